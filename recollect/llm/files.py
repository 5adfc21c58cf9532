"""Files in the shared folder, by any file system that pyarrow knows (file, hdfs, s3, gs)."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):  # file:/a, file:///a
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


@contextmanager
def written(uri: str):
    """A stream whose file gets its name only once it is whole, so a task that is lost or repeated leaves no part behind."""
    system, path = opened(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part, compression=None) as out:
        yield out
    system.move(part, path)


def stream(uri: str):
    system, path = opened(uri)
    return system.open_input_stream(path, compression=None)


def ranged(uri: str):
    """An open file that can be read from any place."""
    system, path = opened(uri)
    return system.open_input_file(path)


def contents(uri: str) -> bytes:
    with stream(uri) as f:
        return f.read()
