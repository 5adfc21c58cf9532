"""Files that are followed: what is young waits, what vanishes goes, a tick that runs again replaces itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.sources import files
from recollect.streaming import sync

FILES = "path string, text string, size long, mtime_ms long"


def listing(spark, rows):
    return spark.createDataFrame([(p, t, len(t), m) for p, t, m in rows], FILES)


def seen(spark, folder):
    return sorted((r.epoch, r.path, r.change) for r in sync.log(spark, folder).collect())


def texts(spark, folder):
    return sorted((r.source_doc, r.kind, r.text) for r in sync.current(spark, folder).collect())


def test_follow(spark, tmp_path):
    folder, rows, now = f"file://{tmp_path}/f", [], [1000]
    run = lambda: sync.follow(spark, lambda: listing(spark, rows), folder, clock=lambda: now[0]).awaitTermination()
    run()
    assert seen(spark, folder) == [] and texts(spark, folder) == []
    rows[:] = [("a.md", "# A\n\ntext", 500), ("b.md", "- one\n- two", 900), ("c.md", "gone soon", 500)]
    run()
    assert seen(spark, folder) == [(1, "a.md", "new"), (1, "c.md", "new")]  # b is too young
    rows[:] = [("a.md", "# A\n\ntext", 700), ("b.md", "- one\n- two", 900)]  # a touched without a change, c gone
    now[0] = 2000
    run()
    assert seen(spark, folder)[2:] == [(2, "b.md", "new"), (2, "c.md", "gone")]
    assert texts(spark, folder) == [("a.md", "heading", "A"), ("a.md", "paragraph", "text"), ("b.md", "list", "one"), ("b.md", "list", "two")]
    rows[:] = [("a.md", "changed!", 1990), ("b.md", "- one", 1500), ("c.md", "back", 1500)]
    run()
    assert seen(spark, folder)[4:] == [(3, "b.md", "changed"), (3, "c.md", "new")]
    sync.tick(listing(spark, rows), folder, 3, now[0])  # the same tick again
    assert seen(spark, folder)[4:] == [(3, "b.md", "changed"), (3, "c.md", "new")]
    now[0] = 3000
    run()
    assert seen(spark, folder)[6:] == [(4, "a.md", "changed")]
    assert texts(spark, folder) == [("a.md", "paragraph", "changed!"), ("b.md", "list", "one"), ("c.md", "paragraph", "back")]


def test_follow_a_tree_of_files(spark, tmp_path):
    tree, folder = tmp_path / "notes", f"file://{tmp_path}/f"
    (tree / "in").mkdir(parents=True)
    (tree / "in/a.md").write_text("- keep it")
    (tree / "b.txt").write_text("no note")
    run = lambda: sync.follow(spark, lambda: files.markdown(spark, f"file://{tree}"), folder, quiet_ms=0).awaitTermination()
    run()
    (tree / "in/a.md").write_text("- keep it\n- and this")
    (tree / "c.markdown").write_text("late")
    run()
    assert texts(spark, folder) == [("c.markdown", "paragraph", "late"), ("in/a.md", "list", "and this"), ("in/a.md", "list", "keep it")]
    (tree / "in/a.md").unlink()
    run()
    assert texts(spark, folder) == [("c.markdown", "paragraph", "late")]


def test_a_running_query_ticks(spark, tmp_path):
    folder, rows = f"file://{tmp_path}/f", [("a.md", "one", 1)]
    q = sync.follow(spark, lambda: listing(spark, rows), folder, parse=lambda d: d.select("source_doc", F.upper("text").alias("text")), every="200 milliseconds")
    try:
        while len(q.recentProgress) < 3 and q.isActive:
            q.awaitTermination(1)
    finally:
        q.stop()
    assert q.exception() is None and [r.text for r in sync.current(spark, folder).collect()] == ["ONE"]
