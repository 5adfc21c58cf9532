"""Training-data operators: fingerprints, decontamination, token files, BPE, HTML, quality, joins, shards, lines, WARC."""
