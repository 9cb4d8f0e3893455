"""Corpus operators for training-data pipelines: mixing, chat formatting, language
identification, vector search, near and exact deduplication, token files, licence
scans, toxicity and byte-pair encoding.

Each module holds one operator with its general interface; `queries` derives the
registered digests from them. Nothing else in the package imports this folder.
"""
