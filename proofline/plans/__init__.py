"""Registered queries: name -> (function of spark and sf_dir, DuckDB SQL or None)."""

from proofline.plans import audits, corpus, evidence, grids, retrieval, stored

QUERIES = {**retrieval.QUERIES, **corpus.QUERIES, **evidence.QUERIES, **audits.QUERIES, **grids.QUERIES, **stored.QUERIES}
