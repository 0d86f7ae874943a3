"""Operators for preparing training data; nothing outside this package imports it."""

from importlib import import_module

from .common import ORACLE, QUERIES

for _name in ("bpe", "decontamination", "line_dedup", "manifest", "packing", "pii", "quality", "secrets", "simhash", "spelling", "token_files", "topk", "warc"):
    import_module(f"{__name__}.{_name}")

__all__ = ["ORACLE", "QUERIES"]
