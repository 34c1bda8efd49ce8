"""All queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ("ann", "webp", "toxicity", "pii", "mixing", "warc", "quality", "packing", "url_filter", "simhash_dedup")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"{__package__}.{m}").ORACLE.items()}
