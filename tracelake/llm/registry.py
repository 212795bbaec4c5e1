"""The queries of this subpackage and their SQL."""

from . import bpe, chunks, decontaminate, lm_scores, pu_quality, quality_rules, revisits, secrets, sharding, simhash

_MODULES = (lm_scores, quality_rules, decontaminate, secrets, simhash, bpe, pu_quality, sharding, chunks, revisits)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
