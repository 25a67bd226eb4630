"""Query registry: name -> (callable(spark, sf_dir) -> DataFrame, oracle SQL or None)."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def load_all():
    """Import every plan module so their queries register."""
    from telemark.plans import telemetry, enrichment, evaluation, corpus, catalog, runlog, loglines  # noqa: F401
    return QUERIES, ORACLES
