"""The queries of the curation operators and the SQL that each must agree with."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame, with its SQL where there is one."""

    def keep(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return keep


from . import curation_queries, fact_queries, gate_queries, more_queries, telemetry_queries  # noqa: E402, F401  they register themselves
