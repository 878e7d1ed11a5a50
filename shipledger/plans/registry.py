"""Registered queries: ``name -> (spark_fn(spark, sf_dir) -> DataFrame)`` and,
where SQL can state the same thing, ``name -> DuckDB SQL`` over the driver's
views. Every query runs the whole chain over the whole driver tables: adapter
-> cleaning -> the operator under test. Column names and types agree between
the two sides (decimals leave as double, counts as bigint)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shipledger import constants as K
from shipledger.plans import oracle as O
from shipledger.plans.build import processed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, Callable[[], str]] = {}


def register(name: str, sql: Callable[[], str] | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return processed(spark, sf_dir).table


# ---------------------------------------------------------------------------
# SQL snippets shared by the oracle texts
# ---------------------------------------------------------------------------

def pct(k: str, n: str) -> str:
    return f"(CAST(100 AS DOUBLE) * (CAST({k} AS DOUBLE) / CAST(NULLIF({n}, 0) AS DOUBLE)))"


def msum(expr: str) -> str:
    return f"CAST(coalesce(sum({expr}), 0) AS DOUBLE)"


def cnt(cond: str | None = None) -> str:
    return f"CAST(count_if({cond}) AS BIGINT)" if cond else "CAST(count(*) AS BIGINT)"


def carrier_rank_sql(col: str = "carrier") -> str:
    whens = " ".join(f"WHEN {O.q(c)} THEN {i}" for i, c in enumerate(K.CARRIER_ORDER))
    return f"CAST(CASE {col} {whens} ELSE {len(K.CARRIER_ORDER)} END AS INTEGER)"


KPI_SQL = f"""
    {msum("CASE WHEN is_billable THEN freight_cost_eur END")} AS total_spend,
    {cnt()} AS orders,
    {cnt("is_billable")} AS billable_orders,
    {cnt("NOT is_cancelled")} AS active_orders,
    {cnt("is_cancelled")} AS cancelled_orders,
    {cnt("cost_is_outlier")} AS outlier_orders,
    {cnt("is_cancelled OR cost_is_outlier")} AS excluded_from_spend,
    coalesce({pct("count_if(is_on_time AND NOT is_cancelled)", "count_if(NOT is_cancelled)")}, 0.0) AS on_time_pct,
    coalesce(avg(CASE WHEN is_late AND NOT is_cancelled THEN delay_days END), 0.0) AS avg_delay,
    {cnt("is_late AND NOT is_cancelled")} AS late_orders,
    {msum("CASE WHEN NOT is_cancelled THEN late_penalty_eur END")} AS penalties"""


# ---------------------------------------------------------------------------
# A1 / A2
# ---------------------------------------------------------------------------

def _kpis_sql() -> str:
    return O.base_ctes() + f"\nSELECT {KPI_SQL}\nFROM shipments"


@register("kpis", _kpis_sql)
def q_kpis(spark, sf_dir):
    from shipledger.operators.aggregates import kpis

    return kpis(shipments(spark, sf_dir))


CARRIER_SQL = f"""
    carrier,
    {msum("CASE WHEN is_billable THEN freight_cost_eur END")} AS spend,
    {cnt()} AS orders,
    {cnt("is_billable")} AS billable_orders,
    {pct("count_if(is_on_time AND NOT is_cancelled)", "count_if(NOT is_cancelled)")} AS on_time_pct,
    {msum("CASE WHEN NOT is_cancelled THEN late_penalty_eur END")} AS penalties,
    {msum("CASE WHEN is_billable THEN freight_cost_eur END")}
      / CAST(NULLIF(count_if(is_billable), 0) AS DOUBLE) AS cost_per_shipment,
    {carrier_rank_sql()} AS carrier_rank"""


def _carrier_sql() -> str:
    return O.base_ctes() + f"\nSELECT {CARRIER_SQL}\nFROM shipments WHERE carrier IS NOT NULL GROUP BY carrier"


@register("carrier_spend", _carrier_sql)
def q_carrier_spend(spark, sf_dir):
    from shipledger.operators.aggregates import spend_by_carrier

    return spend_by_carrier(shipments(spark, sf_dir))


from shipledger.plans import (  # noqa: E402,F401
    registry_steps, registry_metrics, registry_findings, registry_views, registry_storage,
)

__all__ = ["QUERIES", "ORACLE", "register"]
