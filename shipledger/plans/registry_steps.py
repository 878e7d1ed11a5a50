"""Registered queries for the cleaning steps (C1-C23, D1-D4) and the audit
(Q1-Q6). Each one runs the whole chain over the whole driver tables and
exposes the step's effect, so a wrong step shows as a value mismatch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shipledger import constants as K
from shipledger.operators import audit
from shipledger.operators.aggregates import trend
from shipledger.operators.clean import null_flags
from shipledger.plans import oracle as O
from shipledger.plans.build import processed
from shipledger.plans.registry import cnt, msum, register
from shipledger.schema import FLAG_COLUMNS, SHIPMENT_SCHEMA
from shipledger.session import stage_root
from shipledger.sources import store
from shipledger.sources.ingest import read_exports, reconcile_frames, split_vocabularies
from shipledger.sources.testbook import SOURCE_NAME, SPLIT_EXPORTS, SYSTEMS, raw_shipments, write_exports


def _sql(body: str, *extra: str) -> str:
    return O.with_ctes(*extra) + "\n" + body


# --- S4/S5/S7/S8 reconciled union -------------------------------------------

def _union_sql() -> str:
    names = " ".join(f"WHEN {i} THEN {O.q(n)}" for i, (n, _) in enumerate(SPLIT_EXPORTS))
    toks = ", ".join(O.q(t) for t in K.NULL_TOKENS)
    cols = ", ".join(f"CASE WHEN {c} IN ({toks}) THEN NULL ELSE {c} END AS {c}" for c in K.REQUIRED_COLUMNS)
    return _sql(f"SELECT CASE _part % 3 {names} END AS source_file, {cols} FROM raw")


@register("reconciled_union", _union_sql)
def q_reconciled_union(spark, sf_dir):
    """The raw export split into three systems' header vocabularies, then
    mapped back (snake-case + aliases), aligned by name and unioned."""
    frames = split_vocabularies(raw_shipments(spark, sf_dir))
    union = reconcile_frames(frames)
    return union.select("source_file", *K.REQUIRED_COLUMNS)


# --- C1-C3 text ---------------------------------------------------------------

def _text_sql() -> str:
    return _sql(
        f"""SELECT status, service_level, currency, origin_country, destination_country, customer_segment,
  {cnt()} AS rows, CAST(sum(_padded) AS BIGINT) AS padded_cells,
  CAST(sum(length(destination_city)) AS BIGINT) AS city_chars
FROM annotated GROUP BY ALL"""
    )


@register("normalised_text", _text_sql)
def q_normalised_text(spark, sf_dir):
    a = processed(spark, sf_dir).annotated
    return a.groupBy("status", "service_level", "currency", "origin_country", "destination_country",
                     "customer_segment").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("_padded").cast("long").alias("padded_cells"),
        F.sum(F.length("destination_city")).cast("long").alias("city_chars"),
    )


# --- C4/C5 carriers -------------------------------------------------------------

def _carrier_sql() -> str:
    return _sql(f"""SELECT carrier_raw, carrier, _carrier_unmapped AS unmapped, _carrier_changed AS changed,
  {cnt()} AS rows FROM annotated GROUP BY ALL""")


@register("carrier_canonical", _carrier_sql)
def q_carrier_canonical(spark, sf_dir):
    a = processed(spark, sf_dir).annotated
    return a.groupBy("carrier_raw", "carrier", F.col("_carrier_unmapped").alias("unmapped"),
                     F.col("_carrier_changed").alias("changed")).agg(F.count(F.lit(1)).alias("rows"))


# --- C6/C7 dates ------------------------------------------------------------------

def _dates_sql() -> str:
    return _sql(f"SELECT ship_date_raw, ship_date, {cnt()} AS rows FROM annotated GROUP BY ALL")


@register("parsed_dates", _dates_sql)
def q_parsed_dates(spark, sf_dir):
    a = processed(spark, sf_dir).annotated
    return a.groupBy("ship_date_raw", "ship_date").agg(F.count(F.lit(1)).alias("rows"))


# --- C8-C11 numerics and FX ---------------------------------------------------------

def _fx_sql() -> str:
    return _sql(f"""SELECT currency, {cnt()} AS rows,
  CAST(sum(freight_cost) AS DOUBLE) AS cost_raw, CAST(sum(freight_cost_eur) AS DOUBLE) AS cost_eur,
  {cnt("_ccy_unknown")} AS unknown_currency, {cnt("_converted")} AS converted,
  {cnt("freight_cost_eur IS NULL")} AS cost_missing, {cnt("_transit_voided")} AS transit_voided,
  {cnt("weight_kg = 0")} AS zero_weight
FROM kept GROUP BY currency""")


@register("fx", _fx_sql)
def q_fx(spark, sf_dir):
    kept = processed(spark, sf_dir).annotated.filter(F.col("_removed").isNull())
    return kept.groupBy("currency").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("freight_cost").cast("double").alias("cost_raw"),
        F.sum("freight_cost_eur").cast("double").alias("cost_eur"),
        F.count_if(F.col("_ccy_unknown")).alias("unknown_currency"),
        F.count_if(F.col("_converted")).alias("converted"),
        F.count_if(F.col("freight_cost_eur").isNull()).alias("cost_missing"),
        F.count_if(F.col("_transit_voided")).alias("transit_voided"),
        F.count_if(F.col("weight_kg") == 0).alias("zero_weight"),
    )


# --- D1 dedup ------------------------------------------------------------------------

def _dedup_sql() -> str:
    return _sql(f"""SELECT order_id, ship_date, carrier, destination_country,
  CAST(freight_cost_eur AS DOUBLE) AS freight_cost_eur, transit_days
FROM annotated WHERE _removed = {O.q(K.REMOVED_DUPLICATE)}""")


@register("deduplicated", _dedup_sql)
def q_deduplicated(spark, sf_dir):
    a = processed(spark, sf_dir).annotated
    return a.filter(F.col("_removed") == K.REMOVED_DUPLICATE).select(
        "order_id", "ship_date", "carrier", "destination_country",
        F.col("freight_cost_eur").cast("double").alias("freight_cost_eur"), "transit_days",
    )


# --- D2 outliers -----------------------------------------------------------------------

def _outlier_sql() -> str:
    return _sql(f"""SELECT l.service_level, l.n, l.q1, l.q3,
  CASE WHEN l.n >= {K.OUTLIER_MIN_VALUES} THEN round(l.q3r + {K.OUTLIER_IQR_MULTIPLIER} * (l.q3r - l.q1r), 6) END AS upper_limit,
  coalesce(o.outliers, 0) AS outliers
FROM (SELECT service_level, CAST(count(freight_cost_eur) AS BIGINT) AS n,
        round(quantile_cont(CAST(freight_cost_eur AS DOUBLE), 0.25), 6) AS q1,
        round(quantile_cont(CAST(freight_cost_eur AS DOUBLE), 0.75), 6) AS q3,
        quantile_cont(CAST(freight_cost_eur AS DOUBLE), 0.25) AS q1r,
        quantile_cont(CAST(freight_cost_eur AS DOUBLE), 0.75) AS q3r
      FROM kept WHERE service_level IS NOT NULL GROUP BY service_level) l
LEFT JOIN (SELECT service_level, {cnt("cost_is_outlier")} AS outliers FROM shipments GROUP BY service_level) o
USING (service_level)""")


@register("outliers", _outlier_sql)
def q_outliers(spark, sf_dir):
    from shipledger.operators.clean import SET_OUTLIER

    c = processed(spark, sf_dir)
    lim = c.stats.filter(F.col("set") == SET_OUTLIER).select(
        F.col("k1").alias("service_level"), "n",
        F.round("q1", 6).alias("q1"), F.round("q3", 6).alias("q3"),
        F.when(F.col("n") >= K.OUTLIER_MIN_VALUES,
               F.round(F.col("q3") + F.lit(K.OUTLIER_IQR_MULTIPLIER) * (F.col("q3") - F.col("q1")), 6)).alias("upper_limit"),
    )
    out = c.table.groupBy("service_level").agg(F.count_if(F.col("cost_is_outlier")).alias("outliers"))
    return lim.join(out, "service_level", "left").fillna({"outliers": 0})


# --- D3 / C9 / C21 transit, D4 cost ------------------------------------------------------

def _transit_sql() -> str:
    return _sql("""SELECT order_id, lane, service_level, transit_days, promised_days, transit_days_imputed, is_cancelled
FROM full_ WHERE transit_days_imputed OR _transit_missing_cancelled""")


@register("transit_imputed", _transit_sql)
def q_transit_imputed(spark, sf_dir):
    full = processed(spark, sf_dir).full
    return full.filter(F.col("transit_days_imputed") | F.col("_transit_missing_cancelled")).select(
        "order_id", "lane", "service_level", "transit_days", "promised_days", "transit_days_imputed", "is_cancelled"
    )


def _cost_sql() -> str:
    return _sql("""SELECT order_id, carrier, service_level, CAST(freight_cost_eur AS DOUBLE) AS freight_cost_eur
FROM shipments WHERE cost_is_imputed""")


@register("cost_imputed", _cost_sql)
def q_cost_imputed(spark, sf_dir):
    t = processed(spark, sf_dir).table
    return t.filter(F.col("cost_is_imputed")).select(
        "order_id", "carrier", "service_level", F.col("freight_cost_eur").cast("double").alias("freight_cost_eur")
    )


# --- C12-C20 the whole derived table --------------------------------------------------------

def _derived_cols_spark():
    out = []
    for f in SHIPMENT_SCHEMA.fields:
        if f.dataType.typeName() == "decimal":
            out.append(F.col(f.name).cast("double").alias(f.name))
        else:
            out.append(F.col(f.name))
    return out


def _derived_sql() -> str:
    cols = [
        f"CAST({f.name} AS DOUBLE) AS {f.name}" if f.dataType.typeName() == "decimal" else f.name
        for f in SHIPMENT_SCHEMA.fields
    ]
    return _sql("SELECT " + ", ".join(cols) + " FROM shipments")


@register("derived", _derived_sql)
def q_derived(spark, sf_dir):
    """The whole processed table (every derived column, every kept row)."""
    return processed(spark, sf_dir).table.select(*_derived_cols_spark())


# --- Q6 rejects, Q1 log, Q2-Q5 -----------------------------------------------------------

def _rejects_sql() -> str:
    return _sql("SELECT source_file, order_id, ship_date_raw, carrier, _removed AS reason FROM annotated "
                "WHERE _removed IS NOT NULL")


@register("rejects", _rejects_sql)
def q_rejects(spark, sf_dir):
    return processed(spark, sf_dir).rejects()


def _py_list_sql(expr: str) -> str:
    return f"'[' || array_to_string(list_transform({expr}, lambda x: '''' || x || ''''), ', ') || ']'"


def _log_sql() -> str:
    L = audit
    counts = f"""_c AS (
  SELECT
    (SELECT CAST(count(*) AS BIGINT) FROM annotated) AS rows_in,
    (SELECT CAST(sum(_padded) AS BIGINT) FROM annotated) AS padded,
    (SELECT {cnt("_carrier_unmapped")} FROM annotated) AS unmapped,
    (SELECT {cnt("_carrier_changed")} FROM annotated) AS changed,
    (SELECT CAST(count(DISTINCT carrier) AS BIGINT) FROM annotated) AS n_carriers,
    (SELECT {cnt("ship_date IS NOT NULL")} FROM annotated) AS parsed,
    (SELECT {cnt("_removed = " + O.q(K.REMOVED_UNDATED))} FROM annotated) AS undated,
    (SELECT {cnt("_removed = " + O.q(K.REMOVED_DUPLICATE))} FROM annotated) AS dupes,
    (SELECT {cnt("_transit_voided")} FROM kept) AS neg_transit,
    (SELECT {cnt("_ccy_unknown")} FROM kept) AS unknown_ccy,
    (SELECT {cnt("_converted")} FROM kept) AS converted,
    (SELECT CAST(count(*) AS BIGINT) FROM full_) AS rows_out,
    (SELECT {cnt("cost_is_outlier")} FROM full_) AS outliers,
    (SELECT {cnt("transit_days_imputed")} FROM full_) AS transit_imputed,
    (SELECT {cnt("_transit_missing_cancelled")} FROM full_) AS transit_cancelled,
    (SELECT {cnt("cost_is_imputed")} FROM full_) AS cost_imputed,
    (SELECT list_sort(list(carrier)) FROM (SELECT DISTINCT carrier FROM annotated
       WHERE _carrier_unmapped AND carrier IS NOT NULL ORDER BY carrier LIMIT 10)) AS carrier_names,
    (SELECT CAST(count(DISTINCT currency) AS BIGINT) FROM kept WHERE _ccy_unknown) AS n_ccy
)"""

    def row(seq, step, action, n, detail, cond="true"):
        return (f"SELECT {seq} AS seq, {O.q(step)} AS step, {O.q(action)} AS action, CAST({n} AS BIGINT) AS rows_affected, "
                f"{detail} AS detail FROM _c WHERE {cond}")

    parts = [
        f"SELECT 1 AS seq, {O.q(L.LOG_INGEST[0])} AS step, {O.q(L.LOG_INGEST[1])} AS action, "
        f"CAST(count(*) AS BIGINT) AS rows_affected, source_file || ' ({len(K.REQUIRED_COLUMNS)} columns)' AS detail "
        "FROM annotated GROUP BY source_file",
        row(3, *L.LOG_TRIM[:2], "padded", O.q(L.LOG_TRIM[2])),
        row(4, *L.LOG_CARRIER_FLAG, "unmapped", _py_list_sql("carrier_names"), "unmapped > 0"),
        row(5, *L.LOG_CARRIER_MAP[:2], "changed", f"CAST(n_carriers AS VARCHAR) || {O.q(' ' + L.LOG_CARRIER_MAP[2])}"),
        row(6, *L.LOG_DATES[:2], "parsed", O.q(L.LOG_DATES[2])),
        row(7, *L.LOG_UNDATED[:2], "undated", O.q(L.LOG_UNDATED[2]), "undated > 0"),
        row(8, *L.LOG_DUPES[:2], "dupes", O.q(L.LOG_DUPES[2]), "dupes > 0"),
        row(9, *L.LOG_NEG[:2], "neg_transit", O.q(L.LOG_NEG[2]), "neg_transit > 0"),
        row(10, *L.LOG_CCY_FLAG, "unknown_ccy", f"CAST(n_ccy AS VARCHAR) || {O.q(L.CCY_DETAIL)}", "unknown_ccy > 0"),
        row(11, *L.LOG_CCY[:2], "converted", O.q("rates: {'EUR': 1.0, 'USD': 0.92, 'SEK': 0.087}")),
        row(12, *L.LOG_OUTLIERS[:2], "outliers", O.q("IQR rule per service level, multiplier 3.0")),
        row(13, *L.LOG_IMP_TRANSIT[:2], "transit_imputed", O.q(L.LOG_IMP_TRANSIT[2])),
        row(14, *L.LOG_IMP_CANCELLED[:2], "transit_cancelled", O.q(L.LOG_IMP_CANCELLED[2])),
        row(15, *L.LOG_IMP_COST[:2], "cost_imputed", O.q(L.LOG_IMP_COST[2])),
        row(16, *L.LOG_DERIVE[:2], "rows_out", O.q("late penalty assumption: €45 per shipment per day late")),
    ]
    return _sql("\nUNION ALL\n".join(parts), counts)


@register("cleaning_log", _log_sql)
def q_cleaning_log(spark, sf_dir):
    return audit.cleaning_log(processed(spark, sf_dir))


def _values_sql() -> str:
    return _sql(f"""SELECT {O.q(audit.LOG_CARRIER_FLAG[0])} AS step, carrier AS value, {cnt()} AS rows
FROM annotated WHERE _carrier_unmapped GROUP BY carrier
UNION ALL
SELECT {O.q(audit.LOG_CCY_FLAG[0])}, currency, {cnt()} FROM kept WHERE _ccy_unknown GROUP BY currency""")


@register("cleaning_log_values", _values_sql)
def q_cleaning_log_values(spark, sf_dir):
    """Every unmapped carrier name and unknown currency, with its rows."""
    return audit.cleaning_log_values(processed(spark, sf_dir))


def _totals_sql() -> str:
    return _sql(f"""SELECT {cnt()} AS rows_in, {cnt("_removed IS NOT NULL")} AS rows_removed,
  {cnt("_removed IS NULL")} AS rows_out, true AS reconciles, {O.q(SOURCE_NAME)} AS sources,
  '{{"EUR":1.0,"USD":0.92,"SEK":0.087}}' AS fx_to_eur, CAST(45 AS DOUBLE) AS late_penalty_eur_per_day,
  CAST(3 AS DOUBLE) AS outlier_iqr_multiplier FROM annotated""")


@register("log_totals", _totals_sql)
def q_log_totals(spark, sf_dir):
    """The log's totals and assumptions (without the time stamp)."""
    t = audit.totals(processed(spark, sf_dir))
    return t.select("rows_in", "rows_removed", "rows_out", "reconciles", F.array_join("sources", ",").alias("sources"),
                    "assumptions.*")


def _null_flags_sql() -> str:
    return _sql("SELECT " + ", ".join(f"{cnt(f'{c} IS NULL')} AS {c}" for c in FLAG_COLUMNS) + " FROM shipments")


@register("null_flags", _null_flags_sql)
def q_null_flags(spark, sf_dir):
    return null_flags(processed(spark, sf_dir).table)


@register("storage_roundtrip", _derived_sql)
def q_storage_roundtrip(spark, sf_dir):
    """The processed table written as gzip CSV, read back with the
    pinned types."""
    path = f"{stage_root(spark)}/stages/roundtrip-{uuid.uuid4().hex}"
    t = processed(spark, sf_dir).table
    store.write_processed(t, f"{path}/parquet", csv_path=f"{path}/csv", partition_by=None)
    return store.read_processed(spark, f"{path}/csv", "csv").select(*_derived_cols_spark())


def _exports_sql() -> str:
    systems = " ".join(f"WHEN {i} THEN {O.q(name)}" for i, (name, _, _) in enumerate(SYSTEMS))
    city = "'He said \"hi\", |' || chr(10) || destination_city"
    others = ", ".join(c for c in K.REQUIRED_COLUMNS if c != "destination_city")
    return _sql(f"""SELECT CASE _part % 3 {systems} END AS system, {others},
  CASE WHEN _part % 3 = 2 THEN {city} ELSE destination_city END AS destination_city FROM raw""")


@register("ingested_exports", _exports_sql)
def q_ingested_exports(spark, sf_dir):
    """The raw export written as CSVs of three vocabularies and
    delimiters (doubled quotes and line breaks inside fields, a space in file
    names, equal base names), then read back."""
    top = f"{stage_root(spark)}/stages/exports-{uuid.uuid4().hex}"
    files = write_exports(spark, raw_shipments(spark, sf_dir), top)
    got = read_exports(spark, [path for _, path in files]).raw
    systems = spark.createDataFrame([(i, system) for i, (system, _) in enumerate(files)], "_file int, system string")
    return got.where("not _surplus").join(systems, "_file").select("system", *K.REQUIRED_COLUMNS)


def _recon_sql() -> str:
    from shipledger.plans.registry import CARRIER_SQL, KPI_SQL

    tr = trend_sql_ctes("shipments", "ship_week", "week", "_tw")
    k = f"_k AS (SELECT {KPI_SQL} FROM shipments)"
    car = (f"_csum AS (SELECT CAST(sum(orders) AS BIGINT) AS co, CAST(sum(billable_orders) AS BIGINT) AS cb, "
           f"sum(spend) AS cs FROM (SELECT {CARRIER_SQL} FROM shipments WHERE carrier IS NOT NULL GROUP BY carrier))")
    ann = (f"_ann AS (SELECT CAST(count(*) AS BIGINT) AS rows_in, {cnt('_removed IS NOT NULL')} AS rows_removed, "
           f"{cnt('_removed IS NOT NULL AND _removed IN (' + O.q(K.REMOVED_UNDATED) + ', ' + O.q(K.REMOVED_DUPLICATE) + ')')}"
           " AS logged FROM annotated)")
    wk = (f"_wk AS (SELECT (SELECT coalesce(sum(spend), 0) FROM _tw) AS weekly_spend, "
          f"(SELECT {msum('CASE WHEN is_billable THEN freight_cost_eur END')} FROM shipments "
          f"WHERE ship_week IN (SELECT period FROM _tw)) AS billable_in_kept_weeks)")
    return _sql(
        """SELECT rows_in, rows_removed, orders AS rows_out,
  rows_in - rows_removed = orders AS rows_reconcile,
  logged = rows_removed AS removals_logged,
  co = orders AS carrier_orders_match,
  cb = billable_orders AS carrier_billable_match,
  abs(cs - total_spend) < 1.0 AS carrier_spend_match,
  orders - billable_orders = excluded_from_spend AS spend_gap_explained,
  active_orders = orders - cancelled_orders AS active_is_orders_minus_cancelled,
  abs(weekly_spend - billable_in_kept_weeks) < 1.0 AS weekly_spend_match
FROM _k, _csum, _ann, _wk""",
        *tr, k, car, ann, wk,
    )


@register("reconciliation", _recon_sql)
def q_reconciliation(spark, sf_dir):
    c = processed(spark, sf_dir)
    return audit.reconciliation(c)


def _invariants_sql() -> str:
    carriers = ", ".join(O.q(x) for x in K.CARRIER_ORDER)
    return _sql(f"""SELECT
  {cnt("order_id IS NULL OR ship_date IS NULL OR carrier IS NULL OR freight_cost_eur IS NULL OR delay_days IS NULL")} AS null_critical,
  {cnt("(transit_days IS NULL) <> is_cancelled")} AS transit_null_not_cancelled,
  {cnt("(delivery_date IS NULL) <> is_cancelled")} AS delivery_null_not_cancelled,
  {cnt("transit_days_imputed AND is_cancelled")} AS cancelled_imputed,
  {cnt("transit_days < 0")} AS negative_transit,
  {cnt("freight_cost_eur < 0")} AS negative_cost,
  {cnt("NOT is_cancelled AND delay_days <> greatest(transit_days - promised_days, 0)")} AS delay_mismatch,
  {cnt("is_on_time AND is_late")} AS late_and_on_time,
  {cnt(f"abs(late_penalty_eur - delay_days * {K.LATE_PENALTY_EUR_PER_DAY}) >= 0.01")} AS penalty_mismatch,
  {cnt("is_cancelled AND is_billable")} AS cancelled_billable,
  {cnt(f"NOT (carrier IN ({carriers}))")} AS non_canonical_carrier,
  (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT order_id, count(*) AS n FROM shipments
     GROUP BY order_id HAVING count(*) > 1)) AS duplicate_ids
FROM shipments""")


@register("invariants", _invariants_sql)
def q_invariants(spark, sf_dir):
    return audit.invariants(processed(spark, sf_dir).table, proven_unique=True)


# --- trend SQL shared with the metrics registry --------------------------------------------

def trend_sql_ctes(src: str, col: str, grain: str, name: str) -> list[str]:
    from shipledger.plans.registry import pct

    per = f"""{name}_per AS (
  SELECT {col} AS period,
    {msum("CASE WHEN is_billable THEN freight_cost_eur END")} AS spend,
    {pct("count_if(is_on_time AND NOT is_cancelled)", "count_if(NOT is_cancelled)")} AS on_time_pct,
    {cnt("NOT is_cancelled")} AS orders,
    {cnt("is_late AND NOT is_cancelled")} AS late_orders,
    {msum("CASE WHEN NOT is_cancelled THEN late_penalty_eur END")} AS penalties,
    avg(CASE WHEN is_late AND NOT is_cancelled THEN delay_days END) AS avg_delay
  FROM {src} GROUP BY {col} HAVING count_if(NOT is_cancelled) > 0)"""
    if grain == "day":
        return [per, f"{name} AS (SELECT * FROM {name}_per)"]
    last_end = "b._last + 6" if grain == "week" else "last_day(b._last)"
    b = f"""{name}_b AS (
  SELECT (SELECT min(ship_date) FROM {src}) AS _lo, (SELECT max(ship_date) FROM {src}) AS _hi,
         count(*) AS _n, min(period) AS _first, max(period) AS _last FROM {name}_per)"""
    keep = f"""{name} AS (
  SELECT p.* FROM {name}_per p, {name}_b b
  WHERE NOT (p.period = b._first AND b._n >= 4 AND b._first < b._lo)
    AND NOT (p.period = b._last AND b._n >= 4 AND {last_end} > b._hi
             AND b._n - CAST(b._n >= 4 AND b._first < b._lo AS INTEGER) > 2))"""
    return [per, b, keep]
