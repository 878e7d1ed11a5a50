"""DuckDB oracle: the same adapter + cleaning chain + metrics written as plain
SQL over the driver's views, used by the driver's correctness gate and by our
own tests. It is an independent formulation (window dedup, per-set medians as
separate GROUP BYs) of what the Spark plans compute."""

from __future__ import annotations

from shipledger import constants as K
from shipledger.sources import testbook as TB


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def trim_ws(x: str) -> str:
    from shipledger.functions.text import WHITESPACE

    return f"trim({x}, {q(WHITESPACE)})"


def title(x: str) -> str:
    lx = f"lower({x})"
    return (
        f"array_to_string(list_transform(range(1, length({lx}) + 1), lambda i: CASE WHEN i = 1 OR NOT "
        f"regexp_matches(substring({lx}, i - 1, 1), '\\p{{L}}') THEN upper(substring({lx}, i, 1)) "
        f"ELSE substring({lx}, i, 1) END), '')"
    )


def case_map(key: str, mapping: dict, cast: str | None = None) -> str:
    whens = " ".join(
        f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else repr(v)}" for k, v in mapping.items()
    )
    expr = f"CASE {key} {whens} END"
    return f"CAST({expr} AS {cast})" if cast else expr


#: the layouts of the adapter's dates, and no others
_DATE_LAYOUTS = ["%Y-%m-%d", "%d/%m/%Y", "%b %d, %Y", "%Y-%m-%d %H:%M:%S", "%d-%m-%Y", "%Y-%m-%dT%H:%M:%SZ",
                 "%d/%m/%Y %H:%M", "%d %B %Y"]


def parse_date(x: str) -> str:
    x = trim_ws(x)
    tries = ", ".join(f"try_strptime({x}, {q(f)})" for f in _DATE_LAYOUTS)
    return f"CAST(coalesce({tries}) AS DATE)"


def _raw_cte() -> str:
    cost = "round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(0.002 AS DECIMAL(4,3)) + 18, 2)"
    return f"""
_li AS (
  SELECT l_orderkey AS o, l_partkey AS k, l_suppkey AS s, l_linenumber AS ln, l_quantity, l_extendedprice,
         l_shipdate AS ts, c_custkey AS c, c_name, c_mktsegment, s_nationkey, n_name
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN nation ON s_nationkey = n_nationkey
),
raw AS (
  SELECT
    CASE WHEN k % 1013 = 0 THEN NULL ELSE 'ORD-' || CAST(o AS VARCHAR) || '-' || CAST(ln AS VARCHAR) END AS order_id,
    CASE WHEN k % 83 = 0 THEN NULL WHEN k % 89 = 0 THEN 'junk'
         WHEN o % 8 = 0 THEN strftime(ts, '%Y-%m-%d')
         WHEN o % 8 = 1 THEN strftime(ts, '%d/%m/%Y')
         WHEN o % 8 = 2 THEN strftime(ts, '%b %d, %Y')
         WHEN o % 8 = 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
         WHEN o % 8 = 4 THEN strftime(ts, '%d-%m-%Y')
         WHEN o % 8 = 5 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
         WHEN o % 8 = 6 THEN strftime(ts, '%d/%m/%Y %H:%M')
         ELSE strftime(ts, '%d %B %Y') END AS ship_date,
    CASE WHEN k % 101 = 0 THEN 'Acme Road' ELSE ({arr(TB.CARRIER_SPELLINGS)})[1 + (s % 6) * 2 + k % 2] END AS carrier,
    n_name AS origin_city,
    ({arr(TB.ORIGINS)})[1 + s_nationkey % 5] AS origin_country,
    CASE WHEN k % 17 = 0 THEN '  ' || c_name || ' ' ELSE c_name END AS destination_city,
    ({arr(TB.DESTINATIONS)})[1 + c % 14] AS destination_country,
    ({arr([n for n, _ in TB.SERVICES])})[1 + ln % 4] AS service_level,
    c_mktsegment AS customer_segment,
    CASE WHEN k % 107 = 0 THEN '0' ELSE CAST(l_quantity AS VARCHAR) END AS weight_kg,
    CASE WHEN k % 67 = 0 THEN NULL WHEN k % 199 = 0 THEN CAST({cost} * 10 AS VARCHAR)
         ELSE CAST({cost} AS VARCHAR) END AS freight_cost,
    CASE WHEN k % 103 = 0 THEN 'XYZ' ELSE ({arr(TB.CURRENCIES)})[1 + o % 6] END AS currency,
    CASE WHEN k % 53 = 0 THEN NULL WHEN k % 997 = 0 THEN '-3'
         ELSE CAST(1 + (k * 7 + s * 13 + o) % 6
                   + CASE WHEN s % 6 = 0 AND dayname(ts) = 'Friday' AND c % 14 < 5 THEN 3 ELSE 0 END AS VARCHAR)
    END AS transit_days,
    ({arr([p for _, p in TB.SERVICES])})[1 + ln % 4] AS promised_days,
    CASE WHEN o % 71 = 0 THEN 'CANCELLED' WHEN o % 50 = 1 AND k % 2 = 0 THEN 'IN TRANSIT'
         WHEN o % 50 = 1 THEN 'In Transit' ELSE 'Delivered' END AS status,
    {q(TB.SOURCE_NAME)} AS source_file,
    row_number() OVER (ORDER BY k, s, l_extendedprice, o, ln) AS file_pos,
    k AS _part
  FROM _li
)"""


def _clean_ctes() -> str:
    toks = ", ".join(q(t) for t in K.NULL_TOKENS)
    nt = {c: f"CASE WHEN {c} IN ({toks}) THEN NULL ELSE {c} END" for c in K.REQUIRED_COLUMNS}
    padded = " + ".join(
        f"CAST(length(coalesce({c}, '')) <> length({trim_ws(f'coalesce({c}, {q(str())})')}) AS INTEGER)"
        for c in K.TEXT_COLUMNS
    )
    trimmed = {c: trim_ws(c) for c in K.TEXT_COLUMNS}
    for c in ("origin_country", "destination_country", "currency"):
        trimmed[c] = f"upper({trimmed[c]})"
    for c in ("status", "service_level"):
        trimmed[c] = title(trimmed[c])
    key = "regexp_replace(lower(coalesce(carrier, '')), '[^a-z]', '', 'g')"
    canon = case_map(key, K.CANONICAL_CARRIERS)
    rate = case_map("currency", K.FX_TO_EUR, "DECIMAL(6,3)")
    ce = ", ".join(q(c) for c in K.CENTRAL_EUROPE)
    num = lambda c: f"CASE WHEN isnan(TRY_CAST({c} AS DOUBLE)) THEN NULL ELSE TRY_CAST({c} AS DOUBLE) END"
    return f"""
_tok AS (
  SELECT {", ".join(f"{nt[c]} AS {c}" for c in K.REQUIRED_COLUMNS)}, source_file, file_pos FROM raw
),
_txt AS (
  SELECT {padded} AS _padded,
    {", ".join(f"{trimmed[c]} AS {c}" for c in K.TEXT_COLUMNS)},
    ship_date, weight_kg, freight_cost, transit_days, promised_days, source_file, file_pos, carrier AS carrier_raw
  FROM _tok
),
_car AS (
  SELECT *, {canon} AS _canon FROM _txt
),
_row AS (
  SELECT * EXCLUDE (carrier, _canon, ship_date, weight_kg, freight_cost, transit_days, promised_days),
    _canon IS NULL AS _carrier_unmapped,
    _canon IS NOT NULL AND _canon IS DISTINCT FROM carrier AS _carrier_changed,
    coalesce(_canon, carrier) AS carrier,
    ship_date AS ship_date_raw,
    {parse_date("ship_date")} AS ship_date,
    {num("weight_kg")} AS weight_kg,
    TRY_CAST(freight_cost AS DECIMAL(24,6)) AS freight_cost,
    {num("transit_days")} AS _transit_in,
    {num("promised_days")} AS promised_days
  FROM _car
),
_fx AS (
  SELECT * EXCLUDE (_transit_in),
    coalesce(_transit_in < 0, false) AS _transit_voided,
    CASE WHEN _transit_in >= 0 THEN _transit_in END AS transit_days,
    {rate} IS NULL AS _ccy_unknown,
    CAST(round(freight_cost * {rate}, 2) AS DECIMAL(18,2)) AS freight_cost_eur,
    origin_country || ' → ' || destination_country AS lane
  FROM _row
),
annotated AS (
  SELECT *,
    coalesce(currency <> 'EUR', true) AND freight_cost_eur IS NOT NULL AS _converted,
    CASE WHEN ship_date IS NULL THEN {q(K.REMOVED_UNDATED)}
         WHEN row_number() OVER (PARTITION BY order_id, ship_date IS NULL ORDER BY file_pos) > 1
         THEN {q(K.REMOVED_DUPLICATE)} END AS _removed
  FROM _fx
),
kept AS (SELECT * FROM annotated WHERE _removed IS NULL),
_lim AS (
  SELECT service_level,
    quantile_cont(CAST(freight_cost_eur AS DOUBLE), 0.75)
      + {K.OUTLIER_IQR_MULTIPLIER} * (quantile_cont(CAST(freight_cost_eur AS DOUBLE), 0.75)
                                     - quantile_cont(CAST(freight_cost_eur AS DOUBLE), 0.25)) AS _upper
  FROM kept WHERE service_level IS NOT NULL
  GROUP BY service_level HAVING count(freight_cost_eur) >= {K.OUTLIER_MIN_VALUES}
),
_lane AS (
  SELECT lane, service_level, median(transit_days) AS _lane_transit
  FROM kept WHERE lane IS NOT NULL AND service_level IS NOT NULL GROUP BY lane, service_level
),
_cmed AS (
  SELECT carrier, service_level, median(CAST(freight_cost_eur AS DOUBLE)) AS _carrier_cost
  FROM kept WHERE carrier IS NOT NULL AND service_level IS NOT NULL GROUP BY carrier, service_level
),
_glob AS (
  SELECT median(transit_days) AS _g_transit, median(CAST(freight_cost_eur AS DOUBLE)) AS _g_cost,
         median(promised_days) AS _g_promised
  FROM kept
),
_imp AS (
  SELECT kept.* EXCLUDE (transit_days, freight_cost_eur, promised_days),
    status = 'Cancelled' AS is_cancelled,
    coalesce(CAST(kept.freight_cost_eur AS DOUBLE) > _upper, false) AS cost_is_outlier,
    kept.transit_days IS NULL AND NOT (status = 'Cancelled') AS transit_days_imputed,
    kept.transit_days IS NULL AND status = 'Cancelled' AS _transit_missing_cancelled,
    CASE WHEN NOT (status = 'Cancelled')
         THEN CAST(round_even(coalesce(kept.transit_days, _lane_transit, _g_transit), 0) AS INTEGER) END AS transit_days,
    kept.freight_cost_eur IS NULL AS cost_is_imputed,
    CAST(coalesce(kept.freight_cost_eur, round(CAST(_carrier_cost AS DECIMAL(18,4)), 2),
                  round(CAST(_g_cost AS DECIMAL(18,4)), 2)) AS DECIMAL(18,2)) AS freight_cost_eur,
    CAST(trunc(coalesce(kept.promised_days, _g_promised)) AS INTEGER) AS promised_days
  FROM kept
  LEFT JOIN _lim USING (service_level)
  LEFT JOIN _lane USING (lane, service_level)
  LEFT JOIN _cmed USING (carrier, service_level)
  CROSS JOIN _glob
),
_del AS (
  SELECT *, CAST(CASE WHEN is_cancelled THEN 0 ELSE coalesce(greatest(transit_days - promised_days, 0), 0) END
                 AS INTEGER) AS delay_days
  FROM _imp
),
full_ AS (
  SELECT *,
    delay_days > 0 AND NOT is_cancelled AS is_late,
    NOT (delay_days > 0 AND NOT is_cancelled) AND NOT is_cancelled AS is_on_time,
    CAST(CAST(delay_days AS DECIMAL(18,2)) * CAST({K.LATE_PENALTY_EUR_PER_DAY} AS DECIMAL(18,2)) AS DECIMAL(18,2))
      AS late_penalty_eur,
    ship_date + transit_days AS delivery_date,
    dayname(ship_date) AS ship_weekday,
    CAST(date_trunc('week', ship_date) AS DATE) AS ship_week,
    CAST(date_trunc('month', ship_date) AS DATE) AS ship_month,
    coalesce(destination_country IN ({ce}), false) AS is_central_europe,
    CAST(round(CAST(CAST(freight_cost_eur AS DOUBLE) / CASE WHEN weight_kg <> 0 THEN weight_kg END
                    AS DECIMAL(38,10)), 2) AS DECIMAL(18,2)) AS cost_per_kg,
    NOT is_cancelled AND NOT cost_is_outlier AS is_billable
  FROM _del
),
shipments AS (SELECT * FROM full_)"""


def base_ctes() -> str:
    """``WITH`` clause defining raw, annotated, kept, full_ and shipments."""
    return "WITH " + _raw_cte().strip() + "," + _clean_ctes()


def with_ctes(*extra: str) -> str:
    """The base chain plus extra named CTEs (``name AS (...)`` strings)."""
    body = base_ctes()
    for e in extra:
        body += ",\n" + e
    return body
