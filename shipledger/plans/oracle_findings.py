"""DuckDB oracle texts for findings (F1-F5, F8) and report formatting (X1-X7),
including per-slice findings. Independent SQL formulation over the same
``shipments`` CTE chain as the other oracles."""

from __future__ import annotations

from shipledger import constants as K
from shipledger.functions.formats import MINUS, NNBSP
from shipledger.operators import findings as FD
from shipledger.plans import oracle as O
from shipledger.plans.registry import KPI_SQL, carrier_rank_sql, cnt, msum, pct

Q = O.q


# ---------------------------------------------------------------------------
# DuckDB formatters: round half up on the shortest decimal form of the double
# ---------------------------------------------------------------------------

def _dbl(x: str) -> str:
    return f"CAST(({x}) AS DOUBLE)"


def rhu(x: str, d: int) -> str:
    return (f"coalesce(CAST(round(TRY_CAST(CAST({_dbl(x)} AS VARCHAR) AS DECIMAL(38,17)), {d}) AS DOUBLE), "
            f"round({_dbl(x)}, {d}))")


def rhe(x: str, d: int) -> str:
    return (f"coalesce(CAST(round_even(TRY_CAST(CAST({_dbl(x)} AS VARCHAR) AS DECIMAL(38,17)), {d}) AS DOUBLE), "
            f"round_even({_dbl(x)}, {d}))")


def none(x: str, body: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN 'none' ELSE {body} END)"


def d_group(x: str, d: int = 0) -> str:
    r = rhu(f"abs({_dbl(x)})", d)
    sign = f"CASE WHEN {_dbl(x)} < 0 AND {r} <> 0 THEN {Q(MINUS)} ELSE '' END"
    return none(x, f"({sign} || replace(format('{{:,.{d}f}}', {r}), ',', {Q(NNBSP)}))")


def d_compact(x: str) -> str:
    a = f"abs({_dbl(x)})"
    body = (f"CASE WHEN {a} >= 1e9 THEN printf('%.1f', {rhu(f'{a} / 1e9', 1)}) || 'bn' "
            f"WHEN {a} >= 1e7 THEN printf('%.1f', {rhu(f'{a} / 1e6', 1)}) || 'M' "
            f"WHEN {a} >= 1e6 THEN printf('%.2f', {rhu(f'{a} / 1e6', 2)}) || 'M' "
            f"WHEN {a} >= 1e4 THEN printf('%.0f', {rhu(f'{a} / 1e3', 0)}) || 'k' "
            f"WHEN {a} >= 1e3 THEN printf('%.1f', {rhu(f'{a} / 1e3', 1)}) || 'k' "
            f"ELSE printf('%.0f', {rhu(a, 0)}) END")
    return none(x, f"((CASE WHEN {_dbl(x)} < 0 THEN {Q(MINUS)} ELSE '' END) || {body})")


def d_money(x: str, exact: bool = True) -> str:
    return none(x, f"({Q('EUR' + NNBSP)} || {d_group(x, 0) if exact else d_compact(x)})")


def d_pct(x: str, decimals: int | None = None) -> str:
    a = f"abs({_dbl(x)})"

    def render(d: int) -> str:
        r = rhu(a, d)
        return (f"((CASE WHEN {_dbl(x)} < 0 AND {r} <> 0 THEN {Q(MINUS)} ELSE '' END) || printf('%.{d}f', {r}) || '%')")

    body = render(decimals) if decimals is not None else f"(CASE WHEN {a} > 0 AND {a} < 1 THEN {render(2)} ELSE {render(1)} END)"
    return none(x, body)


def d_f0(x: str) -> str:
    return f"printf('%.0f', {rhe(x, 0)})"


def d_week(x: str) -> str:
    return none(x, f"('W' || lpad(CAST(weekofyear({x}) AS VARCHAR), 2, '0') || ' ' || CAST(isoyear({x}) AS VARCHAR))")


def share(part: str, whole: str) -> str:
    return f"(CASE WHEN ({whole}) <> 0 THEN CAST(100 AS DOUBLE) * ({part}) / ({whole}) ELSE CAST(0 AS DOUBLE) END)"


# ---------------------------------------------------------------------------
# findings
# ---------------------------------------------------------------------------

def _k(keys: list[str]) -> tuple[str, str, str]:
    """(select prefix, group-by prefix, partition clause) for slice keys."""
    sel = "".join(f"{k}, " for k in keys)
    part = ("PARTITION BY " + ", ".join(keys)) if keys else ""
    return sel, sel, part


def _using(keys: list[str], how: str = "JOIN") -> str:
    return f"{how} %s USING ({', '.join(keys)})" if keys else ("CROSS JOIN %s" if how == "JOIN" else "LEFT JOIN %s ON true")


def findings_ctes(keys: list[str]) -> list[str]:
    sel, grp, part = _k(keys)
    regions = []
    for i, (name, cs) in enumerate(K.REGIONS.items()):
        for c in cs:
            regions.append(f"({Q(name)}, {i}, {Q(c)})")
    j = lambda t, how="JOIN": _using(keys, how) % t
    m = K.MIN_LANE_SHIPMENTS
    days = O.arr(K.WEEKDAYS_TESTED)
    all_days = O.arr(K.WEEKDAYS)
    prev = " ".join(f"WHEN {Q(k)} THEN {Q(v)}" for k, v in K.PREVIOUS_DAY.items())
    return [
        f"_fk AS (SELECT {sel}{KPI_SQL} FROM shipments GROUP BY ALL)" if keys else f"_fk AS (SELECT {KPI_SQL} FROM shipments)",
        f"""_fper AS (SELECT {sel}{d_week('min(ship_date)')} || ' to ' || {d_week('max(ship_date)')} AS period
  FROM shipments {'GROUP BY ' + ', '.join(keys) if keys else ''})""",
        f"""_fbc AS (
  SELECT *, CAST(row_number() OVER ({part} ORDER BY carrier_rank, carrier) - 1 AS INTEGER) AS row_pos FROM (
    SELECT {sel}carrier, {cnt()} AS orders, {msum("CASE WHEN is_billable THEN freight_cost_eur END")} AS spend,
      {pct("count_if(is_on_time AND NOT is_cancelled)", "count_if(NOT is_cancelled)")} AS on_time_pct,
      {msum("CASE WHEN NOT is_cancelled THEN late_penalty_eur END")} AS penalties,
      {cnt("is_late AND NOT is_cancelled")} AS late_orders, {carrier_rank_sql()} AS carrier_rank
    FROM shipments WHERE carrier IS NOT NULL GROUP BY {grp}carrier))""",
        f"""_fweak AS (SELECT * EXCLUDE (_rn) FROM (
  SELECT *, row_number() OVER ({part} ORDER BY on_time_pct, carrier_rank, carrier) AS _rn FROM _fbc
  WHERE on_time_pct IS NOT NULL) WHERE _rn = 1)""",
        f"""_flanes AS (
  SELECT {sel}carrier, destination_country, {cnt()} AS orders, {pct("count_if(is_late)", "count(*)")} AS late_pct,
    {msum("late_penalty_eur")} AS penalties
  FROM shipments WHERE NOT is_cancelled AND carrier IS NOT NULL AND destination_country IS NOT NULL
  GROUP BY {grp}carrier, destination_country HAVING count(*) >= {m})""",
        f"""_fwl AS (SELECT {sel}carrier, destination_country AS wl_dest, late_pct AS wl_late, orders AS wl_orders FROM (
  SELECT *, row_number() OVER (PARTITION BY {sel}carrier ORDER BY penalties DESC, destination_country) AS _rn
  FROM _flanes) WHERE _rn = 1)""",
        f"""_f1 AS (
  SELECT {sel}'weakest_carrier' AS key, 1 AS _order, w.penalties AS leak_eur,
    w.carrier || ' runs ' || {d_f0('k.on_time_pct - w.on_time_pct')} || ' points below the book at '
      || {d_pct('w.on_time_pct')} || ' on time, with ' || {d_money('w.penalties')} || ' in late penalties across '
      || {d_group('w.orders')} || ' shipments.' AS claim,
    'The book runs at ' || {d_pct('k.on_time_pct')} || ' on time across ' || {d_group('k.orders')} || ' shipments; '
      || w.carrier || ' carries ' || {d_pct('CAST(100 AS DOUBLE) * w.orders / k.orders')} || ' of them and '
      || {d_pct(share('w.penalties', 'k.penalties'))} || ' of all penalties.' AS support_1,
    CASE WHEN wl_dest IS NOT NULL THEN 'Its worst lane is ' || wl_dest || ' at ' || {d_pct('wl_late')}
      || ' late across ' || {d_group('wl_orders')} || ' shipments.' ELSE {Q(FD.NO_LANE)} END AS support_2,
    {d_group('w.late_orders')} || ' of its shipments arrived late. Penalties are '
      || {d_money(repr(K.LATE_PENALTY_EUR_PER_DAY))} || ' per day late; cancelled shipments are excluded.' AS support_3,
    'Cap ' || w.carrier || '''s share of time-critical freight and put the contract on the next review agenda, with the '
      || {d_money('w.penalties')} || ' in penalties as the opening figure.' AS action,
    w.penalties AS figure_eur, 'Late penalties on ' || w.carrier AS figure_label,
    p.period || ', ' || {d_group('w.orders')} || ' shipments' AS figure_basis,
    {Q(FD.METHOD_WEAK)} AS method,
    {d_group('k.cancelled_orders')} || ' cancelled and ' || {d_group('k.outlier_orders')}
      || ' cost-outlier shipments excluded from spend.' AS exclusions,
    w.row_pos AS cite_row, 'on_time_pct, penalties' AS cite_columns
  FROM _fweak w {j('_fk k')} {j('_fper p')} LEFT JOIN _fwl USING ({sel}carrier)
  WHERE w.on_time_pct < k.on_time_pct - {K.WEAK_CARRIER_GAP_PTS})""",
        f"_freg AS (SELECT * FROM (VALUES {', '.join(regions)}) t(region, region_order, destination_country))",
        f"""_fcells AS (
  SELECT {sel}carrier, region, region_order, ship_weekday, count(*) AS n, sum(transit_days) AS t_sum,
    count(transit_days) AS t_n, count_if(is_late) AS late_n, {msum("late_penalty_eur")} AS penalties
  FROM shipments JOIN _freg USING (destination_country) WHERE NOT is_cancelled AND carrier IS NOT NULL
  GROUP BY {grp}carrier, region, region_order, ship_weekday)""",
        f"""_fsc AS (SELECT *, sum(n) OVER w AS s_n, sum(t_sum) OVER w AS s_t_sum, sum(t_n) OVER w AS s_t_n,
  sum(late_n) OVER w AS s_late_n FROM _fcells WINDOW w AS (PARTITION BY {sel}carrier, region))""",
        f"""_feff AS (SELECT * EXCLUDE (_rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY {sel}carrier, region ORDER BY transit_uplift_pct DESC, _day) AS _rn FROM (
    SELECT {sel}carrier, region, region_order, ship_weekday AS weekday, n AS shipments, s_n - n AS baseline_shipments,
      CAST(100 AS DOUBLE) * ((CAST(t_sum AS DOUBLE) / NULLIF(t_n, 0)) / _base - 1.0) AS transit_uplift_pct,
      CAST(100 AS DOUBLE) * CAST(late_n AS DOUBLE) / n AS late_pct,
      CAST(100 AS DOUBLE) * CAST(s_late_n - late_n AS DOUBLE) / (s_n - n) AS baseline_late_pct,
      penalties AS penalties_eur, _day
    FROM (SELECT *, CAST(s_t_sum - t_sum AS DOUBLE) / NULLIF(s_t_n - t_n, 0) AS _base,
            list_position({days}, ship_weekday) AS _day FROM _fsc)
    WHERE _day > 0 AND s_n >= {2 * m} AND n >= {m} AND s_n - n >= {m} AND (_base IS NULL OR _base <> 0))
  WHERE transit_uplift_pct IS NOT NULL) WHERE _rn = 1)""",
        f"""_fsig AS (SELECT * EXCLUDE (_rn) FROM (
  SELECT *, row_number() OVER ({part} ORDER BY penalties_eur DESC, carrier, region_order) AS _rn FROM _feff
  WHERE transit_uplift_pct >= {K.MIN_UPLIFT_PCT} AND late_pct - baseline_late_pct >= {K.MIN_LATE_GAP_PCT})
  WHERE _rn = 1)""",
        f"""_fwev AS (
  SELECT {sel}s.carrier, r.region, s.ship_weekday AS weekday, {cnt()} AS shipments,
    {pct("count_if(s.is_late)", "count(*)")} AS late_pct, avg(s.transit_days) AS transit_days,
    {msum("s.late_penalty_eur")} AS penalties,
    CAST(list_position({all_days}, s.ship_weekday) AS INTEGER) AS weekday_order
  FROM shipments s JOIN _freg r USING (destination_country)
  JOIN (SELECT DISTINCT {sel}carrier, region FROM _fsig) g USING ({sel}carrier, region)
  WHERE NOT s.is_cancelled GROUP BY {grp}s.carrier, r.region, s.ship_weekday)""",
        f"""_f2 AS (
  SELECT {sel}'weekday' AS key, 2 AS _order, s.penalties_eur AS leak_eur,
    s.carrier || ' ' || s.weekday || ' dispatches to ' || s.region || ' arrive late ' || {d_pct('s.late_pct')}
      || ' of the time, against ' || {d_pct('s.baseline_late_pct')} || ' on other weekdays.' AS claim,
    'Transit runs ' || {d_pct('s.transit_uplift_pct')} || ' longer on ' || s.weekday || ' across '
      || {d_group('s.shipments')} || ' shipments; the other weekdays hold ' || {d_group('s.baseline_shipments')}
      || '.' AS support_1,
    'Penalties on those ' || s.weekday || ' dispatches come to ' || {d_money('s.penalties_eur')} || ' in the period.'
      AS support_2,
    'A weekday under {m} shipments is not tested, so the comparison covers '
      || {d_group('s.shipments + s.baseline_shipments')} || ' shipments.' AS support_3,
    'Shift ' || s.weekday || ' volume to ' || (CASE s.weekday {prev} ELSE 'the previous day' END)
      || ' and get a written cut-off time from ' || s.carrier || ' for ' || s.region || '.' AS action,
    s.penalties_eur AS figure_eur, 'Late penalties on ' || s.weekday || ' dispatches' AS figure_label,
    p.period || ', ' || {d_group('s.shipments')} || ' shipments' AS figure_basis,
    'Scope is ' || s.carrier || ' shipments into ' || s.region
      || ', cancelled shipments excluded. Late is delivery after the promised date.' AS method,
    {Q(FD.EXCL_WEEKDAY)} AS exclusions,
    CAST((SELECT count(*) FROM _fwev e WHERE e.carrier = s.carrier AND e.region = s.region
          {''.join(f'AND e.{k} = s.{k} ' for k in keys)}
          AND e.weekday_order < list_position({all_days}, s.weekday)) AS INTEGER) AS cite_row,
    'late_pct, penalties' AS cite_columns
  FROM _fsig s {j('_fper p')})""",
        f"""_fbook AS (SELECT {sel}{pct("count_if(is_late)", "count(*)")} AS book_late_pct FROM shipments
  WHERE NOT is_cancelled {'GROUP BY ' + ', '.join(keys) if keys else ''})""",
        f"""_ftop AS (SELECT * EXCLUDE (_rn) FROM (
  SELECT *, row_number() OVER ({part} ORDER BY penalties DESC, carrier, destination_country) AS _rn FROM _flanes)
  WHERE _rn = 1)""",
        f"""_f3 AS (
  SELECT {sel}'worst_lane' AS key, 3 AS _order, t.penalties AS leak_eur,
    t.carrier || ' into ' || t.destination_country || ' is the lane losing most to late delivery: '
      || {d_pct('t.late_pct')} || ' late across ' || {d_group('t.orders')} || ' shipments.' AS claim,
    'Penalties on the lane are ' || {d_money('t.penalties')} || ', ' || {d_pct(share('t.penalties', 'k.penalties'))}
      || ' of all penalties in the period.' AS support_1,
    'The network late rate is ' || {d_pct('b.book_late_pct')} || ', so the lane runs '
      || {d_pct('t.late_pct - b.book_late_pct')} || ' points above it.' AS support_2,
    'Lanes under {m} shipments are excluded from the ranking.' AS support_3,
    CASE WHEN coalesce(contains(f1.claim, t.carrier), false) THEN {Q(FD.SAME_LANE_ACTION)}
      ELSE 'Re-tender the ' || t.destination_country || ' lane, or price the penalty into what you pay '
           || t.carrier || '.' END AS action,
    t.penalties AS figure_eur, 'Late penalties on the lane' AS figure_label,
    p.period || ', ' || {d_group('t.orders')} || ' shipments' AS figure_basis,
    {Q(FD.METHOD_LANE)} AS method, 'Lanes under {m} shipments are not ranked.' AS exclusions,
    0 AS cite_row, 'late_pct, penalties' AS cite_columns
  FROM _ftop t {j('_fk k')} {j('_fbook b')} {j('_fper p')} {j('_f1 f1', 'LEFT JOIN')})""",
        f"""_fall AS (
  SELECT f.*, {share('f.leak_eur', 'k.total_spend')} AS share_pct FROM (
    SELECT * FROM _f1 UNION ALL BY NAME SELECT * FROM _f2 UNION ALL BY NAME SELECT * FROM _f3) f {j('_fk k')})""",
        f"""findings AS (
  SELECT * EXCLUDE (_order),
    CASE WHEN share_pct >= {K.SEVERITY_THRESHOLDS['critical']} THEN 'critical'
         WHEN share_pct >= {K.SEVERITY_THRESHOLDS['serious']} THEN 'serious' ELSE 'warning' END AS severity,
    CAST(row_number() OVER ({part} ORDER BY leak_eur DESC, _order) AS INTEGER) AS position
  FROM _fall WHERE share_pct >= {K.SEVERITY_THRESHOLDS['warning']})""",
    ]


FINDING_COLS = ["key", "position", "severity", "share_pct", "leak_eur", "figure_eur", "claim", "support_1",
                "support_2", "support_3", "action", "figure_label", "figure_basis", "method", "exclusions",
                "cite_row", "cite_columns"]


def findings_sql(keys: list[str] | None = None) -> str:
    keys = keys or []
    cols = ", ".join(keys + [c if c != "cite_row" else "CAST(cite_row AS INTEGER) AS cite_row" for c in FINDING_COLS])
    return O.with_ctes(*findings_ctes(keys)) + f"\nSELECT {cols} FROM findings"


def evidence_sql() -> str:
    ctes = findings_ctes([]) + [
        """_flanes5 AS (SELECT *, CAST(row_number() OVER (ORDER BY penalties DESC, carrier, destination_country) AS INTEGER)
  AS lane_rank FROM _flanes)""",
    ]
    body = """SELECT * FROM (
  SELECT 'weakest_carrier' AS key, row_pos AS row_no, carrier, CAST(NULL AS VARCHAR) AS destination_country,
    CAST(NULL AS VARCHAR) AS weekday, orders AS shipments, spend, on_time_pct, CAST(NULL AS DOUBLE) AS late_pct,
    CAST(NULL AS DOUBLE) AS transit_days, penalties FROM _fbc
  UNION ALL
  SELECT 'weekday', CAST(row_number() OVER (PARTITION BY carrier, region ORDER BY weekday_order) - 1 AS INTEGER),
    carrier, NULL, weekday, shipments, NULL, NULL, late_pct, transit_days, penalties FROM _fwev
  UNION ALL
  SELECT 'worst_lane', lane_rank - 1, carrier, destination_country, NULL, orders, NULL, NULL, late_pct, NULL, penalties
  FROM _flanes5 WHERE lane_rank <= 5
) e WHERE key IN (SELECT key FROM findings)"""
    return O.with_ctes(*ctes) + "\n" + body


def cites_sql() -> str:
    """Each cite of a finding against the evidence cell that it names."""
    first = "CASE WHEN f.key = 'weakest_carrier' THEN 'on_time_pct' ELSE 'late_pct' END"
    value = "CASE WHEN f.key = 'weakest_carrier' THEN e.on_time_pct ELSE e.late_pct END"
    both = f"""SELECT f.*, {first} AS column_, {value} AS value, {d_pct(f'({value})')} AS shown
  FROM f LEFT JOIN e ON e.key = f.key AND e.row_no = f.cite_row
  UNION ALL
  SELECT f.*, 'penalties', e.penalties, {d_money('e.penalties')} FROM f LEFT JOIN e ON e.key = f.key AND e.row_no = f.cite_row"""
    return f"""WITH f AS ({findings_sql()}), e AS ({evidence_sql()}), c AS ({both})
SELECT key, position, cite_row AS row_no, column_ AS "column", value, shown,
  CASE WHEN contains(claim, shown) THEN 'claim'
       WHEN contains(support_1 || ' ' || support_2 || ' ' || support_3, shown) THEN 'support' END AS quoted_in
FROM c"""


def records_sql() -> str:
    """The nested record with its arrays as text."""
    columns = " ".join(
        f"WHEN {Q(k)} THEN " + Q("; ".join(f"{n}|{label}|{kind}|{fmt or '-'}" for n, label, kind, fmt in cols))
        for k, cols in FD.EVIDENCE_COLUMNS.items())
    return f"""WITH f AS ({findings_sql()})
SELECT key, position, severity, share_pct, leak_eur, claim, support_1 || ' / ' || support_2 || ' / ' || support_3 AS support,
  CAST(3 AS INTEGER) AS n_support, action, figure_eur, figure_label, figure_basis, method, exclusions,
  CASE WHEN key = 'weakest_carrier' THEN cite_row || ':on_time_pct; ' ELSE cite_row || ':late_pct; ' END
    || cite_row || ':penalties' AS cite,
  CASE key {columns} END AS columns
FROM f"""


def formatted_carriers_sql() -> str:
    ctes = findings_ctes([])[:3] + ["_fb AS (SELECT min(ship_date) AS _a, max(ship_date) AS _b FROM shipments)"]

    def prose(a: str, b: str) -> str:
        return (f"CASE WHEN year({a}) = year({b}) AND month({a}) = month({b}) "
                f"THEN CAST(day({a}) AS VARCHAR) || ' to ' || strftime({b}, '%-d %B %Y') "
                f"WHEN year({a}) = year({b}) THEN strftime({a}, '%-d %B') || ' to ' || strftime({b}, '%-d %B %Y') "
                f"ELSE strftime({a}, '%-d %B %Y') || ' to ' || strftime({b}, '%-d %B %Y') END")

    body = f"""SELECT carrier, row_pos, {d_group('orders')} AS shipments, {d_group('spend')} AS spend,
  {d_money('spend', False)} AS spend_compact, {d_money('penalties')} AS penalties,
  {d_group('on_time_pct', 1)} AS on_time, {d_pct('on_time_pct')} AS on_time_pct,
  {none('spend / orders', f"printf('%.2f', {rhu('spend / orders', 2)})")} AS spend_per_shipment,
  strftime(_a, '%Y-%m-%d') || ' to ' || strftime(_b, '%Y-%m-%d') AS period_iso,
  {d_week('_a')} || ' to ' || {d_week('_b')} AS period_weeks,
  {prose('_a', '_b')} AS period_prose, strftime(_b, '%B %Y') AS last_month
FROM _fbc CROSS JOIN _fb"""
    return O.with_ctes(*ctes) + "\n" + body


# ---------------------------------------------------------------------------
# executive summary, brief and its audit
# ---------------------------------------------------------------------------

def _n_words(x: str) -> str:
    whens = " ".join(f"WHEN {n} THEN {Q(w)}" for n, w in FD.N_WORDS.items())
    return f"(CASE {x} {whens} ELSE CAST({x} AS VARCHAR) END)"


def _comma(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


def _days(x: str) -> str:
    return none(x, f"(printf('%.1f', {rhu(x, 1)}) || ' days')")


def summary_sql() -> str:
    ctes = findings_ctes([]) + [
        """_fcomp AS (
  SELECT carrier, penalties, _rn AS position FROM (
    SELECT carrier, CAST(coalesce(sum(late_penalty_eur), 0) AS DOUBLE) AS penalties,
      row_number() OVER (ORDER BY coalesce(sum(late_penalty_eur), 0) DESC, carrier) AS _rn
    FROM shipments WHERE NOT is_cancelled AND carrier IS NOT NULL GROUP BY carrier) WHERE _rn <= 3 AND penalties > 0
  UNION ALL
  SELECT 'Other', sum(penalties), 4 FROM (
    SELECT CAST(coalesce(sum(late_penalty_eur), 0) AS DOUBLE) AS penalties,
      row_number() OVER (ORDER BY coalesce(sum(late_penalty_eur), 0) DESC, carrier) AS _rn
    FROM shipments WHERE NOT is_cancelled AND carrier IS NOT NULL GROUP BY carrier) WHERE _rn > 3
  HAVING sum(penalties) > 0)""",
        f"""_fcs AS (SELECT coalesce(string_agg(carrier || ' ' || {d_money('penalties', False)}, '; ' ORDER BY position), '')
  AS composition FROM _fcomp)""",
        """_fsum AS (SELECT CAST(count(*) AS BIGINT) AS n_findings, CAST(coalesce(sum(leak_eur), 0) AS DOUBLE) AS addressed_eur,
  CAST(count_if(severity = 'critical') AS BIGINT) AS n_critical, CAST(count_if(severity = 'serious') AS BIGINT) AS n_serious,
  CAST(count_if(severity = 'warning') AS BIGINT) AS n_warning, arg_min(claim, position) AS first_claim FROM findings)""",
    ]

    def part(n: str, word: str) -> str:
        return f"CASE WHEN {n} > 0 THEN lower({_n_words(n)}) || ' ' || CASE WHEN {n} = 1 THEN 'is' ELSE 'are' END || ' ' || {word} END"

    parts = (f"list_filter([{part('n_critical', Q('critical'))}, {part('n_serious', Q('serious'))}, "
             f"{part('n_warning', 'CASE WHEN n_warning = 1 THEN ' + Q('a warning') + ' ELSE ' + Q('warnings') + ' END')}], "
             "lambda x: x IS NOT NULL)")
    joined = ("CASE len(_parts) WHEN 1 THEN _parts[1] WHEN 2 THEN _parts[1] || ' and ' || _parts[2] "
              "ELSE _parts[1] || ', ' || _parts[2] || ' and ' || _parts[3] END")
    sev = f"CASE WHEN len(_parts) > 0 THEN upper(substring({joined}, 1, 1)) || substring({joined}, 2) || '.' ELSE '' END"
    body = f"""SELECT penalties AS hero_eur,
  {d_pct(share('penalties', 'total_spend'))} || ' of ' || period || ' freight spend' AS hero_label,
  {d_group('late_orders')} || ' late shipments of ' || {d_group('active_orders')} || '. Penalties at '
    || {d_money(repr(K.LATE_PENALTY_EUR_PER_DAY))} || ' per day late; cancelled shipments excluded.' AS hero_basis,
  composition,
  CASE WHEN n_findings > 0 THEN {_n_words('n_findings')} || ' finding' || CASE WHEN n_findings <> 1 THEN 's' ELSE '' END
    || ' account' || CASE WHEN n_findings = 1 THEN 's' ELSE '' END || ' for <b>' || {d_money('addressed_eur', False)}
    || '</b> of late-delivery penalties in ' || period || ', ' || {d_pct(share('addressed_eur', 'total_spend'))}
    || ' of freight spend. ' || ({sev})
  ELSE 'No leakage above the ' || {d_pct(repr(K.SEVERITY_THRESHOLDS['warning']))} || ' reporting threshold was found in '
    || period || '.' END AS sentence_1,
  CASE WHEN n_findings > 0 THEN first_claim ELSE 'Late-delivery penalties total <b>' || {d_money('penalties', False)}
    || '</b> across ' || {d_group('late_orders')} || ' late shipments.' END AS sentence_2,
  'On-time delivery is <b>' || {d_pct('on_time_pct')} || '</b> across ' || {d_group('active_orders')}
    || ' non-cancelled shipments; ' || {d_group('late_orders')} || ' arrived late by ' || {_days('avg_delay')}
    || ' on average.' AS sentence_3,
  CASE WHEN n_findings > 0 THEN 'Recommended actions address <b>' || {d_money('addressed_eur', False)} || '</b> of the '
    || {d_money('penalties', False)} || ' in penalties.'
  ELSE 'Penalties total ' || {d_money('penalties', False)}
    || '; none concentrates enough in one carrier, lane or weekday to act on.' END AS footer,
  addressed_eur, n_findings, n_critical, n_serious, n_warning
FROM (SELECT *, {parts} AS _parts FROM _fk, _fper, _fsum, _fcs)"""
    return O.with_ctes(*ctes) + "\n" + body


def _brief_ctes() -> list[str]:
    prev = " ".join(f"WHEN {Q(k)} THEN {Q(v)}" for k, v in K.PREVIOUS_DAY.items())
    gap = "k.on_time_pct - w.on_time_pct"
    return findings_ctes([]) + [
        f"""_fbul AS (
  SELECT 1 AS _slot, '**' || weekday || ' is where ' || region || ' is losing you money.** ' || {d_f0('late_pct')}
    || '% of ' || carrier || '''s ' || weekday || ' dispatches land late. Any other weekday it is '
    || {d_f0('baseline_late_pct')} || '%. Transit runs ' || {d_f0('transit_uplift_pct')} || '% longer across '
    || {_comma('shipments')} || ' shipments and the penalties come to ' || {d_money('penalties_eur')} || '. Shift '
    || weekday || ' volume to ' || (CASE weekday {prev} ELSE 'the previous day' END)
    || ' and get a written cut-off time out of ' || carrier || '.' AS text FROM _fsig
  UNION ALL
  SELECT 2, '**Your worst single lane is ' || t.carrier || ' into ' || t.destination_country || '.** '
    || {d_f0('t.late_pct')} || '% late across ' || {_comma('t.orders')} || ' shipments, ' || {d_money('t.penalties')}
    || ' in penalties. ' || CASE WHEN coalesce(t.carrier = s.carrier, false)
      THEN 'Same carrier as the point above, so make it one commercial conversation rather than two.'
      ELSE 'Re-tender it, or price the penalty into what you pay ' || t.carrier || '.' END
  FROM _ftop t LEFT JOIN _fsig s ON true
  UNION ALL
  SELECT 3, CASE WHEN coalesce(t.carrier = w.carrier, false)
      THEN '**' || w.carrier || ' is not one bad lane.** It runs ' || {d_f0(gap)} || ' points below the book at '
        || {d_f0('w.on_time_pct')} || '% on time.'
      ELSE '**' || w.carrier || ' runs ' || {d_f0(gap)} || ' points below the book, at ' || {d_f0('w.on_time_pct')}
        || '% on time.**' END
    || ' That is ' || {_comma('w.orders')} || ' shipments and ' || {d_money('w.spend', False)}
    || ' of spend riding on the weakest service in the book. Cap its share of time-critical freight and put the '
    || 'contract on the next review agenda.'
  FROM _fweak w CROSS JOIN _fk k LEFT JOIN _ftop t ON true
  WHERE w.on_time_pct < k.on_time_pct - {K.WEAK_CARRIER_GAP_PTS})""",
        f"""brief AS (
  SELECT CAST(row_number() OVER (ORDER BY _slot) AS INTEGER) AS bullet_no, text FROM (
    SELECT * FROM _fbul
    UNION ALL
    SELECT 0, '**Nothing in this view is worth escalating.** ' || printf('%.1f', {rhe('on_time_pct', 1)})
      || '% on time across ' || {_comma('orders')} || ' shipments, with ' || {d_money('penalties')}
      || ' of penalties. Widen the date range or clear the carrier filter to go looking.'
    FROM _fk WHERE (SELECT count(*) FROM _fbul) = 0))""",
    ]


def brief_sql() -> str:
    return O.with_ctes(*_brief_ctes()) + "\nSELECT * FROM brief"


def brief_audit_sql() -> str:
    sig_cols = ["shipments", "baseline_shipments", "transit_uplift_pct", "late_pct", "baseline_late_pct",
                "penalties_eur", "late_pct - baseline_late_pct"]
    kpi_cols = ["total_spend", "orders", "billable_orders", "active_orders", "cancelled_orders", "outlier_orders",
                "excluded_from_spend", "on_time_pct", "avg_delay", "late_orders", "penalties"]
    ev = " UNION ALL ".join(
        [f"SELECT CAST({c} AS DOUBLE) AS v FROM _fk" for c in kpi_cols]
        + [f"SELECT CAST({c} AS DOUBLE) FROM _fsig" for c in sig_cols]
        + [f"SELECT CAST(w.{c} AS DOUBLE) FROM _fweak w" for c in ("on_time_pct", "orders", "spend")]
        + ["SELECT k.on_time_pct - w.on_time_pct FROM _fweak w, _fk k"]
        + [f"SELECT CAST({c} AS DOUBLE) FROM (SELECT * FROM _flanes ORDER BY penalties DESC, carrier, destination_country "
           f"LIMIT 3)" for c in ("orders", "late_pct", "penalties")]
    )
    ctes = _brief_ctes() + [
        f"_fev AS (SELECT v FROM ({ev}) WHERE v IS NOT NULL)",
        f"""_fallow AS (SELECT DISTINCT n FROM (
  SELECT CAST({rhe('v', 0)} AS BIGINT) AS n FROM _fev UNION ALL SELECT CAST(trunc(v) AS BIGINT) FROM _fev
  UNION ALL SELECT CAST({rhe('v / 1000', 0)} AS BIGINT) FROM _fev
  UNION ALL SELECT CAST(trunc({rhe('v', 1)} * 10) AS BIGINT) FROM _fev))""",
        """_ftok AS (SELECT CAST(round_even(CAST(regexp_replace(tok, '[,\\x{202F}]', '', 'g') AS DOUBLE), 0) AS BIGINT) AS n
  FROM (SELECT unnest(regexp_extract_all(text, '(\\d[\\d,\\x{202F}]*(?:\\.\\d+)?)', 1)) AS tok FROM brief))""",
    ]
    body = """SELECT CAST(count(*) AS BIGINT) AS figures,
  CAST((SELECT count(*) FROM _ftok WHERE n NOT IN (SELECT n FROM _fallow)) AS BIGINT) AS untraceable,
  (SELECT count(*) FROM _ftok WHERE n NOT IN (SELECT n FROM _fallow)) = 0 AS traceable
FROM _ftok"""
    return O.with_ctes(*ctes) + "\n" + body
