"""Findings, executive summary and brief (F1-F8).

Everything stays a DataFrame: the three candidate findings (weakest carrier,
weekday signal, worst lane) are built as rows from small aggregates, unioned,
given a share of spend and a severity by rule, filtered at the reporting
threshold and ranked by money. With ``by`` every slice (segment, month,
tenant...) gets its own findings in the same job. Texts are assembled with
column expressions; every figure in them comes from the aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shipledger import constants as K
from shipledger.functions import formats as X
from shipledger.operators import aggregates as A
from shipledger.operators.cube import grouped
from shipledger.session import materialize

ONE_PARTITION_CELLS = 50_000

# ---------------------------------------------------------------------------
# What the evidence of each finding shows (column of the evidence
# frame, heading, kind, format) and which figures its claim rests on
# ---------------------------------------------------------------------------
EVIDENCE_COLUMNS = {
    "weakest_carrier": [("carrier", "Carrier", "text", None), ("shipments", "Shipments", "num", "int"),
                        ("spend", "Spend (EUR)", "num", "int"), ("on_time_pct", "On time (%)", "num", "1dp"),
                        ("penalties", "Penalties (EUR)", "num", "int")],
    "weekday": [("weekday", "Dispatch weekday", "text", None), ("shipments", "Shipments", "num", "int"),
                ("late_pct", "Late (%)", "num", "1dp"), ("transit_days", "Mean transit (days)", "num", "1dp"),
                ("penalties", "Penalties (EUR)", "num", "int")],
    "worst_lane": [("carrier", "Carrier", "text", None), ("destination_country", "Destination", "text", None),
                   ("shipments", "Shipments", "num", "int"), ("late_pct", "Late (%)", "num", "1dp"),
                   ("penalties", "Penalties (EUR)", "num", "int")],
}

# ---------------------------------------------------------------------------
# Finding and briefing wording
# ---------------------------------------------------------------------------
METHOD_WEAK = ("On time is the share of non-cancelled shipments delivered by the promised date. "
               "Spend covers billable shipments only.")
NO_LANE = "No single lane carries enough shipments to rank."
EXCL_WEEKDAY = "Weekdays under the minimum shipment count are shown but not compared."
METHOD_LANE = "Lanes ranked by late penalties, cancelled shipments excluded."
SAME_LANE_ACTION = "Same carrier as the finding above; make it one commercial conversation and put the lane on the agenda."
N_WORDS = {0: "No", 1: "One", 2: "Two", 3: "Three"}


def _keys(by) -> list[str]:
    return A._keys(by)


class E(str):
    """A fragment of SQL text (plain ``str`` parts are literal text)."""


def txt(*parts) -> Column:
    """One SQL ``concat`` of literal texts and SQL fragments: one ``expr``
    call per report column keeps plan construction cheap."""
    return F.expr("concat(" + ", ".join(p if isinstance(p, E) else X.sq(p) for p in parts) + ")")


def f0(x: str) -> E:
    """Python's ``{:.0f}``: round half to even, no decimals."""
    return E(f"format_string('%.0f', bround(CAST(({x}) AS DOUBLE), 0))")


def f1(x: str) -> E:
    return E(f"format_string('%.1f', bround(CAST(({x}) AS DOUBLE), 1))")


def comma(x: str) -> E:
    """Python's ``{:,}`` for an integer."""
    return E(f"format_number(CAST(({x}) AS BIGINT), 0)")


def pct(x: str) -> E:
    return E(X.pct_sql(x))


def count(x: str) -> E:
    return E(X.group_sql(x, 0))


def money(x: str, exact: bool = True) -> E:
    return E(X.money_sql(x, exact=exact))


def share_sql(part: str, whole: str) -> str:
    return f"(CASE WHEN ({whole}) <> 0 THEN 100.0D * ({part}) / ({whole}) ELSE 0.0D END)"


def share(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, F.lit(100.0) * part / whole).otherwise(F.lit(0.0))


def prev_day(x: str) -> E:
    whens = " ".join(f"WHEN {X.sq(k)} THEN {X.sq(v)}" for k, v in K.PREVIOUS_DAY.items())
    return E(f"CASE {x} {whens} ELSE 'the previous day' END")


def _join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    return A.join_on(a, b, keys, how=how)


# ---------------------------------------------------------------------------
# Evidence (the facts every finding is built from)
# ---------------------------------------------------------------------------

class Facts:
    """Every fact the findings, summary and brief use, derived from ONE scan.

    The cube holds, per slice x carrier x destination x weekday, the counts
    and sums of all populations; it is a partial aggregate (hot keys are
    combined map-side) whose size is bounded by the number of slices times
    carriers x countries x 7, not by the rows. KPIs, the carrier table, lanes,
    the weekday scope arithmetic, evidence tables and the composition are all
    exact sums over it, so a set of findings costs one pass over the
    shipments instead of one per aggregate. Derived frames are memoised so a
    query that uses one twice reuses its shuffle.

    With ``stage=True`` (the default) the cube is written once to the
    session's stage folder and every fact reads that small table. Left lazy,
    each consumer would re-aggregate the shipments: exchange reuse does not
    survive the different column pruning of ~30 consumers, and a findings
    plan then scanned the whole table 29 times. Use ``stage=False`` for a
    single fact, where one lazy pass is cheaper than a write."""

    def __init__(self, df: DataFrame, by=None, regions: dict | None = None, stage: bool = True):
        self.df, self.keys, self.regions, self.stage = df, _keys(by), regions, stage
        self._memo: dict = {}

    def _get(self, name, make):
        if name not in self._memo:
            self._memo[name] = make()
        return self._memo[name]

    @property
    def cube(self) -> DataFrame:
        def make():
            return grouped(self.df, [*self.keys, "carrier", "destination_country", "ship_weekday"])

        def staged():
            if not self.stage:
                return make()
            cube = materialize(make(), "facts-cube")
            # the count is read from the files' footers; a cube this small is
            # one partition, and the facts on it need no further shuffle
            return cube.coalesce(1) if cube.count() <= ONE_PARTITION_CELLS else cube
        return self._get("cube", staged)

    def kpis(self) -> DataFrame:
        return self._get("kpis", lambda: A.kpis(self.cube, self.keys))

    def period(self) -> DataFrame:
        def make():
            b = self.cube.groupBy(*self.keys).agg(F.min("first_date").alias("first_date"),
                                                  F.max("last_date").alias("last_date"))
            return b.withColumn("period", X.fmt_week_range("first_date", "last_date"))
        return self._get("period", make)

    def carriers(self) -> DataFrame:
        def make():
            keys = self.keys
            bc = (
                self.cube.filter(F.col("carrier").isNotNull())
                .groupBy(*keys, "carrier")
                .agg(
                    F.sum("n_all").alias("orders"),
                    A.money_sum(F.col("spend")).cast("double").alias("spend"),
                    A.ratio_pct(F.sum("n_on_time"), F.sum("n_active")).alias("on_time_pct"),
                    A.money_sum(F.col("penalties")).cast("double").alias("penalties"),
                    F.sum("n_late").alias("late_orders"),
                )
                .withColumn("carrier_rank", A.carrier_rank())
            )
            w = Window.partitionBy(*keys).orderBy("carrier_rank", "carrier")
            return bc.withColumn("row_pos", (F.row_number().over(w) - 1).cast("int"))
        return self._get("carriers", make)

    def weakest(self) -> DataFrame:
        """Lowest on-time rate (first in the fixed carrier order on ties)."""
        def make():
            w = Window.partitionBy(*self.keys).orderBy(F.col("on_time_pct"), "carrier_rank", "carrier")
            return self.carriers().filter(F.col("on_time_pct").isNotNull()).withColumn(
                "_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
        return self._get("weakest", make)

    def lanes(self) -> DataFrame:
        """A10 lanes: active shipments per carrier x destination, >= 8."""
        def make():
            return (
                self.cube.filter(F.col("carrier").isNotNull() & F.col("destination_country").isNotNull())
                .groupBy(*self.keys, "carrier", "destination_country")
                .agg(
                    F.sum("n_active").alias("orders"),
                    A.ratio_pct(F.sum("n_late"), F.sum("n_active")).alias("late_pct"),
                    A.money_sum(F.col("penalties")).cast("double").alias("penalties"),
                )
                .filter(F.col("orders") >= K.MIN_LANE_SHIPMENTS)
            )
        return self._get("lanes", make)

    def top_lanes(self, limit: int) -> DataFrame:
        """A10 + A17: the ``limit`` costliest lanes and the book late rate."""
        def make():
            keys = self.keys
            book = self.cube.groupBy(*keys).agg(A.ratio_pct(F.sum("n_late"), F.sum("n_active")).alias("book_late_pct"))
            w = Window.partitionBy(*keys).orderBy(F.col("penalties").desc(), F.col("carrier"),
                                                  F.col("destination_country"))
            ranked = self.lanes().withColumn("lane_rank", F.row_number().over(w)).filter(F.col("lane_rank") <= limit)
            return _join(ranked, book, keys).withColumn("late_pct_above_book",
                                                         F.col("late_pct") - F.col("book_late_pct"))
        return self._get(("top_lanes", limit), make)

    def cells(self) -> DataFrame:
        """Weekday cells per carrier and region (A9 input), from the cube."""
        def make():
            reg = F.broadcast(A.regions_frame(self.df.sparkSession, self.regions))  # listed countries only
            active = self.cube.filter(F.col("carrier").isNotNull() & (F.col("n_active") > 0))
            return active.join(reg, "destination_country").groupBy(
                *self.keys, "carrier", "region", "region_order", "destinations", "ship_weekday").agg(
                F.sum("n_active").alias("n"),
                F.sum("t_sum").alias("t_sum"),
                F.sum("t_n").alias("t_n"),
                F.sum("n_late").alias("late_n"),
                A.money_sum(F.col("penalties")).cast("double").alias("penalties"),
            )
        return self._get("cells", make)

    def signal(self) -> DataFrame:
        return self._get("signal", lambda: A.signal_from_effects(
            A.effects_from_cells(self.cells(), by=self.keys), by=self.keys))

    def weekday_table(self) -> DataFrame:
        """A16 for the signal's scope: per weekday, Mon-Sun."""
        def make():
            keys = self.keys
            scope = self.signal().select(*keys, "carrier", "region")
            order = F.array_position(F.array(*[F.lit(d) for d in K.WEEKDAYS]), F.col("weekday"))
            return A.join_on(self.cells(), scope, keys, ["carrier", "region"]).select(
                *keys, "carrier", "region", F.col("ship_weekday").alias("weekday"), F.col("n").alias("shipments"),
                A.ratio_pct(F.col("late_n"), F.col("n")).alias("late_pct"),
                (F.col("t_sum").cast("double") / F.when(F.col("t_n") != 0, F.col("t_n"))).alias("transit_days"),
                "penalties",
            ).withColumn("weekday_order", order.cast("int"))
        return self._get("weekday_table", make)

    def composition(self, top: int = 3) -> DataFrame:
        """A13 from the cube: top carriers by penalties (> 0) and Other."""
        def make():
            keys = self.keys
            pen = self.cube.filter(F.col("carrier").isNotNull()).groupBy(*keys, "carrier").agg(
                A.money_sum(F.col("penalties")).alias("penalties"), F.sum("n_active").alias("_act")
            ).filter(F.col("_act") > 0)
            w = Window.partitionBy(*keys).orderBy(F.col("penalties").desc(), F.col("carrier"))
            ranked = pen.withColumn("_rn", F.row_number().over(w))
            named = ranked.filter((F.col("_rn") <= top) & (F.col("penalties") > 0)).select(
                *keys, "carrier", F.col("penalties").cast("double").alias("penalties"), F.col("_rn").alias("position"))
            other = (ranked.filter(F.col("_rn") > top).groupBy(*keys).agg(F.sum("penalties").alias("penalties"))
                     .filter(F.col("penalties") > 0)
                     .select(*keys, F.lit("Other").alias("carrier"), F.col("penalties").cast("double").alias("penalties"),
                             F.lit(top + 1).alias("position")))
            return named.unionByName(other)
        return self._get(("composition", top), make)


def carrier_table(df: DataFrame, by=None) -> DataFrame:
    """F1/F8 evidence: A2 + penalties + late count + row position."""
    return Facts(df, by, stage=False).carriers()


def weakest_carrier(df: DataFrame, by=None) -> DataFrame:
    return Facts(df, by, stage=False).weakest()


# ---------------------------------------------------------------------------
# F1-F5 findings
# ---------------------------------------------------------------------------

def findings(df: DataFrame, by=None, facts: Facts | None = None) -> DataFrame:
    """The findings a reader can open and check, ranked by money at stake."""
    fx = facts or Facts(df, by)
    keys = fx.keys
    k = fx.kpis()
    per = fx.period()
    weak = fx.weakest()
    lanes_all = fx.lanes()
    lane_w = Window.partitionBy(*keys, "carrier").orderBy(F.col("penalties").desc(), "destination_country")
    weak_lane = (
        lanes_all.withColumn("_rn", F.row_number().over(lane_w)).filter(F.col("_rn") == 1)
        .select(*keys, "carrier", F.col("destination_country").alias("wl_dest"),
                F.col("late_pct").alias("wl_late"), F.col("orders").alias("wl_orders"))
    )
    ctx = _join(k, per, keys)

    # F1 weakest carrier
    w = A.join_on(
        _join(weak, ctx.select(*keys, F.col("on_time_pct").alias("book_on_time"), F.col("orders").alias("book_orders"),
                               F.col("penalties").alias("book_penalties"), "cancelled_orders", "outlier_orders",
                               "period"), keys),
        weak_lane, keys, ["carrier"], "left",
    ).filter(F.col("on_time_pct") < F.col("book_on_time") - K.WEAK_CARRIER_GAP_PTS)
    gap = "book_on_time - on_time_pct"
    c = E("carrier")
    f_weak = w.select(
        *keys,
        F.lit("weakest_carrier").alias("key"), F.lit(1).alias("_order"),
        F.col("penalties").alias("leak_eur"),
        txt(c, " runs ", f0(gap), " points below the book at ", pct("on_time_pct"), " on time, with ",
            money("penalties"), " in late penalties across ", count("orders"), " shipments.").alias("claim"),
        txt("The book runs at ", pct("book_on_time"), " on time across ", count("book_orders"), " shipments; ", c,
            " carries ", pct("100.0D * orders / book_orders"), " of them and ",
            pct(share_sql("penalties", "book_penalties")), " of all penalties.").alias("support_1"),
        F.when(F.col("wl_dest").isNotNull(),
               txt("Its worst lane is ", E("wl_dest"), " at ", pct("wl_late"), " late across ", count("wl_orders"),
                   " shipments.")).otherwise(F.lit(NO_LANE)).alias("support_2"),
        txt(count("late_orders"), " of its shipments arrived late. Penalties are ",
            money(repr(K.LATE_PENALTY_EUR_PER_DAY) + "D"), " per day late; cancelled shipments are excluded.").alias(
            "support_3"),
        txt("Cap ", c, "'s share of time-critical freight and put the contract on the next review agenda, with the ",
            money("penalties"), " in penalties as the opening figure.").alias("action"),
        F.col("penalties").alias("figure_eur"),
        txt("Late penalties on ", c).alias("figure_label"),
        txt(E("period"), ", ", count("orders"), " shipments").alias("figure_basis"),
        F.lit(METHOD_WEAK).alias("method"),
        txt(count("cancelled_orders"), " cancelled and ", count("outlier_orders"),
            " cost-outlier shipments excluded from spend.").alias("exclusions"),
        F.col("row_pos").alias("cite_row"),
        F.lit("on_time_pct, penalties").alias("cite_columns"),
        F.col("carrier").alias("subject"),
    )

    # F2 weekday signal
    sig = fx.signal()
    ev = fx.weekday_table()
    day_pos = (
        A.join_on(ev, sig.select(*keys, "carrier", "region", F.col("weekday").alias("_sday")), keys, ["carrier", "region"])
        .groupBy(*keys, "carrier", "region", "_sday")
        .agg(F.count_if(F.col("weekday_order") < F.array_position(
            F.array(*[F.lit(d) for d in K.WEEKDAYS]), F.col("_sday"))).cast("int").alias("cite_row"))
        .drop("_sday")
    )
    s = A.join_on(_join(sig, ctx.select(*keys, "period"), keys), day_pos, keys, ["carrier", "region"], "left")
    day, c = E("weekday"), E("carrier")
    f_sig = s.select(
        *keys,
        F.lit("weekday").alias("key"), F.lit(2).alias("_order"),
        F.col("penalties_eur").alias("leak_eur"),
        txt(c, " ", day, " dispatches to ", E("region"), " arrive late ", pct("late_pct"), " of the time, against ",
            pct("baseline_late_pct"), " on other weekdays.").alias("claim"),
        txt("Transit runs ", pct("transit_uplift_pct"), " longer on ", day, " across ", count("shipments"),
            " shipments; the other weekdays hold ", count("baseline_shipments"), ".").alias("support_1"),
        txt("Penalties on those ", day, " dispatches come to ", money("penalties_eur"), " in the period.").alias(
            "support_2"),
        txt(f"A weekday under {K.MIN_LANE_SHIPMENTS} shipments is not tested, so the comparison covers ",
            count("shipments + baseline_shipments"), " shipments.").alias("support_3"),
        txt("Shift ", day, " volume to ", prev_day("weekday"), " and get a written cut-off time from ", c, " for ",
            E("region"), ".").alias("action"),
        F.col("penalties_eur").alias("figure_eur"),
        txt("Late penalties on ", day, " dispatches").alias("figure_label"),
        txt(E("period"), ", ", count("shipments"), " shipments").alias("figure_basis"),
        txt("Scope is ", c, " shipments into ", E("region"),
            ", cancelled shipments excluded. Late is delivery after the promised date.").alias("method"),
        F.lit(EXCL_WEEKDAY).alias("exclusions"),
        F.coalesce(F.col("cite_row"), F.lit(0)).alias("cite_row"),
        F.lit("late_pct, penalties").alias("cite_columns"),
        F.col("carrier").alias("subject"),
    )

    # F3 worst lane
    top = fx.top_lanes(1)
    weak_claim = f_weak.select(*keys, F.col("claim").alias("_weak_claim"))
    t = (
        _join(top, ctx.select(*keys, F.col("penalties").alias("book_penalties"), "period"), keys)
        .transform(lambda d: _join(d, weak_claim, keys, "left"))
    )
    same = F.coalesce(F.col("_weak_claim").contains(F.col("carrier")), F.lit(False))
    c, dest = E("carrier"), E("destination_country")
    f_lane = t.select(
        *keys,
        F.lit("worst_lane").alias("key"), F.lit(3).alias("_order"),
        F.col("penalties").alias("leak_eur"),
        txt(c, " into ", dest, " is the lane losing most to late delivery: ", pct("late_pct"), " late across ",
            count("orders"), " shipments.").alias("claim"),
        txt("Penalties on the lane are ", money("penalties"), ", ", pct(share_sql("penalties", "book_penalties")),
            " of all penalties in the period.").alias("support_1"),
        txt("The network late rate is ", pct("book_late_pct"), ", so the lane runs ", pct("late_pct - book_late_pct"),
            " points above it.").alias("support_2"),
        F.lit(f"Lanes under {K.MIN_LANE_SHIPMENTS} shipments are excluded from the ranking.").alias("support_3"),
        F.when(same, F.lit(SAME_LANE_ACTION)).otherwise(
            txt("Re-tender the ", dest, " lane, or price the penalty into what you pay ", c, ".")).alias("action"),
        F.col("penalties").alias("figure_eur"),
        F.lit("Late penalties on the lane").alias("figure_label"),
        txt(E("period"), ", ", count("orders"), " shipments").alias("figure_basis"),
        F.lit(METHOD_LANE).alias("method"),
        F.lit(f"Lanes under {K.MIN_LANE_SHIPMENTS} shipments are not ranked.").alias("exclusions"),
        F.lit(0).alias("cite_row"),
        F.lit("late_pct, penalties").alias("cite_columns"),
        F.col("carrier").alias("subject"),
    )

    allf = f_weak.unionByName(f_sig).unionByName(f_lane)
    spend = k.select(*keys, F.col("total_spend").alias("_spend"))
    allf = _join(allf, spend, keys).withColumn("share_pct", share(F.col("leak_eur"), F.col("_spend")))
    th = K.SEVERITY_THRESHOLDS
    kept = allf.filter(F.col("share_pct") >= th["warning"]).withColumn(
        "severity",
        F.when(F.col("share_pct") >= th["critical"], "critical")
        .when(F.col("share_pct") >= th["serious"], "serious")
        .otherwise("warning"),
    )
    rank = Window.partitionBy(*keys).orderBy(F.col("leak_eur").desc(), F.col("_order"))
    return kept.withColumn("position", F.row_number().over(rank).cast("int")).drop("_spend", "_order").withColumn(
        "kind", F.lit("Finding"))


# ---------------------------------------------------------------------------
# F8 evidence tables, one long table keyed by finding
# ---------------------------------------------------------------------------

def evidence(df: DataFrame, by=None, facts: Facts | None = None) -> DataFrame:
    """F8: the table behind each kept finding, in one long frame."""
    fx = facts or Facts(df, by)
    keys = fx.keys
    kept = findings(df, facts=fx).select(*keys, "key")
    bc = fx.carriers().select(
        *keys, F.lit("weakest_carrier").alias("key"), F.col("row_pos").alias("row_no"), "carrier",
        F.lit(None).cast("string").alias("destination_country"), F.lit(None).cast("string").alias("weekday"),
        F.col("orders").alias("shipments"), "spend", "on_time_pct", F.lit(None).cast("double").alias("late_pct"),
        F.lit(None).cast("double").alias("transit_days"), "penalties",
    )
    wk = fx.weekday_table()
    wk = wk.withColumn("row_no", (F.row_number().over(
        Window.partitionBy(*keys, "carrier", "region").orderBy("weekday_order")) - 1).cast("int")).select(
        *keys, F.lit("weekday").alias("key"), "row_no", "carrier", F.lit(None).cast("string").alias("destination_country"),
        "weekday", "shipments", F.lit(None).cast("double").alias("spend"), F.lit(None).cast("double").alias("on_time_pct"),
        "late_pct", "transit_days", "penalties",
    )
    ln = fx.top_lanes(5).select(
        *keys, F.lit("worst_lane").alias("key"), (F.col("lane_rank") - 1).cast("int").alias("row_no"), "carrier",
        "destination_country", F.lit(None).cast("string").alias("weekday"), F.col("orders").alias("shipments"),
        F.lit(None).cast("double").alias("spend"), F.lit(None).cast("double").alias("on_time_pct"), "late_pct",
        F.lit(None).cast("double").alias("transit_days"), "penalties",
    )
    return A.join_on(bc.unionByName(wk).unionByName(ln), kept, keys, ["key"], "left_semi")


# ---------------------------------------------------------------------------
# F5 the nested record of a finding, and its cites resolved to evidence cells
# ---------------------------------------------------------------------------

def _by_key(make) -> Column:
    """A literal per finding key, as one map."""
    return F.create_map(*[x for k, cols in EVIDENCE_COLUMNS.items() for x in (F.lit(k), make(cols))])[F.col("key")]


def records(df: DataFrame, by=None, facts: Facts | None = None) -> DataFrame:
    """one nested row a finding. ``support`` is an array of sentences,
    ``figure`` and ``cite`` are structs: each cite names a row and a column of
    the finding's evidence (F8), whose ``columns`` say heading, kind and format."""
    f = findings(df, by, facts)
    columns = _by_key(lambda cols: F.array(*[F.struct(
        F.lit(n).alias("name"), F.lit(label).alias("label"), F.lit(kind).alias("kind"), F.lit(fmt).cast("string").alias("format"))
        for n, label, kind, fmt in cols]))
    cite = F.transform(F.split("cite_columns", ", "), lambda c: F.struct(
        F.col("cite_row").alias("row_no"), c.alias("column")))
    keys = facts.keys if facts else _keys(by)
    return f.select(
        *keys, "key", "kind", "position", "severity", "share_pct", "leak_eur", "claim",
        F.array("support_1", "support_2", "support_3").alias("support"), "action",
        F.struct(F.col("figure_eur").alias("eur"), F.col("figure_label").alias("label"),
                 F.col("figure_basis").alias("basis")).alias("figure"),
        "method", "exclusions", "subject", cite.alias("cite"), columns.alias("columns"))


def finding_cites(df: DataFrame, by=None, facts: Facts | None = None) -> DataFrame:
    """F5 + F8: one row a cite: the evidence cell that it names, its value, the
    value as a report shows it, and where the finding quotes that text (claim,
    support, or null if nowhere). A cite without a cell keeps a null value."""
    fx = facts or Facts(df, by)
    keys = fx.keys
    # all numeric cells of the evidence in long form
    named = {n for cols in EVIDENCE_COLUMNS.values() for n, _, kind, _ in cols if kind == "num"}
    ev = evidence(df, facts=fx)
    cells = ev.select(*keys, "key", "row_no", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in ev.columns if c in named])))
    cites = records(df, facts=fx).select(*keys, "key", "position", "claim", "support", F.inline("cite"))
    found = A.join_on(cites, cells, keys, ["key", "row_no", "column"], "left")
    shown = F.when(F.col("column").endswith("_pct"), X.fmt_pct("value")).otherwise(X.fmt_money("value", exact=True))
    quoted = F.when(F.col("claim").contains(F.col("shown")), "claim").when(
        F.array_join("support", " ").contains(F.col("shown")), "support")
    return found.withColumn("shown", shown).select(
        *keys, "key", "position", "row_no", "column", "value", "shown", quoted.alias("quoted_in"))


# ---------------------------------------------------------------------------
# F6 executive summary
# ---------------------------------------------------------------------------

def n_words(x: str) -> E:
    whens = " ".join(f"WHEN {n} THEN {X.sq(w)}" for n, w in N_WORDS.items())
    return E(f"CASE {x} {whens} ELSE CAST({x} AS STRING) END")


def executive_summary(df: DataFrame, by=None, facts: Facts | None = None) -> DataFrame:
    """hero figure, composition, three sentences, footer, one row per slice."""
    fx = facts or Facts(df, by)
    keys = fx.keys
    k = fx.kpis()
    per = fx.period()
    f = findings(df, facts=fx)
    fsum = f.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_findings"),
        F.sum("leak_eur").alias("addressed_eur"),
        F.count_if(F.col("severity") == "critical").alias("n_critical"),
        F.count_if(F.col("severity") == "serious").alias("n_serious"),
        F.count_if(F.col("severity") == "warning").alias("n_warning"),
        F.min_by("claim", "position").alias("first_claim"),
    )
    comp = fx.composition().withColumn(
        "_item", txt(E("carrier"), " ", money("penalties", exact=False))
    ).groupBy(*keys).agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(position, _item))), x -> x._item), '; ')")
        .alias("composition")
    )
    r = _join(_join(k, per, keys), fsum, keys, "left")
    r = _join(r, comp, keys, "left").fillna({"n_findings": 0, "addressed_eur": 0.0, "n_critical": 0, "n_serious": 0,
                                              "n_warning": 0})

    def part(n: str, word: str) -> str:
        return (f"CASE WHEN {n} > 0 THEN concat(lower({n_words(n)}), ' ', CASE WHEN {n} = 1 THEN 'is' ELSE 'are' END, "
                f"' ', {word}) END")

    parts = (f"filter(array({part('n_critical', X.sq('critical'))}, {part('n_serious', X.sq('serious'))}, "
             f"{part('n_warning', 'CASE WHEN n_warning = 1 THEN ' + X.sq('a warning') + ' ELSE ' + X.sq('warnings') + ' END')}"
             "), x -> x IS NOT NULL)")
    r = r.withColumn("_parts", F.expr(parts))
    joined = ("CASE size(_parts) WHEN 1 THEN _parts[0] WHEN 2 THEN concat(_parts[0], ' and ', _parts[1]) "
              "ELSE concat(_parts[0], ', ', _parts[1], ' and ', _parts[2]) END")
    sev = E(f"CASE WHEN size(_parts) > 0 THEN concat(upper(substring({joined}, 1, 1)), substring({joined}, 2), '.') "
            "ELSE '' END")
    has = F.col("n_findings") > 0
    plural = E("CASE WHEN n_findings <> 1 THEN 's' ELSE '' END")
    singular = E("CASE WHEN n_findings = 1 THEN 's' ELSE '' END")
    s1 = F.when(has, txt(
        n_words("n_findings"), " finding", plural, " account", singular, " for <b>", money("addressed_eur", False),
        "</b> of late-delivery penalties in ", E("period"), ", ", pct(share_sql("addressed_eur", "total_spend")),
        " of freight spend. ", sev,
    )).otherwise(txt("No leakage above the ", pct(repr(K.SEVERITY_THRESHOLDS["warning"]) + "D"),
                     " reporting threshold was found in ", E("period"), "."))
    s2 = F.when(has, F.col("first_claim")).otherwise(txt(
        "Late-delivery penalties total <b>", money("penalties", False), "</b> across ", count("late_orders"),
        " late shipments."))
    s3 = txt("On-time delivery is <b>", pct("on_time_pct"), "</b> across ", count("active_orders"),
             " non-cancelled shipments; ", count("late_orders"), " arrived late by ", E(X.days_sql("avg_delay")),
             " on average.")
    footer = F.when(has, txt("Recommended actions address <b>", money("addressed_eur", False), "</b> of the ",
                             money("penalties", False), " in penalties.")).otherwise(
        txt("Penalties total ", money("penalties", False),
            "; none concentrates enough in one carrier, lane or weekday to act on."))
    return r.select(
        *keys,
        F.col("penalties").alias("hero_eur"),
        txt(pct(share_sql("penalties", "total_spend")), " of ", E("period"), " freight spend").alias("hero_label"),
        txt(count("late_orders"), " late shipments of ", count("active_orders"), ". Penalties at ",
            money(repr(K.LATE_PENALTY_EUR_PER_DAY) + "D"), " per day late; cancelled shipments excluded.").alias(
            "hero_basis"),
        F.coalesce(F.col("composition"), F.lit("")).alias("composition"),
        s1.alias("sentence_1"), s2.alias("sentence_2"), s3.alias("sentence_3"), footer.alias("footer"),
        F.col("addressed_eur").cast("double").alias("addressed_eur"),
        F.col("n_findings").cast("long").alias("n_findings"),
        F.col("n_critical").cast("long").alias("n_critical"),
        F.col("n_serious").cast("long").alias("n_serious"),
        F.col("n_warning").cast("long").alias("n_warning"),
    )


# ---------------------------------------------------------------------------
# F7 brief and its audit
# ---------------------------------------------------------------------------

def brief(df: DataFrame, by=None, facts: Facts | None = None) -> DataFrame:
    """one to three bullets (bullet_no, text) per slice, with the fallback
    line when nothing is worth escalating."""
    fx = facts or Facts(df, by)
    keys = fx.keys
    k = fx.kpis()
    sig = fx.signal()
    top = fx.top_lanes(3).filter(F.col("lane_rank") == 1)
    weak = fx.weakest()
    day, c = E("weekday"), E("carrier")

    b1 = sig.select(
        *keys, F.lit(1).alias("_slot"),
        txt("**", day, " is where ", E("region"), " is losing you money.** ", f0("late_pct"), "% of ", c, "'s ", day,
            " dispatches land late. Any other weekday it is ", f0("baseline_late_pct"), "%. Transit runs ",
            f0("transit_uplift_pct"), "% longer across ", comma("shipments"), " shipments and the penalties come to ",
            money("penalties_eur"), ". Shift ", day, " volume to ", prev_day("weekday"),
            " and get a written cut-off time out of ", c, ".").alias("text"),
    )
    t = _join(top, sig.select(*keys, F.col("carrier").alias("_sig_carrier")), keys, "left")
    b2 = t.select(
        *keys, F.lit(2).alias("_slot"),
        txt("**Your worst single lane is ", c, " into ", E("destination_country"), ".** ", f0("late_pct"),
            "% late across ", comma("orders"), " shipments, ", money("penalties"), " in penalties. ",
            E("CASE WHEN coalesce(carrier = _sig_carrier, false) THEN "
              + X.sq("Same carrier as the point above, so make it one commercial conversation rather than two.")
              + " ELSE concat('Re-tender it, or price the penalty into what you pay ', carrier, '.') END")).alias("text"),
    )
    wk = _join(
        _join(weak, k.select(*keys, F.col("on_time_pct").alias("_book")), keys),
        top.select(*keys, F.col("carrier").alias("_lane_carrier")), keys, "left",
    ).filter(F.col("on_time_pct") < F.col("_book") - K.WEAK_CARRIER_GAP_PTS)
    gap = "_book - on_time_pct"
    shared = "coalesce(_lane_carrier = carrier, false)"
    lead_shared = txt("**", c, " is not one bad lane.** It runs ", f0(gap), " points below the book at ",
                      f0("on_time_pct"), "% on time.")
    lead_other = txt("**", c, " runs ", f0(gap), " points below the book, at ", f0("on_time_pct"), "% on time.**")
    b3 = wk.select(
        *keys, F.lit(3).alias("_slot"),
        F.concat(
            F.when(F.expr(shared), lead_shared).otherwise(lead_other),
            txt(" That is ", comma("orders"), " shipments and ", money("spend", False),
                " of spend riding on the weakest service in the book. Cap its share of time-critical freight and put "
                "the contract on the next review agenda."),
        ).alias("text"),
    )
    bullets = b1.unionByName(b2).unionByName(b3)
    counted = bullets.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    fallback = _join(k, counted, keys, "left").filter(F.coalesce(F.col("_n"), F.lit(0)) == 0).select(
        *keys, F.lit(0).alias("_slot"),
        txt("**Nothing in this view is worth escalating.** ", f1("on_time_pct"), "% on time across ", comma("orders"),
            " shipments, with ", money("penalties"),
            " of penalties. Widen the date range or clear the carrier filter to go looking.").alias("text"),
    )
    out = bullets.unionByName(fallback)
    rank = Window.partitionBy(*keys).orderBy("_slot")  # three bullets at most
    return out.select(*keys, F.row_number().over(rank).cast("int").alias("bullet_no"), "text")


def evidence_numbers(df: DataFrame, by=None, facts: Facts | None = None) -> DataFrame:
    """Every numeric fact the brief may quote (slice keys, ``value``)."""
    fx = facts or Facts(df, by)
    keys = fx.keys
    k = fx.kpis()
    kv = k.select(*keys, F.explode(F.array(*[F.col(c).cast("double") for c in k.columns if c not in keys])).alias("value"))
    sig = fx.signal()
    sv = sig.select(*keys, F.explode(F.array(*[F.col(c).cast("double") for c in (
        "shipments", "baseline_shipments", "transit_uplift_pct", "late_pct", "baseline_late_pct", "penalties_eur",
        "late_gap_pct")])).alias("value"))
    weak = fx.weakest()
    wv = weak.select(*keys, F.explode(F.array(*[F.col(c).cast("double") for c in ("on_time_pct", "orders", "spend")])).alias(
        "value"))
    gap = _join(weak, k.select(*keys, F.col("on_time_pct").alias("_b")), keys).select(
        *keys, (F.col("_b") - F.col("on_time_pct")).alias("value"))
    lanes = fx.top_lanes(3)
    lv = lanes.select(*keys, F.explode(F.array(*[F.col(c).cast("double") for c in ("orders", "late_pct", "penalties")])).alias(
        "value"))
    return kv.unionByName(sv).unionByName(wv).unionByName(gap).unionByName(lv).filter(F.col("value").isNotNull())


def brief_audit(df: DataFrame, by=None, facts: Facts | None = None) -> DataFrame:
    """F7 audit: every figure quoted in the brief must trace to the evidence
    (as itself, truncated, in thousands, or x10 at one decimal). One row a
    slice: figures quoted, figures not traceable, traceable."""
    fx = facts or Facts(df, by)
    keys = fx.keys
    ev = evidence_numbers(df, facts=fx)
    v = F.col("value")
    allowed = ev.select(*keys, F.explode(F.array(
        F.bround(v, 0).cast("long"), v.cast("long"), F.bround(v / 1000, 0).cast("long"),
        (F.bround(v, 1) * 10).cast("long"),
    )).alias("n")).distinct()
    tokens = brief(df, facts=fx).select(
        *keys, F.explode(F.regexp_extract_all("text", F.lit("(\\d[\\d,\u202f]*(?:\\.\\d+)?)"), 1)).alias("tok"))
    nums = tokens.select(*keys, F.bround(F.regexp_replace("tok", "[,\u202f]", "").cast("double"), 0).cast("long").alias("n"))
    checked = A.join_on(nums, allowed.withColumn("_ok", F.lit(True)), keys, ["n"], "left")
    return checked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("figures"), F.count_if(F.col("_ok").isNull()).alias("untraceable")).withColumn(
        "traceable", F.col("untraceable") == 0)
