"""Cleaning: raw string exports -> one typed, audited shipment table.

Structure (see README, "Cleaning plan"):

1. ``annotate`` — every row-level step (trim, case, carrier spelling, date
   parse, numeric coercion, voiding, FX) in one narrow stage, written ONCE, so
   that a row's file position is fixed before anything refers to it.
2. ``disposition`` — rows are *marked* as removed, never dropped, so the log is
   one aggregation and reconciles by construction. Only the ids that occur
   twice are joined back, and no wide row is shuffled for it.
3. ``group_stats`` — every median / quartile the imputation needs, rolled up
   from one count of distinct values over grouping sets (map-side combining; a
   hot group costs one row per distinct value); exact quantiles are then read off cumulative
   counts, bucket by bucket (``exact_quantiles``).
4. ``finish`` — size-checked broadcast joins of those small tables, then the
   derived business columns, typed to ``SHIPMENT_SCHEMA``; extra columns of the
   sources stay.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from shipledger import constants as K
from shipledger.functions.dates import date_parts, month_start, parse_ship_date, week_start, weekday_name
from shipledger.functions.text import carrier_key, lookup, null_tokens, strip_ws, title_case
from shipledger.operators.cube import build_cube
from shipledger.schema import FLAG_COLUMNS, SHIPMENT_COLUMNS, ORDER_PREFIX
from shipledger.session import BROADCAST_MAX_BYTES, broadcasts, drop_stages, materialize, sized_side, text_bytes

MONEY = "decimal(18,2)"
RATE = "decimal(6,3)"
RAW_MONEY = "decimal(24,6)"

# Tasks of the written stages: a few for each core, so that the last ones do not
# leave the others idle. The scan of the exports keeps the session's own size.
SHUFFLE_CONF = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}
STAGE_CONF = {**SHUFFLE_CONF, "spark.sql.files.maxPartitionBytes": "32m"}

# Columns of the written stages whose values hardly repeat: keys, file positions, money.
PLAIN_COLUMNS = ("order_id", "_id", "_ord", "_first", "freight_cost", "freight_cost_eur", "cost_per_kg")

# The later copies of repeated ids as one bit a row: up to this size (a billion rows, about) they are broadcast.
MARKS_MAX_BYTES = 160 << 20
MARKS_BLOCK = 4096  # rows of one block of marks: 64 words of 64 bits

# Stat sets computed by group_stats.
SET_OUTLIER = 0      # (service_level)            cost quartiles
SET_LANE = 1         # (lane, service_level)      transit median
SET_COST = 2         # (carrier, service_level)   cost median
SET_G_TRANSIT = 3    # ()                         transit median
SET_G_COST = 4       # ()                         cost median
SET_G_PROMISED = 5   # ()                         promised median


def _num(c: Column, to: str) -> Column:
    v = c.try_cast(to)
    if to == "double":
        v = F.when(~F.isnan(v), v)
    return v


def annotate(
    raw: DataFrame,
    carriers: dict | None = None,
    fx: dict | None = None,
    tokens: list[str] | None = None,
    date_formats: list[str] | None = None,
) -> DataFrame:
    """Row-level cleaning. ``raw`` holds the 15 required string columns,
    ``source_file`` and one or more ``_ord*`` columns giving file order
    (compared left to right; kept as the struct ``_ord``). Extra columns are
    kept; ``_surplus`` marks lines with more fields than their header."""
    carriers = K.CANONICAL_CARRIERS if carriers is None else carriers
    fx = K.FX_TO_EUR if fx is None else fx
    ord_cols = [c for c in raw.columns if c.startswith(ORDER_PREFIX)]
    if not ord_cols:
        raise ValueError("raw shipments need at least one _ord* column giving file order")
    missing = [c for c in K.REQUIRED_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError("missing required columns: " + ", ".join(missing))

    # Two projections: a row is copied once for each, so steps are composed rather
    # than stacked; what a projection uses twice is evaluated once.
    read = {c: null_tokens(c, tokens) for c in K.REQUIRED_COLUMNS}
    # C1 trim (count padded cells first), C2 upper, C3 title.
    trimmed = {c: strip_ws(read[c]) for c in K.TEXT_COLUMNS}
    padded = sum(
        (F.coalesce((F.octet_length(read[c]) != F.octet_length(trimmed[c])).cast("int"), F.lit(0)) for c in K.TEXT_COLUMNS),
        F.lit(0),
    )
    texts = {**read, **trimmed}
    texts |= {c: F.upper(texts[c]) for c in ("origin_country", "destination_country", "currency")}
    texts |= {c: title_case(texts[c]) for c in ("status", "service_level")}
    df = raw.select(
        *[texts[c].alias(c) if c in texts else F.col(f"`{c}`") for c in raw.columns],
        read["carrier"].alias("carrier_raw"), padded.alias("_padded"),
        # C4/C5 carrier spelling, C6 dates (split once), C8 numerics.
        lookup(carriers, carrier_key(trimmed["carrier"])).alias("_canon"),
        date_parts(texts["ship_date"]).alias("_parts"), _num(texts["transit_days"], "double").alias("_transit"),
    )
    cost = F.col("freight_cost").try_cast(RAW_MONEY)
    # C10/C11 FX at fixed rates.
    rate = F.when(F.col("currency").isNotNull(), lookup(fx, F.col("currency"), RATE))
    eur = F.round(cost * rate, 2).cast(MONEY)
    values = {
        "carrier": F.coalesce("_canon", "carrier"),
        "ship_date": parse_ship_date("ship_date", date_formats, F.col("_parts")),
        "weight_kg": _num(F.col("weight_kg"), "double"),
        "freight_cost": cost,
        # C9 void negative transit
        "transit_days": F.when(F.col("_transit") >= 0, F.col("_transit")),
        "promised_days": _num(F.col("promised_days"), "double"),
    }
    made = {
        "_carrier_unmapped": F.col("_canon").isNull(),
        "_carrier_changed": F.col("_canon").isNotNull() & ~F.col("_canon").eqNullSafe(F.col("carrier")),
        "ship_date_raw": F.col("ship_date"),
        "_transit_voided": F.coalesce(F.col("_transit") < 0, F.lit(False)),
        "_ccy_unknown": rate.isNull(),
        "freight_cost_eur": eur,
        "_converted": F.coalesce(F.col("currency") != "EUR", F.lit(True)) & eur.isNotNull(),
        "lane": F.concat(F.col("origin_country"), F.lit(" → "), F.col("destination_country")),
        "_ord": F.struct(*ord_cols),
    }
    if "_surplus" not in raw.columns:
        made["_surplus"] = F.lit(False)
    if "_file" not in raw.columns:
        made["_file"] = F.lit(0)
    return df.select(
        *[values[c].alias(c) if c in values else F.col(f"`{c}`") for c in raw.columns if c not in ord_cols and c not in made],
        "carrier_raw", "_padded", *[e.alias(c) for c, e in made.items()])


def _dated() -> Column:
    return F.col("ship_date").isNotNull() & ~F.col("_surplus")


def placed(stored: DataFrame) -> DataFrame:
    """Rows of a written stage with their place in it (its file, hashed, and the row in that file)."""
    return stored.select("*", F.xxhash64("_metadata.file_path").alias("_spot_file"), F.col("_metadata.row_index").alias("_spot_row"))


def _copy_marks(rows: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """The dated rows that repeat an earlier id, as bits by place: for each block of
    ``MARKS_BLOCK`` rows of a file with such a row, 64 words of 64 bits."""
    copies = rows.filter(_dated()).select("order_id", "_ord", "_spot_file", "_spot_row").join(
        sized_side(ids, size), F.col("order_id").eqNullSafe(F.col("_id"))).filter(F.col("_ord") != F.col("_first"))
    words = copies.groupBy("_spot_file", F.expr(f"_spot_row div {MARKS_BLOCK}").alias("_block"),
                           F.expr("_spot_row div 64 % 64").alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_spot_row % 64 as int))")).alias("_bits"))
    blocks = words.groupBy("_spot_file", "_block").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_words"))
    return blocks.select("_spot_file", "_block", F.expr(
        "transform(sequence(0L, 63L), i -> coalesce(element_at(_words, i), 0L))").alias("_marks"))


def disposition(rows: DataFrame, stages: list[str] | None = None) -> tuple[DataFrame, int]:
    """C7 + D1 over the written row-level stage: ``_removed`` holds the reason,
    or null; and the number of dated rows that repeat an earlier id. The first
    dated row of each order_id in file order survives; null ids count as one id.

    One partial aggregate (``min`` of the file-order struct; a hot id cannot
    skew it) finds the ids with more than one dated row; it groups by the hash of an
    id first, as ids that begin alike are slow to sort. Only those are joined
    back: broadcast if small, else a shuffle join that AQE may split, hashed on the
    ids as long as they fit (``sized_side``). Of ``placed`` rows only ids, order and place are
    shuffled then, once: the copies are kept as a bit a row (``_copy_marks``), broadcast to
    the rows wherever they are read, so no wide row is shuffled. That the
    survivors are exactly one a distinct dated id is checked on counts that the
    writes bring along (``check_survivors``), without a pass of its own."""
    dated = _dated()
    spark, own = rows.sparkSession, []
    ids = materialize(
        rows.filter(dated).groupBy(F.xxhash64("order_id").alias("_hash"), "order_id").agg(
            F.min("_ord").alias("_first"), F.count(F.lit(1)).alias("_copies"))
        .filter(F.col("_copies") > 1).select(F.col("order_id").alias("_id"), "_first", "_copies"), "repeated-ids",
        stages=own, conf=STAGE_CONF, plain=PLAIN_COLUMNS)
    # the file order counts with the width of its columns
    order = rows.schema["_ord"].dataType
    known = ids.agg(F.coalesce(F.sum(text_bytes(ids)), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n"),
                    F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("spare")).first()
    size = known["b"] + known["n"] * 8 * len(order.fields)
    out = None
    if "_spot_row" in rows.columns and not broadcasts(size):
        marks = materialize(_copy_marks(rows, ids, size), "removed-copies", stages=own)
        if marks.count() * (MARKS_BLOCK // 8 + 64) <= MARKS_MAX_BYTES:
            drop_stages(spark, own[:1])  # the ids are not needed any more
            del own[0]
            out = rows.withColumn("_block", F.expr(f"_spot_row div {MARKS_BLOCK}")).join(
                F.broadcast(marks), ["_spot_file", "_block"], "left")
            copy = F.expr("getbit(_marks[cast(_spot_row div 64 % 64 as int)], cast(_spot_row % 64 as int)) = 1")
        else:
            drop_stages(spark, own[1:])
            del own[1:]
    if out is None:
        out = rows.join(sized_side(ids, size), F.col("order_id").eqNullSafe(F.col("_id")), "left")
        copy = F.col("_copies").isNotNull() & (F.col("_ord") != F.col("_first"))
    if stages is not None:
        stages += own
    removed = (
        F.when(F.col("_surplus"), F.lit(K.REMOVED_SURPLUS))
        .when(F.col("ship_date").isNull(), F.lit(K.REMOVED_UNDATED))
        .when(copy, F.lit(K.REMOVED_DUPLICATE))
    )
    out = out.withColumn("_removed", removed).drop("_id", "_first", "_copies", "_spot_file", "_spot_row", "_block", "_marks")
    return out, known["spare"]


def check_survivors(dated: int, spare: int, kept: int) -> None:
    """One survivor a distinct dated id."""
    if kept != dated - spare:
        raise ValueError(f"file order does not tell rows apart: {kept} survivors for {dated - spare} distinct ids; "
                         "give frames unique _ord* columns")


def group_stats(kept: DataFrame, accuracy: int | None = None, stages: list[str] | None = None) -> DataFrame:
    """All quartiles and medians the cleaning needs.

    Output columns: set, k1, k2, n (non-null values), q1, q2 (median), q3.
    Exact by default; ``accuracy`` switches to ``percentile_approx`` over the
    counted values (a bounded sketch per group).

    The rows are read once: one aggregation over grouping sets counts them by
    (service, carrier, cost), (lane, service, transit) and (promised days); all
    six sets are sums over those counts."""
    if accuracy:
        return _approximate_stats(kept, F.col("freight_cost_eur").cast("double"), accuracy)
    counted = materialize(count_values(kept), "counted", stages=stages, conf=STAGE_CONF)
    return stats_of_values(materialize(value_sets(counted), "value-counts", stages=stages))


def count_values(rows: DataFrame, by=()) -> DataFrame:
    """Rows by (service, carrier, cost), by (lane, service, transit) and by
    promised days, in one aggregation over grouping sets; per ``by`` too. The
    counts are additive: those of two sets of rows may be summed, and those of a
    part taken off."""
    by = list(by)
    values = rows.select(*by, "service_level", "carrier", "lane", F.col("freight_cost_eur").cast("double").alias("_cost"),
                         "transit_days", "promised_days")
    sets = [["service_level", "carrier", "_cost"], ["lane", "service_level", "transit_days"], ["promised_days"]]
    counted = values.groupingSets([[F.col(c) for c in (*by, *g)] for g in sets], *[F.col(c) for c in values.columns]).agg(
        F.count(F.lit(1)).alias("_c"),
        F.when(F.grouping("_cost") == 0, 0).when(F.grouping("transit_days") == 0, 1).otherwise(2).alias("_kind"))
    return counted.select(*by, "_kind", "service_level", "carrier", "lane", "_cost", "transit_days", "promised_days", "_c")


def value_sets(counted: DataFrame) -> DataFrame:
    """The six sets of counted values (set, k1, k2, v, _c), as sums over
    ``count_values``."""
    costs = counted.filter("_kind = 0").withColumnRenamed("_cost", "v")
    times = counted.filter("_kind = 1").withColumnRenamed("transit_days", "v")
    promised = counted.filter("_kind = 2").withColumnRenamed("promised_days", "v")

    def cells(set_id: int, base: DataFrame, *keys: str) -> DataFrame:
        # Grouped sets drop null keys (an equi-join never matches them either).
        names = [F.col(k) for k in keys] + [F.lit(None).cast("string")] * (2 - len(keys))
        rows = reduce(lambda d, k: d.filter(F.col(k).isNotNull()), keys, base)
        return rows.groupBy(F.lit(set_id).alias("set"), names[0].alias("k1"), names[1].alias("k2"), F.col("v").cast(
            "double").alias("v")).agg(F.sum("_c").alias("_c"))

    return reduce(DataFrame.unionByName, [
        cells(SET_OUTLIER, costs, "service_level"),
        cells(SET_LANE, times, "lane", "service_level"),
        cells(SET_COST, costs, "carrier", "service_level"),
        cells(SET_G_TRANSIT, times),
        cells(SET_G_COST, costs),
        cells(SET_G_PROMISED, promised),
    ])


def stats_of_values(sets: DataFrame) -> DataFrame:
    """Quartiles and medians of each group of ``value_sets``."""
    return quantiles_of_counts(sets, ["set", "k1", "k2"], "v", "_c", [0.25, 0.5, 0.75], ["q1", "q2", "q3"])


def _approximate_stats(kept: DataFrame, cost: Column, accuracy: int) -> DataFrame:
    """The same table with ``percentile_approx``: one bounded sketch per group."""
    def part(set_id: int, v: Column, *keys: str) -> DataFrame:
        names = [F.col(k) for k in keys] + [F.lit(None).cast("string")] * (2 - len(keys))
        rows = reduce(lambda d, k: d.filter(F.col(k).isNotNull()), keys, kept)
        q = F.percentile_approx(v.cast("double"), [0.25, 0.5, 0.75], accuracy)
        return rows.groupBy(F.lit(set_id).alias("set"), names[0].alias("k1"), names[1].alias("k2")).agg(
            F.count(v).alias("n"), q.alias("_q")).select(
            "set", "k1", "k2", "n", *[F.col("_q")[i].alias(f"q{i + 1}") for i in range(3)])

    transit = F.col("transit_days")
    return reduce(DataFrame.unionByName, [
        part(SET_OUTLIER, cost, "service_level"), part(SET_LANE, transit, "lane", "service_level"),
        part(SET_COST, cost, "carrier", "service_level"), part(SET_G_TRANSIT, transit), part(SET_G_COST, cost),
        part(SET_G_PROMISED, F.col("promised_days"))])


def exact_quantiles(df: DataFrame, keys: list[str], v: str, probs: list[float], names: list[str]) -> DataFrame:
    """Exact linear-interpolation quantiles per group (see
    ``quantiles_of_counts``). Output: keys, n (non-null values), one column per
    probability."""
    return quantiles_of_counts(df.groupBy(*keys, v).agg(F.count(F.lit(1)).alias("_c")), keys, v, "_c", probs, names)


def quantiles_of_counts(hist: DataFrame, keys: list[str], v: str, c: str, probs: list[float],
                        names: list[str]) -> DataFrame:
    """Exact quantiles from counts of distinct values, without any task that
    holds, or even sorts, a whole group.

    1. Values fall into buckets of about 0.4 % width (logarithmic, so an extreme
       value does not flatten the others). Bucket totals per group are a small
       table; running sums over it (some thousand rows a group at most) give
       each bucket the ranks before it.
    2. Only buckets that hold a wanted rank (floor and ceil of p*(n-1)) are
       sorted by value, each for itself.
    3. The values at the wanted ranks are interpolated as Spark's
       ``percentile`` does. Groups whose values are all null keep n = 0 and
       null quantiles."""
    val = F.col(v).cast("double")
    bucket = F.floor(F.signum(val) * F.log1p(F.abs(val)) * 256)
    same = lambda a, b: reduce(lambda x, k: x & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")), keys, F.lit(True))
    hist = hist.withColumn("_b", bucket)
    g = Window.partitionBy(*keys)
    totals = hist.groupBy(*keys, "_b").agg(F.sum(F.when(F.col(v).isNotNull(), F.col(c)).otherwise(0)).alias("_t"))
    totals = totals.withColumns({
        "_before": F.sum("_t").over(g.orderBy(F.col("_b").asc_nulls_first()).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)) - F.col("_t"),
        "_n": F.sum("_t").over(g)})
    pos = {p: F.lit(p) * (F.col("_n") - 1) for p in probs}
    ranks = [r for p in probs for r in (F.floor(pos[p]), F.ceil(pos[p]))]
    holds = reduce(lambda a, r: a | ((F.col("_before") <= r) & (r < F.col("_before") + F.col("_t"))), ranks, F.lit(False))
    hit = totals.filter(holds & (F.col("_t") > 0))
    rows = hist.alias("h").join(hit.alias("t"), same("h", "t") & (F.col("h._b") == F.col("t._b"))).select(
        *[F.col(f"h.{k}") for k in keys], F.col("h._b"), F.col(f"h.{v}").alias("_v"), F.col(f"h.{c}").alias("_c"), "_before", "_n")
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_end", F.col("_before") + F.sum("_c").over(inside))
    at = lambda r: F.max(F.when((F.col("_end") - F.col("_c") <= r) & (r < F.col("_end")), F.col("_v").cast("double")))
    picked = rows.groupBy(*keys).agg(
        *[at(F.floor(pos[p])).alias(f"_lo{i}") for i, p in enumerate(probs)],
        *[at(F.ceil(pos[p])).alias(f"_hi{i}") for i, p in enumerate(probs)])
    sizes = totals.groupBy(*keys).agg(F.max("_n").alias("n"))
    out = []
    for i, name in enumerate(names):
        at_, lo, hi = F.lit(probs[i]) * (F.col("n") - 1), F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append(F.when(F.floor(at_) == F.ceil(at_), lo)
                   .otherwise((F.ceil(at_) - at_) * lo + (at_ - F.floor(at_)) * hi).alias(name))
    joined = sizes.alias("s").join(picked.alias("p"), same("s", "p"), "left")
    return joined.select(*[F.col(f"s.{k}") for k in keys], F.col("n").cast("long").alias("n"), *out)


def _money_median(c: Column) -> Column:
    """A median of money: double -> decimal(18,4) -> rounded to cents."""
    return F.round(c.cast("decimal(18,4)"), 2).cast(MONEY)


def finish(kept: DataFrame, stats: DataFrame, min_values: int = K.OUTLIER_MIN_VALUES,
           iqr: float = K.OUTLIER_IQR_MULTIPLIER, penalty: float = K.LATE_PENALTY_EUR_PER_DAY,
           central_europe: list[str] | None = None) -> DataFrame:
    """D2-D4 and C12-C21 over the kept rows. Returns SHIPMENT_COLUMNS, the extra
    columns of the sources, and ``_transit_missing_cancelled`` for the log."""
    extras = [c for c in kept.columns if not c.startswith("_") and c not in SHIPMENT_COLUMNS
              and c not in ("carrier_raw", "ship_date_raw")]
    # each lookup's own size decides its own join
    size = {r["set"]: r["b"] for r in stats.groupBy("set").agg(F.sum(text_bytes(stats)).alias("b")).collect()}

    def lookup_of(set_id: int, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if size.get(set_id, 0) <= BROADCAST_MAX_BYTES else df

    small = stats
    limits = small.filter((F.col("set") == SET_OUTLIER) & (F.col("n") >= min_values)).select(
        F.col("k1").alias("service_level"), (F.col("q3") + F.lit(iqr) * (F.col("q3") - F.col("q1"))).alias("_upper")
    )
    lane_med = small.filter(F.col("set") == SET_LANE).select(
        F.col("k1").alias("lane"), F.col("k2").alias("service_level"), F.col("q2").alias("_lane_transit")
    )
    cost_med = small.filter(F.col("set") == SET_COST).select(
        F.col("k1").alias("carrier"), F.col("k2").alias("service_level"), F.col("q2").alias("_carrier_cost")
    )
    glob = small.filter(F.col("set") >= SET_G_TRANSIT).agg(
        F.max(F.when(F.col("set") == SET_G_TRANSIT, F.col("q2"))).alias("_g_transit"),
        F.max(F.when(F.col("set") == SET_G_COST, F.col("q2"))).alias("_g_cost"),
        F.max(F.when(F.col("set") == SET_G_PROMISED, F.col("q2"))).alias("_g_promised"),
    )
    df = (
        kept.join(lookup_of(SET_OUTLIER, limits), "service_level", "left")
        .join(lookup_of(SET_LANE, lane_med), ["lane", "service_level"], "left")
        .join(lookup_of(SET_COST, cost_med), ["carrier", "service_level"], "left")
        .crossJoin(F.broadcast(glob))  # exactly one row
    )
    # one projection, for the same reason as in ``annotate``
    cancelled = F.col("status") == "Cancelled"
    filled = F.coalesce(F.col("transit_days"), F.col("_lane_transit"), F.col("_g_transit"))
    transit = F.when(~cancelled, F.rint(filled)).cast("int")
    cost = F.coalesce(F.col("freight_cost_eur"), _money_median(F.col("_carrier_cost")), _money_median(F.col("_g_cost"))).cast(MONEY)
    outlier = F.coalesce(F.col("freight_cost_eur").cast("double") > F.col("_upper"), F.lit(False))
    promised = F.coalesce(F.col("promised_days"), F.col("_g_promised")).cast("int")
    delay = F.when(cancelled, F.lit(0)).otherwise(F.coalesce(F.greatest(transit - promised, F.lit(0)), F.lit(0))).cast("int")
    late = (delay > 0) & ~cancelled
    made = {
        "is_cancelled": cancelled,
        "cost_is_outlier": outlier,
        "transit_days_imputed": F.col("transit_days").isNull() & ~cancelled,
        "_transit_missing_cancelled": F.col("transit_days").isNull() & cancelled,
        "transit_days": transit,
        "cost_is_imputed": F.col("freight_cost_eur").isNull(),
        "freight_cost_eur": cost,
        "promised_days": promised,
        "delay_days": delay,
        "is_late": late,
        "is_on_time": ~late & ~cancelled,
        "late_penalty_eur": (delay.cast(MONEY) * F.lit(penalty).cast(MONEY)).cast(MONEY),
        "delivery_date": F.date_add(F.col("ship_date"), transit),
        "ship_weekday": weekday_name("ship_date"),
        "ship_week": week_start("ship_date"),
        "ship_month": month_start("ship_date"),
        "is_central_europe": F.coalesce(F.col("destination_country").isin(
            K.CENTRAL_EUROPE if central_europe is None else central_europe), F.lit(False)),
        "cost_per_kg": F.round(
            (cost.cast("double") / F.when(F.col("weight_kg") != 0, F.col("weight_kg"))).cast("decimal(38,10)"), 2).cast(MONEY),
        "is_billable": ~cancelled & ~outlier,
    }
    return df.select(*[made[c].alias(c) if c in made else F.col(c) for c in (*SHIPMENT_COLUMNS, *extras, "_transit_missing_cancelled")])


@dataclass
class Cleaned:
    """Result of a build: the typed table plus everything needed to audit it."""

    annotated: DataFrame            # every raw row with its disposition, over the written stage
    stats: DataFrame                # quartiles / medians used for outliers and imputation
    full: DataFrame                 # kept rows, with one helper column for the log
    sources: list[str] = field(default_factory=list)
    file_entries: DataFrame | None = None  # per-file ingest / map_schema log rows
    fx: dict = field(default_factory=dict)
    iqr: float = K.OUTLIER_IQR_MULTIPLIER
    penalty: float = K.LATE_PENALTY_EUR_PER_DAY
    stages: list[str] = field(default_factory=list)
    cells: DataFrame | None = None  # counts that the log is made from (audit.log_cells)
    counts: dict | None = None      # of the finished rows, observed while they were written
    cube_stage: DataFrame | None = None

    @property
    def cube(self) -> DataFrame:
        """The additive cube of the table (``cube.build_cube``), written once
        in date order; every view reads it instead of the shipments."""
        if self.cube_stage is None:
            cells = build_cube(self.table).repartitionByRange("ship_date").sortWithinPartitions("ship_date")
            self.cube_stage = materialize(cells, "cube", stages=self.stages)
        return self.cube_stage

    @property
    def table(self) -> DataFrame:
        """The processed table: SHIPMENT_COLUMNS, then extra source columns."""
        return self.full.drop("_transit_missing_cancelled")

    def rejects(self) -> DataFrame:
        """Q6: removed rows with their reason."""
        return self.annotated.filter(F.col("_removed").isNotNull()).select(
            "source_file", "order_id", "ship_date_raw", "carrier", F.col("_removed").alias("reason")
        )

    def rejected_rows(self) -> DataFrame:
        """The removed rows whole: every cleaned and extra column, and the reason."""
        gone = self.annotated.filter(F.col("_removed").isNotNull())
        return gone.select(*[c for c in gone.columns if not c.startswith("_")], F.col("_removed").alias("reason"))


def clean(raw: DataFrame, *, accuracy: int | None = None, stage_mode: str = "write",
          carriers: dict | None = None, fx: dict | None = None, tokens: list[str] | None = None,
          date_formats: list[str] | None = None, sources: list[str] | None = None,
          file_entries: DataFrame | None = None, check_flags: bool = True,
          min_values: int = K.OUTLIER_MIN_VALUES, iqr: float = K.OUTLIER_IQR_MULTIPLIER,
          penalty: float = K.LATE_PENALTY_EUR_PER_DAY, central_europe: list[str] | None = None, again=None) -> Cleaned:
    """Run the whole cleaning chain. The row-level stage is always written, so
    that each row's position in its file is fixed; so are the value counts and,
    with ``stage_mode="write"``, the finished table."""
    stages: list[str] = []
    # Counts come along with the writes (observed where the writing tasks are, so a
    # repeated task counts once) instead of further passes over the rows.
    row_settings = {"carriers": carriers, "fx": fx, "tokens": tokens, "date_formats": date_formats}
    rows, dated = write_rows(raw, stages, again, **row_settings)
    annotated, spare = disposition(rows, stages)
    kept = annotated.filter(F.col("_removed").isNull())
    stats = materialize(group_stats(kept, accuracy, stages), "stats", stages=stages)
    full = finish(kept, stats, min_values, iqr, penalty, central_europe)
    if stage_mode == "write":
        full, counts = write_finished(full, stages)
    else:
        counts = full.agg(*finished_counts()).first().asDict()
    try:
        check_survivors(dated, spare, counts["rows_out"])
        if check_flags:
            flag_error([c for c in FLAG_COLUMNS if counts[f"null_{c}"]])
    except ValueError:
        drop_stages(raw.sparkSession, stages)  # nothing of a refused build stays
        raise
    return Cleaned(annotated=annotated, stats=stats, full=full, sources=sources or [], file_entries=file_entries,
                   fx=K.FX_TO_EUR if fx is None else fx, iqr=iqr, penalty=penalty, stages=stages, counts=counts)


def write_rows(raw: DataFrame, stages: list[str], again=None, **settings) -> tuple[DataFrame, int]:
    """The row-level stage, and its number of dated rows, observed on the way.

    ``again``: where ``raw`` was read as one line a record (``_open_quote`` marks
    records whose quote is open at the line's end), reads the exports with such a
    record as multi-line records. The others are read once."""
    seen = Observation()
    metrics = [F.count_if(_dated()).alias("dated")]
    if "_open_quote" in raw.columns:
        metrics.append(F.collect_set(F.when(F.col("_open_quote"), F.col("_file"))).alias("files"))
    rows = annotate(raw, **settings).observe(seen, *metrics).drop("_open_quote")
    rows = placed(materialize(rows, "rows", stages=stages, conf=SHUFFLE_CONF, plain=PLAIN_COLUMNS))
    files = sorted(seen.get.get("files") or [])
    if not files or again is None:
        return rows, seen.get["dated"]
    more = Observation()
    second = annotate(again(files), **settings).observe(more, F.count_if(_dated()).alias("dated"))
    second = placed(materialize(second, "rows-multi-line", stages=stages, conf=SHUFFLE_CONF, plain=PLAIN_COLUMNS))
    first = rows.filter(~F.col("_file").isin(files))
    kept = first.agg(F.count_if(_dated()).alias("n")).first()["n"]
    return first.unionByName(second, allowMissingColumns=True), kept + more.get["dated"]


def finished_counts() -> list[Column]:
    """What the log and the gates count of the finished rows."""
    return [
        F.count(F.lit(1)).alias("rows_out"),
        F.count_if(F.col("cost_is_outlier")).alias("outliers"),
        F.count_if(F.col("transit_days_imputed")).alias("transit_imputed"),
        F.count_if(F.col("_transit_missing_cancelled")).alias("transit_cancelled"),
        F.count_if(F.col("cost_is_imputed")).alias("cost_imputed"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in FLAG_COLUMNS],
    ]


def write_finished(full: DataFrame, stages: list[str]) -> tuple[DataFrame, dict]:
    """The finished table is the unit every view reads: write it once, so
    queries plan against a Parquet scan. Each file is in date order, so a
    date range skips row groups by their statistics. Returns the table and the
    counts observed on the way."""
    done = Observation()
    out = materialize(full.sortWithinPartitions("ship_date").observe(done, *finished_counts()), "shipments", stages=stages,
                      conf=STAGE_CONF, plain=PLAIN_COLUMNS)
    return out, dict(done.get)


def null_flags(full: DataFrame) -> DataFrame:
    """C22 as counts: one row, the null values of each flag (all should be 0)."""
    return full.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in FLAG_COLUMNS])


def flag_gate(full: DataFrame) -> None:
    """A null flag is an error, never coerced. One aggregation."""
    row = null_flags(full).first()
    flag_error([c for c in FLAG_COLUMNS if row[c]])


def flag_error(bad: list[str]) -> None:
    if bad:
        raise ValueError(
            "Flag column(s) " + ", ".join(f"`{c}`" for c in bad)
            + " contain nulls (usually a missing status). A flag must be true or false; "
            "investigate the input rather than coercing it."
        )
