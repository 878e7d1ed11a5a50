"""The row-level stage: shapes that take a short way give what the long way gives, and its plan stays narrow."""

import datetime as dt

from pyspark.sql import functions as F

from shipment_rows import COLS, FIXTURE

ODD = ["", " ", "a", "A", " a", "a ", "a ", "　a", "äb", "bä", "in transit", "IN  TRANSIT", "next-day 2nd", "abc\n",
       "O'NEIL", "École", "x1y", "Nordfrakt AB", "Baltica Logistics A/S", "\x1fz\x85", "Kelvin", "~", "!a!", "\x7f", "a\tb", None]


def test_short_ways_equal_the_long_ones(spark):
    from shipledger.functions.text import WHITESPACE, carrier_key, strip_ws, title_case

    df = spark.createDataFrame([(v,) for v in ODD], "v string")
    spaced = F.regexp_replace(F.lower("v"), r"([^\p{L}])", "$1 ")
    rows = df.select(
        "v", strip_ws("v").alias("s"), F.trim("v", F.lit(WHITESPACE)).alias("s_long"),
        title_case("v").alias("t"), F.regexp_replace(F.initcap(spaced), r"([^\p{L}]) ", "$1").alias("t_long"),
        carrier_key("v").alias("k"), F.regexp_replace(F.lower(F.coalesce("v", F.lit(""))), "[^a-z]", "").alias("k_long")).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert (r.s, r.t, r.k) == (r.s_long, r.t_long, r.k_long), r.v


def test_ends_of_months_and_weekdays(spark):
    from shipledger.functions.dates import parse_ship_date, weekday_name

    want = {"2024-02-29": dt.date(2024, 2, 29), "29/02/2023": None, "31/04/2025": None, "30.04.2025": dt.date(2025, 4, 30),
            "1900-02-29": None, "Feb 29, 2000": dt.date(2000, 2, 29), "31 June 2025": None, "31-Dec-99": dt.date(1999, 12, 31),
            "2025-13-31": None, "2025-01-32": None, "0000-01-31": None, "2025-03-14T10:00:00Z": dt.date(2025, 3, 14)}
    rows = spark.createDataFrame([(v,) for v in want], "v string").select("v", parse_ship_date("v").alias("d")).collect()
    assert {r.v: r.d for r in rows} == want
    days = spark.sql("SELECT date_add(DATE '2025-03-10', CAST(id AS INT)) AS d FROM range(7)").select(
        weekday_name("d").alias("n"), F.date_format("d", "EEEE").alias("w")).collect()
    assert all(r.n == r.w for r in days) and len(days) == 7


def test_row_level_stage_copies_a_row_at_most_three_times(spark):
    from shipledger.operators.clean import annotate

    df = spark.createDataFrame(FIXTURE, ", ".join(f"{c} string" for c in COLS)).withColumn("_ord1", F.lit(1)).withColumn(
        "source_file", F.lit("a"))
    plan = annotate(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Project [") <= 3  # eight before


def test_written_stages_run_compiled_and_leave_the_session_as_it_was(spark):
    from shipledger.session import SESSION_CONF, jit_sized

    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "65535")
    try:
        with jit_sized(spark):
            assert spark.conf.get(key) == SESSION_CONF[key]
        assert spark.conf.get(key) == "65535"
    finally:
        spark.conf.set(key, before)


def test_table_written_once_with_its_counts(spark, tmp_path):
    from shipledger.sources.store import write_processed

    df = spark.sql("SELECT DATE '2025-01-01' AS ship_month, DATE '2025-01-05' AS ship_date, id, id % 2 = 0 AS _even FROM range(10)")
    seen = write_processed(df, str(tmp_path / "t"), counts=[F.count(F.lit(1)).alias("rows"), F.count_if("_even").alias("even")])
    back = spark.read.parquet(str(tmp_path / "t"))
    assert seen == {"rows": 10, "even": 5} and back.count() == 10 and "_even" not in back.columns


def test_short_looks_at_ends_and_tokens_equal_the_long_ones(spark):
    from shipledger.constants import NULL_TOKENS
    from shipledger.functions.text import WHITESPACE, null_tokens, strip_ws

    values = [*ODD, *NULL_TOKENS, *[f" {t}" for t in NULL_TOKENS], "é", "!é", "é!", "\x80", "a\x7f", "\x7fa", "aé", "ab" * 40]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = df.select("v", strip_ws("v").alias("s"), F.trim("v", F.lit(WHITESPACE)).alias("s_long"), null_tokens("v").alias("n"),
                     null_tokens("v", []).alias("all"), null_tokens("v", ["é", "\x80"]).alias("own")).collect()
    assert all(r.s == r.s_long for r in rows)
    assert all(r.n == (None if r.v in NULL_TOKENS else r.v) for r in rows)
    assert all(r.all == r.v and r.own == (None if r.v in ("é", "\x80") else r.v) for r in rows)


def test_many_repeated_ids_are_joined_back_without_a_sort_of_the_rows(spark, monkeypatch):
    from shipledger import session
    from shipledger.operators import clean as C

    df = spark.sql("""SELECT CASE WHEN id % 7 = 0 THEN NULL ELSE concat('ORD-', id % 40) END AS order_id,
                      IF(id % 11 = 0, NULL, DATE '2025-01-01') AS ship_date, id % 13 = 0 AS _surplus,
                      struct(id % 3 AS _ord1, id AS _ord2) AS _ord FROM range(200)""")
    want, spare = C.disposition(df)
    assert "Broadcast" in want._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(session, "BROADCAST_MAX_BYTES", -1)
    got, again = C.disposition(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan  # a sort-merge join before
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and spare == again
    monkeypatch.setattr(session, "HASHED_MAX_BYTES", -1)  # too many ids for hash tables: the join that spills
    spilling, _ = C.disposition(df)
    assert "ShuffledHashJoin" not in spilling._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, spilling.collect())) == sorted(map(str, want.collect()))


def test_a_stage_has_its_own_task_size(spark, monkeypatch):
    from shipledger import session
    from shipledger.operators import clean as C

    key, seen = "spark.sql.adaptive.advisoryPartitionSizeInBytes", []
    before = spark.conf.get(key)
    real = session.jit_sized

    def looked(s, more=None):
        seen.append(dict(more or {}))
        return real(s, more)

    monkeypatch.setattr(session, "jit_sized", looked)
    df = spark.createDataFrame(FIXTURE, ", ".join(f"{c} string" for c in COLS)).withColumn("_ord1", F.monotonically_increasing_id())
    C.clean(df.withColumn("source_file", F.lit("a")))
    assert sum(key in m for m in seen) == 4  # rows, repeated ids, counts, shipments
    assert spark.conf.get(key) == before
