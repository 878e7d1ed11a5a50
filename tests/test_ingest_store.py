"""CSV exports of three vocabularies (S1-S8), storage round trip (S9-S11,
S13) and staleness (S12)."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

WMS = ("order_id,ship_date,carrier,origin_city,origin_country,destination_city,destination_country,service_level,"
       "customer_segment,weight_kg,freight_cost,currency,transit_days,promised_days,status\n"
       "W1,2025-03-14,Nordfrakt,Malmo,SE,Berlin,DE,Standard,retail,10,100,EUR,3,4,Delivered\n"
       "D1,2025-03-15,Nordfrakt,Malmo,SE,Berlin,DE,Standard,retail,10,111,EUR,3,4,Delivered\n")
TMS = ("Order ID,Ship Date,Carrier,Origin City,Origin Country,Destination City,Destination Country,Service Level,"
       "Customer Segment,Weight (kg),Freight Cost,Currency,Transit Days,Promised Days,Status\n"
       "T1,14/03/2025,MERIDIAN EXPRESS,Oslo,NO,Prague,CZ,express,b2b,5,200,SEK,2,2,IN TRANSIT\n"
       "D1,2025-03-16,Nordfrakt,Malmo,SE,Berlin,DE,Standard,retail,10,222,EUR,3,4,Delivered\n")
BROKER = ("CONSIGNMENT_NO;DESPATCH_DATE;HAULIER;COLLECT_CITY;COLLECT_CC;DELIVER_CITY;DELIVER_CC;SERVICE;ACCOUNT_TYPE;"
          "GROSS_WEIGHT_KG;NET_CHARGE;CCY;DAYS_IN_TRANSIT;SLA_DAYS;CONSIGNMENT_STATUS\n"
          "B1;Mar 14, 2025;kestrel;Rome;IT;Paris;FR;Economy;retail;0;50;USD;NA;7;Delivered\n")


@pytest.fixture(scope="module")
def exports(tmp_path_factory):
    d = tmp_path_factory.mktemp("exports")
    (d / "a_wms.csv").write_text(WMS)
    (d / "b_tms.csv").write_text(TMS)
    (d / "c_broker.csv").write_text(BROKER)
    return d


def test_header_mapping_unit():
    from shipledger.sources.ingest import map_header, snake, sniff_delimiter

    assert snake(" Weight (kg) ") == "weight_kg"
    assert snake("Order ID") == "order_id"
    assert sniff_delimiter("A;B;C,D") == ";"
    assert sniff_delimiter("order_id") == ","
    hm = map_header("x.csv", ["CONSIGNMENT_NO", "CCY", "extra col"])
    assert hm.columns == ["order_id", "currency", "extra_col"]
    assert hm.mapping_detail == "ccy -> currency, consignment_no -> order_id"
    with pytest.raises(ValueError, match="both map to"):
        map_header("x.csv", ["weight", "gross_weight"])


def test_three_vocabularies(spark, exports):
    from shipledger.plans.build import build_from_files
    from shipledger.operators import audit

    b = build_from_files(spark, str(exports))
    t = {r.order_id: r for r in b.table.collect()}
    assert set(t) == {"W1", "D1", "T1", "B1"}
    assert t["D1"].freight_cost_eur == 111 and t["D1"].source_file == "a_wms.csv"   # first file wins
    assert t["T1"].carrier == "Meridian Express" and t["T1"].status == "In Transit"
    assert t["T1"].ship_date == dt.date(2025, 3, 14) and float(t["T1"].freight_cost_eur) == 17.4
    assert t["B1"].carrier == "Kestrel Parcel" and t["B1"].transit_days_imputed
    assert t["B1"].cost_per_kg is None
    log = audit.cleaning_log(b).collect()
    maps = [r.detail for r in log if r.step == "map_schema"]
    assert any(d.startswith("c_broker.csv: ") and "haulier -> carrier" in d for d in maps)
    assert [r.rows_affected for r in log if r.step == "ingest"] == [2, 2, 1]


def test_single_file_and_refusal(spark, exports, tmp_path):
    from shipledger.plans.build import build_from_files
    from shipledger.sources.ingest import read_exports

    one = build_from_files(spark, [str(exports / "c_broker.csv")])
    assert one.table.count() == 1
    junk = tmp_path / "vendor_invoices.csv"
    junk.write_text("invoice_no,vendor,amount\nINV-1,Acme,120\n")
    with pytest.raises(ValueError) as err:
        read_exports(spark, [str(junk)])
    assert "could not be found" in str(err.value) and "Columns seen" in str(err.value)


def test_storage_parity_and_log(spark, fixture_build, tmp_path):
    from shipledger.operators import audit, findings
    from shipledger.sources import store

    store.write_processed(fixture_build.table, str(tmp_path / "pq"), csv_path=str(tmp_path / "csv"))
    a = store.read_processed(spark, str(tmp_path / "pq"))
    b = store.read_processed(spark, str(tmp_path / "csv"), fmt="csv")
    assert a.count() == b.count() == fixture_build.table.count()
    assert store.parity(a, b).count() == 0
    assert store.parity(a, fixture_build.table).count() == 0
    store.write_log(audit.cleaning_log(fixture_build), audit.totals(fixture_build), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log" / "totals")).first().reconciles
    store.export_evidence(findings.evidence(fixture_build.table), str(tmp_path / "ev"))


def test_staleness(spark, exports, tmp_path):
    from shipledger.streaming import freshness

    src = tmp_path / "src"
    src.mkdir()
    (src / "a.csv").write_text(WMS)
    out = str(tmp_path / "out")
    assert freshness.ensure_processed(spark, str(src), out)          # first build
    assert freshness.ensure_processed(spark, str(src), out) == []    # fresh
    time.sleep(1.1)
    (src / "b.csv").write_text(TMS)                                   # a new export arrives
    assert freshness.is_stale(spark, str(src), out)
    assert freshness.ensure_processed(spark, str(src), out)
    t = freshness.open_processed(spark, out)
    assert set(r.source_file for r in t.select("source_file").distinct().collect()) == {"a.csv", "b.csv"}
    os.remove(src / "b.csv")
    assert freshness.is_stale(spark, str(src), out)   # a removed export counts too


def test_sorted_write_keeps_the_stable_order(spark, fixture_build, tmp_path):
    """Each written file holds its rows in (ship_date, order_id) order, and
    the month partitions hold consecutive ranges; nothing is lost."""
    from pyspark.sql import functions as F

    from shipledger.sources import store

    out = str(tmp_path / "sorted")
    store.write_processed(fixture_build.table, out, sort=True)
    back = spark.read.parquet(out)
    assert back.count() == fixture_build.table.count()
    rows = back.select(F.input_file_name().alias("f"), "ship_date", "order_id").collect()
    per_file: dict = {}
    for r in rows:
        per_file.setdefault(r.f, []).append((r.ship_date, r.order_id or ""))
    for f, keys in per_file.items():
        assert keys == sorted(keys), f


ROW = "{id},2025-03-14,Nordfrakt,Malmo,SE,{city},DE,Standard,retail,10,{cost},EUR,3,4,Delivered"
HEAD = WMS.split("\n")[0]


def test_quotes_line_breaks_and_surplus_fields(spark, tmp_path):
    """Doubled quotes and line breaks inside fields keep their columns; a short
    line is filled with nulls; a surplus line is removed with a reason."""
    from shipledger.operators import audit
    from shipledger.plans.build import build_from_files

    lines = [HEAD, ROW.format(id="Q1", city='"He said ""hi"", x"', cost=1), ROW.format(id="Q2", city='"two\nlines"', cost=2),
             ROW.format(id="Q3", city="Berlin", cost=3) + ",surplus", ROW.format(id="Q4", city='"a,b"', cost=4) + ',"x,y"',
             ROW.format(id="Q5", city="Berlin", cost=5)]
    (tmp_path / "q.csv").write_text("\n".join(lines) + "\n")
    built = build_from_files(spark, str(tmp_path))
    t = {r.order_id: r for r in built.table.collect()}
    assert set(t) == {"Q1", "Q2", "Q5"}
    assert t["Q1"].destination_city == 'He said "hi", x' and t["Q1"].status == "Delivered"
    assert t["Q2"].destination_city == "two\nlines" and float(t["Q2"].freight_cost) == 2
    gone = {r.order_id: r.reason for r in built.rejected_rows().collect()}
    assert gone == dict.fromkeys(("Q3", "Q4"), "line has more fields than its header")
    log = audit.cleaning_log(built).collect()
    assert [r.rows_affected for r in log if "more fields" in r.action] == [2]
    tot = audit.totals(built).first()
    assert (tot.rows_in, tot.rows_removed, tot.rows_out, tot.reconciles) == (5, 2, 3, True)


def test_short_lines_are_filled_with_nulls(spark, tmp_path):
    from shipledger.sources.ingest import read_exports

    (tmp_path / "s.csv").write_text("\ufeff" + HEAD + "\nS1,2025-03-14,Nordfrakt\n", encoding="utf-8")
    (tmp_path / "t.csv").write_text(HEAD + "\n" + ROW.format(id="T1", city="B", cost=1) + "\n")
    rows = {r.order_id: r for r in read_exports(spark, str(tmp_path)).raw.collect()}
    assert rows["S1"].carrier == "Nordfrakt" and rows["S1"].status is None and not rows["S1"]._surplus


def test_names_with_spaces_and_equal_names(spark, tmp_path):
    from shipledger.operators import audit
    from shipledger.plans.build import build_from_files

    one, two = tmp_path / "one+1", tmp_path / "two 2%"
    one.mkdir()
    two.mkdir()
    (one / "b two.csv").write_text(HEAD + "\n" + ROW.format(id="D1", city="A", cost=111) + "\n")
    (two / "b two.csv").write_text(HEAD + "\n" + ROW.format(id="D1", city="A", cost=222) + "\n"
                                   + ROW.format(id="D2", city="A", cost=5) + "\n")
    paths = [str(one / "b two.csv"), str(two / "b two.csv")]
    for order, cost, counts in ((paths, 111, [1, 2]), (paths[::-1], 222, [2, 1])):
        built = build_from_files(spark, order)
        t = {r.order_id: r for r in built.table.collect()}
        assert float(t["D1"].freight_cost) == cost and t["D1"].source_file == "b two.csv"
        log = audit.cleaning_log(built).orderBy("seq").collect()
        assert [r.rows_affected for r in log if r.step == "ingest"] == counts


def test_extra_columns_survive_storage(spark, tmp_path):
    from shipledger.plans.build import build_from_files
    from shipledger.sources import store

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.csv").write_text(HEAD + ",Cost Centre\n" + ROW.format(id="X1", city="A", cost=1) + ",CC 7\n")
    t = build_from_files(spark, str(tmp_path / "in")).table
    assert t.first().cost_centre == "CC 7"
    store.write_processed(t, str(tmp_path / "pq"), csv_path=str(tmp_path / "csv"))
    a = store.read_processed(spark, str(tmp_path / "pq"))
    b = store.read_processed(spark, str(tmp_path / "csv"), fmt="csv")
    assert a.first().cost_centre == b.first().cost_centre == "CC 7"
    assert store.parity(a, b).count() == 0


def test_headers_come_from_the_first_bytes(spark, exports, tmp_path):
    from shipledger.sources.ingest import read_headers

    got = read_headers(spark, [f"file:{exports}/a_wms.csv", f"file:{exports}/c_broker.csv"])
    assert {k.rsplit("/", 1)[-1]: v.split(";")[0].split(",")[0] for k, v in got.items()} == {
        "a_wms.csv": "order_id", "c_broker.csv": "CONSIGNMENT_NO"}
    wide = ",".join(f"column_{i}" for i in range(3000))
    (tmp_path / "wide.csv").write_text("\ufeff" + wide + "\r\n1,2\n", encoding="utf-8")
    (tmp_path / "bare.csv").write_text("one,two")
    (tmp_path / "none.csv").write_text("")
    got = read_headers(spark, [f"file:{tmp_path}/{n}.csv" for n in ("wide", "bare", "none")], first_bytes=64)
    assert sorted(got.values()) == sorted([wide, "one,two", ""])


def test_only_exports_with_open_quotes_are_read_again(spark, tmp_path):
    from shipledger.plans.build import build_from_files
    from shipledger.sources import ingest

    (tmp_path / "a.csv").write_text(HEAD + "\n" + ROW.format(id="P1", city='"plain, quoted"', cost=1) + "\n")
    (tmp_path / "b.csv").write_text(HEAD + "\n" + ROW.format(id="P2", city='"a,b\nc ""d"""', cost=2) + "\n"
                                    + ROW.format(id="P3", city="Kiel", cost=3) + "\n")
    (tmp_path / "c.csv").write_text(HEAD + "\n" + ROW.format(id="P4", city='"""doubled"""', cost=4) + "\n")
    asked = []
    read = ingest.read_exports

    def watched(*args, **kw):
        ing = read(*args, **kw)
        again = ing.again
        ing.again = lambda files: asked.append(files) or again(files)
        return ing

    ingest.read_exports = watched
    try:
        t = {r.order_id: r for r in build_from_files(spark, str(tmp_path)).table.collect()}
    finally:
        ingest.read_exports = read
    assert asked == [[1, 2]]  # c holds a value that begins with a quote: read again with the same result
    assert {k: r.destination_city for k, r in t.items()} == {
        "P1": "plain, quoted", "P2": 'a,b\nc "d"', "P3": "Kiel", "P4": '"doubled"'}
    raw = {r.order_id: r for r in read(spark, str(tmp_path)).raw.collect()}
    assert {k: raw[k].destination_city for k in t} == {k: r.destination_city for k, r in t.items()}


def _csv_rows(spark, path):
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "(empty)").csv(path)
    return df.columns, sorted((tuple("" if v == "(empty)" else v for v in r) for r in df.collect()), key=str)


def test_csv_is_written_from_the_stored_parquet(spark, tmp_path):
    """The frame is made, dealt and sorted once for both formats; both hold the same rows,
    also those without a month and repeated ones."""
    from shipledger.sources import store

    feb, mar = dt.date(2025, 2, 1), dt.date(2025, 3, 1)
    rows = [("A", mar, "", "007", mar), ("A", mar, "", "007", mar), ("B", feb, None, 'x "y", z', feb), (None, None, "t", None, None)]
    made = spark.sparkContext.accumulator(0)
    table = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(lambda r: (made.add(1), r)[1]),
                                  "order_id string, ship_month date, lane string, cost_centre string, ship_date date")
    store.write_processed(table, str(tmp_path / "pq"), csv_path=str(tmp_path / "csv"))
    assert made.value == len(rows)
    columns, got = _csv_rows(spark, str(tmp_path / "csv"))
    assert columns == table.columns
    want = sorted((tuple(v.isoformat() if isinstance(v, dt.date) else v for v in r) for r in rows), key=str)
    assert got == want
    stored = spark.read.schema(table.schema).parquet(str(tmp_path / "pq")).select(*table.columns)
    assert sorted(map(tuple, stored.collect()), key=str) == sorted(rows, key=str)


def test_csv_of_rows_that_the_parquet_does_not_hold_alone(spark, tmp_path):
    """Appended rows, an empty table, and a text as folder name (an empty one is stored as
    null there) come to the CSV as they are."""
    from shipledger.sources import store

    pq, csv = str(tmp_path / "pq"), str(tmp_path / "csv")
    table = spark.sql("select 'A' as order_id, date'2025-03-01' as ship_month")
    store.write_processed(table, pq, csv_path=csv, mode="append")
    store.write_processed(table, pq, csv_path=csv, mode="append")
    assert _csv_rows(spark, csv)[1] == [("A", "2025-03-01")] * 2
    store.write_processed(table.limit(0), pq, csv_path=csv)
    assert _csv_rows(spark, csv) == (table.columns, [])
    texts = spark.createDataFrame([("A", ""), ("B", None), ("C", "01")], "order_id string, carrier string")
    store.write_processed(texts, pq, csv_path=csv, partition_by="carrier")
    assert _csv_rows(spark, csv)[1] == [("A", ""), ("B", None), ("C", "01")]
