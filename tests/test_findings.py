"""Findings by hand: the planted Friday signal, each finding's sentences typed
here, slices against the same slice alone (a null slice included), formats."""

import pytest
from pyspark.sql import functions as F

from shipledger.operators import aggregates as A
from shipledger.operators import findings as FD


def shipment(day, carrier, dest, late, seg="retail", n=1, transit=None, cancelled=False):
    """n rows: a Mon-Fri of March 2025, EUR 100 each, EUR 90 penalty when late."""
    date = {"Monday": "2025-03-03", "Tuesday": "2025-03-04", "Wednesday": "2025-03-05", "Thursday": "2025-03-06",
            "Friday": "2025-03-07"}[day]
    t = transit if transit is not None else (6 if late else 4)
    return [(date, day, carrier, dest, seg, late, not late, 2 if late else 0, 90.0 if late else 0.0, t, cancelled)] * n


@pytest.fixture(scope="module")
def planted(spark):
    """Nordfrakt into DE: 10 of 20 Friday dispatches late at 6 days, 1 of 20 on
    each other weekday at 4 days. Baltica into SE: never late."""
    rows = []
    for day in ("Monday", "Tuesday", "Wednesday", "Thursday"):
        rows += shipment(day, "Nordfrakt", "DE", True, n=1) + shipment(day, "Nordfrakt", "DE", False, n=19)
        rows += shipment(day, "Baltica Logistics", "SE", False, n=30, seg=None)
    rows += shipment("Friday", "Nordfrakt", "DE", True, n=10) + shipment("Friday", "Nordfrakt", "DE", False, n=10, transit=6)
    df = spark.createDataFrame(rows, "d string, ship_weekday string, carrier string, destination_country string, "
                                     "customer_segment string, is_late boolean, is_on_time boolean, delay_days int, "
                                     "p double, transit_days int, is_cancelled boolean")
    return df.withColumns({"ship_date": F.col("d").cast("date"), "late_penalty_eur": F.col("p").cast("decimal(18,2)"),
                           "freight_cost_eur": F.lit(100).cast("decimal(18,2)"), "is_billable": F.lit(True),
                           "cost_is_outlier": F.lit(False)})


def test_planted_friday(planted):
    s = A.weekday_signal(planted).collect()
    assert len(s) == 1
    s = s[0]
    assert (s.carrier, s.region, s.weekday, s.shipments, s.baseline_shipments) == ("Nordfrakt", "Central Europe", "Friday", 20, 80)
    assert s.late_pct == 50.0 and s.baseline_late_pct == 5.0 and s.late_pct > 2 * s.baseline_late_pct
    # other days: 4 late at 6 days, 76 at 4 days -> 4.1; Friday 6 -> +46.3 %
    assert s.transit_uplift_pct == pytest.approx(100 * (6 / 4.1 - 1)) and s.transit_uplift_pct > 15
    assert s.penalties_eur == 900.0


def test_findings_by_hand(planted):
    """Book: 220 shipments, EUR 22,000; 14 late, EUR 1,260; on time 206 / 220 = 93.6 %.
    Nordfrakt: 86 of 100 on time, 7.6 points below: under the 10 of F1, so F2 and F3."""
    f = {r.key: r for r in FD.findings(planted).collect()}
    assert set(f) == {"weekday", "worst_lane"}
    lane, day = f["worst_lane"], f["weekday"]
    assert (lane.position, lane.leak_eur, lane.severity) == (1, 1260.0, "critical")
    assert lane.share_pct == pytest.approx(100 * 1260 / 22000)
    assert lane.claim.startswith("Nordfrakt into DE is the lane losing most to late delivery: ")
    assert "14" in lane.claim and "100 shipments" in lane.claim
    assert (day.position, day.leak_eur, day.severity) == (2, 900.0, "critical")
    assert day.claim.startswith("Nordfrakt Friday dispatches to Central Europe arrive late ")
    assert "50" in day.claim and "on other weekdays" in day.claim
    assert "the Thursday" in day.action or "Thursday" in day.action
    assert day.cite_row == 4  # Monday to Thursday come first


def test_weakest_carrier_by_hand(spark, planted):
    """Add 60 punctual Vantage shipments' worth of gap: Nordfrakt late 60 of 100."""
    worse = planted.withColumns({"is_late": F.col("carrier") == "Nordfrakt", "is_on_time": F.col("carrier") != "Nordfrakt",
                                 "late_penalty_eur": F.when(F.col("carrier") == "Nordfrakt", 45).otherwise(0).cast("decimal(18,2)")})
    f = {r.key: r for r in FD.findings(worse).collect()}
    w = f["weakest_carrier"]
    # on time 0 of 100; the book 120 of 220 = 54.5 %: 55 points below; EUR 4,500 of 22,000
    assert w.claim.startswith("Nordfrakt runs 55 points below the book at ") and w.leak_eur == 4500.0
    assert w.severity == "critical" and "100 shipments" in w.claim


def test_summary_and_brief_by_hand(planted):
    s = FD.executive_summary(planted).first()
    assert (s.n_findings, s.n_critical, s.hero_eur, s.addressed_eur) == (2, 2, 1260.0, 2160.0)
    assert s.sentence_1.startswith("Two findings account for <b>")
    assert "93.6" in s.sentence_3 and "14 arrived late" in s.sentence_3
    b = [r.text for r in FD.brief(planted).orderBy("bullet_no").collect()]
    assert len(b) == 2 and b[0].startswith("**Friday is where Central Europe is losing you money.** 50% of Nordfrakt's")
    assert b[1].startswith("**Your worst single lane is Nordfrakt into DE.** 14% late across 100 shipments")
    assert "one commercial conversation" in b[1]
    audit = FD.brief_audit(planted).first()
    assert audit.traceable and audit.figures > 5


def test_nothing_to_escalate(planted):
    calm = planted.filter("carrier = 'Baltica Logistics'").limit(5)  # too few for a lane
    assert FD.findings(calm).count() == 0
    b = FD.brief(calm).collect()
    assert len(b) == 1 and b[0].text.startswith("**Nothing in this view is worth escalating.** 100.0% on time across 5")
    assert FD.executive_summary(calm).first().n_findings == 0


def norm(df, drop=()):
    return sorted(str([(c, round(v, 9) if isinstance(v, float) else v) for c, v in sorted(r.asDict().items()) if c not in drop])
                  for r in df.collect())


@pytest.mark.parametrize("make", [FD.findings, FD.evidence, FD.executive_summary, FD.brief, FD.brief_audit,
                                  A.worst_lanes, A.weekday_signal, A.kpis, A.composition])
def test_slices_equal_each_slice_alone(planted, make):
    """customer_segment holds a null slice: no slice may vanish."""
    df = planted.withColumn("customer_segment", F.when(F.col("ship_weekday") == "Monday", "b2b").otherwise(
        F.col("customer_segment")))
    got = make(df, by="customer_segment")
    for value in ("retail", "b2b", None):
        same = F.col("customer_segment").eqNullSafe(F.lit(value))
        alone = norm(make(df.filter(same)))
        assert norm(got.filter(same), ("customer_segment",)) == alone, value
    if make in (FD.executive_summary, FD.brief, FD.brief_audit, A.kpis):
        assert got.select("customer_segment").distinct().count() == 3


def test_weekday_evidence_keeps_a_null_slice(planted):
    null = planted.withColumn("customer_segment", F.lit(None).cast("string"))
    sig = A.weekday_signal(null, by="customer_segment")
    ev = A.weekday_evidence(null, sig, by="customer_segment").orderBy("weekday_order").collect()
    assert [(r.weekday, r.shipments) for r in ev] == [(d, 20) for d in ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday")]


def test_wide_lane_matrix(planted):
    wide = {r.carrier: r.asDict() for r in A.lane_matrix_wide(planted).collect()}
    assert wide["Nordfrakt"]["DE"] == pytest.approx(14.0) and wide["Nordfrakt"]["SE"] is None
    counts = {r.carrier: r.asDict() for r in A.lane_matrix_wide(planted, "shipments").collect()}
    assert counts["Baltica Logistics"]["SE"] == 120 and counts["Baltica Logistics"]["DE"] == 0


def test_one_cube_for_a_view(planted, monkeypatch):
    """Findings, evidence, summary, brief and audit of one view share one cube."""
    made = []
    monkeypatch.setattr(FD, "materialize", lambda df, name, *a, **k: made.append(name) or df)
    fx = FD.Facts(planted)
    for make in (FD.findings, FD.evidence, FD.executive_summary, FD.brief, FD.brief_audit):
        make(planted, facts=fx).count()
    assert made == ["facts-cube"]
