"""Registered queries for findings, summary, brief and report formatting
(F1-F8, X1-X7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shipledger.functions import formats as X
from shipledger.operators import findings as FD
from shipledger.plans.build import processed
from shipledger.plans import oracle_findings as OF
from shipledger.plans.registry import register


def _table(spark, sf_dir):
    return processed(spark, sf_dir).table


FINDING_COLS = ["key", "position", "severity", "share_pct", "leak_eur", "figure_eur", "claim", "support_1",
                "support_2", "support_3", "action", "figure_label", "figure_basis", "method", "exclusions",
                "cite_row", "cite_columns"]


@register("findings", lambda: OF.findings_sql())
def q_findings(spark, sf_dir):
    return FD.findings(_table(spark, sf_dir)).select(*FINDING_COLS)


@register("findings_by_segment", lambda: OF.findings_sql(["customer_segment"]))
def q_findings_by_segment(spark, sf_dir):
    return FD.findings(_table(spark, sf_dir), by="customer_segment").select("customer_segment", *FINDING_COLS)


@register("evidence", OF.evidence_sql)
def q_evidence(spark, sf_dir):
    return FD.evidence(_table(spark, sf_dir))


@register("finding_cites", OF.cites_sql)
def q_finding_cites(spark, sf_dir):
    return FD.finding_cites(_table(spark, sf_dir))


@register("finding_records", OF.records_sql)
def q_finding_records(spark, sf_dir):
    """The nested records, with their arrays written out as text."""
    def text(name, sep, part):
        return F.array_join(F.transform(name, part), sep).alias(name)

    return FD.records(_table(spark, sf_dir)).select(
        "key", "position", "severity", "share_pct", "leak_eur", "claim", F.array_join("support", " / ").alias("support"),
        F.size("support").alias("n_support"), "action", F.col("figure.eur").alias("figure_eur"),
        F.col("figure.label").alias("figure_label"), F.col("figure.basis").alias("figure_basis"), "method", "exclusions",
        text("cite", "; ", lambda c: F.concat_ws(":", c["row_no"].cast("string"), c["column"])),
        text("columns", "; ", lambda c: F.concat_ws("|", c["name"], c["label"], c["kind"], F.coalesce(c["format"], F.lit("-")))))


@register("executive_summary", OF.summary_sql)
def q_executive_summary(spark, sf_dir):
    return FD.executive_summary(_table(spark, sf_dir))


@register("brief", OF.brief_sql)
def q_brief(spark, sf_dir):
    return FD.brief(_table(spark, sf_dir))


@register("brief_audit", OF.brief_audit_sql)
def q_brief_audit(spark, sf_dir):
    return FD.brief_audit(_table(spark, sf_dir))


def per_segment(sql: str) -> str:
    """The query over each customer segment alone, stacked (DuckDB side)."""
    whole = "shipments AS (SELECT * FROM full_)"
    if whole not in sql:
        raise ValueError("the query does not read the shipments chain")
    return "\nUNION ALL\n".join(
        f"SELECT '{s}' AS customer_segment, q.* FROM ("
        + sql.replace(whole, f"shipments AS (SELECT * FROM full_ WHERE customer_segment = '{s}')") + ") q"
        for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))


@register("evidence_by_segment", lambda: per_segment(OF.evidence_sql()))
def q_evidence_by_segment(spark, sf_dir):
    return FD.evidence(_table(spark, sf_dir), by="customer_segment")


@register("summary_by_segment", lambda: per_segment(OF.summary_sql()))
def q_summary_by_segment(spark, sf_dir):
    return FD.executive_summary(_table(spark, sf_dir), by="customer_segment")


@register("brief_by_segment", lambda: per_segment(OF.brief_sql()))
def q_brief_by_segment(spark, sf_dir):
    return FD.brief(_table(spark, sf_dir), by="customer_segment")


@register("brief_audit_by_segment", lambda: per_segment(OF.brief_audit_sql()))
def q_brief_audit_by_segment(spark, sf_dir):
    return FD.brief_audit(_table(spark, sf_dir), by="customer_segment")


@register("formatted_carriers", OF.formatted_carriers_sql)
def q_formatted_carriers(spark, sf_dir):
    """The carrier detail table as the report shows it: grouped counts, exact
    money, one-decimal rates, compact spend, period in ISO weeks."""
    t = _table(spark, sf_dir)
    bc = FD.carrier_table(t)
    b = bc.crossJoin(F.broadcast(t.agg(F.min("ship_date").alias("_a"), F.max("ship_date").alias("_b"))))
    return b.select(
        "carrier", "row_pos",
        X.fmt_count("orders").alias("shipments"),
        X.fmt_group("spend", 0).alias("spend"),
        X.fmt_money("spend").alias("spend_compact"),
        X.fmt_money("penalties", exact=True).alias("penalties"),
        X.fmt_group("on_time_pct", 1).alias("on_time"),
        X.fmt_pct("on_time_pct").alias("on_time_pct"),
        X.fmt_ratio("spend / orders").alias("spend_per_shipment"),
        X.fmt_iso_range("_a", "_b").alias("period_iso"),
        X.fmt_week_range("_a", "_b").alias("period_weeks"),
        X.fmt_prose_range("_a", "_b").alias("period_prose"),
        X.fmt_month("_b").alias("last_month"),
    )
