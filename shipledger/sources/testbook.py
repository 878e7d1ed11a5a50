"""Adapter: the driver's TPC-H-style tables -> a raw, messy shipment export.

The driver data holds no shipments, so line items become shipments by integer
arithmetic on their keys. The rules are deterministic, so the same raw export
can be rebuilt in DuckDB for the oracle (``shipledger.plans.oracle``). Every
defect the cleaning must handle is planted: eight date layouts, missing and
junk dates, carrier spelling variants and an unknown carrier, padded cities,
upper-case statuses, currencies (including an unknown one), ten-fold costs,
missing costs and transit times, negative transit, zero weights, null ids and
re-exported duplicates ((l_orderkey, l_linenumber) repeats in the driver
data). A Friday delay is planted for one carrier into Central Europe.

Rules, with k = l_partkey, o = l_orderkey, s = l_suppkey, c = c_custkey:

| raw column | rule |
|---|---|
| order_id | null if k%1013=0 else 'ORD-' o '-' l_linenumber |
| ship_date | null if k%83=0; 'junk' if k%89=0; else by o%8: yyyy-MM-dd, dd/MM/yyyy, MMM dd, yyyy, yyyy-MM-dd HH:mm:ss, dd-MM-yyyy, yyyy-MM-dd'T'HH:mm:ss'Z', dd/MM/yyyy HH:mm, dd MMMM yyyy |
| carrier | 'Acme Road' if k%101=0; else entry 1+(s%6)*2+k%2 of CARRIER_SPELLINGS |
| origin_country / city | ORIGINS[s_nationkey%5] / the supplier nation's name |
| destination_country | DESTINATIONS[c%14]; destination_city c_name, space padded if k%17=0 |
| service_level, promised_days | SERVICES[l_linenumber%4] |
| customer_segment, weight_kg | c_mktsegment; '0' if k%107=0 else l_quantity |
| freight_cost | null if k%67=0; else round(price*0.002+18, 2) in decimal, x10 if k%199=0 |
| currency | 'XYZ' if k%103=0; else CURRENCIES[o%6] |
| transit_days | null if k%53=0; -3 if k%997=0; else 1+(7k+13s+o)%6, +3 when s%6=0, Friday and c%14<5 |
| status | CANCELLED if o%71=0; In Transit (IN TRANSIT when k even) if o%50=1; else Delivered |
| file order | (k, s, l_extendedprice, o, l_linenumber), then scan position |
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shipledger import constants as K
from shipledger.session import ensure_parallel

# ---------------------------------------------------------------------------
# Spelling pools of the adapter
# ---------------------------------------------------------------------------
CARRIER_SPELLINGS = [
    "Nordfrakt",
    "Nordfrakt AB",
    "Meridian Express",
    "MERIDIAN EXPRESS",
    "Vantage",
    "Vantage Freight Ltd",
    "baltica",
    " Baltica Logistics ",
    "Kestrel Parcels AB",
    "kestrel",
    "HANSEATIC",
    "Hanseatic Line",
]
ORIGINS = ["SE", "NL", "DE", "IT", "ES"]
DESTINATIONS = ["DE", "AT", "CH", "PL", "CZ", "SE", "NO", "DK", "FI", "NL", "FR", "ES", "IT", "GB"]
SERVICES = [("Express", "2"), ("Standard", "4"), ("STANDARD", "4"), ("Economy", "7")]
CURRENCIES = ["EUR", "EUR", "EUR", "USD", "SEK", "eur"]
SOURCE_NAME = "driver_tables"
TABLES = ["lineitem", "orders", "customer", "supplier", "nation"]

# ---------------------------------------------------------------------------
# The three source-system header vocabularies of the fixtures
# (canonical column -> header as exported)
# ---------------------------------------------------------------------------
VOCAB_WMS = {c: c for c in K.REQUIRED_COLUMNS}
VOCAB_TMS = {
    "order_id": "Order ID",
    "ship_date": "Ship Date",
    "carrier": "Carrier",
    "origin_city": "Origin City",
    "origin_country": "Origin Country",
    "destination_city": "Destination City",
    "destination_country": "Destination Country",
    "service_level": "Service Level",
    "customer_segment": "Customer Segment",
    "weight_kg": "Weight (kg)",
    "freight_cost": "Freight Cost",
    "currency": "Currency",
    "transit_days": "Transit Days",
    "promised_days": "Promised Days",
    "status": "Status",
}
VOCAB_BROKER = {
    "order_id": "CONSIGNMENT_NO",
    "ship_date": "DESPATCH_DATE",
    "carrier": "HAULIER",
    "origin_city": "COLLECT_CITY",
    "origin_country": "COLLECT_CC",
    "destination_city": "DELIVER_CITY",
    "destination_country": "DELIVER_CC",
    "service_level": "SERVICE",
    "customer_segment": "ACCOUNT_TYPE",
    "weight_kg": "GROSS_WEIGHT_KG",
    "freight_cost": "NET_CHARGE",
    "currency": "CCY",
    "transit_days": "DAYS_IN_TRANSIT",
    "promised_days": "SLA_DAYS",
    "status": "CONSIGNMENT_STATUS",
}
SPLIT_EXPORTS = [("wms_export.csv", VOCAB_WMS), ("tms_export.csv", VOCAB_TMS), ("parcel_broker_export.csv", VOCAB_BROKER)]


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw export (all strings) built from lineitem x orders x customer x
    supplier x nation."""
    return export_columns(shipment_lines(spark, sf_dir))


#: the columns of ``shipment_lines`` that give the file order
FILE_ORDER = ["l_partkey", "l_suppkey", "l_extendedprice", "l_orderkey", "l_linenumber", "_scan_pos"]


def shipment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a row of the raw export is made from, typed: narrow rows to be dealt or
    sorted. Joins are left to the optimiser: the two large inputs shuffle on the order
    key, the small dimensions broadcast by size. Customers come to the orders first, so
    that a large customer table does not shuffle the line items again."""
    li = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate",
        F.monotonically_increasing_id().alias("_scan_pos"),
    )
    li = ensure_parallel(li, "_scan_pos")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    supp = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    j = (
        li.join(orders.join(cust, F.col("o_custkey") == cust.c_custkey), li.l_orderkey == orders.o_orderkey)
        .join(supp, F.col("l_suppkey") == supp.s_suppkey)
        .join(nation, F.col("s_nationkey") == nation.n_nationkey, "left")
    )
    return j.select(*li.columns, "c_custkey", "c_name", "c_mktsegment", "s_nationkey", "n_name")


def export_columns(j: DataFrame) -> DataFrame:
    """The columns of the raw export from ``shipment_lines`` (rules: see above), row by row."""
    k, o, s, c = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_suppkey"), F.col("c_custkey")
    ts = F.col("l_shipdate")
    friday = F.weekday(ts) == 4
    svc = F.col("l_linenumber") % 4
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    cost = F.round(price * F.lit(0.002).cast("decimal(4,3)") + F.lit(18), 2)
    base_transit = F.lit(1) + (k * 7 + s * 13 + o) % 6
    planted = (s % 6 == 0) & friday & (c % 14 < 5)

    return j.select(
        F.when(k % 1013 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("ORD-"), o.cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")))
        .alias("order_id"),
        F.when(k % 83 == 0, F.lit(None).cast("string"))
        .when(k % 89 == 0, F.lit("junk"))
        .when(o % 8 == 0, F.date_format(ts, "yyyy-MM-dd"))
        .when(o % 8 == 1, F.date_format(ts, "dd/MM/yyyy"))
        .when(o % 8 == 2, F.date_format(ts, "MMM dd, yyyy"))
        .when(o % 8 == 3, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(o % 8 == 4, F.date_format(ts, "dd-MM-yyyy"))
        .when(o % 8 == 5, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(o % 8 == 6, F.date_format(ts, "dd/MM/yyyy HH:mm"))
        .otherwise(F.date_format(ts, "dd MMMM yyyy"))
        .alias("ship_date"),
        F.when(k % 101 == 0, F.lit("Acme Road")).otherwise(_pick(CARRIER_SPELLINGS, (s % 6) * 2 + k % 2)).alias("carrier"),
        F.col("n_name").alias("origin_city"),
        _pick(ORIGINS, F.col("s_nationkey") % 5).alias("origin_country"),
        F.when(k % 17 == 0, F.concat(F.lit("  "), F.col("c_name"), F.lit(" "))).otherwise(F.col("c_name")).alias(
            "destination_city"
        ),
        _pick(DESTINATIONS, c % 14).alias("destination_country"),
        _pick([n for n, _ in SERVICES], svc).alias("service_level"),
        F.col("c_mktsegment").alias("customer_segment"),
        F.when(k % 107 == 0, F.lit("0")).otherwise(F.col("l_quantity").cast("string")).alias("weight_kg"),
        F.when(k % 67 == 0, F.lit(None).cast("string"))
        .when(k % 199 == 0, (cost * 10).cast("string"))
        .otherwise(cost.cast("string"))
        .alias("freight_cost"),
        F.when(k % 103 == 0, F.lit("XYZ")).otherwise(_pick(CURRENCIES, o % 6)).alias("currency"),
        F.when(k % 53 == 0, F.lit(None).cast("string"))
        .when(k % 997 == 0, F.lit("-3"))
        .otherwise((base_transit + F.when(planted, 3).otherwise(0)).cast("string"))
        .alias("transit_days"),
        _pick([p for _, p in SERVICES], svc).alias("promised_days"),
        F.when(o % 71 == 0, F.lit("CANCELLED"))
        .when((o % 50 == 1) & (k % 2 == 0), F.lit("IN TRANSIT"))
        .when(o % 50 == 1, F.lit("In Transit"))
        .otherwise(F.lit("Delivered"))
        .alias("status"),
        F.lit(SOURCE_NAME).alias("source_file"),
        k.alias("_ord1"),
        s.alias("_ord2"),
        F.col("l_extendedprice").alias("_ord3"),
        o.alias("_ord4"),
        F.col("l_linenumber").alias("_ord5"),
        F.col("_scan_pos").alias("_ord6"),
    )


#: (system, header vocabulary, delimiter) of the exports that ``write_exports`` makes
SYSTEMS = [("wms", VOCAB_WMS, ","), ("tms", VOCAB_TMS, ";"), ("broker", VOCAB_BROKER, "|")]


def write_exports(spark: SparkSession, raw: DataFrame, top: str) -> list[tuple[str, str]]:
    """The raw export as CSV files of three systems (rows by ``_ord1 % 3``), one
    folder each: (system, path) of every file. Files are called ``export k.csv``
    in each folder, so names hold a space and repeat. The broker's cities hold
    doubled quotes, its delimiter and a line break."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for i, (system, vocab, sep) in enumerate(SYSTEMS):
        part = raw.filter(F.col("_ord1") % 3 == i)
        if system == "broker":
            part = part.withColumn("destination_city", F.concat(F.lit('He said "hi", |\n'),
                                                                F.col("destination_city")))
        (part.select(*[F.col(c).alias(vocab[c]) for c in K.REQUIRED_COLUMNS]).write
         .option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{top}/{system}"))
        folder = jvm.org.apache.hadoop.fs.Path(f"{top}/{system}")
        fs = folder.getFileSystem(conf)
        parts = sorted(st.getPath().toString() for st in fs.listStatus(folder) if st.getPath().getName().startswith("part-"))
        for k, path in enumerate(parts):
            to = jvm.org.apache.hadoop.fs.Path(folder, f"export {k}.csv")
            fs.rename(jvm.org.apache.hadoop.fs.Path(path), to)
            out.append((system, to.toString()))
    return out
