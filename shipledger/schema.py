"""The processed shipment table: column order and Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

ORDER_PREFIX = "_ord"

_S, _D, _I, _B = T.StringType(), T.DateType(), T.IntegerType(), T.BooleanType()
_M = T.DecimalType(18, 2)

SHIPMENT_SCHEMA = T.StructType(
    [
        T.StructField("order_id", _S),
        T.StructField("ship_date", _D, False),
        T.StructField("carrier", _S),
        T.StructField("origin_city", _S),
        T.StructField("origin_country", _S),
        T.StructField("destination_city", _S),
        T.StructField("destination_country", _S),
        T.StructField("service_level", _S),
        T.StructField("customer_segment", _S),
        T.StructField("weight_kg", T.DoubleType()),
        T.StructField("freight_cost", T.DecimalType(24, 6)),
        T.StructField("currency", _S),
        T.StructField("transit_days", _I),
        T.StructField("promised_days", _I),
        T.StructField("status", _S),
        T.StructField("source_file", _S),
        T.StructField("freight_cost_eur", _M),
        T.StructField("cost_is_outlier", _B, False),
        T.StructField("lane", _S),
        T.StructField("transit_days_imputed", _B, False),
        T.StructField("cost_is_imputed", _B, False),
        T.StructField("is_cancelled", _B, False),
        T.StructField("delay_days", _I, False),
        T.StructField("is_late", _B, False),
        T.StructField("is_on_time", _B, False),
        T.StructField("late_penalty_eur", _M),
        T.StructField("delivery_date", _D),
        T.StructField("ship_weekday", _S),
        T.StructField("ship_week", _D),
        T.StructField("ship_month", _D),
        T.StructField("is_central_europe", _B, False),
        T.StructField("cost_per_kg", _M),
        T.StructField("is_billable", _B, False),
    ]
)

SHIPMENT_COLUMNS = [f.name for f in SHIPMENT_SCHEMA.fields]

FLAG_COLUMNS = [
    "is_cancelled",
    "is_late",
    "is_on_time",
    "is_billable",
    "cost_is_outlier",
    "cost_is_imputed",
    "transit_days_imputed",
    "is_central_europe",
]
