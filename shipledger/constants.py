"""Business constants and reference vocabularies.

Everything in the "fixed values" blocks below must equal the values the
original dashboard uses, or results stop matching. They are stated plainly,
in their natural order, so a reader can check them at a glance. Every
function that consumes one of them accepts an override argument.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Business assumptions
# ---------------------------------------------------------------------------
LATE_PENALTY_EUR_PER_DAY = 45.0
FX_TO_EUR = {"EUR": 1.0, "USD": 0.92, "SEK": 0.087}
OUTLIER_IQR_MULTIPLIER = 3.0
OUTLIER_MIN_VALUES = 20
CENTRAL_EUROPE = ["DE", "AT", "CH", "PL", "CZ"]

# ---------------------------------------------------------------------------
# Carrier spelling variants (key = lower-case letters only)
# ---------------------------------------------------------------------------
CANONICAL_CARRIERS = {
    "nordfrakt": "Nordfrakt",
    "nordfraktab": "Nordfrakt",
    "meridianexpress": "Meridian Express",
    "meridianexpr": "Meridian Express",
    "vantagefreight": "Vantage Freight",
    "vantage": "Vantage Freight",
    "vantagefreightltd": "Vantage Freight",
    "balticalogistics": "Baltica Logistics",
    "baltica": "Baltica Logistics",
    "balticalog": "Baltica Logistics",
    "balticalogisticsas": "Baltica Logistics",
    "kestrelparcel": "Kestrel Parcel",
    "kestrelparcels": "Kestrel Parcel",
    "kestrelparcelsab": "Kestrel Parcel",
    "kestrel": "Kestrel Parcel",
    "hanseaticline": "Hanseatic Line",
    "hanseatic": "Hanseatic Line",
    "hanseaticlines": "Hanseatic Line",
}

# Fixed display order of carriers; unknown carriers sort after these.
CARRIER_ORDER = [
    "Nordfrakt",
    "Meridian Express",
    "Vantage Freight",
    "Baltica Logistics",
    "Kestrel Parcel",
    "Hanseatic Line",
]

# ---------------------------------------------------------------------------
# Header aliases (key = snake-cased header) -> canonical column
# ---------------------------------------------------------------------------
COLUMN_ALIASES = {
    "consignment_no": "order_id",
    "consignment": "order_id",
    "order_ref": "order_id",
    "shipment_id": "order_id",
    "awb": "order_id",
    "tracking_no": "order_id",
    "despatch_date": "ship_date",
    "dispatch_date": "ship_date",
    "shipped": "ship_date",
    "shipped_on": "ship_date",
    "date_shipped": "ship_date",
    "collection_date": "ship_date",
    "haulier": "carrier",
    "carrier_name": "carrier",
    "service_provider": "carrier",
    "collect_city": "origin_city",
    "collection_city": "origin_city",
    "collect_cc": "origin_country",
    "collect_country": "origin_country",
    "deliver_city": "destination_city",
    "delivery_city": "destination_city",
    "deliver_cc": "destination_country",
    "delivery_country": "destination_country",
    "dest_country": "destination_country",
    "service": "service_level",
    "service_type": "service_level",
    "account_type": "customer_segment",
    "segment": "customer_segment",
    "gross_weight_kg": "weight_kg",
    "weight": "weight_kg",
    "gross_weight": "weight_kg",
    "net_charge": "freight_cost",
    "charge": "freight_cost",
    "cost": "freight_cost",
    "freight_charge": "freight_cost",
    "ccy": "currency",
    "currency_code": "currency",
    "days_in_transit": "transit_days",
    "transit": "transit_days",
    "sla_days": "promised_days",
    "promised_transit_days": "promised_days",
    "consignment_status": "status",
    "shipment_status": "status",
}

REQUIRED_COLUMNS = [
    "order_id",
    "ship_date",
    "carrier",
    "origin_city",
    "origin_country",
    "destination_city",
    "destination_country",
    "service_level",
    "customer_segment",
    "weight_kg",
    "freight_cost",
    "currency",
    "transit_days",
    "promised_days",
    "status",
]

# Columns trimmed in the text step, in this order.
TEXT_COLUMNS = [
    "order_id",
    "carrier",
    "origin_city",
    "origin_country",
    "destination_city",
    "destination_country",
    "service_level",
    "customer_segment",
    "currency",
    "status",
]

# ---------------------------------------------------------------------------
# Strings a CSV reader treats as missing (the pandas defaults)
# ---------------------------------------------------------------------------
NULL_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# ---------------------------------------------------------------------------
# English month names, in order
# ---------------------------------------------------------------------------
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november",
          "december"]

# ---------------------------------------------------------------------------
# Analytics thresholds
# ---------------------------------------------------------------------------
MIN_LANE_SHIPMENTS = 8
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
WEEKDAYS_TESTED = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday"]
REGIONS = {
    "Central Europe": ["DE", "AT", "CH", "PL", "CZ"],
    "the Nordics": ["SE", "NO", "DK", "FI"],
    "Southern Europe": ["IT", "ES", "FR"],
}
PREVIOUS_DAY = {
    "Monday": "the Friday before",
    "Tuesday": "Monday",
    "Wednesday": "Tuesday",
    "Thursday": "Wednesday",
    "Friday": "Thursday",
}
MIN_UPLIFT_PCT = 12.0
MIN_LATE_GAP_PCT = 8.0
SEVERITY_THRESHOLDS = {"warning": 0.1, "serious": 0.3, "critical": 1.0}
WEAK_CARRIER_GAP_PTS = 10.0
MIN_PRIOR_SHIPMENTS = 20
SPARKLINE_WEEKS = 13
SPARKLINE_MIN_POINTS = 3
KPI_DEAD_BAND = 0.05

# Log texts (fixed wording of the cleaning log).
REMOVED_SURPLUS = "line has more fields than its header"
REMOVED_UNDATED = "ship_date missing or unparseable"
REMOVED_DUPLICATE = "duplicate order_id re-exported by source system"
