"""Rows that several test modules share (no test imports a conftest)."""

SMOKE = "/root/testdata/sf0.001"

COLS = ["order_id", "ship_date", "carrier", "origin_city", "origin_country", "destination_city",
        "destination_country", "service_level", "customer_segment", "weight_kg", "freight_cost", "currency",
        "transit_days", "promised_days", "status"]


def row(order_id, ship_date, carrier, oc, dc, service, cost, ccy, transit, promised, status, weight="10"):
    return (order_id, ship_date, carrier, "City", oc, "Town", dc, service, "retail", weight, cost, ccy, transit,
            promised, status)


# Hand-written export (file order = list order). Expected values are worked
# out by hand in test_clean.py.
FIXTURE = [
    row("A1", "2025-03-14", "Nordfrakt AB", "SE", "DE", "Standard", "100", "EUR", "2", "4", "Delivered"),
    row("A2", "14/03/2025", " Nordfrakt ", "SE", "DE", "standard", "100", "USD", "6", "4", "Delivered", "5"),
    row("A3", "Mar 14, 2025", "Baltica Logistics A/S", "SE", "DE", "Standard", "1000", "SEK", "4", "4",
        "IN TRANSIT", "0"),
    row("A4", "2025-03-14 00:00:00", "KESTREL PARCEL", "SE", "DE", "Standard", "50", "XYZ", "3", "4", "Delivered"),
    row("A5", "04/03/2025", "Hanseatic Lines", "SE", "DE", "Standard", "80", "EUR", "", "4", "Delivered"),
    row("A6", "03/14/2025", "Acme Road", "SE", "DE", "Standard", "60", "EUR", "-2", "4", "Delivered"),
    row("A7", "junk", "Nordfrakt", "SE", "DE", "Standard", "10", "EUR", "2", "4", "Delivered"),
    row("A8", "", "Nordfrakt", "SE", "DE", "Standard", "10", "EUR", "2", "4", "Delivered"),
    row("A1", "2025-03-15", "Nordfrakt", "SE", "DE", "Standard", "999", "EUR", "9", "4", "Delivered"),
    row("A9", "", "Nordfrakt", "SE", "DE", "Standard", "10", "EUR", "2", "4", "Delivered"),
    row("A9", "2025-03-16", "Nordfrakt", "SE", "DE", "Standard", "90", "EUR", "5", "4", "Delivered"),
    row(None, "2025-03-17", "Nordfrakt", "SE", "DE", "Standard", "70", "EUR", "2", "4", "Delivered"),
    row(None, "2025-03-18", "Nordfrakt", "SE", "DE", "Standard", "75", "EUR", "2", "4", "Delivered"),
    row("A10", "2025-03-18", "Nordfrakt", "SE", "NA", "next-day", "40", "EUR", "", "4", "CANCELLED"),
]
