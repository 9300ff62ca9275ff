import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from datawright.functions.cells import MIXED


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.autoBroadcastJoinThreshold", "1m").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def mixed_cell(v):
    if v is None:
        return ("missing", None, None, None)
    if isinstance(v, dt.datetime):
        return ("datetime", None, None, v)
    if isinstance(v, str):
        x = v.strip().replace(",", "")
        form = "string"
        if x.replace(".", "", 1).isdigit():
            form = "formatted-numeric-string" if "," in v else "numeric-string"
        return (form, v, None, None)
    return ("float", None, float(v), None)


INVOICE = T.StructType([
    T.StructField("invoice_id", T.StringType()), T.StructField("invoice_date", MIXED), T.StructField("payment_date", T.TimestampType()), T.StructField("country", T.StringType()), T.StructField("city", T.StringType()), T.StructField("sector", T.StringType()),
    T.StructField("quantity", T.IntegerType()), T.StructField("unit_price", MIXED), T.StructField("discount_pct", T.DoubleType()), T.StructField("tax_pct", T.DoubleType()), T.StructField("invoice_amount", T.DoubleType()), T.StructField("payment_amount", T.DoubleType()),
    T.StructField("currency", T.StringType()), T.StructField("payment_method", T.StringType()), T.StructField("status", T.StringType()), T.StructField("employee_count", T.IntegerType()), T.StructField("annual_revenue", MIXED), T.StructField("reported_profit", T.DoubleType()),
    T.StructField("customer_rating", T.DoubleType()), T.StructField("sales_channel", T.StringType()), T.StructField("__row_id", T.LongType()),
])


def invoice_rows():
    """40 rows with planted defects; each plant is named at its line."""
    places = [("Algeria", "Oran", "DZD"), ("Morocco", "Rabat", "MAD"), ("Tunisia", "Tunis", "TND"), ("France", "Paris", "EUR")]
    rows = []
    for k in range(40):
        country, city, currency = places[k % 4]
        price, quantity = 100.0 + k, 1 + k % 5
        amount = round(quantity * price * 0.9 * 1.2, 2)
        rows.append({
            "invoice_id": f"INV-2024-{k:05d}", "invoice_date": dt.datetime(2024, 1 + k % 12, 1 + k % 27), "payment_date": dt.datetime(2024, 12, 1), "country": country, "city": city, "sector": ["ICT", "Retail", "Health"][k % 3], "quantity": quantity, "unit_price": price, "discount_pct": 0.1,
            "tax_pct": 0.2, "invoice_amount": amount, "payment_amount": amount, "currency": currency, "payment_method": ["Card", "Cash"][k % 2], "status": "Paid", "employee_count": 50 + k, "annual_revenue": 1e6 + k, "reported_profit": 1e5, "customer_rating": 3.0 + (k % 3) / 2, "sales_channel": "Web",
        })
    for k, v in {0: "31/02/2024", 1: "2024-13-45", 2: "05/06/2024", 3: "12/25/2024", 4: "25/12/2024", 5: "14/03/2024", 6: "20/07/2024"}.items():
        rows[k]["invoice_date"] = v  # 2 impossible, 1 ambiguous, 1 month first against day first, 3 day first
    rows[8]["invoice_id"] = "INV-2019-00008"  # year differs from the date's
    rows[8]["country"], rows[9]["country"], rows[13]["country"] = "ALGERIA", " morocco", "MAROC"
    rows[12]["city"], rows[16]["city"] = "Casablanca", "Fez"  # Algeria with Moroccan cities
    rows[20]["city"] = "Atlantis"
    rows[36]["city"] = None
    rows[11]["sector"] = "Rеtail"  # a Cyrillic letter
    rows[14]["quantity"], rows[15]["quantity"] = -2, 0
    rows[17]["unit_price"], rows[18]["unit_price"] = "1,200.50", "340"
    for k in (14, 15, 17, 18):
        price = float(str(rows[k]["unit_price"]).replace(",", ""))
        rows[k]["invoice_amount"] = rows[k]["payment_amount"] = round(rows[k]["quantity"] * price * 0.9 * 1.2, 2)
    for k in (21, 22, 23):
        rows[k]["invoice_amount"] += 50.0  # breaks the formula
        rows[k]["payment_amount"] += 50.0
    rows[24]["status"], rows[25]["status"] = "Pending", "Overdue"
    for k in (24, 25):
        rows[k]["payment_date"] = rows[k]["payment_amount"] = None  # rightly absent
    rows[26]["payment_date"] = None  # paid without a date
    rows[27]["payment_amount"] -= 10.0  # paid, but not in full
    rows[28]["currency"] = "USD"
    rows[29]["employee_count"] = rows[30]["employee_count"] = 999_999
    rows[31]["annual_revenue"] = "486,849"
    rows[32]["reported_profit"] = 2e6
    rows[33]["customer_rating"] = 9.9
    exact, conflict = dict(rows[34]), dict(rows[35])
    conflict["payment_method"] = "Wire"
    return [*rows, exact, conflict]


@pytest.fixture(scope="session")
def invoices(spark):
    made = []
    for k, r in enumerate(invoice_rows()):
        made.append(tuple(mixed_cell(r[f.name]) if f.dataType == MIXED else k if f.name == "__row_id" else r[f.name] for f in INVOICE))
    return spark.createDataFrame(made, INVOICE).cache()


CONTEXT = dict(identifier="invoice_id", key="invoice_id", compare_to="invoice_date", date_columns=("invoice_date",), categorical=("country", "city", "sector", "payment_method", "currency", "status", "sales_channel"))


@pytest.fixture(scope="session")
def scanned(invoices):
    from datawright.plans.scan import scan

    return scan(invoices, **CONTEXT)
