"""Declared schemas of the web-shop tables and the company register.

``website_sessions`` and ``website_pageviews`` have declared DDL; the commerce tables are
typed from their use in the reports. Column order matters for CSV loads, which bind
columns by position.
"""

from __future__ import annotations

from pyspark.sql import types as T

WEBSITE_SESSIONS = T.StructType([
    T.StructField("website_session_id", T.LongType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("is_repeat_session", T.IntegerType()),
    T.StructField("utm_source", T.StringType()),
    T.StructField("utm_campaign", T.StringType()),
    T.StructField("utm_content", T.StringType()),
    T.StructField("device_type", T.StringType()),
    T.StructField("http_referer", T.StringType()),
])

WEBSITE_PAGEVIEWS = T.StructType([
    T.StructField("website_pageview_id", T.LongType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("website_session_id", T.LongType()),
    T.StructField("pageview_url", T.StringType()),
])

ORDERS = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("website_session_id", T.LongType()),
    T.StructField("primary_product_id", T.LongType()),
    T.StructField("price_usd", T.DecimalType(18, 2)),
])

PRODUCTS = T.StructType([
    T.StructField("product_id", T.LongType()),
    T.StructField("product_name", T.StringType()),
])

ORDER_ITEMS = T.StructType([
    T.StructField("order_item_id", T.StringType()),
    T.StructField("order_id", T.LongType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("price_usd", T.DecimalType(18, 2)),
])

ORDER_ITEM_REFUNDS = T.StructType([
    T.StructField("order_item_refund_id", T.StringType()),
    T.StructField("order_item_id", T.StringType()),
    T.StructField("order_id", T.LongType()),
    T.StructField("refund_amount_usd", T.DecimalType(18, 2)),
])

SHOP_SCHEMAS = {
    "website_sessions": WEBSITE_SESSIONS,
    "website_pageviews": WEBSITE_PAGEVIEWS,
    "orders": ORDERS,
    "products": PRODUCTS,
    "order_items": ORDER_ITEMS,
    "order_item_refunds": ORDER_ITEM_REFUNDS,
}

# Keys that the reports rely on: a session id counts once per session row, an order id belongs
# to one session. ``ingest_csv`` refuses a table that repeats them.
UNIQUE_KEYS = {
    "website_sessions": "website_session_id",
    "website_pageviews": "website_pageview_id",
    "orders": "order_id",
    "products": "product_id",
    "order_items": "order_item_id",
    "order_item_refunds": "order_item_refund_id",
}

# Dimension columns compared case-insensitively by the reports (MySQL's default collation).
# They are stored lower-case, so equality filters on them reach the Parquet scan.
CASE_INSENSITIVE_COLUMNS = {
    "website_sessions": ("utm_source", "utm_campaign", "utm_content", "device_type", "http_referer"),
    "website_pageviews": ("pageview_url",),
}

# The 17 columns of the company register, in file order.
REGISTER_COLUMNS = (
    "CORPORATE_IDENTIFICATION_NUMBER", "COMPANY_NAME", "COMPANY_STATUS", "COMPANY_CLASS",
    "COMPANY_CATEGORY", "COMPANY_SUB_CATEGORY", "DATE_OF_REGISTRATION", "REGISTERED_STATE",
    "AUTHORIZED_CAP", "PAIDUP_CAPITAL", "INDUSTRIAL_CLASS",
    "PRINCIPAL_BUSINESS_ACTIVITY_AS_PER_CIN", "REGISTERED_OFFICE_ADDRESS",
    "REGISTRAR_OF_COMPANIES", "EMAIL_ADDR", "LATEST_YEAR_ANNUAL_RETURN",
    "LATEST_YEAR_FINANCIAL_STATEMENT",
)
