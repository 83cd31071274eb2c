"""Sales, product and refund reports.

Joins to ``products`` come last: the fact side (items, refunds) is first aggregated to one
row per product id, so the join and the final grouping by (id, name) work on product-sized
data. Grouping again after the join keeps the reference's results when a product id occurs
twice in ``products`` (each copy repeats the product's totals). Refund lines are a sizeable
share of item lines at scale, so those joins stay shuffle joins (AQE broadcasts them at
runtime when a measured side is small).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.functions.semantics import DAY, period_key


def sales_by_day_hour(orders: DataFrame) -> DataFrame:
    """Orders and revenue per calendar day and hour of day."""
    return (orders.select(period_key("created_at", DAY).alias("order_date"),
                          F.hour("created_at").cast("int").alias("order_hour"),
                          "order_id", "price_usd")
            .groupBy("order_date", "order_hour")
            .agg(F.count("order_id").alias("total_orders"),
                 F.sum("price_usd").cast("double").alias("total_revenue")))


def product_sales(products: DataFrame, items: DataFrame) -> DataFrame:
    """``products JOIN order_items``: line count (``COUNT(oi.order_id)``) and revenue per product."""
    per_product = items.groupBy("product_id").agg(
        F.count("order_id").alias("n"), F.sum("price_usd").alias("rev"))
    return (products.select("product_id", "product_name").join(per_product, "product_id")
            .groupBy("product_id", "product_name")
            .agg(F.sum("n").cast("bigint").alias("total_orders"),
                 F.sum("rev").cast("double").alias("total_revenue")))


def product_refunds(refunds: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """``refunds JOIN order_items JOIN products``: refund count and amount per product."""
    # One row per refunded item first: a hot item costs one row per task in the join.
    per_item = refunds.groupBy("order_item_id").agg(
        F.count("order_item_refund_id").alias("n"), F.sum("refund_amount_usd").alias("amt"))
    per_product = (items.select("order_item_id", "product_id").join(per_item, "order_item_id")
                   .groupBy("product_id").agg(F.sum("n").alias("n"), F.sum("amt").alias("amt")))
    return (per_product.join(products.select("product_id", "product_name"), "product_id")
            .groupBy("product_id", "product_name")
            .agg(F.sum("n").cast("bigint").alias("total_refunds"),
                 F.sum("amt").cast("double").alias("total_refund_amount")))


def product_success(orders: DataFrame, refunds: DataFrame, products: DataFrame, *,
                    decimals: int = 1) -> DataFrame:
    """Revenue and refunds per primary product of refunded orders.

    Same rows as ``orders JOIN refunds ON order_id JOIN products ON primary_product_id``:
    only refunded orders count, an order's price repeats once per refund row and refunds of
    other products in the order are charged to the primary product. Refunds are reduced to
    one row per order first, so the price repetition is a multiplication, not a fan-out.
    """
    per_order = refunds.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_refund_rows"), F.sum("refund_amount_usd").alias("refund"))
    per_product = (orders.select("order_id", "primary_product_id", "price_usd")
                   .join(per_order, "order_id")
                   .groupBy("primary_product_id")
                   .agg(F.sum(F.col("price_usd") * F.col("n_refund_rows")).alias("rev"),
                        F.sum("refund").alias("ref")))
    named = per_product.join(products.select("product_id", "product_name"),
                             per_product.primary_product_id == F.col("product_id"))
    return (named.groupBy("product_name")
            .agg(F.round(F.sum("rev"), decimals).cast("double").alias("total_revenue"),
                 F.round(F.sum("ref"), decimals).cast("double").alias("total_refund_amount")))
