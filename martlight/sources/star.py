"""Adapter: the star-schema test tables under the canonical marketplace names.

Every derived column is an expression over the given tables, so the derived
tables grow with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlight.functions.columns import label_map
from martlight.session import tune
from martlight.sources.tables import Marketplace


def _minutes(column: Column) -> Column:
    zero = F.lit(0)
    return F.make_dt_interval(zero, zero, column.cast("int"))


def _days(column: Column | int) -> Column:
    column = F.lit(column) if isinstance(column, int) else column
    return F.make_dt_interval(column.cast("int"))


def load_star(spark: SparkSession, sf_dir: str) -> Marketplace:
    tune(spark)

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    nation = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nation = nation.select("n_nationkey", "n_name", "r_name")
    customer, orders, lines = read("customer"), read("orders"), read("lineitem")
    part, supplier = read("part"), read("supplier")

    placed = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    customers = placed.select(
        F.col("c_custkey").alias("customer_id"),
        F.expr("c_custkey div 2").alias("customer_unique_id"),
        (F.col("c_custkey") % 500).cast("int").alias("customer_zip_code_prefix"),
        F.col("n_name").alias("customer_city"),
        F.col("r_name").alias("customer_state"),
    )
    geolocation = placed.select(
        (F.col("c_custkey") % 500).cast("int").alias("geolocation_zip_code_prefix"),
        (F.col("c_nationkey") * 1.5 - 20).alias("geolocation_lat"),
        (F.col("c_nationkey") * 2.5 - 40).alias("geolocation_lng"),
        F.col("n_name").alias("geolocation_city"),
        F.col("r_name").alias("geolocation_state"),
    )
    return Marketplace(
        customers=customers,
        geolocation=geolocation,
        orders=_orders(orders, lines),
        order_items=_items(lines),
        order_payments=_payments(lines),
        order_reviews=_reviews(orders),
        products=_products(part),
        sellers=supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").alias("seller_id"),
            F.col("s_nationkey").alias("seller_zip_code_prefix"),
            F.col("n_name").alias("seller_city"),
            F.col("r_name").alias("seller_state"),
        ),
        category_translation=part.where(F.col("p_type") != "PROMO")
        .select(F.col("p_type").alias("product_category_name"))
        .distinct()
        .withColumn("product_category_name_english", F.lower("product_category_name")),
    )


def _orders(orders: DataFrame, lines: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    shipped = lines.groupBy("l_orderkey").agg(
        F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship")
    )
    purchase = F.col("o_orderdate") + _minutes(key * 37 % 1440)
    base = orders.withColumn("order_purchase_timestamp", purchase).join(
        shipped, key == F.col("l_orderkey"), "left"
    )
    arrived = F.col("o_orderstatus") != "P"
    return base.select(
        key.alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.when(key % 97 == 0, "canceled")
        .when(key % 89 == 0, "unavailable")
        .otherwise(label_map("o_orderstatus", {"F": "delivered", "O": "shipped", "P": "processing"}))
        .alias("order_status"),
        "order_purchase_timestamp",
        F.when(key % 50 != 0, F.col("order_purchase_timestamp") + _days(key % 3)).alias("order_approved_at"),
        F.col("first_ship").alias("order_delivered_carrier_date"),
        F.when(arrived, F.col("last_ship")).alias("order_delivered_customer_date"),
        (F.col("order_purchase_timestamp") + _days(key % 40 + 20)).alias("order_estimated_delivery_date"),
    )


def _items(lines: DataFrame) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    freight = F.round(price * F.col("l_tax").cast("decimal(4,2)"), 2).cast("decimal(12,2)")
    return lines.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        price.alias("price"),
        freight.alias("freight_value"),
    )


def _payments(lines: DataFrame) -> DataFrame:
    flag = F.col("l_returnflag")
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    return (
        lines.groupBy(F.col("l_orderkey").alias("order_id"), flag.alias("flag"))
        .agg(F.sum(price).alias("value"), F.count(F.lit(1)).alias("lines"))
        .select(
            "order_id",
            label_map("flag", {"A": F.lit(1), "N": F.lit(2), "R": F.lit(3)}).alias("payment_sequential"),
            label_map("flag", {"A": "credit_card", "N": "boleto", "R": "voucher"}).alias("payment_type"),
            F.col("lines").cast("int").alias("payment_installments"),
            F.col("value").cast("decimal(12,2)").alias("payment_value"),
        )
    )


def _reviews(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    purchase = F.col("o_orderdate") + _minutes(key * 37 % 1440)
    which = F.explode(F.sequence(F.lit(0), F.when(key % 17 == 0, 1).otherwise(0)))
    rows = orders.where(key % 10 != 0).withColumn("which", which)
    return rows.select(
        (key * 2 + F.col("which")).alias("review_id"),
        key.alias("order_id"),
        (F.lit(1) + (key * (F.lit(7) - F.col("which") * 4) + F.col("o_custkey")) % 5)
        .cast("int")
        .alias("review_score"),
        F.when(key % 4 == 0, F.concat(F.lit("order "), key.cast("string"))).alias("review_comment_title"),
        F.when(key % 3 == 0, F.col("o_orderpriority")).alias("review_comment_message"),
        (purchase + _days(10)).alias("review_creation_date"),
        (purchase + _days(12)).alias("review_answer_timestamp"),
    )


def _products(part: DataFrame) -> DataFrame:
    size = F.col("p_size")
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.when(size > 3, F.col("p_type")).alias("product_category_name"),
        F.length("p_name").alias("product_name_lenght"),
        (F.length("p_name") * 3 + F.length("p_brand")).alias("product_description_lenght"),
        F.when(size % 7 != 0, size % 5 + 1).alias("product_photos_qty"),
        (size * 10).cast("decimal(18,4)").alias("product_weight_g"),
        (size + 5).cast("decimal(18,4)").alias("product_length_cm"),
        (size * 0.5).cast("decimal(18,4)").alias("product_height_cm"),
        (size % 9 - 1).cast("decimal(18,4)").alias("product_width_cm"),
    )
