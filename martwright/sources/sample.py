"""Canonical raw tables derived from the generic sales sample tables.

The sample has orders, lines, customers and events but no payments, reviews,
geography, leads or deals. Every missing column is worked out by plain arithmetic on
the keys of the whole source table, so that it can be restated in any SQL engine. The
rules deliberately leave some rows without a partner (orders without payment, zips
without geography, deals without lead) because the models are built on outer joins.
Ids stay BIGINT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the sample tables; naming them saves a pass over the file footers.
SAMPLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# The geography list, entry z % 25 for zip z.
GEO_STATES = (
    "rj sp es mg pr sc rs go df am rr ap pa to ac ce rn pe al se ba pi ma mt ro".split()
)
GEO_CITIES = [
    "rio de janeiro",
    "são paulo",
    "vitória",
    "belo horizonte",
    "curitiba",
    "joinville",
    "porto alegre",
    "goiânia",
    "brasília",
    "manaus",
    "boa vista",
    "macapá",
    "belém",
    "palmas",
    "rio branco",
    "fortaleza",
    "natal",
    "recife",
    "maceió",
    "aracaju",
    "salvador",
    "teresina",
    "são luís",
    "cuiabá",
    "porto velho",
]
PAYMENT_TYPES = ["credit_card", "boleto", "debit_card", "voucher"]
LEAD_ORIGINS = ["organic_search", "paid_search", "social", "email", "referral"]
LEAD_TYPES = [
    "online_beginner",
    "online_small",
    "online_medium",
    "online_big",
    "online_top",
    "offline",
    "industry",
    "other",
]


_BUILDERS = {
    "raw_orders": "orders",
    "raw_order_items": "order_items",
    "raw_order_payments": "order_payments",
    "raw_order_reviews": "order_reviews",
    "raw_customers": "customers",
    "raw_geolocation": "geolocation",
    "raw_products": "products",
    "raw_category_translation": "category_translation",
    "raw_sellers": "sellers",
    "raw_marketing_qualified_leads": "leads",
    "raw_closed_deals": "closed_deals",
}


def _pick(values: list[str], index: Column) -> Column:
    """Entry ``index`` (from 0) of a fixed list, NULL past its end."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _after(ts: Column, days: object = 0, hours: object = 0, minutes: object = 0) -> Column:
    parts = [p if isinstance(p, Column) else F.lit(p) for p in (days, hours, minutes)]
    return ts + F.make_dt_interval(*[p.cast("int") for p in parts])


def _cents(value: Column) -> Column:
    return F.round(value.cast("decimal(38,10)"), 2).cast("decimal(18,2)")


class SampleTables:
    """The sample tables of one folder, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._tables: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        if name not in self._tables:
            reader = self.spark.read
            if name in SAMPLE_SCHEMAS:
                reader = reader.schema(SAMPLE_SCHEMAS[name])
            self._tables[name] = reader.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    def raw(self, name: str) -> DataFrame:
        """A canonical raw table by name."""
        return getattr(self, _BUILDERS[name])()

    def orders(self) -> DataFrame:
        key, day = F.col("o_orderkey"), F.col("o_orderdate")
        status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
        purchase = _after(day, minutes=key % 1440)
        return self.read("orders").select(
            key.alias("order_id"),
            key.alias("customer_id"),
            F.when(status == "F", "delivered")
            .when(status == "O", "shipped")
            .when(priority == "1-URGENT", "canceled")
            .when(priority == "2-HIGH", "unavailable")
            .otherwise("processing")
            .alias("order_status"),
            purchase.alias("order_purchase_timestamp"),
            F.when(key % 41 != 0, _after(purchase, hours=key % 48)).alias("order_approved_at"),
            F.when(status != "P", _after(day, hours=24 + key * 5 % 150)).alias(
                "order_delivered_carrier_date"
            ),
            F.when(status == "F", _after(day, hours=72 + key * 7 % 600)).alias(
                "order_delivered_customer_date"
            ),
            _after(day, days=20).alias("order_estimated_delivery_date"),
        )

    def order_items(self) -> DataFrame:
        price = _cents(F.col("l_extendedprice") / 2000)
        freight = F.round(price * F.col("l_tax").cast("decimal(4,2)"), 2)
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_shipdate").alias("shipping_limit_date"),
            price.alias("price"),
            freight.cast("decimal(18,2)").alias("freight_value"),
        )

    def order_payments(self) -> DataFrame:
        key = F.col("o_orderkey")
        main = F.struct(
            F.lit(1).alias("payment_sequential"),
            _pick(PAYMENT_TYPES, key % 4).alias("payment_type"),
            (key % 11).cast("int").alias("payment_installments"),
            _cents(F.col("o_totalprice") / 2000).alias("payment_value"),
        )
        second = F.struct(
            F.lit(2).alias("payment_sequential"),
            F.lit("voucher").alias("payment_type"),
            F.lit(1).alias("payment_installments"),
            F.lit("25.00").cast("decimal(18,2)").alias("payment_value"),
        )
        return (
            self.read("orders")
            .select(
                key.alias("order_id"),
                F.explode(
                    F.array_compact(
                        F.array(F.when(key % 113 != 0, main), F.when(key % 5 == 0, second))
                    )
                ).alias("p"),
            )
            .select("order_id", "p.*")
        )

    def order_reviews(self) -> DataFrame:
        key = F.col("o_orderkey")
        digit = key * 7 % 10
        first = F.struct(
            (key * 10).alias("review_id"),
            key.alias("doc_id"),
            F.when(digit < 5, 5)
            .when(digit == 5, 4)
            .otherwise(digit - 5)
            .cast("int")
            .alias("review_score"),
            F.lit(25).alias("wait_days"),
        )
        second = F.struct(
            (key * 10 + 1).alias("review_id"),
            F.lit(None).cast("long").alias("doc_id"),
            (1 + key % 5).cast("int").alias("review_score"),
            F.lit(30).alias("wait_days"),
        )
        reviews = (
            self.read("orders")
            .select(
                key.alias("order_id"),
                "o_orderdate",
                F.explode(
                    F.array_compact(
                        F.array(F.when(key % 10 != 3, first), F.when(key % 50 == 0, second))
                    )
                ).alias("r"),
            )
            .select("order_id", "o_orderdate", "r.*")
        )
        messages = self.read("documents").select("doc_id", "text")
        created = _after(F.col("o_orderdate"), days=F.col("wait_days"))
        return reviews.join(messages, "doc_id", "left").select(
            "review_id",
            "order_id",
            "review_score",
            F.lit(None).cast("string").alias("review_comment_title"),
            F.col("text").alias("review_comment_message"),
            created.alias("review_creation_date"),
            _after(created, days=2).alias("review_answer_timestamp"),
        )

    def _nations(self) -> DataFrame:
        return (
            self.read("nation")
            .join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                "n_nationkey",
                F.lower("n_name").alias("city"),
                F.lower(F.substring("r_name", 1, 2)).alias("state"),
            )
        )

    def customers(self) -> DataFrame:
        people = self.read("customer").join(
            self._nations(), F.col("c_nationkey") == F.col("n_nationkey")
        )
        return (
            self.read("orders")
            .where(F.col("o_orderkey") % 97 != 0)
            .join(people, F.col("o_custkey") == F.col("c_custkey"))
            .select(
                F.col("o_orderkey").alias("customer_id"),
                F.col("o_custkey").alias("customer_unique_id"),
                (F.col("c_custkey") % 200).cast("int").alias("customer_zip_code_prefix"),
                F.col("city").alias("customer_city"),
                F.col("state").alias("customer_state"),
            )
        )

    def geolocation(self) -> DataFrame:
        zip_code = F.col("zip")
        return (
            self.read("customer")
            .select((F.col("c_custkey") % 200).cast("int").alias("zip"))
            .where(zip_code < 190)
            .distinct()
            .select(
                zip_code.alias("geolocation_zip_code_prefix"),
                _pick(GEO_CITIES, zip_code % 25).alias("geolocation_city"),
                _pick(GEO_STATES, zip_code % 25).alias("geolocation_state"),
            )
        )

    def products(self) -> DataFrame:
        size = F.col("p_size")
        return self.read("part").select(
            F.col("p_partkey").alias("product_id"),
            F.concat(F.lower("p_type"), F.lit("_goods")).alias("product_category_name"),
            F.length("p_name").alias("product_name_lenght"),
            (size * 20).alias("product_description_lenght"),
            (F.col("p_partkey") % 7).cast("int").alias("product_photos_qty"),
            (size * 100).alias("product_weight_g"),
            (size + 10).alias("product_length_cm"),
            (size + 5).alias("product_height_cm"),
            (size + 8).alias("product_width_cm"),
        )

    def category_translation(self) -> DataFrame:
        kind = F.lower("p_type")
        return (
            self.read("part")
            .select(kind.alias("kind"))
            .where(F.col("kind") != "promo")
            .distinct()
            .select(
                F.concat("kind", F.lit("_goods")).alias("product_category_name"),
                F.concat(F.lit("eng_"), "kind").alias("product_category_name_english"),
            )
        )

    def sellers(self) -> DataFrame:
        return (
            self.read("supplier")
            .join(self._nations(), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("s_suppkey").alias("seller_id"),
                (F.col("s_suppkey") % 200).cast("int").alias("seller_zip_code_prefix"),
                F.col("city").alias("seller_city"),
                F.col("state").alias("seller_state"),
            )
        )

    def leads(self) -> DataFrame:
        return (
            self.read("events")
            .where(F.col("event_type") == "signup")
            .select(
                F.col("event_id").alias("mql_id"),
                F.col("ts").cast("date").alias("first_contact_date"),
                F.col("user_id").alias("landing_page_id"),
                _pick(LEAD_ORIGINS, F.col("event_id") % 6).alias("origin"),
            )
        )

    def closed_deals(self) -> DataFrame:
        key, kind = F.col("event_id"), F.col("event_type")
        seller_count = self.read("supplier").agg(F.count("*")).scalar()
        won = _after(F.col("ts"), days=key % 120)
        return (
            self.read("events")
            .where(
                ((kind == "signup") & (key % 5 == 0)) | ((kind == "error") & (key % 40 == 0))
            )
            .select(
                key.alias("mql_id"),
                (F.col("user_id") % seller_count).alias("seller_id"),
                (key % 7).alias("sdr_id"),
                (key % 5).alias("sr_id"),
                F.when(key % 4 == 0, F.date_format(won, "yyyy-MM-dd HH:mm:ss"))
                .when(key % 4 == 1, F.date_format(won, "M/d/yyyy H:mm"))
                .when(key % 4 == 2, F.date_format(won, "yyyy-MM-dd"))
                .otherwise("")
                .alias("won_date"),
                F.when(key % 2 == 0, "home_decor").otherwise("pet").alias("business_segment"),
                _pick(LEAD_TYPES, key % 9).alias("lead_type"),
                F.when(key % 2 == 0, "cat")
                .otherwise("wolf, shark")
                .alias("lead_behaviour_profile"),
                (key % 3 == 0).alias("has_company"),
                (key % 2 == 0).alias("has_gtin"),
                F.lit("5-20").alias("average_stock"),
                F.when(key % 2 == 0, "reseller").otherwise("manufacturer").alias("business_type"),
                (key % 300).cast("double").alias("declared_product_catalog_size"),
                F.when(key % 8 == 0, 0)
                .otherwise(F.round((F.col("value") * 1000).cast("decimal(38,10)"), 0))
                .cast("decimal(18,2)")
                .alias("declared_monthly_revenue"),
            )
        )
