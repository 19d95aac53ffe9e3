"""Tables derived from the cleaned ones: clients, users, and versioned categories and products."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.integrity import keep_known
from ..operators.joins import null_safe_join
from ..operators.keys import dense_keys
from ..operators.ordering import keep_one, nulls_last
from ..operators.quality import union_all
from ..operators.storage import materialise

CLIENT = ["client_id", "user_id", "user_device_id"]


def build_clients(messages: DataFrame, first_purchases: DataFrame) -> DataFrame:
    """One row per client of either source; a row with a first purchase date wins over a recipient row.

    Recipients are reduced to distinct rows first, so a client with very many messages costs nothing extra.
    """
    recipients = messages.select(*CLIENT).dropna(subset=["client_id"]).distinct()
    both = first_purchases.withColumn("_source", F.lit(0)).unionByName(
        recipients.withColumn("_source", F.lit(1)), allowMissingColumns=True
    )
    order = nulls_last("_source", "first_purchase_date", "user_id", "user_device_id")
    return keep_one(both, ["client_id"], order).select(*CLIENT, "first_purchase_date")


def build_users(events: DataFrame, clients: DataFrame, friends: DataFrame) -> DataFrame:
    """Every user id of events, clients and friendships, once. Message users are not a source."""
    ids = [
        events.select("user_id"),
        clients.select("user_id"),
        friends.select(F.col("friend1").alias("user_id")),
        friends.select(F.col("friend2").alias("user_id")),
    ]
    return union_all(ids).dropna().distinct()


def enforce_campaigns(messages: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Messages whose (campaign_id, message_type) is a known campaign."""
    return keep_known(messages, ["campaign_id", "message_type"], campaigns, ["id", "campaign_type"])


def _last_known(column: str) -> Column:
    """Latest value that is not NULL, by event time; among equal times the greatest value."""
    latest = F.when(F.col(column).isNotNull(), F.struct("event_time", column))
    return F.max_by(F.col(column), latest)


def assign_keys(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(categories, products, events with product_sk and category_sk).

    A product has one version per category it appeared under, and each event points to the version
    with its own category values, so it keeps the category it had when it happened. A missing
    category code is a value like any other.
    """
    category = ["category_id", "category_code"]
    # The number of a category stands for its id and code, which are small tables' worth of text on very many events:
    # what is grouped, joined and sorted below is narrow. Numbers follow the order of id and code.
    categories = dense_keys(events.select(*category).distinct(), nulls_last(*category), "category_sk")
    numbers = categories.select(*category, F.col("category_sk").alias("_category"))
    coded = null_safe_join(events, numbers, category, "left", category).drop(*category)
    version = ["product_id", "_category"]
    # The versions are written once: the events are read for them, and then for the keys only.
    latest = materialise(
        coded.groupBy(*version).agg(_last_known("brand").alias("brand"), _last_known("price").alias("last_known_price")),
        "versions",
    )
    # A category without an id is numbered, but it is no one's category.
    known = numbers.select("_category", F.when(F.col("category_id").isNotNull(), F.col("_category")).alias("category_sk"))
    versions = dense_keys(latest.join(known, "_category", "left"), nulls_last(*version), "product_sk")
    products = versions.select("product_sk", "product_id", "category_sk", "brand", "last_known_price")
    found = versions.dropna(subset=["category_sk"]).select(*version, "product_sk", "category_sk")
    keyed = coded.join(found, version, "left").join(numbers, "_category", "left")
    return categories, products, keyed.select(*events.columns, "product_sk", "category_sk")
