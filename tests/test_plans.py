"""What Spark makes of the jobs: pushed filters, group limits, join kinds, and split hot partitions."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from registry.queries import QUERIES
from tradewind.operators.embed import embed
from tradewind.plans import models
from tradewind.plans import recommend as recommend_plan
from tradewind.plans.campaigns import campaign_conversion
from tradewind.plans.dimensions import assign_keys
from tradewind.plans.models import both_directions
from tradewind.plans.recommend import product_popularity, recommend
from tradewind.plans.search import keyword_matches
from tradewind.plans.targeting import targeting_score
from tradewind.sources.testdata import view

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_compares_all_rows_with_all_rows(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "PythonUDF" not in text and "InPandas" not in text and "ArrowEval" not in text


def test_top_k_reports_never_sort_everything(spark):
    for name in ("campaign_conversion", "targeting_score", "recommend_top50"):
        assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, SF))


def test_groups_are_limited_before_the_shuffle(spark):
    for name in ("top_categories_per_user", "top_products_per_category", "search_token", "clean_messages", "clean_campaigns"):
        text = plan(QUERIES[name](spark, SF))
        assert text.count("WindowGroupLimit") >= 2 and "Partial" in text, name


def test_exclusion_is_an_anti_join(spark):
    assert "LeftAnti" in plan(QUERIES["recommend_after_rank"](spark, SF))


def test_messages_are_counted_before_the_join(spark):
    text = plan(campaign_conversion(view(spark, SF, "fx_messages"), view(spark, SF, "fx_campaigns")))
    assert text.index("Join") < text.index("partial_count(1)")


def test_stored_events_are_read_narrow_and_filtered(spark, tmp_path):
    path = str(tmp_path / "events")
    view(spark, SF, "fx_events").withColumn("product_sk", F.col("product_id")).write.parquet(path)
    df = product_popularity(spark.read.parquet(path))
    text = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    reads = [line for line in text.splitlines() if "ReadSchema" in line]
    assert reads and all("price" not in line and "brand" not in line for line in reads)
    assert "EqualTo(event_type,purchase)" in text


# ── hot keys: with joins forced to shuffle, a third of all rows under one key ───────────────────


@pytest.fixture
def shuffled(settings):
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="8k",
        spark__sql__adaptive__coalescePartitions__minPartitionSize="8k",
        spark__sql__shuffle__partitions="16",
    )


def split_joins(df, *keys: str) -> list:
    """Collect, and return the rows; the joins on the keys named must be salted or split by Spark."""
    result = df.collect()
    text = plan(df)
    final = text[: text.index("Initial Plan")]
    assert "isFinalPlan=true" in final
    joins = [line for line in final.splitlines() if "SortMergeJoin" in line]
    for key in keys:
        assert any(f"[{key}#" in j and ("_salt#" in j or "skew=true" in j) for j in joins), (key, joins)
    return result


def test_a_hub_among_friends_is_split(spark, shuffled):
    hub = [(0, i) for i in range(1, 40_000)]
    others = [(i, i + 1 + i % 7) for i in range(1, 80_000)]
    friendships = spark.createDataFrame(hub + others, "user_id_1 bigint, user_id_2 bigint").repartition(24)
    messages = spark.range(0, 80_000, 3).select(F.col("id").alias("user_id"), F.lit(True).alias("is_purchased"))
    got = split_joins(targeting_score(messages, None, friendships, k=None, buyer_from="messages"), "friend_id")
    want = Counter()
    for a, b in hub + others:
        want[a] += b % 3 == 0 and b < 80_000
        want[b] += a % 3 == 0 and a < 80_000
    assert {r.user_id: r.friend_purchasers for r in got} == {u: n for u, n in want.items() if n}


def test_a_hot_product_is_split(spark, shuffled):
    """A third of all events, each by another user, are on product 1."""
    events = spark.range(0, 120_000, 1, 24).select(
        (F.col("id") % 60_000).alias("user_id"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 5_000 + 2).alias("product_sk"),
        F.when(F.col("id") % 2 == 0, "purchase").otherwise("view").alias("event_type"),
    )
    products = spark.range(1, 5_003).select(
        F.col("id").alias("product_sk"), F.col("id").alias("product_id"), (F.col("id") % 400).alias("category_sk"),
        F.lit("b").alias("brand"), F.lit(1.0).alias("last_known_price"),
    )
    categories = spark.range(400).select(F.col("id").alias("category_sk"), F.col("id").cast("string").alias("category_code"))
    got = Counter(tuple(r) for r in split_joins(recommend(events, products, categories, limit=None), "product_sk", "category_sk"))
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        assert got == Counter(tuple(r) for r in recommend(events, products, categories, limit=None).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.skewJoin.enabled")


def test_events_of_a_hot_product_are_keyed(spark, shuffled):
    events = spark.range(0, 60_000, 1, 24).select(
        F.lit(dt.datetime(2019, 10, 1)).cast("timestamp_ntz").alias("event_time"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 3_000).alias("product_id"),
        F.lit(7).cast("bigint").alias("category_id"), F.lit(None).cast("string").alias("category_code"),
        F.lit("b").alias("brand"), F.col("id").cast("double").alias("price"),
    )
    categories, products, keyed = assign_keys(events)
    assert categories.count() == 1
    got = split_joins(keyed.select("product_id", "product_sk", "price"), "product_id")
    number = {p: i + 1 for i, p in enumerate(sorted({r.product_id for r in got}))}
    assert len(got) == 60_000 and all(r.product_sk == number[r.product_id] for r in got)
    # All events have the same time, so the last known price is the greatest one.
    assert products.count() == len(number) and products.filter("product_id = 1").first().last_known_price == 59_997.0


def test_a_hub_document_is_built_in_parts(spark, shuffled):
    pairs = spark.range(1, 30_000).select(F.lit(0).cast("bigint").alias("user_id_1"), F.col("id").alias("user_id_2")).repartition(24)
    docs = embed(both_directions(pairs), "user_id", F.col("friend_id"), "friends", F.col("friend_id"), parts=300)
    hub = [r.n for r in docs.select("user_id", F.size("friends").alias("n")).collect() if r.user_id == 0]
    assert sum(hub) == 29_999 and max(hub) < 200 and len(hub) == 300


def test_products_of_a_hot_category_are_ranked(spark, shuffled):
    """A third of all products are in category 0, and every user likes it."""
    products = spark.range(0, 30_000, 1, 24).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("category_sk"), F.col("id").alias("product_sk"),
        F.col("id").alias("product_id"), F.lit("b").alias("brand"), F.lit(1.0).alias("last_known_price"),
    )
    categories = spark.range(500).select(F.col("id").alias("category_sk"), F.col("id").cast("string").alias("category_code"))
    # User u bought the product 3u of category 0, which are ranked by their key, and viewed another.
    events = spark.range(0, 4_000, 1, 8).select(
        F.col("id").alias("user_id"), (F.col("id") * 3 % 30_000).alias("product_sk"), F.lit("purchase").alias("event_type")
    )
    got = recommend(events, products, categories, exclusion="before_rank", n_categories=1, limit=None)
    recommended = {}
    for r in split_joins(got.select("user_id", "product_id"), "category_sk"):
        recommended.setdefault(r.user_id, set()).add(r.product_id)
    best = [3 * i for i in range(6)]
    assert len(recommended) == 4_000
    assert all(found == {p for p in best if p != 3 * u} - ({15} if u > 4 else set()) for u, found in recommended.items() if u < 6)
    assert all(found == set(best[:5]) for u, found in recommended.items() if u >= 6)


def test_a_buyer_of_a_third_of_all_products(spark, shuffled, monkeypatch):
    """Their purchases in one category are looked at in blocks of ranks, with the same result."""
    monkeypatch.setattr(recommend_plan, "RANK_BLOCK", 50)
    products = spark.range(0, 3_000, 1, 8).select(
        F.lit(0).cast("bigint").alias("category_sk"), F.col("id").alias("product_sk"),
        F.col("id").alias("product_id"), F.lit("b").alias("brand"), F.lit(1.0).alias("last_known_price"),
    )
    categories = spark.sql("SELECT 0L AS category_sk, 'c' AS category_code")
    # User 0 bought 0..999 but for three, user 1 bought the last product only; popularity is equal but there.
    bought = spark.range(1_000).where("id NOT IN (7, 120, 998)").select(F.lit(0).cast("bigint").alias("user_id"), F.col("id").alias("product_sk"))
    events = bought.unionByName(spark.sql("SELECT 1L AS user_id, 2999L AS product_sk")).withColumn("event_type", F.lit("purchase"))
    got = recommend(events, products, categories, exclusion="before_rank", limit=None).collect()
    found = {u: sorted(r.product_id for r in got if r.user_id == u) for u in (0, 1)}
    # Bought products rank first: for user 0 all those are taken but 2999, then come the others by key.
    assert found == {0: [7, 120, 998, 1000, 2999], 1: [0, 1, 2, 3, 4]}


def test_recommendations_read_events_once(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.range(50).selectExpr("id % 5 AS user_id", "id % 9 AS product_sk", "'purchase' AS event_type").write.parquet(path)
    products = spark.range(9).selectExpr("id AS product_sk", "id AS product_id", "id % 2 AS category_sk", "'b' AS brand", "1.0D AS last_known_price")
    categories = spark.range(2).selectExpr("id AS category_sk", "'c' AS category_code")
    plan = recommend(spark.read.parquet(path), products, categories)._jdf.queryExecution().optimizedPlan().toString()
    assert path not in plan


def test_wide_events_keep_their_order_and_need_no_join(spark):
    from registry.queries import resolved_tables

    events = models.denormalised(resolved_tables(spark, "/root/testdata/sf0.001"))["events"]
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_keyword_lookup_has_no_pattern_per_keyword(spark):
    categories = spark.createDataFrame([(1, "Tools.Hard_Light")], "category_sk int, category_code string")
    found = keyword_matches(categories, [f"k{i}" for i in range(50)], "segment")
    assert "RLIKE" not in found._jdf.queryExecution().optimizedPlan().toString().upper()
