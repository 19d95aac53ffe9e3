"""Recommendations: popular products that a user has not bought, from the user's favourite categories."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import null_safe_join, salted_join
from ..operators.keys import rank_within
from ..operators.ordering import nulls_last, top_per_group
from ..operators.storage import materialise

# What an event of each type says about interest; any other type counts 1.
WEIGHTS = {"purchase": 3, "cart": 2}

# Of all category keys, only the code may be NULL.
NULLABLE = ["category_code"]

# Ranks of a category that one window task looks at.
RANK_BLOCK = 10_000

OUTPUT = ["user_id", "category_code", "product_id", "brand", "price", "global_purchases"]


def interest(weights: dict[str, int] = WEIGHTS, default_weight: int = 1) -> Column:
    """The weight of an event."""
    cases = [(F.col("event_type") == kind, F.lit(weight)) for kind, weight in weights.items()]
    if not cases:
        return F.lit(default_weight)
    chain = reduce(lambda chain, case: chain.when(*case), cases[1:], F.when(*cases[0]))
    return chain.otherwise(default_weight)


def interactions(
    events: DataFrame, key: list[str] = (), weights: dict[str, int] = WEIGHTS, default_weight: int = 1
) -> DataFrame:
    """user_id, product_sk, the columns of ``key``, score and purchases: all that is needed of the events.

    It is written, as scores, popularity and purchased pairs are all read from it, and it is far
    smaller than the events, which are read and shuffled once.
    """
    purchases = F.count_if(F.col("event_type") == "purchase")
    grouped = events.groupBy("user_id", "product_sk", *key)
    return materialise(grouped.agg(F.sum(interest(weights, default_weight)).alias("score"), purchases.alias("purchases")), "interactions")


def product_popularity(events: DataFrame) -> DataFrame:
    """product_sk, buy_count for products bought at least once."""
    return events.filter(F.col("event_type") == "purchase").groupBy("product_sk").agg(F.count("*").alias("buy_count"))


def purchased_pairs(events: DataFrame) -> DataFrame:
    """Distinct (user_id, product_sk) of purchases."""
    return events.filter(F.col("event_type") == "purchase").select("user_id", "product_sk").distinct()


def category_affinity(
    events: DataFrame,
    products: DataFrame | None = None,
    key: list[str] = ("category_sk",),
    weights: dict[str, int] = WEIGHTS,
    default_weight: int = 1,
) -> DataFrame:
    """user_id, category key, cat_score.

    With ``products`` the category comes from them: scores are first summed per user and product,
    which leaves far fewer rows than events to join. Without, it is a column of the events.
    """
    weight = F.sum(interest(weights, default_weight)).alias("score")
    if products is None:
        return _affinity(events.groupBy("user_id", *key).agg(weight), None, key)
    return _affinity(events.groupBy("user_id", "product_sk").agg(weight), products, key)


def _affinity(scores: DataFrame, products: DataFrame | None, key: list[str]) -> DataFrame:
    if products is not None:
        scores = scores.join(products.select("product_sk", *key), "product_sk")
    return scores.groupBy("user_id", *key).agg(F.sum("score").alias("cat_score"))


def top_categories(affinity: DataFrame, key: list[str] = ("category_sk",), n: int = 3) -> DataFrame:
    """The ``n`` best categories of each user."""
    return top_per_group(affinity, ["user_id"], [F.desc("cat_score"), *nulls_last(*key)], n)


def rated_products(products: DataFrame, popularity: DataFrame) -> DataFrame:
    """Products with buy_count, 0 for those never bought."""
    return products.join(popularity, "product_sk", "left").withColumn("buy_count", F.coalesce("buy_count", F.lit(0)))


def top_products(rated: DataFrame, key: list[str] = ("category_sk",), n: int = 5) -> DataFrame:
    """The ``n`` most bought products of each category."""
    return top_per_group(rated, list(key), _by_popularity(), n)


def recommend(
    events: DataFrame,
    products: DataFrame,
    categories: DataFrame,
    weights: dict[str, int] = WEIGHTS,
    default_weight: int = 1,
    n_categories: int = 3,
    n_products: int = 5,
    exclusion: str = "after_rank",
    limit: int | None = 50,
    inline_category: bool = False,
) -> DataFrame:
    """Recommendations on the normalised model, or with ``inline_category`` on the denormalised one.

    ``exclusion="after_rank"`` takes the top products of a category and then leaves out those the
    user bought, so a user may get fewer than ``n_products``. ``"before_rank"`` leaves them out
    first and fills up with the next ones. ``limit=None`` gives every user's rows, unsorted.
    """
    key = ["category_sk"]
    done = interactions(events, key if inline_category else [], weights, default_weight)
    affinity = _affinity(done, None if inline_category else products, key)
    names = categories.select("category_sk", "category_code")
    return _recommend(affinity, products, names, done, key, n_categories, n_products, exclusion, limit)


def recommend_documents(
    events: DataFrame,
    products: DataFrame,
    weights: dict[str, int] = WEIGHTS,
    default_weight: int = 1,
    n_categories: int = 3,
    n_products: int = 5,
    exclusion: str = "before_rank",
    limit: int | None = 50,
) -> DataFrame:
    """The same on product documents; a category is its (category_id, category_code) pair."""
    key = ["category_id", "category_code"]
    flat = products.select(
        F.col("_id").alias("product_sk"), "product_id", "category.category_id", "category.category_code",
        "brand", "last_known_price",
    )
    done = interactions(events, [], weights, default_weight)
    return _recommend(_affinity(done, flat, key), flat, None, done, key, n_categories, n_products, exclusion, limit)


def recommend_graph(
    had_event: DataFrame,
    in_category: DataFrame,
    products: DataFrame,
    categories: DataFrame,
    weights: dict[str, int] = WEIGHTS,
    default_weight: int = 1,
    n_categories: int = 3,
    n_products: int = 5,
    exclusion: str = "before_rank",
    limit: int | None = 50,
) -> DataFrame:
    """The same on the graph: users had events on products, products are in categories."""
    events = had_event.select(F.col("src").alias("user_id"), F.col("dst").alias("product_sk"), "event_type")
    members = in_category.select(F.col("src").alias("product_sk"), F.col("dst").alias("category_sk"))
    key = ["category_sk"]
    done = interactions(events, [], weights, default_weight)
    affinity = _affinity(done, members, key)
    names = categories.select("category_sk", "category_code")
    return _recommend(
        affinity, products.join(members, "product_sk"), names, done, key, n_categories, n_products, exclusion, limit
    )


def _by_popularity() -> list[Column]:
    return [F.desc("buy_count"), F.asc("product_sk")]


def _recommend(
    affinity: DataFrame,
    products: DataFrame,
    names: DataFrame | None,
    done: DataFrame,
    key: list[str],
    n_categories: int,
    n_products: int,
    exclusion: str,
    limit: int | None,
) -> DataFrame:
    favourites = top_categories(affinity, key, n_categories)
    purchases = done.filter(F.col("purchases") > 0)
    rated = rated_products(products, purchases.groupBy("product_sk").agg(F.sum("purchases").alias("buy_count")))
    bought = purchases.select("user_id", "product_sk")
    if exclusion == "after_rank":
        # At most n_categories rows per user meet at most n_products rows per category.
        best = top_products(rated, key, n_products)
        if names is not None:
            best = best.join(names, key)
        offered = salted_join(favourites, best, key, "inner", ["user_id"], NULLABLE)
        picked = offered.join(bought, ["user_id", "product_sk"], "left_anti")
    elif exclusion == "before_rank":
        # Names come to the products, which are far fewer than the rows returned.
        named = rated if names is None else salted_join(rated, names, key, "inner", ["product_sk"])
        picked = _first_not_bought(favourites, named, bought, key, n_products)
    else:
        raise ValueError(f"unknown exclusion: {exclusion}")
    result = picked.withColumn("price", F.round(F.col("last_known_price"), 2)).withColumn(
        "global_purchases", F.col("buy_count").cast("bigint")
    )
    if limit is not None:
        result = result.orderBy("user_id", F.desc("cat_score"), F.desc("buy_count"), *nulls_last(*key), "product_sk").limit(limit)
    return result.select(*OUTPUT)


def _first_not_bought(favourites: DataFrame, rated: DataFrame, bought: DataFrame, key: list[str], n: int) -> DataFrame:
    """For each user and favourite category, the first ``n`` products by popularity not bought.

    Products are ranked within their category once. What the user bought there occupies some ranks,
    and the wanted products sit in the gaps between them. Each gap gives at most ``n`` ranks, which
    are then looked up. So no user is ever paired with a whole category: the rows made are the rows
    returned, plus one per purchased pair.
    """
    place = ["user_id", *key]
    block = [*place, "_block"]
    ranked = materialise(rank_within(rated, key, _by_popularity(), "_rank", NULLABLE), "ranked")
    taken = bought.join(ranked.select("product_sk", *key, "_rank"), "product_sk").select(*place, "_rank")
    # A mark behind the last rank closes the last gap.
    ends = favourites.select(*place, F.lit(2**62).alias("_rank"))
    marks = taken.unionByName(ends).withColumn("_block", F.floor(F.col("_rank") / RANK_BLOCK))
    # Windows see one block of ranks, so a user who bought a third of a category is many tasks. What a
    # block needs of those before it is its first neighbour and their number: one row per block.
    inside = Window.partitionBy(*block).orderBy("_rank")
    earlier = Window.partitionBy(*place).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        marks.groupBy(*block)
        .agg(F.max("_rank").alias("_last"), F.count("*").alias("_n"))
        .withColumn("_prior", F.coalesce(F.max("_last").over(earlier), F.lit(0)))
        .withColumn("_prior_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_last", "_n")
    )
    blocks = null_safe_join(blocks, favourites.select(*place, "cat_score"), place, "inner", NULLABLE)
    placed = marks.withColumn("_in", F.lag("_rank").over(inside)).withColumn("_number", F.row_number().over(inside))
    gaps = (
        null_safe_join(placed, blocks, block, "inner", NULLABLE)
        .withColumn("_before", F.coalesce("_in", "_prior"))
        # _free counts the ranks not bought up to _before.
        .withColumn("_free", F.col("_before") - F.col("_prior_n") - F.col("_number") + 1)
        .filter((F.col("_free") < n) & (F.col("_rank") > F.col("_before") + 1))
    )
    last = F.least(F.col("_rank") - 1, F.col("_before") + n - F.col("_free"))
    slots = gaps.select(*place, "cat_score", F.explode(F.sequence(F.col("_before") + 1, last)).alias("_rank"))
    return null_safe_join(slots, ranked, [*key, "_rank"], "inner", NULLABLE)
