"""Each registered query: (spark, folder of test tables) to a DataFrame over those whole tables."""

import uuid
from collections.abc import Callable
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.operators.constraints import violations
from tradewind.operators.fingerprint import consistency
from tradewind.operators.integrity import keep_known
from tradewind.operators.quality import null_counts, row_counts, union_all
from tradewind.operators.storage import materialise, shared_folder
from tradewind.plans import models
from tradewind.plans.campaigns import campaign_conversion, campaign_conversion_documents, campaign_conversion_graph
from tradewind.plans.clean import CLEANERS, clean_and_audit, clean_campaigns, clean_events, clean_first_purchases, clean_friends, clean_messages
from tradewind.plans.dimensions import assign_keys, build_clients, build_users, enforce_campaigns
from tradewind.plans.recommend import (
    category_affinity,
    product_popularity,
    rated_products,
    recommend,
    recommend_documents,
    recommend_graph,
    top_categories,
    top_products,
)
from tradewind.plans.search import search, search_documents, search_graph
from tradewind.plans.targeting import targeting_score, targeting_score_documents, targeting_score_graph
from tradewind.schemas import CLEAN, RAW
from tradewind.sources.csv import read_csv, read_typed_csv
from tradewind.sources.months import Months, between, month_of
from tradewind.sources.tables import current, publication, read_tables, write_tables
from tradewind.sources.testdata import KEYWORDS, PHRASES, SEGMENTS, view

Query = Callable[[SparkSession, str], DataFrame]

# Loaded once per application and folder, as the reports all start from the same loaded tables.
_loaded: dict[tuple, dict] = {}


def _once(kind: str, build: Query) -> Callable[[SparkSession, str], dict]:
    def get(spark: SparkSession, sf_dir: str) -> dict:
        key = (spark.sparkContext.applicationId, sf_dir, kind)
        if key not in _loaded:
            _loaded[key] = build(spark, sf_dir)
        return _loaded[key]

    return get


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_events")


def _friends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each friendship once, lower user first."""
    return clean_friends(view(spark, sf_dir, "fx_friends_raw"))[0]


def _friendships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _friends(spark, sf_dir).withColumnsRenamed({"friend1": "user_id_1", "friend2": "user_id_2"})


def _build_keyed(spark: SparkSession, sf_dir: str) -> dict:
    categories, products, events = assign_keys(materialise(_events(spark, sf_dir), "fx_events"))
    tables = {"categories": categories, "products": products, "events": events}
    return {name: materialise(df, name) for name, df in tables.items()}


_keyed = _once("keyed", _build_keyed)


def resolved_tables(spark: SparkSession, sf_dir: str) -> dict:
    keyed = _keyed(spark, sf_dir)
    clients, friends = view(spark, sf_dir, "fx_clients"), materialise(_friends(spark, sf_dir), "friends")
    return models.resolve(
        {
            **keyed,
            "users": build_users(keyed["events"], clients, friends),
            "clients": clients,
            "campaigns": view(spark, sf_dir, "fx_campaigns"),
            "messages": view(spark, sf_dir, "fx_messages"),
            "friends": friends,
        }
    )


_resolved = _once("resolved", resolved_tables)


def _double_price(df: DataFrame, column: str = "price") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("double"))


# ── campaign conversion ─────────────────────────────────────────────────────────────────────────


def _campaign_conversion(spark, sf_dir, **options):
    return campaign_conversion(view(spark, sf_dir, "fx_messages"), view(spark, sf_dir, "fx_campaigns"), **options)


def _campaign_conversion_documents(spark, sf_dir):
    return campaign_conversion_documents(models.documents(_resolved(spark, sf_dir))["messages"], k=None)


def _campaign_conversion_graph(spark, sf_dir):
    vertices, edges = models.graph(_resolved(spark, sf_dir))
    return campaign_conversion_graph(edges["SENT_TO"], vertices["Campaign"], k=None)


# ── targeting score ─────────────────────────────────────────────────────────────────────────────


def _targeting_score(spark, sf_dir, **options):
    messages, clients = view(spark, sf_dir, "fx_messages"), view(spark, sf_dir, "fx_clients")
    return targeting_score(messages, clients, _friendships(spark, sf_dir), **options)


def _targeting_score_documents(spark, sf_dir):
    docs = models.documents(_resolved(spark, sf_dir), models.PARTS)
    return targeting_score_documents(docs["users"], docs["messages"], k=None)


def _targeting_score_graph(spark, sf_dir):
    _, edges = models.graph(_resolved(spark, sf_dir))
    return targeting_score_graph(edges["SENT_TO"], edges["BELONGS_TO"], edges["FRIENDS_WITH"], k=None)


# ── recommendations ─────────────────────────────────────────────────────────────────────────────


def _category_affinity(spark, sf_dir):
    t = _keyed(spark, sf_dir)
    return category_affinity(t["events"], t["products"])


def _top_categories(spark, sf_dir):
    return top_categories(_category_affinity(spark, sf_dir))


def _product_popularity(spark, sf_dir):
    return product_popularity(_keyed(spark, sf_dir)["events"])


def _top_products(spark, sf_dir):
    t = _keyed(spark, sf_dir)
    best = top_products(rated_products(t["products"], product_popularity(t["events"])))
    return best.select("category_sk", "product_sk", "product_id", "buy_count")


def _recommend(spark, sf_dir, **options):
    t = _keyed(spark, sf_dir)
    return _double_price(recommend(t["events"], t["products"], t["categories"], **options))


def _recommend_wide(spark, sf_dir):
    wide = models.denormalised(_resolved(spark, sf_dir))
    return _double_price(
        recommend(wide["events"], wide["products"], wide["categories"], inline_category=True, limit=None)
    )


def _recommend_documents(spark, sf_dir):
    docs = models.documents(_resolved(spark, sf_dir))
    return recommend_documents(docs["events"], docs["products"], limit=None)


def _recommend_graph(spark, sf_dir):
    vertices, edges = models.graph(_resolved(spark, sf_dir))
    return recommend_graph(edges["HAD_EVENT"], edges["IN_CATEGORY"], vertices["Product"], vertices["Category"], limit=None)


# ── search ──────────────────────────────────────────────────────────────────────────────────────


def _search(spark, sf_dir, match, keywords=KEYWORDS):
    t = _keyed(spark, sf_dir)
    return _double_price(search(keywords, t["categories"], t["products"], t["events"], match))


def _search_documents(spark, sf_dir):
    resolved = _resolved(spark, sf_dir)
    docs = models.documents(resolved)
    return search_documents(KEYWORDS, docs["products"], docs["events"], categories=resolved["categories"])


def _search_graph(spark, sf_dir):
    vertices, edges = models.graph(_resolved(spark, sf_dir))
    return search_graph(KEYWORDS, vertices["Category"], vertices["Product"], edges["IN_CATEGORY"], edges["HAD_EVENT"])


# ── cleaning and dimensions ─────────────────────────────────────────────────────────────────────

def _cleaner(name: str) -> Query:
    return lambda spark, sf_dir: _dates_as_text(CLEANERS[name](view(spark, sf_dir, f"raw_{name}"))[0].select(*RAW[name]))


def _from_csv(name: str) -> Query:
    """The raw view written as CSV into the shared folder, read back and cleaned."""

    def query(spark, sf_dir):
        path = _as_csv(view(spark, sf_dir, f"raw_{name}"), name)
        return _dates_as_text(CLEANERS[name](read_csv(spark, path, RAW[name]))[0].select(*RAW[name]))

    return query


def _as_csv(df: DataFrame, name: str) -> str:
    """Write a table as CSV into the shared folder, and return its path."""
    path = f"{shared_folder(df.sparkSession)}/csv/{name}-{uuid.uuid4().hex}.csv"
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]"}
    df.write.options(header=True, escape='"', **keep).csv(path)
    return path


def _csv_typed(spark, sf_dir):
    """Cleaned messages as a CSV file, read back with their types."""
    messages, _ = clean_messages(view(spark, sf_dir, "raw_messages"))
    return _dates_as_text(read_typed_csv(spark, _as_csv(messages.select(*RAW["messages"]), "clean_messages"), CLEAN["messages"]))


def _csv_subset(spark, sf_dir):
    """Four columns of cleaned events in a CSV file of nine, in another order."""
    events, _ = clean_events(view(spark, sf_dir, "raw_events"))
    path = _as_csv(events.select(*RAW["events"]), "clean_events")
    return read_typed_csv(spark, path, CLEAN["events"], ["user_id", "price", "event_time", "event_type"])


def _dates_as_text(df: DataFrame) -> DataFrame:
    """Engines hand dates to Python in different types; as text they compare."""
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


def _clean_audit(spark, sf_dir):
    return union_all([clean(view(spark, sf_dir, f"raw_{name}"))[1] for name, clean in CLEANERS.items()])


def _build_clients(spark, sf_dir):
    messages, _ = clean_messages(view(spark, sf_dir, "raw_messages"))
    return build_clients(messages, clean_first_purchases(view(spark, sf_dir, "raw_client_first_purchase_date")))


def _build_users(spark, sf_dir):
    friends, _ = clean_friends(view(spark, sf_dir, "raw_friends"))
    events, _ = clean_events(view(spark, sf_dir, "raw_events"))
    return build_users(events, _build_clients(spark, sf_dir), friends)


def _clean_messages_integrity(spark, sf_dir):
    messages, _ = clean_messages(view(spark, sf_dir, "raw_messages"))
    campaigns, _ = clean_campaigns(view(spark, sf_dir, "raw_campaigns"))
    return enforce_campaigns(messages, campaigns).groupBy("campaign_id", "message_type").agg(F.count("*").alias("n"))


def _dim_products(spark, sf_dir):
    return _double_price(_keyed(spark, sf_dir)["products"], "last_known_price")


def _events_keyed(spark, sf_dir):
    return _double_price(_keyed(spark, sf_dir)["events"].select("event_time", "event_type", "user_id", "price", "product_sk"))


def _events_null_keys(spark, sf_dir):
    return null_counts(_keyed(spark, sf_dir)["events"], ["product_sk", "category_code", "brand"])


def _messages_integrity(spark, sf_dir):
    messages, campaigns = view(spark, sf_dir, "fx_messages"), view(spark, sf_dir, "fx_campaigns")
    kept = keep_known(messages, ["campaign_id", "message_type"], campaigns, ["campaign_id", "campaign_type"])
    return kept.select("id", "campaign_id", "message_type")


def _events_fk_filter(spark, sf_dir):
    """Events of users who have friends, on products that were bought."""
    events, pairs = _keyed(spark, sf_dir)["events"], _friendships(spark, sf_dir)
    befriended = models.both_directions(pairs).select("user_id").distinct()
    kept = keep_known(keep_known(events, ["user_id"], befriended), ["product_sk"], product_popularity(events))
    return kept.groupBy("user_id", "product_sk").agg(F.count("*").alias("n"))


def _messages_client_fk(spark, sf_dir):
    """Messages without a client, or to a client with a first purchase."""
    messages, clients = view(spark, sf_dir, "fx_messages"), view(spark, sf_dir, "raw_first_purchase")
    return keep_known(messages, ["client_id"], clients, allow_null=True).select("id", "client_id")


# ── models ──────────────────────────────────────────────────────────────────────────────────────


def _doc_users(spark, sf_dir, parts=models.PARTS):
    users = models.documents(_resolved(spark, sf_dir), parts)["users"]

    def text(c):
        return F.concat_ws(":", c.client_id.cast("string"), c.user_device_id.cast("string"), c.first_purchase_date)

    return users.select(
        F.col("_id").alias("user_id"),
        "part",
        F.array_join(F.transform("clients", text), ",").alias("clients"),
        F.array_join(F.col("friends").cast("array<string>"), ",").alias("friends"),
    )


def _doc_products(spark, sf_dir):
    products = models.documents(_resolved(spark, sf_dir))["products"]
    return products.select(
        F.col("_id").alias("product_sk"), "product_id", "category.category_id", "category.category_code",
        "brand", "last_known_price",
    )


def _doc_campaigns(spark, sf_dir):
    return models.documents(_resolved(spark, sf_dir))["campaigns"].select("_id.campaign_id", "_id.campaign_type", "channel")


def _doc_messages(spark, sf_dir):
    messages = models.documents(_resolved(spark, sf_dir))["messages"]
    return messages.select(F.col("_id").alias("id"), "campaign.*", *[c for c in messages.columns if c not in ("_id", "campaign")])


def _doc_events(spark, sf_dir):
    events = models.documents(_resolved(spark, sf_dir))["events"]
    return events.select(F.col("_id").alias("event_id"), "event_time", "event_type", "user_id", "product_sk", "price", "user_session")


def _wide_events(spark, sf_dir):
    return _double_price(models.denormalised(_resolved(spark, sf_dir))["events"])


def _wide_messages(spark, sf_dir):
    return models.denormalised(_resolved(spark, sf_dir))["messages"]


def _graph_sent_to(spark, sf_dir):
    sent = models.graph(_resolved(spark, sf_dir))[1]["SENT_TO"]
    return sent.select("src.campaign_id", "src.campaign_type", F.col("dst").alias("client_id"), "id", "is_opened", "is_purchased")


def _graph_edge(name: str) -> Query:
    return lambda spark, sf_dir: models.graph(_resolved(spark, sf_dir))[1][name]


def _graph_vertex(label: str) -> Query:
    return lambda spark, sf_dir: _dates_as_text(models.graph(_resolved(spark, sf_dir))[0][label])


def _graph_violations_found(spark, sf_dir):
    """The check of user vertices, after every tenth user was stored twice."""
    vertices = models.graph(_resolved(spark, sf_dir))[0]
    users = vertices["User"]
    twice = users.unionByName(users.filter(F.col("user_id") % 10 == 0))
    return violations({**vertices, "User": twice}, models.vertex_constraints()[:1])


def _load_audit(spark, sf_dir):
    """The audit of a load whose parents are incomplete: clients with a purchase, users with friends, products that were bought."""
    keyed, pairs = _keyed(spark, sf_dir), _friends(spark, sf_dir)
    befriended = models.both_directions(_friendships(spark, sf_dir)).select("user_id").distinct()
    sold = product_popularity(keyed["events"])
    tables = {
        **keyed,
        "products": keyed["products"].join(sold, "product_sk", "left_semi"),
        "users": befriended,
        "clients": view(spark, sf_dir, "raw_first_purchase"),
        "campaigns": view(spark, sf_dir, "fx_campaigns"),
        "messages": view(spark, sf_dir, "fx_messages"),
        "friends": pairs,
    }
    return models.resolve_with_audit(tables)[1]


def _graph_violations(spark, sf_dir):
    return violations(models.graph(_resolved(spark, sf_dir))[0], models.vertex_constraints())


def _graph_vertices(spark, sf_dir):
    return row_counts(models.graph(_resolved(spark, sf_dir))[0])


def _graph_edges(spark, sf_dir):
    """Edges per type, with their distinct ends."""
    _, edges = models.graph(_resolved(spark, sf_dir))
    per_type = [
        df.agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))
        .withColumn("name", F.lit(name))
        for name, df in edges.items()
    ]
    return union_all(per_type)


def _table_counts(spark, sf_dir):
    return row_counts(models.normalised(_resolved(spark, sf_dir)))


def _events_by_month(spark, sf_dir):
    return models.month_counts(models.normalised(_resolved(spark, sf_dir))["events"])


# Months that the registered layout has folders for. Events go from 1992 to 1998.
_MONTHS: Months = ("1994-01", "1996-12")


def _store_events(spark, sf_dir) -> dict:
    """Events of the normalised model, written by month."""
    events = models.normalised(_resolved(spark, sf_dir))["events"].withColumn("event_month", month_of("event_time", _MONTHS))
    folder = f"{shared_folder(spark)}/tables/by-month-{uuid.uuid4().hex}"
    write_tables({"events": events}, folder, models.PARTITION_BY)
    return {"folder": folder}


_stored_events = _once("by-month", _store_events)


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{_stored_events(spark, sf_dir)['folder']}/events")


def _events_between(spark, sf_dir, start, stop):
    """Events of a time range from the stored layout."""
    return _double_price(between(stored_events(spark, sf_dir), start, stop))


def _publish_twice(spark, sf_dir):
    """Row counts of cleaned tables after a load, a second one with other rows, and a third that fails midway."""
    keyed, clients, friends = _keyed(spark, sf_dir), view(spark, sf_dir, "fx_clients"), _friends(spark, sf_dir)
    tables = {**keyed, "clients": clients, "friends": friends}
    folder = f"{shared_folder(spark)}/tables/published-{uuid.uuid4().hex}"
    with publication(spark, folder) as version:
        version.write({name: df.limit(1) for name, df in tables.items()})
    with publication(spark, folder) as version:
        version.write(tables)
    with suppress(InterruptedError), publication(spark, folder) as version:
        version.write({"clients": clients.limit(0), "friends": friends.limit(0)})
        raise InterruptedError
    return row_counts(read_tables(spark, current(spark, folder), list(tables)))


def _constraint_violations(spark, sf_dir):
    """The constraints of the normalised model, on tables whose foreign keys were not resolved."""
    keyed = _keyed(spark, sf_dir)
    clients, pairs = view(spark, sf_dir, "fx_clients"), _friendships(spark, sf_dir)
    unresolved = {
        **keyed,
        "users": clients.select("user_id").distinct(),
        "clients": clients,
        "campaigns": view(spark, sf_dir, "fx_campaigns"),
        "messages": view(spark, sf_dir, "fx_messages"),
        "events": _resolved(spark, sf_dir)["events"],
        "friendships": pairs,
    }
    return violations(unresolved, models.constraints(unresolved))


def _model_consistency(spark, sf_dir):
    """Every analysis on all four models, compared row by row with the normalised one."""
    r = _resolved(spark, sf_dir)
    norm, wide, docs, (vertices, edges) = models.normalised(r), models.denormalised(r), models.documents(r, models.PARTS), models.graph(r)
    sent, belongs, friends = edges["SENT_TO"], edges["BELONGS_TO"], edges["FRIENDS_WITH"]
    had, within = edges["HAD_EVENT"], edges["IN_CATEGORY"]

    def conversion(m, **options):
        return campaign_conversion(m["messages"], m["campaigns"], k=None, **options)

    def recommended(m, **options):
        return recommend(m["events"], m["products"], m["categories"], limit=None, **options)

    def found(m):
        return search(KEYWORDS, m["categories"], m["products"], m["events"], "contains")

    # The graph has no bulk messages, so its counterpart leaves them out too.
    base = {
        "conversion": conversion(norm),
        "client conversion": conversion(norm, require_client=True),
        "targeting": targeting_score(norm["messages"], norm["clients"], norm["friendships"], k=None),
        "recommend": _double_price(recommended(norm)),
        "search": _double_price(found(norm)),
    }
    others = {
        ("conversion", "denormalised"): conversion(wide),
        ("conversion", "document"): campaign_conversion_documents(docs["messages"], docs["campaigns"], None, "half_up"),
        ("client conversion", "graph"): campaign_conversion_graph(sent, vertices["Campaign"], None, "half_up"),
        ("targeting", "denormalised"): targeting_score(wide["messages"], wide["clients"], wide["friendships"], k=None),
        ("targeting", "document"): targeting_score_documents(docs["users"], docs["messages"], k=None),
        ("targeting", "graph"): targeting_score_graph(sent, belongs, friends, k=None),
        ("recommend", "denormalised"): _double_price(recommended(wide, inline_category=True)),
        ("recommend", "document"): recommend_documents(docs["events"], docs["products"], exclusion="after_rank", limit=None),
        ("recommend", "graph"): recommend_graph(
            had, within, vertices["Product"], vertices["Category"], exclusion="after_rank", limit=None
        ),
        ("search", "denormalised"): _double_price(found(wide)),
        ("search", "document"): search_documents(KEYWORDS, docs["products"], docs["events"], "contains"),
        ("search", "graph"): search_graph(KEYWORDS, vertices["Category"], vertices["Product"], within, had, "contains"),
    }
    base = {query: materialise(result, "base") for query, result in base.items()}
    changed = base["conversion"].agg(F.min(F.struct("campaign_id", "campaign_type")).alias("c")).select("c.*", F.lit(1).alias("more"))
    wrong = base["conversion"].join(changed, ["campaign_id", "campaign_type"], "left").withColumn(
        "total_sent", F.col("total_sent") + F.coalesce("more", F.lit(0))
    )
    others["conversion", "one row changed"] = wrong.drop("more")
    return consistency(base, others)


QUERIES: dict[str, Query] = {
    "campaign_conversion": _campaign_conversion,
    "campaign_conversion_require_client": lambda s, d: _campaign_conversion(s, d, require_client=True),
    "campaign_conversion_documents": _campaign_conversion_documents,
    "campaign_conversion_graph": _campaign_conversion_graph,
    "targeting_score": _targeting_score,
    "targeting_score_wide": lambda s, d: _targeting_score(s, d, k=None, buyer_from="messages"),
    "targeting_score_with_self_only": lambda s, d: _targeting_score(s, d, k=None, include_self_only=True),
    "targeting_score_documents": _targeting_score_documents,
    "targeting_score_graph": _targeting_score_graph,
    "category_affinity": _category_affinity,
    "top_categories_per_user": _top_categories,
    "product_popularity": _product_popularity,
    "top_products_per_category": _top_products,
    "recommend_top50": _recommend,
    "recommend_after_rank": lambda s, d: _recommend(s, d, limit=None),
    "recommend_before_rank": lambda s, d: _recommend(s, d, limit=None, exclusion="before_rank"),
    "recommend_wide": _recommend_wide,
    "recommend_documents": _recommend_documents,
    "recommend_graph": _recommend_graph,
    "search_token": lambda s, d: _search(s, d, "token"),
    "search_segment": lambda s, d: _search(s, d, "segment"),
    "search_phrase": lambda s, d: _search(s, d, "token", PHRASES),
    "search_segment_any_case": lambda s, d: _search(s, d, "segment", SEGMENTS),
    "search_contains": lambda s, d: _search(s, d, "contains"),
    "search_documents": _search_documents,
    "search_graph": _search_graph,
    "clean_events": _cleaner("events"),
    "clean_campaigns": _cleaner("campaigns"),
    "clean_messages": _cleaner("messages"),
    "clean_friends": _cleaner("friends"),
    "csv_events": _from_csv("events"),
    "csv_messages": _from_csv("messages"),
    "csv_typed": _csv_typed,
    "csv_subset": _csv_subset,
    "clean_audit": _clean_audit,
    "clean_messages_integrity": _clean_messages_integrity,
    "build_clients": lambda s, d: _dates_as_text(_build_clients(s, d)),
    "build_users": _build_users,
    "dim_categories": lambda s, d: _keyed(s, d)["categories"],
    "dim_products": _dim_products,
    "events_keyed": _events_keyed,
    "events_null_keys": _events_null_keys,
    "messages_integrity": _messages_integrity,
    "events_fk_filter": _events_fk_filter,
    "messages_client_fk": _messages_client_fk,
    "doc_users": _doc_users,
    "doc_users_parts": lambda s, d: _doc_users(s, d, parts=3),
    "doc_products": _doc_products,
    "doc_campaigns": _doc_campaigns,
    "doc_messages": _doc_messages,
    "doc_events": _doc_events,
    "graph_vertices_summary": _graph_vertices,
    "graph_edges_summary": _graph_edges,
    "graph_had_event": _graph_edge("HAD_EVENT"),
    "graph_belongs_to": _graph_edge("BELONGS_TO"),
    "graph_friends_with": _graph_edge("FRIENDS_WITH"),
    "graph_in_category": _graph_edge("IN_CATEGORY"),
    **{f"graph_vertices_{label.lower()}": _graph_vertex(label) for label in ("User", "Client", "Category", "Product", "Campaign")},
    "graph_violations_found": _graph_violations_found,
    "load_audit": _load_audit,
    "graph_sent_to": _graph_sent_to,
    "graph_constraint_violations": _graph_violations,
    "wide_events": _wide_events,
    "wide_messages": _wide_messages,
    "table_counts": _table_counts,
    "events_by_month": _events_by_month,
    "events_one_month": lambda s, d: _events_between(s, d, "1995-03-01", "1995-04-01"),
    "events_across_bounds": lambda s, d: _events_between(s, d, "1996-12-10T12:00", "1997-01-20"),
    "events_in_and_outside_months": lambda s, d: models.month_counts(stored_events(s, d)),
    "publish_twice": _publish_twice,
    "constraint_violations": _constraint_violations,
    "model_consistency": _model_consistency,
}
