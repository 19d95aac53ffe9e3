"""Four forms of one data set: normalised, denormalised, document and graph.

``resolve`` checks foreign keys and numbers the events once; the four builders then only project
and join. ``t`` holds the cleaned tables users, clients, categories, products, campaigns, messages,
events (with product_sk) and friends.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import whole
from ..operators.constraints import Check, Constraint, ForeignKey, Unique, not_null
from ..operators.embed import embed
from ..operators.integrity import FAILED, Parent, failures, first_failing, passed
from ..operators.keys import dense_keys
from ..operators.ordering import keep_one, nulls_last
from ..operators.quality import union_all
from ..operators.storage import materialise
from ..schemas import CAMPAIGN_COLUMNS, EVENT_COLUMNS, MESSAGE_COLUMNS
from ..sources.months import Months, month_of

MONEY = "decimal(10,2)"
# Fixed value: parts of each user's document in stored models and registered queries. A prime, as ids may come in steps.
PARTS = 17
NOT_IN_EVENT_DOCUMENTS = ["product_id", "category_id", "category_code", "category_sk", "brand", "event_month"]


def existing(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that ``df`` has, in the order given."""
    return df.select(*[c for c in columns if c in df.columns])


def resolve(t: dict[str, DataFrame], months: Months | None = None) -> dict[str, DataFrame]:
    """The tables with every foreign key resolved and event_id 1..n in time order, all of them stored.

    Events get an event_month column, the layout column of event tables; ``months`` bounds it.
    Numbering leaves them sorted by time, so writing them by month makes few files per month.
    """
    return resolve_with_audit(t, months)[0]


def resolve_with_audit(t: dict[str, DataFrame], months: Months | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """``resolve``, and what each foreign key dropped: table, key, n_rows (before), dropped.

    A key is checked on the rows that the keys before it kept. Each table with foreign keys is
    written once, rejected rows too, with the key that rejected them, and counted there.
    """
    campaigns = keep_one(t["campaigns"].withColumnRenamed("id", "campaign_id"), ["campaign_id", "campaign_type"])
    campaigns, users = materialise(campaigns, "campaigns"), materialise(t["users"].select("user_id").distinct(), "users")
    clients = materialise(keep_one(t["clients"], ["client_id"]), "clients")

    campaign = Parent(["campaign_id", "message_type"], campaigns, ["campaign_id", "campaign_type"])
    client = Parent(["client_id"], clients, allow_null=True)
    messages = materialise(first_failing(t["messages"], [campaign, client]), "messages")

    event_parents = [Parent(["user_id"], users), Parent(["product_sk"], t["products"])]
    events = first_failing(t["events"], event_parents)
    first = [FAILED, "event_time", "user_id", "product_sk"]
    # Rejected rows come last, so the others are numbered without gaps.
    numbered = dense_keys(events, nulls_last(*first, *[c for c in events.columns if c not in first]), "event_id")
    # The numbering has written the events; its offsets, one per range partition, are looked up where ids are read.
    events = passed(numbered).withColumn("event_month", month_of("event_time", months))

    friends = t["friends"].select(F.col("friend1").alias("user_id_1"), F.col("friend2").alias("user_id_2"))
    friend_parents = [Parent([end], users, ["user_id"]) for end in ("user_id_1", "user_id_2")]
    friends = materialise(first_failing(friends, friend_parents), "friendships")

    resolved = {
        "users": users,
        "clients": clients,
        "categories": t["categories"],
        "products": t["products"],
        "campaigns": campaigns,
        "messages": passed(messages),
        "events": events,
        "friendships": passed(friends),
    }
    report = [
        failures("messages", messages, [campaign, client]),
        failures("events", numbered, event_parents, "event_id"),
        failures("friendships", friends, friend_parents),
    ]
    return resolved, union_all(report)


# Layout column per table, for write_tables.
PARTITION_BY = {"events": "event_month"}


def normalised(r: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Eight relational tables. A count of a campaign that is no whole number becomes NULL."""
    counts = {c: whole(F.col(c)) for c in ("total_count", "hour_limit", "subject_length") if c in r["campaigns"].columns}
    return {
        "users": r["users"],
        "clients": existing(r["clients"], ["client_id", "user_id", "user_device_id", "first_purchase_date"]),
        "categories": r["categories"].select("category_sk", "category_id", "category_code"),
        "products": r["products"].select(
            "product_sk", "product_id", "category_sk", "brand", F.col("last_known_price").cast(MONEY).alias("last_known_price")
        ),
        "campaigns": existing(r["campaigns"].withColumns(counts), CAMPAIGN_COLUMNS),
        "messages": existing(r["messages"], MESSAGE_COLUMNS),
        "events": existing(r["events"].withColumn("price", F.col("price").cast(MONEY)), [*EVENT_COLUMNS, "event_month"]),
        "friendships": r["friendships"],
    }


def denormalised(r: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The relational tables, with user and device in messages and product and category in events."""
    wide_messages = [*MESSAGE_COLUMNS[:5], "user_id", "user_device_id", *MESSAGE_COLUMNS[5:]]
    wide_events = [*EVENT_COLUMNS, "product_id", "brand", "category_id", "category_code", "category_sk", "event_month"]
    events = r["events"]
    if "category_sk" not in events.columns:  # cleaned elsewhere; the join loses the order by time
        events = events.join(r["products"].select("product_sk", "category_sk"), "product_sk", "left")
    return {
        **normalised(r),
        "messages": existing(r["messages"], wide_messages),
        "events": existing(events.withColumn("price", F.col("price").cast(MONEY)), wide_events),
    }


def documents(r: dict[str, DataFrame], parts: int = 1) -> dict[str, DataFrame]:
    """Five collections of nested documents; an absent value is a NULL field.

    A user's document is cut into ``parts`` by the ids of its clients and friends: part 0 is always
    there, others if something falls into them. One part is one document per user.
    """
    client = F.struct("client_id", "user_device_id", F.col("first_purchase_date").cast("string").alias("first_purchase_date"))
    clients = embed(r["clients"].dropna(subset=["user_id"]), "user_id", client, "clients", F.col("client_id"), parts)
    friends = embed(both_directions(r["friendships"]), "user_id", F.col("friend_id"), "friends", F.col("friend_id"), parts)
    users = (
        r["users"]
        .withColumn("part", F.lit(0))
        .join(clients, ["user_id", "part"], "full")
        .join(friends, ["user_id", "part"], "full")
        .join(r["users"], "user_id", "left_semi")
        .select(F.col("user_id").alias("_id"), "part", "clients", "friends")
    )
    category = F.when(F.col("category_id").isNotNull() | F.col("category_code").isNotNull(), F.struct("category_id", "category_code"))
    products = (
        r["products"]
        .join(r["categories"], "category_sk", "left")
        .select(
            F.col("product_sk").alias("_id"),
            "product_id",
            category.alias("category"),
            "brand",
            F.col("last_known_price").cast("double").alias("last_known_price"),
        )
    )
    campaigns = r["campaigns"].select(
        F.struct("campaign_id", "campaign_type").alias("_id"),
        *[c for c in r["campaigns"].columns if c not in ("campaign_id", "campaign_type")],
    )
    campaign_of = F.struct("campaign_id", "message_type").alias("campaign")
    return {
        "users": users,
        "products": products,
        "campaigns": campaigns,
        "messages": r["messages"]
        .withColumnRenamed("id", "_id")
        .withColumn("campaign", campaign_of)
        .drop("campaign_id", "message_type"),
        "events": r["events"]
        .withColumnRenamed("event_id", "_id")
        .withColumn("price", F.col("price").cast("double"))
        .drop(*NOT_IN_EVENT_DOCUMENTS),
    }


def both_directions(friendships: DataFrame) -> DataFrame:
    """Each friendship as (user_id, friend_id), once from either side. Reads the table once."""
    sides = F.array(
        F.struct(F.col("user_id_1").alias("user_id"), F.col("user_id_2").alias("friend_id")),
        F.struct(F.col("user_id_2").alias("user_id"), F.col("user_id_1").alias("friend_id")),
    )
    return friendships.select(F.inline(sides))


def graph(r: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(vertices per label, edges per type). Edges have src, dst and their own properties.

    A campaign's vertex id is its (campaign_id, campaign_type) pair. Friendships are stored once.
    """
    message_properties = [c for c in MESSAGE_COLUMNS if c not in ("campaign_id", "client_id", "message_type")]
    vertices = {
        "User": r["users"],
        "Client": existing(r["clients"], ["client_id", "user_device_id", "first_purchase_date"]),
        "Category": r["categories"],
        "Product": r["products"].select(
            "product_sk", "product_id", "brand", F.col("last_known_price").cast("double").alias("last_known_price")
        ),
        "Campaign": existing(r["campaigns"], CAMPAIGN_COLUMNS),
    }
    sent = r["messages"].filter(F.col("client_id").isNotNull())
    edges = {
        "BELONGS_TO": _edges(r["clients"], "client_id", "user_id"),
        "FRIENDS_WITH": _edges(r["friendships"], "user_id_1", "user_id_2"),
        "IN_CATEGORY": _edges(r["products"], "product_sk", "category_sk"),
        "HAD_EVENT": _edges(
            r["events"].withColumn("price", F.col("price").cast("double")),
            "user_id",
            "product_sk",
            ["event_type", "event_time", "price", "user_session"],
        ),
        "SENT_TO": sent.select(
            F.struct("campaign_id", F.col("message_type").alias("campaign_type")).alias("src"),
            F.col("client_id").alias("dst"),
            "message_type",
            *[c for c in message_properties if c in sent.columns],
        ),
    }
    return vertices, edges


def _edges(df: DataFrame, src: str, dst: str, properties: list[str] = ()) -> DataFrame:
    ends = df.dropna(subset=[src, dst])
    return ends.select(F.col(src).alias("src"), F.col(dst).alias("dst"), *[c for c in properties if c in df.columns])


def constraints(tables: dict[str, DataFrame]) -> list[Constraint]:
    """The constraints of the normalised model, for ``constraints.violations``."""
    keys = {
        "users": ["user_id"],
        "clients": ["client_id"],
        "categories": ["category_sk"],
        "products": ["product_sk"],
        "campaigns": ["campaign_id", "campaign_type"],
        "messages": ["id"],
        "events": ["event_id"],
        "friendships": ["user_id_1", "user_id_2"],
    }
    required = {
        "clients": ["user_id"],
        "categories": ["category_id"],
        "products": ["product_id"],
        "messages": ["campaign_id", "message_type"],
        "events": ["event_time", "event_type"],
    }
    parents = [
        ("clients", ["user_id"], "users", ["user_id"]),
        ("products", ["category_sk"], "categories", ["category_sk"]),
        ("messages", ["campaign_id", "message_type"], "campaigns", ["campaign_id", "campaign_type"]),
        ("messages", ["client_id"], "clients", ["client_id"]),
        ("events", ["product_sk"], "products", ["product_sk"]),
        ("events", ["user_id"], "users", ["user_id"]),
        ("friendships", ["user_id_1"], "users", ["user_id"]),
        ("friendships", ["user_id_2"], "users", ["user_id"]),
    ]
    found = [Unique(f"{name} primary key", name, tuple(key)) for name, key in keys.items()]
    for name, key in keys.items():
        found += not_null(name, [*key, *required.get(name, [])])
    found += [
        ForeignKey(f"{child}.{'+'.join(cols)} in {parent}", child, tuple(cols), parent, tuple(parent_cols))
        for child, cols, parent, parent_cols in parents
    ]
    found += [
        Unique("clients unique user and device", "clients", ("user_id", "user_device_id")),
        Unique("categories unique id and code", "categories", ("category_id", "category_code")),
        Check("friendships lower user first", "friendships", F.col("user_id_1") < F.col("user_id_2")),
    ]
    if "message_id" in tables["messages"].columns:
        found.append(Unique("messages unique message_id", "messages", ("message_id",)))
    return found


def vertex_constraints() -> list[Constraint]:
    """The unique keys of the graph model's vertices."""
    keys = {"User": "user_id", "Client": "client_id", "Product": "product_sk", "Category": "category_sk"}
    return [Unique(f"{label} unique {key}", label, (key,)) for label, key in keys.items()]


def month_counts(events: DataFrame) -> DataFrame:
    """event_month, n: the sizes of the event table's layout parts."""
    return events.groupBy("event_month").agg(F.count("*").alias("n"))
