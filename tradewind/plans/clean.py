"""Raw text frames to typed, deduplicated tables. Each job returns the table and its audit row."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import lenient_date, lenient_double, lenient_long, lenient_timestamp, strict_long, strict_utc_timestamp
from ..functions.text import flag, normalize, strip
from ..operators.ordering import keep_one
from ..operators.quality import audit
from ..operators.storage import materialise
from ..schemas import CAMPAIGN_FLAGS, MESSAGE_FLAGS, MESSAGE_LABELS, MESSAGE_TIMES


def _conform(df: DataFrame, conversions: dict) -> DataFrame:
    """Convert the columns that exist, in place.

    Columns with the same conversion are the items of one array, so that its code is there once. Repeated for
    each of some thirty columns it makes methods that the JVM does not compile, and rows are then interpreted.
    """
    alike: dict = {}
    for c, convert in conversions.items():
        if c in df.columns:
            alike.setdefault(convert, []).append(c)
    shared = {f"_converted_{i}": (convert, cs) for i, (convert, cs) in enumerate(alike.items()) if len(cs) > 2}
    values = {c: convert(F.col(c)) for convert, cs in alike.items() if len(cs) <= 2 for c in cs}
    values |= {c: F.get(name, i) for name, (_, cs) in shared.items() for i, c in enumerate(cs)}
    items = {name: F.transform(F.array(*[F.col(c).cast("string") for c in cs]), convert) for name, (convert, cs) in shared.items()}
    return df.withColumns(items).withColumns(values).select(*df.columns)


def _present(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def clean_events(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with a price of zero or more, a product and a user; whole-row duplicates removed."""
    kept = (lenient_double(F.col("price")) >= 0) & _present("product_id", "user_id")
    clean = _conform(
        raw.filter(kept),
        {
            "event_time": lambda c: strict_utc_timestamp(c, "event_time", kept),
            "event_type": normalize,
            "category_code": strip,
            "brand": normalize,
            "price": lenient_double,
            "product_id": lambda c: strict_long(c, "product_id", kept),
            "user_id": lambda c: strict_long(c, "user_id", kept),
            "category_id": lambda c: strict_long(c, "category_id", kept),
            "user_session": strip,
        },
    ).dropDuplicates()
    return clean, audit("events", raw, clean)


def clean_campaigns(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Campaigns with an id and a type, one row per (id, campaign_type)."""
    kept = _present("id", "campaign_type")
    clean = keep_one(
        _conform(
            raw.filter(kept),
            {
                "id": lambda c: strict_long(c, "id", kept),
                "started_at": lenient_timestamp,
                "finished_at": lenient_timestamp,
                "campaign_type": normalize,
                "channel": normalize,
                "topic": normalize,
                "position": normalize,
                "hour_limit": lenient_double,
                "subject_length": lenient_double,
                "total_count": lenient_long,
                **dict.fromkeys(CAMPAIGN_FLAGS, flag),
            },
        ),
        ["id", "campaign_type"],
    )
    return clean, audit("campaigns", raw, clean)


def clean_messages(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with a numeric id, a message id that is not blank, and a campaign; one row per id.

    Bulk messages have no client, so client, user and device may be NULL.
    """
    named = strip(F.col("message_id")) != ""
    kept = lenient_long(F.col("id")).isNotNull() & named & _present("campaign_id", "message_type")
    clean = keep_one(
        _conform(
            raw.filter(kept),
            {
                "id": lenient_long,
                "campaign_id": lambda c: strict_long(c, "campaign_id", kept),
                "client_id": lenient_long,
                "user_id": lenient_long,
                "user_device_id": lenient_long,
                "date": lenient_date,
                **dict.fromkeys(MESSAGE_LABELS, normalize),
                **dict.fromkeys(MESSAGE_TIMES, lenient_timestamp),
                **dict.fromkeys(MESSAGE_FLAGS, flag),
            },
        ),
        ["id"],
    )
    return clean, audit("messages", raw, clean)


def clean_first_purchases(raw: DataFrame) -> DataFrame:
    """First purchase dates per client; the client must be there."""
    return _conform(
        raw,
        {
            "client_id": lambda c: strict_long(c, "client_id"),
            "user_id": lenient_long,
            "user_device_id": lenient_long,
            "first_purchase_date": lenient_date,
        },
    ).select("client_id", "user_id", "user_device_id", "first_purchase_date")


def clean_friends(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Undirected friendships, each once, with the lower user first; no one befriends themselves."""
    kept = _present("friend1", "friend2")
    pairs = raw.filter(kept).select(
        strict_long(F.col("friend1"), "friend1", kept).alias("a"), strict_long(F.col("friend2"), "friend2", kept).alias("b")
    )
    clean = (
        pairs.filter(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("friend1"), F.greatest("a", "b").alias("friend2"))
        .dropDuplicates()
    )
    return clean, audit("friends", raw, clean)


CLEANERS = {"events": clean_events, "campaigns": clean_campaigns, "messages": clean_messages, "friends": clean_friends}


def clean_and_audit(name: str, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A stored cleaned table and its audit row. ``raw`` is best a stored table, too: both are counted as they lie."""
    clean = materialise(CLEANERS[name](raw)[0], name)
    return clean, audit(name, raw, clean)
