"""The test tables as shop data: views in SQL that both Spark and DuckDB run.

``fx_*`` views hold typed tables for the models and analyses, ``raw_*`` views hold dirty text for
the cleaning jobs. Each view may use those before it.
"""

import re

from pyspark.sql import DataFrame, SparkSession

from ..schemas import CAMPAIGN_FLAGS, MESSAGE_FLAGS, MESSAGE_TIMES, RAW

BASE = ["nation", "customer", "part", "orders", "lineitem"]

KEYWORDS = ["ring", "widget", "bolt", "gear"]
PHRASES = ["hard_ring", "Hard Widget", "hard.bolt", "ring hard", "_", "gear"]
SEGMENTS = ["RING", "Widgets", "HARD_bolt", "economy.gear", "rin"]


def _dirty_flag(key: str, shift: int) -> str:
    return (
        f"CASE ({key} + {shift}) % 8 WHEN 0 THEN ' T' WHEN 1 THEN 'f ' WHEN 2 THEN 'True' WHEN 3 THEN 'FALSE' "
        "WHEN 4 THEN '1' WHEN 5 THEN '0' WHEN 6 THEN 'maybe' ELSE NULL END"
    )


def _dirty_time(key: str, shift: int) -> str:
    return (
        f"CASE WHEN ({key} + {shift}) % 29 = 0 THEN 'not a time' WHEN ({key} + {shift}) % 5 = 1 THEN NULL "
        "ELSE CAST(o_orderdate AS STRING) || "
        f"CASE ({key} + {shift}) % 31 WHEN 3 THEN '+05:00' WHEN 4 THEN '-09:30' WHEN 5 THEN ' Europe/Paris' WHEN 6 THEN ' UTC' ELSE '' END END"
    )


_RAW_MESSAGE = {
    "id": "CASE WHEN o_orderkey % 97 = 0 THEN 'bad' ELSE CAST(o_orderkey AS STRING) END",
    "message_id": "CASE WHEN o_orderkey % 41 = 0 THEN '  ' WHEN o_orderkey % 43 = 0 THEN NULL "
    "ELSE 'm-' || CAST(o_orderkey AS STRING) || suffix END",
    "campaign_id": "CAST(o_orderkey % 25 AS STRING)",
    "message_type": "' ' || o_orderpriority || ' '",
    "client_id": "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 59 = 1 THEN '146.0000001' ELSE CAST(o_custkey AS STRING) || '.0' END",
    "user_id": "CASE WHEN o_orderkey % 53 = 0 THEN 'unknown' ELSE CAST(o_custkey - o_custkey % 2 AS STRING) END",
    "user_device_id": "CAST(o_custkey % 2 AS STRING)",
    "channel": "CASE o_orderkey % 3 WHEN 0 THEN ' Email' WHEN 1 THEN 'PUSH ' ELSE 'sms' END",
    "category": "CAST(NULL AS STRING)",
    "platform": "CASE o_orderkey % 4 WHEN 0 THEN 'Android ' WHEN 1 THEN ' iOS' WHEN 2 THEN NULL ELSE 'desktop' END",
    "email_provider": "CASE WHEN o_orderkey % 3 = 0 THEN ' Mail.Example' ELSE NULL END",
    "stream": "lower(o_orderstatus)",
    "date": "CASE WHEN o_orderkey % 37 = 0 THEN '??' WHEN o_orderkey % 37 = 1 THEN substr(CAST(o_orderdate AS STRING), 1, 10) || ' 02:00:00+04:00' "
    "ELSE substr(CAST(o_orderdate AS STRING), 1, 10) END",
    **{c: _dirty_flag("o_orderkey", i) for i, c in enumerate(MESSAGE_FLAGS)},
    **{c: _dirty_time("o_orderkey", i) for i, c in enumerate(MESSAGE_TIMES)},
}

_RAW_CAMPAIGN = {
    "id": "CAST(campaign_id AS STRING)",
    "campaign_type": "CASE WHEN copy = 1 THEN upper(campaign_type) ELSE ' ' || campaign_type END",
    "channel": "CASE WHEN copy = 1 THEN 'Push' ELSE ' EMAIL ' END",
    "topic": "CASE WHEN campaign_id % 5 = 0 THEN NULL ELSE 'Sale ' || CAST(campaign_id AS STRING) END",
    "started_at": "CASE WHEN campaign_id % 7 = 0 THEN 'soon' WHEN campaign_id % 7 = 1 THEN '2021-04-30T22:00:00+05:30' ELSE '2021-04-30 07:22:36.615023' END",
    "finished_at": "CASE WHEN campaign_id % 3 = 0 THEN NULL ELSE '2021-05-01 08:00:00' END",
    "total_count": "CASE WHEN campaign_id % 6 = 0 THEN 'many' WHEN campaign_id % 6 = 1 THEN CAST(campaign_id AS STRING) || '.0000001' "
    "ELSE CAST(campaign_id * 10 AS STRING) || '.0' END",
    **{c: _dirty_flag("campaign_id", i) for i, c in enumerate(CAMPAIGN_FLAGS)},
    "hour_limit": "CASE WHEN campaign_id % 4 = 0 THEN '24' WHEN campaign_id % 8 = 1 THEN '1.5' WHEN campaign_id % 8 = 5 THEN '2.5f' ELSE NULL END",
    "subject_length": "CASE WHEN campaign_id % 9 = 0 THEN '-' ELSE CAST(40 + campaign_id AS STRING) END",
    "position": "CASE WHEN campaign_id % 2 = 0 THEN ' Top' ELSE NULL END",
}


def _columns(names: list[str], expressions: dict[str, str]) -> str:
    return ",\n       ".join(f"{expressions[n]} AS {n}" for n in names)


VIEWS: dict[str, str] = {
    # Some (campaign, type) pairs are missing on purpose: their messages are orphans.
    "fx_campaigns": """
SELECT t.campaign_id, t.campaign_type,
       CASE n_regionkey % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'push' ELSE 'sms' END AS channel
FROM (SELECT DISTINCT CAST(o_orderkey % 25 AS INT) AS campaign_id, lower(o_orderpriority) AS campaign_type FROM orders) t
JOIN nation ON n_nationkey = t.campaign_id
WHERE (t.campaign_id + length(t.campaign_type)) % 7 <> 0""",
    # A NULL client marks a bulk message; a flag may be NULL.
    "fx_messages": """
SELECT o_orderkey AS id, 'm-' || CAST(o_orderkey AS STRING) AS message_id,
       CAST(o_orderkey % 25 AS INT) AS campaign_id, lower(o_orderpriority) AS message_type,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS client_id,
       o_custkey - o_custkey % 2 AS user_id, CAST(o_custkey % 2 AS INT) AS user_device_id,
       CASE o_custkey % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'push' ELSE 'sms' END AS channel,
       o_orderstatus <> 'P' AS is_opened, o_orderstatus = 'F' AS is_clicked,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_orderstatus = 'F' AND o_totalprice >= 400000) END AS is_purchased,
       o_orderdate AS sent_at
FROM orders""",
    "raw_first_purchase": """
SELECT o_custkey AS client_id, o_custkey - o_custkey % 2 AS user_id, CAST(min(o_orderdate) AS DATE) AS first_purchase_date
FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey""",
    # Two clients per user.
    "fx_clients": """
SELECT c_custkey AS client_id, c_custkey - c_custkey % 2 AS user_id, CAST(c_custkey % 2 AS INT) AS user_device_id,
       f.first_purchase_date
FROM customer LEFT JOIN raw_first_purchase f ON f.client_id = c_custkey""",
    # Self-loops, reversed and repeated pairs.
    "fx_friends_raw": """
SELECT a.o_custkey - a.o_custkey % 2 AS friend1, b.o_custkey - b.o_custkey % 2 AS friend2
FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1""",
    # The category changes with l_linestatus and the brand with the quantity, so products have versions
    # and "last known" matters; NULL, plural and '_' codes separate the match modes.
    "fx_events": """
SELECT l_shipdate AS event_time,
       CASE l_returnflag WHEN 'R' THEN 'purchase' WHEN 'A' THEN 'cart' ELSE 'view' END AS event_type,
       l_partkey AS product_id, CAST(p_size % 5 AS BIGINT) AS category_id,
       CASE WHEN p_size % 10 = 0 THEN NULL
            WHEN l_linestatus = 'F' THEN lower(p_type) || '.' || split_part(p_name, ' ', 2) || CASE WHEN p_size % 3 = 0 THEN 's' ELSE '' END
            ELSE lower(p_type) || '.hard_' || split_part(p_name, ' ', 2) END AS category_code,
       CASE WHEN l_linenumber = 4 THEN NULL WHEN l_quantity >= 25 THEN lower(p_brand) ELSE lower(p_brand) || ' plus' END AS brand,
       CAST(l_extendedprice AS DECIMAL(10,2)) AS price, o_custkey - o_custkey % 2 AS user_id,
       's-' || CAST(l_orderkey AS STRING) AS user_session
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    # Flags, ids, times and labels as they come; one in fifty messages is there twice.
    "raw_messages": f"""
SELECT {_columns(RAW["messages"], _RAW_MESSAGE)}
FROM (SELECT *, '' AS suffix FROM orders UNION ALL SELECT *, '-b' AS suffix FROM orders WHERE o_orderkey % 50 = 0) o""",
    # UTC suffix or offset, case, blanks, bad (also number-like), negative and missing prices; whole-row duplicates.
    "raw_events": """
SELECT CAST(l_shipdate AS STRING) || CASE l_orderkey % 23 WHEN 3 THEN '+05:30' WHEN 7 THEN '-03:00' ELSE ' UTC' END AS event_time,
       CASE l_returnflag WHEN 'R' THEN ' Purchase' WHEN 'A' THEN 'CART' ELSE 'view ' END AS event_type,
       CAST(l_partkey AS STRING) AS product_id, CAST(l_partkey % 7 AS STRING) AS category_id,
       CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE ' Tools.' || CASE l_partkey % 3 WHEN 0 THEN 'Light' ELSE 'saw ' END END AS category_code,
       CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE ' Brand#' || CAST(l_partkey % 13 AS STRING) END AS brand,
       CASE l_orderkey % 5 WHEN 0 THEN 'abc' WHEN 1 THEN '-3' WHEN 2 THEN NULL
         ELSE CASE l_orderkey % 19 WHEN 1 THEN '12d' WHEN 2 THEN '2.5f' WHEN 3 THEN '0x1p3' WHEN 4 THEN '1.5e2' ELSE CAST(l_quantity AS STRING) END
       END AS price,
       CASE WHEN l_orderkey % 31 = 0 THEN NULL ELSE CAST(l_orderkey % 150 AS STRING) END AS user_id,
       ' s-' || CAST(l_suppkey AS STRING) || ' ' AS user_session
FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 20 = 0) l""",
    # Case, blanks and repeated keys.
    "raw_campaigns": f"""
SELECT {_columns(RAW["campaigns"], _RAW_CAMPAIGN)}
FROM (SELECT DISTINCT o_orderkey % 25 AS campaign_id, lower(o_orderpriority) AS campaign_type, 0 AS copy FROM orders
      UNION ALL
      SELECT DISTINCT o_orderkey % 25 AS campaign_id, lower(o_orderpriority) AS campaign_type, 1 AS copy FROM orders
      WHERE o_orderkey % 25 % 4 = 0) c""",
    "raw_client_first_purchase_date": """
SELECT CAST(client_id AS STRING) AS client_id, CAST(first_purchase_date AS STRING) AS first_purchase_date,
       CAST(user_id AS STRING) AS user_id, CAST(NULL AS STRING) AS user_device_id
FROM raw_first_purchase""",
    "raw_friends": """
SELECT CASE WHEN friend1 % 17 = 0 THEN NULL ELSE CAST(friend1 AS STRING) END AS friend1, CAST(friend2 AS STRING) AS friend2
FROM fx_friends_raw""",
}


def with_views(*names: str, also: dict[str, str] | None = None) -> str:
    """A WITH clause that defines the named views and what they need."""
    known = {**VIEWS, **(also or {})}
    needed: dict[str, None] = {}

    def add(name: str) -> None:
        for other in known:
            if other != name and re.search(rf"\b{other}\b", known[name]):
                add(other)
        needed.setdefault(name)

    for name in names:
        add(name)
    return ",\n".join(f"{name} AS ({known[name].strip()})" for name in needed)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views above, over the parquet files in ``sf_dir``."""
    # The raw views have some thirty expressions a row. As one method they exceed what the JVM compiles (8,000 bytes).
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    tables = ",\n".join(f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in BASE)
    return spark.sql(f"WITH {tables},\n{with_views(name)}\nSELECT * FROM {name}")
