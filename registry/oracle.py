"""The same queries in SQL for DuckDB, over views named like the test tables."""

from tradewind.schemas import CAMPAIGN_FLAGS, MESSAGE_FLAGS, MESSAGE_LABELS, MESSAGE_TIMES, RAW
from tradewind.sources.testdata import KEYWORDS, PHRASES, SEGMENTS, with_views

# ── shared steps ────────────────────────────────────────────────────────────────────────────────

_WEIGHT = "CASE event_type WHEN 'purchase' THEN 3 WHEN 'cart' THEN 2 ELSE 1 END"

_STEPS = {
    "fx_friends": """
SELECT DISTINCT least(friend1, friend2) AS user_id_1, greatest(friend1, friend2) AS user_id_2
FROM fx_friends_raw WHERE friend1 <> friend2""",
    "fx_categories": """
SELECT row_number() OVER (ORDER BY category_id, category_code NULLS LAST) AS category_sk, category_id, category_code
FROM (SELECT DISTINCT category_id, category_code FROM fx_events) t""",
    "last_brand": """
SELECT product_id, category_id, category_code, brand FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id, category_id, category_code ORDER BY event_time DESC, brand DESC) AS rn
  FROM fx_events WHERE brand IS NOT NULL) t WHERE rn = 1""",
    "last_price": """
SELECT product_id, category_id, category_code, price FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id, category_id, category_code ORDER BY event_time DESC, price DESC) AS rn
  FROM fx_events WHERE price IS NOT NULL) t WHERE rn = 1""",
    "fx_versions": """
SELECT row_number() OVER (ORDER BY v.product_id, v.category_id, v.category_code NULLS LAST) AS product_sk,
       v.product_id, v.category_id, v.category_code, c.category_sk, b.brand, p.price AS last_known_price
FROM (SELECT DISTINCT product_id, category_id, category_code FROM fx_events) v
JOIN fx_categories c ON v.category_id = c.category_id AND v.category_code IS NOT DISTINCT FROM c.category_code
LEFT JOIN last_brand b ON v.product_id = b.product_id AND v.category_id = b.category_id AND v.category_code IS NOT DISTINCT FROM b.category_code
LEFT JOIN last_price p ON v.product_id = p.product_id AND v.category_id = p.category_id AND v.category_code IS NOT DISTINCT FROM p.category_code""",
    "fx_keyed": """
SELECT e.*, v.product_sk, v.category_sk
FROM fx_events e JOIN fx_versions v
  ON e.product_id = v.product_id AND e.category_id = v.category_id AND e.category_code IS NOT DISTINCT FROM v.category_code""",
    "popularity": "SELECT product_sk, count(*) AS buy_count FROM fx_keyed WHERE event_type = 'purchase' GROUP BY product_sk",
    "rated": """
SELECT v.*, coalesce(p.buy_count, 0) AS buy_count FROM fx_versions v LEFT JOIN popularity p ON p.product_sk = v.product_sk""",
    "affinity": f"SELECT user_id, category_sk, CAST(sum({_WEIGHT}) AS BIGINT) AS cat_score FROM fx_keyed GROUP BY user_id, category_sk",
    "favourites": """
SELECT user_id, category_sk, cat_score FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cat_score DESC, category_sk) AS rn FROM affinity) t WHERE rn <= 3""",
    "best_products": """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY category_sk ORDER BY buy_count DESC, product_sk) AS rn FROM rated) t WHERE rn <= 5""",
    "purchased": "SELECT DISTINCT user_id, product_sk FROM fx_keyed WHERE event_type = 'purchase'",
    "resolved_messages": """
SELECT m.* FROM fx_messages m JOIN fx_campaigns c ON m.campaign_id = c.campaign_id AND m.message_type = c.campaign_type""",
    "buyers": """
SELECT DISTINCT c.user_id FROM fx_messages m JOIN fx_clients c ON m.client_id = c.client_id WHERE m.is_purchased""",
    "message_buyers": "SELECT DISTINCT user_id FROM fx_messages WHERE is_purchased",
    "resolved_buyers": """
SELECT DISTINCT c.user_id FROM resolved_messages m JOIN fx_clients c ON m.client_id = c.client_id WHERE m.is_purchased""",
    "sides": """
SELECT user_id_1 AS user_id, user_id_2 AS friend_id FROM fx_friends
UNION ALL SELECT user_id_2, user_id_1 FROM fx_friends""",
    "all_users": """
SELECT user_id FROM fx_events UNION SELECT user_id FROM fx_clients
UNION SELECT user_id_1 FROM fx_friends UNION SELECT user_id_2 FROM fx_friends""",
}


def _sql(query: str, *views: str, **also: str) -> str:
    return f"WITH {with_views(*views, also={**_STEPS, **also})}\n{query.strip()}"


# ── analyses ────────────────────────────────────────────────────────────────────────────────────

_COUNTS = """count(*) AS total_sent, count(*) FILTER (WHERE is_opened) AS opened,
       count(*) FILTER (WHERE is_clicked) AS clicked, count(*) FILTER (WHERE is_purchased) AS purchased"""
_PURCHASES = "count(*) FILTER (WHERE is_purchased)"
# 100 * purchases / messages with two decimals, in whole numbers: half up, and half to even.
_HALF_UP = f"((20000 * {_PURCHASES} + count(*)) // (2 * count(*))) / 100.0"
_HALF_EVEN = f"""CASE WHEN (10000 * {_PURCHASES} % count(*)) * 2 = count(*) AND (10000 * {_PURCHASES} // count(*)) % 2 = 0
            THEN 10000 * {_PURCHASES} // count(*) ELSE (20000 * {_PURCHASES} + count(*)) // (2 * count(*)) END / 100.0"""


def _conversion(where: str = "TRUE", tail: str = "") -> str:
    return _sql(
        f"""
SELECT c.campaign_id, c.campaign_type, c.channel, {_COUNTS}, CAST({_HALF_UP} AS DOUBLE) AS purchase_rate_pct
FROM fx_messages m JOIN fx_campaigns c ON m.campaign_id = c.campaign_id AND m.message_type = c.campaign_type
WHERE {where} GROUP BY c.campaign_id, c.campaign_type, c.channel {tail}""",
        "fx_messages",
        "fx_campaigns",
    )


_TOP_CAMPAIGNS = "ORDER BY purchase_rate_pct DESC, campaign_id, campaign_type LIMIT 10"


def _targeting(buyers: str, tail: str = "", self_only: bool = False) -> str:
    return _sql(
        f"""
SELECT coalesce(f.user_id, b.user_id) AS user_id, coalesce(f.n, 0) AS friend_purchasers,
       CAST(CASE WHEN b.user_id IS NULL THEN 0 ELSE 2 END AS BIGINT) AS self_purchase_score,
       coalesce(f.n, 0) + CASE WHEN b.user_id IS NULL THEN 0 ELSE 2 END AS total_score
FROM (SELECT s.user_id, count(*) AS n FROM sides s JOIN {buyers} b ON b.user_id = s.friend_id GROUP BY s.user_id) f
{"FULL" if self_only else "LEFT"} JOIN {buyers} b ON b.user_id = f.user_id {tail}""",
        "sides",
        buyers,
    )


_RECOMMENDED = "user_id, category_code, product_id, brand, CAST(round(last_known_price, 2) AS DOUBLE) AS price, buy_count AS global_purchases"
_AFTER_RANK = """FROM favourites f JOIN best_products p USING (category_sk)
WHERE NOT EXISTS (SELECT 1 FROM purchased b WHERE b.user_id = f.user_id AND b.product_sk = p.product_sk)"""


def _after_rank(tail: str = "") -> str:
    return _sql(f"SELECT {_RECOMMENDED} {_AFTER_RANK} {tail}", "favourites", "best_products", "purchased")


def _before_rank() -> str:
    return _sql(
        f"""
SELECT {_RECOMMENDED} FROM (
  SELECT f.user_id, p.category_code, p.product_id, p.brand, p.last_known_price, p.buy_count,
         row_number() OVER (PARTITION BY f.user_id, category_sk ORDER BY p.buy_count DESC, p.product_sk) AS rn
  FROM favourites f JOIN rated p USING (category_sk)
  WHERE NOT EXISTS (SELECT 1 FROM purchased b WHERE b.user_id = f.user_id AND b.product_sk = p.product_sk)) t
WHERE rn <= 5""",
        "favourites",
        "rated",
        "purchased",
    )


def _words_of(text: str) -> str:
    return f"' ' || trim(regexp_replace(lower(coalesce({text}, '')), '[^a-z0-9]+', ' ', 'g')) || ' '"


def _keyword_list(keywords: list[str]) -> str:
    return "(VALUES " + ", ".join(f"('{k}')" for k in keywords) + ") AS k(keyword)"


_KEYWORDS = _keyword_list(KEYWORDS)
_MATCH = {
    "phrase": f"regexp_matches(k.keyword, '[a-zA-Z0-9]') AND contains({_words_of('p.category_code')}, {_words_of('k.keyword')})",
    "dotted": "contains('.' || lower(p.category_code) || '.', '.' || lower(k.keyword) || '.')",
    "token": "list_contains(regexp_split_to_array(lower(coalesce(p.category_code, '')), '[^a-z0-9]+'), k.keyword)",
    "segment": r"regexp_matches(p.category_code, '(^|\.)' || k.keyword || '(\.|$)', 'i')",
    "contains": "contains(p.category_code, k.keyword)",
}


def _search(match: str, keywords: list[str] = KEYWORDS) -> str:
    return _sql(
        f"""
SELECT keyword, product_sk, product_id, category_sk, category_code, brand,
       CAST(round(last_known_price, 2) AS DOUBLE) AS price, buy_count AS global_purchases
FROM (SELECT k.keyword, p.*, row_number() OVER (PARTITION BY k.keyword ORDER BY p.buy_count DESC, p.product_sk) AS rn
      FROM {_keyword_list(keywords)} JOIN rated p ON {_MATCH[match]}) t
WHERE rn <= 5""",
        "rated",
    )


# ── cleaning ────────────────────────────────────────────────────────────────────────────────────


def _norm(c: str) -> str:
    return f"lower(trim({c}))"


def _flag(c: str) -> str:
    return f"CASE WHEN {_norm(c)} IN ('t', 'true', '1') THEN TRUE WHEN {_norm(c)} IN ('f', 'false', '0') THEN FALSE END"


def _time(c: str) -> str:
    """UTC time of a text without zone, or with an offset of hours and minutes; any other zone gives NULL."""
    offset = f"regexp_extract(trim({c}), '([+-])(\\d\\d):(\\d\\d)$'"
    minutes = f"CASE {offset}, 1) WHEN '' THEN 0 ELSE CAST({offset}, 1) || '1' AS INT) * (CAST({offset}, 2) AS INT) * 60 + CAST({offset}, 3) AS INT)) END"
    plain = f"regexp_replace(trim({c}), '(UTC|Z|[+-]\\d\\d:\\d\\d)$', '')"
    return f"CASE WHEN regexp_matches({plain}, '[A-Za-z]{{2,}}') THEN NULL ELSE TRY_CAST(trim({plain}) AS TIMESTAMP) - to_minutes({minutes}) END"


def _whole(c: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({c}), '[+-]?\\d+(\\.0*)?') THEN TRY_CAST(TRY_CAST(trim({c}) AS DECIMAL(38,6)) AS BIGINT) END"


def _number(c: str) -> str:
    return f"TRY_CAST(trim({c}) AS DOUBLE)"


def _cleaned(table: str, conversions: dict[str, str]) -> str:
    return ", ".join(f"{conversions.get(c, c)} AS {c}" for c in RAW[table])


_CAMPAIGN = {
    "id": _whole("id"), "started_at": _time("started_at"), "finished_at": _time("finished_at"),
    "campaign_type": _norm("campaign_type"), "channel": _norm("channel"), "topic": _norm("topic"),
    "position": _norm("position"), "hour_limit": _number("hour_limit"), "subject_length": _number("subject_length"),
    "total_count": _whole("total_count"), **{c: _flag(c) for c in CAMPAIGN_FLAGS},
}
_MESSAGE = {
    **{c: _whole(c) for c in ("id", "campaign_id", "client_id", "user_id", "user_device_id")},
    "date": f"CAST({_time('date')} AS DATE)", **{c: _norm(c) for c in MESSAGE_LABELS},
    **{c: _time(c) for c in MESSAGE_TIMES}, **{c: _flag(c) for c in MESSAGE_FLAGS},
}

# The time without zone or offset, less the offset.
_OFFSET = r"'([+-])(\d\d):(\d\d)$'"
_UTC_TIME = rf"""CAST(regexp_replace(event_time, ' UTC$|[+-]\d\d:\d\d$', '') AS TIMESTAMP) - to_minutes(
  CASE regexp_extract(event_time, {_OFFSET}, 1) WHEN '' THEN 0 ELSE
  CAST(regexp_extract(event_time, {_OFFSET}, 1) || '1' AS INT) * (CAST(regexp_extract(event_time, {_OFFSET}, 2) AS INT) * 60
    + CAST(regexp_extract(event_time, {_OFFSET}, 3) AS INT)) END)"""

_CLEAN = {
    "cleaned_events": f"""
SELECT DISTINCT {_UTC_TIME} AS event_time, lower(trim(event_type)) AS event_type,
       CAST(product_id AS BIGINT) AS product_id, CAST(category_id AS BIGINT) AS category_id, trim(category_code) AS category_code,
       lower(trim(brand)) AS brand, TRY_CAST(price AS DOUBLE) AS price, CAST(user_id AS BIGINT) AS user_id,
       trim(user_session) AS user_session
FROM raw_events WHERE TRY_CAST(price AS DOUBLE) >= 0 AND product_id IS NOT NULL AND user_id IS NOT NULL""",
    "cleaned_campaigns": f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY id, campaign_type ORDER BY channel) AS rn
  FROM (SELECT {_cleaned("campaigns", _CAMPAIGN)} FROM raw_campaigns WHERE id IS NOT NULL AND campaign_type IS NOT NULL) t) u
WHERE rn = 1""",
    "cleaned_messages": f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY message_id) AS rn
  FROM (SELECT {_cleaned("messages", _MESSAGE)} FROM raw_messages
        WHERE trim(message_id) <> '' AND campaign_id IS NOT NULL AND message_type IS NOT NULL) t
  WHERE id IS NOT NULL) u
WHERE rn = 1""",
    "cleaned_friends": """
SELECT DISTINCT CAST(least(CAST(friend1 AS BIGINT), CAST(friend2 AS BIGINT)) AS BIGINT) AS friend1,
       greatest(CAST(friend1 AS BIGINT), CAST(friend2 AS BIGINT)) AS friend2
FROM raw_friends WHERE friend1 IS NOT NULL AND friend2 IS NOT NULL AND friend1 <> friend2""",
    "built_clients": """
SELECT client_id, user_id, user_device_id, first_purchase_date FROM (
  SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY source, user_id NULLS LAST, user_device_id NULLS LAST) AS rn
  FROM (SELECT 0 AS source, CAST(client_id AS BIGINT) AS client_id, CAST(user_id AS BIGINT) AS user_id,
               CAST(user_device_id AS BIGINT) AS user_device_id, CAST(first_purchase_date AS DATE) AS first_purchase_date
        FROM raw_client_first_purchase_date
        UNION ALL
        SELECT 1, client_id, user_id, user_device_id, NULL FROM cleaned_messages WHERE client_id IS NOT NULL) t) u
WHERE rn = 1""",
}


def _clean_sql(query: str, *views: str) -> str:
    return _sql(query, *views, **_CLEAN)


def _audit() -> str:
    parts = [
        f"SELECT '{t}' AS \"table\", raw, cleaned, raw - cleaned AS dropped FROM "
        f"(SELECT (SELECT count(*) FROM raw_{t}) AS raw, (SELECT count(*) FROM cleaned_{t}) AS cleaned) {t}_counts"
        for t in ("events", "campaigns", "messages", "friends")
    ]
    names = [f"{kind}_{t}" for t in ("events", "campaigns", "messages", "friends") for kind in ("raw", "cleaned")]
    return _clean_sql("\nUNION ALL ".join(parts), *names)


# ── models ──────────────────────────────────────────────────────────────────────────────────────


def _counted(tables: dict[str, str], *views: str) -> str:
    return _sql("\nUNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {t}" for n, t in tables.items()), *views)


_EVENT_ORDER = """row_number() OVER (ORDER BY event_time, user_id, product_sk, event_type, product_id, category_id,
                          category_code NULLS LAST, brand NULLS LAST, price, user_session)"""
_EVENT_IDS = f"""
SELECT {_EVENT_ORDER} AS event_id,
       event_time, event_type, user_id, product_sk, CAST(price AS DOUBLE) AS price, user_session
FROM fx_keyed"""

_EDGES = {
    "BELONGS_TO": ("fx_clients", "client_id", "user_id"),
    "FRIENDS_WITH": ("fx_friends", "user_id_1", "user_id_2"),
    "IN_CATEGORY": ("fx_versions", "product_sk", "category_sk"),
    "HAD_EVENT": ("fx_keyed", "user_id", "product_sk"),
    "SENT_TO": ("resolved_messages WHERE client_id IS NOT NULL", "(campaign_id, message_type)", "client_id"),
}


def _edges() -> str:
    parts = [
        f"SELECT '{name}' AS name, count(*) AS n, count(DISTINCT {src}) AS sources, count(DISTINCT {dst}) AS targets FROM {table}"
        for name, (table, src, dst) in _EDGES.items()
    ]
    return _sql("\nUNION ALL ".join(parts), "fx_clients", "fx_friends", "fx_versions", "fx_keyed", "resolved_messages")


_MONTH = "CASE WHEN m BETWEEN '1994-01' AND '1996-12' THEN m ELSE 'outside' END"


def _events_between(start: str, stop: str) -> str:
    return _sql(
        f"""
SELECT event_id, event_time, event_type, product_sk, user_id, user_session, price, {_MONTH} AS event_month
FROM (SELECT *, strftime(event_time, '%Y-%m') AS m FROM numbered) t
WHERE event_time >= TIMESTAMP '{start}' AND event_time < TIMESTAMP '{stop}'""",
        "numbered",
        numbered=_EVENT_IDS,
    )


def _bad(constraint: str, count: str) -> str:
    return f"SELECT '{constraint}' AS \"constraint\", CAST(({count}) AS BIGINT) AS n_bad"


def _violations() -> str:
    tables = {
        "users": "known_users", "clients": "fx_clients", "categories": "fx_categories", "products": "fx_versions",
        "campaigns": "fx_campaigns", "messages": "fx_messages", "events": "numbered_events", "friendships": "fx_friends",
    }
    keys = {
        "users": ["user_id"], "clients": ["client_id"], "categories": ["category_sk"], "products": ["product_sk"],
        "campaigns": ["campaign_id", "campaign_type"], "messages": ["id"], "events": ["event_id"],
        "friendships": ["user_id_1", "user_id_2"],
    }
    required = {
        "clients": ["user_id"], "categories": ["category_id"], "products": ["product_id"],
        "messages": ["campaign_id", "message_type"], "events": ["event_time", "event_type"],
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

    def duplicates(table: str, cols: list[str]) -> str:
        listed = ", ".join(cols)
        given = " AND ".join(f"{c} IS NOT NULL" for c in cols)
        return f"SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM {table} WHERE {given} GROUP BY {listed}) g"

    parts = [_bad(f"{t} primary key", duplicates(tables[t], k)) for t, k in keys.items()]
    parts += [
        _bad(f"{t}.{c} not null", f"SELECT count(*) FROM {tables[t]} WHERE {c} IS NULL")
        for t, k in keys.items()
        for c in [*k, *required.get(t, [])]
    ]
    for child, cols, parent, parent_cols in parents:
        given = " AND ".join(f"c.{c} IS NOT NULL" for c in cols)
        same = " AND ".join(f"p.{p} = c.{c}" for c, p in zip(cols, parent_cols))
        orphans = f"SELECT count(*) FROM {tables[child]} c WHERE {given} AND NOT EXISTS (SELECT 1 FROM {tables[parent]} p WHERE {same})"
        parts.append(_bad(f"{child}.{'+'.join(cols)} in {parent}", orphans))
    parts += [
        _bad("clients unique user and device", duplicates("fx_clients", ["user_id", "user_device_id"])),
        _bad("categories unique id and code", duplicates("fx_categories", ["category_id", "category_code"])),
        _bad("friendships lower user first", "SELECT count(*) FROM fx_friends WHERE NOT user_id_1 < user_id_2"),
        _bad("messages unique message_id", duplicates("fx_messages", ["message_id"])),
    ]
    return _sql(
        "\nUNION ALL ".join(parts),
        *tables.values(),
        known_users="SELECT DISTINCT user_id FROM fx_clients",
        numbered_events=_EVENT_IDS,
    )


def _consistency() -> str:
    conversion = "SELECT DISTINCT campaign_id, message_type FROM resolved_messages"
    sizes = {
        "conversion": f"SELECT count(*) FROM ({conversion}) t",
        "client conversion": f"SELECT count(*) FROM ({conversion} WHERE client_id IS NOT NULL) t",
        "targeting": "SELECT count(DISTINCT s.user_id) FROM sides s JOIN resolved_buyers b ON b.user_id = s.friend_id",
        "recommend": f"SELECT count(*) {_AFTER_RANK}",
        "search": "SELECT sum(least(n, 5)) FROM (SELECT k.keyword, count(*) AS n "
        f"FROM {_KEYWORDS} JOIN rated p ON {_MATCH['contains']} GROUP BY k.keyword) t",
    }
    models = {
        "conversion": ["denormalised", "document"],
        "client conversion": ["graph"],
        **{q: ["denormalised", "document", "graph"] for q in ("targeting", "recommend", "search")},
    }
    parts = [
        f"SELECT '{q}' AS query, '{m}' AS model, CAST(({sizes[q]}) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_diff"
        for q in sizes
        for m in models[q]
    ]
    # One row of the result was changed on purpose: it is missing on one side and surplus on the other.
    parts.append(
        f"SELECT 'conversion' AS query, 'one row changed' AS model, CAST(({sizes['conversion']}) AS BIGINT) AS n_rows, CAST(2 AS BIGINT) AS n_diff"
    )
    return _sql(
        "\nUNION ALL ".join(parts),
        "resolved_messages", "resolved_buyers", "sides", "favourites", "best_products", "purchased", "rated",
    )


def _user_documents(parts: int) -> str:
    return _sql(
        f"""
SELECT coalesce(u.user_id, c.user_id, f.user_id) AS user_id, coalesce(u.part, c.part, f.part) AS part, clients, friends
FROM (SELECT user_id, 0 AS part FROM all_users) u
FULL JOIN (SELECT user_id, CAST(client_id % {parts} AS INT) AS part,
             string_agg(concat_ws(':', client_id, user_device_id, first_purchase_date), ',' ORDER BY client_id) AS clients
           FROM fx_clients GROUP BY 1, 2) c ON c.user_id = u.user_id AND c.part = u.part
FULL JOIN (SELECT user_id, CAST(friend_id % {parts} AS INT) AS part,
             string_agg(CAST(friend_id AS VARCHAR), ',' ORDER BY friend_id) AS friends
           FROM sides GROUP BY 1, 2) f ON f.user_id = coalesce(u.user_id, c.user_id) AND f.part = coalesce(u.part, c.part)""",
        "all_users",
        "fx_clients",
        "sides",
    )


ORACLE: dict[str, str] = {
    "campaign_conversion": _conversion(tail=_TOP_CAMPAIGNS),
    "campaign_conversion_require_client": _conversion("m.client_id IS NOT NULL", _TOP_CAMPAIGNS),
    "campaign_conversion_documents": _sql(
        f"""
SELECT campaign_id, message_type AS campaign_type, arg_min(channel, id) AS channel, {_COUNTS},
       CAST({_HALF_EVEN} AS DOUBLE) AS purchase_rate_pct
FROM resolved_messages GROUP BY campaign_id, message_type""",
        "resolved_messages",
    ),
    "campaign_conversion_graph": _conversion("m.client_id IS NOT NULL"),
    "targeting_score": _targeting("buyers", "ORDER BY total_score DESC, user_id LIMIT 20"),
    "targeting_score_wide": _targeting("message_buyers"),
    "targeting_score_with_self_only": _targeting("buyers", self_only=True),
    "targeting_score_documents": _targeting("resolved_buyers"),
    "targeting_score_graph": _targeting("resolved_buyers"),
    "category_affinity": _sql("SELECT * FROM affinity", "affinity"),
    "top_categories_per_user": _sql("SELECT * FROM favourites", "favourites"),
    "product_popularity": _sql("SELECT * FROM popularity", "popularity"),
    "top_products_per_category": _sql("SELECT category_sk, product_sk, product_id, buy_count FROM best_products", "best_products"),
    "recommend_top50": _after_rank("ORDER BY user_id, cat_score DESC, buy_count DESC, category_sk, product_sk LIMIT 50"),
    "recommend_after_rank": _after_rank(),
    "recommend_before_rank": _before_rank(),
    "recommend_wide": _after_rank(),
    "recommend_documents": _before_rank(),
    "recommend_graph": _before_rank(),
    "search_token": _search("token"),
    "search_segment": _search("segment"),
    "search_phrase": _search("phrase", PHRASES),
    "search_segment_any_case": _search("dotted", SEGMENTS),
    "search_contains": _search("contains"),
    "search_documents": _search("segment"),
    "search_graph": _search("contains"),
    **{f"clean_{t}": _clean_sql(f"SELECT * FROM cleaned_{t}", f"cleaned_{t}") for t in ("events", "campaigns", "friends")},
    "csv_events": _clean_sql("SELECT * FROM cleaned_events", "cleaned_events"),
    "csv_typed": _clean_sql("SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM cleaned_messages", "cleaned_messages"),
    "csv_subset": _clean_sql("SELECT user_id, price, event_time, event_type FROM cleaned_events", "cleaned_events"),
    "csv_messages": _clean_sql("SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM cleaned_messages", "cleaned_messages"),
    "clean_messages": _clean_sql("SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM cleaned_messages", "cleaned_messages"),
    "clean_audit": _audit(),
    "clean_messages_integrity": _clean_sql(
        """
SELECT campaign_id, message_type, count(*) AS n FROM cleaned_messages m
WHERE EXISTS (SELECT 1 FROM cleaned_campaigns c WHERE c.id = m.campaign_id AND c.campaign_type = m.message_type)
GROUP BY campaign_id, message_type""",
        "cleaned_messages",
        "cleaned_campaigns",
    ),
    "build_clients": _clean_sql(
        "SELECT * REPLACE (CAST(first_purchase_date AS VARCHAR) AS first_purchase_date) FROM built_clients", "built_clients"
    ),
    "build_users": _clean_sql(
        """
SELECT user_id FROM (SELECT user_id FROM cleaned_events UNION SELECT user_id FROM built_clients
                     UNION SELECT friend1 FROM cleaned_friends UNION SELECT friend2 FROM cleaned_friends) t
WHERE user_id IS NOT NULL""",
        "cleaned_events",
        "built_clients",
        "cleaned_friends",
    ),
    "dim_categories": _sql("SELECT * FROM fx_categories", "fx_categories"),
    "dim_products": _sql(
        "SELECT product_sk, product_id, category_sk, brand, CAST(last_known_price AS DOUBLE) AS last_known_price FROM fx_versions",
        "fx_versions",
    ),
    "events_keyed": _sql(
        "SELECT event_time, event_type, user_id, CAST(price AS DOUBLE) AS price, product_sk FROM fx_keyed", "fx_keyed"
    ),
    "events_null_keys": _sql(
        """
SELECT count(*) FILTER (WHERE product_sk IS NULL) AS product_sk, count(*) FILTER (WHERE category_code IS NULL) AS category_code,
       count(*) FILTER (WHERE brand IS NULL) AS brand FROM fx_keyed""",
        "fx_keyed",
    ),
    "messages_integrity": _sql(
        """
SELECT id, campaign_id, message_type FROM fx_messages m
WHERE EXISTS (SELECT 1 FROM fx_campaigns c WHERE c.campaign_id = m.campaign_id AND c.campaign_type = m.message_type)""",
        "fx_messages",
        "fx_campaigns",
    ),
    "events_fk_filter": _sql(
        """
SELECT user_id, product_sk, count(*) AS n FROM fx_keyed
WHERE user_id IN (SELECT user_id FROM sides) AND product_sk IN (SELECT product_sk FROM popularity)
GROUP BY user_id, product_sk""",
        "fx_keyed",
        "sides",
        "popularity",
    ),
    "messages_client_fk": _sql(
        "SELECT id, client_id FROM fx_messages WHERE client_id IS NULL OR client_id IN (SELECT client_id FROM raw_first_purchase)",
        "fx_messages",
        "raw_first_purchase",
    ),
    "doc_users": _user_documents(17),
    "doc_users_parts": _user_documents(3),
    "doc_products": _sql(
        """
SELECT product_sk, product_id, category_id, category_code, brand, CAST(last_known_price AS DOUBLE) AS last_known_price
FROM fx_versions""",
        "fx_versions",
    ),
    "doc_campaigns": _sql("SELECT campaign_id, campaign_type, channel FROM fx_campaigns", "fx_campaigns"),
    "doc_messages": _sql("SELECT * FROM resolved_messages", "resolved_messages"),
    "doc_events": _sql(_EVENT_IDS, "fx_keyed"),
    "graph_vertices_summary": _counted(
        {"User": "all_users", "Client": "fx_clients", "Category": "fx_categories", "Product": "fx_versions", "Campaign": "fx_campaigns"},
        "all_users", "fx_clients", "fx_categories", "fx_versions", "fx_campaigns",
    ),
    "graph_edges_summary": _edges(),
    "graph_had_event": _sql(
        "SELECT user_id AS src, product_sk AS dst, event_type, event_time, CAST(price AS DOUBLE) AS price, user_session FROM fx_keyed", "fx_keyed"
    ),
    "graph_belongs_to": _sql("SELECT client_id AS src, user_id AS dst FROM fx_clients", "fx_clients"),
    "graph_friends_with": _sql("SELECT user_id_1 AS src, user_id_2 AS dst FROM fx_friends", "fx_friends"),
    "graph_in_category": _sql("SELECT product_sk AS src, category_sk AS dst FROM fx_versions", "fx_versions"),
    "graph_vertices_user": _sql("SELECT user_id FROM all_users", "all_users"),
    "graph_vertices_client": _sql(
        "SELECT client_id, user_device_id, CAST(first_purchase_date AS VARCHAR) AS first_purchase_date FROM fx_clients", "fx_clients"
    ),
    "graph_vertices_category": _sql("SELECT category_sk, category_id, category_code FROM fx_categories", "fx_categories"),
    "graph_vertices_product": _sql(
        "SELECT product_sk, product_id, brand, CAST(last_known_price AS DOUBLE) AS last_known_price FROM fx_versions", "fx_versions"
    ),
    "graph_vertices_campaign": _sql("SELECT campaign_id, campaign_type, channel FROM fx_campaigns", "fx_campaigns"),
    "graph_sent_to": _sql(
        """
SELECT campaign_id, message_type AS campaign_type, client_id, id, is_opened, is_purchased
FROM resolved_messages WHERE client_id IS NOT NULL""",
        "resolved_messages",
    ),
    "graph_constraint_violations": _sql(
        "\nUNION ALL ".join(
            _bad(f"{label} unique {key}", f"SELECT count({key}) - count(DISTINCT {key}) FROM {table}")
            for label, key, table in [
                ("User", "user_id", "all_users"), ("Client", "client_id", "fx_clients"),
                ("Product", "product_sk", "fx_versions"), ("Category", "category_sk", "fx_categories"),
            ]
        ),
        "all_users", "fx_clients", "fx_versions", "fx_categories",
    ),
    "graph_violations_found": _sql(
        "SELECT 'User unique user_id' AS constraint, count(*) AS n_bad FROM all_users WHERE user_id % 10 = 0", "all_users"
    ),
    "load_audit": _sql(
        """
SELECT 'messages' AS "table", 'campaign_id+message_type' AS key, count(*) AS n_rows,
       count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM fx_campaigns c WHERE c.campaign_id = m.campaign_id AND c.campaign_type = m.message_type)) AS dropped
FROM fx_messages m
UNION ALL
SELECT 'messages', 'client_id', count(*), count(*) FILTER (WHERE client_id IS NOT NULL AND client_id NOT IN (SELECT client_id FROM raw_first_purchase))
FROM resolved_messages
UNION ALL
SELECT 'events', 'user_id', count(*), count(*) FILTER (WHERE user_id NOT IN (SELECT user_id FROM sides)) FROM fx_keyed
UNION ALL
SELECT 'events', 'product_sk', count(*), count(*) FILTER (WHERE product_sk NOT IN (SELECT product_sk FROM popularity))
FROM fx_keyed WHERE user_id IN (SELECT user_id FROM sides)
UNION ALL
SELECT 'friendships', 'user_id_1', count(*), CAST(0 AS BIGINT) FROM fx_friends
UNION ALL
SELECT 'friendships', 'user_id_2', count(*), CAST(0 AS BIGINT) FROM fx_friends""",
        "fx_messages", "fx_campaigns", "raw_first_purchase", "resolved_messages", "fx_keyed", "sides", "popularity", "fx_friends",
    ),
    "wide_events": _sql(
        """
SELECT n.*, e.product_id, e.brand, e.category_id, e.category_code, e.category_sk, strftime(n.event_time, '%Y-%m') AS event_month
FROM numbered n JOIN ordered e USING (event_id)""",
        "numbered", "ordered",
        numbered=_EVENT_IDS,
        ordered=f"SELECT {_EVENT_ORDER} AS event_id, * FROM fx_keyed",
    ),
    "wide_messages": _sql("SELECT * FROM resolved_messages", "resolved_messages"),
    "table_counts": _counted(
        {
            "users": "all_users", "clients": "fx_clients", "categories": "fx_categories", "products": "fx_versions",
            "campaigns": "fx_campaigns", "messages": "resolved_messages", "events": "fx_keyed", "friendships": "fx_friends",
        },
        "all_users", "fx_clients", "fx_categories", "fx_versions", "fx_campaigns", "resolved_messages", "fx_keyed", "fx_friends",
    ),
    "events_by_month": _sql(
        "SELECT strftime(event_time, '%Y-%m') AS event_month, count(*) AS n FROM fx_events GROUP BY 1", "fx_events"
    ),
    "events_one_month": _events_between("1995-03-01", "1995-04-01"),
    "events_across_bounds": _events_between("1996-12-10 12:00:00", "1997-01-20"),
    "events_in_and_outside_months": _sql(
        f"SELECT {_MONTH} AS event_month, count(*) AS n FROM (SELECT strftime(event_time, '%Y-%m') AS m FROM fx_events) t GROUP BY 1", "fx_events"
    ),
    "publish_twice": _counted(
        {"clients": "fx_clients", "categories": "fx_categories", "products": "fx_versions", "events": "fx_keyed", "friends": "fx_friends"},
        "fx_clients", "fx_categories", "fx_versions", "fx_keyed", "fx_friends",
    ),
    "constraint_violations": _violations(),
    "model_consistency": _consistency(),
}
