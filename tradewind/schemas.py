"""Columns of the raw files and of the cleaned tables.

Fixed values: names and order are those of the files and models that users already have.
"""

CAMPAIGN_FLAGS = [
    "ab_test", "warmup_mode", "subject_with_personalization", "subject_with_deadline", "subject_with_emoji",
    "subject_with_bonuses", "subject_with_discount", "subject_with_saleout", "is_test",
]

MESSAGE_FLAGS = [
    "is_opened", "is_clicked", "is_purchased", "is_unsubscribed", "is_hard_bounced", "is_soft_bounced",
    "is_complained", "is_blocked",
]

MESSAGE_TIMES = [
    "sent_at", "opened_first_time_at", "opened_last_time_at", "clicked_first_time_at", "clicked_last_time_at",
    "purchased_at", "unsubscribed_at", "hard_bounced_at", "soft_bounced_at", "complained_at", "blocked_at",
    "created_at", "updated_at",
]

MESSAGE_LABELS = ["message_type", "channel", "category", "platform", "email_provider", "stream"]

# Raw files: every column is text.
RAW = {
    "events": [
        "event_time", "event_type", "product_id", "category_id", "category_code", "brand", "price", "user_id",
        "user_session",
    ],
    "campaigns": [
        "id", "campaign_type", "channel", "topic", "started_at", "finished_at", "total_count", "ab_test",
        "warmup_mode", "hour_limit", "subject_length", "subject_with_personalization", "subject_with_deadline",
        "subject_with_emoji", "subject_with_bonuses", "subject_with_discount", "subject_with_saleout", "is_test",
        "position",
    ],
    "messages": [
        "id", "message_id", "campaign_id", "message_type", "client_id", "user_id", "user_device_id", "channel",
        "category", "platform", "email_provider", "stream", "date", "sent_at", "is_opened", "opened_first_time_at",
        "opened_last_time_at", "is_clicked", "clicked_first_time_at", "clicked_last_time_at", "is_unsubscribed",
        "unsubscribed_at", "is_hard_bounced", "hard_bounced_at", "is_soft_bounced", "soft_bounced_at",
        "is_complained", "complained_at", "is_blocked", "blocked_at", "is_purchased", "purchased_at", "created_at",
        "updated_at",
    ],
    "client_first_purchase_date": ["client_id", "first_purchase_date", "user_id", "user_device_id"],
    "friends": ["friend1", "friend2"],
}


def _typed(columns: list[str], types: dict[str, str]) -> str:
    return ", ".join(f"{c} {types.get(c, 'string')}" for c in columns)


_CAMPAIGN_TYPES = {
    "id": "bigint", "started_at": "timestamp_ntz", "finished_at": "timestamp_ntz", "total_count": "bigint",
    "hour_limit": "double", "subject_length": "double", **dict.fromkeys(CAMPAIGN_FLAGS, "boolean"),
}
_MESSAGE_TYPES = {
    "id": "bigint", "campaign_id": "bigint", "client_id": "bigint", "user_id": "bigint",
    "user_device_id": "bigint", "date": "date", **dict.fromkeys(MESSAGE_FLAGS, "boolean"),
    **dict.fromkeys(MESSAGE_TIMES, "timestamp_ntz"),
}
_EVENT_TYPES = {
    "event_time": "timestamp_ntz", "product_id": "bigint", "category_id": "bigint", "price": "double",
    "user_id": "bigint", "product_sk": "bigint", "category_sk": "bigint",
}

# Cleaned tables, as DDL strings.
CLEAN = {
    "events": _typed([*RAW["events"], "product_sk", "category_sk"], _EVENT_TYPES),
    "campaigns": _typed(RAW["campaigns"], _CAMPAIGN_TYPES),
    "messages": _typed(RAW["messages"], _MESSAGE_TYPES),
    "clients": "client_id bigint, user_id bigint, user_device_id bigint, first_purchase_date date",
    "friends": "friend1 bigint, friend2 bigint",
    "categories": "category_sk bigint, category_id bigint, category_code string",
    "products": "product_sk bigint, product_id bigint, category_sk bigint, brand string, last_known_price double",
    "users": "user_id bigint",
}

# Columns of the relational models, in order. Columns that a source lacks are left out on load.
CAMPAIGN_COLUMNS = ["campaign_id", *[c for c in RAW["campaigns"] if c != "id"]]
MESSAGE_COLUMNS = [
    "id", "message_id", "campaign_id", "message_type", "client_id", "channel", "platform", "email_provider",
    "stream", "date", "sent_at", "is_opened", "opened_first_time_at", "opened_last_time_at", "is_clicked",
    "clicked_first_time_at", "clicked_last_time_at", "is_purchased", "purchased_at", "is_unsubscribed",
    "unsubscribed_at", "is_hard_bounced", "hard_bounced_at", "is_soft_bounced", "soft_bounced_at",
    "is_complained", "complained_at", "is_blocked", "blocked_at", "created_at", "updated_at",
]
EVENT_COLUMNS = ["event_id", "event_time", "event_type", "product_sk", "user_id", "user_session", "price"]
