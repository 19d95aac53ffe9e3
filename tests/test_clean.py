import datetime as dt

import pytest
from pyspark.sql import functions as F

from tradewind.plans.clean import clean_campaigns, clean_events, clean_first_purchases, clean_friends, clean_messages
from tradewind.plans.dimensions import assign_keys, build_clients, build_users, enforce_campaigns
from tradewind.schemas import RAW


def raw(spark, table, *records):
    """Raw rows with the columns of ``table``; those not given are NULL."""
    schema = ", ".join(f"{c} string" for c in RAW[table])
    return spark.createDataFrame([tuple(r.get(c) for c in RAW[table]) for r in records], schema)


EVENT = {
    "event_time": "2019-10-01 00:00:00 UTC", "event_type": " View", "product_id": "5", "category_id": "7",
    "category_code": " A.b ", "brand": " ACME ", "price": "1.50", "user_id": "3", "user_session": " s ",
}


def test_clean_events(spark, rows):
    records = [
        EVENT,
        {**EVENT, "event_type": "VIEW "},  # the same after cleaning
        {**EVENT, "price": "0"},
        {**EVENT, "price": "-0.01"},
        {**EVENT, "price": "free"},
        {**EVENT, "price": "nan"},
        {**EVENT, "price": None},
        {**EVENT, "user_id": None},
        {**EVENT, "product_id": None},
        {**EVENT, "event_type": "Return", "brand": None, "category_code": None, "user_session": None},
    ]
    clean, audit = clean_events(raw(spark, "events", *records))
    time = dt.datetime(2019, 10, 1)
    assert rows(clean, *RAW["events"]) == sorted(
        [
            (time, "view", 5, 7, "A.b", "acme", 1.5, 3, "s"),
            (time, "view", 5, 7, "A.b", "acme", 0.0, 3, "s"),
            (time, "return", 5, 7, None, None, 1.5, 3, None),
        ],
        key=repr,
    )
    assert rows(audit) == [("events", 10, 3, 7)]


@pytest.mark.parametrize("bad", [{"category_id": None}, {"category_id": "x"}, {"event_time": "noon UTC"}, {"user_id": "me"}])
def test_clean_events_fails_on_what_must_be_right(spark, bad):
    with pytest.raises(Exception, match="bad value in"):
        clean_events(raw(spark, "events", {**EVENT, **bad}))[0].collect()


def test_a_bad_category_does_not_matter_in_a_dropped_event(spark):
    assert clean_events(raw(spark, "events", {**EVENT, "category_id": "x", "price": "-1"}))[0].count() == 0


def test_clean_campaigns(spark, rows):
    records = [
        {"id": "1", "campaign_type": " Bulk", "channel": " SMS", "started_at": "2021-04-30 07:22:36.615023", "total_count": "146.0", "is_test": "t"},
        {"id": "1", "campaign_type": "bulk ", "channel": "Email"},
        {"id": None, "campaign_type": "bulk"},
        {"id": "2", "campaign_type": None},
        {"id": "2", "campaign_type": "trigger", "hour_limit": "x", "finished_at": "never", "ab_test": "maybe", "position": " TOP"},
    ]
    clean, audit = clean_campaigns(raw(spark, "campaigns", *records))
    shown = ["id", "campaign_type", "channel", "started_at", "finished_at", "total_count", "hour_limit", "ab_test", "is_test", "position"]
    assert rows(clean, *shown) == [
        (1, "bulk", "email", None, None, None, None, None, None, None),
        (2, "trigger", None, None, None, None, None, None, None, "top"),
    ]
    assert rows(audit) == [("campaigns", 5, 2, 3)]
    first, _ = clean_campaigns(raw(spark, "campaigns", records[0]))
    assert rows(first, *shown) == [(1, "bulk", "sms", dt.datetime(2021, 4, 30, 7, 22, 36, 615023), None, 146, None, None, True, None)]


MESSAGE = {"id": "1", "message_id": "m1", "campaign_id": "4", "message_type": " BULK", "is_opened": "t", "is_clicked": "f"}


def test_clean_messages(spark, rows):
    records = [
        {**MESSAGE, "client_id": "1515915625489833514", "user_id": "oops", "date": "2021-04-30", "sent_at": "later"},
        {**MESSAGE, "message_id": "m0", "client_id": None},
        {**MESSAGE, "id": "x"},
        {**MESSAGE, "id": None},
        {**MESSAGE, "id": "2", "message_id": " \t "},
        {**MESSAGE, "id": "3", "message_id": None},
        {**MESSAGE, "id": "4", "campaign_id": None},
        {**MESSAGE, "id": "5", "message_type": None},
        {**MESSAGE, "id": "6.0", "client_id": "1515915625489833514.0", "date": "2021-04-30 10:00:00", "is_opened": None},
    ]
    clean, audit = clean_messages(raw(spark, "messages", *records))
    assert rows(clean, "id", "message_id", "campaign_id", "message_type", "client_id", "date", "is_opened", "is_clicked") == [
        (1, "m0", 4, "bulk", None, None, True, False),
        (6, "m1", 4, "bulk", 1515915625489833514, dt.date(2021, 4, 30), None, False),
    ]
    assert rows(audit) == [("messages", 9, 2, 7)]
    with pytest.raises(Exception, match="bad value in campaign_id"):
        clean_messages(raw(spark, "messages", {**MESSAGE, "campaign_id": "x"}))[0].collect()


def test_clean_friends(spark, rows):
    pairs = [("2", "1"), ("1", "2"), ("1", "1"), ("3", None), (None, "3"), ("10", "9")]
    clean, audit = clean_friends(raw(spark, "friends", *[{"friend1": a, "friend2": b} for a, b in pairs]))
    assert rows(clean) == [(1, 2), (9, 10)]
    assert rows(audit) == [("friends", 6, 2, 4)]


def test_rows_that_are_dropped_never_fail_wherever_spark_moves_the_filters(spark, rows):
    """The raw pairs come from a join, below which each side's conversion may be moved."""
    left = spark.createDataFrame([(1, "5"), (2, None), (3, "7"), (4, "8")], "k int, friend1 string")
    right = spark.createDataFrame([(1, "9"), (2, "bad"), (3, None), (4, "8")], "k int, friend2 string")
    clean, audit = clean_friends(left.join(right, "k").select("friend1", "friend2"))
    assert rows(clean.filter("friend1 > 0 and friend2 > 0")) == [(5, 9)]
    assert rows(audit) == [("friends", 4, 1, 3)]
    users = build_users(clean.select(F.col("friend1").alias("user_id")), clean.select(F.col("friend2").alias("user_id")), clean)
    assert rows(users) == [(5,), (9,)]


def test_a_first_purchase_wins_over_a_recipient_row(spark, rows):
    messages = spark.createDataFrame([(1, 10, 0), (1, 10, 0), (2, 20, None), (None, 30, 0), (3, 31, 1), (3, 30, 2)], "client_id bigint, user_id bigint, user_device_id bigint")
    first = clean_first_purchases(
        raw(
            spark, "client_first_purchase_date",
            {"client_id": "1", "user_id": "99", "first_purchase_date": "2020-01-02"},
            {"client_id": "7", "user_id": "70", "user_device_id": "4", "first_purchase_date": "?"},
        )
    )
    clients = build_clients(messages, first)
    assert clients.columns == ["client_id", "user_id", "user_device_id", "first_purchase_date"]
    assert rows(clients) == [
        (1, 99, None, dt.date(2020, 1, 2)), (2, 20, None, None), (3, 30, 2, None), (7, 70, 4, None),
    ]


def test_users_come_from_events_clients_and_friends(spark, rows):
    events = spark.createDataFrame([(1,), (1,)], "user_id bigint")
    clients = spark.createDataFrame([(2,), (None,)], "user_id bigint")
    friends = spark.createDataFrame([(3, 4), (1, 3)], "friend1 bigint, friend2 bigint")
    assert rows(build_users(events, clients, friends)) == [(1,), (2,), (3,), (4,)]


def test_messages_of_unknown_campaigns_are_dropped(spark, rows):
    messages = spark.createDataFrame([(1, 4, "bulk"), (2, 4, "trigger"), (3, 5, "bulk")], "id bigint, campaign_id bigint, message_type string")
    campaigns = spark.createDataFrame([(4, "bulk"), (6, "bulk")], "id bigint, campaign_type string")
    assert rows(enforce_campaigns(messages, campaigns), "id") == [(1,)]


def test_versions_keep_the_category_of_their_time(spark, rows):
    t = [dt.datetime(2019, 10, d) for d in range(1, 8)]
    data = [
        (t[0], 5, 7, "a", "old", 1.0), (t[2], 5, 7, "a", None, 3.0), (t[1], 5, 7, "a", "new", 2.0),
        (t[3], 5, 7, None, None, 4.0), (t[4], 5, 6, "z", "b", 5.0), (t[4], 5, 6, "z", "c", 4.5), (t[0], 4, 7, None, None, 9.0),
    ]
    events = spark.createDataFrame(
        data, "event_time timestamp_ntz, product_id bigint, category_id bigint, category_code string, brand string, price double"
    )
    categories, products, keyed = assign_keys(events)
    # A missing code sorts last and is a category of its own.
    assert rows(categories) == [(1, 6, "z"), (2, 7, "a"), (3, 7, None)]
    # The last known brand skips events without one; equal times take the greater value.
    assert rows(products) == [(1, 4, 3, None, 9.0), (2, 5, 1, "c", 5.0), (3, 5, 2, "new", 3.0), (4, 5, 3, None, 4.0)]
    assert rows(keyed, "product_id", "price", "product_sk") == sorted(
        [(5, 1.0, 3), (5, 3.0, 3), (5, 2.0, 3), (5, 4.0, 4), (5, 5.0, 2), (5, 4.5, 2), (4, 9.0, 1)], key=repr
    )


def test_a_conversion_of_many_columns_is_written_once(spark, settings):
    """thirteen times and eight flags share one conversion each, so that the row's code stays short."""
    from tradewind.plans.clean import clean_messages
    from tradewind.schemas import RAW

    given = {"id": "1", "message_id": "m", "campaign_id": "2", "message_type": " A ", "sent_at": "2021-04-30 07:22:36.5", "opened_first_time_at": "2021-04-30T02:00:00+05:30",
             "blocked_at": "2021-04", "updated_at": "2021-4-3 1:00 UTC", "created_at": "soon", "is_opened": " T", "is_clicked": "FALSE", "is_blocked": "maybe"}
    raw = spark.createDataFrame([[given.get(c) for c in RAW["messages"]]], ", ".join(f"{c} string" for c in RAW["messages"]))
    clean, _ = clean_messages(raw)
    settings(spark__sql__debug__maxToStringFields="1000")
    plan = clean._jdf.queryExecution().analyzed().toString()
    assert plan.count("transform(array(") == 4  # whole numbers, labels, times, flags
    row = clean.collect()[0]
    texts = {c: str(row[c]) for c in given}
    assert texts == {"id": "1", "message_id": "m", "campaign_id": "2", "message_type": "a", "sent_at": "2021-04-30 07:22:36.500000", "opened_first_time_at": "2021-04-29 20:30:00",
                     "blocked_at": "2021-04-01 00:00:00", "updated_at": "2021-04-03 01:00:00", "created_at": "None", "is_opened": "True", "is_clicked": "False", "is_blocked": "None"}
    assert clean.columns == RAW["messages"]
