import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from tradewind.__main__ import main
from tradewind.operators.constraints import violations
from tradewind.operators.quality import diff
from tradewind.operators.storage import shared_folder
from tradewind.plans import models
from tradewind.plans.analyses import ANALYSES, analyse
from tradewind.plans.load import MODELS, clean_dataset, load_models, read_model, tables_of
from tradewind.schemas import CLEAN, EVENT_COLUMNS, MESSAGE_COLUMNS, RAW
from tradewind.sources.csv import NO_VALUE, read_clean_csv, read_csv, read_typed_csv
from tradewind.sources.months import between
from tradewind.sources.tables import current, publication, published, read_clean, read_tables
from tradewind.sources.testdata import KEYWORDS, view

SF = "/root/testdata/sf0.001"


def models_of(spark, folder):
    return current(spark, f"{folder}/models")


def stored_tables(spark):
    folder = f"{shared_folder(spark)}/tables"
    return sorted(os.listdir(folder)) if os.path.isdir(folder) else []


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """The raw views as CSV files, cleaned and loaded."""
    folder = tmp_path_factory.mktemp("shop")
    for name in RAW:
        view(spark, SF, f"raw_{name}").write.csv(f"{folder}/raw/{name}.csv", header=True, escape='"')
    left = stored_tables(spark)
    audit = clean_dataset(spark, f"{folder}/raw", f"{folder}/clean").collect()
    assert stored_tables(spark) == left
    before = stored_tables(spark)
    report = load_models(spark, f"{folder}/clean", f"{folder}/models").collect()
    assert stored_tables(spark) == before
    assert {r["key"] for r in report if r["table"] == "messages"} == {"campaign_id+message_type", "client_id", "rows"}
    assert all(r["dropped"] >= 0 for r in report) and len(report) == 6 + 8
    return folder, {r.table: r for r in audit}


def test_csv_columns_are_found_by_name_and_marked_values_are_null(spark, tmp_path, rows):
    path = str(tmp_path / "x.csv")
    with open(path, "w") as f:
        f.write('b,a,unused\n"x ""y"", z",t,1\nN/A,007,2\n"",null,3\n')
    assert rows(read_csv(spark, path, ["a", "b"])) == sorted([("t", 'x "y", z'), ("007", None), (None, None)], key=repr)
    assert "" in NO_VALUE


def test_typed_csv(spark, tmp_path, rows):
    path = str(tmp_path / "x.csv")
    with open(path, "w") as f:
        f.write("t,n,f,d,x,s\n2019-10-01 00:00:05+00:00,146.0,True,2020-01-02,1.5,007\n,,,,,\n")
    schema = "n bigint, t timestamp_ntz, f boolean, d date, x double, s string"
    assert rows(read_typed_csv(spark, path, schema)) == [
        (146, dt.datetime(2019, 10, 1, 0, 0, 5), True, dt.date(2020, 1, 2), 1.5, "007"),
        (None,) * 6,
    ]
    assert rows(read_typed_csv(spark, path, schema, ["s", "n"])) == sorted([("007", 146), (None, None)], key=repr)


def test_a_subset_makes_no_other_columns(spark, tmp_path, rows):
    path = tmp_path / "x.csv"
    path.write_text("a,b,c,d\n1,2,3,4\n5,6,7,8\n")
    some = read_typed_csv(spark, str(path), "a bigint, b string, c bigint, d double", ["d", "a"])
    assert rows(some) == [(4.0, 1), (8.0, 5)] and some.dtypes == [("d", "double"), ("a", "bigint")]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<a:string,d:string,_malformed:string>" in plan
    path.write_text("a,b,c,d\n1,2,3,4\n5,6,7\n")
    subset = read_typed_csv(spark, str(path), "a bigint, b string, c bigint, d double", ["a"])
    for unread in (subset.count, subset.collect):
        with pytest.raises(Exception, match="malformed row"):
            unread()


def test_malformed_rows_fail_the_job(spark, tmp_path):
    for i, row in enumerate(("1,2,3", "1", '"a\nb",2')):
        path = tmp_path / f"{i}.csv"
        path.write_text(f"x,y\n1,2\n{row}\n")
        with pytest.raises(Exception, match="(?i)malformed"):
            read_csv(spark, str(path), ["x"]).collect()
    assert {r.x for r in read_csv(spark, str(path), ["x"], multi_line=True).collect()} == {"1", "a\nb"}


def test_files_of_one_folder_must_have_one_header(spark, tmp_path):
    for name, header in (("a", "x,y"), ("b", "y,x")):
        (tmp_path / f"{name}.csv").write_text(f"{header}\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, str(tmp_path), ["x", "y"]).collect()


def test_cleaned_tables_survive_a_trip_through_csv(spark, shop, tmp_path):
    folder, _ = shop
    clean = read_clean(spark, f"{folder}/clean")
    for name, df in clean.items():
        writer = df.write.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
        writer.csv(f"{tmp_path}/{name}.csv", header=True, escape='"')
    for name, df in read_clean_csv(spark, str(tmp_path)).items():
        expected = clean[name].drop("category_sk") if name == "events" else clean[name]
        assert df.dtypes == expected.dtypes
        assert diff(df, expected).count() == 0, name


def test_cleaning_run_writes_typed_tables_and_an_audit(spark, shop):
    folder, audit = shop
    clean = read_clean(spark, f"{folder}/clean")
    assert set(clean) == set(CLEAN)
    counts = {name: df.count() for name, df in clean.items()}
    assert all(counts.values())
    assert audit["events"].raw == audit["events"].cleaned + audit["events"].dropped
    assert audit["events"].cleaned == counts["events"] and audit["friends"].cleaned == counts["friends"]
    assert audit["messages with a known campaign"].cleaned == counts["messages"]
    assert clean["events"].filter("product_sk is null").count() == 0
    assert clean["categories"].agg(F.min("category_sk"), F.max("category_sk")).first() == (1, counts["categories"])


def test_stored_normalised_model_keeps_all_constraints(spark, shop, rows):
    folder, _ = shop
    m = read_tables(spark, f"{models_of(spark, folder)}/relational", ["users", "clients", "categories", "products", "campaigns", "messages", "events", "friendships"])
    bad = {c: n for c, n in rows(violations(m, models.constraints(m))) if n}
    # Several clients share a user and have no device, which is allowed; nothing else is off.
    assert set(bad) <= {"clients.user_id not null", "clients unique user and device"}
    assert m["events"].columns == [*EVENT_COLUMNS, "event_month"] and m["messages"].columns == MESSAGE_COLUMNS
    assert dict(m["events"].dtypes)["price"] == "decimal(10,2)" and dict(m["campaigns"].dtypes)["hour_limit"] == "bigint"
    n = m["events"].count()
    assert m["events"].agg(F.countDistinct("event_id"), F.min("event_id"), F.max("event_id")).first() == (n, 1, n)


def test_events_are_stored_by_month_and_read_by_month(spark, shop):
    folder, _ = shop
    path = f"{models_of(spark, folder)}/relational/events"
    months = {d.split("=")[1] for d in os.listdir(path) if "=" in d}
    events = spark.read.parquet(path)
    assert months == {r[0] for r in events.select(F.date_format("event_time", "yyyy-MM")).distinct().collect()}
    month = sorted(months)[0]
    files = events.filter(F.col("event_month") == month)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_month" in files
    # Half-open bounds: a month's first instant belongs to it.
    assert events.filter((F.col("event_month") == month) & (F.date_trunc("month", "event_time") != F.lit(month + "-01").cast("timestamp_ntz"))).count() == 0


def test_time_ranges_read_their_months_and_what_lies_outside(spark, shop, tmp_path, rows):
    folder, _ = shop
    times = ["1996-12-31 23:59:59.999999", "1997-01-01", "1997-01-31 23:59:59.999999", "1997-02-01", "1997-03-31 12:00:00", "1997-04-01", None]
    events = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id int, t string").selectExpr("id", "CAST(t AS TIMESTAMP_NTZ) AS event_time")
    laid = events.withColumn("event_month", models.month_of("event_time", ("1997-01", "1997-03")))
    assert rows(laid, "id", "event_month") == [(0, "outside"), (1, "1997-01"), (2, "1997-01"), (3, "1997-02"), (4, "1997-03"), (5, "outside"), (6, "outside")]
    laid.write.partitionBy("event_month").parquet(f"{tmp_path}/events")
    stored = spark.read.parquet(f"{tmp_path}/events")
    ids = lambda start, stop: [i for (i,) in rows(between(stored, start, stop), "id")]
    assert ids("1997-01-01", "1997-02-01") == [1, 2] and ids("1996-01-01", "1997-01-01") == [0] and ids("1997-03-31T12:00", "1998-01-01") == [4, 5]
    assert ids("1996-12-31T23:59:59.999999", "1997-02-01T00:00:00.000001") == [0, 1, 2, 3] and ids("1997-02-01", "1997-02-01") == []
    report = load_models(spark, f"{folder}/clean", str(tmp_path / "bounded"), ("relational",), months=("1994-01", "1995-12"))
    months = {d.split("=")[1] for d in os.listdir(f"{current(spark, str(tmp_path / 'bounded'))}/relational/events") if "=" in d}
    assert months and months <= {f"{y}-{m:02}" for y in (1994, 1995) for m in range(1, 13)} | {"outside"} and "outside" in months
    assert report.count() == 14


def test_one_month_reads_one_folder(spark):
    from registry.queries import QUERIES, stored_events

    query = QUERIES["events_one_month"](spark, SF)
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*event_month#\d+ >= 1995-03.*event_month#\d+ <= 1995-03", plan)
    months = {r["event_month"] for r in query.collect()}
    read = query._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numPartitions").value()
    assert months == {"1995-03"} and read == 2 < stored_events(spark, SF).select("event_month").distinct().count()


def test_a_failed_load_leaves_the_former_tables(spark, shop, tmp_path, monkeypatch):
    folder, _ = shop
    target = str(tmp_path / "models")
    load_models(spark, f"{folder}/clean", target, ("relational", "wide"))
    first = published(spark, target)
    n = read_model(spark, target, "relational", ["events"])["events"].count()
    written = []

    def failing(tables, path, layout=None):
        written.append(path)
        if len(written) == 2:
            raise InterruptedError("killed midway")
        return write(tables, path, layout)

    from tradewind.plans import load
    write = load.write_tables
    monkeypatch.setattr(load, "write_tables", failing)
    with pytest.raises(InterruptedError):
        load_models(spark, f"{folder}/clean", target, ("relational", "wide"))
    monkeypatch.undo()
    # The first form was written in full, and is gone with the rest of the failed load.
    assert len(written) == 2 and published(spark, target) == first and len(os.listdir(f"{target}/_versions")) == 1
    assert read_model(spark, target, "relational", ["events"])["events"].count() == n


def test_versions_switch_as_a_whole_and_old_ones_go(spark, tmp_path, rows):
    folder = str(tmp_path / "tables")
    assert current(spark, folder) == folder and published(spark, folder) == []
    readers = []
    for i in range(4):
        with publication(spark, folder) as version:
            stored = version.write({"a": spark.range(i + 1), "b": spark.range(2 * i)})
            assert stored["a"].count() == i + 1
            assert not i or current(spark, folder) == readers[-1][0]
        readers.append((current(spark, folder), read_tables(spark, current(spark, folder), ["a", "b"])))
    assert len(published(spark, folder)) == len(os.listdir(f"{folder}/_versions")) == 2
    # A reader that began before the last load still sees its own version.
    assert [t.count() for t in readers[2][1].values()] == [3, 4] and [t.count() for t in readers[3][1].values()] == [4, 6]
    with pytest.raises(ValueError), publication(spark, folder) as version:
        version.write({"a": spark.range(9)})
        raise ValueError
    # What a killed load left behind goes with the load after the next.
    os.makedirs(f"{folder}/_versions/000001-killed")
    with publication(spark, folder) as early:
        with publication(spark, folder) as late:
            late.write({"a": spark.range(7)})
        early.write({"a": spark.range(8)})
    assert current(spark, folder).split("/")[-1] == max(early.name, late.name)
    assert "000001-killed" not in os.listdir(f"{folder}/_versions")


def test_a_load_reads_each_table_once_for_its_audit(spark, shop, monkeypatch):
    """The events are scanned for each foreign key's distinct values, once for the numbering, and never again for counts."""
    folder, _ = shop
    clean = read_clean(spark, f"{folder}/clean")
    _, audit = models.resolve_with_audit(clean)
    plan = audit._jdf.queryExecution().executedPlan().toString()
    assert f"{folder}/clean" not in plan and "LeftAnti" not in plan
    assert plan.count("Scan parquet") == 4  # three stored tables, and the offsets of the numbering


def test_wide_tables_hold_user_product_and_category(spark, shop):
    folder, _ = shop
    wide = read_tables(spark, f"{models_of(spark, folder)}/wide", ["events", "messages", "products", "categories"])
    assert {"product_id", "brand", "category_id", "category_code", "category_sk"} <= set(wide["events"].columns)
    assert wide["messages"].columns[4:7] == ["client_id", "user_id", "user_device_id"]
    through = wide["events"].join(wide["products"].select("product_sk", F.col("category_sk").alias("c")), "product_sk")
    assert through.filter(~F.col("category_sk").eqNullSafe(F.col("c"))).count() == 0


def test_documents_are_nested(spark, shop):
    folder, _ = shop
    docs = read_tables(spark, f"{models_of(spark, folder)}/document", ["users", "products", "campaigns", "messages", "events"])
    assert dict(docs["users"].dtypes)["clients"].startswith("array<struct<client_id:bigint,user_device_id:bigint,first_purchase_date:string")
    assert docs["products"].columns == ["_id", "product_id", "category", "brand", "last_known_price"]
    assert docs["campaigns"].select("_id.campaign_id", "_id.campaign_type").distinct().count() == docs["campaigns"].count()
    assert dict(docs["messages"].dtypes)["campaign"] == "struct<campaign_id:bigint,message_type:string>"
    assert not {"product_id", "category_code", "brand"} & set(docs["events"].columns)
    # No empty arrays: an owner without items has a NULL field.
    assert docs["users"].filter((F.size("friends") == 0) | (F.size("clients") == 0)).count() == 0


def test_a_hub_user_is_spread_over_parts(spark, rows):
    r = {
        "users": spark.createDataFrame([(i,) for i in range(301)], "user_id bigint"),
        "clients": spark.createDataFrame([(1, 0, 1, dt.date(2020, 1, 1)), (2, 999, 1, None)], "client_id bigint, user_id bigint, user_device_id int, first_purchase_date date"),
        "friendships": spark.createDataFrame([(0, i) for i in range(1, 301)], "user_id_1 bigint, user_id_2 bigint"),
        "products": spark.createDataFrame([(1, 1, 1, "b", 1.0)], "product_sk int, product_id int, category_sk int, brand string, last_known_price double"),
        "categories": spark.createDataFrame([(1, 1, None)], "category_sk int, category_id int, category_code string"),
        "campaigns": spark.createDataFrame([(1, "a")], "campaign_id int, campaign_type string"),
        "messages": spark.createDataFrame([(1, 1, "a", 1)], "id int, campaign_id int, message_type string, client_id int"),
        "events": spark.createDataFrame([(1, 1, 1, 2.0)], "event_id int, user_id int, product_sk int, price double"),
    }
    users = models.documents(r, parts=6)["users"].collect()
    hub = [u for u in users if u._id == 0]
    assert {u.part for u in hub} == set(range(6)) and sum(u.clients is not None for u in hub) == 1
    assert sorted(f for u in hub for f in u.friends) == list(range(1, 301))
    # every user has part 0, and others where a friend or client falls into them
    assert {u._id for u in users} == set(range(301)) == {u._id for u in users if u.part == 0}
    assert all({f % 6 for f in u.friends or []} <= {u.part} for u in users)
    one = models.documents(r)["users"].collect()
    assert len(one) == 301 and {u.part for u in one} == {0}


def test_graph_edges_point_to_vertices(spark, shop):
    folder, _ = shop
    g = read_tables(spark, f"{models_of(spark, folder)}/graph", ["User", "Client", "Product", "Category", "Campaign", "BELONGS_TO", "FRIENDS_WITH", "IN_CATEGORY", "HAD_EVENT", "SENT_TO"])
    ends = {
        "BELONGS_TO": (("Client", "client_id"), ("User", "user_id")),
        "FRIENDS_WITH": (("User", "user_id"), ("User", "user_id")),
        "IN_CATEGORY": (("Product", "product_sk"), ("Category", "category_sk")),
        "HAD_EVENT": (("User", "user_id"), ("Product", "product_sk")),
    }
    for edge, sides in ends.items():
        for end, (label, key) in zip(("src", "dst"), sides):
            vertices = g[label].select(F.col(key).alias(end))
            assert g[edge].join(vertices, end, "left_anti").count() == 0, edge
    assert g["SENT_TO"].filter("dst is null").count() == 0
    assert {"is_purchased", "sent_at", "message_id"} <= set(g["SENT_TO"].columns)


@pytest.mark.parametrize("form", MODELS)
@pytest.mark.parametrize("name", ANALYSES)
def test_every_analysis_runs_on_every_stored_model(spark, shop, form, name):
    folder, _ = shop
    path = f"{models_of(spark, folder)}/{form}"
    tables = read_tables(spark, path, [t for t in os.listdir(path)])
    result = analyse(name, form, tables, ["light", "saw"]).collect()
    assert result and len(result) <= 50


def test_command_line_writes_whole_results(spark, shop, tmp_path):
    folder, _ = shop
    out = str(tmp_path / "out")
    assert main(["run", f"{folder}/models", "wide", "q3", out, "light", "--n", "all"]) == 0
    tables = read_tables(spark, f"{models_of(spark, folder)}/wide", ["categories", "products", "events"])
    want = analyse("q3", "wide", tables, ["light"], n=None)
    assert spark.read.parquet(out).count() == want.count() > 0
    assert main(["run", f"{folder}/models", "relational", "q2", out, "--limit=all", "--exclusion", "before_rank"]) == 0
    assert spark.read.parquet(out).columns == want.sparkSession.read.parquet(out).columns
    for bad in (["run", str(folder), "wide", "q9", out], [], ["run", f"{folder}/models", "wide", "q3", out, "--k", "3"]):
        with pytest.raises(SystemExit):
            main(bad)


def test_a_stored_document_model_chooses_its_parts(spark, shop, tmp_path, rows):
    folder, _ = shop
    assert main(["load", f"{folder}/clean", str(tmp_path / "own"), "--forms", "document", "--parts", "5"]) == 0
    stored = {5: read_tables(spark, f"{current(spark, str(tmp_path / 'own'))}/document", ["users"]), 17: read_tables(spark, f"{models_of(spark, folder)}/document", ["users"])}
    friends = read_tables(spark, f"{models_of(spark, folder)}/relational", ["friendships"])["friendships"]
    want = rows(models.both_directions(friends))
    for parts, tables in stored.items():
        items = tables["users"].select("_id", "part", F.explode("friends").alias("friend"))
        assert rows(items.select("_id", "friend")) == want
        assert {p for (p,) in rows(items.select("part"))} == set(range(parts))
        assert items.where(F.col("friend") % parts != F.col("part")).count() == 0
    with pytest.raises(SystemExit):
        main(["load", f"{folder}/clean", str(tmp_path / "none"), "--parts", "0"])


@pytest.mark.parametrize("name", ["targeting_score_documents", "model_consistency"])
def test_registered_queries_cut_the_documents_of_hubs(spark, monkeypatch, name):
    from registry.queries import QUERIES

    built, documents = [], models.documents
    monkeypatch.setattr(models, "documents", lambda *given: built.append(documents(*given)) or built[-1])
    QUERIES[name](spark, SF)
    (docs,) = built
    assert docs["users"].agg(F.max("part")).first()[0] == 16


def test_many_keywords_give_all_their_rows(spark):
    categories = spark.range(30).selectExpr("id AS category_sk", "'tools.k' || id AS category_code")
    products = spark.range(300).selectExpr("id AS product_sk", "id AS product_id", "id % 30 AS category_sk", "'b' AS brand", "1.0D AS last_known_price")
    events = spark.sql("SELECT 0L AS user_id, 0L AS product_sk, 'purchase' AS event_type")
    t = {"categories": categories, "products": products, "events": events}
    assert analyse("q3", "relational", t, [f"k{i}" for i in range(30)]).count() == 150


def test_tables_of_each_form(spark):
    from registry.queries import resolved_tables

    resolved = resolved_tables(spark, SF)
    assert len(tables_of(resolved, "relational")) == len(tables_of(resolved, "wide")) == 8
    assert len(tables_of(resolved, "document")) == 5 and len(tables_of(resolved, "graph")) == 10
    after = analyse("q2", "relational", tables_of(resolved, "relational"), KEYWORDS)
    wide = analyse("q2", "wide", tables_of(resolved, "wide"), KEYWORDS)
    assert diff(after, wide).count() == 0


def test_events_are_numbered_and_joined_by_narrow_rows(spark, monkeypatch):
    """F1 to F6: versions hold a category's number and not its text, and numbered events are written once."""
    from tradewind.plans import dimensions, models

    written = {}

    def note(df, name):
        written.setdefault(name, []).append(df.columns)
        return materialise(df, name)

    materialise = models.materialise
    monkeypatch.setattr(dimensions, "materialise", note)
    monkeypatch.setattr(models, "materialise", note)
    rows = [(1, "view", 7, 1, "a.b", "x", 1.0, 5), (2, "cart", 7, 1, None, "y", 2.0, 5), (3, "view", 7, None, "a.b", None, 3.0, 6), (4, "view", 8, 1, "a.b", "z", None, 6)]
    events = spark.createDataFrame(rows, "event_time int, event_type string, product_id long, category_id long, category_code string, brand string, price double, user_id long")
    events = events.withColumn("event_time", events.event_time.cast("timestamp").cast("timestamp_ntz"))
    categories, products, keyed = dimensions.assign_keys(events)
    assert written["versions"] == [["product_id", "_category", "brand", "last_known_price"]]
    assert sorted(map(tuple, categories.collect()), key=str) == [(1, 1, "a.b"), (2, 1, None), (3, None, "a.b")]
    assert sorted(tuple(r) for r in products.select("product_sk", "product_id", "category_sk", "last_known_price").collect()) == [
        (1, 7, 1, 1.0), (2, 7, 2, 2.0), (3, 7, None, 3.0), (4, 8, 1, None),
    ]
    found = {(r.event_time.second, r.category_id, r.category_code, r.product_sk, r.category_sk) for r in keyed.collect()}
    assert found == {(1, 1, "a.b", 1, 1), (2, 1, None, 2, 2), (3, None, "a.b", None, None), (4, 1, "a.b", 4, 1)}
    empty = {"campaigns": "campaign_id long, campaign_type string, channel string", "friends": "friend1 long, friend2 long",
             "clients": "client_id long, user_id long", "messages": "id long, campaign_id long, message_type string, client_id long"}
    tables = {name: spark.createDataFrame([], schema) for name, schema in empty.items()}
    resolved = models.resolve({**tables, "users": events.select("user_id"), "categories": categories, "products": products, "events": keyed})
    assert "events" not in written
    assert sorted((r.event_id, r.event_time.second) for r in resolved["events"].collect()) == [(1, 1), (2, 2), (3, 4)]
