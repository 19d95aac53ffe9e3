"""Native operators and the others that SQL can express, against SQL and hand-made cases."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.compare import canonical, connect
from tests.llm import cases
from tradewind.llm import decontaminate, fm_index, line_dedup, quality, suffix_levels
from tradewind.llm.oracle import ORACLE
from tradewind.llm.queries import QUERIES


def same(df, con, sql):
    result = con.execute(sql)
    want = canonical([d[0] for d in result.description], result.fetchall())
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == want


def views(docs, **tables):
    con = duckdb.connect()
    for name, df in {"documents": docs, **tables}.items():
        con.register(name, df.toArrow())
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_sql(spark, name):
    same(QUERIES[name](spark, cases.SF), connect(cases.SF), ORACLE[name])


@pytest.mark.parametrize("name, operator", [("op3_fm_index", fm_index.remove_repeats), ("op8_suffix_levels", suffix_levels.remove_repeats)])
def test_repeats_of_odd_documents_equal_sql(spark, name, operator):
    passage = " ".join(f"w{i}é" for i in range(60))
    texts = [passage, f"a {passage}\nb {passage}", None, "", " \t", passage[:210], "x " * 300, passage, "tail " + passage[-215:]]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = operator(docs)
    spans = [F.size("starts").cast("long").alias("n_spans")] if name == "op8_suffix_levels" else []
    assert found.agg(F.sum("n_removed")).first()[0] > 0
    same(found.select("doc_id", found.columns[1], "n_removed", *spans, F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")), views(docs), ORACLE[name])


def test_quality_of_odd_documents(spark):
    docs = cases.documents(spark)
    found = quality.apply_rules(docs).select("doc_id", *quality.COUNTS, "base_failed", "kept")
    same(found, views(docs), ORACLE["op6_quality_rules"])
    assert quality.apply_rules(cases.empty(docs)).count() == 0


def test_repeated_lines_count_with_their_white_space(spark):
    texts = ["alpha\n  alpha\nalpha\t\nalpha\r\nalpha", "a b\na b\n \n \n a b", None, "\n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = quality.apply_rules(docs).select("doc_id", *quality.COUNTS, "base_failed", "kept")
    assert [r["n_dup_lines"] for r in found.orderBy("doc_id").collect()] == [1, 1, 0, 0]
    same(found, views(docs), ORACLE["op6_quality_rules"])


def test_quality_filter_keeps_rows_and_columns(spark):
    docs = cases.clashing(cases.documents(spark))
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    judged = quality.apply_rules(docs).where("kept")
    assert kept.count() == judged.count() > 0
    assert {r["_words"] for r in kept.collect()} == {"own _words"}


def test_quality_rules_name_what_is_broken(spark):
    texts = {
        "symbols": "the cat ### and *** dog " * 20,
        "shouting": "THE CAT AND DOG!! " * 20,
        "fine": " ".join(f"the w{i} and of a b{i}" for i in range(20)),
    }
    docs = spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id string, text string")
    broken = {r["doc_id"]: r["failed"] for r in quality.apply_rules(docs).collect()}
    assert "symbols per word" in broken["symbols"]
    assert "upper-case letters per character" in broken["shouting"]
    assert broken["fine"] == []
    only = {"longer": ("n_words", "n_lines", 1000, None)}
    assert {tuple(r["failed"]) for r in quality.apply_rules(docs, rules=only).collect()} == {("longer",)}


def test_repeated_lines_are_compared_with_their_white_space(spark):
    body = " ".join(f"the word{i}" for i in range(30))
    texts = [f"{body}\nalpha\n  alpha\nalpha\t\nalpha\r", f"{body}\nalpha\n  alpha\nalpha\n  alpha", f"{body}\n\n \n\n ", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: (r["n_dup_lines"], r["kept"]) for r in quality.apply_rules(docs).collect()}
    assert found == {0: (0, True), 1: (2, True), 2: (0, True), 3: (0, False)}
    assert {r["doc_id"] for r in quality.quality_filter(docs).collect()} == {0, 1, 2}


def test_line_dedup_of_odd_documents(spark):
    docs = cases.documents(spark)
    found = line_dedup.remove_boilerplate(docs)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    found = found.select("doc_id", "n_lines", "n_removed", digest)
    same(found, views(docs), ORACLE["op2_line_dedup"])


def test_line_dedup_keeps_one_copy_or_none(spark):
    docs = spark.createDataFrame([(i, f"own {i}\n same  \nsame\n\nother", f"s{i}") for i in range(5)], "doc_id int, text string, source string")
    kept = {r["doc_id"]: r["text"] for r in line_dedup.remove_boilerplate(docs, min_sites=5).collect()}
    assert kept[0] == "own 0\n same  \n\nother" and kept[3] == "own 3\n"
    none = {r["doc_id"]: r["text"] for r in line_dedup.remove_boilerplate(docs, min_sites=5, keep_first=False).collect()}
    assert none[0] == "own 0\n"
    assert line_dedup.remove_boilerplate(docs, min_sites=6).agg(F.sum("n_removed")).first()[0] == 0


def test_line_dedup_columns_and_empty_table(spark):
    docs = cases.clashing(cases.documents(spark))
    found = line_dedup.remove_boilerplate(docs)
    assert found.columns == [*docs.columns, "n_lines", "n_removed"] and found.count() == docs.count()
    assert line_dedup.remove_boilerplate(cases.empty(docs)).count() == 0


def test_wide_lines_are_decided_by_sketches_near_ones_exactly(spark):
    # many lines at, just below and far above the threshold
    rows = [(i, "\n".join(f"line {k}" for k in (90, 99, 100, 101, 300) if i < k), f"s{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    found = line_dedup.boilerplate(line_dedup._line_rows(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("site"), "text")), 100)
    assert found.count() == 3


def test_decontamination_of_odd_documents(spark):
    rng = random.Random(8)
    docs = cases.documents(spark)
    long = cases.collected(docs)[22][1].split("\n")[2].split()
    items = [(1, " ".join(long[5:30])), (2, " ".join(long[20:31]) + "!"), (3, cases.text(rng, 30)), (4, "river stone"), (5, "alpha"), (6, None), (7, ""), (3, "Stone RIVER x1"), (None, " ".join(long[:12]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    marked = decontaminate.mark_contaminated(cases.clashing(docs), benchmark)
    found = marked.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )
    assert found.where("contaminated").count() > 12
    same(found, views(docs, benchmark=benchmark), ORACLE["op9_decontaminate"])


def test_decontamination_reads_documents_twice_for_items_of_all_lengths(spark, monkeypatch):
    rng = random.Random(9)
    docs = cases.documents(spark)
    body = cases.collected(docs)[22][1].split("\n")[2].split()
    items = [(n, " ".join(body[n : n + n])) for n in range(1, 11)] + [(20 + n, cases.text(rng, n)) for n in range(1, 11)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    passes, old = [], decontaminate._fingerprinted
    monkeypatch.setattr(decontaminate, "_fingerprinted", lambda rows, sizes, *a: passes.append((rows, sizes)) or old(rows, sizes, *a))
    marked = decontaminate.mark_contaminated(docs, benchmark)
    read = [sizes for rows, sizes in passes if "_id" in rows.columns]
    assert read == [list(range(1, 11))] * 2
    found = marked.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )
    same(found, views(docs, benchmark=benchmark), ORACLE["op9_decontaminate"])


def test_decontamination_without_documents_or_items(spark):
    docs = cases.documents(spark)
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.mark_contaminated(cases.empty(docs), benchmark).count() == 0
    nothing = decontaminate.mark_contaminated(docs, benchmark.where("false"))
    assert nothing.count() == docs.count() and nothing.where("contaminated or n_hit > 0 or size(items) > 0").count() == 0


def test_native_operators_run_no_python(spark):
    docs = cases.documents(spark)
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for df in (quality.quality_filter(docs), line_dedup.remove_boilerplate(docs), decontaminate.mark_contaminated(docs, benchmark)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
