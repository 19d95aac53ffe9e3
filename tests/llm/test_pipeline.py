"""The pipeline's stages, against plain Python over the stage before."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.llm import cases
from tests.llm.test_models import LIBRARY
from tests.llm.test_simhash import all_pairs, brute, groups
from tradewind.llm import quality
from tradewind.llm.line_dedup import MIN_SITES
from tradewind.operators.storage import materialise

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ASCII = {i: i + 32 for i in range(65, 91)}


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def after_lines(rows):
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    sites, first = {}, {}
    for doc, text, _, source, _ in rows:
        for line in {strip(x) for x in (text or "").split("\n")} - {""}:
            sites.setdefault(line, set()).add(source)
            if doc is not None:
                first[line] = min(doc, first.get(line, doc))
    wide = {x for x, s in sites.items() if len(s - {None}) >= MIN_SITES}
    for doc, text, lang, source, n in rows:
        if text is None:
            yield doc, text, lang, source, n
            continue
        kept, own = [], set()
        for line in text.split("\n"):
            key = strip(line)
            if key not in wide or first.get(key) == doc and key not in own:
                kept.append(line)
                own.add(key)
        yield doc, "\n".join(kept), lang, source, len("\n".join(kept))


def windows(text):
    words = WORD.findall((text or "").translate(ASCII))
    return {tuple(words[i : i + 10]) for i in range(max(1, len(words) - 9))} if words else set()


@pytest.mark.parametrize("folder", [cases.SF, "odd"])
def test_stages_equal_plain_python(spark, folder):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "near-duplicates", "decontamination", "tokens"]
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet") if folder != "odd" else cases.documents(spark)
    stages = [docs]
    for _, stage in corpus_pipeline.STAGES:
        stages.append(materialise(stage(spark, stages[-1], cases.SF), "stage"))
        if len(stages) < 6:
            assert stages[-1].columns == docs.columns
    good, lined, single, clean, tokens = stages[1:]

    assert rows_of(good) == rows_of(quality.apply_rules(docs).where("kept").select(docs.columns))
    before = rows_of(good)
    assert rows_of(lined) == sorted(after_lines(before), key=repr)

    before = rows_of(lined)
    want = groups(range(len(before)), all_pairs([brute(r[1]) for r in before]))
    kept = rows_of(single)
    assert set(kept) <= set(before) and len(kept) == len(set(want.values()))
    root = {r: want[i] for i, r in enumerate(before)}
    assert len({root[r] for r in kept}) == len(kept)
    for r in kept:
        assert r[0] == min((before[i][0] for i in want if want[i] == root[r] and before[i][0] is not None), default=None)

    items = [r["text"] for r in spark.read.parquet(f"{cases.SF}/benchmark.parquet").collect()]
    leaked = set().union(*map(windows, items))
    assert rows_of(clean) == [r for r in kept if not windows(r[1]) & leaked]

    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    found = tokens.collect()
    assert len(found) == clean.count()
    for r in found:
        assert r["round_trip"] and np.frombuffer(r["ids"], "<u4").tolist() == LIBRARY.encode_ordinary(texts[r["doc_id"]])


def test_empty_table_and_registration(spark):
    docs = cases.empty(cases.documents(spark))
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, cases.SF), "stage")
    assert docs.count() == 0
    queries = __spark_entry__.queries()
    assert "pipeline" in queries and {f"op{n}" for n in range(1, 11)} <= {q.partition("_")[0] for q in queries}
    assert queries["pipeline"](spark, cases.SF).where(~F.col("round_trip")).count() == 0
