"""PPM, toxicity and BPE, against brute force, held-out accuracy and the tokenizer library."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import cases
from tradewind.llm import blocks, bpe, ppm, toxicity
from tradewind.llm.queries import op1_ppm, op5_toxicity, op7_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


# ── PPM ─────────────────────────────────────────────────────────────────────────────────────────


def brute_scores(rows, order=ppm.ORDER):
    """(n_tokens, n_known, train_tokens, base, score) of rows (text, learns), with explicit exclusion sets."""
    texts = [((t or "").encode().lower(), learns) for t, learns in rows]
    words, followed = Counter(), defaultdict(Counter)
    for text, learns in texts:
        if learns:
            words.update([*text.split(), None])
            line = [256] * order + list(text) + [256]
            for i in range(order, len(line)):
                for k in range(order + 1):
                    followed[tuple(line[i - k : i])][line[i]] += 1
    total, kinds = sum(words.values()), len(words)

    def coded(context, symbol):
        excluded, result = set(), 0.0
        for k in range(order, -1, -1):
            seen = {s: n for s, n in followed.get(tuple(context[order - k :]), {}).items() if s not in excluded}
            if symbol in seen:
                return result + math.log10(seen[symbol] / (sum(seen.values()) + len(seen)))
            if seen:
                result += math.log10(len(seen) / (sum(seen.values()) + len(seen)))
            excluded |= seen.keys()
        return result - math.log10(257 - len(excluded))

    for text, _ in texts:
        tokens = [*text.split(), None]
        line = [256] * order + list(text) + [256]
        base = sum(math.log10((words[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in tokens)
        score = sum(coded(line[i - order : i], line[i]) for i in range(order, len(line)))
        yield len(tokens), sum(words[w] > 0 for w in tokens), total, base, score


def assert_scores(found, wanted):
    assert found[:3] == wanted[:3]
    assert found[3] == pytest.approx(wanted[3], rel=1e-9) and found[4] == pytest.approx(wanted[4], rel=1e-9)


COLUMNS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def test_ppm_of_odd_documents(spark, monkeypatch):
    monkeypatch.setattr(blocks, "FAN_IN", 2)
    monkeypatch.setattr(blocks.pack, "__defaults__", (3000,))
    docs = cases.clashing(cases.documents(spark)).withColumn("place", F.monotonically_increasing_id())
    learns = F.col("place") % 3 > 0
    rows = docs.select("place", "text", learns.alias("learns")).orderBy("place").collect()
    found = {r["place"]: r for r in ppm.score_texts(docs, learns, id="place").collect()}
    assert len(found) == len(rows)
    for r, wanted in zip(rows, brute_scores([(r["text"], r["learns"]) for r in rows]), strict=True):
        assert_scores(tuple(found[r["place"]][c] for c in COLUMNS), wanted)


@pytest.mark.parametrize("learns", [True, False])
def test_ppm_of_all_or_no_training_texts(spark, learns):
    docs = spark.createDataFrame([(1, "Abab\n"), (2, None), (2, ""), (None, "é x")], "doc_id long, text string")
    found = ppm.score_texts(docs, F.lit(learns)).collect()
    wanted = list(brute_scores([(t, learns) for t in ("Abab\n", None, "", "é x")]))
    order = sorted(range(4), key=lambda i: wanted[i][4])
    for r, i in zip(sorted(found, key=lambda r: r["score"]), order, strict=True):
        assert_scores(tuple(r[c] for c in COLUMNS), wanted[i])
    assert ppm.score_texts(cases.empty(docs), F.lit(learns)).count() == 0


def test_ppm_probabilities_sum_to_one():
    keys, _ = ppm.symbol_keys([b"abracadabra", b"abba"], 4)
    unique, counts = np.unique(keys, return_counts=True)
    low = ppm.low_levels(*ppm._summed(ppm._suffix(unique, 1), counts))
    found = ppm.levels(unique, counts, low, 4)
    for context in (b"abra", b"zzzz", b"zabb"):
        start = 0
        for symbol in context:
            start = start << 9 | symbol
        every = np.array([start << 9 | s for s in range(257)])
        assert (10 ** ppm.log_probability(every, found)).sum() == pytest.approx(1)


def test_ppm_query(spark):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet").orderBy("doc_id").collect()
    learns = [zlib.crc32(str(r["doc_id"]).encode()) % 10 != 0 for r in docs]
    found = {r["doc_id"]: r for r in op1_ppm(spark, cases.SF).collect()}
    for r, learnt, wanted in list(zip(docs, learns, brute_scores([(r["text"], x) for r, x in zip(docs, learns, strict=True)]), strict=True))[:60]:
        assert found[r["doc_id"]]["held_out"] != learnt
        assert_scores(tuple(found[r["doc_id"]][c] for c in COLUMNS), wanted)


# ── toxicity ────────────────────────────────────────────────────────────────────────────────────


def test_toxicity_query_on_held_out_rows(spark):
    """On the largest test table that has labels enough to learn from."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = op5_toxicity(spark, folder)
    assert scored.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = scored.where("held_out").join(labels, "doc_id").select("toxic", "predicted", "score").collect()
    toxic, clean = ([r for r in held if r["toxic"] == k] for k in (1, 0))
    assert len(toxic) > 50
    assert sum(r["predicted"] for r in toxic) > 0.85 * len(toxic)
    assert sum(r["predicted"] for r in clean) < 0.05 * len(clean)
    assert all(0 <= r["score"] <= 1 for r in held)


def sentences(n, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("abcdefghilmnoprstu", k=6)) for _ in range(300)]
    return [(" ".join(rng.choices(plain, k=40) + (["horrible"] * 2 if i % 4 == 0 else [])), int(i % 4 == 0)) for i in range(n)]


def test_misspelt_words_share_ngrams():
    rows = sentences(400)
    scorer = toxicity.Scorer(toxicity.train([t for t, _ in rows], [y for _, y in rows]))
    clean = rows[1][0]
    assert scorer.score(clean) < 0.3 < 0.5 < scorer.score(clean + " horrible horrible")
    assert scorer.score(clean + " horriible horribble xhorrible") > 2 * scorer.score(clean)


def test_toxicity_sample_and_odd_rows(spark):
    docs = cases.clashing(cases.documents(spark))
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(3, 1), (None, 1), (5, None), (999, 1)], "doc_id long, toxic int")
    slim = docs.select("doc_id", "text")
    texts, toxic = toxicity.sample(slim, labels, "doc_id", "text", "toxic", 100, 1 << 20)
    assert len(texts) == 12 and sum(toxic) == 6
    texts, toxic = toxicity.sample(slim, labels, "doc_id", "text", "toxic", 5, 1 << 20)
    assert len(texts) == 5
    texts, _ = toxicity.sample(slim, labels, "doc_id", "text", "toxic", 100, 300)
    assert sum(len((t or "").encode()) for t in texts) <= 300
    model = toxicity.fit(docs, labels)
    scores = docs.select("text", toxicity.score(model, docs, F.col("text")).alias("s")).collect()
    assert len({r["s"] for r in scores if not (r["text"] or "").strip()}) == 1


def test_toxicity_sample_loses_no_document_to_copies(spark):
    rows = [(1, "aa"), (1, "aa"), (1, "aa"), (2, "bb"), (3, "cc"), (3, "c"), (4, None), (4, None), (None, "n")]
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 0), (4, 1)], "doc_id long, toxic int")
    texts, toxic = toxicity.sample(docs, labels, "doc_id", "text", "toxic", 100, 1 << 20)
    assert sorted(zip(map(str, texts), toxic, strict=True)) in [
        sorted([("aa", 1), ("bb", 0), (three, 0), ("None", 1)]) for three in ("c", "cc")
    ]
    again = toxicity.sample(docs.repartition(7), labels, "doc_id", "text", "toxic", 100, 1 << 20)
    assert again == (texts, toxic)
    assert len(toxicity.sample(docs, labels, "doc_id", "text", "toxic", 2, 1 << 20)[0]) == 2
    assert len(toxicity.sample(docs, labels, "doc_id", "text", "toxic", 100, 4)[0]) >= 2


def test_toxicity_scores_are_the_softmax_of_averaged_embeddings():
    texts = ["you are a vile idiot", "the meadow is green", "vile vile idiot", "green green meadow grass", None, ""] * 4
    toxic = [1, 0, 1, 0, 0, 0] * 4
    table, out, bias = toxicity.embeddings(texts, toxic)
    scorer = toxicity.Scorer(toxicity.train(texts, toxic))
    for text in [*texts, "a vyle idoit in the grass", "naïve Übung, ÄÖ", "x" * 50]:
        total, weight = np.zeros(toxicity.WIDTH), 0.0
        for word in set((text or "").encode().lower().split()):
            often = (text.encode().lower().split().count(word)) ** 0.5
            for bucket in toxicity.subwords(word):
                total += often * table[bucket]
                weight += often
        logits = out @ (total / (toxicity.PADDING + weight)) + bias
        share = np.exp(logits - logits.max())
        assert scorer.score(text) == pytest.approx(share[1] / share.sum(), abs=1e-5)


@pytest.mark.parametrize("labelled, score", [([], 0.0), ([(1, 0), (2, 0)], 0.0), ([(1, 1), (2, 1)], 1.0)])
def test_toxicity_without_both_classes(spark, labelled, score):
    docs = cases.documents(spark)
    model = toxicity.fit(docs, spark.createDataFrame(labelled, "doc_id long, toxic int"))
    found = docs.select(toxicity.score(model, docs, F.col("text")).alias("s")).distinct().collect()
    assert [r["s"] for r in found] == [pytest.approx(score, abs=1e-5)]
    assert cases.empty(docs).select(toxicity.score(model, docs, F.col("text"))).count() == 0


# ── BPE ─────────────────────────────────────────────────────────────────────────────────────────

with open(PATH, "rb") as _file:
    RANKS = bpe.read_ranks(_file.read())
LIBRARY = tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
OWN = bpe.Bpe(RANKS, PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=300), st.text("abcdeéß  \n'", max_size=300), st.builds(lambda s, n: s * n, st.text(min_size=1, max_size=6), st.integers(1, 120))))
def test_bpe_equals_the_library(text):
    ids = OWN.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode_ordinary(text)
    assert OWN.decode(ids) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=120), st.binary(max_size=120))
def test_joining_is_encoding_the_whole(left, right):
    joined = OWN.join(OWN.merged(left), OWN.merged(right))
    assert joined == OWN.merged(left + right)
    assert OWN.encoded(left + right) == joined


def test_ranks_are_read():
    assert bpe.read_ranks(base64.b64encode(b"a") + b" 0\n" + base64.b64encode(b"bc") + b" 7\n") == {b"a": 0, b"bc": 7}


def test_bpe_columns_and_odd_documents(spark):
    docs = cases.clashing(cases.documents(spark))
    found = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN)
    assert found.columns == [*[c for c in docs.columns if c != "ids"], "ids", "decoded"]
    rows = found.select("text", "ids", "decoded").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == LIBRARY.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.decode(bpe.encode(cases.empty(docs), PATH, PATTERN), PATH, PATTERN).count() == 0


def test_bpe_query(spark):
    docs = dict(cases.collected(spark.read.parquet(f"{cases.SF}/documents.parquet")))
    found = op7_bpe(spark, cases.SF).collect()
    assert len(found) == len(docs)
    for r in found:
        ids = LIBRARY.encode_ordinary(docs[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((docs[r["doc_id"]] or "").encode()).hexdigest()
