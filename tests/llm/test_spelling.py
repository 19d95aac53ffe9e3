"""Spelling variants against a comparison of all words with all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tradewind.llm import spelling
from tradewind.llm.queries import QUERIES


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_force(rows, least=5, often=3, ratio=2, drop=True):
    counts = Counter()
    for id, text in rows:
        lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if id is None else id}:{run}".encode())
            if drop and h % 97 == 0:
                run = "".join(c for i, c in enumerate(run) if i != h % len(run))
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= often}
    patterns = {}
    for w in words:  # words that may be near share a pattern with one letter left open
        for i in range(len(w) + 1):
            patterns.setdefault(w[:i] + "?" + w[i + 1 :], set()).add(w)
            patterns.setdefault(w[:i] + "?" + w[i:], set()).add(w)
    result = {}
    for w, n in words.items():
        keys = [w[:i] + "?" + w[i + 1 :] for i in range(len(w))] + [w[:i] + "?" + w[i:] for i in range(len(w) + 1)]
        near = [o for o in set().union(*(patterns.get(k, ()) for k in keys)) if o != w and one_edit(w, o)]
        best = min(near, key=lambda o: (-words[o], o), default=None)
        result[w] = [n, len(near), best if best and words[best] >= ratio * n else None]
    rows = []
    for w, (n, near, form) in result.items():
        root = w
        while result[root][2]:
            root = result[root][2]
        rows.append((w, form, root, n, near, words[form] if form else None))
    return sorted(rows, key=repr)


def test_query_equals_brute_force(spark, rows):
    docs = cases.collected(spark.read.parquet(f"{cases.SF}/documents.parquet"))
    found = rows(QUERIES["op11_spelling"](spark, cases.SF), "word", "form", "root", "n", "n_near", "form_n")
    assert found == brute_force(docs) and sum(r[1] is not None for r in found) > 100


@pytest.mark.parametrize("chunk", [spelling.CHUNK, 40])
def test_chains_ties_accents_and_odd_rows(spark, rows, monkeypatch, chunk):
    """Small chunks make blocks of many chunks; words of 3,000 letters stand beside short ones."""
    monkeypatch.setattr(spelling, "CHUNK", chunk)
    rng = random.Random(5)
    texts = ["Stonehouse " * 40 + "stonehousé " * 12 + "stonhousé " * 4, "CAFÉTER caféter cafeter cafeter cafeter " * 3, None, "", " 12 .\n"]
    texts += ["abcde abcdf abcdg abcxx " * 3, "ÀÀÀÀÀ ÀÀÀÀÿ " * 3, ("q" * 3000 + " " + "q" * 2999 + " ") * 3, "x" * 5 + "1" + "x" * 4]
    for _ in range(30):
        texts.append(" ".join("".join(rng.choice("abé") for _ in range(rng.choice([5, 6, 7]))) for _ in range(40)))
    docs = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(1, texts[1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("word", "n", "block", "id", "form")})
    found = spelling.spelling_variants(frame, edit=spelling.dropped_letter)
    assert rows(found, "word", "form", "root", "n", "n_near", "form_n") == brute_force(docs)
    assert spelling.spelling_variants(cases.empty(frame)).count() == 0


def test_roots_follow_chains_to_their_end(spark, rows):
    chain = [(f"w{i:03}", f"w{i + 1:03}") for i in range(37)] + [("w037", None), ("hub", "w037"), ("alone", None)]
    found = rows(spelling.roots(spark.createDataFrame(chain, "word string, form string")))
    assert found == sorted((w, "w037") for w, f in chain if f)


def test_all_pairs_of_a_block_and_the_next_are_found():
    rng = np.random.default_rng(3)
    for length in (5, 9):
        a, b = (np.unique(rng.choice([97, 98, 233], (150, n)), axis=0).astype(np.uint8) for n in (length, length + 1))
        text = lambda m: ["".join(map(chr, r)) for r in m]
        for left, right, same in ((a, a, True), (a, b, False)):
            found = set(zip(*map(np.ndarray.tolist, spelling.near_words(left, right, same)), strict=True))
            pairs = ((i, j) for i in range(len(left)) for j in range(len(right)) if not same or i < j)
            assert found == {(i, j) for i, j in pairs if one_edit(text(left)[i], text(right)[j])} and found


def test_blocks_of_near_words_are_visited(spark):
    words = ["abcde", "abcdé", "abcdef", "xbcde", "zzzzz", "àbcde"]
    chunks = spelling._chunks(spark.createDataFrame([(w, 3) for w in words], "word string, n long"))
    met = {(a, b) for r in spelling._met(chunks).collect() for a in r["words"].split("\n") for b in r["others"].split("\n")}
    assert all((a, b) in met or (b, a) in met for a in words for b in words if a != b and one_edit(a, b))


def test_runs_of_long_texts_are_not_cut(monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 7)
    text = "Straße und Häuser, " * 50 + "X" * 100 + " Ende"
    want = Counter(re.findall("[a-zÀ-ÿ]+", text.encode().lower().decode()))
    assert spelling.runs(text) == want
