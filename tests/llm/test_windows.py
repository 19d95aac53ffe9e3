"""Repeated windows of words and bytes, against counting all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import cases
from tradewind.llm import anchors, fm_index, suffix_levels
from tradewind.llm.queries import op3_fm_index, op8_suffix_levels

segments = st.lists(st.tuples(st.text("ab", min_size=3, max_size=40), st.integers(1, 2)), min_size=1, max_size=12, unique_by=lambda x: x[0])


def counted(texts, copies, size):
    """Which windows of each sequence stand twice or more."""
    seen = Counter()
    for units, n in zip(texts, copies, strict=True):
        for i in range(len(units) - size + 1):
            seen[tuple(units[i : i + size])] += n
    return [[seen[tuple(u[i : i + size])] > 1 for i in range(len(u) - size + 1)] for u in texts]


@settings(max_examples=60, deadline=None)
@given(segments, st.integers(2, 6))
def test_fm_index_counts_windows(rows, size):
    texts = [list(t) for t, _ in rows]
    found = fm_index.repeats([" ".join(t).encode() for t in texts], np.array([n for _, n in rows]), size)
    assert [m.tolist() for m in found] == counted(texts, [n for _, n in rows], size)


@settings(max_examples=60, deadline=None)
@given(segments, st.integers(8, 19), st.integers(1, 80))
def test_suffix_levels_count_windows(rows, size, batch):
    texts = [t.encode() for t, _ in rows]
    found = suffix_levels.repeats(texts, np.array([n for _, n in rows]), size, batch)
    assert [m.tolist() for m in found] == counted(texts, [n for _, n in rows], size)


def test_levels_merge_geometrically(monkeypatch):
    made = []
    old = suffix_levels.merged
    monkeypatch.setattr(suffix_levels, "merged", lambda a, b, size: made.append(a.generation) or old(a, b, size))
    rng = random.Random(0)
    suffix_levels.repeats([bytes(rng.choices(range(256), k=30)) for _ in range(8)], np.ones(8, int), 10, 30)
    assert made == [0, 0, 1, 0, 0, 1, 2]


def test_fm_index_leaps_over_windows_that_stand_once(monkeypatch):
    """Each segment repeats a phrase, but no window: about as many words are searched as there are windows."""
    searched = []
    extended = fm_index.FmIndex.extended
    monkeypatch.setattr(fm_index.FmIndex, "extended", lambda self, symbol, place: searched.append(len(place)) or extended(self, symbol, place))
    phrase = [f"p{i}" for i in range(30)]
    texts = [[*(f"a{d}-{i}" for i in range(60)), *phrase, *(f"b{d}-{i}" for i in range(60))] for d in range(20)]
    found = fm_index.repeats([" ".join(t).encode() for t in texts], np.ones(20, int), 35)
    assert not np.concatenate(found).any()
    assert sum(searched) < 2 * sum(len(f) for f in found)


def test_fm_index_finds_pattern_ranges():
    text = np.array([1, 2, 1, 2, 1, 0, 2, 1, 3, 0])
    index = fm_index.FmIndex(text, np.ones(len(text), int))
    low, high = np.array([0]), np.array([len(text)])
    for symbol in (1, 2):
        low, high = index.extended(np.array([symbol]), low), index.extended(np.array([symbol]), high)
    assert index.weight(low, high).tolist() == [3]  # 2 1


def want(units, size):
    masks = counted(units, [1] * len(units), size)
    result = []
    for u, mask in zip(units, masks, strict=True):
        gone = np.zeros(len(u), bool)
        for i in np.nonzero(mask)[0]:
            gone[i : i + size] = True
        result.append(gone)
    return result


def check(rows, units, size, join):
    """Rows (id, units, removed, kept) as a multiset, as ids may repeat."""
    expected = Counter()
    for (i, _), u, gone in zip(rows, units, want(units, size), strict=True):
        expected[(i, len(u), int(gone.sum()), join([x for x, g in zip(u, gone, strict=True) if not g]))] += 1
    return expected


WORDS = (fm_index.remove_repeats, "n_words", lambda t: (t or "").encode().split(), lambda u: b" ".join(u).decode())
BYTES = (suffix_levels.remove_repeats, "n_bytes", lambda t: (t or "").encode(), bytes)


@pytest.mark.parametrize("operator, count, split, join, size, gram", [(*WORDS, 9, 4), (*BYTES, 40, 12)])
@pytest.mark.parametrize("hot, stretch", [(20_000, 1 << 20), (2, 300)])
def test_odd_documents(spark, monkeypatch, operator, count, split, join, size, gram, hot, stretch):
    monkeypatch.setattr(anchors, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(anchors, "STRETCH", stretch)
    docs = cases.clashing(cases.documents(spark)).repartition(3)
    rows = cases.collected(cases.documents(spark))
    found = operator(docs, window=size, gram=gram, hot=hot).collect()
    got = Counter((r["doc_id"], r[count], r["n_removed"], r["kept"] if isinstance(r["kept"], str) else bytes(r["kept"])) for r in found)
    assert got == check(rows, [split(t) for _, t in rows], size, join)
    for r in found:
        assert sum(b - a for a, b in zip(r["starts"], r["ends"], strict=True)) == r["n_removed"]
        assert all(b < a for a, b in zip(r["starts"][1:], r["ends"], strict=False))


@pytest.mark.parametrize("operator", [fm_index.remove_repeats, suffix_levels.remove_repeats])
def test_empty_table(spark, operator):
    assert operator(cases.empty(cases.documents(spark))).count() == 0


@pytest.mark.parametrize("query, split, size, join", [(op3_fm_index, bytes.split, 35, b" ".join), (op8_suffix_levels, bytes, 200, bytes)])
def test_queries_equal_counting(spark, query, split, size, join):
    docs = [(i, (t or "").encode()) for i, t in cases.collected(spark.read.parquet(f"{cases.SF}/documents.parquet"))]
    units = [split(t) for _, t in docs]
    got = {r["doc_id"]: r for r in query(spark, cases.SF).collect()}
    assert len(got) == len(docs)
    removed = 0
    for (i, _), u, gone in zip(docs, units, want(units, size), strict=True):
        kept = join([x for x, g in zip(u, gone, strict=True) if not g])
        removed += int(gone.sum())
        assert got[i]["n_removed"] == gone.sum() and got[i][1] == len(u)
        assert got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()
    assert removed > 0
