"""Exact top-k and whitening against numpy on whole matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tradewind.llm import topk, whitening
from tradewind.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def table(spark, rows):
    data = [(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows]
    return spark.createDataFrame(data, SCHEMA)


def clashing(vectors):
    names = "id n x place length is_query bucket strip grp reach rank score query_id component ids size data kind _query".split()
    return vectors.withColumns({c: F.lit("own") for c in names})


def sound(rows, scale, offset=0):
    """ids and whole numbers of the rows that take part."""
    kept = [(i, np.float32(v).astype(float)) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    return [i for i, _ in kept], np.array([np.floor(scale * v) for _, v in kept]).astype(np.int64) + offset


def best(rows, k=5, every=50):
    ids, x = sound(rows, 256)
    found = []
    for at, i in enumerate(ids):
        if i is not None and i % every == 0:
            scores = x @ x[at]
            order = sorted((j for j in range(len(ids)) if j != at), key=lambda j: (-scores[j], ids[j] is None, ids[j] or 0))
            found += [(i, rank + 1, ids[j], int(scores[j])) for rank, j in enumerate(order[:k])]
    return sorted(found, key=repr)


def odd(seed=1, n=300, size=6, scale=1.0):
    """Vectors of very different lengths, with copies, ties, repeated and NULL ids, and some that take no part."""
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=size) * rng.choice([0.01, 0.3, 1, 5]) * scale).tolist()) for i in range(n)]
    rows += [(n + i, rows[50][1]) for i in range(40)] + [(50, rows[50][1]), (100, rows[3][1]), (None, rows[50][1]), (None, rows[7][1])]
    rows += [(n + 60 + i, [0.0] * size) for i in range(3)] + [(1000, [0.0] * size)]
    none = [None, [], [None] * size, [float("nan")] + [1.0] * (size - 1), [float("inf")] * size, [1.0, None] + [1.0] * (size - 2)]
    return rows + [(2000 + 50 * i, v) for i, v in enumerate(none)]


@pytest.mark.parametrize("sizes", [{}, {"bucket": 16, "strip": 2, "queries": 3}])
def test_top_k_equals_brute_force(spark, rows, sizes):
    vectors = odd()
    found = topk.top_k(clashing(table(spark, vectors)), F.col("vec_id") % 50 == 0, **sizes)
    assert rows(found, "query_id", "rank", "id", "score") == best(vectors)


@pytest.mark.parametrize("spread", [0.02, 0.2])
def test_top_k_of_crowded_directions(spark, rows, spread):
    """Near copies of a few directions make local thresholds high, so that coordinates prune."""
    rng = np.random.default_rng(2)
    heads = rng.normal(size=(5, 16))
    data = heads[rng.integers(0, 5, 400)] + spread * rng.normal(size=(400, 16))
    vectors = [(i, (3 * v / np.linalg.norm(v)).tolist()) for i, v in enumerate(data)]
    found = topk.top_k(table(spark, vectors), F.col("vec_id") % 5 == 0, bucket=64, strip=2, queries=16)
    assert rows(found, "query_id", "rank", "id", "score") == best(vectors, every=5)


def test_top_k_of_few_rows(spark, rows):
    few = [(0, [1.0, 2.0]), (50, [0.5, 0.5]), (3, [-1.0, -2.0])]
    found = topk.top_k(table(spark, few), F.col("vec_id") % 50 == 0)
    assert rows(found, "query_id", "rank", "id", "score") == best(few)
    assert topk.top_k(cases.empty(table(spark, few)), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(table(spark, few[:1]), F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        topk.top_k(table(spark, [*few, (4, [1.0])]), F.lit(True))


def test_large_products_are_exact():
    rng = np.random.default_rng(4)
    for most in (100, 10**6, 10**9):
        x = rng.integers(-most, most, (20, 3))
        held = topk.Vectors(np.arange(20), np.zeros(20, bool), np.arange(20), np.sqrt((x.astype(float) ** 2).sum(1)), np.full(20, -np.inf), x)
        exact = x.astype(object) @ x.T.astype(object)
        assert (topk.products(held, slice(None), held, slice(None)) == exact).all()
    huge = topk.Vectors(*[np.zeros(1)] * 3, np.full(1, 2.0**40), np.zeros(1), np.full((1, 1), 2**40))
    with pytest.raises(OverflowError):
        topk.products(huge, slice(None), huge, slice(None))


def test_focus_keeps_every_vector_above_the_cosine():
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (500, 4))
    held = topk.Vectors(np.arange(500), np.zeros(500, bool), np.arange(500), np.sqrt((x.astype(float) ** 2).sum(1)), np.zeros(500), x)
    for query in held.unit[:40]:
        for cosine in (0.9, 0.97, 1.0):
            near = set(np.nonzero(held.unit @ query >= cosine)[0].tolist())
            assert near <= set(topk._focus(query, cosine, held).tolist())


def check_whitening(found, vectors, components=32):
    ids, x = sound(vectors, 64, 1_000_000)
    n, size = x.shape
    sums = x.sum(axis=0)
    away = (n * x.astype(object) - sums.astype(object)) ** 2
    centred = ((n * x - sums) / n).astype(float)
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    kept = min(components, int((values > 1e-10 * values[0]).sum()))
    assert len(found) == n * kept and set(found["component"]) == set(range(1, kept + 1))
    assert set(found["n"]) == {n} and found["identity_error"].nunique() == 1 and found["identity_error"].iloc[0] < 1e-9
    want = sorted((str(i), int(d)) for i, d in zip(ids, away.sum(axis=1), strict=True))
    first = found[found["component"] == 1]
    got = [(str(None if i != i else int(i)), int(d)) for i, d in zip(first["vec_id"], first["deviation"], strict=True)]
    assert sorted(got) == want
    for c in range(kept):
        rows = found[found["component"] == c + 1]
        assert np.allclose(rows["explained"], values[c] / values.sum(), rtol=1e-9)
        mine = centred @ axes[:, c] / np.sqrt(values[c])
        there = rows["whitened"].to_numpy()
        assert min(np.abs(np.sort(there) - np.sort(s * mine)).max() for s in (1, -1)) < 1e-7


def test_query_equals_numpy(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{cases.SF}/embeddings.parquet").collect()]
    check_whitening(QUERIES["op13_whitening"](spark, cases.SF).toPandas(), rows)


@pytest.mark.parametrize("size, components", [(6, 32), (20, 3)])
def test_whitening_of_odd_rows(spark, size, components):
    vectors = odd(seed=6, size=size)
    found = whitening.whiten(clashing(table(spark, vectors)).repartition(5), components=components)
    check_whitening(found.toPandas(), vectors, components)


def test_whitening_leaves_out_directions_without_variance(spark):
    rng = np.random.default_rng(7)
    flat = rng.normal(size=(200, 3)) @ rng.integers(-3, 4, (3, 60))
    flat = np.round(flat * 4) @ np.eye(60)
    rows = [(i, np.concatenate([v[:10], np.tile(v[:1], 50)]).tolist()) for i, v in enumerate(flat)]
    check_whitening(whitening.whiten(table(spark, rows)).toPandas(), rows)


def test_whitening_of_nothing(spark):
    none = table(spark, [(1, None), (2, [])])
    assert whitening.whiten(none).count() == 0 and whitening.whiten(cases.empty(none)).count() == 0
    assert whitening.whiten(table(spark, [(i, [1.0, 2.0]) for i in range(4)])).count() == 0
    with pytest.raises(Exception, match="components"):
        whitening.whiten(table(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def test_filter_damps_the_unwanted_spectrum():
    values = np.array([10.0, 6.0, 5.0, 1.0, 0.5, 0.0])
    passes = []
    damped = whitening._filtered(lambda b: passes.append(1) or values[:, None] * b, np.eye(6), 1.0, 10.0)
    growth = np.abs(np.diag(damped))
    assert growth[0] == pytest.approx(1) and (growth[1:3] > 1e3 * growth[3:].max()).all() and 1 < len(passes) <= whitening.DEGREE


def test_deviations_beyond_64_bits_are_null():
    centre = whitening.Centre(10**9, [10**15 + 7, 10**15])
    x = np.array([[1_000_000, 1_000_000], [1_000_003, 999_990]])
    want = [sum((10**9 * int(a) - s) ** 2 for a, s in zip(r, [10**15 + 7, 10**15], strict=True)) for r in x]
    assert centre.deviations(x) == [want[0], None] and want[1] >= 2**63
