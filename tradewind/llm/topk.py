"""Exact top-k by inner product of whole-numbered vectors, which stand in buckets by length.

Vectors are numbered by falling length; ``BUCKET`` of them in a row are a bucket, and ``STRIP``
buckets a strip. Each query starts from a score that it surely reaches, its k-th best in the first
bucket. Over the query's length that is the length that a vector needs at least. Queries are sorted
by it and cut into groups of ``QUERIES``, and a group meets the strips whose longest vector is long
enough for one of its queries. Such a meeting is a tile of bounded size that may go to any task.

In a tile the buckets come by falling length, and the scores to reach rise on the way. A score over
the lengths of the query and of the bucket's longest vector is the cosine that the bucket's vectors
need, the local threshold, and it says how the bucket is pruned. Above 1 the bucket is skipped. From
``COORDINATE_FROM`` on, vectors are found in lists sorted by coordinate: in each of the ``FOCUS``
largest coordinates of the query they must lie within the bounds that the cosine leaves them. Below,
the vectors that are long enough are taken, which stand in front. What is left is verified by its
product. Bounds are wider by ``SLACK`` than they need to be, so neither rounding nor ties lose a row.

Tiles grow with queries times vectors where lengths do not tell vectors apart, as the exact search
of a share of all rows against all rows must.

Defined results: vectors that are NULL, empty or hold NULL, NaN or infinite components take no part.
All others must have the same number of components, or the job fails. Rows are told apart by their
place: copies find each other, and a repeated query id is as many queries. A NULL id is a candidate,
last among equal scores; whether it is a query is up to ``is_query``, where NULL means no. Products
are exact, and one of 2**63 or more fails the job. An empty table gives no rows. Other columns are
not read.
"""

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.operators.keys import dense_keys
from tradewind.operators.storage import materialise

from .columns import whole_vectors

BUCKET = 2048
STRIP = 4
QUERIES = 512
COORDINATE_FROM = 0.9
FOCUS = 4
SLACK = 1e-9

_PACKED = "n long, first long, ids binary, no_ids binary, places binary, lengths binary, reach binary, data binary, kind string"


class Vectors:
    """Some rows side by side: ids, places, lengths, the score to reach (of queries) and components."""

    def __init__(self, ids, no_ids, places, lengths, reach, data):
        self.ids, self.no_ids, self.places, self.lengths, self.reach, self.data = ids, no_ids, places, lengths, reach, data
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._unit = None

    @classmethod
    def of(cls, rows: pd.DataFrame) -> "Vectors":
        ids = rows["id"].astype("Int64")
        data = np.stack(rows["x"].to_numpy()).astype(np.int64)
        reach = rows["reach"].to_numpy(float) if "reach" in rows else np.full(len(rows), -np.inf)
        places = rows["place"].to_numpy(np.int64)
        return cls(ids.fillna(0).to_numpy(np.int64), ids.isna().to_numpy(bool), places, rows["length"].to_numpy(float), reach, data)

    def packed(self) -> dict:
        least, most = int(self.data.min()), int(self.data.max())
        kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= least and most <= np.iinfo(k).max)
        arrays = {"ids": self.ids, "no_ids": self.no_ids, "places": self.places, "lengths": self.lengths, "reach": self.reach}
        packed = {name: [a.tobytes()] for name, a in arrays.items()}
        return {"n": [len(self.ids)], "first": [int(self.places.min())], **packed, "data": [self.data.astype(kind).tobytes()], "kind": [kind]}

    @classmethod
    def unpacked(cls, row) -> "Vectors":
        kinds = {"ids": np.int64, "no_ids": bool, "places": np.int64, "lengths": float, "reach": float}
        arrays = {name: np.frombuffer(getattr(row, name), kind) for name, kind in kinds.items()}
        return cls(**arrays, data=np.frombuffer(row.data, row.kind).astype(np.int64).reshape(row.n, -1))

    @property
    def unit(self) -> np.ndarray:
        """The vectors at length 1."""
        if self._unit is None:
            self._unit = self.data / np.maximum(self.lengths, 1e-300)[:, None]
        return self._unit

    def by_coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the order of coordinate ``f``, and the coordinate in that order."""
        if f not in self._lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self._lists[f] = order, self.unit[order, f]
        return self._lists[f]


def products(queries: Vectors, rows, vectors: Vectors, columns) -> np.ndarray:
    """Exact products of some queries with some vectors, in floats where these are exact."""
    bound = float(queries.lengths.max(initial=0) * vectors.lengths.max(initial=0)) * (1 + SLACK)
    if bound >= 2**63:
        raise OverflowError("an inner product may not fit 64 bits")
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    return (queries.data[rows].astype(kind) @ vectors.data[columns].astype(kind).T).astype(np.int64)


def _focus(query: np.ndarray, cosine: float, bucket: Vectors) -> np.ndarray:
    """Places of the vectors whose focus coordinates allow at least this cosine with the unit vector ``query``."""
    focus = np.argsort(-np.abs(query), kind="stable")[:FOCUS]
    cosine = min(cosine, 1.0)
    spread = np.sqrt(np.maximum((1 - cosine**2) * (1 - query[focus] ** 2), 0)) + SLACK
    low = query[focus] * cosine - spread
    low = np.where(np.arccos(np.clip(query[focus], -1, 1)) + np.arccos(cosine) >= np.pi, -2.0, low)
    high = np.where(query[focus] >= cosine, 2.0, query[focus] * cosine + spread)
    ranges = []
    for f, a, b in zip(focus.tolist(), low, high, strict=True):
        order, values = bucket.by_coordinate(f)
        ranges.append((order, int(np.searchsorted(values, a, "left")), int(np.searchsorted(values, b, "right"))))
    order, start, stop = min(ranges, key=lambda r: r[2] - r[1])
    found = order[start:stop]
    inside = bucket.unit[found][:, focus]
    return found[((inside >= low) & (inside <= high)).all(axis=1)]


class Best:
    """The best ``k`` of each query so far."""

    def __init__(self, queries: Vectors, k: int):
        self.queries, self.k, self.reach = queries, k, queries.reach.copy()
        self.rows, self.scores, self.ids, self.no_ids = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, no_ids: np.ndarray) -> None:
        pairs = zip((self.rows, self.scores, self.ids, self.no_ids), (rows, scores, ids, no_ids), strict=True)
        rows, scores, ids, no_ids = (np.concatenate(p) for p in pairs)
        order = np.lexsort((ids, no_ids, -scores, rows))
        sorted_rows = rows[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_rows, sorted_rows, "left")
        kept = order[rank < self.k]
        self.rows, self.scores, self.ids, self.no_ids = rows[kept], scores[kept], ids[kept], no_ids[kept]
        last = rank[rank < self.k] == self.k - 1
        np.maximum.at(self.reach, self.rows[last], self.scores[last].astype(float))

    def look_into(self, bucket: Vectors) -> None:
        """Add what a bucket has; its vectors come by falling length and their places in a row."""
        queries, longest = self.queries, bucket.lengths[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            needed = np.where(self.reach > 0, self.reach / queries.lengths, 0.0) * (1 - SLACK)
            local = np.where(needed > 0, needed / longest, 0.0)
        by_length = np.nonzero(local < COORDINATE_FROM)[0]
        by_coordinate = np.nonzero((local >= COORDINATE_FROM) & (local <= 1))[0]
        if len(by_length):
            enough = np.searchsorted(-bucket.lengths, -needed[by_length], "right")  # vectors in front that are long enough
            scores = products(queries, by_length, bucket, slice(0, int(enough.max())))
            wanted = (scores >= self.reach[by_length, None]) & (np.arange(scores.shape[1]) < enough[:, None])
            rows, columns = np.nonzero(wanted)
            self._found(by_length[rows], columns, scores[rows, columns], bucket)
        for row in by_coordinate.tolist():
            columns = _focus(queries.unit[row], float(local[row]), bucket)
            if len(columns):
                scores = products(queries, [row], bucket, columns)[0]
                near = scores >= self.reach[row]
                self._found(np.full(int(near.sum()), row), columns[near], scores[near], bucket)

    def _found(self, rows: np.ndarray, columns: np.ndarray, scores: np.ndarray, bucket: Vectors) -> None:
        other = self.queries.places[rows] != bucket.places[columns]
        rows, columns = rows[other], columns[other]
        if len(rows):
            self.add(rows, scores[other], bucket.ids[columns], bucket.no_ids[columns])


def _numbered(vectors: DataFrame, id: str, vector: str, scale: float, is_query: Column) -> DataFrame:
    """place (from 0, by falling length), id, x, length and is_query of each vector that takes part."""
    rows = whole_vectors(vectors.withColumn("_query", F.coalesce(is_query, F.lit(False))), vector, scale).select(
        F.col(id).cast("long").alias("id"), "x", F.col("_query").alias("is_query")
    )
    squares = F.aggregate("x", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    rows = rows.withColumn("length", F.sqrt(squares))
    order = [F.desc("length"), F.asc_nulls_last("id"), F.asc("x")]
    return dense_keys(rows, order, "place").withColumn("place", F.col("place") - 1)


def _grouped(rows: DataFrame, name: str) -> DataFrame:
    """The rows of each value of ``name``, as many as the caller dealt to it, packed into one row."""

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({name: [key[0]], **Vectors.of(frame.sort_values("place")).packed()})

    return rows.groupBy(name).applyInPandas(pack, f"{name} long, {_PACKED}")


def _started(queries: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """The queries with ``reach``, their k-th best score in the first bucket, which is one broadcast row."""

    def start(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                group = Vectors.unpacked(row)
                best = Best(group, k)
                best.look_into(Vectors.unpacked(SimpleNamespace(**row.first_bucket)))
                ids = pd.Series(group.ids, dtype="Int64").mask(group.no_ids)
                yield pd.DataFrame(
                    {"place": group.places, "id": ids, "x": list(group.data), "length": group.lengths, "reach": best.reach}
                )

    one = first.select(F.lit(True).alias("_on"), F.struct("*").alias("first_bucket"))
    joined = queries.withColumn("_on", F.lit(True)).join(F.broadcast(one), "_on").drop("_on")
    return joined.mapInPandas(start, "place long, id long, x array<long>, length double, reach double")


def _tiles(groups: DataFrame, strips: DataFrame) -> DataFrame:
    """(grp, strip) to meet: of each group the strips up to the last whose longest vector is long enough.

    Strips come by falling length, so their number for a group is a running count of both, sorted by
    length. This is one row per strip and group, some thousandths of the vectors.
    """
    marks = strips.select(F.col("longest").alias("length"), F.lit(None).cast("long").alias("grp"))
    marks = marks.unionByName(groups.select(F.col("needed").alias("length"), "grp"))
    until = Window.orderBy(F.desc("length"), F.asc_nulls_first("grp")).rowsBetween(Window.unboundedPreceding, 0)
    counted = marks.withColumn("n", F.count_if(F.col("grp").isNull()).over(until)).where("grp IS NOT NULL AND n > 0")
    return counted.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("strip"))


def top_k(
    vectors: DataFrame,
    is_query: Column,
    *,
    id: str = "vec_id",
    vector: str = "embedding",
    scale: float = 256.0,
    k: int = 5,
    bucket: int = BUCKET,
    strip: int = STRIP,
    queries: int = QUERIES,
) -> DataFrame:
    """query_id, rank, id and score of the ``k`` rows with the highest products with each query, itself aside.

    Components are taken as floor(scale * component). Equal scores go by id.
    """
    rows = materialise(_numbered(vectors, id, vector, scale, is_query), "vectors")
    sizes = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if sizes[0] != sizes[1]:
        raise ValueError(f"vectors have {sizes[0]} to {sizes[1]} components")
    plain = rows.withColumn("bucket", F.floor(F.col("place") / bucket)).drop("is_query")
    buckets = materialise(_grouped(plain, "bucket").withColumn("strip", F.floor(F.col("bucket") / strip)), "buckets")

    asked = dense_keys(rows.where("is_query").drop("is_query"), [F.asc("place")], "number")
    asked = _grouped(asked.withColumn("grp", F.floor((F.col("number") - 1) / queries)).drop("number"), "grp")
    started = _started(asked, buckets.where("bucket = 0"), k)
    needed = F.when((F.col("reach") > 0) & (F.col("length") > 0), F.col("reach") / F.col("length") * (1 - SLACK)).otherwise(0.0)
    started = dense_keys(started.withColumn("needed", needed), [F.desc("needed"), F.asc("place")], "number")
    started = started.withColumn("grp", F.floor((F.col("number") - 1) / queries))
    started = materialise(started.drop("number"), "queries")
    asked = _grouped(started.drop("needed"), "grp")

    longest = plain.groupBy(F.floor(F.col("bucket") / strip).alias("strip")).agg(F.max("length").alias("longest"))
    tiles = materialise(_tiles(started.groupBy("grp").agg(F.min("needed").alias("needed")), longest), "tiles")

    def search(group: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        found = {"place": [], "query_id": [], "id": [], "score": []}
        if len(group) and len(met):
            held = Vectors.unpacked(next(group.itertuples()))
            best = Best(held, k)
            for row in met.sort_values("bucket").itertuples():
                best.look_into(Vectors.unpacked(row))
            found = {
                "place": held.places[best.rows],
                "query_id": pd.Series(held.ids[best.rows], dtype="Int64").mask(held.no_ids[best.rows]),
                "id": pd.Series(best.ids, dtype="Int64").mask(best.no_ids),
                "score": best.scores,
            }
        return pd.DataFrame(found)

    left = asked.join(tiles, "grp").groupBy("grp", "strip")
    right = buckets.join(tiles, "strip").groupBy("grp", "strip")
    found = left.cogroup(right).applyInPandas(search, "place long, query_id long, id long, score long")
    order = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
