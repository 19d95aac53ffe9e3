"""SimHash near-duplicates by exact comparison of tiles.

A fingerprint has 64 bits; two link at ``radius`` or fewer different bits. Different fingerprints are
sorted into tiles by the bit counts of their four quarters. Bit counts that differ by more than the
radius in sum rule a pair of tiles out; every pair that is left is compared in full, exclusive-or
and bit count, as numpy blocks. Large tiles are cut into chunks of ``CHUNK`` fingerprints, so a block
has a fixed size, however many fingerprints share a tile; every block is a row of a join and goes to
any task. Copies share a fingerprint and are compared once; a block returns at most a spanning
forest of its links, not its pairs, so a group of thousands of near copies stays small.

Defined results: NULL or wordless text has fingerprint zero and links like any other. Rows that
agree in id and text are one document. A component's id is the least id in it (NULLs aside); it is
NULL only if all ids in it are NULL. An empty table gives no rows.
"""

from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.operators.storage import materialise

from .columns import field, packed, unpacked
from .components import connected_components

SHINGLE = 3
RADIUS = 3
CHUNK = 512
_QUARTERS = 4


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of the word shingles, repeats included; XXH64 with seed 42."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()[min(shingle, len(parts)) - 1 :]
    hashed = np.fromiter((xxhash.xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, stops, strict=False)), "<u8", len(stops))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashed), 65536):
        bits = np.unpackbits(hashed[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashed), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, id: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """id, key (hash of the text) and fp of every row."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.select(F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("key"), of(F.col(text)).alias("fp"))


def _tile(fp: Column) -> Column:
    """The bit counts of the quarters as one number, five bits for each."""
    counts = [F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(0xFFFF)) for i in range(_QUARTERS)]
    return sum((c * 32**i for i, c in enumerate(counts[1:], 1)), counts[0]).cast("int")


def _steps(radius: int) -> list[int]:
    """Differences of tile numbers to itself and to later tiles within the radius, each pair of tiles once."""
    steps = []
    for moves in product(range(-radius, radius + 1), repeat=_QUARTERS):
        number = sum(m * 32**i for i, m in enumerate(moves))
        if sum(map(abs, moves)) <= radius and number >= 0:
            steps.append(number)
    return sorted(steps)


def _forest(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links between two blocks as edges to the first member of each group that they form."""
    rows, cols = [], []
    for i in range(0, len(left), 256):
        near = np.bitwise_count(left[i : i + 256, None] ^ right[None, :]) <= radius
        r, c = np.nonzero(near)
        rows.append(r + i)
        cols.append(c)
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    if same:
        rows, cols = rows[rows < cols], cols[rows < cols]
        nodes = left
    else:
        cols = cols + len(left)
        nodes = np.concatenate([left, right])
    if not len(rows):
        return nodes[:0], nodes[:0]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[rows], label[cols])
        fresh = label.copy()
        np.minimum.at(fresh, rows, least)
        np.minimum.at(fresh, cols, least)
        fresh = fresh[fresh]
        if (fresh == label).all():
            break
        label = fresh
    hung = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[hung], nodes[label[hung]]


def links(found: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints ``fp`` that links connect."""
    tiled = found.select("fp").distinct().withColumn("tile", _tile(F.col("fp")))
    tiled = materialise(tiled, "fingerprints")
    sizes = tiled.groupBy("tile").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    sizes = materialise(sizes, "tiles")  # at most 17 to the power 4 rows
    chunks = (
        tiled.join(F.broadcast(sizes), "tile")
        .groupBy("tile", F.pmod(F.xxhash64("fp"), "chunks").cast("int").alias("chunk"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    chunks = materialise(chunks, "chunks")
    step = F.explode(F.array(*map(F.lit, _steps(radius)))).alias("step")
    visits = chunks.select(F.col("tile").alias("from"), F.col("chunk").alias("visitor"), F.col("fps").alias("left"), step)
    visits = visits.withColumn("tile", F.col("from") + F.col("step")).drop("step")
    visits = visits.join(F.broadcast(sizes.select("tile")), "tile", "left_semi")
    blocks = visits.join(chunks, "tile").where((F.col("from") < F.col("tile")) | (F.col("visitor") <= F.col("chunk")))

    def compare(frames):
        for frame in frames:
            us, vs = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for left, right, same in zip(frame["left"], frame["fps"], frame["same"], strict=True):
                u, v = _forest(np.asarray(left).astype(np.uint64), np.asarray(right).astype(np.uint64), radius, same)
                us.append(u)
                vs.append(v)
            yield pd.DataFrame({"u": np.concatenate(us).view(np.int64), "v": np.concatenate(vs).view(np.int64)})

    same = (F.col("from") == F.col("tile")) & (F.col("visitor") == F.col("chunk"))
    return blocks.select("left", "fps", same.alias("same")).mapInPandas(compare, "u long, v long")


def near_duplicates(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """id, key (hash of the text), fp, root (of its component) and component (least id in it) of every row."""
    found = materialise(fingerprints(docs, id, text, shingle), "simhash")
    roots = connected_components(links(found, radius)).select(F.col("u").alias("fp"), "root")
    owned = found.groupBy("fp").agg(F.min("id").alias("least")).join(roots, "fp", "left")
    owned = materialise(owned.select("fp", "least", F.coalesce("root", "fp").alias("root")), "owned")
    least = owned.groupBy("root").agg(F.min("least").alias("component"))
    return found.join(owned.join(least, "root").select("fp", "root", "component"), "fp")


def drop_near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: the one with the least id, of equals the one with the least text hash."""
    grouped = near_duplicates(docs, id=id, text=text, **options)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("key"))).alias("first")
    kept = materialise(grouped.groupBy("root").agg(first).select(F.col("first.id").alias("_id"), F.col("first.key").alias("_key")), "kept")
    same = field(id).eqNullSafe(F.col("_id")) & (F.xxhash64(field(text)) == F.col("_key"))
    rows = packed(docs).join(kept, same).dropDuplicates(["_id", "_key"])
    return unpacked(rows, docs.columns, {})
