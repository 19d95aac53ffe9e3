"""Finding windows that stand more than once, by indexes over shards that content chooses.

A window is ``size`` units (words or bytes) in a row. Its anchor is the least hash of its ``gram``-unit
grams, so equal windows have equal anchors, and a shard that holds all windows of an anchor holds
all copies of each of them. The steps:

1. Every block counts its anchors' occurrences. They are summed over all blocks, and a join tells each
   block which of its anchors occur twice or more in all. An anchor that occurs once belongs to
   windows that stand once. Most text ends here. A key is one row per block that holds it, however
   often, and is counted per task before it moves, so rows grow with the text and no key is hot.
2. Runs of windows with the same living anchor are written out as segments, equal segments of a
   block once, with their places. An anchor that occurs more than ``hot`` times (a common phrase)
   would make an unbounded group; its windows are asked about again, each by a hash of the whole
   window, and those that repeat are dealt by it, so that a group holds copies of one window, which
   are counted before they move. Only these stretches of text are written out for that.
3. Segments are grouped into shards of a few MB. An index over a shard's different segments, with
   the number of copies of each, tells which of their windows stand twice or more.
4. The answers go back to the segments' places, and each block marks what they cover.

Which index a shard gets is the operator's choice; it takes (segments, copies) and returns a mask of
repeated windows for each segment.
"""

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.operators.storage import materialise

from .blocks import dump, load, pack, unpack

BLOCK_BYTES = 4 << 20
SHARD_BYTES = 4 << 20
HOT = 20_000
STRETCH = 1 << 20  # windows whose anchors are computed at once

Index = Callable[[list[bytes], np.ndarray, int], list[np.ndarray]]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Bytes:
    """Units of one byte."""

    codes = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)  # one random number for each byte

    def split(self, text: bytes):
        return text

    def hashed(self, texts: list[bytes]) -> np.ndarray:
        return self.codes[np.frombuffer(b"".join(texts), np.uint8)]

    def joined(self, units: bytes) -> bytes:
        return units


class Words:
    """Units between white space (space and \\x09-\\x0D), unchanged."""

    factor = 0x9E3779B97F4A7C15  # odd, so that it has an inverse

    def split(self, text: bytes):
        return text.split()

    def hashed(self, texts: list[list[bytes]]) -> np.ndarray:
        """A word's hash is a polynomial of its bytes, taken from sums that run over a stretch of text.

        Words of one hash share a shard and no more: the index compares the words themselves.
        """
        line = np.frombuffer(b" ".join([w for words in texts for w in words]), np.uint8)
        if not len(line):
            return np.zeros(0, np.uint64)
        gaps = np.flatnonzero(line == 32)
        starts, ends = np.append(0, gaps + 1), np.append(gaps, len(line))
        result = np.zeros(len(starts), np.uint64)
        cuts = np.append(np.flatnonzero(np.diff(starts // STRETCH, prepend=-1)), len(starts))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            base, n = starts[i], int(ends[j - 1] - starts[i])
            powers = np.cumprod(np.full(n, self.factor, np.uint64))
            sums = np.append(np.uint64(0), np.cumsum(Bytes.codes[line[base : base + n]] * powers, dtype=np.uint64))
            inverse = np.cumprod(np.full(n, pow(self.factor, -1, 1 << 64), np.uint64))
            result[i:j] = (sums[ends[i:j] - base] - sums[starts[i:j] - base]) * inverse[starts[i:j] - base]
        return _mixed(result)

    def joined(self, units: list[bytes]) -> bytes:
        return b" ".join(units)


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram`` units in a row, built by doubling."""
    n = len(codes) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    result, done, power, span, factor = None, 0, codes, 1, 0xD1342543DE82EF95
    while True:
        scale = np.uint64(factor)
        if gram & span:
            result = power[:n].copy() if result is None else result * scale + power[done : done + n]
            done += span
        if span * 2 > gram:
            return _mixed(result)
        power = power[:-span] * scale + power[span:]
        span, factor = span * 2, factor * factor % (1 << 64)


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """The least (or greatest) of each ``width`` values in a row."""
    span = 1
    while span * 2 <= width:
        values = best(values[:-span], values[span:])
        span *= 2
    return best(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def runs_of(codes: np.ndarray, sizes: list[int], size: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor (anchors, starts, lengths) and the hashes of all grams that are anchors.

    ``codes`` are the units of texts of these sizes, one after another. A run is cut after
    4 * ``size`` windows, counted from its own start.
    """
    ends = np.cumsum(np.array(sizes, np.int64))
    begins = ends - np.array(sizes, np.int64)
    long = ends - begins >= size
    steps = np.zeros(len(codes) + 1, np.int8)
    np.add.at(steps, begins[long], 1)
    np.add.at(steps, ends[long] - size + 1, -1)
    inside = np.cumsum(steps[:-1], dtype=np.int8).astype(bool)  # windows that stay in their text
    width = size - gram + 1
    parts: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for at in range(0, len(codes) - size + 1, STRETCH):
        n = min(STRETCH, len(codes) - size + 1 - at)
        hashes = gram_hashes(codes[at : at + n + size - 1], gram)
        least = np.where(inside[at : at + n], _sliding(hashes, width, np.minimum), np.uint64(0))
        fresh = np.append(0, np.nonzero(least[1:] != least[:-1])[0] + 1)
        lengths = np.diff(np.append(fresh, n))
        for i in np.nonzero((lengths > 4 * size) & (least[fresh] > 0))[0][::-1].tolist():
            fresh = np.insert(fresh, i + 1, np.arange(fresh[i] + 4 * size, fresh[i] + lengths[i], 4 * size))
        lengths = np.diff(np.append(fresh, n))
        own = least[fresh] > 0
        edge = np.zeros(width - 1, np.uint64)  # grams near either end are in fewer windows
        covering = _sliding(np.concatenate([edge, least, edge]), width, np.maximum)
        parts.append((least[fresh][own], fresh[own] + at, lengths[own], hashes[covering == hashes]))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def counted_keys(block: int, keys: np.ndarray) -> pd.DataFrame:
    unique, counts = np.unique(keys, return_counts=True)
    return pd.DataFrame({"block": block, "key": unique.view(np.int64), "n": counts})


def repeated_keys(asks: DataFrame, hot: int) -> DataFrame:
    """block, key and whether hot of the keys (block, key, n) that stand twice or more in all blocks."""
    stored = materialise(asks, "keys")
    total = stored.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    return stored.select("block", "key").join(total.select("key", (F.col("n") > hot).alias("hot")), "key")


def _states(keys: np.ndarray, reply: pd.DataFrame) -> np.ndarray:
    """0: stands once, 1: more often, 2: hot; of each key."""
    if not len(reply):
        return np.zeros(len(keys), np.uint8)
    known = reply["key"].to_numpy(np.int64)
    order = np.argsort(known)
    known, hot = known[order], reply["hot"].to_numpy(bool)[order]
    wanted = keys.view(np.int64)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[at] == wanted, 1 + hot[at], 0).astype(np.uint8)


def repeated_windows(
    docs: DataFrame,
    index: Index,
    units: Callable,
    *,
    size: int,
    gram: int,
    id: str = "doc_id",
    text: str = "text",
    hot: int = HOT,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row per document: id, n_units, n_removed, starts and ends (of removed runs of units) and kept (bytes)."""
    blocks = pack(docs, id, text, BLOCK_BYTES)

    def of_block(payload: bytes):
        kind = units()
        split = [kind.split(t) for t in unpack(payload)[1]]
        return kind, split, kind.hashed(split)

    def asked(frames):
        for frame in frames:
            for number, payload in zip(frame["block"], frame["payload"], strict=True):
                _, split, codes = of_block(payload)
                yield counted_keys(number, runs_of(codes, [len(s) for s in split], size, gram)[3])

    keys = "block long, key long, n long"
    replies = repeated_keys(blocks.select("block", "payload").mapInPandas(asked, keys), hot)

    def segment_rows(number, kind, split, bases, chosen) -> pd.DataFrame:
        """Segments (key, first unit, windows) of pieces of text, equal ones in one row with all places.

        ``bases`` says which document each piece is of, and where it begins in it.
        """
        ends = np.cumsum([len(s) for s in split])
        rows: dict[bytes, list] = {}
        pieces = np.searchsorted(ends, chosen[1], "right")
        firsts = chosen[1] - np.append(0, ends)[pieces]
        for key, piece, first, n in zip(*(x.tolist() for x in (chosen[0], pieces, firsts, chosen[2])), strict=True):
            segment = kind.joined(split[piece][first : first + n + size - 1])
            row = rows.setdefault(xxhash.xxh3_128_digest(segment), [key, segment, []])
            row[2].append((bases[piece][0], bases[piece][1] + first))
        return pd.DataFrame(
            {
                "kind": "segment",
                "block": number,
                "key": np.array([r[0] for r in rows.values()], np.uint64).view(np.int64),
                "digest": list(rows),
                "segment": [r[1] for r in rows.values()],
                "copies": [len(r[2]) for r in rows.values()],
                "places": [dump(np.array(r[2], np.int64)) for r in rows.values()],
            }
        )

    def hot_rows(number, kind, split, codes, runs) -> list[pd.DataFrame]:
        """Stretches of windows with hot anchors, and what is asked about each of their windows."""
        at = np.concatenate([np.arange(s, s + n) for s, n in zip(runs[1].tolist(), runs[2].tolist(), strict=True)])
        ends = np.cumsum([len(s) for s in split])
        pieces = np.searchsorted(ends, at, "right")
        # windows of one document in a row make a stretch; those of two documents are never neighbours
        cuts = np.append(0, np.nonzero(np.diff(at) != 1)[0] + 1)
        lengths = np.diff(np.append(cuts, len(at)))
        firsts = (at - np.append(0, ends)[pieces])[cuts]
        stretches = list(zip(pieces[cuts].tolist(), firsts.tolist(), lengths.tolist(), strict=True))
        texts = [kind.joined(split[doc][first : first + n + size - 1]) for doc, first, n in stretches]
        places = [dump(np.array([[doc, first]], np.int64)) for doc, first, _ in stretches]
        asks = counted_keys(number, window_hashes(codes, at, size))
        return [
            pd.DataFrame({"kind": "stretch", "block": number, "segment": texts, "places": places}),
            pd.DataFrame({"kind": "keys", "block": [number], "segment": [asks["key"].to_numpy().tobytes()], "places": [asks["n"].to_numpy().tobytes()]}),
        ]

    columns = ["kind", "block", "key", "digest", "segment", "copies", "places"]
    schema = "kind string, block long, key long, digest binary, segment binary, copies long, places binary"

    def written(frames: list[pd.DataFrame]) -> pd.DataFrame:
        whole = pd.concat([f.astype(object) for f in frames]) if frames else pd.DataFrame()
        return whole.reindex(columns=columns).astype(object).where(lambda x: x.notna(), None)

    def segments(block: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for number, payload in zip(block["block"], block["payload"], strict=True):
            kind, split, codes = of_block(payload)
            anchors, starts, lengths, _ = runs_of(codes, [len(s) for s in split], size, gram)
            states = _states(anchors, reply)
            runs, bases = (anchors, starts, lengths), [(i, 0) for i in range(len(split))]
            frames.append(segment_rows(number, kind, split, bases, [x[states == 1] for x in runs]))
            if (states == 2).any():
                frames += hot_rows(number, kind, split, codes, [x[states == 2] for x in runs])
        return written(frames)

    def joined(left: DataFrame, right: DataFrame):
        return left.groupBy("block").cogroup(right.groupBy("block"))

    packed = blocks.select("block", "payload")
    stored = materialise(joined(packed, replies).applyInPandas(segments, schema), "segments")
    found = stored.where("kind = 'segment'").select("block", "key", "digest", "segment", "copies", "places")
    grouped = found.select("key", "digest", "segment", "copies")

    asks = stored.where("kind = 'keys'").select("block", "segment", "places")
    if asks.limit(1).count():

        def spread(frames):
            for frame in frames:
                for number, some, counts in zip(frame["block"], frame["segment"], frame["places"], strict=True):
                    yield pd.DataFrame({"block": number, "key": np.frombuffer(some, np.int64), "n": np.frombuffer(counts, np.int64)})

        def hot_segments(stretch: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
            if not len(stretch):
                return pd.DataFrame()
            kind = units()
            split = [kind.split(t) for t in stretch["segment"]]
            codes = kind.hashed(split)
            bases = [tuple(load(p)[0][0].tolist()) for p in stretch["places"]]
            ends = np.cumsum([len(s) for s in split]).tolist()
            at = np.concatenate([np.arange(e - len(s), e - size + 1) for s, e in zip(split, ends, strict=True)])
            hashes = window_hashes(codes, at, size)
            repeated = _states(hashes, reply) > 0
            chosen = [hashes[repeated], at[repeated], np.ones(int(repeated.sum()), np.int64)]
            return written([segment_rows(stretch["block"].iloc[0], kind, split, bases, chosen)])

        stretches = stored.where("kind = 'stretch'").select("block", "segment", "places")
        more = materialise(joined(stretches, repeated_keys(asks.mapInPandas(spread, keys), hot)).applyInPandas(hot_segments, schema), "hot-segments").select(found.columns)
        counted = more.groupBy("key", "digest", "segment").agg(F.sum("copies").alias("copies"))
        grouped, found = grouped.unionByName(counted), found.unionByName(more)

    total = found.agg(F.sum(F.octet_length("segment"))).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_bytes))

    def indexed(frame: pd.DataFrame) -> pd.DataFrame:
        different = frame.groupby("digest", sort=False).agg(segment=("segment", "first"), copies=("copies", "sum"))
        masks = index(list(different["segment"]), different["copies"].to_numpy(np.int64), size)
        hits = [(d, dump(np.packbits(m), np.array([len(m)]))) for d, m in zip(different.index, masks, strict=True) if m.any()]
        return pd.DataFrame({"digest": [d for d, _ in hits], "mask": [m for _, m in hits]})

    dealt_out = grouped.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    # equal segments have the same windows and so the same anchor: one shard answers for them
    masks = materialise(dealt_out.groupBy("shard").applyInPandas(indexed, "digest binary, mask binary"), "masks")
    marks = found.select("block", "digest", "places").join(masks, "digest").select("block", "places", "mask")

    def removed(block: pd.DataFrame, mark: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for payload in block["payload"]:
            ids, texts = unpack(payload)
            kind = units()
            split = [kind.split(t) for t in texts]
            steps: dict[int, list] = {}
            for places, mask in zip(mark["places"], mark["mask"], strict=True):
                bits, n = load(mask)
                windows = np.nonzero(np.unpackbits(bits, count=int(n[0])))[0]
                for doc, first in load(places)[0].tolist():
                    steps.setdefault(doc, []).append(windows + first)
            rows = [_kept(kind, s, steps.get(i), size) for i, s in enumerate(split)]
            names = ("n_units", "n_removed", "starts", "ends", "kept")
            frames.append(pd.DataFrame({"id": ids} | {name: [r[k] for r in rows] for k, name in enumerate(names)}))
        return pd.concat(frames) if frames else pd.DataFrame()

    kind = docs.schema[id].dataType.simpleString()
    schema_out = f"id {kind}, n_units long, n_removed long, starts array<long>, ends array<long>, kept binary"
    return joined(packed, marks).applyInPandas(removed, schema_out).withColumnRenamed("id", id)


def window_hashes(codes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows that start at the given units."""
    result = np.zeros(len(at), np.uint64)
    for first in range(0, len(at), STRETCH):
        some = at[first : first + STRETCH]
        value = np.zeros(len(some), np.uint64)
        for k in range(size):
            value = value * np.uint64(0xD1342543DE82EF95) + codes[some + k]
        result[first : first + STRETCH] = _mixed(value)
    return result


def _kept(kind, units, windows: list[np.ndarray] | None, size: int):
    """n_units, n_removed, starts and ends of removed runs, and what is left."""
    if not windows:
        return len(units), 0, [], [], kind.joined(units)
    first = np.unique(np.concatenate(windows))
    new = np.append(True, first[1:] > first[:-1] + size)
    starts = first[new]
    ends = np.append(first[np.nonzero(new)[0][1:] - 1], first[-1]) + size
    edges = [0, *np.stack([starts, ends], axis=1).ravel().tolist(), len(units)]
    pieces = [units[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
    kept = b"".join(pieces) if isinstance(units, bytes) else [w for p in pieces for w in p]
    return len(units), int((ends - starts).sum()), starts.tolist(), ends.tolist(), kind.joined(kept)
