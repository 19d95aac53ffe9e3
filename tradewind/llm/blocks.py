"""Documents packed into blocks, and lookups of many blocks' keys in one distributed table.

A block holds the documents of a few MB of text, taken from one partition as they come, in one
compressed row: it moves between tasks as a whole, and keys that its documents share are asked for
once. Block sizes do not depend on sources, ids or copies, so no block is hot; only a single text
that is longer than a block makes a larger one.

``lookup`` answers each block's keys from a table that all blocks make together. Keys are dealt into
parts. The parts' tables grow by a tree of merges with a bounded fan-in. A part's questions are
answered together, unless they are more than ``answer_bytes``: then they are dealt to so many tasks
that each gets about that much, and only then the part's table is copied. A table is a merge of its
part's questions, so all copies together grow with the bytes of the questions, not with blocks times
tables.
"""

import io
import pickle
import struct
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.operators.storage import materialise

BLOCK_BYTES = 8 << 20
FAN_IN = 256
PART_BYTES = 16 << 20  # of text for each part of a table
ANSWER_BYTES = 64 << 20  # of questions that one task answers

Merge = Callable[[list[bytes]], bytes]
Answer = Callable[[bytes, list[bytes]], list[bytes]]


def pack(docs: DataFrame, id: str, text: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A stored table of blocks: block (number), n_bytes (of its texts) and payload."""

    def run(batches):
        held, size, made = [], 0, 0

        def block():
            sink = io.BytesIO()
            table = pa.Table.from_batches(held)
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table)
            number = TaskContext.get().partitionId() * (1 << 32) + made
            return pa.RecordBatch.from_pydict(
                {"block": pa.array([number], pa.int64()), "n_bytes": [size], "payload": pa.array([sink.getvalue()], pa.binary())}
            )

        for batch in batches:
            texts = batch.column(1)
            sizes = np.frombuffer(pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.int64)
            start = 0
            for i, n in enumerate(sizes.tolist()):
                if size and size + n > block_bytes:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    yield block()
                    held, size, start, made = [], 0, i, made + 1
                size += n
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield block()

    packed = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, "block long, n_bytes long, payload binary"
    )
    return materialise(packed, "blocks")


def unpack(payload: bytes) -> tuple[list, list[bytes]]:
    """The ids and texts of a block; a NULL text is empty."""
    table = pa.ipc.open_stream(payload).read_all()
    return table.column("id").to_pylist(), [(t or "").encode() for t in table.column("text").to_pylist()]


def parts_for(blocks: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """Parts for a table that grows with the text."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))


def dealt(part: np.ndarray, parts: int) -> Iterable[tuple[int, np.ndarray]]:
    """(part, places of its keys in order) of each part that has keys."""
    part = part.astype(np.uint16) if parts <= 1 << 16 else part  # which numpy sorts by radix
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.unique(part).tolist():
        yield p, order[bounds[p] : bounds[p + 1]]


def tables(asks: DataFrame, merge: Merge, fan_in: int = FAN_IN) -> DataFrame:
    """part and table: the asks of a part merged, a bounded number at a time."""
    groups = asks.select("block").distinct().count()
    level = asks.select("part", F.xxhash64("block").alias("slot"), F.col("ask").alias("table"))

    def merged(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [keys[0]], "slot": [keys[1]], "table": [merge(list(frame["table"]))]})

    while True:
        groups = -(-groups // fan_in)
        level = level.withColumn("slot", F.pmod("slot", F.lit(max(groups, 1)))).groupBy("part", "slot")
        level = materialise(level.applyInPandas(merged, "part int, slot long, table binary"), "part-tables")
        if groups <= 1:
            return level.drop("slot")


def slots_of(asks: DataFrame, answer_bytes: int = ANSWER_BYTES) -> DataFrame:
    """part and slots: the number of tasks that answer its questions, a row per part."""
    needed = F.ceil(F.sum(F.octet_length("ask")) / answer_bytes)
    return asks.groupBy("part").agg(F.greatest(needed, F.lit(1)).cast("long").alias("slots"))


def lookup(asks: DataFrame, found: DataFrame, answer: Answer, answer_bytes: int = ANSWER_BYTES) -> DataFrame:
    """block, part and reply of each ask (part, block, ask), from the ``tables`` of the parts."""
    slots = materialise(slots_of(asks, answer_bytes), "slots")
    salted = asks.join(slots, "part").withColumn("slot", F.pmod(F.xxhash64("block"), F.col("slots")))
    copies = found.join(slots, "part").select("part", "table", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"))

    def answered(asked: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        replies = answer(table["table"].iloc[0], list(asked["ask"])) if len(asked) else []
        return pd.DataFrame({"block": asked["block"], "part": asked["part"], "reply": replies})

    groups_of = salted.groupBy("part", "slot").cogroup(copies.groupBy("part", "slot"))
    return groups_of.applyInPandas(answered, "block long, part int, reply binary")


def with_replies(blocks: DataFrame, replies: DataFrame, apply: Callable, schema: str) -> DataFrame:
    """``apply(ids, texts, {part: reply})`` of each block as rows."""

    def run(block: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
        frames = [apply(*unpack(p), dict(zip(reply["part"], reply["reply"], strict=True))) for p in block["payload"]]
        return frames[0] if frames else pd.DataFrame()

    cogrouped = blocks.select("block", "payload").groupBy("block").cogroup(replies.groupBy("block"))
    return cogrouped.applyInPandas(run, schema)


def sorted_bytes(keys: np.ndarray) -> np.ndarray:
    """Ascending keys as differences, which compress."""
    return np.diff(keys, prepend=keys.dtype.type(0))


def dump(*arrays: np.ndarray) -> bytes:
    return pickle.dumps(arrays, protocol=5)


def load(blob: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(blob)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers in few bytes: first all lowest bytes, then all next ones, compressed."""
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<cBI", a.dtype.kind.encode(), a.itemsize, len(a)) for a in arrays)
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return head + pa.compress(planes, codec="zstd", asbytes=True)


def unsqueeze(blob: bytes) -> tuple[np.ndarray, ...]:
    kinds = [struct.unpack_from("<cBI", blob, 1 + 6 * i) for i in range(blob[0])]
    sizes = [width * n for _, width, n in kinds]
    planes = np.frombuffer(pa.decompress(blob[1 + 6 * len(kinds) :], sum(sizes), "zstd", asbytes=True), np.uint8)
    arrays, at = [], 0
    for (kind, width, n), size in zip(kinds, sizes, strict=True):
        bytes_ = np.ascontiguousarray(planes[at : at + size].reshape(width, n).T)
        arrays.append(bytes_.view(f"{kind.decode()}{width}").reshape(n))
        at += size
    return tuple(arrays)
