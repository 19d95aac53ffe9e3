"""Byte-level BPE as a monoid: encodings of neighbours are joined, so a text is encoded by a tree.

A piece (one match of the pattern) is halved down to short leaves, each leaf is merged directly, and
two encodings are joined by encoding a window of tokens around the seam anew. A sequence of tokens
is the encoding of its bytes exactly if every two neighbours in it are the encoding of their own
bytes. So the window has settled once its first and last token agree with the tokens outside;
until then it is doubled. Pieces never merge with each other, so above them the tree concatenates.
Decoding looks up each token's bytes and concatenates up the same kind of tree.

Defined results: NULL text is empty text, with no tokens; every text and every sequence of ids is
handled by itself, so repeated rows get equal results; an empty table gives no rows; other columns
pass through, and a column with the name of a result is replaced. Texts are whole, of any length.
An id beyond the vocabulary raises an error.
"""

import base64
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LEAF = 24  # bytes that are merged directly
CACHE = 200_000  # different pieces that a task remembers


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Lines of a token in base64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self._pieces: dict[str, bytes] = {}
        self._stable: dict[tuple[bytes, bytes], bool] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Merges the lowest-ranked pair of neighbours, the leftmost of equals, until none is left."""
        parts: list[bytes | None] = [data[i : i + 1] for i in range(len(data))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        ranks = self.ranks
        heap = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= len(parts) or ranks.get(parts[i] + parts[j]) != rank:
                continue
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                if (r := ranks.get(parts[i] + parts[after[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [p for p in parts if p is not None]

    def stable(self, left: bytes, right: bytes) -> bool:
        key = (left, right)
        if key not in self._stable:
            if len(self._stable) >= CACHE:
                self._stable.clear()
            self._stable[key] = self.merged(left + right) == [left, right]
        return self._stable[key]

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of the bytes of both, from the encodings of each."""
        if not left or not right:
            return left or right
        size = 1
        while True:
            head, tail = left[:-size], right[size:]
            window = self.merged(b"".join(left[-size:]) + b"".join(right[:size]))
            if (not head or self.stable(head[-1], window[0])) and (not tail or self.stable(window[-1], tail[0])):
                return head + window + tail
            size *= 2

    def encoded(self, data: bytes) -> list[bytes]:
        if len(data) <= LEAF:
            return self.merged(data)
        half = len(data) // 2
        return self.join(self.encoded(data[:half]), self.encoded(data[half:]))

    def piece(self, text: str) -> bytes:
        """The ids of one match of the pattern as little-endian 32-bit integers."""
        found = self._pieces.get(text)
        if found is None:
            data = text.encode()
            whole = self.ranks.get(data)
            ids = [whole] if whole is not None else [self.ranks[t] for t in self.encoded(data)]
            found = np.array(ids, "<u4").tobytes()
            if len(data) <= 64:
                if len(self._pieces) >= CACHE:
                    self._pieces.clear()
                self._pieces[text] = found
        return found

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.piece, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        found = np.frombuffer(ids, "<u4")
        return self._concatenated([self.tokens[i] for i in found.tolist()])

    def _concatenated(self, parts: list[bytes]) -> bytes:
        if len(parts) <= 1024:
            return b"".join(parts)
        half = len(parts) // 2
        return self._concatenated(parts[:half]) + self._concatenated(parts[half:])


_coders: dict[int, Bpe] = {}  # of this worker


def _coder(shared, pattern: str) -> Bpe:
    key = hash((shared.value, pattern))
    if key not in _coders:
        _coders.clear()
        _coders[key] = Bpe(read_ranks(shared.value), pattern)
    return _coders[key]


OUT_BYTES = 8 << 20  # of a column that a task holds before it hands it on


def _mapped(docs: DataFrame, name: str, source: str, change) -> DataFrame:
    """``docs`` with a binary column made from another, a few MB at a time."""
    fields = [f for f in docs.schema.fields if f.name != name]

    def run(batches):
        for batch in batches:
            values, old = batch.column(batch.schema.names.index(source)), batch.select([f.name for f in fields])
            start, made, taken = 0, [], 0
            for i in range(batch.num_rows):
                made.append(change(values[i].as_py()))
                taken += len(made[-1])
                if taken >= OUT_BYTES or i + 1 == batch.num_rows:
                    columns = [*old.slice(start, len(made)).columns, pa.array(made, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=[*old.schema.names, name])
                    start, made, taken = i + 1, [], 0

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(name, T.BinaryType())]))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the column ``ids``: token ids as little-endian unsigned 32-bit integers.

    ``path`` is a file of ranks on the driver, which sends it to the tasks; its size is the vocabulary's.
    """
    with open(path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    return _mapped(docs, ids, text, lambda value: _coder(shared, pattern).encode(value or ""))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """``docs`` with the column ``data``: the bytes that the ids stand for."""
    with open(path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    return _mapped(docs, data, ids, lambda value: _coder(shared, pattern).decode(value or b""))
