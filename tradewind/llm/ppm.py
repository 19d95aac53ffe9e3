"""Scoring by partial matching: a trie of byte contexts with escapes and symbol exclusion.

The trie's nodes are the contexts of up to ``ORDER`` symbols in the training texts, with a count for
each symbol that followed; a symbol is a byte or the end of the text, and contexts at the start of a
text are filled up with a start mark. A symbol is coded in the longest context that was seen: with
T counts of D symbols there, a symbol with count c has probability c / (T + D) and the escape to the
context one byte shorter D / (T + D) (escape method C). Symbols of the longer context are excluded
in the shorter one: T and D are taken without them. Below the empty context all symbols left are
equally likely. The code length of a text is the sum over its bytes and its end.

As every count of a longer context is also counted in the shorter one, what is excluded there is
the symbols of the longer one, so the exclusion is a number per context and the whole model is a
table of (context, symbol) counts. It is kept in parts by the last two bytes of the context, which
hold the orders above one; the first two orders have at most 257 squared counts and go to every
task. Blocks of documents ask for each (context, symbol) that they hold once, however often, and a
part computes the probability of each that it is asked for once, however many blocks ask.

The base is a word model with the same training texts: words by counts, plus 0.1.

Defined results: texts are lower-cased (ASCII) before anything else. NULL text is empty and codes
its end alone. Without training texts all symbols are equally likely. Each row counts, repeated
ones too; an empty table gives no rows. Words are compared by a 64-bit hash.
"""

from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.operators.storage import materialise

from .blocks import dealt, lookup, pack, parts_for, sorted_bytes, squeeze, tables, unpack, unsqueeze, with_replies

ORDER = 5  # at most 6: a key, with its symbol, then has 63 bits
ANSWER_BYTES = 16 << 20  # of questions, squeezed to some two bytes a key
CHUNK = 1 << 20  # keys whose probabilities are computed at once
MARK = 256  # the start, in contexts, and the end, as a symbol
SYMBOLS = 257
_BITS = 9
_LOW = (1 << _BITS) - 1


def _suffix(keys: np.ndarray, order: int) -> np.ndarray:
    """The (context, symbol) keys in the context of ``order`` symbols."""
    return keys & ((1 << _BITS * (order + 1)) - 1)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, place = np.unique(keys, return_inverse=True)
    return unique, np.bincount(place, counts, len(unique)).astype(np.int64)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in an ascending table, and whether they are there."""
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


class Level:
    """The counts in contexts of one order, and what their symbols count in contexts one shorter."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, below: "Level | None"):
        self.keys, self.counts, self.order = keys, counts, order
        self.contexts, start = np.unique(keys >> _BITS, return_index=True)
        self.total, self.kinds, self.excluded = counts[:0], counts[:0], counts[:0]
        if len(keys):
            self.total = np.add.reduceat(counts, start)
            self.kinds = np.diff(np.append(start, len(keys)))
            if below is not None:
                at, _ = _find(below.keys, _suffix(keys, order - 1))
                self.excluded = np.add.reduceat(below.counts[at], start)


def low_levels(keys: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Orders 0 and 1 from the counts of order 1."""
    zero = Level(*_summed(_suffix(keys, 0), counts), 0, None)
    return [zero, Level(keys, counts, 1, zero)]


def levels(keys: np.ndarray, counts: np.ndarray, low: list[Level], order: int) -> list[Level]:
    found = list(low)
    for k in range(2, order + 1):
        found.append(Level(*_summed(_suffix(keys, k), counts), k, found[-1]))
    return found


def log_probability(keys: np.ndarray, found: list[Level]) -> np.ndarray:
    """log10 of the probability of each key's symbol in its context."""
    result, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
    kinds_above, count_above = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    for level in reversed(found):
        wanted = _suffix(keys, level.order)
        at, seen = _find(level.contexts, wanted >> _BITS)
        if not len(level.contexts):
            continue
        total, kinds = level.total[at] - count_above, level.kinds[at] - kinds_above
        place, there = _find(level.keys, wanted)
        hit, miss = open_ & seen & there, open_ & seen & ~there & (total > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            result += np.where(hit, np.log10(level.counts[place] / (total + kinds)), 0)
            result += np.where(miss, np.log10(kinds / (total + kinds)), 0)
        open_ &= ~hit
        kinds_above = np.where(seen, level.kinds[at], 0)
        count_above = np.where(seen, level.excluded[at], 0) if level.order else count_above
    left = SYMBOLS - (len(found[0].keys) if found else 0)
    return result - np.where(open_, np.log10(max(left, 1)), 0)


def symbol_keys(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The (context, symbol) keys of all texts one after another, and where each text begins."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    line = np.full(int((sizes + order).sum()), MARK, np.uint16)
    ends = np.cumsum(sizes + order)
    own = np.ones(len(line), bool)
    for end, size, text in zip(ends.tolist(), sizes.tolist(), texts, strict=True):
        line[end - size : end - 1] = np.frombuffer(text, np.uint8)
        own[end - size - order : end - size] = False
    n = max(len(line) - order, 0)
    keys = line[:n].astype(np.int64)
    for k in range(1, order + 1):
        keys <<= _BITS
        keys |= line[k : k + n]
    return keys[own[order:]], np.cumsum(sizes) - sizes


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """By the last two symbols of the context."""
    pair = (keys >> _BITS) & ((1 << 2 * _BITS) - 1)
    return ((pair * 0x9E3779B1) >> 7) % parts


def _hash_part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (hashes % np.uint64(parts)).astype(np.int64)


class Symbols:
    """The different (context, symbol) keys of a block, ascending, with counts in its training texts."""

    def __init__(self, texts: list[bytes], train: np.ndarray, order: int):
        keys, self.starts = symbol_keys(texts, order)
        learnt = np.repeat(train, np.diff(np.append(self.starts, len(keys))))
        self.codes, unique = pd.factorize(keys)  # by a hash table, which takes half the memory of sorting
        ascending = np.argsort(unique)
        self.keys, self.rank = unique[ascending], np.empty_like(ascending)
        self.rank[ascending] = np.arange(len(unique))
        self.counts = np.bincount(self.codes[learnt], minlength=len(unique))[ascending]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each text the sum of its symbols' values."""
        return np.add.reduceat(values[self.rank][self.codes], self.starts) if len(self.starts) else np.zeros(0)


class Words:
    """The hashes of a block's different words, ascending, with counts in its training texts."""

    def __init__(self, texts: list[bytes], train: np.ndarray):
        sizes: list[int] = []
        numbers: defaultdict = defaultdict(count().__next__)

        def tokens():
            for text in texts:
                found = text.split()
                sizes.append(len(found))
                yield from found

        codes = np.fromiter(map(numbers.__getitem__, tokens()), np.int64)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
        self.hashes, number = np.unique(hashes, return_inverse=True)
        self.place, self.sizes = number[codes], np.array(sizes, np.int64)
        self.counts = np.bincount(self.place[np.repeat(train, self.sizes)], minlength=len(self.hashes))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each text the sum of its words' values."""
        return np.bincount(np.repeat(np.arange(len(self.sizes)), self.sizes), values[self.place], len(self.sizes))


def merge(asks: list[bytes]) -> bytes:
    """Counts of the same keys in sum; keys that no training text holds go."""
    loaded = [unsqueeze(a) for a in asks]
    summed = []
    for i in (0, 2):
        keys = np.concatenate([np.cumsum(x[i], dtype=x[i].dtype) for x in loaded])
        unique, counts = _summed(keys, np.concatenate([x[i + 1] for x in loaded]))
        summed += [sorted_bytes(unique[counts > 0]), counts[counts > 0]]
    return squeeze(*summed)


def _answers(found: list[Level], asked: list[np.ndarray]) -> list[np.ndarray]:
    """The log10 probabilities of several ascending lists of keys, each different key's taken once."""
    every = np.unique(np.concatenate(asked))
    logs = np.concatenate([log_probability(every[i : i + CHUNK], found) for i in range(0, len(every), CHUNK)] or [np.zeros(0)])
    return [logs[np.searchsorted(every, keys)] for keys in asked]


def score_texts(
    docs: DataFrame, train: Column, *, id: str = "doc_id", text: str = "text", order: int = ORDER
) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score and score (log10) of every row.

    ``train`` says which rows are learnt from; it may use the columns of ``docs``.
    """
    spark = docs.sparkSession
    marked = docs.select(F.struct(F.col(id).alias("id"), F.coalesce(train, F.lit(False)).alias("train")).alias("row"), F.col(text).alias("text"))
    blocks = pack(marked, "row", "text")
    parts = parts_for(blocks)

    def prepared(ids, texts):
        return [r["id"] for r in ids], np.array([r["train"] for r in ids], bool), [t.lower() for t in texts]

    def counted_keys(texts, learns):
        symbols = Symbols(texts, learns, order)
        return symbols.keys, symbols.counts

    def asked(frames):
        for frame in frames:
            for number, payload in zip(frame["block"], frame["payload"], strict=True):
                _, learns, texts = prepared(*unpack(payload))
                keys, counts = counted_keys(texts, learns)
                words = Words(texts, learns)
                hashes, uses = words.hashes, words.counts
                by_part = {p: [keys[at], counts[at], hashes[:0], uses[:0]] for p, at in dealt(_part_of(keys, parts), parts)}
                for p, at in dealt(_hash_part(hashes, parts), parts):
                    row = by_part.setdefault(p, [keys[:0], counts[:0], None, None])
                    row[2:] = hashes[at], uses[at]
                asks = [squeeze(sorted_bytes(k), c, sorted_bytes(h), w) for k, c, h, w in by_part.values()]
                yield pd.DataFrame({"part": list(by_part), "block": number, "ask": asks})

    asks = materialise(blocks.mapInPandas(asked, "part int, block long, ask binary"), "asks")
    model = tables(asks, merge)

    def pairs(frames):
        """Order 1 counts, and the sums that the base needs."""
        for frame in frames:
            for table in frame["table"]:
                keys, counts, hashes, word_counts = unsqueeze(table)
                low, n = _summed(_suffix(np.cumsum(keys), 1), counts)
                yield pd.DataFrame({"key": np.append(low, [-1, -2]), "n": np.append(n, [word_counts.sum(), len(hashes)])})

    rows = model.mapInPandas(pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    sums = dict(zip(rows["key"].to_pylist(), rows["n"].to_pylist(), strict=True))  # at most 257 squared and two
    trained = marked.where("row.train").count()
    total = sums.pop(-1, 0) + trained
    kinds = sums.pop(-2, 0) + (trained > 0)
    low_keys = np.array(sorted(k for k in sums), np.int64)
    shared = spark.sparkContext.broadcast((low_keys, np.array([sums[k] for k in low_keys.tolist()], np.int64)))

    def answer(table: bytes, asked: list[bytes]) -> list[bytes]:
        keys, counts, hashes, word_counts = unsqueeze(table)
        hashes = np.cumsum(hashes, dtype=np.uint64)
        found = levels(np.cumsum(keys), counts, low_levels(*shared.value), order)
        questions = [unsqueeze(a) for a in asked]
        replies = []
        for logs, (_, _, words, _) in zip(_answers(found, [np.cumsum(q[0]) for q in questions]), questions, strict=True):
            at, known = _find(hashes, np.cumsum(words, dtype=np.uint64))
            n = np.where(known, word_counts[at], 0) if len(hashes) else np.zeros(len(words), np.int64)
            values, place = np.unique(logs, return_inverse=True)  # counts are small numbers, so logarithms repeat
            replies.append(squeeze(values, place.astype(np.int32), n))
        return replies

    def scored(ids, texts, replies):
        ids, learns, texts = prepared(ids, texts)
        symbols = Symbols(texts, learns, order)
        logs = np.zeros(len(symbols.keys))
        for p, at in dealt(_part_of(symbols.keys, parts), parts):
            values, place, _ = unsqueeze(replies[p])
            logs[at] = values[place]
        score = symbols.sums(logs)
        del symbols, logs
        words = Words(texts, learns)
        counts = np.zeros(len(words.hashes), np.int64)
        for p, at in dealt(_hash_part(words.hashes, parts), parts):
            counts[at] = unsqueeze(replies[p])[2]
        whole = total + 0.1 * (kinds + 1)
        end = np.log10((trained + 0.1) / whole)
        return pd.DataFrame(
            {
                "id": ids,
                "n_tokens": words.sizes + 1,
                "n_known": words.sums(counts > 0).astype(np.int64) + (trained > 0),
                "train_tokens": total,
                "base_score": words.sums(np.log10((counts + 0.1) / whole)) + end,
                "score": score,
            }
        )

    kind = docs.schema[id].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    replies = lookup(asks, model, answer, ANSWER_BYTES)
    return with_replies(blocks, replies, scored, schema).withColumnRenamed("id", id)
