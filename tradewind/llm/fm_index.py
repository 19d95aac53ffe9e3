"""Removal of repeated word windows by a compressed FM-index per shard.

The different segments of a shard (see ``anchors``) are one text of word numbers. Its suffix array
gives the Burrows-Wheeler transform, which is kept as a wavelet matrix: one bit vector per bit of
the word numbers, packed, with running bit counts. Backward search narrows the range of suffixes
that start with a pattern, word by word from its end. Segments are streamed through the index side
by side: each is matched backwards from its end as far as the text repeats, which gives the
matching statistics that matter here, the longest repeat that ends at a place. Repeats that reach
the threshold are reported as intervals, and the search goes on left of where it broke off. Where
text stands once, the search leaps: words that several windows have in common are matched first,
and if they stand once, so do all of these windows. The range of suffixes is weighed by the copies
of their segments.

Defined results: NULL text has no words; windows never cross documents; equal windows of the same
document count as repeats too; repeated rows are documents of their own; an empty table gives no
rows. Only the id and the text are used.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Words, repeated_windows

WINDOW = 35
GRAM = 12


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling; ``symbols`` are ranks of single symbols.

    The first sort sees two symbols at once. After each, only suffixes that still have equals are sorted
    on, by what follows, inside their group: a suffix's rank is the first row of its group.
    """
    n = len(symbols)
    later = np.append(symbols[1:].astype(np.int64) + 1, 0)[:n]
    key = symbols.astype(np.int64) * (int(symbols.max(initial=0)) + 2) + later
    order = np.argsort(key)
    rank, rows, span = np.empty(n, np.int64), np.arange(n), 2
    value = key[order]
    while True:
        # rows are those sorted last, value tells which of them are equal
        new = np.append(True, value[1:] != value[:-1])[: len(rows)]
        rank[order[rows]] = np.maximum.accumulate(np.where(new, rows, 0))
        rows = rows[~(new & np.append(new[1:], True)[: len(rows)])]
        if not len(rows):
            return order
        suffixes = order[rows]
        ahead = suffixes + span
        inside = ahead < n
        later = np.zeros(len(rows), np.int64)
        later[inside] = rank[ahead[inside]] + 1
        value = rank[suffixes] * (n + 1) + later
        sorted_ = np.argsort(value)
        order[rows], value = suffixes[sorted_], value[sorted_]
        span *= 2


_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)  # the bits under each place of a word


class BitVector:
    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64))[:-1].astype(np.int32)

    def ones(self, stop: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = stop >> 6
        return self.before.take(word) + np.bitwise_count(self.words.take(word) & _BELOW.take(stop & 63))


class FmIndex:
    """Counts of patterns in a text of numbers from 1; 0 parts the segments."""

    def __init__(self, text: np.ndarray, weights: np.ndarray):
        """``weights``: what an occurrence at each place counts."""
        kinds = int(text.max()) + 1
        parts = text == 0
        unique = np.where(parts, np.cumsum(parts), text + parts.sum())  # no two segment ends are alike
        order = suffix_array(unique)
        transform = text[order - 1]
        self.smaller = np.append(0, np.cumsum(np.bincount(text, minlength=kinds)))
        self.weight_before = np.append(0, np.cumsum(weights[order]))
        self.size, self.bits = len(text), max(1, (kinds - 1).bit_length())
        self.levels, self.zeros = [], []
        first = np.zeros(kinds, np.int64)
        numbers = np.arange(kinds)
        for b in reversed(range(self.bits)):
            bits = (transform >> b) & 1
            vector = BitVector(bits)
            zeros = int(len(bits) - bits.sum())
            self.levels.append(vector)
            self.zeros.append(zeros)
            ones = vector.ones(first)
            first = np.where((numbers >> b) & 1, zeros + ones, first - ones)
            transform = np.concatenate([transform[bits == 0], transform[bits == 1]])
        self.first = first

    def of_symbol(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of suffixes that begin with a symbol, where every search starts."""
        return self.smaller[symbol], self.smaller[symbol + 1]

    def extended(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The end of a range of suffixes after a symbol is put in front."""
        at = place
        for k, vector in enumerate(self.levels):
            ones = vector.ones(at)
            at = np.where((symbol >> (self.bits - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return self.smaller[symbol] + at - self.first[symbol]

    def weight(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.weight_before[high] - self.weight_before[low]


def repeats(segments: list[bytes], copies: np.ndarray, size: int) -> list[np.ndarray]:
    """For each segment (words joined by a space), which of its windows of ``size`` words stand twice or more."""
    lengths = np.array([s.count(b" ") + 1 for s in segments], np.int64)
    words = b" ".join(segments).split(b" ")
    numbers = dict(zip(dict.fromkeys(words), range(1, len(words) + 1)))
    starts = np.cumsum(lengths + 1) - lengths - 1
    text = np.zeros(len(words) + len(segments), np.int64)
    text[np.arange(len(words)) + np.repeat(np.arange(len(segments)), lengths)] = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    index = FmIndex(text, np.repeat(copies, lengths + 1))
    found = [np.zeros(max(n - size + 1, 0), bool) for n in lengths.tolist()]

    # Each job searches windows low … high of a segment, backwards. A leap is a number of windows, high the
    # last of them, whose common words are searched: if these stand once, so do all of the windows.
    job = np.nonzero(lengths >= size)[0]
    low, high = np.zeros(len(job), np.int64), lengths[job] - size
    widest = max(1, size * 2 // 3)
    leap = np.ones(len(job), np.int64)
    while len(job):
        place = high + size - leap
        least = np.where(leap > 1, high, low)
        begin, end = index.of_symbol(text[starts[job] + place])
        open_ = np.flatnonzero(index.weight(begin, end) >= 2)
        place[open_] -= 1
        open_ = open_[place[open_] >= least[open_]]
        while len(open_):
            symbol = text[starts[job[open_]] + place[open_]]
            both = index.extended(np.concatenate([symbol, symbol]), np.concatenate([begin[open_], end[open_]]))
            new_begin, new_end = both[: len(open_)], both[len(open_) :]
            goes = index.weight(new_begin, new_end) >= 2
            open_ = open_[goes]
            begin[open_], end[open_] = new_begin[goes], new_end[goes]
            place[open_] -= 1
            open_ = open_[place[open_] >= least[open_]]
        # the text repeats from place + 1 to the end of what was searched
        repeated, whole = place < high, leap == 1
        for i in np.nonzero(repeated & whole)[0].tolist():
            found[job[i]][max(place[i] + 1, low[i]) : high[i] + 1] = True
        high = np.where(repeated, np.where(whole, place, high), high - leap)
        # words that repeat are searched anew with all of their window; after a repeat's end leaps are wide, else they double
        leap = np.where(repeated, np.where(whole, widest, 1), np.minimum(2 * leap, widest))
        left = high >= low
        job, low, high, leap = job[left], low[left], high[left], leap[left]
    return found


def remove_repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, **options) -> DataFrame:
    """One row per document: id, n_words, n_removed, starts and ends (of removed runs of words) and kept (text)."""
    found = repeated_windows(docs, repeats, Words, size=window, gram=gram, id=id, text=text, **options)
    return found.withColumnRenamed("n_units", "n_words").withColumn("kept", F.col("kept").cast("string"))
