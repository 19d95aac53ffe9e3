"""Removal of repeated byte strings by a logarithmic family of suffix arrays per shard.

The different segments of a shard (see ``anchors``) come in batches. A batch gets a suffix array of
its windows, sorted by their ``size`` bytes. It is merge-scanned against the level of every earlier
generation: both sides are sorted, so a range of the level is narrowed eight bytes at a time for all
windows of the batch at once, and what is left after the last bytes are matches as long as a window.
Then the batch becomes a level; two levels of the same generation are merged into one of the next,
at the places that the scan finds, without sorting again. A window takes part in a merge once per
generation, so n batches cost about log n scans each.

Defined results: texts are UTF-8 bytes, NULL is empty; strings never cross documents; equal strings
of the same document count as repeats too, also if they overlap; repeated rows are documents of
their own; an empty table gives no rows. Only the id and the text are used.
"""

import numpy as np
from pyspark.sql import DataFrame

from .anchors import Bytes, repeated_windows

WINDOW = 200
GRAM = 40
BATCH_BYTES = 1 << 20


class Level:
    """Windows in order: their places in the text of words (eight bytes from each place), and who they are."""

    def __init__(self, words: np.ndarray, order: np.ndarray, owner: np.ndarray, generation: int):
        self.words, self.order, self.owner, self.generation = words, order, owner, generation

    def word(self, rows: np.ndarray, offset: int) -> np.ndarray:
        return self.words[self.order[rows] + offset]


def _offsets(size: int) -> list[int]:
    """Where to read eight bytes so that all of a window is read, from the left."""
    return [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]


def suffix_level(segments: list[bytes], first: int, size: int) -> tuple[Level, np.ndarray]:
    """The sorted windows of a batch, and which of them (in that order) equal a neighbour.

    Owners number the windows of all batches; this one's begin at ``first``.
    """
    text = np.frombuffer(b"".join(segments) + bytes(8), np.uint8)
    words = np.zeros(len(text) - 7, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | text[k : len(text) - 7 + k]
    lengths = np.array([len(s) for s in segments], np.int64)
    counts = np.maximum(lengths - size + 1, 0)
    begins = np.cumsum(lengths) - lengths
    places = np.arange(counts.sum()) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
    value = words[places]
    order = np.argsort(value)
    value = value[order]
    group = np.append(0, np.cumsum(value[1:] != value[:-1]))[: len(order)]
    rows = np.arange(len(order))
    for offset in _offsets(size)[1:]:
        # of the windows that still have equals, those of a group that differ here are sorted and parted
        new = np.append(True, group[rows][1:] != group[rows][:-1])[: len(rows)]
        rows = rows[~(new & np.append(new[1:], True)[: len(rows)])]
        if not len(rows):
            break
        value, own = words[places[order[rows]] + offset], group[rows]
        differs = np.append((own[1:] == own[:-1]) & (value[1:] != value[:-1]), False)
        begins = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        mixed = np.repeat(np.logical_or.reduceat(differs, begins), np.diff(np.append(begins, len(rows))))
        if not mixed.any():
            continue
        some, value, own = rows[mixed], value[mixed], own[mixed]
        sorted_ = np.lexsort((value, own))
        order[some], value = order[some[sorted_]], value[sorted_]
        fresh = np.zeros(len(order), np.int64)
        fresh[some[1:]] = (own[1:] == own[:-1]) & (value[1:] != value[:-1])
        group = group + np.cumsum(fresh)
    same = group[1:] == group[:-1] if len(group) else np.zeros(0, bool)
    twice = np.append(same, False)[: len(order)] | np.append(False, same)[: len(order)]
    return Level(words, places[order], order + first, 0), twice


def scan(level: Level, batch: Level, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the batch, the range of equal windows in the level; empty where it would go."""
    first = level.words[level.order]
    own = batch.words[batch.order]
    low, high = np.searchsorted(first, own, "left"), np.searchsorted(first, own, "right")
    for offset in _offsets(size)[1:]:
        rows = np.nonzero(low < high)[0]
        if not len(rows):
            break
        value = batch.word(rows, offset)
        # a range of one word, and a value outside of the range, need no search
        least, most = level.word(low[rows], offset), level.word(high[rows] - 1, offset)
        above, below = value > most, value < least
        low[rows[above]], high[rows[below]] = high[rows[above]], low[rows[below]]
        left = ~above & ~below & (least != most)
        rows, value = rows[left], value[left]
        bounds = []
        for after in (False, True):
            a, b = low[rows], high[rows]
            while True:
                open_ = np.nonzero(a < b)[0]
                if not len(open_):
                    break
                middle = (a[open_] + b[open_]) >> 1
                there = level.word(middle, offset)
                right = there <= value[open_] if after else there < value[open_]
                a[open_] = np.where(right, middle + 1, a[open_])
                b[open_] = np.where(right, b[open_], middle)
            bounds.append(a)
        low[rows], high[rows] = bounds
    return low, high


def merged(older: Level, newer: Level, size: int) -> Level:
    low, _ = scan(older, newer, size)
    n = len(older.order) + len(newer.order)
    at = low + np.arange(len(low))
    taken = np.zeros(n, bool)
    taken[at] = True
    order, owner = np.empty(n, np.int64), np.empty(n, np.int64)
    order[at], owner[at] = newer.order + len(older.words), newer.owner
    order[~taken], owner[~taken] = older.order, older.owner
    return Level(np.concatenate([older.words, newer.words]), order, owner, older.generation + 1)


def repeats(segments: list[bytes], copies: np.ndarray, size: int, batch_bytes: int = BATCH_BYTES) -> list[np.ndarray]:
    """For each segment, which of its windows of ``size`` bytes stand twice or more."""
    counts = np.array([max(len(s) - size + 1, 0) for s in segments], np.int64)
    ends = np.cumsum(counts)
    found = np.repeat(copies > 1, counts)
    levels: list[Level] = []
    start = 0
    while start < len(segments):
        stop, taken = start, 0
        while stop < len(segments) and (stop == start or taken + len(segments[stop]) <= batch_bytes):
            taken += len(segments[stop])
            stop += 1
        level, twice = suffix_level(segments[start:stop], int(ends[start] - counts[start]), size)
        found[level.owner[twice]] = True
        for older in levels:
            low, high = scan(older, level, size)
            hit = low < high
            found[level.owner[hit]] = True
            steps = np.zeros(len(older.order) + 1, np.int64)
            np.add.at(steps, low[hit], 1)
            np.add.at(steps, high[hit], -1)
            found[older.owner[np.cumsum(steps[:-1]) > 0]] = True
        while levels and levels[-1].generation == level.generation:
            level = merged(levels.pop(), level, size)
        levels.append(level)
        start = stop
    return np.split(found, ends[:-1]) if len(segments) else []


def remove_repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, **options) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, starts and ends (of removed runs of bytes) and kept (bytes)."""
    found = repeated_windows(docs, repeats, Bytes, size=window, gram=gram, id=id, text=text, **options)
    return found.withColumnRenamed("n_units", "n_bytes")
