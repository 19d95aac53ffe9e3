"""Spelling variants: words one edit apart, found by Gram matrices of letter counts.

Words are the runs of letters of all texts with their counts. An edit that inserts or deletes a
letter moves the vector of letter counts by a squared distance of 1, one that replaces a letter by 2
at most. So words are dealt into blocks by their length and by how many letters they have of each of
``GROUPS`` groups, and a block meets only those blocks, of its own length or the next, whose group
counts are within a squared distance of 2 of its own. Each such pair of blocks is one NumPy product of letter
counts, which gives the squared distances of all its words; the pairs of words at most 2 apart are
then verified letter by letter. Accented letters share a few dimensions, which only makes
distances smaller, so no pair is lost.

Blocks are cut into chunks of ``CHUNK`` letters by a hash of the word, and a row of the join holds two chunks, so
no task holds more than a few of them. Comparisons grow with the square of the number of different words,
over the pairs of blocks that are near.

A word's form is the most frequent of the words one edit away (of equals the first in code-point
order) if that is at least ``ratio`` times as frequent as the word itself. Following forms ends at the root. Frequencies
at least double on the way, so the rounds below are few.

Defined results: NULL and letterless texts have no words, and a NULL id is read as an empty one.
Repeated rows count again. A run of any length is one word. An empty table gives no rows. Columns
other than id and text are not read.
"""

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.operators.storage import materialise

from .columns import count_of

MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
GROUPS = 6
CHUNK = 16_384  # letters of the words in a chunk
SLICE = 1 << 20  # characters of a text looked at together
HELD = 200_000  # different words, or times 80 their letters, that a task counts before it hands them on
_RUN = re.compile("[a-zÀ-ÿ]+")
_OTHER = re.compile("[^A-Za-zÀ-ÿ]")
# Dimension of each letter: a to z have their own, all others share six.
_DIMENSIONS = 32
_DIMENSION = np.array([c - 97 if 97 <= c <= 122 else 26 + c % 6 for c in range(256)])
_LETTERS = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]

Edit = Callable[[str, str], str]


def dropped_letter(id: str, run: str, every: int = 97) -> str:
    """The run without one letter, if ``every`` divides the crc32 of id and run: a deterministic misspelling."""
    h = zlib.crc32(f"{id}:{run}".encode())
    if h % every:
        return run
    place = h % len(run)
    return run[:place] + run[place + 1 :]


def runs(text: str) -> Counter:
    """The runs of letters with A to Z in lower case, and how often they stand in the text."""
    found, start = Counter(), 0
    while start < len(text):
        stop = start + SLICE
        if stop < len(text):  # a slice ends where no run goes on
            gap = _OTHER.search(text, stop)
            stop = gap.start() if gap else len(text)
        found.update(_RUN.findall(text[start:stop].encode().lower().decode()))
        start = stop
    return found


def count_words(docs: DataFrame, id: str, text: str, edit: Edit | None = None, min_length: int = MIN_LENGTH) -> DataFrame:
    """word and n over all texts, for words of ``min_length`` letters or more.

    ``edit`` changes the runs of a document, given its id, before they are counted. Tasks add up
    before the shuffle and hand on a bounded number of words at a time.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, letters = {}, 0

        def handed_on():
            return pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})

        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                key = key.as_py()
                for word, n in runs(value.as_py()).items():
                    if edit is not None:
                        word = edit(key, word)
                    if len(word) >= min_length:
                        if word in counts:
                            counts[word] += n
                        else:
                            counts[word] = n
                            letters += len(word)
                if len(counts) > HELD or letters > 80 * HELD:
                    yield handed_on()
                    counts, letters = {}, 0
        yield handed_on()

    texts = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    return texts.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _block(word: Column) -> Column:
    """How many letters the word has of each group; their sum is its length."""
    groups = ["".join(c for c in _LETTERS if _DIMENSION[ord(c)] % GROUPS == g) for g in range(GROUPS)]
    return F.array(*[count_of(word, letters) for letters in groups])


def _steps() -> list[list[int]]:
    """From a block to itself, to blocks of its length and to those of the next; each pair of blocks once."""
    unit = np.eye(GROUPS, dtype=int)
    replaced = [unit[g] - unit[h] for g in range(GROUPS) for h in range(g + 1, GROUPS)]
    return [[0] * GROUPS, *map(np.ndarray.tolist, replaced), *unit.tolist()]


def _chunks(words: DataFrame) -> DataFrame:
    """block, chunk, and the words (a line each) and their counts."""
    dealt = words.withColumn("block", _block(F.col("word")))
    sizes = dealt.groupBy("block").agg(F.ceil(F.sum(F.length("word")) / CHUNK).alias("chunks"))
    listed = F.collect_list(F.struct("word", "n"))
    return (
        dealt.join(sizes, "block")
        .groupBy("block", F.pmod(F.xxhash64("word"), "chunks").cast("int").alias("chunk"))
        .agg(listed.alias("list"))
        .select("block", "chunk", F.array_join("list.word", "\n").alias("words"), F.col("list.n").alias("ns"))
    )


def _met(chunks: DataFrame) -> DataFrame:
    """Pairs of chunks to compare, each once: words, ns, others, other_ns, same."""
    blocks = chunks.select("block").distinct()
    step = F.explode(F.array(*[F.array(*map(F.lit, s)) for s in _steps()])).alias("step")
    moved = F.zip_with("from", "step", lambda a, b: a + b).alias("block")
    near = blocks.select(F.col("block").alias("from"), step).select("from", moved).join(blocks, "block", "left_semi")
    near = near.groupBy("from").agg(F.collect_list("block").alias("to"))  # as many as there are steps at most
    visits = chunks.withColumnsRenamed({"block": "from", "chunk": "visitor"}).join(near, "from")
    visits = visits.select("from", "visitor", "words", "ns", F.explode("to").alias("block"))
    others = chunks.select("block", "chunk", F.col("words").alias("others"), F.col("ns").alias("other_ns"))
    own = F.col("from") == F.col("block")
    met = visits.join(others, "block").where(~own | (F.col("visitor") <= F.col("chunk")))
    return met.select("words", "ns", "others", "other_ns", (own & (F.col("visitor") == F.col("chunk"))).alias("same"))


def _letters(words: str) -> np.ndarray:
    """A row of letters for each word; all have the same length."""
    length = words.find("\n") if "\n" in words else len(words)
    return np.frombuffer((words + "\n").encode("latin-1"), np.uint8).reshape(-1, length + 1)[:, :length]


def _letter_counts(letters: np.ndarray) -> np.ndarray:
    rows, length = letters.shape
    place = _DIMENSION[letters] + np.arange(rows)[:, None] * _DIMENSIONS
    exact = np.float32 if length <= 4000 else np.float64  # squares of the length must fit
    return np.bincount(place.ravel(), minlength=rows * _DIMENSIONS).reshape(rows, -1).astype(exact)


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which words of ``a`` are one edit from the word beside them in ``b``, of their length or one more."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    front, back = a != b[:, :-1], a != b[:, 1:]
    length = a.shape[1]
    first = np.where(front.any(axis=1), front.argmax(axis=1), length)
    last = np.where(back.any(axis=1), length - 1 - back[:, ::-1].argmax(axis=1), -1)
    return last < first


def near_words(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of the words one edit apart; in one and the same chunk each pair once."""
    x, y = _letter_counts(a), _letter_counts(b)
    lengths = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :]
    rows, columns = np.nonzero(lengths - 2 * (x @ y.T) <= 2)
    if same:
        rows, columns = rows[rows < columns], columns[rows < columns]
    step = max(1, (4 << 20) // a.shape[1])
    found = [_one_edit(a[rows[i : i + step]], b[columns[i : i + step]]) for i in range(0, len(rows), step)]
    near = np.concatenate(found) if found else np.zeros(0, bool)
    return rows[near], columns[near]


def _best(words: list[str], mine: np.ndarray, others: list[str], letters: np.ndarray, ns: np.ndarray, other: np.ndarray) -> pd.DataFrame:
    """Of each word with near ones: their number, and the most frequent with its count."""
    rank = np.empty(len(others), np.int64)
    rank[np.lexsort(letters.T[::-1])] = np.arange(len(others))
    order = np.lexsort((rank[other], -ns[other], mine))
    mine, other = mine[order], other[order]
    held, first, count = np.unique(mine, return_index=True, return_counts=True)
    best = other[first]
    return pd.DataFrame({"word": [words[i] for i in held], "n_near": count, "best_n": ns[best], "best": [others[i] for i in best]})


def _compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for left, left_ns, right, right_ns, same in frame.itertuples(index=False):
            a, b = _letters(left), _letters(right)
            rows, columns = near_words(a, b, same)
            if len(rows):
                words, others = left.split("\n"), right.split("\n")
                yield _best(words, rows, others, b, np.asarray(right_ns), columns)
                yield _best(others, columns, words, a, np.asarray(left_ns), rows)


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form and form_n of each of the ``words`` (word, n), which are different."""
    chunks = materialise(_chunks(words), "spelling-chunks")
    found = _met(chunks).mapInPandas(_compared, "word string, n_near long, best_n long, best string")
    best = found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word"))).alias("best")
    )
    joined = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best")
    accepted = -F.col("best.minus") >= ratio * F.col("n")
    return joined.select(
        "word", "n", "n_near", F.when(accepted, F.col("best.word")).alias("form"), F.when(accepted, -F.col("best.minus")).alias("form_n")
    )


def roots(linked: DataFrame) -> DataFrame:
    """word and root of each row of ``linked`` (word, form) that has a form.

    Each round doubles the steps taken: a word's root becomes its root's root.
    """
    now = materialise(linked.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        nexts = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = now.join(nexts, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        moved = materialise(moved, "spelling-roots")
        now = moved.drop("_moved")
        if not moved.where("_moved").limit(1).count():
            return now


def spelling_variants(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    edit: Edit | None = None,
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``min_length`` letters that stands ``min_count`` times."""
    words = materialise(count_words(docs, id, text, edit, min_length).where(F.col("n") >= min_count), "spelling-words")
    found = materialise(forms(words, ratio), "spelling-forms")
    rooted = found.join(roots(found), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
