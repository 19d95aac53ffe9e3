"""Toxicity by subword bags: averaged embeddings into a linear softmax, trained jointly in numpy.

A document is the average embedding of its subwords, the character n-grams of its words and the words
themselves, hashed into ``BUCKETS`` rows. A word that stands c times weighs as the root of c, and
``PADDING`` zero vectors are averaged in. Misspelt words share most n-grams with the words they come
from. As average and softmax are linear, a trained model scores a bucket by one number, so scoring
needs one table of ``BUCKETS`` numbers (1 MB) and the tasks share nothing else.

The model is fitted on the driver on a bounded sample: at most ``MAX_ROWS`` labelled documents in the
order of a hash of their ids, of which those are left out that would bring the texts above
``MAX_BYTES`` in sum; whole texts. Everything else runs over all rows.

Defined results: only ASCII letters are lower-cased; NULL and wordless texts get the score of an empty
bag. Labels that are NULL or belong to no document are not used; of several labels of a document the
greatest counts, and of several rows with a labelled id the one with the least hash of its text. Without labelled rows of both classes the score is the share of toxic ones (0 if
there are none). Equal texts get equal scores; an empty table gives no rows.
"""

import zlib
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 18
SIZES = (4, 5, 6)
WIDTH = 8
PADDING = 300  # zero vectors in each average, so that a few subwords do not sway a short text
EPOCHS = 6
MIN_STEPS = 1200  # of the optimiser; a small sample gets more epochs
BATCH = 32
RATE = 0.3
MAX_ROWS = 6000
MAX_BYTES = 32 << 20
_EDGES = b".,;:!?\"'()[]"


def subwords(word: bytes) -> list[int]:
    marked = b"<" + word.strip(_EDGES) + b">"
    grams = [zlib.crc32(marked[i : i + n]) % BUCKETS for n in SIZES for i in range(len(marked) - n + 1)]
    return [*grams, zlib.crc32(marked) % BUCKETS]


def _bag(text: str | None, known: dict[bytes, array]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares."""
    found, weights = array("i"), array("f")
    for word, count in Counter((text or "").encode().lower().split()).items():
        grams = known.get(word)
        if grams is None:
            if len(known) >= 100_000:
                known.clear()
            grams = known[word] = array("i", subwords(word))
        found.extend(grams)
        weights.extend([count**0.5] * len(grams))
    buckets, place = np.unique(np.array(found, np.int32), return_inverse=True)
    weight = np.bincount(place, weights, len(buckets))
    return buckets, (weight / (PADDING + weight.sum())).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray  # what a bucket adds to the log odds, for its share of the bag
    bias: float


def train(texts: list[str | None], toxic: list[int], seed: int = 0) -> Model:
    """The model, with what each bucket adds to the log odds folded into one number."""
    if len(set(toxic)) < 2:
        share = min(max(float(np.mean(toxic)) if toxic else 0.0, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    table, out, bias = embeddings(texts, toxic, seed)
    return Model((table @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def embeddings(texts: list[str | None], toxic: list[int], seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings of the buckets, and weights and biases of the two classes, trained together."""
    y = np.array(toxic, np.int64)
    known: dict[bytes, array] = {}
    bags = [_bag(t, known) for t in texts]
    known.clear()
    rng = np.random.default_rng(seed)
    table = (rng.random((BUCKETS, WIDTH), dtype=np.float32) - 0.5) / WIDTH
    out = np.stack([np.full(WIDTH, -0.5, np.float32), np.full(WIDTH, 0.5, np.float32)])
    bias = np.zeros(2, np.float32)
    steps = [np.full((BUCKETS, 1), 1e-6, np.float32), np.full((2, WIDTH), 1e-6, np.float32), np.full(2, 1e-6, np.float32)]
    for _ in range(max(EPOCHS, -(-MIN_STEPS * BATCH // len(bags)))):
        order = rng.permutation(len(bags))
        for start in range(0, len(order), BATCH):
            chosen = order[start : start + BATCH]
            buckets, shares = (np.concatenate([bags[i][k] for i in chosen]) for k in (0, 1))
            doc = np.repeat(np.arange(len(chosen)), [len(bags[i][0]) for i in chosen])
            used, row = np.unique(buckets, return_inverse=True)
            mean = np.zeros((len(chosen), WIDTH), np.float32)
            np.add.at(mean, doc, table[buckets] * shares[:, None])
            logits = mean @ out.T + bias
            error = np.exp(logits - logits.max(axis=1, keepdims=True))
            error /= error.sum(axis=1, keepdims=True)
            error[np.arange(len(chosen)), y[chosen]] -= 1
            error /= len(chosen)
            change = np.zeros((len(used), WIDTH), np.float32)
            np.add.at(change, row, (error @ out)[doc] * shares[:, None])
            steps[0][used, 0] += (change**2).mean(axis=1)
            table[used] -= RATE * change / np.sqrt(steps[0][used])
            for parameter, gradient, step in ((out, error.T @ mean, steps[1]), (bias, error.sum(axis=0), steps[2])):
                step += gradient**2
                parameter -= RATE * gradient / np.sqrt(step)
    return table, out, bias


class Scorer:
    """Scores texts one after another and remembers its words' subwords in sum."""

    REMEMBERED = 400_000

    def __init__(self, model: Model):
        self.weights, self.bias, self.words = model.weights.tolist(), model.bias, {}

    def _word(self, word: bytes) -> complex:
        """Sum of the weights, and number, of a word's subwords as the two parts of one number."""
        found = subwords(word)
        if len(self.words) >= self.REMEMBERED:
            self.words.clear()
        value = self.words[word] = complex(sum(map(self.weights.__getitem__, found)), len(found))
        return value

    def score(self, text: str | None) -> float:
        known, fresh = self.words.get, self._word
        words = Counter((text or "").encode().lower().split())
        total = sum([(known(w) or fresh(w)) * c**0.5 for w, c in words.items()], 0j)
        odds = total.real / (PADDING + total.imag) + self.bias
        return float(1 / (1 + np.exp(-min(max(odds, -30.0), 30.0))))


def sample(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, max_rows: int, max_bytes: int):
    """Texts and labels to learn from, at most ``max_rows`` and ``max_bytes``, one text for each id."""
    place = F.xxhash64(F.col(id).cast("string"))
    chosen = (
        labels.where(F.col(id).isNotNull() & F.col(label).isNotNull())
        .groupBy(id)
        .agg(F.max(label).alias("_toxic"))
        .orderBy(place, id)
        .limit(max_rows)
    )
    joined = docs.join(F.broadcast(chosen), id).withColumn("_hash", F.xxhash64(text))  # at most max_rows ids
    size = F.coalesce(F.octet_length(text), F.lit(0))
    first = joined.groupBy(id).agg(F.min(F.struct("_hash", size.alias("size"))).alias("first"))
    total, fits = 0, []
    for row in first.orderBy(place, id).select(id, "first.*").toArrow().to_pylist():
        if total + row["size"] <= max_bytes:
            total += row["size"]
            fits.append((row[id], row["_hash"]))
    if not fits:
        return [], []
    fitting = docs.sparkSession.createDataFrame(fits, joined.select(id, "_hash").schema)
    texts = joined.join(F.broadcast(fitting), [id, "_hash"], "left_semi").dropDuplicates([id])
    rows = texts.select(id, F.col(text).alias("text"), "_toxic").orderBy(place, id).toArrow().to_pylist()
    return [r["text"] for r in rows], [int(r["_toxic"] > 0) for r in rows]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_rows: int = MAX_ROWS,
    max_bytes: int = MAX_BYTES,
) -> Model:
    """A model from the rows of ``labels`` given, which is where rows are held out, and their texts."""
    return train(*sample(docs.select(id, text), labels.select(id, label), id, text, label, max_rows, max_bytes))


def score(model: Model, docs: DataFrame, text: Column) -> Column:
    """The probability, 0 to 1, that a text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.tobytes(), model.bias))

    @F.pandas_udf("double")
    def scored(batches: pd.Series) -> pd.Series:
        key = id(shared.value)
        if _scorers.get("key") != key:
            weights, bias = shared.value
            _scorers.update(key=key, scorer=Scorer(Model(np.frombuffer(weights, np.float32), bias)))
        return pd.Series([_scorers["scorer"].score(t) for t in batches], dtype="float64")

    return scored(text)


_scorers: dict = {}  # of this worker
