"""Benchmark decontamination by winnowing.

A window is ``window`` consecutive words of a benchmark item (a shorter item is one window). Its
fingerprint is the least hash of the ``k``-grams in it. A span that a document shares with an item
has the same k-grams on both sides, and so the same least one: no shared window is missed. Three
steps: the fingerprints of all document windows are joined with the benchmark's, which leaves the
few documents and windows that may match; those are written out in full; and they are joined with
the benchmark's windows, word by word. Overlapping hits are joined to spans.

A document's fingerprints are deduplicated before they leave its row, a window's items are gathered
into one row before the join, and no pair of a document and an item is built. Windows of all sizes
are looked for together: the documents are read twice, whatever the lengths of the items.

Defined results: only ASCII letters are lower-cased; words are runs of ASCII digits, lower-case
letters and all characters beyond ASCII. NULL or wordless texts and items have no windows. Rows
that agree in id and text are one document and get the same result each; items that share an id are
one item; a NULL item id is written as the empty string.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.operators.storage import materialise

from .columns import LOWER, UPPER, field, numbers, packed, unpacked

WINDOW = 10
K = 5
_GAPS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def item_words(text: Column) -> Column:
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + _GAPS, LOWER + " " * len(_GAPS))
    return F.array_remove(F.split(plain, " "), "")


def _grams(words: str, k: int) -> Column:
    return F.transform(
        numbers(0, F.size(words) - k), lambda i: F.xxhash64(*[F.get(F.col(words), i + j) for j in range(k)])
    )


def _least(size: int, gram: int) -> Column:
    if size == gram:
        return F.col(f"_grams{gram}")
    span = range(size - gram + 1)
    return F.transform(numbers(0, F.size("_words") - size), lambda i: F.least(*[F.get(f"_grams{gram}", i + j) for j in span]))


def _sized(size: int) -> Column:
    return F.transform(f"_least{size}", lambda h: F.xxhash64(h, F.lit(size)))


def _texts(size: int, found) -> Column:
    """A struct for each window of ``size`` words, of its fingerprint, first word, end and text, by ``found``."""
    return F.transform(f"_least{size}", lambda h, i: found(h, i, (i + size).alias("end"), _window_text(i, size).alias("words")))


def _fingerprinted(rows: DataFrame, sizes: list[int], window: int, k: int) -> DataFrame:
    """Adds _least{size} for each size: the fingerprint of each window of so many words, by its first word.

    Windows below the full size have their size in the fingerprint, so that they meet their like only.
    """
    for gram in sorted({min(k, size) for size in sizes}):
        rows = rows.withColumn(f"_grams{gram}", _grams("_words", gram))
    for size in sizes:
        rows = rows.withColumn(f"_least{size}", _least(size, min(k, size)))
        if size < window:
            rows = rows.withColumn(f"_least{size}", _sized(size))
    return rows.drop(*[f"_grams{min(k, size)}" for size in sizes])


def _window_text(start: Column, size: int) -> Column:
    return F.concat_ws(" ", *[F.get(F.col("_words"), start + j) for j in range(size)])


def benchmark_windows(items: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """size, fingerprint, words and items (ids as strings) of each different window."""
    listed = items.where(F.size("_words") > 0).withColumn("_size", F.least(F.size("_words"), F.lit(window)))
    sizes = list(range(1, window + 1))
    rows = _fingerprinted(listed, sizes, window, k)
    at = F.lit(None)
    for size in sizes:
        found = _texts(size, lambda h, i, end, words: F.struct(h.alias("fingerprint"), words))
        at = F.when(F.col("_size") == size, found).otherwise(at)
    each = rows.select("item_id", F.col("_size").alias("size"), F.explode(at).alias("w")).select("size", "w.*", "item_id")
    return each.groupBy("size", "fingerprint", "words").agg(F.collect_set("item_id").alias("items"))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    k: int = K,
) -> DataFrame:
    """One row per different (id, text): _id, _key, n_hit, spans (start, end), items (sorted strings)."""
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), item_words(F.col(item_text)).alias("_words")
    )
    windows = materialise(benchmark_windows(items, window, k), "benchmark-windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most ``window`` rows
    listed = docs.select(F.col(id).alias("_id"), F.xxhash64(F.col(text)).alias("_key"), item_words(F.col(text)).alias("_words"))
    if sizes:
        marks = materialise(windows.select("fingerprint").distinct(), "benchmark-fingerprints")
        every = F.concat(*[F.col(f"_least{size}") for size in sizes])
        suspects = (
            _fingerprinted(listed, sizes, window, k)
            .select("_id", "_key", F.explode(F.array_distinct(every)).alias("fingerprint"))
            .join(marks, "fingerprint", "left_semi")
            .groupBy("_id", "_key")
            .agg(F.collect_set("fingerprint").alias("_marks"))
        )
        suspects = materialise(suspects.withColumnsRenamed({"_id": "_sid", "_key": "_skey"}), "suspects")
        same = listed["_id"].eqNullSafe(suspects["_sid"]) & (listed["_key"] == suspects["_skey"])
        narrowed = _fingerprinted(listed.join(suspects, same), sizes, window, k)

        def place(h, i, end, words):
            return F.when(F.array_contains("_marks", h), F.struct(i.alias("start"), end, words))

        places = [F.filter(_texts(size, place), lambda w: w.isNotNull()) for size in sizes]
        # a text of words tells its size, so windows of all sizes meet in one join
        hits = (
            narrowed.select("_id", "_key", F.explode(F.concat(*places)).alias("w"))
            .select("_id", "_key", "w.start", "w.end", "w.words")
            .join(windows.select("words", "items"), "words")
            .select("_id", "_key", "start", "end", "items")
        )
    else:
        hits = listed.where(F.lit(False)).select(
            "_id", "_key", F.lit(0).alias("start"), F.lit(0).alias("end"), F.array(F.lit("")).alias("items")
        )
    gathered = hits.groupBy("_id", "_key").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def grow(a, x):
        fresh = F.greatest(x["start"], a["end"])
        return F.struct(F.greatest(x["end"], a["end"]).alias("end"), (a["n"] + F.greatest(x["end"] - fresh, F.lit(0))).alias("n"))

    return gathered.withColumn("n_hit", F.aggregate("spans", start, grow, lambda a: a["n"]))


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted strings) and contaminated."""
    leaks = materialise(find_leaks(docs, benchmark, id=id, text=text, **options), "leaks")
    # what the text is needed for is worked out before the join, so that it moves only if the caller keeps it
    rows = packed(docs).withColumns({"_text_key": F.xxhash64(field(text)), "_n_words": F.size(item_words(field(text))).cast("long")})
    joined = rows.join(leaks, field(id).eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    outputs = {
        "n_words": F.col("_n_words"),
        "n_hit": n_hit,
        "items": F.coalesce("items", F.array().cast("array<string>")),
        "contaminated": n_hit > 0,
    }
    return unpacked(joined, docs.columns, outputs)
