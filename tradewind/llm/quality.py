"""Quality rules: a table of thresholds, compiled into one projection of built-in functions.

Measures are ratios of counts that one text alone determines, so a document is judged without any
shuffle. Ratios of a text without words (or lines) are NULL and fail no rule by themselves; such a
text fails for its length.

Defined results: NULL text is a text without words; lines are parted by ``\\n``, and a line without
a word is never a repeated line; a line repeats another if all characters are the same, white space at
the ends too; documents are judged one by one, so repeated rows get the same verdict each; an empty
table gives no rows. Other columns pass through untouched; one that has the name of a result of
``apply_rules`` is replaced.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import LOWER, SPACES, UPPER, count_of, field, numbers, packed, trimmed_lines, unpacked, without_spaces, words

# Frequent words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that for it was on with as are this be by from or at "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un une du que est pour qui dans par sur au pas plus "
    "el los las y del se por con su para una no es lo como"
).split()

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

# measure: (numerator, denominator, least, most); None is no bound.
RULES: dict[str, tuple[str, str, float | None, float | None]] = {
    "mean word length": ("word_chars", "n_words", 2.0, 14.0),
    "symbols per word": ("n_symbols", "n_words", None, 0.1),
    "exclamation marks per word": ("n_exclaims", "n_words", None, 0.5),
    "upper-case letters per character": ("n_upper", "word_chars", None, 0.6),
    "stop words per word": ("n_stop_words", "n_words", 0.01, None),
    "repeated lines per line": ("n_dup_lines", "n_lines", None, 0.5),
    "lines ending in an ellipsis": ("n_ellipsis_lines", "n_lines", None, 0.5),
    "lines starting with a bullet": ("n_bullet_lines", "n_lines", None, 0.9),
}
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, all within one expression."""
    return F.get(F.transform(F.array(value), use), 0)


def _repeat_words(words_: Column) -> Column:
    """The words in windows of three that the text has twice or more.

    Windows are compared by a 64-bit hash within one text. Sorting them with their places puts equal
    ones side by side; the places that have an equal neighbour are then joined to runs of words.
    """
    windows = F.transform(
        numbers(0, F.size(words_) - 3),
        lambda i: F.xxhash64(F.get(words_, i), F.get(words_, i + 1), F.get(words_, i + 2)),
    )

    def starts(placed: Column) -> Column:
        at = lambda j: F.get(placed, j)["h"]
        twice = F.filter(placed, lambda x, j: (x["h"] == at(j + 1)) | ((j > 0) & (x["h"] == at(j - 1))))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(first: Column) -> Column:
        fresh = F.transform(first, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(first, j + 1) - p, F.lit(3))))
        return F.aggregate(fresh, F.lit(0).cast("long"), lambda total, n: total + n)

    def counted(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(repeated, let(placed, lambda p: let(starts(p), covered))).otherwise(F.lit(0).cast("long"))

    return let(windows, counted)


def _counts(text: Column) -> Column:
    """A struct of all counts that the rules use."""
    long = lambda column: column.cast("long")

    def of(d: Column) -> Column:
        plain, split, lines = d["text"], d["words"], d["lines"]
        counts = {
            "n_words": long(F.size(split)),
            "word_chars": long(F.length(without_spaces(plain))),
            "n_symbols": count_of(plain, "#*$%&|<>"),
            "n_exclaims": count_of(plain, "!"),
            "n_upper": count_of(plain, UPPER),
            "n_stop_words": long(F.size(F.filter(split, lambda w: F.translate(w, UPPER, LOWER).isin(STOP_WORDS)))),
            "n_repeat_words": _repeat_words(split),
            "n_lines": long(F.size(lines)),
            "n_dup_lines": long(F.size(d["whole"]) - F.size(F.array_distinct(d["whole"]))),
            "n_ellipsis_lines": long(F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…")))),
            "n_bullet_lines": long(F.size(F.filter(lines, lambda x: F.substring(x, 1, 1).isin("-", "*", "•")))),
        }
        return F.struct(*[c.alias(name) for name, c in counts.items()])

    plain = F.coalesce(text, F.lit(""))
    lines = F.array_remove(trimmed_lines(text), "")
    whole = F.filter(F.split(plain, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    return let(F.struct(plain.alias("text"), words(text).alias("words"), lines.alias("lines"), whole.alias("whole")), of)


def _failed(counts: Column, rules) -> Column:
    """The names of the rules that a document with these counts breaks."""
    found = []
    for name, (part, whole, least, most) in rules.items():
        ratio = F.when(counts[whole] > 0, counts[part] / counts[whole])
        low = F.lit(False) if least is None else ratio < least
        high = F.lit(False) if most is None else ratio > most
        found.append(F.when(low | high, F.lit(name)))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def verdict(text: Column, rules=None) -> Column:
    """One struct with the counts, base_failed, failed (names of broken rules) and kept.

    It is one expression without columns in between, so a filter on it that the optimizer moves
    towards the scan stays one expression.
    """

    def of(counts: Column) -> Column:
        repeated = 100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"]
        base_failed = (counts["n_words"] < MIN_WORDS) | repeated
        failed = _failed(counts, RULES if rules is None else rules)
        kept = ~base_failed & (F.size(failed) == 0)
        return F.struct(*[counts[c].alias(c) for c in COUNTS], base_failed.alias("base_failed"), failed.alias("failed"), kept.alias("kept"))

    return let(_counts(text), of)


def apply_rules(docs: DataFrame, text: str = "text", rules=None) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``failed`` (names of broken rules) and ``kept``."""
    judged = packed(docs).withColumn("_verdict", verdict(field(text), rules))
    added = [*COUNTS, "base_failed", "failed", "kept"]
    return unpacked(judged, docs.columns, {c: F.col(f"_verdict.{c}") for c in added})


def quality_filter(docs: DataFrame, text: str = "text", rules=None) -> DataFrame:
    """The documents that break no rule, with the columns they came with."""
    return docs.where(verdict(F.col(f"`{text}`"), rules)["kept"])
