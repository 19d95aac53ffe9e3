"""Column expressions on texts that several operators share. All are built-in functions."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The characters that part words, and the ASCII letters.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def without_spaces(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def words(text: Column) -> Column:
    """The runs of characters other than space and \\x09-\\x0D; NULL has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(spaced, " "), "")


def count_of(text: Column, characters: str) -> Column:
    """How many characters of the text are among the given ones."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def trimmed_lines(text: Column) -> Column:
    """The lines between ``\\n``, without white space at either end; NULL has none."""
    lines = F.transform(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)))
    return F.coalesce(lines, F.array().cast("array<string>"))


def numbers(start, stop: Column) -> Column:
    """start, start + 1 … stop as an array, empty if stop is below start."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.when(stop >= start, F.sequence(start, stop)).otherwise(F.array().cast("array<int>"))


def packed(docs: DataFrame) -> DataFrame:
    """All columns in one, ``_row``, so that names an operator uses inside cannot clash with them."""
    return docs.select(F.struct("*").alias("_row"))


def field(name: str) -> Column:
    return F.col(f"_row.`{name}`")


def unpacked(rows: DataFrame, names: list[str], outputs: dict[str, Column]) -> DataFrame:
    """The columns ``names`` of a packed frame and the outputs, which replace columns of their name."""
    old = [(outputs[n] if n in outputs else field(n)).alias(n) for n in names]
    return rows.select(*old, *[c.alias(n) for n, c in outputs.items() if n not in names])


def whole_vectors(rows: DataFrame, vector: str, scale: float, offset: int = 0) -> DataFrame:
    """The rows whose vector has components, all of them finite, and ``x``: floor(scale * component) + offset of each."""
    given = F.transform(vector, lambda c: c.cast("double"))
    infinite = [F.lit(float(v)) for v in ("inf", "-inf", "nan")]
    sound = F.size(vector).cast("int") > 0
    sound &= ~F.exists(given, lambda c: c.isNull() | c.isin(*infinite))
    whole = F.transform(given, lambda c: F.floor(c * scale) + F.lit(offset).cast("long"))
    return rows.where(F.coalesce(sound, F.lit(False))).withColumn("x", whole)
