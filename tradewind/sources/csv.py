"""Raw CSV files, read as text by column name."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.parse import lenient_date, lenient_double, lenient_long, lenient_timestamp
from ..functions.text import flag
from ..schemas import CLEAN, RAW

# The texts that mean "no value" in the raw files.
NO_VALUE = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


MALFORMED = "_malformed"


def read_csv(spark: SparkSession, path: str, columns: list[str], multi_line: bool = False) -> DataFrame:
    """The named columns as text, whatever their order in the file; "no value" texts become NULL.

    A row with too many or too few fields fails the job, also where none of its fields is wanted: the
    reader splits whole rows (``columnPruning`` is its option to split no more than it needs), keeps
    the text of a malformed one beside the wanted columns, and makes no other column. Line breaks
    inside quotes need ``multi_line``; a file is then read by one task, so keep files small. Without
    it such a row is malformed and fails the job.

    Only the header line is read here, and every file of a folder must have the same one. Types are
    not inferred: that would cost a second pass over the file and would lose 't'/'f' flags and long ids.
    """
    options = {"header": True, "escape": '"', "enforceSchema": False, "multiLine": multi_line}
    names = spark.read.options(**options).csv(path).columns
    schema = StructType([StructField(c, StringType()) for c in [*names, MALFORMED]])
    options |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED, "columnPruning": False}
    found = spark.read.options(**options).schema(schema).csv(path)
    # The reader refuses a query of nothing but malformed texts, such as a count, so the message names a column.
    first = F.coalesce(F.col(f"`{columns[0]}`"), F.lit("NULL"))
    error = F.raise_error(F.concat(F.lit(f"malformed row in {path} ({columns[0]} "), first, F.lit("): "), F.col(MALFORMED))).cast("boolean")
    sound = found.where(F.when(F.col(MALFORMED).isNotNull(), error).otherwise(True))
    return sound.select(*[F.when(~F.col(f"`{c}`").isin(*NO_VALUE), F.col(f"`{c}`")).alias(c) for c in columns])


def read_raw(spark: SparkSession, folder: str, multi_line: bool = False) -> dict[str, DataFrame]:
    """The five raw files of a data set."""
    return {name: read_csv(spark, f"{folder}/{name}.csv", columns, multi_line) for name, columns in RAW.items()}


_CONVERSIONS = {
    "bigint": lenient_long,
    "double": lenient_double,
    "boolean": flag,
    "date": lenient_date,
    "timestamp_ntz": lenient_timestamp,
    "string": lambda c: c,
}


def read_typed_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV file of cleaned data with the types of ``schema`` ("a bigint, b string"), or some of its columns.

    Whole numbers may be written with a fraction of zero, and UTC times with "+00:00".
    """
    types = dict(field.split(" ") for field in schema.split(", "))
    wanted = columns or list(types)
    return read_csv(spark, path, wanted).select(*[_CONVERSIONS[types[c]](F.col(c)).alias(c) for c in wanted])


def read_clean_csv(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The eight cleaned tables, kept as CSV files; events there have no category_sk."""
    columns = {name: [field.split(" ")[0] for field in schema.split(", ")] for name, schema in CLEAN.items()}
    columns["events"].remove("category_sk")
    return {name: read_typed_csv(spark, f"{folder}/{name}.csv", schema, columns[name]) for name, schema in CLEAN.items()}
