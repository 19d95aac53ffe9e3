"""Text conforming."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spark's trim() removes blanks only; the data may also carry tabs, line ends and no-break spaces.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# The spellings that mean true and false.
TRUE_WORDS = ("t", "true", "1")
FALSE_WORDS = ("f", "false", "0")


def strip(c: Column) -> Column:
    """Text without surrounding whitespace; case is kept and NULL stays NULL."""
    return F.trim(c.cast("string"), F.lit(WHITESPACE))


def normalize(c: Column) -> Column:
    """Stripped, lower-case text; NULL stays NULL."""
    return F.lower(strip(c))


def flag(c: Column) -> Column:
    """Boolean from its usual spellings; anything else is NULL."""
    # One lookup, as a second condition on the word would conform the text again.
    meanings = {**dict.fromkeys(TRUE_WORDS, True), **dict.fromkeys(FALSE_WORDS, False)}
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in meanings.items() for v in pair]), normalize(c))
