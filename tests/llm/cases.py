"""Small tables that hold what real ones may: NULLs, empty and long texts, ties, repeats, clashing names."""

import random

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORDS = "the and of der die und alpha beta gamma delta river stone café naïve 漢字 x1".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, seed=3):
    """Rows (doc_id, text, lang, source, n_chars) and columns with the names operators use inside."""
    rng = random.Random(seed)
    passage, notice = text(rng, 60), "Accept all cookies on this site."
    rows = [(i, text(rng, rng.choice([0, 1, 9, 40, 80])), f"site{i % 4}") for i in range(20)]
    rows += [(20 + i, f"{text(rng, 12)}\n{notice}\n{passage}\n{text(rng, 7)}", f"site{i % 12}") for i in range(12)]
    rows += [(40, None, "site0"), (41, "", None), (42, " \n\t ", "site1"), (None, text(rng, 50), "site2")]
    rows += [(43, "x " * 3000, "site3"), (44, text(rng, 4000), "site4"), (44, rows[5][1], "site4"), (20, rows[20][1], "site0")]
    rows += [(50 + i, rows[20][1], f"site{i}") for i in range(3)]
    data = [(d, t, "en", s, len(t) if t is not None else None) for d, t, s in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(data, schema)


def clashing(docs):
    """The documents with more columns, named like results and inner columns."""
    names = "id key fp block payload _row _id _key _words kept items n_words u v ids license path".split()
    return docs.select("*", *[F.lit(f"own {n}").alias(n) for n in names])


def empty(docs):
    return docs.where(F.lit(False))


def collected(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
