"""From raw files to stored tables: the cleaning run and the model load."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import audit, row_counts, union_all
from ..operators.storage import materialise, table_scope
from ..sources.csv import read_raw
from ..sources.months import Months
from ..sources.tables import current, publication, read_clean, read_tables, write_tables
from . import models
from .clean import CLEANERS, clean_and_audit, clean_first_purchases
from .dimensions import assign_keys, build_clients, build_users, enforce_campaigns

MODELS = ("relational", "wide", "document", "graph")


def clean_dataset(spark: SparkSession, raw_folder: str, folder: str, multi_line: bool = False) -> DataFrame:
    """Clean the five raw files into the eight tables under ``folder``; returns the audit report.

    Clients are taken from the messages before those without a known campaign are dropped. Each raw
    file is parsed once, into a table that goes with the other intermediate ones when the job ends.
    The tables are published together, so a run that fails leaves the former ones in place.
    ``multi_line`` reads line breaks inside quotes.
    """
    with table_scope(spark), publication(spark, folder) as version:
        raw = {name: materialise(df, f"raw-{name}") for name, df in read_raw(spark, raw_folder, multi_line).items()}
        clean, reports = {}, []
        for name in CLEANERS:
            clean[name], report = clean_and_audit(name, raw[name])
            reports.append(report)
        categories, products, events = assign_keys(clean["events"])
        clients = build_clients(clean["messages"], clean_first_purchases(raw["client_first_purchase_date"]))
        messages = enforce_campaigns(clean["messages"], clean["campaigns"])
        stored = version.write(
            {
                "events": events,
                "campaigns": clean["campaigns"],
                "messages": messages,
                "clients": clients,
                "friends": clean["friends"],
                "categories": categories,
                "products": products,
            }
        )
        users = version.write({"users": build_users(stored["events"], stored["clients"], stored["friends"])})["users"]
        unmatched = stored["events"].filter("product_sk IS NULL")
        reports += [
            audit("clients", raw["client_first_purchase_date"], stored["clients"]),
            audit("messages with a known campaign", clean["messages"], stored["messages"]),
            audit("users", users, users),
            audit("events without a product key", unmatched, unmatched),
        ]
        return _kept(union_all(reports))


def load_models(
    spark: SparkSession,
    clean_folder: str,
    folder: str,
    forms: tuple[str, ...] = MODELS,
    parts: int = models.PARTS,
    months: Months | None = None,
) -> DataFrame:
    """Store the chosen models of a cleaned data set, each as <form> in a new version of ``folder``.

    Returns the audit: what each foreign key dropped (table, key, n_rows, dropped), and with key
    "rows" the size of each resolved table. Resolved tables are written once, and all forms are made
    from them and published together. ``parts`` is the layout of the document form's users,
    ``months`` bounds the months that events are stored by.
    """
    with table_scope(spark), publication(spark, folder) as version:
        resolved, dropped = models.resolve_with_audit(read_clean(spark, clean_folder), months)
        write_models(resolved, version.path, forms, parts)
        sizes = row_counts(resolved).select(
            F.col("name").alias("table"), F.lit("rows").alias("key"), F.col("n").alias("n_rows"), F.lit(0).cast("bigint").alias("dropped")
        )
        return _kept(dropped.unionByName(sizes))


def read_model(spark: SparkSession, folder: str, form: str, names: list[str]) -> dict[str, DataFrame]:
    """Tables of one form in the current version of ``folder``."""
    return read_tables(spark, f"{current(spark, folder)}/{form}", names)


def _kept(report: DataFrame) -> DataFrame:
    """A report of some rows that outlives the tables it was made from."""
    return report.sparkSession.createDataFrame(report.collect(), report.schema)


def write_models(
    resolved: dict[str, DataFrame], folder: str, forms: tuple[str, ...] = MODELS, parts: int = models.PARTS
) -> None:
    """Store models of resolved tables. The relational forms keep their events by month."""
    for form in forms:
        layout = models.PARTITION_BY if form in ("relational", "wide") else None
        write_tables(tables_of(resolved, form, parts), f"{folder}/{form}", layout)


def tables_of(resolved: dict[str, DataFrame], form: str, parts: int = models.PARTS) -> dict[str, DataFrame]:
    """The tables of one model; a graph's are its vertex labels and edge types."""
    if form == "graph":
        vertices, edges = models.graph(resolved)
        return {**vertices, **edges}
    if form == "document":
        return models.documents(resolved, parts)
    builders = {"relational": models.normalised, "wide": models.denormalised}
    return builders[form](resolved)
