"""Sinks of results: tables in folders, JSON reports, Markdown of small tables."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows that a report may show of a table; more stay in the stored one.
SHOWN_ROWS = 80


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """Each table as Parquet, CSV or JSON below a folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).format(kind).save(f"{folder}/{name}")


def write_json(df: DataFrame, folder: str, name: str, part: str | None = None) -> str:
    """A table of structs as JSON lines, nulls written out, in a folder of its own; then the manifest names it. Returns the folder.

    The manifest is a small table of rows (name, part, path, rows), one file for each call. It is written last and
    by one rename, so a reader that goes by it never sees half a table; of several of one name and part the latest holds.
    """
    spark, path = df.sparkSession, f"{folder}/{name}-{uuid.uuid4().hex}"
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    rows = spark.read.text(path).count()
    entry = spark.createDataFrame([(name, part, path, rows, time.time_ns())], "name string, part string, path string, rows long, at long")
    entry.coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return path


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(name, part, path, rows) of the latest table under each name and part."""
    told = spark.read.parquet(f"{folder}/manifest")
    return told.groupBy("name", "part").agg(F.max_by(F.struct("path", "rows"), "at").alias("x")).select("name", "part", "x.*")


def read_json(spark: SparkSession, folder: str, name: str, schema: StructType | str, part: str | None = None) -> DataFrame:
    """The table that the manifest names, under a schema."""
    found = manifest(spark, folder).where((F.col("name") == name) & F.col("part").eqNullSafe(F.lit(part))).first()
    if found is None:
        raise FileNotFoundError(f"no table {name} in {folder}")
    return spark.read.schema(schema).json(found.path)


def risk_report(state: DataFrame, grid: DataFrame, contributions: DataFrame, events: DataFrame, signals: DataFrame) -> DataFrame:
    """(panel, report): one JSON text a panel of its state, VaR grid, contributions, last events and signals.

    state has a row a panel; the others are gathered by panel, of which each has
    as many rows as assets, horizons or detectors.
    """
    out = state.select("panel", F.struct(*[c for c in state.columns if c != "panel"]).alias("state"))
    for name, df in (("var", grid), ("contributions", contributions), ("anomalies", events), ("signals", signals)):
        rows = df.groupBy("panel").agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != "panel"]))).alias(name))
        out = out.join(rows, "panel", "left")
    fields = [c for c in out.columns if c != "panel"]
    return out.select("panel", F.to_json(F.struct(F.lit("risk_report_v1").alias("schema_version"), F.col("panel"), *fields)).alias("report"))


def markdown(df: DataFrame, rows: int = SHOWN_ROWS) -> str:
    """The first rows of a small table as Markdown."""
    shown = df.limit(rows).collect()
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [" | ".join(df.columns), " | ".join("-" for _ in df.columns), *(" | ".join(cell(v) for v in r) for r in shown)]
    return "\n".join(f"| {x} |" for x in lines)


def patched(text: str, mark: str, body: str) -> str:
    """text with what stands between `<!-- mark -->` and `<!-- /mark -->` replaced by body; added at the end if there are no marks."""
    block = f"<!-- {mark} -->\n{body}\n<!-- /{mark} -->"
    found = re.compile(rf"<!-- {re.escape(mark)} -->.*?<!-- /{re.escape(mark)} -->", re.S)
    return found.sub(lambda _: block, text) if found.search(text) else f"{text.rstrip()}\n\n{block}\n"
