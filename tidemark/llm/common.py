"""What the llm operators share: inputs, batch sizes and row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch; a text may be long, so the default of 10,000 rows is too many.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Hand texts to Python in batches of at most `rows` rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def quoted(name: str) -> str:
    """A column's name as F.col() reads it, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame) -> DataFrame:
    """docs as one column, row, so that no name put beside it can clash; "row.*" gives the columns back."""
    return docs.select(F.struct(*[F.col(quoted(c)).alias(c) for c in docs.columns]).alias("row"))


def others(columns: list[str], *names: str) -> list[Column]:
    """The columns of packed rows, without those that have one of the given names in any case: results take their place."""
    taken = {n.lower() for n in names}
    return [F.col(f"row.{quoted(c)}").alias(c) for c in columns if c.lower() not in taken]


def sha256_hex(value: Column) -> Column:
    return F.sha2(value, 256)


def row_keys(ident: str, text: str) -> tuple[Column, Column]:
    """128 bits that stand for one row's id and text; never null.

    Rows with the same id and the same text get the same key.
    """
    return (
        F.xxhash64(F.col(ident), F.col(text)).alias("key_a"),
        F.xxhash64(F.lit(1), F.col(text), F.col(ident)).alias("key_b"),
    )
