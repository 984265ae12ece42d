"""What the corpus operators share: the query registry, table reading and text primitives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

#: White space and letters as the result contracts name them; fixed values.
BLANK = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Tables of at most so many bytes are sent to the rows they are joined with.
BROADCAST_BYTES = 64 << 20

#: Stands for a missing id inside joins and comparisons: it sorts before all others.
NO_ID = -(2**63)


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_of(column: str) -> Column:
    """The id as a long that is never null."""
    return F.coalesce(F.col(column).cast("bigint"), F.lit(NO_ID))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores after it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def name_of(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def stowed(docs: DataFrame, text: str, doc_id: str | None = None) -> DataFrame:
    """(_row, _text[, _id]): the text, and the other columns in a struct, where their names meet no others."""
    rest = [name_of(c) for c in docs.columns if c != text]
    out = [F.struct(*rest or [F.lit(0)]).alias("_row"), name_of(text).alias("_text")]
    return docs.select(*out, *([] if doc_id is None else [name_of(doc_id).alias("_id")]))


def unstowed(docs: DataFrame, text: str, new: str = "_text") -> list[Column]:
    """The columns of ``docs`` in their order, from a stowed table whose text is now in ``new``."""
    return [F.col(new).alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns]


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def hash_pair(column: Column) -> list[Column]:
    """Two independently seeded 64-bit hashes; together they name a string."""
    return [F.xxhash64(column).alias("_h1"), F.xxhash64(F.lit(1), column).alias("_h2")]


def replace_text(docs: DataFrame, text: str, new: Column) -> DataFrame:
    """The same columns with another text; a character count column, where there is one, follows it."""
    out = docs.withColumn(text, new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(F.col(text)).cast(docs.schema["n_chars"].dataType))
    return out
