"""Result tables on disk."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from surfpop.operators.models import Model

MODEL_TABLES = ("prep", "loadings", "scores", "variance")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def local_path(spark: SparkSession, path: str) -> str | None:
    """The plain path of a folder in a file system that every task opens by itself, else nothing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    where = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    return where.getPath() if where.getScheme() == "file" else None


def commit(spark: SparkSession, path: str, write: Callable[[str], None], overwrite: bool = False) -> str:
    """Lets ``write`` fill a folder beside ``path`` and renames it when it is whole.

    Readers see the old table or the new one, a failed write leaves the old one, and a table may be replaced by rows
    that are read from it. What stands at ``path`` is refused unless ``overwrite``.
    """
    path = path.rstrip("/")
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    parent, name, mark = path.rpartition("/")[0], path.rpartition("/")[2], uuid.uuid4().hex

    def beside(kind: str) -> str:
        return f"{parent}/.{name}-{kind}-{mark}" if parent else f".{name}-{kind}-{mark}"

    if files.exists(at) and not overwrite:
        raise FileExistsError(f"{path} exists; overwrite=True replaces it.")
    staged, old = beside("staged"), beside("old")
    try:
        write(staged)
        replaced = files.exists(at)
        if replaced and not overwrite:
            raise FileExistsError(f"{path} was written meanwhile; overwrite=True replaces it.")
        if replaced and not files.rename(at, hadoop.Path(old)):
            raise OSError(f"{path} cannot be set aside.")
        if not files.rename(hadoop.Path(staged), at):
            if replaced:
                files.rename(hadoop.Path(old), at)
            raise OSError(f"{staged} cannot be renamed to {path}.")
    finally:
        for left in (staged, old):
            files.delete(hadoop.Path(left), True)
    return path


def publish(df: DataFrame, path: str, overwrite: bool = False) -> str:
    """Parquet that refuses to replace an existing table unless asked."""
    return commit(df.sparkSession, path, df.write.parquet, overwrite)


def save_model(model: Model, path: str, overwrite: bool = False) -> str:
    """The model's tables; one that it does not have, as the scores of a model made by hand, is left out."""
    for name in MODEL_TABLES:
        if getattr(model, name) is not None:
            publish(getattr(model, name), f"{path}/{model.method}/{name}", overwrite)
    return f"{path}/{model.method}"


def load_model(spark: SparkSession, path: str) -> Model:
    """The saved tables transform and reconstruct just like the fitted ones."""
    tables = {name: spark.read.parquet(f"{path}/{name}") if exists(spark, f"{path}/{name}") else None for name in MODEL_TABLES}
    return Model(method=path.rstrip("/").rsplit("/", 1)[-1], **tables)
