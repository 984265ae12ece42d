"""Finding specimens: files paired by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfpop.functions import names
from surfpop.operators import checks

KINDS = {"model": names.MODEL_SUFFIXES, "landmark": names.LANDMARK_SUFFIXES, "texture": names.TEXTURE_SUFFIXES}
FOLDERS = {"model": "models", "landmark": "landmarks", "texture": "textures"}


def list_files(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """files(kind, name, path) of one folder; contents are not read."""
    return spark.read.format("binaryFile").load(folder).select(
        F.lit(kind).alias("kind"), names.base_name(F.col("path")).alias("name"), "path"
    )


def identify(files: DataFrame) -> DataFrame:
    """Adds specimen_id: the name without the ending its kind accepts; other files are dropped."""
    known, stem = F.lit(False), F.lit(None).cast("string")
    for kind, suffixes in KINDS.items():
        match = (F.col("kind") == kind) & names.has_suffix(F.col("name"), suffixes)
        known, stem = known | match, F.when(match, names.stem(F.col("name"), suffixes)).otherwise(stem)
    return files.withColumn("specimen_id", stem).filter(known & ~names.is_hidden(F.col("name")))


def pair_files(files: DataFrame, exact_textures: bool = False) -> tuple[DataFrame, DataFrame]:
    """(specimens, problems): one mesh, one landmark file and at most one texture per id."""
    named = identify(files)
    per = named.groupBy("specimen_id").agg(*[
        e for kind in KINDS for e in (
            F.count(F.when(F.col("kind") == kind, 1)).alias(f"n_{kind}"),
            F.min(F.when(F.col("kind") == kind, F.col("path"))).alias(f"{kind}_path"),
        )
    ])
    rules = [
        *[(F.col(f"n_{kind}") > 1, f"several {kind} files") for kind in KINDS],
        ((F.col("n_model") > 0) & (F.col("n_landmark") == 0), "missing landmark"),
        ((F.col("n_model") == 0) & (F.col("n_landmark") > 0), "missing model"),
    ]
    if exact_textures:
        rules += [
            ((F.col("n_model") > 0) & (F.col("n_texture") == 0), "missing texture"),
            ((F.col("n_model") == 0) & (F.col("n_landmark") == 0) & (F.col("n_texture") > 0), "extra texture"),
        ]
    found = F.array_compact(F.array(*[F.when(rule, F.lit(text)) for rule, text in rules]))
    problems = per.select("specimen_id", F.explode(found).alias("problem"))
    specimens = per.filter((F.col("n_model") > 0) & (F.col("n_landmark") > 0)).select(
        "specimen_id", F.col("model_path").alias("mesh_path"), F.col("landmark_path").alias("landmarks_path"),
        "texture_path",
    )
    return specimens, problems


def discover(spark: SparkSession, root: str, exact_textures: bool = True) -> DataFrame:
    """specimens(specimen_id, mesh_path, landmarks_path, texture_path) under a dataset folder."""
    files = None
    for kind, folder in FOLDERS.items():
        part = list_files(spark, f"{root.rstrip('/')}/{folder}", kind)
        files = part if files is None else files.unionByName(part)
    specimens, problems = pair_files(files, exact_textures)
    checks.require_none(problems, "Files do not pair up.")
    if specimens.isEmpty():
        raise ValueError("No specimens found.")
    return specimens
