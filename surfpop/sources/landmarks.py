"""Landmark files: Markups JSON, FCSV and CSV."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfpop.functions import names
from surfpop.operators import checks
from surfpop.session import cut, wide_parts
from surfpop.sources import tables

MARKUPS = (
    "markups array<struct<type string, coordinateSystem string, controlPoints array<struct<"
    "id string, label string, position array<double>, positionStatus string>>>>"
)
# Fixed value: column order of an FCSV file that does not name its columns.
FCSV_COLUMNS = "id,x,y,z,ow,ox,oy,oz,vis,sel,lock,label,desc,associatedNodeID"


def specimen_of(path) -> F.Column:
    folder = F.regexp_extract(path, "specimen_id=([^/]+)/", 1)
    return F.when(folder != "", folder).otherwise(names.stem(names.base_name(path), names.LANDMARK_SUFFIXES))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """files(specimen_id, kind, text); one landmark file is one study's label set, so it is small."""
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    where = F.col("_metadata.file_path")
    return text.select(
        specimen_of(where).alias("specimen_id"),
        F.when(F.lower(where).endswith(".fcsv"), "fcsv").when(F.lower(where).endswith(".csv"), "csv")
        .otherwise("json").alias("kind"),
        F.regexp_replace("value", "^﻿", "").alias("text"),
    )


def _json_points(files: DataFrame) -> DataFrame:
    doc = files.filter("kind = 'json'").withColumn("d", F.from_json("text", MARKUPS))
    sets = F.size("d.markups")
    one = doc.withColumn("m", F.get("d.markups", F.lit(0)))
    return one.select(
        "specimen_id", F.when(sets == 1, F.coalesce("m.coordinateSystem", F.lit("RAS"))).alias("system"),
        F.posexplode_outer("m.controlPoints").alias("ord", "p"),
    ).select(
        "specimen_id", "system", "ord", "p.label",
        *[F.get("p.position", F.lit(i)).alias(n) for i, n in enumerate("xyz")],
        (F.coalesce("p.positionStatus", F.lit("defined")) == "defined").alias("defined"),
    )


def csv_cells(row: F.Column) -> F.Column:
    """The cells of a CSV row, however many; quotes around a cell go, doubled ones inside it become one."""
    quoted = lambda c: F.trim(c).rlike('^".*"$')
    inner = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), '^"|"$', ""), '""', '"')
    return F.transform(F.split(row, ',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda c: F.when(quoted(c), inner(c)).otherwise(c))


def _table_points(files: DataFrame) -> DataFrame:
    text = files.filter("kind <> 'json'").select(
        "specimen_id", "kind", F.filter(F.split("text", "\r\n|\r|\n"), lambda s: F.trim(s) != "").alias("rows")
    )
    fcsv = F.col("kind") == "fcsv"
    value = lambda line: F.trim(F.regexp_replace(line, "^[^=]*=", ""))
    tagged = lambda tag: F.when(F.exists("rows", lambda s: s.startswith(tag)), value(F.try_element_at(F.filter("rows", lambda s: s.startswith(tag)), F.lit(-1))))
    head = text.select(
        "specimen_id",
        F.when(fcsv, F.coalesce(tagged("# CoordinateSystem"), F.lit("RAS"))).otherwise("RAS").alias("system"),
        F.when(fcsv, F.coalesce(tagged("# columns"), F.lit(FCSV_COLUMNS))).otherwise(F.get("rows", F.lit(0))).alias("columns"),
        F.when(fcsv, F.filter("rows", lambda s: ~s.startswith("#"))).otherwise(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))).alias("rows"),
    ).withColumn("columns", F.transform(csv_cells(F.col("columns")), lambda c: F.trim(c)))
    cells = head.select("specimen_id", "system", "columns", F.posexplode("rows").alias("ord", "row")).withColumn(
        "c", csv_cells(F.col("row")))

    def field(name):
        at = F.array_position("columns", name)
        return F.when(at > 0, F.get("c", (at - 1).cast("int")))

    return cells.select(
        "specimen_id", "system", "ord", field("label").alias("label"),
        *[F.trim(field(n)).try_cast("double").alias(n) for n in "xyz"], F.lit(True).alias("defined"),
    )


def parse_landmarks(files: DataFrame, axes: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(landmarks(specimen_id, label, ord, x, y, z) in RAS, problems) from files(specimen_id, kind, text).

    ``axes`` overrides what the files say.
    """
    points = _json_points(files).unionByName(_table_points(files))
    if axes is not None:
        points = points.withColumn("system", F.lit(axes))
    system = F.upper(F.col("system"))
    flip = F.when(system.isin("LPS", "1"), -1.0).otherwise(1.0)
    bad = F.lit(False)
    for n in "xyz":
        bad = bad | F.col(n).isNull() | F.isnan(n) | (F.abs(F.col(n)) == F.lit(float("inf")))
    problem = (
        F.when(F.col("system").isNull() | ~system.isin("RAS", "LPS", "0", "1"), "not one landmark set with known axes")
        .when(F.col("ord").isNull(), "no landmarks").when(~F.col("defined"), "undefined point")
        .when(F.col("label").isNull() | (F.trim("label") == ""), "empty label").when(bad, "coordinates missing or not finite")
    )
    problems = points.select("specimen_id", problem.alias("problem")).filter("problem IS NOT NULL")
    landmarks = points.select(
        "specimen_id", "label", F.col("ord").cast("bigint").alias("ord"),
        (F.col("x") * flip).alias("x"), (F.col("y") * flip).alias("y"), "z",
    )
    return landmarks, problems


def read_landmarks(spark: SparkSession, path: str, axes: str | None = None) -> DataFrame:
    # The two formats, both checks and the result would open every file anew. The planner makes a task of every few files.
    landmarks, problems = parse_landmarks(cut(read_files(spark, path).coalesce(wide_parts(spark))), axes)
    checks.require_none(problems, "Invalid landmark file.")
    checks.require_none(checks.label_violations(landmarks), "Labels must be unique and nonempty.")
    return landmarks


def markups_text(landmarks: DataFrame) -> DataFrame:
    """(specimen_id, value): a minimal RAS Markups document per specimen."""
    points = F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "label", "x", "y", "z"))),
        lambda s: F.struct(
            s["ord"].cast("string").alias("id"), s["label"].alias("label"),
            F.array(s["x"], s["y"], s["z"]).alias("position"), F.lit("defined").alias("positionStatus"),
        ),
    )
    doc = F.struct(F.array(F.struct(
        F.lit("Fiducial").alias("type"), F.lit("RAS").alias("coordinateSystem"), F.col("points").alias("controlPoints")
    )).alias("markups"))
    return landmarks.groupBy("specimen_id").agg(points.alias("points")).select("specimen_id", F.to_json(doc).alias("value"))


def folder_of(value: str | None, column: str = "specimen_id") -> str:
    """The folder that ``partitionBy(column)`` makes of a value."""
    name = re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda c: f"%{ord(c[0]):02X}", value or "")
    return f"{column}={name or '__HIVE_DEFAULT_PARTITION__'}"


def _files_writer(root: str) -> Callable:
    def write(rows) -> None:
        for row in rows:
            folder = f"{root}/{folder_of(row['specimen_id'])}"
            os.makedirs(folder, exist_ok=True)
            part = f"{folder}/.{uuid.uuid4().hex}"  # renamed when whole, as a task may run twice
            with open(part, "w", encoding="utf-8", newline="") as file:
                file.write(row["value"] + "\n")
            os.replace(part, f"{folder}/part-00000.txt")

    return write


def write_landmarks(landmarks: DataFrame, path: str, overwrite: bool = False) -> None:
    """One Markups document per specimen under path/specimen_id=.../.

    A file costs its opening and not its bytes, so specimens are dealt over all tasks. In a shared folder the tasks write
    the files themselves: Hadoop's writer starts two processes per file there to set its mode, and the driver would move each
    folder. Other stores get Spark's writer, whose tasks move their own files (version 2 of the commit). Either way the
    folder is renamed when all files are there.
    """
    spark = landmarks.sparkSession
    text = markups_text(landmarks.repartition(wide_parts(spark), "specimen_id")).withColumn("specimen_id", F.col("specimen_id").cast("string"))

    def write(staged: str) -> None:
        root = tables.local_path(spark, staged)
        if root is None:
            text.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("specimen_id").text(staged)
        else:
            os.makedirs(root)
            text.foreachPartition(_files_writer(root))

    tables.commit(spark, path, write, overwrite)
