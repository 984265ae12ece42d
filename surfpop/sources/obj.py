"""Triangular OBJ text as mesh tables, and back."""

from __future__ import annotations

import itertools
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surfpop.functions import names
from surfpop.operators import checks
from surfpop.operators.mesh import Mesh
from surfpop.session import cut, shuffled, wide_parts
from surfpop.sources import tables
from surfpop.sources.landmarks import folder_of

KINDS = ("v", "vt", "f")


def mesh_id_of(path) -> F.Column:
    """The partition folder's value if there is one, else the file name without its ending."""
    folder = F.regexp_extract(path, "mesh_id=([^/]+)/", 1)
    return F.when(folder != "", folder).otherwise(names.stem(names.base_name(path), names.MODEL_SUFFIXES))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """lines(mesh_id, block, pos, line): file splits are the blocks, so a large file is many tasks."""
    text = spark.read.option("recursiveFileLookup", "true").text(path)
    where = F.col("_metadata.file_path")
    return text.select(
        mesh_id_of(where).alias("mesh_id"),
        F.struct(where.alias("path"), F.col("_metadata.file_block_start").alias("start")).alias("block"),
        F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"),
    )


def parse_obj(lines: DataFrame, axes: str = "RAS") -> tuple[Mesh, DataFrame]:
    """(mesh, problems) from lines(mesh_id, block, pos, line).

    Records are numbered within a block and shifted by the counts of the blocks before
    it, which also gives "records so far" for negative indices.
    """
    if axes not in ("RAS", "LPS"):
        raise ValueError("axes must be RAS or LPS.")
    body = F.trim(F.translate(F.element_at(F.split(F.regexp_replace("line", "^﻿", ""), "#"), 1), "\t\r\f", "   "))
    rec = lines.select("mesh_id", "block", "pos", F.split(body, " +").alias("f")).withColumn("kind", F.col("f")[0])
    rec = cut(rec.filter(F.col("kind").isin(*KINDS)))  # counted and numbered: files would be opened and split into words anew
    here = Window.partitionBy("mesh_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("mesh_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rec.groupBy("mesh_id", "block").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS])
    offsets = offsets.select("mesh_id", "block", *[F.coalesce(F.sum(f"n_{k}").over(before), F.lit(0)).alias(f"o_{k}") for k in KINDS])
    rec = rec.select("*", *[F.count(F.when(F.col("kind") == k, 1)).over(here).alias(f"i_{k}") for k in KINDS])
    rec = cut(rec.join(shuffled(offsets), ["mesh_id", "block"]).select(
        "mesh_id", "f", "kind", *[(F.col(f"i_{k}") + F.col(f"o_{k}")).cast("bigint").alias(f"n_{k}") for k in KINDS]
    ))

    def number(i):
        return F.get("f", F.lit(i)).try_cast("double")

    def finite(c):
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))

    sign = -1.0 if axes == "LPS" else 1.0
    v = rec.filter("kind = 'v'").select("mesh_id", F.col("n_v").alias("vertex_id"),
                                        (number(1) * sign).alias("x"), (number(2) * sign).alias("y"), number(3).alias("z"))
    vt = rec.filter("kind = 'vt'").select("mesh_id", F.col("n_vt").alias("vt_id"), number(1).alias("u"), number(2).alias("v"))
    raw = rec.filter("kind = 'f'").select(
        "mesh_id", F.col("n_f").alias("face_id"), "n_v", "n_vt", (F.size("f") == 4).alias("triangle"),
        F.posexplode(F.slice("f", 2, 3)).alias("corner", "token"),
    )
    part = F.split("token", "/")

    def resolve(text, count):
        i = text.try_cast("bigint")
        at = F.when(i > 0, i - 1).when(i < 0, count + i)
        return F.when((at >= 0) & (at < count), at)

    uv_text = F.nullif(F.get(part, F.lit(1)), F.lit(""))
    corner = raw.select(
        "mesh_id", "face_id", "corner", "triangle", resolve(F.get(part, F.lit(0)), F.col("n_v")).alias("vertex_id"),
        uv_text.isNotNull().alias("has_uv"), resolve(uv_text, F.col("n_vt")).alias("vt_id"),
    )
    bad_v = F.lit(False)
    for n in "xyz":
        bad_v = bad_v | ~finite(F.col(n))
    per_face = corner.groupBy("mesh_id", "face_id").agg(
        F.bool_and("triangle").alias("triangle"), F.count(F.lit(1)).alias("n"), F.count("vertex_id").alias("ok"),
        F.sum((F.col("has_uv") & F.col("vt_id").isNull()).cast("int")).alias("bad_uv"),
        *[F.max(F.when(F.col("corner") == k, F.col("vertex_id"))).alias(c) for k, c in enumerate("abc")],
    )
    mixed = corner.groupBy("mesh_id").agg(F.bool_or("has_uv").alias("some"), F.bool_and("has_uv").alias("all"))
    problems = (
        v.filter(bad_v).select("mesh_id", F.lit("vertex without three finite numbers").alias("problem"))
        .unionByName(vt.filter(~finite(F.col("u")) | ~finite(F.col("v"))).select("mesh_id", F.lit("texture point without two finite numbers").alias("problem")))
        .unionByName(per_face.filter("NOT triangle OR n <> 3").select("mesh_id", F.lit("face is not a triangle").alias("problem")))
        .unionByName(per_face.filter("triangle AND n = 3 AND (ok <> 3 OR bad_uv > 0)").select("mesh_id", F.lit("face index out of range").alias("problem")))
        .unionByName(mixed.filter("some AND NOT all").select("mesh_id", F.lit("texture coordinates on some corners only").alias("problem")))
    )
    uv = corner.filter("has_uv").select("mesh_id", "face_id", F.col("corner").cast("bigint").alias("corner"), "vt_id").join(
        shuffled(vt), ["mesh_id", "vt_id"]
    ).select("mesh_id", "face_id", "corner", "u", "v")
    return Mesh(v, per_face.select("mesh_id", "face_id", "a", "b", "c"), uv), problems


def read_obj(spark: SparkSession, path: str, axes: str = "RAS") -> Mesh:
    """Mesh tables of every OBJ file under a path; a malformed file is an error."""
    # The planner makes a task of every few files.
    mesh, problems = parse_obj(read_lines(spark, path).coalesce(wide_parts(spark)), axes)
    checks.require_none(problems, "Invalid OBJ.")
    return mesh


def obj_lines(mesh: Mesh) -> DataFrame:
    """(mesh_id, section, k, value): OBJ text rows in writing order, one vt per face corner."""
    text = lambda *parts: F.concat_ws(" ", *parts)
    s = lambda c: F.col(c).cast("string")
    out = mesh.vertices.select("mesh_id", F.lit(0).alias("section"), F.col("vertex_id").alias("k"), text(F.lit("v"), s("x"), s("y"), s("z")).alias("value"))
    if mesh.corner_uv is None:
        tokens = [(F.col(c) + 1).cast("string") for c in "abc"]
    else:
        out = out.unionByName(mesh.corner_uv.select(
            "mesh_id", F.lit(1).alias("section"), (F.col("face_id") * 3 + F.col("corner")).alias("k"), text(F.lit("vt"), s("u"), s("v")).alias("value")
        ))
        tokens = [
            F.concat_ws("/", (F.col(c) + 1).cast("string"), (F.col("face_id") * 3 + k + 1).cast("string")) for k, c in enumerate("abc")
        ]
    return out.unionByName(mesh.faces.select(
        "mesh_id", F.lit(2).alias("section"), F.col("face_id").alias("k"), text(F.lit("f"), *tokens).alias("value")
    ))


def _parts_writer(root: str) -> Callable:
    """Writes rows(mesh_id, value) in their order, a part file for every mesh of a task; counts the files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, part = f"part-{TaskContext.get().partitionId():05d}.txt", f".{uuid.uuid4().hex}"  # renamed when whole, as a task may run twice
        rows = (row for b in batches for row in zip(b["mesh_id"].to_pylist(), b["value"].to_pylist()))
        files = 0
        for mesh_id, lines in itertools.groupby(rows, lambda row: row[0]):
            folder = f"{root}/{folder_of(mesh_id, 'mesh_id')}"
            os.makedirs(folder, exist_ok=True)
            with open(f"{folder}/{part}", "w", encoding="utf-8", newline="") as file:
                file.writelines(f"{line}\n" for _, line in lines)
            os.replace(f"{folder}/{part}", f"{folder}/{name}")
            files += 1
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], ["files"])

    return write


def write_obj(mesh: Mesh, path: str, overwrite: bool = False) -> None:
    """OBJ text under path/mesh_id=.../; ids must run from 0.

    Rows are range-partitioned in writing order: a small mesh is one part file, a large
    one several whose names sort in order and whose concatenation is the OBJ file. As with landmarks, the tasks write the
    files of a shared folder themselves, and other stores get Spark's writer.
    """
    keyed = obj_lines(mesh).withColumn("mesh_id", F.coalesce(F.col("mesh_id").cast("string"), F.lit("")))
    order = ["mesh_id", "section", "k"]
    rows = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("mesh_id", "value")
    spark = rows.sparkSession

    def write(staged: str) -> None:
        root = tables.local_path(spark, staged)
        if root is None:
            rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("mesh_id").text(staged)
        else:
            os.makedirs(root)
            rows.mapInArrow(_parts_writer(root), "files bigint").write.format("noop").mode("overwrite").save()

    tables.commit(spark, path, write, overwrite)
