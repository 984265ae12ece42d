"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL_ROOT: dict[str, str] = {}
# Bytes of rows, as reckoned by ``by_row``, that a task gathers before it hands them on.
ROW_BYTES = 8 << 20


def build(app: str = "surfpop", master: str | None = None, shuffle_partitions: int | None = None,
          **conf: str) -> SparkSession:
    """A session with adaptive execution and skew handling switched on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a scratch folder only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder every executor can reach.")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOT:
        _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_ROOT[app]


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    The result no longer depends on the plan that made it, survives the loss of
    executors, and carries real sizes, so later joins choose their strategy from them.
    """
    path = f"{work_root(df.sparkSession)}/surfpop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number_rows(df: DataFrame, group: list[str], block: str, order: list, out: str) -> DataFrame:
    """Number the rows of every group from 0, ordered by block and then by ``order``.

    Only the rows of one block meet in one task. Groups are stitched together from
    the block counts, so a group holding most of the table stays spread out.
    """
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*group, block).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*group, block).orderBy(*order)
    return (
        df.withColumn("_rank", F.row_number().over(inside))
        .join(shuffled(offsets), [*group, block])
        .withColumn(out, (F.col("_before") + F.col("_rank") - 1).cast("bigint"))
        .drop("_rank", "_before")
    )


def wide_parts(spark: SparkSession) -> int:
    """Partition count for work that is heavy per row rather than per byte.

    Adaptive coalescing goes by bytes and would put a few megabytes of queries, each
    worth thousands of operations, into one task; a fixed count is left alone.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def row_parts(df: DataFrame, rows: int) -> int:
    """Partition count that leaves about ``rows`` rows to a task.

    Bytes on disk or in a shuffle say little of rows that repeat; tasks counted by them hold more rows as the tables grow.
    """
    return max(wide_parts(df.sparkSession), -(-df.count() // rows))


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is to be shuffled and sorted, never broadcast.

    The planner takes the size of exploded rows from the file behind them, and that of a written table from its
    compressed bytes. Rows of surfaces, pixels and colours then pass for a small table and go through the driver.
    """
    return df.hint("merge")


def by_row(rows: DataFrame, work: Callable[[dict], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that ``work`` makes of every row, as ``schema`` names them; a column of type ``key`` is that of mesh_id.

    A batch holds up to 10 000 rows, and a row may be a whole mesh. One row at a time becomes Python objects, and what they make
    leaves in small batches, so a task holds no more than that beside the batch itself.
    """
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    columns = [c.split() for c in schema.split(",")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            types = [b.schema.field("mesh_id").type if kind == "key" else kinds[kind] for _, kind in columns]
            ready, held = [], 0

            def batch():
                return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*ready), types)], names=[n for n, _ in columns])

            for k in range(b.num_rows):
                for row in work(b.slice(k, 1).to_pylist()[0]):
                    ready.append(row)
                    held += 100 + sum(len(v) for v in row if isinstance(v, bytes))
                    if held >= ROW_BYTES:
                        yield batch()
                        ready, held = [], 0
            if ready:
                yield batch()

    own = rows.schema["mesh_id"].dataType.simpleString()
    return rows.mapInArrow(each, ", ".join(f"{n} {own if kind == 'key' else kind}" for n, kind in columns))


def spread_join(big: DataFrame, small: DataFrame, on: list[str], salt_by: list[str], salts: int = 16,
                how: str = "inner", heavy: bool = False) -> DataFrame:
    """Equi-join where one key may hold a large share of ``big``.

    ``small`` has few rows per key. Each key is split into ``salts`` keys, chosen on the
    big side by a hash of ``salt_by``, so no single task receives a whole hot key. ``heavy`` fixes the number of tasks for
    costly work on the joined rows; the join itself uses the same layout. Both sides are shuffled, for the planner may
    take either for a small table (see ``shuffled``).
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    if heavy:
        left = left.repartition(wide_parts(big.sparkSession), *on, "_salt")
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("shuffle_hash"), [*on, "_salt"], how).drop("_salt")


def block_digest(df: DataFrame, group: list[str], position: str, text: str, out: str,
                 fan: int = 1024, levels: int = 3) -> DataFrame:
    """SHA-256 per group over its rows in ``position`` order, built from block digests.

    Rows are hashed in blocks of ``fan`` positions, then blocks of digests, and so on,
    so no task ever concatenates a whole group.
    """
    rows = df.select(*group, F.col(position).cast("bigint").alias("_pos"), F.col(text).alias("_txt"))
    for level in range(levels):
        last = level == levels - 1
        keyed = rows if last else rows.withColumn("_block", F.floor(F.col("_pos") / fan).cast("bigint"))
        keys = group if last else [*group, "_block"]
        rows = keyed.groupBy(*keys).agg(
            F.sha2(
                F.array_join(
                    F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_txt"))), lambda s: s["_txt"]),
                    ";",
                ),
                256,
            ).alias("_txt")
        )
        if not last:
            rows = rows.withColumnRenamed("_block", "_pos")
    return rows.withColumnRenamed("_txt", out)
