"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes handed to a Python worker at once. Documents have no length
#: limit, so batches are kept small: a worker holds one batch, not one partition.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20
#: Partial sums that one task adds up, and that the driver receives at most.
FAN_IN = 16
#: Rows of a few numbers that a file of a checkpoint is to hold.
FILE_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where a local session names none (tests) a temporary folder is made once and
    kept in the session. On a cluster that is an error: executors couldn't read
    what another one wrote.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="parchmint-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/parchmint-{spark.sparkContext.applicationId}"


def clear_written(spark: SparkSession) -> None:
    """Deletes what ``written`` has left in the shared folder; results that still read it break."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder."""
    spark = df.sparkSession
    path = shared_dir(spark)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return df.checkpoint(eager=True)


def files_for(spark: SparkSession, rows: int) -> int:
    """Partitions for checkpointing ``rows`` rows of a few numbers, as many as there are shuffle partitions at most.

    A file costs the same whatever it holds: Hadoop's local file system starts two
    processes for each, so many small files are far dearer than their rows.
    """
    return max(1, min(-(-rows // FILE_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))))


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back.

    For results that several later plans scan with column pruning. All of an
    application's files are in one folder, see ``clear_written``.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches for the session, unless its own bounds are closer.

    Spark reads the setting when a result is computed, so it can't be put back
    by whoever builds the plan.
    """
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).strip().lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


PARTIAL = "key long, values binary"


def partial(values: np.ndarray) -> pa.RecordBatch:
    """A task's float64 vector as a row of ``total``."""
    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([values.astype(np.float64).tobytes()], pa.binary())], ["key", "values"])


def total(rows: DataFrame, fan_in: int = FAN_IN) -> np.ndarray | None:
    """The sum of the vectors of all tasks, one row of ``partial`` each, over a tree of tasks.

    Neither a task nor the driver holds more than about ``fan_in`` of them, and
    they are added in the order of their keys. None without rows.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _in_order(r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        if held is not None:
            yield partial(held)

    parts = rows.rdd.getNumPartitions()
    while parts > fan_in:
        parts = -(-parts // fan_in)
        rows = rows.repartition(parts, F.col("key") % parts).mapInArrow(add, PARTIAL)
    return _in_order(tuple(r) for r in rows.collect())


def _in_order(rows: Iterable[tuple[int, bytes]]) -> np.ndarray | None:
    held = None
    for _, v in sorted(rows):
        x = np.frombuffer(v, np.float64)
        held = x.copy() if held is None else held + x
    return held


def dealt_anew(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` partitioned by columns that no join key covers.

    A join whose input is already partitioned by its key gets no exchange there,
    and adaptive execution then can't split a hot key of the other side.
    """
    return df.repartition(*cols)


def boxed(df: DataFrame, name: str = "row") -> DataFrame:
    """The whole row as one struct, so that columns added beside it clash with none of its own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def unboxed(columns: list[str], name: str = "row") -> list[Column]:
    """The columns of a boxed row."""
    return [F.col(f"{name}.`{c}`").alias(c) for c in columns]


def keep_rows(df: DataFrame, columns: list[str], keep: Callable[..., list[bool] | np.ndarray]) -> DataFrame:
    """The rows of ``df``, all columns, for which ``keep`` is true.

    ``keep`` gets a batch's values of each of ``columns`` as an Arrow array, null
    for a column that isn't there. Columns pass by position, whatever their names.
    """
    small_batches(df.sparkSession)
    places = [df.columns.index(c) if c in df.columns else None for c in columns]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [pa.nulls(batch.num_rows) if i is None else batch.column(i) for i in places]
            yield batch.filter(pa.array(keep(*values), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", files: int | None = None) -> DataFrame:
    """Connected components of an undirected graph: rows (node, component).

    ``edges`` has two long columns. The component is its smallest node; nodes
    without an edge to another node are not returned. Alternates the large-star
    and small-star steps of Kiveris et al. (2014): every step is a grouped
    minimum, whose partial sums make hub nodes cheap, and an equi-join that
    adaptive execution can split, so a component may hold any share of the rows.
    Each round is checkpointed, in as many files as its edges need, of which no
    round has more than the one before; the first in ``files``, if given. Nothing
    but one fingerprint of the edge set reaches the driver.
    """
    spark = edges.sparkSession
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v")
        .distinct()
    )
    e, before = _settled(e.coalesce(files) if files else e)
    while before[0]:
        sym = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(dealt_anew(low, "m", "u"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = dealt_anew(large, "v", "u").join(dealt_anew(low, "m", "u"), "u")
        small = (
            pairs.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p"))
            .select("p.u", "p.v")
            .where("u <> v")
            .distinct()
        )
        e, after = _settled(small.coalesce(files_for(spark, before[0])))
        if after == before:
            break
        before = after
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _settled(e: DataFrame) -> tuple[DataFrame, tuple]:
    e = cut_lineage(e)
    # Exact and order-free: equal sums of two independent hashes and equal counts.
    row = e.agg(
        F.count(F.lit(1)),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
        F.sum(F.xxhash64("v", "u", F.lit(1)).cast("decimal(38,0)")),
    ).first()
    return e, tuple(row)
