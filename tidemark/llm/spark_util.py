"""Written intermediate tables, edge contraction and connected components."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset (tests), one below the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return found.rstrip("/")


#: Bytes of rows that are sent to a Python worker at once.
BATCH_BYTES = 4 << 20


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) with batches bounded in bytes, as rows may be whole books: Spark bounds them to 64 MB,
    several times over for each task. Sets spark.sql.execution.arrow.maxBytesPerBatch where it is larger."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (conf.get(name, None) or "").lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


#: Spark's switch for deleting an execution's shuffle files as soon as it ends (a stage that needs them again is run again).
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession):
    """Shuffle files of what is executed inside are deleted as soon as it ends. They would stay until the driver's garbage
    collector has run twice, that is through the next step, whose own files then come on top."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


#: How written tables reach a local disk. Hadoop's local file system starts three child processes for each file, to set the
#: permissions of its task's folder, of itself and of a checksum file; without the latter they are two. Each child is, until
#: it runs its program, one more process as large as the executor. Folders of other file systems ignore these settings.
LOCAL = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def in_few(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Neighbouring partitions together, one after the other in a task: an eighth of `partitions` (the shuffle partitions)
    but four a core at least."""
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, partitions // 8))


def materialize(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage ends there and lost executors cost nothing.

    few: neighbouring partitions are written together, for steps that hold no more of a partition than a batch; thousands
    of tiny files cost more than they carry.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if few:
        df = in_few(df)
    with swept(spark):
        df.write.options(compression="zstd", **LOCAL).parquet(path)
    spark._jvm.System.gc()  # shuffle files of other executions are cleaned once the driver drops their handles
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    for open_ in _scratch:
        open_.append(out)
    return out


_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch(keep: list[DataFrame]):
    """Deletes the tables that materialize() writes inside, but for those put into `keep`, once the block ends: results
    that read them must have been written by then."""
    made: list[DataFrame] = []
    _scratch.append(made)
    try:
        yield
    finally:
        _scratch.remove(made)
        kept = {t._tidemark_path for t in keep}
        for table in made:
            if table._tidemark_path not in kept:
                discard(table)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, whatever its columns are called: `name` with underscores added."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def discard(df: DataFrame) -> None:
    """Deletes what materialize() has written, once nothing reads it any more."""
    path = getattr(df, "_tidemark_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


class Sieve:
    """A set of 64-bit keys as a table of 2**`bits` bits, each key one bit: it may hold keys that aren't in the set, never
    lacks one that is. Its size is fixed (8 MB by default), however many keys there are, so it can be broadcast; with
    very many keys it lets everything through."""

    def __init__(self, keys: DataFrame, column: str, bits: int = 26):
        width = 4096  # bytes of one of Spark's bitmaps; they count from 1
        spot = F.pmod(F.col(column), F.lit(1 << bits)) + 1
        rows = keys.groupBy(F.bitmap_bucket_number(spot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits")).toArrow()
        table = np.zeros(max(width, (1 << bits) // 8), np.uint8)
        for bucket, found in zip(rows.column("bucket").to_pylist(), rows.column("bits").to_pylist(), strict=True):
            table[(bucket - 1) * width : bucket * width] = np.frombuffer(found, np.uint8)
        self.mask, self.table = (1 << bits) - 1, keys.sparkSession.sparkContext.broadcast(table)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        spot = keys & self.mask
        return (self.table.value[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1


def forest(a: np.ndarray, b: np.ndarray):
    """Union-find over edges: nodes and each one's smallest reachable node."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            up = new[new]
            if (up == new).all():
                break
            new = up
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contract(batches, most: int = 1 << 20):
    """Replaces the edges of a partition, block by block, by a star for each of its components."""
    parts, held = [], 0

    def stars():
        a, b = forest(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        return a[a != b], b[a != b]

    for batch in batches:
        parts.append(tuple(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b")))
        held += batch.num_rows
        if held > most:
            parts = [stars()]
            held = len(parts[0][0])
            most = max(most, 2 * held)
    if parts:
        a, b = stars()
        for at in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 100_000], pa.int64()), pa.array(b[at : at + 100_000], pa.int64())], names=["a", "b"])


def contracted(run):
    """The edges that `run` gives for a partition, as stars: in the same worker, where components() would need another."""
    return lambda batches: _contract(run(batches))


def components(edges: DataFrame, small: int = 200_000, contract: bool = True) -> DataFrame:
    """Connected components of edges (a long, b long): a row (node, component) for each node with an edge.

    The component is its smallest node. Each partition first contracts its edges to stars by union-find, unless they
    come `contracted`;
    then large-star and small-star rounds with a written table each run until nothing changes. Once no
    more than `small` edges are left, one task ends the work: a bounded size, not a collected graph.
    Rows with a null end and loops are left out; an empty input gives an empty result.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    edges = edges.transform(in_arrow, _contract, "a long, b long") if contract else edges
    now = materialize(edges.distinct(), "edges", few=True)
    for _ in range(60):
        count, check = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if count <= small:
            last = materialize(now.coalesce(1).transform(in_arrow, _contract, "a long, b long"), "edges")
            discard(now)
            now = last
            break
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        star = down.join(low, "a")
        new = star.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        new = materialize(new, "edges", few=True)
        same = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = new
        if tuple(same) == (count, check):
            break
    else:
        raise RuntimeError("connected components did not settle in 60 rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
