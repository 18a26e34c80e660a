"""Helpers shared by the training-data operators: scratch tables, components, word blocks."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Used only where the session names no shared folder (tests on one machine).
FALLBACK_DIR = "/tmp/relscope-checkpoints"

#: A-Z to a-z on UTF-8 bytes; other bytes stay.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


#: Rows of texts that Python workers get at once: texts are long, and a batch is held several times over. Bytes of a batch
#: where many steps follow each other in one session: an executor keeps what its largest batches have taken.
TEXT_ROWS, BATCH_BYTES = 1000, 1 << 20


def in_small_batches(spark: SparkSession, most_bytes: int | None = None) -> None:
    """Let Python workers of this session take texts in batches of TEXT_ROWS rows, which bounds their memory.

    A batch ends as well with the row that reaches most_bytes, if given; every row comes, whatever its length.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    if most_bytes:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{most_bytes}b")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the folder; tables of texts go to Python in small batches."""
    if table in ("documents", "pages"):
        in_small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A DataFrame of a few rows of the driver.

    createDataFrame of a list makes an RDD that Python workers of its own recode on every executor, beside those that run
    functions on columns; their memory comes on top. An Arrow table needs none.
    """
    kinds = StructType.fromDDL(schema)
    fields = to_arrow_schema(kinds)
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields), kinds)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session, else the context's checkpoint folder.

    A session without either gets a folder of this machine if it runs on this machine alone; on a cluster that raises.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        got = jvm_dir.get() if jvm_dir.isDefined() else None
    if not got and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (got or FALLBACK_DIR).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/relscope-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back, which cuts its lineage.

    The table outlives the loss of any executor. Returns the new frame and its path.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a table that `saved` wrote and nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables of one operator in the shared folder; when the block ends all are deleted but those that were kept.

    with Scratch(spark) as scratch:
        rows = scratch.save(rows, "rows")
        return scratch.keep(result, "result")
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for name in list(self.paths):
            self.drop(name)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back; a table of the same name from before goes once the new one is written."""
        out, path = saved(df, name)
        self.drop(name)
        self.paths[name] = path
        return out

    def drop(self, name: str) -> None:
        if name in self.paths:
            dropped(self.spark, self.paths.pop(name))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as a table that outlives the block; whoever owns the shared folder clears it."""
        return saved(df, name)[0]


#: A side up to this many bytes is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def small(df: DataFrame, size: int) -> DataFrame:
    """df with a broadcast hint if its measured size in bytes is within the bound, else df as it is."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def word_blocks(data: bytes, size: int = 1 << 20):
    """Lists of the words of data (split at \\x20 and \\x09-\\x0D), block by block of about `size` bytes.

    The whole text is covered; a block only ends at white space, so memory stays bounded for long texts.
    """
    at, n = 0, len(data)
    while n - at > size:
        cut = at + size
        while cut < n and data[cut] not in b" \t\n\x0b\x0c\r":
            cut += 1
        yield data[at:cut].split()
        at = cut
    yield data[at:].split()


def components(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """Connected components of an undirected edge list: (node, component), component = smallest node.

    Min-label propagation with pointer jumping: each round takes the least label of a node's neighbours, then the
    label's own label, so a chain of length n settles in about log n rounds. Every step is a join or an aggregate
    with map-side combine; labels are written to the shared folder each round. Nodes without an edge don't appear.
    An empty edge list gives an empty table; edges with a null end are left out. The labels go with scratch, if given.
    """
    spark = edges.sparkSession
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a)))
    both, edge_path = saved(both.where("x <> y").distinct(), "edges")
    labels, path = saved(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("x")).alias("component")), "labels")
    total = None
    while True:
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now is None or now == total:
            break
        total = now
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("near"))
        best = labels.join(near, "node", "left").select("node", F.least("component", "near").alias("l"))
        jump = labels.select(F.col("node").alias("l"), F.col("component").alias("up"))
        step = best.join(jump, "l", "left").select("node", F.least("l", "up").alias("component"))
        labels, newer = saved(step, "labels")
        dropped(spark, path)
        path = newer
    dropped(spark, edge_path)
    if scratch is not None:
        scratch.paths[path] = path
    return labels


def in_share(order: Column, share: float | Column) -> Column:
    """Whether a hash (a long) falls in the lowest share (a number or a column) of all hashes.

    Put before orderBy(hash).limit(n): without it every task would send n rows to the one that merges them.
    """
    most = F.least(F.lit(1.0), share) * float(2**53) if isinstance(share, Column) else F.lit(min(1.0, share) * 2**53)
    return F.shiftrightunsigned(order.bitwiseXOR(F.lit(-(1 << 63))), 11) < most.cast("long")


def ranked(rows: DataFrame, group: str, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """rows with `idx`: the place, from 0, of a row among those of its group by order; written as a table of scratch.

    The rows are dealt into ranges of (group, order) and sorted there, so no group meets in one task; a range's rows are
    numbered as they come, and a group's offset in a range is the sum of its rows in earlier ranges (a row a range and group).
    Rows that are equal in group and order come in any order, and in different ranges where there are many of them.
    group and order must not be null.
    """
    by = [group, *order, "__salt"]
    dealt = rows.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*by).sortWithinPartitions(*by).drop("__salt")
    dealt = dealt.withColumn("__place", F.monotonically_increasing_id())
    part, pos = F.shiftrightunsigned("__place", 33), F.col("__place").bitwiseAND((1 << 33) - 1)
    dealt = scratch.save(dealt.withColumn("__part", part).withColumn("__pos", pos).drop("__place"), name)
    pieces = scratch.save(dealt.groupBy("__part", group).agg(F.min("__pos").alias("__from"), F.count("*").alias("__n")), f"{name}-pieces")
    earlier = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size = pieces.agg(F.count("*"), F.sum(F.octet_length(F.col(group).cast("string")))).first()
    starts = small(pieces.select("__part", group, (earlier - F.col("__from")).alias("__shift")), size[0] * 40 + (size[1] or 0))
    return dealt.join(starts, ["__part", group]).withColumn("idx", F.col("__pos") + F.col("__shift")).drop("__part", "__pos", "__shift")
