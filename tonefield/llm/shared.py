"""What the corpus operators share: tables in the shared folder, the learning split, graph components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of every contract here, as the inside of a character class.
SPACE = r"\x20\x09-\x0D"


#: Texts that are Python strings at once in a task, that a worker is handed at once, and rows of a few numbers.
TEXTS, TEXT_ROWS, NUMBER_ROWS = 256, 512, 10_000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver see: spark.checkpoint.dir; a new local one serves on one machine only."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tonefield-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: lineage ends here and lost executors take nothing with them."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spark_type(t: pa.DataType) -> T.DataType:
    if pa.types.is_list(t):
        return T.ArrayType(spark_type(t.value_type))
    if pa.types.is_struct(t):
        return T.StructType([T.StructField(f.name, spark_type(f.type)) for f in t])
    plain = {pa.int32(): T.IntegerType(), pa.int64(): T.LongType(), pa.float64(): T.DoubleType(), pa.bool_(): T.BooleanType(), pa.string(): T.StringType(), pa.binary(): T.BinaryType()}
    return plain[t]


def with_texts(df: DataFrame, keep: list[str], of: Callable[[list[str | None]], dict], more: dict[str, pa.DataType], text: str = "text") -> DataFrame:
    """The columns `keep` of df beside the columns `more` that `of` makes of the texts, at most TEXTS at a time.

    Kept columns pass as they came, as Arrow arrays: no null among ids turns whole numbers into rounded ones.
    """
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in keep] + [T.StructField(c, spark_type(t)) for c, t in more.items()])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                made = of(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(made[c], t) for c, t in more.items())], [*keep, *more])
        pa.default_memory_pool().release_unused()

    return of_texts(df).select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(mapped, schema)


@contextmanager
def batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within this, what is run hands Python workers at most so many rows at once: few of many bytes, many of few."""
    was = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, was)


def of_texts(docs: DataFrame) -> DataFrame:
    """docs, whose texts are to go through Python workers: the session hands over TEXT_ROWS at a time from now on.

    Spark counts rows, not bytes, and thousands of long texts at once, in the executor and in its workers, are more
    memory than they have.
    """
    conf = docs.sparkSession.conf
    if int(conf.get(BATCH)) > TEXT_ROWS:
        conf.set(BATCH, str(TEXT_ROWS))
    return docs


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that nothing may be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def text_mark(text: str = "text") -> Column:
    """Tells texts of one id apart, a null one too."""
    return F.xxhash64(F.coalesce(F.sha2(F.col(text).cast("binary"), 256), F.lit("null")))


def chosen(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that agree with one of kept (id, mark) in id and text_mark; of rows that agree in both, one."""
    kept = kept.select(F.col("id").alias("__id"), F.col("mark").alias("__of")).distinct()
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__of"))
    out = docs.withColumn("__mark", text_mark(text_col)).join(kept, same, "left_semi")
    ids = stored(out.select(F.col(id_col).alias("__id"), F.col("__mark").alias("__of")), "chosen")
    twice = stored(ids.groupBy("__id", "__of").count().where("count > 1").drop("count"), "twice")
    if twice.limit(1).count():
        out = out.join(twice, same, "left_anti").unionByName(out.join(twice, same, "left_semi").dropDuplicates([id_col, "__mark"]))
    return out.drop("__mark")


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows (a written table) with a number from 1 among the rows of equal keys, nulls being equal, in no given order.

    Numbers are given within each partition that is read, after the rows of the partitions before, so that no task
    gets all rows of a key.
    """
    rows = rows.withColumn("__rid", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__rid", 33))
    other = {k: f"__of_{i}" for i, k in enumerate(keys)}
    parts = rows.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*[F.col(k).alias(x) for k, x in other.items()], F.col("__part").alias("__of_part"), F.coalesce(before, F.lit(0)).alias("__before"))
    same = F.col("__part") == F.col("__of_part")
    for k, x in other.items():
        same = same & F.col(k).eqNullSafe(F.col(x))
    place = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy("__rid"))
    made = rows.withColumn("__place", place).join(parts, same).withColumn(name, F.col("__before") + F.col("__place"))
    drop = {"__rid", "__part", "__of_part", "__before", "__place", *other.values()} - {name}
    return made.drop(*drop)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b; longs) reaches.

    Alternates the large-star and small-star steps until no edge changes; each step is one shuffle of the
    edges that are left, and each round is a written table. A node with very many neighbours is reduced to
    its minimum by partial aggregation before the shuffle, and the join that follows is split by skew handling.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    for _ in range(max_rounds):
        # large star: every neighbour that is larger than the node is tied to the node's smallest neighbour
        both = now.union(now.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the node and its smaller neighbours are tied to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = stored(small, "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError("the components did not settle")
    # at the fixed point each node has one edge, to the root of its star
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
