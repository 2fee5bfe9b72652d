"""What the operators share: tables, written cuts of the lineage, components of a link table."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sillage.sources.shared import shared_dir

#: A word, as the contracts have it: a run without the six ASCII white-space characters.
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table as read, dealt out to all cores where its files give fewer partitions than those: work on whole texts
    is worth a shuffle of a small table. Large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: What holds while a cut is written. Spark removes a query's shuffle files as soon as the query has ended; rows go to
#: Python in batches that stay small where texts are long.
_WHILE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and reread: later stages, and retries of them, start from the files, so the
    shuffle files that led to them can go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    was = {k: spark.conf.get(k, None) for k in _WHILE}
    try:
        for k, v in _WHILE.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path  # for drop_cut()
    if (scope := _SCOPE.get()) is not None:
        scope.append(out)
    return out


#: The cuts that the innermost scratch() of this thread, or task of an event loop, has made.
_SCOPE: ContextVar[list[DataFrame] | None] = ContextVar("cuts", default=None)


def scratch(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f with its result cut and all other cuts made on the way removed."""

    @wraps(f)
    def run(*args, **named) -> DataFrame:
        made: list[DataFrame] = []
        outer = _SCOPE.set(made)
        try:
            out = cut(f(*args, **named))
        finally:
            _SCOPE.reset(outer)
        drop_cut(*(x for x in made if x is not out))
        if (scope := _SCOPE.get()) is not None:
            scope.append(out)
        return out

    return run


def drop_cut(*cuts: DataFrame) -> None:
    """Remove the files of cut()s that nothing reads any more."""
    for df in cuts:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def few(df: DataFrame, rows: int) -> DataFrame:
    """A written table, marked for broadcast if it has no more than `rows` rows; beyond that joins shuffle it."""
    return F.broadcast(df) if df.count() <= rows else df


def _state(df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b): one row (id, comp) per linked node, comp its smallest id.

    Alternating large-star and small-star rounds. Each round is two aggregations and two joins whose skewed keys
    adaptive execution splits; nothing but a count and a checksum comes to the driver, and each round is written
    to the shared folder, so a lost executor repeats one round at most.
    """
    now = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    )
    state = _state(now)
    while state[0]:
        both = now.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(
            now.select(F.col("u").alias("x"), F.col("v").alias("y"))
        )
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(low, "v")
            .where("u <> m")
            .select(F.col("u").alias("v"), F.col("m").alias("u"))
            .unionByName(low.select("v", F.col("m").alias("u")))
            .distinct()
        )
        new = cut(small)
        new_state = _state(new)
        drop_cut(now)
        now, (state, was) = new, (new_state, state)
        if state == was:
            break
    roots = now.select(F.col("u").alias("id"), F.col("u").alias("comp")).distinct()
    return now.select(F.col("v").alias("id"), F.col("u").alias("comp")).unionByName(roots)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_RE), F.lit(0))
