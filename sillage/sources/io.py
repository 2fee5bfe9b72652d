"""Reading and writing: tables that may be missing, globs, dimensions, reports, snapshots, retention."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillage.schema import conform


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or a glob, has anything, in whatever store it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def load(spark: SparkSession, path: str, ddl: str, view: str | None = None) -> DataFrame:
    """A Parquet table in a given schema; an empty one if there is none. Registered under `view` if given."""
    df = conform(spark.read.parquet(path), ddl) if exists(spark, path) else spark.createDataFrame([], ddl)
    if view:
        df.createOrReplaceTempView(view)
    return df


def combine(spark: SparkSession, bronze: str, kind: str, ddl: str) -> DataFrame:
    """All tables *_<kind>.parquet of a folder by column name, missing columns null."""
    glob = f"{bronze}/*_{kind}.parquet"
    if not exists(spark, glob):
        return spark.createDataFrame([], ddl)
    return conform(spark.read.option("mergeSchema", True).parquet(glob), ddl)


def brand_tiers(spark: SparkSession, path: str) -> DataFrame:
    """brand, tier from {"tiers": {tier: [brand]}}; of a brand in several tiers, the first tier."""
    tiers = spark.read.option("multiLine", True).json(path).select(F.explode(F.from_json(F.to_json("tiers"), "map<string, array<string>>")).alias("tier", "brands"))
    return tiers.select("tier", F.explode("brands").alias("brand")).groupBy("brand").agg(F.min("tier").alias("tier"))


def category_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """group, category, synonym from {"mappings": {group: {category: [synonym]}}}."""
    raw = spark.read.option("multiLine", True).json(path).select(F.from_json(F.to_json("mappings"), "map<string, map<string, array<string>>>").alias("m"))
    groups = raw.select(F.explode("m").alias("group", "inner")).select("group", F.explode("inner").alias("category", "synonyms"))
    return groups.select("group", "category", F.explode("synonyms").alias("synonym"))


def _path(spark: SparkSession, path: str):
    """A path and the file system that it lies in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    """df in place of the table at path, or with `by` in place of the partitions that it has rows of; others stay. The
    rows are written aside first, so a write that fails leaves what was there; df may read the table itself."""
    spark = df.sparkSession
    if by:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
        return
    name = uuid.uuid4().hex
    fs, table = _path(spark, path)
    _, aside = _path(spark, f"{table.getParent()}/_new-{name}")
    _, old = _path(spark, f"{table.getParent()}/_old-{name}")
    try:
        df.write.parquet(aside.toString())
        had = fs.exists(table)
        if had and not fs.rename(table, old):
            raise OSError(f"{path} cannot be replaced")
        if not fs.rename(aside, table):
            if had:
                fs.rename(old, table)
            raise OSError(f"{path} cannot be written")
        fs.delete(old, True)
    finally:
        fs.delete(aside, True)


def commit(spark: SparkSession, path: str, run_id: str, told: dict) -> None:
    """Record that a run's write to a table is done: `_commits/<run_id>.json` beside its data, which readers of the table
    pass over. The file appears whole or not at all; a run commits once, again counts for nothing."""
    fs, target = _path(spark, f"{path}/_commits/{run_id}.json")
    if fs.exists(target):
        return
    _, draft = _path(spark, f"{path}/_commits/_{run_id}-{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps({"run_id": run_id, **told}, default=str).encode()))
    out.close()
    if not fs.rename(draft, target):
        fs.delete(draft, False)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, told): the runs that have been committed to a table, with what they told as JSON."""
    if not exists(spark, f"{path}/_commits/[!_]*.json"):
        return spark.createDataFrame([], "run_id string, told string")
    lines = spark.read.text(f"{path}/_commits/[!_]*.json", wholetext=True)
    return lines.select(F.get_json_object("value", "$.run_id").alias("run_id"), F.col("value").alias("told"))


def write_run(df: DataFrame, path: str, by: str, run_id: str) -> bool:
    """The partitions of df written to a table, and the run committed; False, and nothing written, if the run is there
    already. A run that failed before its commit is written again, to the same partitions: a rerun never doubles rows."""
    spark = df.sparkSession
    if exists(spark, f"{path}/_commits/{run_id}.json"):
        return False
    write_parquet(df, path, by)
    commit(spark, path, run_id, {"by": by, "columns": df.columns})
    return True


def expire_partitions(spark: SparkSession, path: str, by: str, before: str) -> list[str]:
    """Remove the partitions by=value of a table whose value, as text, comes before a bound (dates as yyyy-mm-dd); their
    values. A folder at a time, whatever number of files it has; a partition without a value stays."""
    fs, table = _path(spark, path)
    gone = []
    for found in fs.globStatus(_path(spark, f"{path}/{by}=*")[1]) or []:
        value = found.getPath().getName().split("=", 1)[1]
        if value != "__HIVE_DEFAULT_PARTITION__" and value < before:
            fs.delete(found.getPath(), True)
            gone.append(value)
    return sorted(gone)


def write_csv(df: DataFrame, path: str) -> None:
    """For small reports: one file with a header; arrays joined by "|"."""
    flat = [F.array_join(c, "|").alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes]
    df.select(*flat).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def report(row: dict, path: str) -> None:
    """A report object as a local JSON file of the driver."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(row, indent=2, default=str))


def summary(title: str, rows: dict) -> str:
    """A report object as Markdown."""
    return "\n".join([f"# {title}", "", "| field | value |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in rows.items()), ""])


def snapshots(pages: DataFrame) -> DataFrame:
    """Pages keyed by a digest of their URL and named by its first eight digits."""
    digest = F.sha2("url", 256)
    return pages.select(digest.alias("url_hash"), F.concat(F.lit("page_"), F.substring(digest, 1, 8), F.lit(".html")).alias("name"), "url", "html")


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """Counts of Parquet files and manifests below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime")
    return files.agg(F.count_if(F.col("path").endswith(".parquet")).alias("parquet"), F.count_if(F.col("path").rlike(r"manifest[^/]*\.json$")).alias("manifests"))


def expired(spark: SparkSession, path: str, as_of: str, days: int) -> DataFrame:
    """Files below a folder that are older than some days: what retention would delete."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime")
    return files.where(F.col("modificationTime") < F.date_sub(F.lit(as_of).cast("date"), days))


def remove_expired(spark: SparkSession, path: str, as_of: str, days: int) -> int:
    """Removes the files that expired() lists, in whatever store they lie; gives their number. For folders without
    partitions; tables lose whole partitions by expire_partitions(). Names alone come to the driver, a partition at a
    time; files gone by then count as removed."""
    old = expired(spark, path, as_of, days).select("path").cache()
    n = 0
    for row in old.toLocalIterator():
        fs, p = _path(spark, row["path"])
        fs.delete(p, False)
        n += 1
    old.unpersist()
    return n
