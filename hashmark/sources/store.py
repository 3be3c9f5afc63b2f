"""Reading and writing: tolerant JSON lines, partitioned writes, upserts, versioned publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashmark.session import hadoop_path


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with header and declared types."""
    return spark.read.csv(path, schema=schema, header=True)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Records that parse, and the lines that don't."""
    known = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", known, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")
    return lines.where("_corrupt IS NULL").drop("_corrupt"), lines.where("_corrupt IS NOT NULL").select("_corrupt")


def write_partitions(df: DataFrame, path: str, by: list[str], whole: bool = False) -> None:
    """Replace only the partitions that ``df`` holds; rows sorted by the partition columns, one file a partition and task.

    With ``whole``, ``df`` is all there is: partitions it doesn't hold are removed afterwards, so that a reader never
    misses rows that stay.
    """
    df.repartition(*by).sortWithinPartitions(*by).write.partitionBy(*by).option("compression", "zstd").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    if whole:
        spark = df.sparkSession
        stored = spark.read.parquet(path).select(*by).distinct()
        on = [F.col(f"a.{c}").cast("string").eqNullSafe(F.col(f"b.{c}").cast("string")) for c in by]
        gone = stored.alias("a").join(df.select(*by).distinct().alias("b"), on, "left_anti")
        for r in gone.toLocalIterator():  # partitions, never rows
            remove_partition(spark, path, {c: r[c] for c in by})


def remove_partition(spark: SparkSession, path: str, values: dict) -> None:
    """Delete one partition's folder."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    null = "__HIVE_DEFAULT_PARTITION__"
    where, files = hadoop_path(spark, "/".join([path, *(f"{c}={null if v is None else escape(str(v))}" for c, v in values.items())]))
    files.delete(where, True)


def read_partitions(spark: SparkSession, path: str, *keep: str) -> DataFrame:
    """The whole partitioned table, or only the files under the sub-paths ``keep`` with their partition columns still there."""
    return spark.read.option("basePath", path).parquet(*[f"{path}/{k}" for k in keep] or [path])


def append_lines(df: DataFrame, path: str) -> None:
    """Append rows to a log of JSON lines; nulls are written, so that a later reader sees every field."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Stored and new rows, one a key: the greatest version, the new row where versions are equal."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    first = Window.partitionBy(*keys).orderBy(F.col(version).desc_nulls_last(), F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_new")


def publish(df: DataFrame, root: str, version: str) -> str:
    """Write a version beside the live one and then point to it in one rename; readers keep what they have open."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{root}/v={version}")
    jvm = spark._jvm
    pointer, files = hadoop_path(spark, f"{root}/CURRENT")
    draft = pointer.suffix(".next")
    out = files.create(draft, True)
    try:
        out.write(bytearray(f"v={version}".encode()))
    finally:
        out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(files.makeQualified(draft), files.makeQualified(pointer), over)
    return f"{root}/v={version}"


def current(spark: SparkSession, root: str) -> DataFrame:
    """The published version."""
    return spark.read.parquet(f"{root}/" + spark.read.text(f"{root}/CURRENT").first().value.strip())


def row_hash(columns: list[str]) -> Column:
    """A hash of a row that sums without overflow; null and the text of any value differ."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c).cast("string"))]
    return F.xxhash64(*parts).cast("decimal(38,0)")


def content_hash(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """One row (one for each value of ``by``): the number of rows and an order-insensitive sum of their hashes, folded on the executors.

    Repeated rows count each time, so a table isn't taken for one that lacks or repeats some of its rows.
    """
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(row_hash(columns)).alias("h"))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name``, ``n_rows``, ``h``: what tables hold, to be stored and verified later."""
    each = [content_hash(df, sorted(df.columns)).select(F.lit(name).alias("table_name"), "n_rows", "h") for name, df in tables.items()]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


def drifted(noted: DataFrame, now: DataFrame) -> DataFrame:
    """``table_name``, ``state``: tables added, removed or changed since the manifest ``noted``."""
    return changed_partitions(noted, now, "table_name")


def rebuild_plan(noted: DataFrame | None, now: DataFrame, by: str, same_code: bool) -> tuple[str, str]:
    """Whether a build has to be ``full`` or may be ``incremental`` (or is not needed: ``none``), and why.

    ``noted`` and ``now`` are content hashes by partition (``by``, ``h``); no record, other code and a partition that is gone ask for a full build.
    """
    if noted is None:
        return "full", "no record of a build"
    if not same_code:
        return "full", "the code changed"
    states = {r.state: r.n for r in changed_partitions(noted, now, by).groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    if states.get("removed"):
        return "full", f"{states['removed']} partitions are gone"
    return ("incremental", f"{sum(states.values())} partitions are new or changed") if states else ("none", "nothing changed")


def changed_partitions(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """Partitions added, removed or changed between two states of content hashes (``by``, ``h``); a null ``by`` is a partition too."""
    a, b = before.select(F.col(by).alias("_by"), "h", F.lit(True).alias("there")).alias("a"), after.select(F.col(by).alias("_by"), "h", F.lit(True).alias("there")).alias("b")
    joined = a.join(b, F.col("a._by").eqNullSafe(F.col("b._by")), "full_outer")
    state = F.when(F.col("a.there").isNull(), "added").when(F.col("b.there").isNull(), "removed").when(F.col("a.h") != F.col("b.h"), "changed")
    return joined.select(F.coalesce("a._by", "b._by").alias(by), state.alias("state")).where("state IS NOT NULL")
