"""Upserts that touch only the buckets a change falls into.

The state is a set of *generations*, each a bucketed table (rows of a bucket in one file, sorted by
key), and a manifest that names, for each version, the generation that holds each bucket:

    {path}/data/<generation>/     files of the buckets that this write has renewed
    {path}/manifest/              one row a bucket and version; the newest version is the state
    {path}/about/                 keys, number of buckets and columns

An upsert reads the buckets hit by the change and joins them with it as they lie: only the change is
shuffled.  It writes those buckets as a new generation and then a new version of the manifest, in one
file; readers see the old state until then.  So what is read and written follows the change,
and not the table.  Rows without a key are left out.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lowtide.operators.indicators import latest_per_key
from lowtide.session import written

BUCKETS = 64
MANIFEST = "version bigint, bucket int, generation string"
#: generations from which an upsert is followed by a compaction
MOST_GENERATIONS = 8


def bucket_of(keys: list[str], buckets: int) -> Column:
    """Number of the bucket that Spark's bucketed writer puts a key into."""
    return F.pmod(F.hash(*keys), F.lit(buckets)).cast("int")


def _about(spark: SparkSession, path: str) -> tuple[list[str], int, StructType]:
    row = json.loads(spark.read.text(f"{path}/about").first()["value"])
    return row["keys"], row["buckets"], StructType.fromJson(row["schema"])


def manifest(spark: SparkSession, path: str) -> dict[int, str]:
    """The generation of every bucket in the newest version: as many entries as there are buckets."""
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    newest = rows.groupBy("bucket").agg(F.max_by("generation", "version").alias("generation"))
    return {r["bucket"]: r["generation"] for r in newest.collect()}


def _publish(spark: SparkSession, path: str, changed: dict[int, str]) -> None:
    """A new version: every bucket with its generation."""
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").agg(F.max("version")).first()[0] if _exists(spark, path) else None
    version = (rows or 0) + 1
    full = (manifest(spark, path) if rows else {}) | changed
    table = spark.createDataFrame([(version, b, g) for b, g in sorted(full.items())], MANIFEST)
    table.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _write(rows: DataFrame, path: str, keys: list[str], buckets: int) -> str:
    """Rows (with ``_bucket``) as a new generation."""
    generation = f"g{uuid.uuid4().hex}"
    writer = rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{path}/data/{generation}")
    writer.format("parquet").saveAsTable(f"lowtide_{generation}")
    return generation


def _generation(spark: SparkSession, path: str, generation: str) -> DataFrame:
    """A generation as a bucketed table; another session attaches the files that are there."""
    name = f"lowtide_{generation}"
    if not spark.catalog.tableExists(name):
        keys, buckets, schema = _about(spark, path)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        by = ", ".join(f"`{k}`" for k in keys)
        spark.sql(
            f"CREATE TABLE {name} ({columns}, `_bucket` int) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) "
            f"INTO {buckets} BUCKETS LOCATION '{path}/data/{generation}'"
        )
    return spark.table(name)


def _parts(spark: SparkSession, path: str, wanted: set[int] | None = None) -> list[tuple[DataFrame, list[int]]]:
    """The state by generation: its rows and the buckets that it holds, of the wanted ones."""
    held: dict[str, list[int]] = {}
    for bucket, generation in manifest(spark, path).items():
        if wanted is None or bucket in wanted:
            held.setdefault(generation, []).append(bucket)
    return [(_generation(spark, path, g).filter(F.col("_bucket").isin(own)), own) for g, own in sorted(held.items())]


def create(df: DataFrame, path: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> None:
    """A bucketed table of the newest row per key."""
    spark = df.sparkSession
    about = json.dumps({"keys": keys, "buckets": buckets, "schema": json.loads(df.schema.json())})
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/about")
    rows = latest_per_key(df.dropna(subset=keys), keys, order).select(*df.columns)
    rows = rows.withColumn("_bucket", bucket_of(keys, buckets)).repartition(buckets, *keys)
    generation = _write(rows, path, keys, buckets)
    _publish(spark, path, dict.fromkeys(range(buckets), generation))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The state of the newest version."""
    parts = [rows.drop("_bucket") for rows, _ in _parts(spark, path)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def merged(state: DataFrame, changes: DataFrame, keys: list[str], guard: str | None = None) -> DataFrame:
    """State and change of the same buckets, both dealt out by key: the incoming row wins, with ``guard``
    only if its time is not older."""
    names = state.columns
    old = state.select(*keys, F.struct(*names).alias("_old"))
    new = changes.select(*keys, F.struct(*names).alias("_new"))
    joined = old.join(new, keys, "full_outer")
    wins = F.col("_new").isNotNull()
    if guard is not None:
        older = F.col(f"_new.{guard}") < F.col(f"_old.{guard}")
        wins = wins & ~F.coalesce(older, F.col("_old").isNotNull() & F.col(f"_new.{guard}").isNull() & F.col(f"_old.{guard}").isNotNull())
    picked = F.when(wins, F.col("_new")).otherwise(F.col("_old"))
    return joined.select(picked.alias("_row")).select("_row.*")


def upsert(df: DataFrame, path: str, order: list[str], guard: str | None = None) -> list[int]:
    """Merge the newest row per key of ``df`` into the table; returns the buckets that were renewed.

    Without ``guard`` an incoming row replaces the stored one; with it only if ``guard`` is not older."""
    spark = df.sparkSession
    keys, buckets, schema = _about(spark, path)
    changes = latest_per_key(df.select(*schema.names).dropna(subset=keys), keys, order).select(*schema.names)
    changes = written(changes.withColumn("_bucket", bucket_of(keys, buckets)), "changes")
    hit = {r["_bucket"] for r in changes.select("_bucket").distinct().collect()}  # at most as many as buckets
    if not hit:
        return []
    renewed = None
    for state, own in _parts(spark, path, hit):
        news = changes.filter(F.col("_bucket").isin(own)).repartition(buckets, *keys)
        part = merged(state, news, keys, guard)
        renewed = part if renewed is None else renewed.unionByName(part)
    generation = _write(renewed, path, keys, buckets)
    _publish(spark, path, dict.fromkeys(hit, generation))
    if len(set(manifest(spark, path).values())) > MOST_GENERATIONS:
        compact(spark, path)
    return sorted(hit)


def compact(spark: SparkSession, path: str) -> None:
    """Bring all buckets into one generation; what older versions alone name may be deleted then."""
    keys, buckets, _ = _about(spark, path)
    rows = read(spark, path).withColumn("_bucket", bucket_of(keys, buckets)).repartition(buckets, *keys)
    _publish(spark, path, dict.fromkeys(range(buckets), _write(rows, path, keys, buckets)))
