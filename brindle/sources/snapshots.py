"""Stored vocabularies: blobs of JSON that may be old or broken, and versioned snapshots of them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .documents import ENTRY

# What an entry must have; stars and uses came later.  The sources and states that it may name.
REQUIRED = ("id", "term", "source", "status", "isEnabled", "observationCount", "createdAt", "updatedAt")
SOURCES, STATES = ("manual", "learned"), ("active", "suggested", "rejected")


def stored_entries(blob: Column) -> Column:
    """Entries of a stored blob (a JSON array); null where it does not decode: one bad entry spoils the whole, as a blob is read whole or not at all.

    Entries without star or uses are old ones: no star, no uses.  A blob that is null has none, without being broken.
    """
    fields = StructType.fromDDL(ENTRY).names
    raw = F.from_json(F.concat(F.lit('{"entries":'), blob, F.lit("}")), f"entries array<struct<{ENTRY}>>, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    lacks = lambda e: F.exists(F.array(*[e[c].isNull() for c in REQUIRED]), lambda x: x) | ~e.source.isin(*SOURCES) | ~e.status.isin(*STATES)
    fine = raw.broken.isNull() & raw.entries.isNotNull() & ~F.coalesce(F.exists(raw.entries, lambda e: e.isNull() | lacks(e)), F.lit(False))
    default = {"starred": F.lit(False), "usageCount": F.lit(0)}
    whole = F.transform(raw.entries, lambda e: F.struct(*[(F.coalesce(e[c], default[c]) if c in default else e[c]).alias(c) for c in fields]))
    return F.when(blob.isNull(), F.array().cast(f"array<struct<{ENTRY}>>")).when(fine, whole)


def read_stored(blobs: DataFrame, column: str = "blob") -> DataFrame:
    """blobs with entries and broken: a broken blob has no entries, and the others are read all the same."""
    found = blobs.withColumn("entries", stored_entries(F.col(column)))
    return found.withColumns({"broken": F.col("entries").isNull(), "entries": F.coalesce("entries", F.array())})


def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def write_snapshot(df: DataFrame, path: str) -> str:
    """Write df as a new version under path, and only then make it the current one; its name.

    The pointer is written beside and renamed over the old one, so readers find one whole version or the other; a job that
    dies before leaves the old one current.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{path}/versions/{version}")
    beside, fs = _file(spark, f"{path}/CURRENT-{version}")
    out = fs.create(beside, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri() if beside.toUri().getScheme() else fs.getUri(), spark._jsparkSession.sessionState().newHadoopConf())
    overwrite = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(beside), fs.makeQualified(_file(spark, f"{path}/CURRENT")[0]), overwrite)
    return version


def read_snapshot(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The current version; an empty table of the schema, if one is given, where there is none."""
    current, fs = _file(spark, f"{path}/CURRENT")
    if not fs.exists(current):
        if schema is None:
            raise FileNotFoundError(f"{path} has no current version")
        return spark.createDataFrame([], schema)
    version = spark.read.text(f"{path}/CURRENT").first()[0]
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{path}/versions/{version}")
