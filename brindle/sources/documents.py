"""Sources and sinks: the driver's tables, vocabulary and case documents as JSON, releases, data URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "id string, term string, source string, status string, isEnabled boolean, observationCount int, starred boolean, usageCount int, createdAt timestamp, updatedAt timestamp"
DOCUMENT = f"version int, exportedAt timestamp, entries array<struct<{ENTRY}>>, exactCorrections string"
RELEASE = "tag_name string, name string, body string, html_url string, published_at string, assets array<struct<name: string, browser_download_url: string, size: bigint>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_document(entries: DataFrame, version: int = 1, corrections: str = "", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, document): one JSON document of all entries of each `by` in order of their terms, keys sorted."""
    cols = sorted(c for c in entries.columns if c not in by)
    rows = F.array_sort(F.collect_list(F.struct("term", F.struct(*cols).alias("e"))))
    return entries.groupBy(*by).agg(F.to_json(F.struct(F.transform(rows, lambda x: x.e).alias("entries"), F.lit(corrections).alias("exactCorrections"), F.lit(version).alias("version"))).alias("document"))


def read_vocabulary(documents: DataFrame, column: str = "document", version: str = "version", strict: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Entries (after `by`) of JSON documents; old entries have no star and no usage.  Not strict: a document that fails is empty."""
    parsed = documents.select(*by, F.from_json(column, DOCUMENT.replace("version", version, 1), {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("d"))
    rows = parsed.where(f"d.{version} is not null").select(*by, F.explode(F.coalesce("d.entries", F.array().cast(f"array<struct<{ENTRY}>>"))).alias("e")).select(*by, "e.*")
    return rows.withColumns({"starred": F.coalesce("starred", F.lit(False)), "usageCount": F.coalesce("usageCount", F.lit(0))})


def read_releases(manifest: DataFrame, column: str = "document") -> DataFrame:
    """Releases of a manifest of schema_version 1."""
    parsed = manifest.select(F.from_json(column, f"schema_version int, releases array<struct<{RELEASE}>>").alias("m")).where("m.schema_version = 1")
    return parsed.select(F.explode("m.releases").alias("r")).select("r.*")


def case_document(row: list[str], optional: list[str]) -> Column:
    """A JSON case of a history row: nulls are empty, optional keys are left out when null."""
    return F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in row], *[F.col(c) for c in optional]))


def data_url_bytes(url: Column) -> Column:
    """Bytes after the last comma, ignoring other characters; null without a comma."""
    return F.when(url.contains(","), F.unbase64(F.regexp_replace(F.substring_index(url, ",", -1), "[^A-Za-z0-9+/=]", "")))


def file_timestamp(ts: Column) -> Column:
    return F.replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(":"), F.lit("-"))
