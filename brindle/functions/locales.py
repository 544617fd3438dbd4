"""Language preferences: best match, fallback chain, options and migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

# Preferences that mean the system's language, and older names of languages.
AUTO = ("", "auto")
ALIASES = {"hinglish": "en-IN", "gujlish": "en-IN"}


def preference(code: Column) -> Column:
    """Trimmed; empty or null is auto."""
    return F.coalesce(F.nullif(strip(code), F.lit("")), F.lit("auto"))


def language(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, "^[A-Za-z]{2,8}", 0))


def best_match(tag: Column, supported: Column) -> Column:
    """The tag itself if supported, else the first supported tag of its language, else null."""
    alike = F.filter(supported, lambda x: (language(tag) != "") & (language(x) == language(tag)))
    return F.when(F.array_contains(supported, tag), tag).otherwise(F.get(alike, F.lit(0)))


def resolve(code: Column, system: Column, supported: Column) -> Column:
    """Auto: the system's match, US English, any English, the first.  Else the match of the tag or its alias; null if there is none."""
    key = F.lower(strip(code))
    asked = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair]), key), strip(code))
    fallback = F.coalesce(best_match(system, supported), best_match(F.lit("en-US"), supported), F.get(supported, F.lit(0)))
    return F.when(key.isin(*AUTO), fallback).otherwise(best_match(asked, supported))


def installed(codes: DataFrame, tags: DataFrame) -> DataFrame:
    """codes (tag, ...) with installed: whether tags (tag) holds it."""
    held = tags.select("tag").distinct().withColumn("installed", F.lit(True))
    return codes.join(held, "tag", "left").withColumn("installed", F.coalesce("installed", F.lit(False)))


def options(locales: DataFrame) -> DataFrame:
    """(place, code, name): the automatic choice, then locales (code, name) by name whatever its case; a short list by nature."""
    first = locales.sparkSession.createDataFrame([("auto", "Auto (System Language)")], "code string, name string")
    rows = locales.select("code", "name").distinct().agg(F.array_sort(F.collect_list(F.struct(F.lower("name").alias("k"), "name", "code"))).alias("all"))
    listed = rows.select(F.posexplode("all").alias("place", "x")).select((F.col("place") + 1).alias("place"), "x.code", "x.name")
    return first.select(F.lit(0).alias("place"), "code", "name").unionByName(listed)


def migrated(stored: Column, options_: Column, resolved: Column) -> Column:
    """A stored code that is no option any more becomes the resolved tag, else auto."""
    return F.when(F.array_contains(options_, stored), stored).otherwise(F.coalesce(resolved, F.lit("auto")))
