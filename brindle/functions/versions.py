"""Semantic versions and release decisions as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def semver(tag: Column) -> Column:
    """A struct that sorts like the version (major, minor, patch, release after prereleases, identifiers), or null.

    Build metadata after + is dropped first, so a - in it is no prerelease; empty dot parts of the core are dropped.
    """
    t = F.regexp_replace(strip(tag), "^[vV]", "")
    t = F.get(F.filter(F.split(t, r"\+", 2), lambda x: x != ""), F.lit(0))
    core, pre = F.substring_index(t, "-", 1), F.when(F.instr(t, "-") > 0, F.regexp_replace(t, "^[^-]*-", ""))
    numbers = F.transform(F.filter(F.split(core, r"\."), lambda x: x != ""), lambda x: F.when(x.rlike(r"^[+-]?\d+$"), x.try_cast("bigint")))
    parts = F.split(pre, r"\.", -1)
    fine = (F.size(numbers) == 3) & ~F.exists(numbers, lambda x: x.isNull()) & (pre.isNull() | ((pre != "") & ~F.exists(parts, lambda x: x == "")))
    number = lambda x: F.when(x.rlike(r"^[+-]?\d+$"), x.try_cast("bigint"))
    ids = F.transform(parts, lambda x: F.struct(F.when(number(x).isNull(), 1).otherwise(0).alias("alpha"), F.coalesce(number(x), F.lit(0)).alias("number"), F.when(number(x).isNull(), x).otherwise("").alias("text")))
    return F.when(fine, F.struct(F.get(numbers, F.lit(0)).alias("major"), F.get(numbers, F.lit(1)).alias("minor"), F.get(numbers, F.lit(2)).alias("patch"), pre.isNull().alias("release"), F.coalesce(ids, F.array().cast("array<struct<alpha:int,number:bigint,text:string>>")).alias("identifiers")))


def update_decision(latest: Column, current: Column, tag: Column, current_tag: Column, published: Column, now: Column, skipped: Column, manual: Column) -> Column:
    """none, wait or offer: the ladder over a known version, same tag, order, an age of three days and a skipped tag."""
    young = published > now - F.expr("interval 3 days")
    return F.when(latest.isNull(), "none").when(tag.eqNullSafe(current_tag), "none").when(latest <= current, "none").when(young & ~manual, "wait").when(tag.eqNullSafe(skipped) & ~manual, "none").otherwise("offer")


def release_notes(releases, current: Column):
    """One row: bodies of releases (tag, body) after current, newest first, joined by a blank line; null if none."""
    later = releases.withColumn("v", semver(F.col("tag"))).where((F.col("v") > current) & (F.trim("body") != ""))
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("v", "tag", "body"))))
    return later.agg(F.nullif(F.array_join(F.transform(ordered, lambda x: F.trim(x.body)), "\n\n"), F.lit("")).alias("notes"))


def display(tag: Column) -> Column:
    """The version as shown: trimmed, without a leading v."""
    return F.regexp_replace(strip(tag), "^[vV]", "")


def published(value: Column) -> Column:
    """An ISO instant, with or without a fraction of a second; null for anything else."""
    fine = value.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})\z")
    return F.when(fine, F.try_to_timestamp(F.regexp_replace(value, r"([+-]\d{2})(\d{2})\z", "$1:$2")))


def display_date(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, yyyy")


def reset_time(epoch: Column) -> Column:
    """The short time of a rate limit's reset, from its header; null if that is no number."""
    return F.date_format(F.timestamp_seconds(epoch.try_cast("double")), "h:mm a")


def should_check(enabled: Column, last: Column, now: Column) -> Column:
    return enabled & (last.isNull() | (now - last > F.expr("interval 7 days")))


def should_remind(available: Column, idle: Column, tag: Column, skipped: Column, reminded: Column, at: Column, now: Column) -> Column:
    """Not for a skipped version, nor within a day of a reminder of the same one."""
    fresh = ~reminded.eqNullSafe(tag) | at.isNull() | (now - at > F.expr("interval 24 hours"))
    return F.coalesce(available & idle & tag.isNotNull() & ~skipped.eqNullSafe(tag) & fresh, F.lit(False))


def candidates(releases):
    """releases (tag, published_at, ...) whose tag and date can be read, with version and published."""
    return releases.withColumns({"version": semver(F.col("tag")), "published": published(F.col("published_at"))}).where("version is not null and published is not null")


def latest(releases, by: list[str]):
    """Of each group the release of the highest version, of equal ones the latest published, then the largest tag."""
    best = candidates(releases).groupBy(*by).agg(F.max(F.struct("version", "published", "tag", "body")).alias("r"))
    return best.select(*by, "r.tag", "r.published", "r.body")


def with_notes(latest_releases, releases, current: Column, by: list[str]):
    """latest_releases (by, tag, body) with the notes of all releases after current, where there are any."""
    later = releases.withColumn("v", semver(F.col("tag"))).where((F.col("v") > current) & (F.trim("body") != ""))
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("v", "tag", F.trim("body").alias("body")))))
    notes = later.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x.body), "\n\n").alias("_notes"))
    return latest_releases.join(notes, by, "left").withColumn("body", F.coalesce("_notes", "body")).drop("_notes")


def either_source(manifest, api):
    """The manifest's releases; those of the other source where the manifest has none."""
    return manifest.unionByName(api.join(manifest.select(F.lit(1).alias("_one")).limit(1), F.lit(True), "left_anti"))


def last_page(count: Column, size: int = 100) -> Column:
    return F.greatest(F.ceil(count / size), F.lit(1))


def is_stale(fetched: Column, now: Column, seconds: int = 300) -> Column:
    return fetched.isNull() | (F.unix_micros(now.cast("timestamp")) - F.unix_micros(fetched.cast("timestamp")) >= seconds * 1_000_000)


def note_lines(text: Column) -> Column:
    """struct(kind, text) of each line of release notes: subheading, heading, bullet or body."""

    def line(raw: Column) -> Column:
        t = F.trim(F.replace(raw, F.lit("\t"), F.lit(" ")))
        kind = F.when(t.startswith("### "), "subheading").when(t.startswith("## "), "heading").when(t.startswith("- "), "bullet").otherwise("body")
        shown = F.when(kind == "subheading", F.substr(t, F.lit(5))).when(kind == "heading", F.substr(t, F.lit(4))).when(kind == "bullet", F.concat(F.lit("• "), F.substr(t, F.lit(3)))).otherwise(raw)
        return F.struct(kind.alias("kind"), shown.alias("text"))

    return F.transform(F.split(text, r"\r\n|\n|\r"), line)


def bold_runs(line: Column) -> Column:
    """struct(text, bold) of a line's runs: text between pairs of ** is bold, an unpaired ** is text."""
    parts = F.split(line, r"\*\*")
    n = F.size(parts)
    # with an odd number of marks the last one is text: the last two parts belong together
    whole = F.when(n % 2 == 1, parts).otherwise(F.array_append(F.slice(parts, 1, n - 2), F.concat_ws("**", F.get(parts, n - 2), F.get(parts, n - 1))))
    runs = F.transform(whole, lambda x, i: F.struct(x.alias("text"), (i % 2 == 1).alias("bold")))
    return F.filter(runs, lambda r: r.text != "")
