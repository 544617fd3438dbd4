"""Run history: scan, append, retention, keyed update and delete, and the as-of lookup of a recent item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan(history: DataFrame, ts: str = "ts", key: str = "id") -> DataFrame:
    return history.orderBy(F.desc(ts), key)


def ranked(history: DataFrame, ts: str, key: str, by: list[str]) -> DataFrame:
    return history.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(ts), key)))


def retain(history: DataFrame, most: int, ts: str = "ts", key: str = "id", by: tuple[str, ...] = ()) -> DataFrame:
    """The newest rows of each partition (of all, without by: a distributed top-k, not one window)."""
    if most <= 0:
        return history.limit(0)
    return ranked(history, ts, key, list(by)).where(F.col("_rank") <= most).drop("_rank") if by else history.orderBy(F.desc(ts), key).limit(most)


def dropped(history: DataFrame, most: int, ts: str = "ts", key: str = "id", by: tuple[str, ...] = ()) -> DataFrame:
    return history.join(retain(history, most, ts, key, by).select(key), key, "left_anti")


def append(history: DataFrame, rows: DataFrame, most: int, ts: str = "ts", key: str = "id") -> DataFrame:
    return retain(history.unionByName(rows), most, ts, key)


def update(history: DataFrame, changes: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Rows whose key is in changes take its columns, nulls included; other keys of changes do nothing.  Of several changes of one key the least by its columns counts."""
    c = changes.groupBy(key).agg(F.min(F.struct(*[F.col(x).alias(f"_{x}") for x in columns], F.lit(True).alias("_hit"))).alias("c")).select(key, "c.*")
    return history.join(c, key, "left").select(*[F.when(F.col("_hit"), F.col(f"_{x}")).otherwise(F.col(x)).alias(x) if x in columns else F.col(x) for x in history.columns])


def delete(history: DataFrame, keys: DataFrame, returning: list[str], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """What stays, and the returned columns of what goes."""
    return history.join(keys.select(key), key, "left_anti"), history.join(keys.select(key), key, "left_semi").select(key, *returning)


def decoded(intent: Column, text: Column, status: Column, ts: Column, now: Column) -> Column:
    """Defaults of stored rows."""
    known = intent.isin("dictation", "command:automatic", "command:manual")
    return F.struct(F.when(known, intent).otherwise("dictation").alias("intent"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(status, F.lit("available (image)")).alias("status"), F.coalesce(ts, now).alias("ts"))


def recent_item(probes: DataFrame, history: DataFrame, on: list[str], condition: Column | None = None, seconds: int = 120) -> DataFrame:
    """Of each probe (probe_id, at, ...) the newest history row (id, ts, ...) at most so many seconds old.

    An equi-join on keys and time buckets of the window's length, not a range join: a history row enters its
    own bucket and the next.  condition: a residual over both sides.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    left = probes.withColumn("_bucket", bucket("at"))
    right = history.withColumn("_bucket", F.explode(F.array(bucket("ts"), bucket("ts") + 1)))
    age = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    hit = left.join(right, [*on, "_bucket"]).where((age >= 0) & (age <= seconds * 1_000_000))
    if condition is not None:
        hit = hit.where(condition)
    return hit.groupBy("probe_id").agg(F.max(F.struct("ts", "id")).alias("m")).select("probe_id", F.col("m.id").alias("id"), F.col("m.ts").alias("ts"))


def insert(history: DataFrame, rows: DataFrame) -> DataFrame:
    """history with the rows, column by column; columns that rows lack are null."""
    have = set(rows.columns)
    typed = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in history.schema.fields]
    return history.unionByName(rows.select(*typed))


def names_of(rows: DataFrame, name: str, ts: str = "ts") -> DataFrame:
    """The file names that rows hold, newest first."""
    return rows.where(F.col(name).isNotNull()).select(name, ts)


def append_returning(history: DataFrame, rows: DataFrame, most: int, name: str, ts: str = "ts", key: str = "id") -> tuple[DataFrame, DataFrame]:
    """history after an append and its retention, and the file names of the rows that went."""
    everything = insert(history, rows)
    return retain(everything, most, ts, key), names_of(dropped(everything, most, ts, key), name, ts)


def clear(history: DataFrame, name: str, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """No rows, and the file names of all."""
    return history.limit(0), names_of(history, name, ts)


def decode(history: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """history with the defaults of columns that are null; an unknown intent is dictation."""
    known = F.col("intent").isin("dictation", "command:automatic", "command:manual")
    new = {c: F.coalesce(F.col(c), v) for c, v in defaults.items()} | ({"intent": F.when(known, F.col("intent")).otherwise("dictation")} if "intent" in history.columns else {})
    return history.select(*[new.get(c, F.col(c)).alias(c) for c in history.columns])


def recent(history: DataFrame, clean: str, raw: str, most: int = 10, ts: str = "ts", key: str = "id") -> DataFrame:
    """The newest rows with something to show."""
    shown = F.coalesce(F.nullif(F.trim(clean), F.lit("")), F.trim(raw))
    return history.where(F.coalesce(shown, F.lit("")) != "").orderBy(F.desc(ts), key).limit(most)


def invalidated(history: DataFrame, scratches: DataFrame, on: list[str], ts: str = "ts") -> DataFrame:
    """history without rows up to the last scratch (on, ts) of their key."""
    mark = scratches.groupBy(*on).agg(F.max(ts).alias("_mark"))
    return history.join(mark, on, "left").where(F.col("_mark").isNull() | (F.col(ts) > F.col("_mark"))).drop("_mark")


def reverted(history: DataFrame, ids: DataFrame, raw: str, clean: str, status: str, key: str = "id") -> DataFrame:
    """Rows of these ids whose raw text may stand in for the cleaned one take it, and say so in their status."""
    hit = history.join(ids.select(key, F.lit(True).alias("_hit")).distinct(), key, "left")
    r, c = F.trim(raw), F.trim(clean)
    may = F.coalesce(F.col("_hit") & (r != "") & (c != "") & (r != c), F.lit(False))
    new = {clean: F.when(may, F.col(raw)).otherwise(F.col(clean)), status: F.when(may, F.concat(F.col(status), F.lit("; reverted to raw"))).otherwise(F.col(status))}
    return hit.select(*[new.get(x, F.col(x)).alias(x) for x in history.columns])


def retried(history: DataFrame, results: DataFrame, columns: list[str], status: str, key: str = "id") -> DataFrame:
    """Rows of results (id, columns, failure) take their columns; where a retry failed only the status changes.  The first of a key's results by failure and columns counts."""
    one = results.groupBy(key).agg(F.min(F.struct(F.col("failure").isNotNull().alias("_bad"), "failure", *columns)).alias("r"))
    met = history.join(one, key, "left")
    done = F.col("r").isNotNull() & ~F.coalesce("r._bad", F.lit(False))
    new = {c: F.when(done, F.col(f"r.{c}")).otherwise(F.col(c)) for c in columns} | {status: F.when(F.col("r._bad"), F.col("r.failure")).when(done, "retried").otherwise(F.col(status))}
    return met.select(*[new.get(x, F.col(x)).alias(x) for x in history.columns])


def scratched(probes: DataFrame) -> DataFrame:
    """probes (previous, at) with status and mark: a scratch without a previous text does nothing, else all history up to it is out."""
    found = F.coalesce(F.trim("previous"), F.lit("")) != ""
    return probes.withColumns({"status": F.when(found, "Scratched").otherwise("Nothing to scratch"), "mark": F.when(found, F.col("at"))})
