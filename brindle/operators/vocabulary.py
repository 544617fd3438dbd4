"""Vocabulary: learning, ranking, usage, merges and lookups by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import candidate_terms, fold, macro_key, normalize_whitespace, separated_key


def canonical(column):
    """The comparison key of a term: one spacing, lower case, without accents."""
    return fold(normalize_whitespace(column))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def observed(calls: DataFrame, call: str, text: str) -> DataFrame:
    """(call, key, term): each call's candidate terms, first spelling of each key."""
    terms = calls.select(call, F.posexplode(candidate_terms(F.col(text))).alias("pos", "term"))
    return terms.groupBy(call, canonical(F.col("term")).alias("key")).agg(F.min_by("term", "pos").alias("term"))


def learned(observations: DataFrame, threshold: int = 3) -> DataFrame:
    """(key, observations, status): a term counts once a call and is active from the threshold on."""
    return observations.groupBy("key").agg(F.count("*").alias("observations")).withColumn("status", F.when(F.col("observations") >= threshold, "active").otherwise("suggested"))


PROMPT_ORDER = ("starred desc", "usage_count desc", "lower(term)", "term")


def active_terms(entries: DataFrame) -> DataFrame:
    """The terms of active, enabled entries in prompt order (starred, usage, term): a distributed sort."""
    return entries.where("status = 'active' and enabled").orderBy(*[F.expr(x.removesuffix(" desc")).desc() if x.endswith(" desc") else F.expr(x) for x in PROMPT_ORDER]).select("term")


def ranking(entries: DataFrame, most: int = 40) -> DataFrame:
    """The first `most` active, enabled entries in prompt order with rank: a top-k, so its window is short."""
    by = [F.expr(x.removesuffix(" desc")).desc() if x.endswith(" desc") else F.expr(x) for x in PROMPT_ORDER]
    return entries.where("status = 'active' and enabled").orderBy(*by).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*by)))


TERMS_AT_ONCE = 20000


def usage(texts: DataFrame, terms: DataFrame, key: str, text: str = "text", at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """(term, uses): rows of texts that hold each term, whatever its case and accents, bounded by non-letters and non-digits; 0 where none does.

    Not a cross join: a text's distinct words meet each term by its longest word (a symbol, if it has no word), and
    then the whole term is looked for in the text.  Terms are taken in hash parts of about at_once, so what stands
    in the plan and what is broadcast have that bound; each part is one pass over the texts, without a shuffle of them.
    """
    word, symbol = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]"
    parts = lambda c, p: F.array_distinct(F.regexp_extract_all(c, F.lit(p), F.lit(0)))
    named = terms.where("term is not null").select("term").distinct().withColumn("_low", fold(F.col("term")))
    pieces = F.when(F.col("_low").rlike(word), parts(F.col("_low"), word)).otherwise(parts(F.col("_low"), symbol))
    longest = F.array_max(F.transform(pieces, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.replace("_low", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{L}\p{N}])"))
    wanted = named.select("term", "_low", longest.alias("_w"), quoted.alias("_pattern")).where("_w is not null")
    n = -(-wanted.count() // at_once)
    low = texts.select(fold(F.col(text)).alias("_text"))
    uses = None
    for i in range(n):
        some = wanted.where(F.pmod(F.xxhash64("term"), F.lit(n)) == i) if n > 1 else wanted
        words = sorted(r[0] for r in some.select("_w").distinct().collect())  # about at_once
        found = low.select("_text", F.explode(F.array_intersect(parts(F.col("_text"), f"{word}|{symbol}" if any(len(w) == 1 for w in words) else word), F.lit(words))).alias("_w"))
        met = found.join(F.broadcast(some), "_w").where((F.col("_low") == F.col("_w")) | F.regexp_like("_text", F.col("_pattern")))
        count = met.groupBy("term").agg(F.count("*").alias("uses"))
        uses = count if uses is None else uses.unionAll(count)
    if uses is None:
        return named.select("term", F.lit(0).cast("long").alias("uses"))
    return named.select("term").join(uses, "term", "left").select("term", F.coalesce("uses", F.lit(0)).alias("uses"))


def macro_lookup(texts: DataFrame, macros: DataFrame, text: str = "text") -> DataFrame:
    """texts with the payload of the first macro (ordinal, command, payload) whose key is the text's."""
    first = first_by(macros.withColumn("_k", macro_key(F.col("command"))).where("_k != ''"), ["_k"], ["ordinal"])
    return texts.withColumn("_k", macro_key(F.col(text))).join(first.select("_k", "payload"), "_k", "left").drop("_k")


def transform_lookup(texts: DataFrame, transforms: DataFrame, text: str = "text") -> DataFrame:
    """texts with the first transform (ordinal, name) that they call by one of four forms of its name."""
    n = separated_key(F.col("name"))
    forms = transforms.where(n != "").select("ordinal", "name", F.explode(F.array(n, F.concat(n, F.lit(" that")), F.concat(n, F.lit(" this")), F.concat(F.lit("apply "), n))).alias("_k"))
    return texts.withColumn("_k", separated_key(F.col(text))).join(first_by(forms, ["_k"], ["ordinal"]).select("_k", "name"), "_k", "left").drop("_k")


def resolve_transforms(built_in: DataFrame, user: DataFrame) -> DataFrame:
    """Built-in transforms that no user transform replaces by name, then the user's."""
    key = separated_key(F.col("name"))
    rest = built_in.withColumn("_k", key).join(user.select(key.alias("_k")), "_k", "left_anti").drop("_k")
    return rest.withColumn("built_in", F.lit(True)).unionByName(user.withColumn("built_in", F.lit(False)))


FIELDS = ("term", "source", "status", "enabled", "starred", "observations", "usage_count")


def import_merge(local: DataFrame, imported: DataFrame) -> DataFrame:
    """Entries (key and FIELDS) after an import in the order of imported.ordinal, with change and updated; without caps.

    Matched by canonical key; imports of one key merge with each other, the first of a new key being its entry.  A
    status that is not active becomes active by the first active import, which brings its enabled flag; one manual
    import makes the entry manual; stars are joined and counters take the largest value.  Each of these rules looks
    at one row of the imports or at all, so the result of taking them row by row is a plain aggregation by key.
    change: added, kept or matched; updated: how many imports changed what a user sees.
    """
    rows = imported.where(F.trim("term") != "").withColumn("key", canonical(F.col("term")))
    at = lambda test: F.min(F.when(test, F.col("ordinal")))
    whole = F.struct("ordinal", *FIELDS)
    imports = rows.groupBy("key").agg(
        F.min_by(whole, "ordinal").alias("i"), F.min_by(F.when(F.col("status") == "active", whole), F.when(F.col("status") == "active", F.col("ordinal"))).alias("active"),
        at(F.col("source") == "manual").alias("manual"), at(F.col("starred")).alias("star"), F.max("observations").alias("most_seen"), F.max("usage_count").alias("most_used"),
    )
    named = local.where(F.trim("term") != "").withColumn("key", canonical(F.col("term")))
    own = named.groupBy("key").agg(F.min_by(F.struct("ordinal", *FIELDS), "ordinal").alias("l"))
    j = own.join(imports, "key", "full_outer").withColumn("b", F.coalesce("l", F.col("i")))
    promoted = (F.col("b.status") != "active") & F.col("active").isNotNull()
    seen = [F.when(promoted, F.col("active.ordinal")), F.when(F.col("b.source") != "manual", F.col("manual")), F.when(~F.coalesce("b.starred", F.lit(False)), F.col("star"))]
    return j.select(
        "key",
        "b.term",
        F.when(F.col("manual").isNotNull(), "manual").otherwise(F.col("b.source")).alias("source"),
        F.when(promoted, "active").otherwise(F.col("b.status")).alias("status"),
        F.when(promoted, F.col("active.enabled")).otherwise(F.col("b.enabled")).alias("enabled"),
        (F.coalesce("b.starred", F.lit(False)) | F.col("star").isNotNull()).alias("starred"),
        F.greatest("b.observations", "most_seen").alias("observations"),
        F.greatest("b.usage_count", "most_used").alias("usage_count"),
        F.when(F.col("l").isNull(), "added").when(F.col("i").isNull(), "kept").otherwise("matched").alias("change"),
        F.size(F.array_distinct(F.array_compact(F.array(*seen)))).cast("long").alias("updated"),
        F.coalesce((F.col("l").isNull()) & (F.col("i.status") != "rejected"), F.lit(False)).alias("counted"),
    )


def import_counters(merged: DataFrame) -> DataFrame:
    """added (rejected ones aside) and updated, of import_merge()."""
    return merged.agg(F.count_if("counted").alias("added"), F.coalesce(F.sum("updated"), F.lit(0)).alias("updated"))


def suggestions(entries: DataFrame) -> DataFrame:
    return entries.where("status = 'suggested'").orderBy("ordinal")


def matches(term, query: str):
    """A search: an empty query matches all."""
    return F.lit(True) if not query.strip() else F.lower(term).contains(query.strip().lower())


def saved(entries: DataFrame, query: str = "") -> DataFrame:
    """Active entries that match, starred ones first, else in their order."""
    return entries.where("status = 'active'").where(matches(F.col("term"), query)).orderBy(F.desc("starred"), "ordinal")


def exported(entries: DataFrame) -> DataFrame:
    """One row: how many entries an export holds."""
    return entries.agg(F.count_if(F.col("status") != "rejected").alias("n"))


def remove(entries: DataFrame, ids: DataFrame) -> DataFrame:
    return entries.join(ids.select("id"), "id", "left_anti")


def edit(entries: DataFrame, ids: DataFrame, at, **values) -> DataFrame:
    """Entries whose id is in ids take the values and the time `at`."""
    hit = entries.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    new = values | {"updated_at": at}
    return hit.select(*[F.when(F.col("_hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in entries.columns])


def set_enabled(entries: DataFrame, ids: DataFrame, enabled: bool, at) -> DataFrame:
    return edit(entries, ids, at, enabled=F.lit(enabled))


def set_starred(entries: DataFrame, ids: DataFrame, starred: bool, at) -> DataFrame:
    return edit(entries, ids, at, starred=F.lit(starred))


def accept(entries: DataFrame, ids: DataFrame, at) -> DataFrame:
    return edit(entries, ids, at, status=F.lit("active"), enabled=F.lit(True))


def dismiss(entries: DataFrame, ids: DataFrame, at) -> DataFrame:
    return edit(entries, ids, at, status=F.lit("rejected"), enabled=F.lit(False))


def add_manual(entries: DataFrame, additions: DataFrame) -> DataFrame:
    """additions (ordinal, term) with key, entry (its ordinal, or null) and outcome: blank, duplicate, promoted or added.

    The first entry of a key counts.  An active one makes the addition a duplicate, as does an earlier addition.
    """
    cleaned = additions.withColumn("term", normalize_whitespace(F.col("term"))).withColumn("key", canonical(F.col("term")))
    first = cleaned.where("term != ''").groupBy("key").agg(F.min("ordinal").alias("_first"))
    own = entries.withColumn("key", canonical(F.col("term"))).groupBy("key").agg(F.min_by(F.struct("ordinal", "status"), "ordinal").alias("_e"))
    met = cleaned.join(first, "key", "left").join(own, "key", "left")
    blank = F.coalesce(F.col("term") == "", F.lit(True))
    outcome = F.when(blank, "blank").when((F.col("_e.status") == "active") | (F.col("ordinal") > F.col("_first")), "duplicate").when(F.col("_e").isNotNull(), "promoted").otherwise("added")
    return met.select("ordinal", "term", "key", F.col("_e.ordinal").alias("entry"), outcome.alias("outcome"))


def with_manual(entries: DataFrame, added: DataFrame, at) -> DataFrame:
    """Entries after add_manual(): promoted ones in place, added ones at the end (their ordinal after all others)."""
    promoted = added.where("outcome = 'promoted'").select(F.col("entry").alias("ordinal"), F.lit(True).alias("_hit"))
    new = {"source": F.lit("manual"), "status": F.lit("active"), "enabled": F.lit(True), "updated_at": at}
    kept = entries.join(promoted, "ordinal", "left").select(*[F.when(F.col("_hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in entries.columns])
    last = entries.agg(F.coalesce(F.max("ordinal"), F.lit(0)).alias("_last"))
    fresh = added.where("outcome = 'added'").crossJoin(F.broadcast(last))  # one row
    start = new | {"ordinal": F.col("_last") + 1 + F.col("ordinal"), "term": F.col("term"), "starred": F.lit(False), "observations": F.lit(0), "usage_count": F.lit(0)}
    return kept.unionByName(fresh.select(*[start.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in entries.schema.fields]))


def pasted_terms(texts: DataFrame, text: str = "text") -> DataFrame:
    """(ordinal, term) of texts (ordinal, text): parts between new lines, commas and semicolons; long text, ordinals in order."""
    parts = texts.select("ordinal", F.posexplode(F.split(text, "[\n,;]")).alias("pos", "term"))
    return parts.where(F.trim("term") != "").select((F.col("ordinal") * 1_000_000 + F.col("pos")).alias("ordinal"), F.trim("term").alias("term"))


def migrated_terms(entries: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """(key, term) that a legacy text adds: the first spelling of each key that no entry has."""
    parts = pasted_terms(texts, text).withColumn("key", canonical(F.col("term"))).where("key != ''")
    first = parts.groupBy("key").agg(F.min_by("term", "ordinal").alias("term"))
    return first.join(entries.select(canonical(F.col("term")).alias("key")), "key", "left_anti")


def learn(entries: DataFrame, calls: DataFrame, threshold: int = 3, learned_cap: int = 300, suggested_cap: int = 100) -> DataFrame:
    """Entries (key, term, source, status, observations, ordinal) after calls (call, key, term, in order of call and pos), with the result of taking one sight after another.

    Manual and rejected entries stay as they are; a learned one counts each call once and is active from the threshold
    on.  Any other key enters at its first sight at which there is room: under learned_cap learned and suggested_cap
    suggested entries.  A promotion frees room, so a key may enter at a later sight than its first.  Rejected entries
    beyond the newest learned_cap go first, where entries have updated_at.

    Sights are walked from one time at which there is room to the next.  There, as many keys enter at once as there is
    room, and no promotion up to the last of them can put one of them off, only add room after it.  The driver holds what
    the caps bound: the promotion times of suggested entries and the keys that have entered.  Every step lets at least
    one key in or passes at least one promotion, so there are at most twice learned_cap steps.
    """
    if "updated_at" in entries.columns and not calls.isEmpty():
        entries = purged(entries.withColumn("id", F.col("key")) if "id" not in entries.columns else entries, learned_cap)
    seen = calls.groupBy("key", "call").agg(F.min(F.struct("pos", "term")).alias("f")).select("key", F.struct("call", F.col("f.pos").alias("pos"), F.col("key").alias("tie")).alias("at"), "f.term")
    learns = (F.col("source") == "learned") & (F.col("status") != "rejected")
    counts = entries.agg(F.count_if(learns).alias("l"), F.count_if(learns & (F.col("status") == "suggested")).alias("s")).first()
    nth = F.row_number().over(Window.partitionBy("key").orderBy("at"))

    def promotions(sights: DataFrame, had) -> list:
        """When the suggested entries among them become active, in order."""
        reached = sights.withColumn("nth", nth).where(F.col("nth") == F.greatest(F.lit(1), threshold - had))
        return sorted(tuple(r["at"]) for r in reached.select("at").collect())

    waiting = entries.where(learns & (F.col("status") == "suggested"))
    ahead = promotions(seen.join(waiting.select("key", "observations"), "key"), F.col("observations")) if counts.s else []
    fresh = seen.join(entries.select("key"), "key", "left_anti")
    entered: dict = {}  # key: (sight, term)
    room, left, now = suggested_cap - counts.s, learned_cap - counts.l, None
    moment = lambda x: F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(x, seen.schema["at"].dataType.fields, strict=True)])
    while left > 0:
        if room <= 0:
            if not ahead:
                break
            now, room = max(x for x in (now, ahead.pop(0)) if x is not None), room + 1
            continue
        later = fresh if now is None else fresh.where(F.col("at") > moment(now))
        if entered:
            later = later.where(~F.col("key").isin(*entered))
        new = later.groupBy("key").agg(F.min(F.struct("at", "term")).alias("f")).orderBy("f.at").limit(left if threshold <= 1 else min(room, left)).collect()  # what is active at once takes no room
        if not new:
            break
        entered |= {r["key"]: (tuple(r["f"]["at"]), r["f"]["term"]) for r in new}
        left, now = left - len(new), tuple(new[-1]["f"]["at"])
        if threshold > 1:
            room -= len(new)
            since = F.lit(None)
            for r in new:
                since = F.when(F.col("key") == r["key"], moment(r["f"]["at"])).otherwise(since)
            ahead = sorted(ahead + promotions(fresh.where(F.col("key").isin(*[r["key"] for r in new])).where(F.col("at") >= since), F.lit(0)))
        # promotions up to the last that entered have freed their room by now
        passed = [x for x in ahead if x <= now]
        room, ahead = room + len(passed), ahead[len(passed) :]

    counted = seen.groupBy("key").agg(F.count("*").alias("n"))
    known = entries.join(counted, "key", "left")
    total = F.col("observations") + F.coalesce("n", F.lit(0))
    hit = learns & F.col("n").isNotNull()
    kept = known.select("key", "term", "source", F.when(hit & (total >= threshold), "active").otherwise(F.col("status")).alias("status"), F.when(hit, total).otherwise(F.col("observations")).alias("observations"), "ordinal")
    if not entered:
        return kept
    spark = entries.sparkSession
    inside = spark.createDataFrame([(k, t, *at) for k, (at, t) in entered.items()], spark.createDataFrame([], "key string, term string").schema.add("call", calls.schema["call"].dataType).add("pos", calls.schema["pos"].dataType).add("tie", "string"))
    uses = fresh.select("key", "at").join(F.broadcast(inside), "key").where(F.col("at") >= F.struct("call", F.col("pos"), F.col("tie"))).groupBy("key").agg(F.count("*").alias("n"), F.first(inside["term"]).alias("term"))
    status = F.when(F.col("n") >= threshold, "active").otherwise("suggested")
    return kept.unionByName(uses.select("key", "term", F.lit("learned").alias("source"), status.alias("status"), F.col("n").alias("observations"), F.lit(None).cast(entries.schema["ordinal"].dataType).alias("ordinal")))


def purged(entries: DataFrame, most: int = 300) -> DataFrame:
    """Without the rejected entries beyond the newest `most`: a bounded top-k, not one window."""
    newest = entries.where("status = 'rejected'").orderBy(F.desc("updated_at"), "id").limit(most)
    return entries.where("status != 'rejected' or status is null").unionByName(newest)


def parse_corrections(lines: DataFrame, text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, ordinal, spoken, replacement) of texts of lines: `->`, `=>` or `→` between two parts; of one spoken form in the texts of one `by` the first wins."""
    rows = lines.select(*by, F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("ordinal", "line")).withColumn("line", F.trim("line")).where("line != '' and line not like '#%'")
    mark = F.when(F.col("line").contains("->"), "->").when(F.col("line").contains("=>"), "=>").when(F.col("line").contains("→"), "→")
    parts = rows.withColumn("mark", mark).where("mark is not null").withColumn("parts", F.expr("split(line, concat('\\\\Q', mark, '\\\\E'), -1)"))
    pairs = parts.where("size(parts) = 2").select(*by, "ordinal", normalize_whitespace(F.get("parts", F.lit(0))).alias("spoken"), F.trim(F.get("parts", F.lit(1))).alias("replacement")).where("spoken != '' and replacement != ''")
    return first_by(pairs.withColumn("key", canonical(F.col("spoken"))), [*by, "key"], ["ordinal"]).select(*by, "ordinal", "spoken", "replacement")
