"""The utterance router: one ordered ladder from transcript to text, with the outcome and its status line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts, rules, text


def prompt(parts: list[tuple[str, Column, int | None]], section: str, body: Column) -> Column:
    """Hints (label, value, cap) that have a value, one a line, then the tagged text."""
    lines = []
    for label, value, cap in parts:
        v = text.strip(value)
        v = F.left(v, F.lit(cap)) if cap else v
        lines.append(F.when(v != "", F.concat(F.lit(f"{label}: "), v)))
    return F.concat_ws("\n", *lines, F.concat(F.lit(f"<{section}>\n"), body, F.lit(f"\n</{section}>")))


def vocabulary_hint(raw: Column, most: int = 40) -> Column:
    return F.array_join(F.slice(text.split_terms(raw), 1, most), ", ")


def budget(transcript: Column) -> Column:
    """Seconds a cleanup may take."""
    return F.when(F.length(transcript) > 500, 4.0).otherwise(2.5)


def route(utterances: DataFrame, must_keep: tuple[str, ...] = ()) -> DataFrame:
    """utterances with outcome (kind, text, seconds, reason, replaces) and status.

    utterances: transcript, intent (dictation, command:automatic, command:manual), mode (smart, basic, exact), wake (struct or
    null), macro (payload or null), selected_text, previous_text, transform (name or null), model_output, model_elapsed;
    before (the caret), macro_name, retried and enter may be there.
    Order: empty, wake (empty command, transform, command), edit command, macro, exact, basic, smart, fallback.
    A model answer that is late, missing or rejected falls back: a wake command and a transform to the command, an edit to the
    selection, a cleanup to the basic one.  replaces: the text takes the place of previous_text.
    """
    given = lambda c, kind="string": F.col(c) if c in utterances.columns else F.lit(None).cast(kind)
    t, command = text.strip(F.col("transcript")), text.strip(F.col("wake.trailing"))
    woken = (F.col("intent") == "dictation") & F.col("wake").isNotNull()
    edit, asked = F.col("intent").startswith("command"), F.col("transform").isNotNull()
    previous = F.coalesce(F.col("previous_text"), F.lit(""))
    kind = F.when(woken & asked, "transform").when(woken, "wake").when(edit, "edit").otherwise("smart")
    rewritten = F.when(woken, previous).otherwise(F.col("selected_text"))
    answer = answered(kind, F.col("model_output"), F.col("model_elapsed"), F.when(woken, command).otherwise(t), rewritten, previous, given("before"), must_keep)
    plain = text.tidy(t)
    basic = F.coalesce(F.nullif(plain, F.lit("")), t)
    none, never = F.lit(None).cast("string"), F.lit(False)

    def made(kind: str | Column, value: Column, why: Column = none, seconds: Column | None = None, replaces: Column = never) -> Column:
        took = F.lit(None).cast("double") if seconds is None else seconds
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), value.alias("text"), took.alias("seconds"), why.alias("reason"), replaces.alias("replaces"))

    a, took = F.col("_answer"), F.col("model_elapsed").cast("double")
    failed = a.reason.isNotNull()
    outcome = (
        F.when(t == "", made("empty", F.lit("")))
        .when(woken & (command == ""), made("wake_failed", F.lit(""), F.lit("empty request")))
        .when(woken & asked & (text.strip(previous) == ""), made("wake_failed", F.lit(""), F.lit("no recent dictation to transform")))
        .when(woken & failed, made("wake_failed", command, a.reason))
        .when(woken & asked, made("transform", a.text, seconds=took, replaces=F.lit(True)))
        .when(woken, made("wake", a.text, seconds=took, replaces=a.replaces))
        .when(edit & failed, made("edit_failed", F.col("selected_text"), a.reason))
        .when(edit, made("edit", a.text, seconds=took))
        .when(F.col("macro").isNotNull(), made("macro", F.col("macro")))
        .when(F.col("mode") == "exact", made("exact", t))
        .when((F.col("mode") == "basic") | failed, made(F.when(F.col("mode") == "basic", "basic").otherwise("fallback"), basic, F.when(F.col("mode") != "basic", a.reason)))
        .otherwise(made("smart", a.text, seconds=took))
    )
    out = utterances.withColumn("_answer", answer).withColumn("outcome", outcome).drop("_answer")
    o = F.col("outcome")
    name = F.when(o.kind.startswith("wake"), F.col("wake.phrase")).when(o.kind == "transform", F.col("transform")).when(o.kind.startswith("edit"), F.substring_index("intent", ":", -1)).otherwise(F.coalesce(given("macro_name"), t))
    line = prompts.status_line(o.kind, name, o.seconds, o.reason, F.coalesce(given("retried", "boolean"), never), F.coalesce(given("enter", "boolean"), never))
    return out.withColumn("status", line)


def answered(kind: Column, output: Column, elapsed: Column, spoken: Column, selected: Column, previous: Column, before: Column, must_keep: tuple[str, ...] = ()) -> Column:
    """struct(text, replaces, reason) of a model's answer: smart cleanup, edit, transform or wake command.

    spoken: the transcript or command; selected: what an edit or transform rewrites; previous: text that a wake command
    may replace; before: the text before the caret.  A late, missing, empty or rejected answer falls back: to the
    transcript, the selection or the command itself.
    """
    smart, wake = kind == "smart", kind == "wake"
    stripped = lambda c: F.when(smart & (text.strip(before) != ""), rules.strip_repeated_prefix(c, before)).otherwise(c)
    cased = lambda c: F.when(smart, rules.harmonize_case(c, spoken, before)).otherwise(c)
    limit = F.when(smart, budget(spoken)).when(kind == "edit", 4.0).otherwise(5.0)
    source = F.when(smart | wake, spoken).otherwise(selected)
    replaceable = F.coalesce(text.strip(previous), F.lit("")) != ""

    def judged(clean: Column) -> Column:
        rejected = F.when(smart, rules.rejection(clean, spoken, must_keep)).when(wake, F.when(clean == "", "empty output")).otherwise(rules.rejection(clean, source, (), True))
        reason = F.when(output.isNull(), "unavailable").when(elapsed.isNull() | (elapsed > limit), "timed out").otherwise(rejected)
        return F.struct(clean.alias("clean"), reason.alias("reason"))

    def settled(x: Column) -> Column:
        value = F.when(x.reason.isNotNull(), source).when(wake, rules.routed_text(x.clean)).otherwise(x.clean)
        replaces = x.reason.isNull() & wake & rules.replaces_previous(x.clean) & replaceable
        return F.struct(value.alias("text"), F.coalesce(replaces, F.lit(False)).alias("replaces"), x.reason.alias("reason"))

    return text.let(text.let(text.let(text.let(prompts.normalized_answer(output), stripped), cased), judged), settled)

