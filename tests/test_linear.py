"""Rules that stay linear on long runs, and equal plain versions of themselves on short random texts."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from brindle.functions import prompts, text


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("rule", "given", "wanted"),
    [
        (text.collapse_repeats, "the " * 1_000_000 + "end", "the end"),
        (text.tidy, "The the " * 500_000 + "end", "The end"),
        (text.strip, " a" + "  " * 500_000 + "b ", "a" + "  " * 500_000 + "b"),
        (text.normalize_punctuation, "a" + " " * 1_000_000 + "b", "a b"),
        (text.without_enter_command, "a" + ", " * 500_000 + "b, press enter.", "a" + ", " * 500_000 + "b"),
        (text.candidate_terms, "a" + " " * 1_000_000 + "Berlin", ["Berlin"]),
        (prompts.strip_tags, "<response>" * 100_000 + "x" + "</response>" * 100_000, "x"),
        (prompts.strip_tags, "<request>a</request> " * 100_000 + "x", "x"),
        (prompts.strip_tags, "<response>" + " " * 500_000 + "a <request>", "a <request>"),
    ],
)
def test_long_runs(spark, rule, given, wanted):
    begin = time.time()
    assert one(spark, rule, given) == wanted
    assert time.time() - begin < 60


def plain_peel(value):
    value = value.strip()
    while value:
        before = value
        for tag in prompts.ECHOED:
            value = re.sub(rf"(?i)\A<{tag}\s*>[\s\S]*?</{tag}\s*>\s*", "", value)
        for tag in prompts.WRAPPERS:
            value = re.sub(rf"(?i)\A<{tag}\s*>\s*", "", value)
            value = re.sub(rf"(?i)\s*</{tag}\s*>\Z", "", value)
        value = value.strip()
        if value == before:
            break
    return value


def test_tags_equal_a_plain_loop(spark):
    r = random.Random(7)
    pieces = ["<response>", "</response>", "<Output >", "</output>", "<request>", "</request>", "<transcript>", "</transcript>", " ", "\n", "a", "<b>", "<", "</reply>", "<reply>"]
    given = ["".join(r.choice(pieces) for _ in range(r.randint(0, 9))) for _ in range(6000)]
    got = spark.createDataFrame(list(enumerate(given)), "i int, t string").select("i", prompts.strip_tags(F.col("t"))).collect()
    assert {i: x for i, x in got} == {i: plain_peel(t) for i, t in enumerate(given)}


def test_repeats_equal_the_pattern(spark):
    r = random.Random(8)
    pieces = ["the", "The", "THE", "a", "an", "is", "cat", " ", "  ", "\n", "-", ",", "_", "é"]
    given = ["".join(r.choice(pieces) + r.choice(["", " ", " "]) for _ in range(r.randint(0, 12))) for _ in range(6000)]
    words = "|".join(sorted(text.COLLAPSIBLE, key=len, reverse=True))
    pattern = re.compile(rf"(?i)(?<!\w)({words})(?:\s+\1)+(?!\w)")
    got = spark.createDataFrame(list(enumerate(given)), "i int, t string").select("i", text.collapse_repeats(F.col("t"))).collect()
    assert {i: x for i, x in got} == {i: pattern.sub(r"\1", t) for i, t in enumerate(given)}


def test_corrections_fold_accents_when_they_look_up(spark):
    fix = lambda t, pairs, **more: one(spark, lambda c: text.apply_corrections(c, pairs, **more), t)
    assert fix("Zoé, zoe", [("zoe", "ZOE")]) == "Zoé, ZOE"  # found by case only
    assert fix("zoe ZOÉ", [("zoé", "first"), ("zoe", "second")]) == "first first"  # the first of those that fit
    assert fix("Zoé, café́ zoë\tRené", [("zoe", "ZOE")], any_accent=True) == "ZOE, café́ ZOE\tRené"
    assert fix("Zoé du  Café", [("zoe du cafe", "x")], any_accent=True) == "x"


def plain_merge(local, imported):
    trimmed = lambda c: [x.strip(text.LINE_BLANKS) for x in (c or "").split("\n")]
    seen, added = {"", *map(str.lower, trimmed(local))}, []
    for x in trimmed(imported):
        if x.lower() not in seen:
            seen.add(x.lower())
            added.append(x)
    kept = (local or "").strip(text.BLANKS)
    return ("\n".join([kept] * bool(kept) + added) if added else local or ""), len(added)


def test_merged_corrections_equal_a_plain_loop(spark):
    r = random.Random(11)
    pieces = ["a", "A", " b", "B\t", "a b", "\u3000c", "É", "é", " ", "\n", "\n", "\n", "\n\n", "z→y", "\r"]
    given = [tuple(None if r.random() < 0.1 else "".join(r.choice(pieces) for _ in range(r.randint(0, 14))) for _ in range(2)) for _ in range(4000)]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(given)], "i int, local string, imported string")
    got = {i: (m.text, m.added) for i, m in rows.select("i", text.merged_corrections(F.col("local"), F.col("imported")).alias("m")).collect()}
    assert got == {i: plain_merge(*x) for i, x in enumerate(given)}


def test_merged_corrections_of_many_lines(spark):
    local, imported = "\n".join(f"l{i}" for i in range(50_000)), "\n".join(f" X{i} \nL{i}\nx{i}" for i in range(100_000))
    begin = time.time()
    m = spark.createDataFrame([(local, imported)], "l string, i string").select(text.merged_corrections(F.col("l"), F.col("i")).alias("m")).first().m
    new = [x for i in range(100_000) for x in (f"X{i}", *([f"L{i}"] if i >= 50_000 else []))]
    assert (m.added, m.text) == (150_000, local + "\n" + "\n".join(new))
    assert time.time() - begin < 60
