"""Text rules on worked examples; cleaning twice changes nothing."""

import pytest
from pyspark.sql import functions as F

from brindle.functions import rules, text, versions

TIDY = [
    ("Uhm, she erm said   yes", "she said yes"),
    ("they they left and and came", "they left and came"),
    ("so so far", "so so far"),
    ("Ca- Carol paid", "Carol paid"),
    ("a-a battery", "a-a battery"),
    ("no, um, later", "no later"),
    ("ten , twenty ; done !", "ten, twenty; done!"),
    ("stop;!? now", "stop? now"),
    ("; then go :", "then go"),
    ("drum, erm uh", "drum"),
    ("", ""),
]


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("given,want", TIDY)
def test_tidy(spark, given, want):
    assert one(spark, given, text.tidy) == want
    assert one(spark, want, text.tidy) == want


def test_corrections_in_one_pass(spark):
    pairs = [("foo", "bar"), ("bar", "baz"), ("foo bar", "qux")]
    assert one(spark, "foo  bar, Foo and bar foobar", lambda c: text.apply_corrections(c, pairs)) == "qux, bar and baz foobar"


def test_keys_and_commands(spark):
    assert one(spark, "Meeting-Notes, please!", text.separated_key) == "meeting notes please"
    assert one(spark, "Meeting-Notes!", text.macro_key) == "meetingnotes"
    assert one(spark, "Scratch, that.", text.is_scratch) and not one(spark, "scratch that please", text.is_scratch)
    assert one(spark, "send it, press enter.", text.without_enter_command) == "send it"
    wake = lambda c: text.wake_match(c, ["hey"], ["juniper"], ["june"], plain=True)["trailing"]
    assert one(spark, "  Hey, juniper: open it", wake) == "open it"
    assert one(spark, "june open", wake) is None and one(spark, "Juniper! go", wake) == "go"


def test_candidates(spark):
    found = one(spark, "Hello there. We met Ada at NASA with gpt-4 and iPhone. The end", text.candidate_terms)
    assert found == ["Ada", "NASA", "gpt-4", "iPhone."]


def test_rules(spark):
    unwrap = lambda s: one(spark, s, rules.unwrap)
    assert unwrap('```json\n{"cleaned_text": "Hi."}\n```') == "Hi." and unwrap("```py\nx\n```") == "```py\nx\n```"
    assert one(spark, "see you at the park", lambda c: rules.strip_repeated_prefix(c, F.lit("I will see you at"))) == "the park"
    assert one(spark, "done.\n", rules.caret_continues) is False and one(spark, "and then", rules.caret_continues) is True
    assert one(spark, "The cat", lambda c: rules.harmonize_case(c, F.lit("the cat"), F.lit("and so"))) == "the cat"
    assert one(spark, "me@gmail.com - Account", lambda c: rules.writing_context(F.lit("Safari"), F.lit(None), c)) == "neutral"
    assert one(spark, "damn it", lambda c: rules.rejection(F.lit("ok it"), c, ("damn",))) == 'dropped the spoken word "damn"'


def test_versions(spark):
    tags = ["1.0.0-1", "1.0.0-2", "1.0.0-10", "1.0.0-a", "1.0.0-a.1", "1.0.0", "v1.0.1", "1.2.0"]
    df = spark.createDataFrame([(t,) for t in reversed(tags)], "t string").withColumn("v", versions.semver(F.col("t")))
    assert [r.t for r in df.orderBy("v").collect()] == tags
    assert one(spark, "1.2", versions.semver) is None and one(spark, "1.2.3-", versions.semver) is None and one(spark, "1..2.3", versions.semver).patch == 3


def test_merged_corrections(spark):
    cases = [("big cat → Bigcat\n", "BIG CAT → Bigcat\nq → Q\n\nq → Q", "big cat → Bigcat\nq → Q", 1), ("", "a → b", "a → b", 1), ("a → b", "a → b\n", "a → b", 0), (None, None, "", 0), ("x ", " Y\t\ny\nX", "x\nY", 1)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, local string, imported string, text string, added int")
    got = rows.select("*", text.merged_corrections(F.col("local"), F.col("imported")).alias("m")).collect()
    assert [(r.m.text, r.m.added) for r in got] == [(r.text, r.added) for r in got]


def test_usage_of_terms_that_are_not_one_word(spark):
    from brindle.operators import vocabulary

    texts = [(1, "In New York, foo-bar"), (1, "In New York, foo-bar"), (2, "new  york xfoo-bar foo-barn"), (None, "NEW YORK new_v1.2"), (3, "v1.23 v1x2 O'Brien's C++"), (4, None), (5, ""), (6, r"a\E|b new yorker")]
    terms = ["New York", "foo-bar", "v1.2", "O'Brien", "C++", "++", "york", "absent one", r"a\E|b", "", None, "foo-bar"]
    got = vocabulary.usage(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(t,) for t in terms], "term string"), "id").collect()
    again = vocabulary.usage(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(t,) for t in terms], "term string"), "id", at_once=3).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    want = {"New York": 3, "foo-bar": 2, "v1.2": 1, "O'Brien": 1, "C++": 1, "++": 0, "york": 4, "absent one": 0, r"a\E|b": 1, "": 0}
    assert sorted(map(tuple, got)) == sorted(want.items())


def test_json_answers(spark):
    cases = [('{"Text": "a", "text": "b"}', "a"), ('{"text": 5, "answer": "x"}', "x"), ('{"text": 5}', '{"text": 5}'), ('{"other": "a"}', '{"other": "a"}'), ("{}", "{}"), ('{"text": "a"', '{"text": "a"'), (None, None)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, x string").select("i", rules.unwrap(F.col("x")).alias("y"))
    assert [r.y for r in df.orderBy("i").collect()] == [w for _, w in cases]


def test_answer_tags(spark):
    from brindle.functions import prompts

    cases = [
        ("<Output>\n <result>Hi </result>\n</OUTPUT >", "Hi"), ("<request>a\nb</request><previous_text></previous_text>done", "done"), ("<list><item>a</item>\n\n<Item > b</item></list>", "- a</item>\n- b".replace("</item>", "")),
        ("<div>x</div>", "<div>x</div>"), ("x </answer></list>", "x"), ("<output>```\nx\n```</output>", "```\nx\n```"), ('{"text": "<reply>y</reply>"}', "y"), ("", ""), (None, None), ("<result><request>q</request><reply>z", "z"), ("a <list> b", "a <list> b"),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, x string").select("i", prompts.normalized_answer(F.col("x")).alias("y"))
    assert [r.y for r in df.orderBy("i").collect()] == [w for _, w in cases]


def test_bold_and_notes(spark):
    runs = lambda s: [(r.text, r.bold) for r in one(spark, s, versions.bold_runs)]
    assert runs("a **b** c") == [("a ", False), ("b", True), (" c", False)] and runs("a ** b") == [("a ** b", False)] and runs("**a**b**c") == [("a", True), ("b**c", False)] and runs("") == []
