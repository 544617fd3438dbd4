"""The registered queries over the driver's tables, and the SQL that checks them.

The driver's texts hold no fillers, wake phrases or odd spacing, so queries add a fixed prefix or suffix on
both sides; otherwise a rule would pass without work.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, text, versions
from ..operators import history, vocabulary
from ..sources.documents import case_document, data_url_bytes, file_timestamp, read_vocabulary, table, vocabulary_document
from ..streaming import machines, tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "text")


_B = r"[^\p{L}\p{M}\p{N}_]"
_FILL = "|".join(sorted(text.FILLERS, key=lambda w: (-len(w), w)))
_INJECT = "'Um,  I uh uh ,think -- ' || text || ' ,, erm.  '"


@query()
def tidy_documents(spark, d):
    """Flagship: the whole cleanup over every document, counted by language."""
    docs = _docs(spark, d).withColumn("given", F.expr(_INJECT))
    tidied = docs.withColumn("tidied", text.tidy(F.col("given"), [("the the", "the"), ("think", "believe")]))
    return tidied.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("tidied") != F.col("given")).alias("changed"), F.sum(F.length("tidied")).alias("chars"))


@query(f"SELECT doc_id, md5(trim(regexp_replace({_INJECT}, '\\s+', ' ', 'g'))) AS tidied FROM documents")
def tidy_whitespace(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(text.normalize_whitespace(F.expr(_INJECT))).alias("tidied"))


@query(f"""SELECT doc_id, md5(regexp_replace(regexp_replace({_INJECT}, '(?i)(^|{_B})(?:{_FILL})($|{_B})', '\\1\\2', 'g'), '(?i)(^|{_B})(?:{_FILL})($|{_B})', '\\1\\2', 'g')) AS tidied FROM documents""")
def tidy_fillers(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(text.remove_fillers(F.expr(_INJECT))).alias("tidied"))


_PUNCT = _INJECT
# What the rules give for the text that the query injects, around texts in which only a run of marks, a weak mark before an end and white space can change.
for _p, _r in ((",\\s*,", " "), ("\\s+([,.;:!?])", "\\1"), ("[,.;:!?]+([,.;:!?])", "\\1"), ("[,;:]\\s*([.!?])", "\\1"), ("\\s+", " ")):
    _PUNCT = f"regexp_replace({_PUNCT}, '{_p}', '{_r}', 'g')"


@query(f"SELECT doc_id, md5({_PUNCT}) AS tidied FROM documents")
def tidy_punctuation(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(text.normalize_punctuation(F.expr(_INJECT))).alias("tidied"))


_REPEAT = "text"
for _w in text.COLLAPSIBLE:
    _REPEAT = rf"regexp_replace({_REPEAT}, '(?i)(^|{_B})({_w})(?:\s+{_w})+($|{_B})', '\1\2\3', 'g')"
# Words that repeat thousands of times in a row stand before every text.
@query(f"SELECT doc_id, md5('The (it is) ' || {_REPEAT}) AS tidied FROM documents")
def tidy_repeats(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(text.collapse_repeats(F.concat(F.lit("The " + "the " * 3000 + "(it IT it is is) "), "text"))).alias("tidied"))


@query("SELECT doc_id, md5('the What go-go ' || text) AS tidied FROM documents")
def tidy_stutters(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(text.collapse_stutters(F.concat(F.lit("th- the Wh— what go-go "), "text"))).alias("tidied"))


# A list of corrections for each turn: a note, one that repeats, and lines that are none.
_CORRECTIONS = "concat('plan  b -> Plan ', CAST(turn AS VARCHAR(9)), chr(10), '# note', chr(10), 'PLAN B => never', chr(10), 'of => OF', CAST(conv_id AS VARCHAR(20)), chr(10), 'broken line', chr(10), 'a -> b -> c', chr(10), 'and → AND', chr(10), ' -> x')"


@query("SELECT conv_id, turn, unnest([0, 3, 6])::INT AS ordinal, unnest(['plan b', 'of', 'and']) AS spoken, unnest(['Plan ' || turn, 'OF' || conv_id, 'AND']) AS replacement FROM (SELECT DISTINCT conv_id, turn FROM conversations)")
def corrections_parse(spark, d):
    texts = table(spark, d, "conversations").select("conv_id", "turn", F.expr(_CORRECTIONS.replace("VARCHAR(9)", "STRING").replace("VARCHAR(20)", "STRING")).alias("text"))
    return vocabulary.parse_corrections(texts, by=("conv_id", "turn"))


# A mark after each blank, so that neighbouring words do not share the blank between them.
_PAIRS = "regexp_replace(text, '(\\s)', '\\1' || chr(1), 'g')"
for _a, _b in (("of[\\s\\x01]+the", "OF-THE"), ("the", "THE"), ("and", "AND")):
    _PAIRS = f"regexp_replace({_PAIRS}, '(?i)(^|{_B}){_a}($|{_B})', '\\1{_b}\\2', 'g')"
_PAIRS = f"replace({_PAIRS}, chr(1), '')"


@query(f"SELECT doc_id, md5({_PAIRS}) AS fixed FROM documents")
def corrections_apply(spark, d):
    fixed = text.apply_corrections(F.col("text"), [("the", "THE"), ("of the", "OF-THE"), ("and", "AND")])
    return _docs(spark, d).select("doc_id", F.md5(fixed).alias("fixed"))


_LINES = "replace(coalesce(text, ''), ' ', chr(10))"
_NEW = "list_filter(string_split(lines, chr(10)), lambda x, i: trim(x) <> '' AND lower(trim(x)) NOT IN ('the', 'of') AND list_position(keys, lower(trim(x))) = i)"


@query(f"""SELECT conv_id, turn, len({_NEW}) AS added, md5(CASE WHEN len({_NEW}) = 0 THEN E'\\nThe\\n of \\n' ELSE E'The\\n of' || chr(10) || array_to_string({_NEW}, chr(10)) END) AS merged
FROM (SELECT *, list_transform(string_split(lines, chr(10)), lambda x: lower(trim(x))) AS keys FROM (SELECT conv_id, turn, {_LINES} AS lines FROM conversations))""")
def corrections_merge(spark, d):
    turns = table(spark, d, "conversations").withColumn("m", text.merged_corrections(F.lit("\nThe\n of \n"), F.expr(_LINES)))
    return turns.select("conv_id", "turn", F.col("m.added").cast("long").alias("added"), F.md5("m.text").alias("merged"))


_SPOKEN = "CASE turn % 4 WHEN 0 THEN '  Hey, Juniper: ' || text WHEN 1 THEN 'juniper ' || text WHEN 2 THEN 'he june-iper! ' || text ELSE text END"
_GREET, _NAME, _FUZZY = ("hey", "he", "hay", "hi"), ("juniper",), ("june iper", "june-iper")
_SEP = r"[\s\p{P}\p{S}]"


@query(rf"""
WITH t AS (SELECT conv_id, turn, {_SPOKEN} AS s FROM conversations)
SELECT conv_id, turn,
  CASE WHEN regexp_matches(s, '(?i)^{_SEP}*(?:hey|hay|he|hi){_SEP}+(?:june iper|june-iper|juniper)($|{_SEP})') THEN 'greeting'
       WHEN regexp_matches(s, '(?i)^{_SEP}*(?:juniper)($|{_SEP})') THEN 'plain' END AS phrase,
  CASE WHEN regexp_matches(s, '(?i)^{_SEP}*(?:hey|hay|he|hi){_SEP}+(?:june iper|june-iper|juniper)($|{_SEP})') THEN md5(regexp_replace(s, '(?i)^{_SEP}*(?:hey|hay|he|hi){_SEP}+(?:june iper|june-iper|juniper){_SEP}*', ''))
       WHEN regexp_matches(s, '(?i)^{_SEP}*(?:juniper)($|{_SEP})') THEN md5(regexp_replace(s, '(?i)^{_SEP}*(?:juniper){_SEP}*', '')) END AS trailing
FROM t""")
def wake_detect(spark, d):
    found = text.wake_match(F.expr(_SPOKEN), _GREET, _NAME, _FUZZY, plain=True)
    return table(spark, d, "conversations").select("conv_id", "turn", found.alias("m")).select("conv_id", "turn", "m.phrase", F.md5("m.trailing").alias("trailing"))


_KEY = r"trim(regexp_replace(lower({0}), '[\p{{P}}\p{{S}}\s]+', ' ', 'g'))"
_CMD = "CASE turn % 3 WHEN 0 THEN 'Scratch, that!' WHEN 1 THEN 'delete-this…' ELSE text END"


@query(f"SELECT conv_id, turn, {_KEY.format(_CMD)} IN ('scratch that', 'scratch this', 'delete that', 'delete this') AS scratch FROM conversations")
def scratch_commands(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.is_scratch(F.expr(_CMD)).alias("scratch"))


_ENTER = "CASE WHEN turn % 2 = 0 THEN text || ', press enter.' ELSE text || ' press enter now' END"


@query(rf"""SELECT conv_id, turn, regexp_matches(s, '(?i)(?:^|[ \t\r\n,;:\-]+)press[ \t\r\n]+enter[\s\p{{P}}]*$') AS enter,
  md5(trim(regexp_replace(s, '(?i)(?:^|[ \t\r\n,;:\-]+)press[ \t\r\n]+enter[\s\p{{P}}]*$', ''), E' \t\r\n')) AS rest FROM (SELECT conv_id, turn, {_ENTER} AS s FROM conversations)""")
def trailing_command(spark, d):
    s = F.expr(_ENTER)
    return table(spark, d, "conversations").select("conv_id", "turn", text.has_enter_command(s).alias("enter"), F.md5(text.without_enter_command(s)).alias("rest"))


# Of each document its terms in order, with the last mark before each: of the gap, or else of the term before.
_PIECE = "[\\p{L}\\p{N}][\\p{L}\\p{N}''’._+-]{1,63}"
_CANDIDATES = f"""c AS (SELECT doc_id, t[i] AS term, i, coalesce(nullif(right(rtrim(g[i], E' \\n\\t\\r'), 1), ''), right(t[i - 1], 1), '.') AS prior, regexp_replace(t[i], '\\P{{L}}', '', 'g') AS letters
    FROM (SELECT doc_id, t, g, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{_PIECE}') AS t, string_split_regex(text, '{_PIECE}') AS g FROM documents))),
  k AS (SELECT doc_id, i, term FROM c WHERE letters <> '' AND lower(term) NOT LIKE 'http%' AND lower(term) NOT IN ({", ".join(f"'{w}'" for w in text.COMMON)})
    AND (regexp_matches(term, '[\\p{{Nd}}_+-]|^.+[\\p{{Lu}}\\p{{Lt}}]') OR regexp_matches(term, '[\\p{{Lu}}\\p{{Lt}}]') AND prior NOT IN ('.', '!', '?') OR regexp_matches(letters, '[\\p{{Lu}}\\p{{Lt}}].*[\\p{{Lu}}\\p{{Lt}}]') AND NOT regexp_matches(letters, '\\p{{Ll}}')))"""


@query(f"WITH {_CANDIDATES} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, term FROM k")
def candidate_terms(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(text.candidate_terms(F.col("text"))).alias("pos", "term"))


@query(f"""WITH {_CANDIDATES} SELECT key, count(DISTINCT doc_id) AS observations, CASE WHEN count(DISTINCT doc_id) >= 3 THEN 'active' ELSE 'suggested' END AS status FROM (SELECT doc_id, strip_accents(lower(term)) AS key FROM k) GROUP BY 1""")
def learn_terms(spark, d):
    return vocabulary.learned(vocabulary.observed(_docs(spark, d), "doc_id", "text"))


_TERMS = [("The", True, 5), ("of", False, 9), ("und", False, 9), ("les", True, 1), ("que", False, 0), ("Zebra", False, 9)]
_TERM_SQL = ", ".join(f"('{t}', {s}, {u})" for t, s, u in _TERMS)


def _entries(spark):
    return spark.createDataFrame([(t, s, u, "active", True) for t, s, u in _TERMS], "term string, starred boolean, usage_count int, status string, enabled boolean")


@query(rf"""SELECT term, count(*) AS uses FROM (VALUES {_TERM_SQL}) t(term, starred, usage) JOIN documents
  ON list_contains(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lower(term)) GROUP BY term""")
def usage_count(spark, d):
    return vocabulary.usage(_docs(spark, d), _entries(spark), "doc_id").where("uses > 0")  # the SQL lists used terms


_PHRASES = ["New York", "foo-bar", "v1.2", "O'Brien", "C++", "never used", "++", "a.b"]
_PHRASE_SQL = ", ".join("('" + t.replace("'", "''") + "')" for t in _PHRASES)
_PHRASED = "text || CASE doc_id % 5 WHEN 0 THEN ' New York, foo-bar (v1.2)' WHEN 1 THEN ' o''brien: foo-barn new  york xv1.2 axb' WHEN 2 THEN ' NEW YORKER new york. C++' WHEN 3 THEN ' v1.23 foo_foo-bar_' ELSE '' END"


@query(rf"""SELECT term, count(given) AS uses FROM (VALUES {_PHRASE_SQL}) t(term) LEFT JOIN (SELECT {_PHRASED} AS given FROM documents)
  ON regexp_matches(lower(given), '(^|[^\p{{L}}\p{{N}}])' || regexp_escape(lower(term)) || '($|[^\p{{L}}\p{{N}}])') GROUP BY term""")
def usage_phrases(spark, d):
    texts = _docs(spark, d).withColumn("text", F.expr(_PHRASED.replace("o''brien", r"o\'brien")))
    return vocabulary.usage(texts, spark.createDataFrame([(t,) for t in _PHRASES], "term string"), "doc_id")


@query(f"SELECT term, row_number() OVER (ORDER BY starred DESC, usage DESC, lower(term))::INT AS rank FROM (VALUES {_TERM_SQL}) t(term, starred, usage)")
def rank_terms(spark, d):
    return vocabulary.ranking(_entries(spark)).select("term", "rank")


_MACRO = "CASE turn % 3 WHEN 0 THEN 'My, Address!' WHEN 1 THEN 'sign-off' ELSE text END"


@query(rf"""SELECT conv_id, turn, CASE trim(regexp_replace(lower({_MACRO}), '\p{{P}}+', '', 'g')) WHEN 'my address' THEN 'one' WHEN 'signoff' THEN 'two' END AS payload FROM conversations""")
def macro_match(spark, d):
    macros = spark.createDataFrame([(0, "my address", "one"), (1, "Sign-off", "two"), (2, "signoff", "three"), (3, "!", "four")], "ordinal int, command string, payload string")
    texts = table(spark, d, "conversations").select("conv_id", "turn", F.expr(_MACRO).alias("text"))
    return vocabulary.macro_lookup(texts, macros).select("conv_id", "turn", "payload")


_CALL = "CASE turn % 4 WHEN 0 THEN 'Apply meeting notes.' WHEN 1 THEN 'shorten that' WHEN 2 THEN 'Meeting-Notes this' ELSE text END"


@query(f"""SELECT conv_id, turn, CASE WHEN k IN ('meeting notes', 'meeting notes that', 'meeting notes this', 'apply meeting notes') THEN 'Meeting-notes'
  WHEN k IN ('shorten', 'shorten that', 'shorten this', 'apply shorten') THEN 'Shorten' END AS name FROM (SELECT conv_id, turn, {_KEY.format(_CALL)} AS k FROM conversations)""")
def transform_match(spark, d):
    transforms = spark.createDataFrame([(0, "Meeting-notes"), (1, "Shorten"), (2, "shorten!")], "ordinal int, name string")
    texts = table(spark, d, "conversations").select("conv_id", "turn", F.expr(_CALL).alias("text"))
    return vocabulary.transform_lookup(texts, transforms).select("conv_id", "turn", "name")


@query("""SELECT 'Rule ' || page_id AS name, true AS built_in FROM pages WHERE page_id % 3 > 0 UNION ALL SELECT 'rule-' || page_id || '!', false FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT 'mine ' || page_id, false FROM pages WHERE page_id % 5 = 0""")
def transforms_resolved(spark, d):
    pages, n = table(spark, d, "pages"), F.col("page_id").cast("string")
    user = pages.where("page_id % 3 = 0").select(F.concat(F.lit("rule-"), n, F.lit("!")).alias("name")).unionAll(pages.where("page_id % 5 = 0").select(F.concat(F.lit("mine "), n)))
    return vocabulary.resolve_transforms(pages.select(F.concat(F.lit("Rule "), n).alias("name")), user)


_HIST = "SELECT event_id AS id, ts, user_id, CASE WHEN event_type = 'view' THEN '' ELSE props END AS clean, event_type AS raw FROM events"


def _history(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), "ts", "user_id", F.expr("CASE WHEN event_type = 'view' THEN '' ELSE props END").alias("clean"), F.col("event_type").alias("raw"))


@query(f"SELECT id, ts FROM ({_HIST}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id) <= 3")
def retain_latest(spark, d):
    return history.retain(_history(spark, d), 3, by=("user_id",)).select("id", "ts")


@query(f"SELECT id, ts FROM ({_HIST}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id) > 3")
def retain_dropped(spark, d):
    return history.dropped(_history(spark, d), 3, by=("user_id",)).select("id", "ts")


@query(f"SELECT id FROM ({_HIST}) ORDER BY ts DESC, id LIMIT 20")
def retain_top(spark, d):
    return history.retain(_history(spark, d), 20).select("id")


@query(f"""SELECT id, CASE WHEN t = '' THEN '(no transcript)' WHEN length(t) > 12 THEN left(t, 12) || '...' ELSE t END AS snippet
  FROM (SELECT id, trim(replace(coalesce(nullif(trim(clean), ''), trim(raw)), chr(10), ' ')) AS t FROM ({_HIST}))""")
def recent_snippets(spark, d):
    return _history(spark, d).select("id", text.snippet(rules.display_text(F.col("clean"), F.col("raw")), 12).alias("snippet"))


@query(f"SELECT id, ts, user_id, CASE WHEN id % 7 = 0 THEN NULL ELSE clean END AS clean, CASE WHEN id % 7 = 0 THEN 'retried' ELSE raw END AS raw FROM ({_HIST})")
def upsert_history(spark, d):
    h = _history(spark, d)
    changes = h.where("id % 7 = 0").select("id", F.lit(None).cast("string").alias("clean"), F.lit("retried").alias("raw"))
    return history.update(h, changes, ["clean", "raw"])


@query(f"SELECT id, raw FROM ({_HIST}) WHERE id % 5 = 0")
def delete_returning(spark, d):
    h = _history(spark, d)
    return history.delete(h, h.where("id % 5 = 0").select("id"), ["raw"])[1]


@query(f"""WITH h AS ({_HIST}) SELECT p.id AS probe_id, arg_max(h.id, (h.ts, h.id)) AS id, max(h.ts) AS ts FROM h p JOIN h
  ON p.user_id = h.user_id AND trim(h.clean) <> '' AND p.ts > h.ts AND p.ts - h.ts <= INTERVAL 2 HOUR GROUP BY p.id""")
def recent_lookup(spark, d):
    h = _history(spark, d)
    items = h.where("trim(clean) != ''").select("id", "ts", "user_id")
    return history.recent_item(h.select(F.col("id").alias("probe_id"), F.col("ts").alias("at"), "user_id"), items, ["user_id"], F.col("at") > F.col("ts"), 7200)


_APP = "['Slack','Mail','Terminal','Notes','WhatsApp','Safari'][(page_id % 6 + 1)::INT]"


@query(f"""SELECT page_id, CASE WHEN a LIKE '%slack%' OR a LIKE '%msteams%' OR a LIKE '%microsoft teams%' THEN 'workChat' WHEN a LIKE '%discord%' OR a LIKE '%whatsapp%' OR a LIKE '%telegram%' OR app = 'messages' THEN 'casualChat'
  WHEN app = 'mail' OR a LIKE '%outlook%' OR a LIKE '%gmail%' THEN 'email' WHEN regexp_matches(i, 'terminal|iterm|ghostty|warp|xcode|visual studio code|vscode|cursor|zed') THEN 'codeOrTerminal'
  WHEN regexp_matches(i, 'pages|notes|obsidian|notion|microsoft word') OR title LIKE '%google docs%' THEN 'document' ELSE 'neutral' END AS context,
  regexp_matches(a, 'obsidian|notion|bear|typora|ia writer|zettlr|logseq|github|gitlab|hackmd|stack overflow') AS markdown
  FROM (SELECT page_id, app, app || ' ' AS i, app || '  ' || title AS a, title FROM (SELECT page_id, lower({_APP}) AS app, lower(url) AS title FROM pages))""")
def classify_context(spark, d):
    app = F.get(F.array(*[F.lit(x) for x in ("Slack", "Mail", "Terminal", "Notes", "WhatsApp", "Safari")]), (F.col("page_id") % 6).cast("int"))
    none = F.lit(None).cast("string")
    return table(spark, d, "pages").select("page_id", rules.writing_context(app, none, F.col("url")).alias("context"), rules.markdown_surface(app, none, F.col("url")).alias("markdown"))


_OUT = "CASE turn % 6 WHEN 0 THEN text WHEN 1 THEN 'Certainly! ' || text WHEN 2 THEN left(text, 5) WHEN 3 THEN text || repeat('x', 2 * length(text) + 200) WHEN 4 THEN '# ' || text ELSE '' END"


@query(f"""SELECT conv_id, turn, CASE WHEN o = '' THEN 'empty output' WHEN starts_with(lower(o), 'certainly') THEN 'assistant-style response' WHEN length(o) > greatest(2 * n, n + 200) THEN 'unexpectedly expanded the transcript'
  WHEN length(o) * 2 < n THEN 'dropped most of the transcript' WHEN starts_with(trim(o), '#') AND NOT starts_with(trim(text), '#') AND NOT regexp_matches(lower(text), 'code block|code fence|heading|quote|markdown') THEN 'wrapped the transcript in markdown' END AS rejection
  FROM (SELECT *, {_OUT} AS o, greatest(length(text), 1) AS n FROM conversations)""")
def validate_output(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", rules.rejection(F.expr(_OUT), F.col("text")).alias("rejection"))


_ROUTE = "CASE turn % 3 WHEN 0 THEN 'replace_previous' || chr(10) || text WHEN 1 THEN 'INSERT' || chr(10) || ' ' || text ELSE text END"


@query(f"SELECT conv_id, turn, turn % 3 = 0 AS replaces, CASE WHEN turn % 3 < 2 THEN md5(trim(text, E' \\n')) ELSE md5(text) END AS routed FROM conversations")
def parse_route(spark, d):
    raw = F.expr(_ROUTE)
    return table(spark, d, "conversations").select("conv_id", "turn", rules.replaces_previous(raw).alias("replaces"), F.md5(rules.routed_text(raw)).alias("routed"))


# Answers as objects: one key, an unknown key, two keys in any case, fenced, a key that holds no text, and plain ones.
@query("""SELECT conv_id, turn, md5(CASE turn % 6 WHEN 1 THEN '{"name": ' || conv_id || '}' WHEN 4 THEN '{"text": ' || conv_id || '}' ELSE trim(text, E' \\t\\r\\n') END) AS unwrapped FROM conversations""")
def unwrap_json(spark, d):
    i, said, chat = F.col("turn") % 6, F.col("text"), F.col("conv_id").cast("string")
    one = F.to_json(F.struct(F.concat(F.lit(" "), said, F.lit("\n")).alias("cleaned_text")))
    raw = (
        F.when(i == 0, F.concat(F.lit("\n"), one)).when(i == 1, F.concat(F.lit('{"name": '), chat, F.lit("}"))).when(i == 2, F.to_json(F.struct(F.lit("y").alias("result"), said.alias("Text"))))
        .when(i == 3, F.concat(F.lit("```json\n"), one, F.lit("\n```"))).when(i == 4, F.concat(F.lit('{"text": '), chat, F.lit("}"))).otherwise(F.concat(said, F.lit(" \n")))
    )
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(rules.unwrap(raw)).alias("unwrapped"))


# The word that the speaker said last is dropped from every third text.
@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 1 AND length(text) * 2 < length(text) + 11 THEN 'dropped most of the transcript' WHEN turn % 3 = 1 THEN 'dropped the spoken word "zznever"' WHEN turn % 3 = 2 THEN 'dropped the spoken word "zznot"' END AS rejection
  FROM conversations""")
def validate_kept(spark, d):
    source = F.concat("text", F.lit(" zznever zznot"))
    output = F.when(F.col("turn") % 3 == 0, source).when(F.col("turn") % 3 == 1, F.concat("text", F.lit("..."))).otherwise(F.concat("text", F.lit(", ZZNEVER said")))
    return table(spark, d, "conversations").select("conv_id", "turn", rules.rejection(output, source, ("zznot", "zznever", "zzunsaid")).alias("rejection"))


_BEFORE = "lag(text) OVER (PARTITION BY conv_id ORDER BY turn)"


@query(f"""SELECT conv_id, turn, coalesce(b <> '' AND NOT ends_with(b, '.') AND NOT ends_with(b, '!') AND NOT ends_with(b, '?') AND NOT ends_with(b, '…'), false) AS continues
  FROM (SELECT conv_id, turn, regexp_replace(trim({_BEFORE}), '["''”’)\\]]+$', '') AS b FROM conversations)""")
def caret_continues(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.expr(_BEFORE).alias("b"))
    return rows.select("conv_id", "turn", rules.caret_continues(F.col("b")).alias("continues"))


_LETTERS = "[\\p{L}\\p{N}''’]"


@query(f"""WITH b AS (SELECT conv_id, turn, text, b, coalesce(regexp_extract(b, '\\S+ \\S+ \\S+$'), '') || ', ' || text AS joined, coalesce(NOT regexp_matches(b, '[\\n\\r]\\s*$') AND scan <> '' AND NOT regexp_matches(scan, '[.!?…]$'), false) AS goes_on
    FROM (SELECT *, regexp_replace(trim(b, E' \\n\\t\\r'), '["''”’)\\]]+$', '') AS scan FROM (SELECT conv_id, turn, text, {_BEFORE} AS b FROM conversations))),
  w AS (SELECT *, regexp_extract_all(lower(coalesce(b, '')), '{_LETTERS}+') AS x, regexp_extract_all(lower(joined), '{_LETTERS}+') AS y, regexp_extract(text, '^[\\p{{L}}''’]+') AS first FROM b),
  k AS (SELECT *, coalesce(list_max(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[len(x) - i + 1:len(x)] = y[1:i])), 0) AS k FROM w),
  r AS (SELECT *, CASE WHEN k >= 3 OR (k >= 2 AND k = len(x)) THEN nullif(regexp_replace(regexp_replace(joined, '^(?:[^' || substr('{_LETTERS}', 2) || '*{_LETTERS}+){{' || k || '}}', ''), '^[\\s,;:—–-]+', ''), '') END AS rest, trim(b) <> '' AND text <> '' AND NOT regexp_matches(substr(first, 2), '\\p{{Lu}}') AS usable FROM k)
SELECT conv_id, turn, md5(coalesce(rest, joined)) AS stripped,
  md5(CASE WHEN usable AND goes_on AND regexp_matches(text, '^\\p{{Lu}}') AND list_contains(regexp_extract_all(text, '[\\p{{L}}''’]+'), lower(first)) THEN lower(left(text, 1)) || substr(text, 2) WHEN usable AND NOT goes_on AND regexp_matches(text, '^\\p{{Ll}}') THEN upper(left(text, 1)) || substr(text, 2) ELSE text END) AS cased FROM r""")
def seam_strip(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", F.expr(_BEFORE).alias("b"))
    joined = F.concat(F.coalesce(F.regexp_extract("b", r"\S+ \S+ \S+$", 0), F.lit("")), F.lit(", "), F.col("text"))
    return rows.select("conv_id", "turn", F.md5(rules.strip_repeated_prefix(joined, F.coalesce("b", F.lit("")))).alias("stripped"), F.md5(rules.harmonize_case(F.col("text"), F.col("text"), F.col("b"))).alias("cased"))


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 200) || chr(10) || '[…]' || chr(10) || right(text, 296) ELSE text END AS cut FROM documents")
def truncate_middle(spark, d):
    return _docs(spark, d).select("doc_id", text.truncate_middle(F.col("text"), 500).alias("cut"))


_TAGS = [("v1.2.3", "one"), ("1.10.0", "two"), ("v1.10.0-beta.2", "three"), ("1.10.0-beta.11", "four"), ("1.10.0-beta.rc", "five"), ("bad", "six"), ("1.2", "seven"), ("2.0.0+b-1", "eight")]


@query("SELECT * FROM (VALUES ('v1.2.3', 1), ('v1.10.0-beta.2', 2), ('1.10.0-beta.11', 3), ('1.10.0-beta.rc', 4), ('1.10.0', 5), ('2.0.0+b-1', 6)) t(tag, place)")
def semver_sort(spark, d):
    rows = spark.createDataFrame(_TAGS, "tag string, body string").withColumn("v", versions.semver(F.col("tag"))).where("v is not null")
    ordered = rows.agg(F.array_sort(F.collect_list(F.struct("v", "tag"))).alias("all"))  # eight literal rows
    return ordered.select(F.posexplode("all").alias("place", "x")).select("x.tag", (F.col("place") + 1).alias("place"))


@query("SELECT 'eight' || chr(10) || chr(10) || 'two' || chr(10) || chr(10) || 'five' AS notes")
def release_notes(spark, d):
    return versions.release_notes(spark.createDataFrame(_TAGS, "tag string, body string"), versions.semver(F.lit("1.10.0-beta.11")))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), 6) AS rms FROM embeddings")
def rms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(machines.rms(F.col("embedding")), 6).alias("rms"))


@query()
def level_fold(spark, d):
    return table(spark, d, "embeddings").select("vec_id", machines.level_curve(F.transform("embedding", lambda x: F.abs(x))).alias("levels"))


@query(rf"""WITH RECURSIVE t AS (SELECT conv_id, turn, regexp_matches({_SPOKEN}, '(?i)^{_SEP}*(?:hey|hay|he|hi){_SEP}+(?:june iper|june-iper|juniper)($|{_SEP})') AS woken, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
  r AS (SELECT conv_id, 0::BIGINT AS i, NULL::BIGINT AS since, NULL::BIGINT AS turn, false AS said FROM t GROUP BY 1
    UNION ALL SELECT t.conv_id, t.i, CASE WHEN since IS NULL AND woken THEN t.turn WHEN since IS NOT NULL AND NOT woken AND t.turn - since >= 1 THEN NULL ELSE since END, t.turn, since IS NULL AND woken
    FROM r JOIN t ON t.conv_id = r.conv_id AND t.i = r.i + 1)
SELECT conv_id, turn, 'greeting' AS output FROM r WHERE said""")
def wake_latch(spark, d):
    spoken = table(spark, d, "conversations").select("conv_id", "turn", F.col("turn").cast("double").alias("at"), text.wake_match(F.expr(_SPOKEN), _GREET, _NAME, _FUZZY)["phrase"].alias("phrase"))
    return machines.fold(spoken, "conv_id", ["turn"], machines.wake_latch)


SESSION = tables.compiled(machines.dictation_session, {f"{kind}:{busy}": {"event": kind, "busy": busy} for kind in ("holdActivated", "holdDeactivated", "toggleActivated", "toggleDeactivated") for busy in (False, True)})


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_id % 11 = 0 AS busy,
    CASE event_type WHEN 'click' THEN 'hold on' WHEN 'view' THEN 'hold off' WHEN 'signup' THEN 'toggle off' ELSE 'toggle on' END AS k FROM events),
  r AS (SELECT user_id, 0::BIGINT AS i, 'idle' AS s, NULL::BIGINT AS event_id, NULL::VARCHAR AS output FROM e GROUP BY 1
    UNION ALL SELECT e.user_id, e.i,
      CASE WHEN s = 'idle' THEN CASE WHEN busy THEN 'idle' WHEN k = 'hold on' THEN 'hold' WHEN k = 'toggle on' THEN 'toggle' ELSE 'idle' END
        WHEN s = 'hold' THEN CASE k WHEN 'toggle on' THEN 'toggle' WHEN 'hold off' THEN 'idle' ELSE 'hold' END
        WHEN k = 'toggle off' THEN 'armed' WHEN s = 'armed' AND k = 'toggle on' THEN 'idle' ELSE s END,
      e.event_id,
      CASE WHEN s = 'idle' THEN CASE WHEN busy THEN NULL WHEN k = 'hold on' THEN 'start:hold' WHEN k = 'toggle on' THEN 'start:toggle' END
        WHEN s = 'hold' THEN CASE k WHEN 'toggle on' THEN 'switchedToToggle' WHEN 'hold off' THEN 'stop' END
        WHEN s = 'armed' AND k = 'toggle on' THEN 'stop' END
    FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, event_id, output FROM r WHERE output IS NOT NULL""")
def session_machine(spark, d):
    kinds = F.create_map(*[F.lit(x) for x in ("click", "holdActivated", "view", "holdDeactivated", "purchase", "toggleActivated", "signup", "toggleDeactivated", "error", "toggleActivated")])
    symbol = F.concat(F.element_at(kinds, F.col("event_type")), F.when(F.col("event_id") % 11 == 0, ":True").otherwise(":False"))
    return tables.run(table(spark, d, "events"), "user_id", "event_id", symbol, SESSION)


@query("""SELECT event_id, CASE WHEN event_id % 5 = 3 THEN 'Bad file ' || event_id WHEN event_id % 5 < 2 AND event_id % 2 = 0 THEN 'Request timed out — try again' ELSE 'No internet — check connection' END AS message FROM events""")
def error_messages(spark, d):
    i, n = F.col("event_id") % 5, F.col("event_id").cast("string")
    code = F.when(i == 0, "timedOut").when(i == 3, "other").when(i == 4, "cannotFindHost")
    said = F.when(i == 1, F.concat(F.lit("The request timed out, "), n)).when(i == 2, F.concat(F.lit("You appear offline "), n)).when(i == 3, F.concat(F.lit("Bad file "), n)).otherwise("x")
    return table(spark, d, "events").select("event_id", rules.error_message(code, said, F.col("event_id") % 2 == 0).alias("message"))


@query("SELECT event_id, n >= 2 AS bindable, CASE WHEN n < 2 THEN 'Unsupported button' WHEN n = 2 THEN 'Middle Button' ELSE 'Button ' || (n + 1) END AS label, CASE WHEN n >= 2 THEN n ELSE 3 END AS normalized FROM (SELECT event_id, (event_id % 6)::INT AS n FROM events)")
def mouse_buttons(spark, d):
    return table(spark, d, "events").select("event_id", rules.mouse_button((F.col("event_id") % 6).cast("int")).alias("b")).select("event_id", "b.*")


@query("SELECT event_id, (s // 60)::BIGINT || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS shown FROM (SELECT event_id, floor(value)::BIGINT AS s FROM events)")
def durations(spark, d):
    return table(spark, d, "events").select("event_id", text.duration(F.col("value")).alias("shown"))


@query(f"SELECT id, CASE WHEN trim(raw) <> '' AND trim(clean) <> '' AND trim(raw) <> trim(clean) THEN trim(raw) END AS target FROM ({_HIST})")
def raw_revert(spark, d):
    return _history(spark, d).select("id", rules.revert_target(F.col("raw"), F.col("clean")).alias("target"))


@query("SELECT user_id, event_type || ' “' || event_id || '”' AS term, event_id % 3 = 0 AS starred, (event_id % 7)::INT AS usageCount FROM events")
def vocabulary_round_trip(spark, d):
    """A document for each user, written and read back."""
    i = F.col("event_id")
    entries = table(spark, d, "events").select("user_id", F.concat("event_type", F.lit(" “"), i.cast("string"), F.lit("”")).alias("term"), F.when(i % 3 == 0, True).alias("starred"), F.when(i % 7 > 0, i % 7).cast("int").alias("usageCount"))
    return read_vocabulary(vocabulary_document(entries, by=("user_id",)), by=("user_id",)).select("user_id", "term", "starred", "usageCount")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H-%M-%SZ') AS stamp FROM events")
def file_timestamps(spark, d):
    return table(spark, d, "events").select("event_id", file_timestamp(F.col("ts")).alias("stamp"))


@query("SELECT event_id, props AS decoded FROM events")
def data_urls(spark, d):
    url = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("props", "UTF-8")))
    return table(spark, d, "events").select("event_id", F.decode(data_url_bytes(url), "UTF-8").alias("decoded"))


@query("""SELECT event_id AS id, '{"id":"' || event_id || '","ts":"' || ts || '","raw":"' || event_type || '","clean":"' || CASE WHEN event_type = 'view' THEN '' ELSE replace(props, '"', '\\"') END || '"}' AS "case" FROM events""")
def case_export(spark, d):
    return _history(spark, d).select("id", case_document(["id", "ts", "raw"], ["clean"]).alias("case"))


# Utterances of every outcome in turn: (kind, and what it takes to get there).
_I = "(conv_id * 7 + turn) % 14"
_LATE, _TIMES = "timed out", "CASE (conv_id * 7 + turn) % 14 WHEN 4 THEN 9.0 WHEN 6 THEN 3.9 WHEN 7 THEN 4.1 WHEN 10 THEN 5.1 WHEN 11 THEN 4.9 ELSE 1.0 END"
_UTTER = f"CASE {_I} WHEN 0 THEN ' ' WHEN 1 THEN 'My address.' WHEN 2 THEN 'um, so the the plan is ' || conv_id WHEN 4 THEN 'uh well the the plan is ' || conv_id WHEN 9 THEN 'hey juniper, make it rhyme' WHEN 10 THEN 'hey juniper, make it rhyme' WHEN 11 THEN 'hey juniper polish' WHEN 12 THEN 'Hi Juniper!' WHEN 13 THEN 'hey juniper polish' ELSE 'Plan ' || conv_id || ' is on track' END"


@query(f"""WITH u AS (SELECT conv_id, turn, {_I} AS i FROM conversations),
  o AS (SELECT *, ['empty', 'macro', 'basic', 'smart', 'fallback', 'exact', 'edit', 'edit_failed', 'edit_failed', 'wake', 'wake_failed', 'transform', 'wake_failed', 'wake_failed'][i + 1] AS kind FROM u)
SELECT conv_id, turn, kind,
  CASE WHEN i IN (4, 7, 10) THEN 'timed out' WHEN i = 12 THEN 'empty request' WHEN i = 13 THEN 'no recent dictation to transform' WHEN i = 8 THEN 'assistant-style response' END AS reason,
  md5(CASE i WHEN 0 THEN '' WHEN 1 THEN '1 Main St' WHEN 2 THEN 'so the plan is ' || conv_id WHEN 4 THEN 'well the plan is ' || conv_id WHEN 6 THEN 'Selected notes of chat ' || conv_id || ', shortened' WHEN 7 THEN 'Selected notes of chat ' || conv_id
    WHEN 8 THEN 'Selected notes of chat ' || conv_id WHEN 9 THEN 'A rhyme in time ' || conv_id WHEN 10 THEN 'make it rhyme' WHEN 11 THEN 'Polished dictation ' || conv_id WHEN 12 THEN '' WHEN 13 THEN '' ELSE 'Plan ' || conv_id || ' is on track' END) AS text,
  i IN (9, 11) AS replaces,
  CASE i WHEN 0 THEN 'Skipped macros and post-processing for empty raw transcript' WHEN 1 THEN 'Voice macro used: My address.' WHEN 2 THEN 'Basic on-device cleanup used' WHEN 3 THEN 'Smart on-device cleanup succeeded (1.00s)'
    WHEN 4 THEN 'Smart cleanup unavailable; basic cleanup used (timed out)' WHEN 5 THEN 'Preserved exact wording, skipped post-processing' WHEN 6 THEN 'Edit mode succeeded (manual)' WHEN 7 THEN 'Edit mode failed, using selected text (manual)'
    WHEN 8 THEN 'Edit mode failed, using selected text (manual)' WHEN 9 THEN 'greeting command succeeded (1.00s)' WHEN 10 THEN 'greeting command unavailable; pasted request (timed out)' WHEN 11 THEN 'Transform “polish” applied (4.90s)'
    WHEN 12 THEN 'greeting command unavailable; pasted request (empty request)' ELSE 'greeting command unavailable; pasted request (no recent dictation to transform)' END AS status
FROM o""")
def route_utterances(spark, d):
    """Every outcome, with budgets met and missed, a refused edit and a transform without a text."""
    from ..operators import router

    i = (F.col("conv_id") * 7 + F.col("turn")) % 14
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    chat = F.col("conv_id").cast("string")
    selected = F.when(i.isin(6, 7, 8), said("Selected notes of chat ", chat))
    previous = F.when(i.isin(9, 10, 11), said("Some dictation ", chat)).when(i == 13, "  ")
    output = (
        F.when(i == 6, said("<output>", selected, ", shortened</output>")).when(i == 8, "I'm sorry, as an AI I cannot do that.").when(i == 9, said("REPLACE_PREVIOUS\n", "A rhyme in time ", chat))
        .when(i == 11, said("Polished dictation ", chat)).otherwise(said("Plan ", chat, " is on track"))
    )
    u = table(spark, d, "conversations").select(
        "conv_id", "turn", F.expr(_UTTER).alias("transcript"), F.when(i.isin(6, 7, 8), "command:manual").otherwise("dictation").alias("intent"),
        F.when(i == 2, "basic").when(i == 5, "exact").otherwise("smart").alias("mode"), output.alias("model_output"), F.expr(_TIMES).cast("double").alias("model_elapsed"), selected.alias("selected_text"), previous.alias("previous_text"),
    )
    wake = text.wake_match(F.col("transcript"), _GREET, _NAME)
    u = u.withColumns({"wake": wake, "macro": F.when(text.macro_key(F.col("transcript")) == "my address", "1 Main St"), "transform": F.when(text.macro_key(wake["trailing"]) == "polish", "polish")})
    return router.route(u).select("conv_id", "turn", "outcome.kind", "outcome.reason", F.md5("outcome.text").alias("text"), "outcome.replaces", "status")


@query("""SELECT page_id, md5('Window: ' || left(url, 20) || chr(10) || '<transcript>' || chr(10) || html || chr(10) || '</transcript>') AS prompt FROM pages""")
def prompts(spark, d):
    from ..operators import router

    parts = [("App", F.lit(" "), 100), ("Window", F.col("url"), 20), ("Vocabulary", router.vocabulary_hint(F.lit(" , \n")), None)]
    return table(spark, d, "pages").select("page_id", F.md5(router.prompt(parts, "transcript", F.col("html"))).alias("prompt"))


# Bindings of an event's number: eight of one key each, every ninth of another kind.
@query("""WITH b AS (SELECT event_id AS id, CASE WHEN event_id % 9 = 0 THEN 'modifierKey' ELSE 'key' END AS kind, event_id // 8 AS code, event_id * 5 % 32 AS modifiers FROM events)
SELECT DISTINCT x.id AS a, y.id AS b FROM b x JOIN b y ON x.id < y.id AND x.kind = y.kind AND x.code = y.code JOIN range(32) r(m)
  ON (m & x.modifiers) = x.modifiers AND (m & y.modifiers) = y.modifiers AND bit_count(x.modifiers) = bit_count(y.modifiers)""")
def shortcut_conflicts(spark, d):
    from ..functions import shortcuts

    i = F.col("event_id")
    return shortcuts.conflicts(table(spark, d, "events").select(i.alias("id"), F.when(i % 9 == 0, "modifierKey").otherwise("key").alias("kind"), F.floor(i / 8).alias("code"), (i * 5 % 32).cast("int").alias("modifiers")))


@query("""SELECT event_id, m, list_sort(list_filter([55, 54, 59, 62, 58, 61, 56, 60, 63], lambda c: (m & CASE WHEN c IN (54, 55) THEN 1 WHEN c IN (59, 62) THEN 2 WHEN c IN (58, 61) THEN 4 WHEN c IN (56, 60) THEN 8 ELSE 16 END) <> 0))::VARCHAR AS codes,
  bit_count(m)::INT AS spec, (m & 3) = 3 AS held, m AS back FROM (SELECT event_id, (event_id % 32)::INT AS m FROM events)""")
def modifier_masks(spark, d):
    from ..functions import shortcuts

    m = F.col("m")
    rows = table(spark, d, "events").select("event_id", (F.col("event_id") % 32).cast("int").alias("m"))
    codes = shortcuts.codes_of(m)
    shown = F.concat(F.lit("["), F.array_join(F.array_sort(codes).cast("array<string>"), ", "), F.lit("]"))
    return rows.select("event_id", "m", shown.alias("codes"), shortcuts.specificity(m).cast("int").alias("spec"), shortcuts.contains_modifiers(m, F.lit(3)).alias("held"), shortcuts.mask_of(codes).alias("back"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'none' WHEN event_id % 3 = 0 THEN 'none' WHEN ts > TIMESTAMP '2024-01-02' AND event_id % 2 = 0 THEN 'wait' WHEN event_id % 7 = 0 AND event_id % 2 = 0 THEN 'none' ELSE 'offer' END AS decision FROM events""")
def update_decision(spark, d):
    i = F.col("event_id")
    tag = F.when(i % 5 == 0, "bad").when(i % 3 == 0, "v1.0.0").when(i % 7 == 0, "v1.7.0").otherwise("v1.2.0")
    now = F.lit("2024-01-05").cast("timestamp_ntz")
    decided = versions.update_decision(versions.semver(tag), versions.semver(F.lit("1.1.0")), tag, F.lit("v1.1.0"), F.col("ts"), now, F.lit("v1.7.0"), i % 2 == 1)
    return table(spark, d, "events").select("event_id", decided.alias("decision"))


@query("SELECT event_id, list_transform([0.35, 0.55, 0.75, 0.9, 1.0, 0.9, 0.75, 0.55, 0.35], lambda m: least(round(value / 100, 4) * m::DOUBLE, 1.0)) [5] AS middle FROM events")
def level_bars(spark, d):
    from ..functions import shortcuts

    return table(spark, d, "events").select("event_id", F.get(shortcuts.bars(F.round(F.col("value") / 100, 4)), F.lit(4)).alias("middle"))


from . import captured, chains, devices, editing, prompting, records, releases, stored  # noqa: E402, F401  the rest of the queries
