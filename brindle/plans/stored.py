"""Queries on what is stored: vocabularies, shortcuts, intents; and on trees of screen elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, shortcuts
from ..sources.documents import table
from ..sources.snapshots import read_stored
from ..streaming import sessions
from .catalogue import query

# A blob an event: none, broken, of the wrong kind, with a bad entry, old (no stars and uses), new with two entries.
_ENTRY = '{"id":"i%s","term":"t%s","source":"%s","status":"active","isEnabled":true,"observationCount":%s,%s"createdAt":"2024-01-01T00:00:00Z","updatedAt":"2024-01-02T00:00:00Z"}'


def _blob(n):
    entry = lambda source, more: F.format_string(_ENTRY, F.col("event_id"), F.col("event_id"), F.lit(source), F.col("event_id") % 9, F.lit(more))
    new = entry("manual", '"starred":true,"usageCount":7,')
    return (
        F.when(n == 1, F.concat(F.lit("["), F.left(new, F.lit(60)))).when(n == 2, '{"entries": 1}').when(n == 3, F.concat(F.lit("["), new, F.lit(","), entry("guessed", ""), F.lit("]")))
        .when(n == 4, F.concat(F.lit("["), entry("learned", ""), F.lit("]"))).when(n == 5, F.concat(F.lit("["), new, F.lit(","), entry("learned", '"unknown":[1],'), F.lit("]"))).when(n == 6, "[]")
    )


@query("""SELECT event_id, n IN (1, 2, 3) AS broken, CASE WHEN n = 4 THEN 'i' || event_id || ' learned false 0' WHEN n = 5 THEN 'i' || event_id || ' manual true 7,i' || event_id || ' learned false 0' ELSE '' END AS entries,
  CASE WHEN n = 4 THEN 1 WHEN n = 5 THEN 2 ELSE 0 END * (event_id % 9) AS observations FROM (SELECT event_id, event_id % 7 AS n FROM events)""")
def stored_vocabularies(spark, d):
    """Old, new and broken blobs in one read."""
    blobs = table(spark, d, "events").select("event_id", _blob(F.col("event_id") % 7).alias("blob"))
    shown = F.transform("entries", lambda e: F.concat_ws(" ", e.id, e.source, e.starred.cast("string"), e.usageCount.cast("string")))
    uses = F.aggregate("entries", F.lit(0).cast("long"), lambda a, e: a + e.observationCount)
    return read_stored(blobs).select("event_id", "broken", F.array_join(shown, ",").alias("entries"), uses.alias("observations"))


_STORED = """CASE {0} WHEN 1 THEN '{{"keyCode":40' WHEN 2 THEN '{{"keyCode":40,"keyDisplay":"K","modifiers":1,"kind":"key"}}' WHEN 3 THEN '{{"keyCode":40,"keyDisplay":"K","modifiers":0,"kind":"key","exactModifierKeyCodes":[55,99]}}'
  WHEN 4 THEN '{{"keyCode":61,"keyDisplay":"R","modifiers":0,"kind":"modifierKey","preset":"rightOption"}}' WHEN 5 THEN '{{"keyCode":40,"keyDisplay":"K","modifiers":1,"kind":"chord"}}' END"""
_ROLES = {"hold": "event_id % 6", "toggle": "(event_id + event_id // 6) % 6", "copy_again": "(event_id + 2) % 6", "cancel": "(event_id // 7) % 6"}
_FALL = "CASE event_id % 4 WHEN 1 THEN 'modifierKey:61' WHEN 2 THEN 'key:96' ELSE 'modifierKey:63' END"
_TOLD = "CASE {0} WHEN 2 THEN 'key:40:1:' WHEN 3 THEN 'key:40:1:55' WHEN 4 THEN {2} ELSE {1} END"


@query(f"""SELECT event_id, {_TOLD.format(_ROLES["hold"], _FALL + " || ':0:'", "'modifierKey:61:0:'")} AS hold, {_TOLD.format(_ROLES["toggle"], _FALL + " || ':1:'", "'modifierKey:61:0:'")} AS toggle,
  {_TOLD.format(_ROLES["copy_again"], "'disabled:0:0:'", "'modifierKey:61:0:'")} AS copy_again, {_TOLD.format(_ROLES["cancel"], "'key:53:0:'", "'key:53:0:'")} AS cancel,
  {_ROLES["hold"]} NOT IN (2, 4) AS rewrite_hold, {_ROLES["toggle"]} NOT IN (2, 4) AS rewrite_toggle, {_ROLES["copy_again"]} = 3 AS rewrite_copy_again, {_ROLES["cancel"]} IN (3, 4) AS rewrite_cancel FROM events""")
def shortcut_configs(spark, d):
    """Stored shortcuts of four roles: none, broken, fine, to be normalised, a modifier key, of an unknown kind."""
    blobs = [F.expr(_STORED.format(n.replace("//", "DIV"))) for n in _ROLES.values()]
    preset = F.when(F.col("event_id") % 4 == 1, "rightOption").when(F.col("event_id") % 4 == 2, "f5").when(F.col("event_id") % 4 == 3, "none such")
    found = table(spark, d, "events").select("event_id", shortcuts.stored_configuration(*blobs, preset).alias("c")).select("event_id", "c.*")
    told = lambda r: F.concat_ws(":", F.col(f"{r}.kind"), F.col(f"{r}.code").cast("string"), F.col(f"{r}.modifiers").cast("string"), F.coalesce(F.array_join(F.col(f"{r}.exact").cast("array<string>"), ","), F.lit(""))).alias(r)
    return found.select("event_id", *map(told, _ROLES), *[f"rewrite_{r}" for r in _ROLES])


@query("SELECT id, CASE WHEN kind IN ('command:automatic', 'command:manual') AND selected IS NOT NULL THEN kind ELSE 'dictation' END AS intent FROM (SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'command:manual' WHEN 'view' THEN 'command:automatic' WHEN 'error' THEN 'other' ELSE 'dictation' END AS kind, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN '' ELSE event_type END AS selected FROM events)")
def restored_intents(spark, d):
    kind = F.when(F.col("event_type") == "click", "command:manual").when(F.col("event_type") == "view", "command:automatic").when(F.col("event_type") == "error", "other").otherwise("dictation")
    selected = F.when(F.col("event_id") % 3 == 1, "").when(F.col("event_id") % 3 == 2, F.col("event_type"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), rules.restored_intent(kind, selected).alias("intent"))


@query("SELECT page_id, url || CASE WHEN position('?' IN url) > 0 THEN '&' ELSE '?' END || 's=44' AS picture FROM pages")
def thumbnail_urls(spark, d):
    return table(spark, d, "pages").select("page_id", rules.thumbnail_url(F.col("url")).alias("picture"))


_HINTS = ["Hey Juniper", "Juniper", "Hey June Iper"]


@query("SELECT conv_id, turn, md5(CASE WHEN turn % 3 = 0 THEN terms WHEN terms = '' THEN hints ELSE terms || chr(10) || hints END) AS vocabulary FROM (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN '' ELSE text END AS terms, 'Hey Juniper' || chr(10) || 'Juniper' || chr(10) || 'Hey June Iper' AS hints FROM conversations)")
def speech_vocabularies(spark, d):
    terms = F.when(F.col("turn") % 4 == 0, "").otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(rules.recognition_terms(terms, _HINTS, F.col("turn") % 3 != 0)).alias("vocabulary"))


# A chat as a tree: turn n stands below turn (n - 1) // 2; every fifth text is one of two that repeat, every fourth element holds none.
_VALUE = "CASE WHEN turn % 5 = 0 THEN concat(' again ', CAST(turn % 2 AS VARCHAR(9)), ' ') ELSE concat('  ', text, chr(10), chr(10), chr(10), chr(10), 'end ', CAST(turn AS VARCHAR(9))) END"


@query(f"""WITH RECURSIVE e AS (SELECT conv_id, turn, CASE WHEN turn % 4 < 3 THEN trim({_VALUE}, E' \\n\\t\\r') END AS v FROM conversations),
  w AS (SELECT conv_id, turn, v, [turn] AS path FROM e WHERE turn = 0 UNION ALL SELECT e.conv_id, e.turn, e.v, list_append(path, e.turn) FROM w JOIN e ON e.conv_id = w.conv_id AND e.turn > 0 AND (e.turn - 1) // 2 = w.turn WHERE len(path) <= 3),
  o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY path) AS n FROM w), p AS (SELECT conv_id, v, min(n) AS n FROM o WHERE n <= 11 AND length(v) >= 2 GROUP BY 1, 2),
  u AS (SELECT *, coalesce(sum(length(v)) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM p),
  j AS (SELECT conv_id, trim(regexp_replace(string_agg(v, chr(10) ORDER BY n), '\\n{{3,}}', chr(10) || chr(10), 'g'), E' \\n\\t\\r') AS t FROM u WHERE used < 900 GROUP BY 1)
SELECT conv_id, md5(CASE WHEN length(t) > 700 THEN left(t, 280) || chr(10) || '[…]' || chr(10) || right(t, 416) ELSE t END) AS seen FROM j""")
def screen_trees(spark, d):
    turn = F.col("turn")
    elements = table(spark, d, "conversations").select("conv_id", turn.alias("id"), F.when(turn > 0, F.floor((turn - 1) / 2)).alias("parent"), turn.alias("pos"), F.when(turn % 4 < 3, "AXStaticText").otherwise("AXGroup").alias("role"), F.expr(_VALUE.replace("VARCHAR(9)", "STRING")).alias("value"))
    return sessions.screen_tree(elements, "conv_id", 700, 3, 10, 900).select("conv_id", F.md5("text").alias("seen"))
