"""Queries on keys, shortcuts, recordings, screens and clipboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import shortcuts
from ..sources.documents import table
from ..streaming import keys, sessions, tables
from .catalogue import query

# Key events of devices (users) from the events' numbers.
_KEYS = """SELECT user_id AS device_id, event_id AS seq, CASE WHEN event_id % 17 = 0 THEN 'backendReset' WHEN event_id % 13 = 0 THEN 'modifierSnapshot' WHEN event_id % 3 = 0 THEN 'keyChanged' ELSE 'modifierChanged' END AS kind,
  CASE WHEN event_id % 3 = 0 THEN 40 + CAST(event_id % 4 AS INT) ELSE CASE event_id % 5 WHEN 0 THEN 55 WHEN 1 THEN 54 WHEN 2 THEN 56 WHEN 3 THEN 61 ELSE 63 END END AS key_code, event_id % 7 < 5 AS is_down, event_id % 19 = 0 AS is_repeat FROM events"""
BINDINGS = [keys.Binding("hold", "key", 40, 1), keys.Binding("toggle", "key", 40, 9), keys.Binding("copyAgain", "modifierKey", 61, 1, (54, 55, 61))]


def _events(spark, d):
    table(spark, d, "events").createOrReplaceTempView("_key_events")
    return spark.sql(_KEYS.replace("FROM events", "FROM _key_events")).withColumn("snapshot", F.when(F.col("kind") == "modifierSnapshot", F.array(F.lit(55), F.lit(61))))


def _now(code, test):
    return f"coalesce(last_value(CASE WHEN {test} THEN is_down WHEN kind = 'backendReset' THEN false WHEN kind = 'modifierSnapshot' AND {code} > 50 THEN {code} IN (55, 61) END IGNORE NULLS) OVER w, false)"


_STATE = f"""k AS ({_KEYS}), s AS (SELECT *, {_now(40, "kind = 'keyChanged' AND key_code = 40 AND NOT is_repeat")} AS k40, {", ".join(f"{_now(c, f'kind = {chr(39)}modifierChanged{chr(39)} AND key_code = {c}')} AS m{c}" for c in (54, 55, 56, 61, 63))} FROM k
    WINDOW w AS (PARTITION BY device_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
  a AS (SELECT *, k40 AND (m54 OR m55) AS hold, k40 AND (m54 OR m55) AND m56 AS toggle, m61 AND (m54 OR m55) AND NOT m56 AND NOT m63 AS again FROM s),
  b AS (SELECT *, coalesce(lag(hold) OVER v, false) AS hold_, coalesce(lag(toggle) OVER v, false) AS toggle_, coalesce(lag(again) OVER v, false) AS again_ FROM a WINDOW v AS (PARTITION BY device_id ORDER BY seq)),
  e AS (SELECT *, list_filter([CASE WHEN toggle AND NOT toggle_ THEN 'toggleActivated' END, CASE WHEN hold AND NOT hold_ THEN 'holdActivated' END, CASE WHEN again AND NOT again_ THEN 'copyAgainTriggered' END,
    CASE WHEN hold_ AND NOT hold THEN 'holdDeactivated' END, CASE WHEN toggle_ AND NOT toggle THEN 'toggleDeactivated' END], lambda x: x IS NOT NULL) AS emitted FROM b)"""


@query(f"""WITH {_STATE} SELECT device_id, seq, array_to_string(emitted, ',') AS emitted, CASE kind WHEN 'keyChanged' THEN key_code = 40 AND (hold OR hold_ OR toggle OR toggle_) WHEN 'modifierSnapshot' THEN len(emitted) > 0
  WHEN 'modifierChanged' THEN (key_code IN (54, 55) AND (hold OR hold_)) OR (key_code IN (54, 55, 56) AND (toggle OR toggle_)) OR again OR again_ ELSE false END AS consumed FROM e""")
def shortcut_edges(spark, d):
    out = keys.shortcut_edges(_events(spark, d), BINDINGS)
    # copyAgain stands after hold in the list and has as many modifiers, so ties keep the order of the bindings
    return out.select("device_id", "seq", F.array_join("emitted", ",").alias("emitted"), "consumed")


@query(f"WITH {_STATE} SELECT device_id, seq, k40 OR m54 OR m55 OR m56 OR m61 AS held FROM s")
def shortcut_inputs(spark, d):
    out = keys.shortcut_edges(_events(spark, d), BINDINGS)
    return out.select("device_id", "seq", keys.pressed_inputs(BINDINGS, F.col("keys"), F.col("modifiers")).alias("held"))


_M = "(event_id % 32)::INT"
_KIND = "CASE event_id % 3 WHEN 0 THEN 'key' WHEN 1 THEN 'modifierKey' ELSE 'disabled' END"


@query(f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (event_id % 60)::INT ELSE 53 END AS code, event_id % 3 = 0 AND ({_M} & 9) = 9 AS cancels,
  CASE WHEN event_id % 5 = 0 THEN 'cancelTranscription' WHEN event_id % 2 = 0 OR event_id % 7 = 0 THEN 'cancelToggle' END AS action FROM events""")
def cancel_keys(spark, d):
    i = F.col("event_id")
    kind, code = F.expr(_KIND), (i % 60).cast("int")
    cancels = shortcuts.cancels(kind, code, F.lit(9), code, (i % 32).cast("int"))
    action = keys.cancel_action(i % 5 == 0, F.when(i % 2 == 0, "toggle"), F.when(i % 7 == 0, "toggle").otherwise("hold"))
    return table(spark, d, "events").select("event_id", shortcuts.cancel_code(kind, code).alias("code"), cancels.alias("cancels"), action.alias("action"))


_EXACT = "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN [55, 99] WHEN 2 THEN [54, 55] WHEN 3 THEN [61, 60] ELSE [63] END"


def _exact():
    i, none = F.col("event_id") % 5, F.lit(None).cast("array<int>")
    codes = lambda *c: F.array(*[F.lit(x) for x in c])
    return F.when(i == 0, none).when(i == 1, codes(55, 99)).when(i == 2, codes(54, 55)).when(i == 3, codes(61, 60)).otherwise(codes(63))


@query(f"""SELECT event_id, CASE WHEN event_id % 3 = 1 THEN m | CASE event_id % 5 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 8 WHEN 4 THEN 16 ELSE 0 END ELSE m | CASE event_id % 5 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 12 WHEN 4 THEN 16 ELSE 0 END END AS modifiers,
  CASE event_id % 5 WHEN 1 THEN '55' WHEN 2 THEN '55,54' WHEN 3 THEN '61,60' WHEN 4 THEN '63' END AS exact,
  CASE WHEN event_id % 3 = 2 THEN m ELSE m | 8 END AS more, CASE WHEN event_id % 3 = 2 THEN CASE event_id % 5 WHEN 1 THEN '55,99' WHEN 2 THEN '54,55' WHEN 3 THEN '61,60' WHEN 4 THEN '63' END ELSE CASE event_id % 5 WHEN 1 THEN '55,56,60' WHEN 2 THEN '55,54,56,60' WHEN 3 THEN '61,56,60' WHEN 4 THEN '56,60,63' END END AS sides
  FROM (SELECT event_id, {_M} AS m FROM events)""")
def binding_storage(spark, d):
    """Normalised and augmented bindings; key 61 is the modifier key's own code."""
    m, text = (F.col("event_id") % 32).cast("int"), lambda c: F.array_join(c.cast("array<string>"), ",")
    rows = table(spark, d, "events").select("event_id", F.expr(_KIND).alias("kind"), m.alias("m"), _exact().alias("exact"))
    n, a = shortcuts.normalized(F.col("kind"), F.lit(61), F.col("m"), F.col("exact")), shortcuts.augmented(F.col("kind"), F.col("m"), F.col("exact"), F.lit(8))
    return rows.select("event_id", n.alias("n"), a.alias("a")).select("event_id", "n.modifiers", text(F.col("n.exact")).alias("exact"), F.col("a.modifiers").alias("more"), text(F.col("a.exact")).alias("sides"))


_GENERAL = ["Cmd ⌘", "Ctrl ⌃", "Option ⌥", "Shift ⇧", "Fn 🌐"]


@query(f"""SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 5 IN (1, 2) OR m & 1 > 0 THEN 'Cmd ⌘' END, CASE WHEN m & 2 > 0 THEN 'Ctrl ⌃' END, CASE WHEN event_id % 5 = 3 THEN 'Right Option ⌥' WHEN m & 4 > 0 THEN 'Option ⌥' END,
  CASE WHEN event_id % 5 = 3 THEN 'Right Shift ⇧' WHEN m & 8 > 0 THEN 'Shift ⇧' END, CASE WHEN event_id % 5 = 4 OR m & 16 > 0 THEN 'Fn 🌐' END], lambda x: x IS NOT NULL), '+') AS names,
  CASE event_id % 6 WHEN 0 THEN 'Right Cmd ⌘' WHEN 1 THEN 'Space' WHEN 2 THEN 'A' WHEN 3 THEN 'ab' WHEN 4 THEN '' ELSE 'Fn 🌐' END AS label,
  concat_ws(':', 'key', m, m, 'p', CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '55,99' WHEN 2 THEN '54,55' WHEN 3 THEN '60,61' ELSE '63' END) AS id, CASE event_id % 6 WHEN 0 THEN 55 WHEN 5 THEN 63 ELSE 7 END AS canonical FROM (SELECT event_id, {_M} AS m FROM events)""")
def binding_labels(spark, d):
    i, m = F.col("event_id") % 6, (F.col("event_id") % 32).cast("int")
    code = F.when(i == 0, 54).when(i == 5, 63).otherwise(7)
    label = shortcuts.key_label(code, F.when(i == 1, "Space"), F.when(i == 2, " a").when(i == 3, "ab"))
    id_ = shortcuts.binding_id(F.lit("key"), m, m, F.lit("p"), _exact())
    return table(spark, d, "events").select("event_id", F.array_join(shortcuts.display_names(m, _exact()), "+").alias("names"), label.alias("label"), id_.alias("id"), shortcuts.canonical_code(code).alias("canonical"))


@query(f"""SELECT event_id, CASE WHEN event_id % 4 > 0 AND event_id % 7 > 0 THEN 'key:' || m || ':' || m END AS of_key, CASE WHEN m & 1 > 0 AND (event_id % 2 = 0 OR m & 30 > 0) THEN 'modifierKey:55:' || (m & 30) END AS of_modifier FROM (SELECT event_id, {_M} AS m FROM events)""")
def binding_capture(spark, d):
    """Bindings from key events; the pressed codes are all those of a mask."""
    i = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", (i % 32).cast("int").alias("m")).withColumn("pressed", shortcuts.codes_of(F.col("m")))
    code = F.when(i % 7 == 0, 60).otherwise(F.col("m"))
    a = shortcuts.binding_of_key(code, F.lit("x"), i % 4 == 0, F.col("pressed"))
    b = shortcuts.binding_of_modifier(F.lit(55), F.col("pressed"), i % 2 == 0)
    text = lambda x: F.concat_ws(":", x["kind"], x["code"].cast("string"), x["modifiers"].cast("string"))
    return rows.select("event_id", F.when(a.isNotNull(), text(a)).alias("of_key"), F.when(b.isNotNull(), text(b)).alias("of_modifier"))


# Any nine pressed and wanted modifier codes, by the bits of two numbers; the permitted modifiers by those of a third.
_NINE, _PAIRS = [55, 54, 59, 62, 58, 61, 56, 60, 63], {1: (55, 54), 2: (59, 62), 4: (58, 61), 8: (56, 60), 16: (63,)}
_PICK = "list_filter([55, 54, 59, 62, 58, 61, 56, 60, 63], lambda c, i: ({0} >> (i - 1)::INT) & 1 = 1)"
_EXACT = " AND ".join(
    f"CASE WHEN len(list_intersect(e, {list(c)})) = 0 THEN (free & {bit}) > 0 OR len(list_intersect(p, {list(c)})) = 0 WHEN len(list_intersect(e, {list(c)})) = 2 THEN len(list_intersect(p, {list(c)})) > 0 ELSE list_sort(list_intersect(e, {list(c)})) = list_sort(list_intersect(p, {list(c)})) END"
    for bit, c in _PAIRS.items()
)


@query(f"SELECT event_id, {_EXACT} AS exact FROM (SELECT event_id, {_PICK.format('(event_id % 512)::INT')} AS p, {_PICK.format('(CASE WHEN event_id % 3 = 0 THEN event_id ELSE event_id * 7 END % 512)::INT')} AS e, (event_id // 3 % 32)::INT AS free FROM events)")
def exact_modifiers(spark, d):
    """Every set of pressed modifiers, against itself and against others."""
    i = F.col("event_id")
    picked = lambda n: F.array_compact(F.array(*[F.when(F.shiftright(n, k).bitwiseAND(F.lit(1)) == 1, c) for k, c in enumerate(_NINE)]))
    pressed, wanted = picked((i % 512).cast("int")), picked((F.when(i % 3 == 0, i).otherwise(i * 7) % 512).cast("int"))
    return table(spark, d, "events").select("event_id", shortcuts.exact_match(pressed, wanted, (F.floor(i / 3) % 32).cast("int")).alias("exact"))


@query(f"""SELECT event_id, CASE WHEN event_id % 4 = 2 AND event_id % 5 = 0 THEN 'Cancel Dictation must use a regular key, optionally with modifiers.' WHEN event_id % 5 = 0 THEN NULL
  WHEN code = 40 THEN CASE event_id % 4 WHEN 1 THEN 'Hold and tap shortcuts must be distinct.' WHEN 2 THEN 'Cancel Dictation cannot share a shortcut with Hold to Talk.' WHEN 3 THEN 'Paste Again cannot share a shortcut with Hold to Talk.' END
  WHEN code = 41 THEN CASE event_id % 4 WHEN 0 THEN 'Hold and tap shortcuts must be distinct.' WHEN 2 THEN 'Cancel Dictation cannot share a shortcut with Tap to Toggle.' WHEN 3 THEN 'Paste Again cannot share a shortcut with Tap to Toggle.' END
  WHEN code = 42 THEN CASE event_id % 4 WHEN 3 THEN 'Paste Again cannot share a shortcut with Cancel Dictation.' WHEN 2 THEN NULL ELSE 'This shortcut is already used by Cancel Dictation.' END
  WHEN code = 43 THEN CASE WHEN event_id % 4 < 3 THEN 'This shortcut is already used by Paste Again.' END END AS message,
  CASE WHEN bit = 1 THEN 'That modifier is already part of the hold shortcut.' WHEN bit = 4 THEN 'That modifier is already the Paste Again shortcut.' END AS modifier FROM (SELECT event_id, 40 + (event_id % 6)::INT AS code, [1, 2, 4, 8][(event_id % 4 + 1)::INT] AS bit FROM events)""")
def shortcut_collisions(spark, d):
    i = F.col("event_id")
    binding = lambda kind, code, m: F.struct(F.lit(kind).alias("kind"), F.lit(code).alias("code"), F.lit(m).alias("modifiers"))
    taken = {"hold": binding("key", 40, 1), "toggle": binding("key", 41, 16), "cancel": binding("key", 42, 16), "copyAgain": binding("key", 43, 2)}
    of = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), (i % len(x) + 1).cast("int"))
    message = shortcuts.collision(of("hold", "toggle", "cancel", "copyAgain"), F.when(i % 5 == 0, "disabled").otherwise("key"), (i % 6 + 40).cast("int"), F.lit(16), taken)
    message = F.when(((i % 6 == 0) & (i % 4 == 0)) | ((i % 6 == 1) & (i % 4 == 1)), F.lit(None)).otherwise(message)  # a role's own binding
    manual = shortcuts.modifier_collision(of(1, 2, 4, 8), taken | {"copyAgain": binding("modifierKey", 58, 0)})
    return table(spark, d, "events").select("event_id", message.alias("message"), manual.alias("modifier"))


@query("SELECT event_id, event_id % 3 = 0 OR (event_id % 5 = 0 AND event_id % 2 = 0) AS restores, CASE WHEN event_id % 2 = 0 THEN event_type || '. ' ELSE event_type END AS pasted FROM events")
def clipboard_rules(spark, d):
    i = F.col("event_id")
    written = F.when(i % 2 == 0, F.concat("event_type", F.lit("."))).otherwise(F.col("event_type"))
    restores = sessions.may_restore(F.lit(1), F.when(i % 3 == 0, 1).otherwise(2), F.when(i % 5 == 0, F.concat("event_type", F.lit("."))), F.when(i % 2 == 0, written).otherwise("other"))
    return table(spark, d, "events").select("event_id", restores.alias("restores"), sessions.pasted(written).alias("pasted"))


@query("SELECT event_id, [54, 58, 63][1:CASE WHEN event_id % 3 = 0 THEN 3 ELSE 2 END]::VARCHAR AS codes FROM events")
def trusted_function_key(spark, d):
    i, given = F.col("event_id"), F.array(F.lit(54), F.lit(58))
    codes = keys.trusted_modifiers(F.when(i % 3 == 1, F.array_append(given, F.lit(63))).when(i % 3 == 0, F.array_append(given, F.lit(63))).otherwise(given), F.when(i % 3 == 1, False).when(i % 6 == 0, True))
    return table(spark, d, "events").select("event_id", F.concat(F.lit("["), F.array_join(codes.cast("array<string>"), ", "), F.lit("]")).alias("codes"))


@query("SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS known FROM events")
def carried_state(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("v"))
    return sessions.carried(rows, "user_id", "v").select("user_id", "event_id", "known")


# Sessions of users: ready at their first purchase, finished at their last click.
_SES = "s AS (SELECT user_id, min(ts) FILTER (event_type = 'purchase') AS ready, max(ts) FILTER (event_type = 'click') AS finished FROM events GROUP BY 1)"


def _sessions(spark, d):
    when = lambda kind: F.when(F.col("event_type") == kind, F.col("ts"))
    return table(spark, d, "events").groupBy("user_id").agg(F.min(when("purchase")).alias("ready"), F.max(when("click")).alias("finished"))


@query(f"WITH {_SES} SELECT event_id, user_id, greatest(ts, ready) AS at FROM events JOIN s USING (user_id) WHERE ready IS NOT NULL AND (finished IS NULL OR ts <= finished)")
def chunks_delivered(spark, d):
    return sessions.delivered(table(spark, d, "events").select("event_id", "user_id", "ts"), _sessions(spark, d), "user_id").select("event_id", "user_id", "at")


@query(f"WITH {_SES} SELECT user_id, trim(string_agg(event_type || ' ', '' ORDER BY event_id)) AS text FROM events JOIN s USING (user_id) WHERE finished IS NULL OR ts - finished <= INTERVAL 1 HOUR GROUP BY 1")
def final_texts(spark, d):
    parts = table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), "ts", F.concat("event_type", F.lit(" ")).alias("text"))
    return sessions.final_text(parts, _sessions(spark, d), "user_id", 3600.0)


@query("""SELECT event_id, CASE WHEN value > 50 OR event_id % 4 = 0 OR event_id % 5 = 0 THEN NULL ELSE event_type END AS output, CASE WHEN event_id % 5 = 0 AND 10 < least(CASE WHEN event_id % 4 = 0 THEN 50 ELSE value END, 50) THEN 'cancelled'
  WHEN event_id % 4 = 0 OR value > 50 THEN 'timed out' END AS failure FROM (SELECT * FROM events WHERE event_id % 5 > 0 OR value > 10)""")
def races(spark, d):
    i = F.col("event_id")
    rows = table(spark, d, "events").where("event_id % 5 > 0 or value > 10")
    won = sessions.first_done(F.when(i % 4 > 0, F.col("event_type")), F.when(i % 4 > 0, F.col("value")), F.lit(50.0), F.when(i % 5 == 0, 10.0))
    return rows.select("event_id", won.alias("r")).select("event_id", "r.output", "r.failure")


@query("""WITH r AS (SELECT user_id, min(ts) AS started, CASE WHEN user_id % 3 = 0 THEN 3600.0 ELSE 0.0 END AS off FROM events GROUP BY 1), b AS (SELECT user_id, min(ts) AS first FROM events WHERE event_type = 'error' GROUP BY 1)
  SELECT user_id, coalesce(epoch_us(first) - epoch_us(started) - off * 1000000 > 1800000000, true) AS failed FROM r LEFT JOIN b USING (user_id)""")
def watchdogs(spark, d):
    e = table(spark, d, "events")
    recordings = e.groupBy("user_id").agg(F.min("ts").alias("started")).withColumn("interrupted", F.when(F.col("user_id") % 3 == 0, 3600.0))
    return sessions.watchdog(recordings, e.where("event_type = 'error'"), "user_id", 1800.0).select("user_id", "failed")


@query("SELECT user_id, min(ts) AS ts FROM events WHERE value > 90 GROUP BY 1")
def first_sounds(spark, d):
    return sessions.first_sound(table(spark, d, "events").select("user_id", "ts", F.when(F.col("value") > 90, F.col("value")).otherwise(0.0).alias("rms")), "user_id")


_STARTS = "CASE event_type WHEN 'click' THEN 'start' WHEN 'view' THEN 'swap' ELSE 'stop' END"


@query(f"""WITH e AS (SELECT *, {_STARTS} AS event FROM events), n AS (SELECT *, (SELECT min((x.ts, x.event_id)) FROM e x WHERE x.user_id = e.user_id AND (x.ts, x.event_id) > (e.ts, e.event_id) AND x.event <> 'swap') AS stop FROM e WHERE event = 'start')
  SELECT user_id, ts, event_id, CASE WHEN EXISTS (SELECT 1 FROM e x WHERE x.user_id = n.user_id AND x.event = 'swap' AND (x.ts, x.event_id) > (n.ts, n.event_id) AND epoch_us(x.ts) - epoch_us(n.ts) < 36000000000 AND (stop IS NULL OR (x.ts, x.event_id) < stop)) THEN 'toggle' ELSE 'hold' END AS mode,
  ts + INTERVAL 10 HOUR AS at FROM n WHERE stop IS NULL OR epoch_us(stop[1]) - epoch_us(ts) >= 36000000000""")
def delayed_starts(spark, d):
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", F.expr(_STARTS).alias("event"), F.lit("hold").alias("mode"))
    return sessions.debounced(rows, "user_id", 36000.0)


@query("""SELECT conv_id, turn, CASE WHEN turn % 5 > 0 AND trim(right(left(text, 60), 20)) <> '' THEN right(left(text, 60), 20) END AS before, text <> '' AND turn % 3 > 0 AS near FROM conversations""")
def caret_texts(spark, d):
    t, k = F.col("text"), F.col("turn")
    near = sessions.ends_with_target(F.concat(F.lit("x "), t, F.when(k % 2 == 0, " ").otherwise("")), t, F.when(k % 3 == 0, 2).otherwise(0))
    return table(spark, d, "conversations").select("conv_id", "turn", sessions.before_caret(t, F.lit(60), k % 5 == 0, 20).alias("before"), near.alias("near"))


@query("SELECT page_id, md5(CASE WHEN length(url) >= 40 THEN url WHEN length(html) > coalesce(length(url), 0) THEN html ELSE url END) AS seen FROM pages")
def visible_texts(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(sessions.visible_text(F.col("url"), F.col("html"), 40)).alias("seen"))


@query("""WITH p AS (SELECT conv_id, trim(text) AS text, min(turn) AS pos FROM conversations WHERE length(trim(text)) >= 2 GROUP BY ALL), j AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY pos, text) AS text FROM p GROUP BY 1)
  SELECT conv_id, md5(CASE WHEN length(text) > 300 THEN left(text, 120) || chr(10) || '[…]' || chr(10) || right(text, 176) ELSE text END) AS seen FROM j""")
def screen_texts(spark, d):
    pieces = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"), "text")
    return sessions.screen_text(pieces, "conv_id", 300).select("conv_id", F.md5("text").alias("seen"))


@query("SELECT user_id, arg_max(event_id, (event_id % 50 * (event_id % 30), -event_id)) AS id FROM events WHERE event_id % 4 > 0 GROUP BY 1")
def largest_windows(spark, d):
    i = F.col("event_id")
    return sessions.largest_window(table(spark, d, "events").select("user_id", i.alias("id"), (i % 50).alias("width"), (i % 30).alias("height"), (i % 4 > 0).alias("on_screen")), "user_id")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value WHEN event_id % 3 = 1 THEN value + 1 END AS volume FROM events")
def volumes(spark, d):
    i, v = F.col("event_id"), F.col("value")
    channels = F.when(i % 3 == 1, F.array(v, v + 1)).otherwise(F.array().cast("array<double>"))
    return table(spark, d, "events").select("event_id", sessions.volume(F.when(i % 3 == 0, v), channels).alias("volume"))


@query("SELECT user_id, bit_or(1::BIGINT << (event_id % 40)::INT) AS mask FROM events GROUP BY 1")
def event_masks(spark, d):
    bits = table(spark, d, "events").select("user_id", F.expr("shiftleft(1L, cast(event_id % 40 as int))").alias("bit"))
    return sessions.event_mask(bits, ["user_id"])


@query("SELECT 'u' || user_id AS uid, arg_min(event_type || event_id, event_id) AS name FROM events WHERE event_id % 3 > 0 AND user_id % 5 > 0 GROUP BY 1")
def input_devices(spark, d):
    i = F.col("event_id")
    rows = table(spark, d, "events").select(F.when(F.col("user_id") % 5 > 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).otherwise(" ").alias("uid"), F.when(i % 3 > 0, F.concat("event_type", i.cast("string"))).otherwise("").alias("name"), i.alias("pos"))
    return sessions.devices(rows)


_BAR = "(0.22 * (0.5 + 0.5 * sin(t * 6.2 - {i} * 0.78)) + 0.06 * (0.5 + 0.5 * sin(t * 3.1 + {i} * 0.5)))"


@query(f"""SELECT event_id, round(least(a * (0.74 + {_BAR.format(i=2)}) + (1 - a) * (0.04 + 0.28 * {_BAR.format(i=2)}), 1.0), 6) AS third, round(pow(0.5 + 0.5 * sin(((t + 5 - 0.11) % 1.05) / 1.05 * 2 * pi() - pi() / 2), 1.9), 6) AS pill
  FROM (SELECT event_id, (event_id % 100) / 10.0::DOUBLE AS t, least((event_id % 130) / 100.0::DOUBLE * 0.75, 1.0) AS a FROM events)""")
def pulsing_levels(spark, d):
    i = F.col("event_id")
    t, level = (i % 100) / 10, (i % 130) / 100
    return table(spark, d, "events").select("event_id", F.round(F.get(shortcuts.pulsing_bars(level, t), F.lit(2)), 6).alias("third"), F.round(F.get(shortcuts.pill_phases(t + 5, 3), F.lit(1)), 6).alias("pill"))


MOUSE = tables.compiled(keys.mouse_hold, {f"{down}:{busy}": {"is_down": down, "busy": busy} for down in (True, False) for busy in (True, False)})


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_type IN ('click', 'view') AS down, event_id % 11 = 0 AS busy FROM events),
  r AS (SELECT user_id, 0::BIGINT AS i, false AS held, NULL::BIGINT AS event_id, NULL::VARCHAR AS output FROM e GROUP BY 1
    UNION ALL SELECT e.user_id, e.i, down AND (held OR NOT busy), e.event_id, CASE WHEN down AND NOT held AND NOT busy THEN 'start:hold' WHEN held AND NOT down THEN 'stop' END
    FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, event_id, output FROM r WHERE output IS NOT NULL""")
def mouse_sessions(spark, d):
    """Presses and releases of a button, every eleventh event while something else runs."""
    symbol = F.concat(F.col("event_type").isin("click", "view").cast("string"), F.lit(":"), (F.col("event_id") % 11 == 0).cast("string"))
    named = F.element_at(F.create_map(*[F.lit(x) for name in MOUSE.symbols for x in (name.lower(), name)]), symbol)
    return tables.run(table(spark, d, "events"), "user_id", "event_id", named, MOUSE)
