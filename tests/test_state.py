"""State machines: exact transitions, and batch against stream."""

from pyspark.sql import functions as F

from brindle.operators import history
from brindle.streaming import machines


def run(transition, events):
    state, out = {}, []
    for e in events:
        state, x = transition(state, e)
        out.append(x)
    return out


def test_wake_latch():
    e = lambda at, phrase=None, **k: {"at": at, "phrase": phrase, **k}
    assert run(machines.wake_latch, [e(0.0, "p"), e(0.5), e(0.6, "p"), e(1.5), e(2.0, "p"), e(2.1, rearm=True), e(2.2, "p")]) == ["p", None, None, None, "p", None, "p"]


def test_session():
    e = lambda event, busy=False: {"event": event, "busy": busy}
    names = ["holdActivated", "toggleActivated", "holdDeactivated", "toggleActivated", "toggleDeactivated", "toggleActivated", "holdActivated", "holdDeactivated"]
    assert run(machines.dictation_session, [e("holdActivated", True), *map(e, names)]) == [None, "start:hold", "switchedToToggle", None, None, None, "stop", "start:hold", "stop"]


def test_stream_equals_fold(spark, tmp_path):
    rows = [(k, i, n, False) for k in range(3) for i, n in enumerate(["holdActivated", "holdDeactivated", "toggleActivated", "toggleDeactivated", "toggleActivated"])]
    schema = "user_id long, event_id long, event string, busy boolean"
    df = spark.createDataFrame(rows, schema)
    df.where("event_id < 3").coalesce(1).write.parquet(f"{tmp_path}/in")
    df.where("event_id >= 3").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = machines.stream(events, "user_id", ["event_id"], machines.dictation_session).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    want = machines.fold(df, "user_id", ["event_id"], machines.dictation_session)
    assert sorted(map(tuple, spark.table("sessions").collect())) == sorted(map(tuple, want.collect())) != []


def test_history(spark):
    h = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ '2024-01-01 00:00:00', 'a'), (2, TIMESTAMP_NTZ '2024-01-01 00:02:00', 'b'), (3, TIMESTAMP_NTZ '2024-01-01 00:02:00', 'c') t(id, ts, x)")
    assert [r.id for r in history.retain(h, 2).collect()] == [2, 3] and history.retain(h, 0).count() == 0
    assert [r.id for r in history.dropped(h, 2).collect()] == [1]
    probes = spark.sql("SELECT 9 AS probe_id, TIMESTAMP_NTZ '2024-01-01 00:02:00' AS at UNION ALL SELECT 8, TIMESTAMP_NTZ '2024-01-01 00:01:59' UNION ALL SELECT 7, TIMESTAMP_NTZ '2024-01-01 00:04:01'")
    assert {(r.probe_id, r.id) for r in history.recent_item(probes, h, []).collect()} == {(9, 3), (8, 1)}


def plain_reducer(events, bindings, permitted=0):
    """The shortcut reducer event by event, over sets."""
    from brindle.functions.shortcuts import BITS, CODES

    bit = {c: BITS[m] for m, codes in CODES.items() for c in codes}
    keys, mods, was, out = set(), set(), [False] * len(bindings), []

    def active(b):
        mask = 0
        for c in mods:
            mask |= bit[c]
        if b.kind == "disabled" or mask & b.modifiers != b.modifiers:
            return False
        if b.exact is not None:
            for m, codes in CODES.items():
                want, have = set(b.exact) & set(codes), mods & set(codes)
                if not want:
                    if have and not permitted & BITS[m]:
                        return False
                elif want == set(codes):
                    if not have:
                        return False
                elif want != have:
                    return False
        return b.code in (keys if b.kind == "key" else mods)

    def concerns(b, code):
        if b.kind == "disabled":
            return False
        return code == b.code or (code in bit and (b.exact is not None or bool(bit[code] & b.modifiers)))

    for e in events:
        before = [active(b) for b in bindings]
        if e["kind"] == "backendReset":
            keys, mods = set(), set()
        elif e["kind"] == "modifierSnapshot":
            mods = set(e["snapshot"])
        elif e["kind"] == "modifierChanged":
            (mods.add if e["is_down"] else mods.discard)(e["key_code"])
        elif not e["is_repeat"]:
            (keys.add if e["is_down"] else keys.discard)(e["key_code"])
        now = [active(b) for b in bindings]
        up = sorted((i for i in range(len(bindings)) if now[i] and not was[i]), key=lambda i: -bindings[i].specificity)
        down = sorted((i for i in range(len(bindings)) if was[i] and not now[i] and bindings[i].role != "copyAgain"), key=lambda i: bindings[i].specificity)
        emitted = [bindings[i].role + ("Triggered" if bindings[i].role == "copyAgain" else "Activated") for i in up] + [bindings[i].role + "Deactivated" for i in down]
        near = [(b.kind == "key" and b.code == e["key_code"]) if e["kind"] == "keyChanged" else concerns(b, e["key_code"]) for b in bindings]
        eaten = bool(emitted) if e["kind"] == "modifierSnapshot" else e["kind"] != "backendReset" and any(n and (x or y) for n, x, y in zip(near, before, now))
        out.append((emitted, eaten))
        was = now
    return out


def test_shortcut_edges_equal_a_plain_reducer(spark):
    import random

    from brindle.streaming.keys import Binding, shortcut_edges

    r = random.Random(3)
    sets = [
        [Binding("hold", "modifierKey", 63), Binding("toggle", "key", 49, 17), Binding("copyAgain", "key", 9, 3, (55, 59))],
        [Binding("hold", "key", 49, 1, (54, 55)), Binding("toggle", "modifierKey", 61, 4, (61, 56, 60)), Binding("copyAgain", "disabled", 9)],
        [Binding("hold", "key", 49), Binding("toggle", "key", 49, 5, (55, 58)), Binding("copyAgain", "modifierKey", 54, 0, ())],
    ]
    for n, bindings in enumerate(sets):
        rows = []
        for device in range(4):
            for seq in range(250):
                kind = r.choices(["modifierChanged", "keyChanged", "modifierSnapshot", "backendReset"], [8, 6, 1, 0.3])[0]
                code = r.choice([49, 9, 1]) if kind == "keyChanged" else r.choice([54, 55, 56, 58, 59, 60, 61, 63])
                rows.append((device, seq, kind, code, r.random() < 0.6, r.random() < 0.1, r.sample([54, 55, 56, 58, 61, 63], r.randint(0, 3)) if kind == "modifierSnapshot" else None))
        names = "device_id seq kind key_code is_down is_repeat snapshot".split()
        df = spark.createDataFrame(rows, "device_id long, seq long, kind string, key_code int, is_down boolean, is_repeat boolean, snapshot array<int>")
        got = {(x.device_id, x.seq): (list(x.emitted), x.consumed) for x in shortcut_edges(df, bindings, permitted=8 * (n % 2)).collect()}
        for device in range(4):
            own = [dict(zip(names, x)) for x in rows if x[0] == device]
            for e, want in zip(own, plain_reducer(own, bindings, 8 * (n % 2))):
                assert got[device, e["seq"]] == want, (n, e)
        assert any(e for e, _ in got.values())


def test_mouse_hold_and_controls():
    from brindle.streaming import keys

    e = lambda down, busy=False: {"is_down": down, "busy": busy}
    assert run(keys.mouse_hold, [e(True, True), e(False), e(True), e(True), e(False), e(False)]) == [None, None, "start:hold", None, "stop", None]
    control = lambda s, x: keys.controlled(s, x, machines.dictation_session)
    x = lambda event: {"event": event, "busy": False}
    assert run(control, [x("begin:hold"), x("holdDeactivated"), x("forceToggle"), x("toggleActivated"), x("holdActivated"), x("reset"), x("holdDeactivated")]) == [None, "stop", None, "stop", "start:hold", None, None]


def test_tables_equal_the_reducers(spark):
    import random

    from brindle.streaming import keys, tables

    r = random.Random(12)
    for transition, symbols in (
        (machines.dictation_session, {f"{k}:{b}": {"event": k, "busy": b} for k in ("holdActivated", "holdDeactivated", "toggleActivated", "toggleDeactivated") for b in (False, True)}),
        (keys.mouse_hold, {f"{d}:{b}": {"is_down": d, "busy": b} for d in (True, False) for b in (True, False)}),
    ):
        rows = [(k, at, r.choice([*symbols, None])) for k in ("hot", "b", None) for at in sorted(r.sample(range(-2000, 20000), 3000 if k == "hot" else 40))]
        want = []
        for key in ("hot", "b"):
            state = {}
            for k, at, s in rows:
                if k == key and s is not None:
                    state, out = transition(state, symbols[s])
                    if out is not None:
                        want.append((k, at, out))
        events = spark.createDataFrame(rows, "k string, at long, s string").repartition(5)
        machine = tables.compiled(transition, symbols)
        for span, block in ((1024, 4096), (7, 3), (1, 1000)):
            got = tables.run(events, "k", "at", F.col("s"), machine, span, block).collect()
            assert sorted(map(tuple, got)) == sorted(want)
        assert tables.run(events.limit(0), "k", "at", F.col("s"), machine).count() == 0


def test_learning_takes_one_sight_after_another(spark):
    import random

    from brindle.operators import vocabulary

    for seed in range(8):
        r = random.Random(seed)
        threshold, learned_cap, suggested_cap = r.choice([(3, 12, 4), (2, 30, 3), (3, 5, 1), (1, 6, 2), (3, 6, 2)])
        have = [("m", "M", "manual", "active", 1, 0), ("x", "X", "learned", "rejected", 2, 1), ("s1", "S1", "learned", "suggested", 1, 2), ("s2", "S2", "learned", "suggested", threshold - 1, 3), ("a", "A", "learned", "active", 9, 4)]
        calls = [(c, p, k, k.upper() + str(c)) for c in range(25) for p, k in enumerate(r.choices(["m", "x", "s1", "s2", "a", *"pqrstuvw"], k=r.randint(0, 4)))]
        state = {h[0]: [h[1], h[2], h[3], h[4]] for h in have}
        for call in sorted({c[0] for c in calls}):
            done = set()
            for _, _, k, term in sorted(c for c in calls if c[0] == call):
                if k in done:
                    continue
                done.add(k)
                if k in state:
                    if state[k][1] == "learned" and state[k][2] != "rejected":
                        state[k][3] += 1
                        state[k][2] = "active" if state[k][3] >= threshold else state[k][2]
                    continue
                live = [s for s in state.values() if s[1] == "learned" and s[2] != "rejected"]
                if len(live) < learned_cap and sum(s[2] == "suggested" for s in live) < suggested_cap:
                    state[k] = [term, "learned", "active" if threshold <= 1 else "suggested", 1]
        entries = spark.createDataFrame(have, "key string, term string, source string, status string, observations long, ordinal int")
        got = vocabulary.learn(entries, spark.createDataFrame(calls, "call int, pos int, key string, term string"), threshold, learned_cap, suggested_cap)
        assert {x.key: [x.term, x.source, x.status, x.observations] for x in got.collect()} == state, (seed, threshold, learned_cap, suggested_cap)


def test_rejected_entries_go_before_learning(spark):
    from brindle.operators import vocabulary

    have = spark.createDataFrame([("a", "A", "learned", "rejected", 1, 0, 1), ("b", "B", "learned", "rejected", 1, 1, 2)], "key string, term string, source string, status string, observations long, ordinal int, updated_at int")
    calls = spark.createDataFrame([(1, 0, "a", "A"), (1, 1, "b", "B")], "call int, pos int, key string, term string")
    got = {r.key: r.status for r in vocabulary.learn(have, calls, 3, 1, 1).collect()}
    assert got == {"a": "suggested", "b": "rejected"}


def test_root_codes(spark):
    from brindle.operators.errors import root_codes

    chain = [(i, i + 1, "deep" if i == 20 else None) for i in range(21)]
    rows = chain + [(30, 31, None), (31, 30, None), (40, 40, None), (41, 99, None), (None, 1, "x"), (50, None, "own"), (51, 50, None), (51, 50, None)]
    got = {r.id: r.code for r in root_codes(spark.createDataFrame(rows, "id int, cause int, code string"), F.col("code")).collect()}
    assert got == {i: "deep" if i >= 13 else None for i in range(21)} | {30: None, 31: None, 40: None, 41: None, 50: "own", 51: "own"}


def test_changes_of_one_key_are_one(spark):
    from brindle.operators import history

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    changes = spark.createDataFrame([(1, "y"), (1, "x"), (3, "z")], "id int, text string")
    assert sorted(map(tuple, history.update(rows, changes, ["text"]).collect())) == [(1, "x"), (2, "b")]
