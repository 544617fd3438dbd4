"""Shortcut events: which bindings are active after each key event, and the edges between them.

What is pressed after an event is, key by key, the last event that said so; so the states of all events come from
one window over a device's events in order, and edges from the event before.  Only keys that bindings and
modifiers name matter, so their number is a constant of the configuration.  A device's events are one window group.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shortcuts import CODES, bit_of, contains_modifiers, exact_match, mask_of

MODIFIERS = [c for codes in CODES.values() for c in codes]


@dataclass(frozen=True)
class Binding:
    """kind: key, modifierKey or disabled; exact: the very codes that must be pressed, or None."""

    role: str
    kind: str
    code: int
    modifiers: int = 0
    exact: tuple[int, ...] | None = None

    @property
    def specificity(self) -> int:
        return self.modifiers.bit_count()


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def is_active(binding: Binding, keys: Column, modifiers: Column, permitted: int = 0) -> Column:
    """Whether a binding is pressed, of arrays of pressed key and modifier codes."""
    if binding.kind == "disabled":
        return F.lit(False)
    held = contains_modifiers(mask_of(modifiers), F.lit(binding.modifiers))
    if binding.exact is not None:
        held = held & exact_match(modifiers, F.array(*[F.lit(c) for c in binding.exact]).cast("array<int>"), F.lit(permitted))
    return held & F.array_contains(keys if binding.kind == "key" else modifiers, binding.code)


def refers_to(binding: Binding, keys: Column, modifiers: Column, permitted: int = 0) -> Column:
    """Whether any pressed key or modifier belongs to the binding."""
    tests = [F.array_contains(keys, binding.code)] if binding.kind == "key" else [F.array_contains(modifiers, binding.code)] if binding.kind == "modifierKey" else []
    if binding.exact is not None:
        near = [*binding.exact, *[c for c in MODIFIERS if bit_of(c) & permitted]]
        tests.append(F.arrays_overlap(modifiers, F.array(*[F.lit(c) for c in near]).cast("array<int>")) if near else F.lit(False))
    else:
        tests.append(mask_of(modifiers).bitwiseAND(F.lit(binding.modifiers)) != 0)
    return _any(tests)


def pressed_inputs(bindings: list[Binding], keys: Column, modifiers: Column, permitted: int = 0) -> Column:
    return _any([refers_to(b, keys, modifiers, permitted) for b in bindings])


def _concerns(binding: Binding, code: Column) -> Column:
    """Whether a change of a modifier's code can matter to the binding."""
    if binding.kind == "disabled":
        return F.lit(False)
    near = MODIFIERS if binding.exact is not None else [c for c in MODIFIERS if bit_of(c) & binding.modifiers]
    return code.isin(binding.code, *near)


def shortcut_edges(events: DataFrame, bindings: list[Binding], key: str = "device_id", order: str = "seq", permitted: int = 0, one_shot: tuple[str, ...] = ("copyAgain",)) -> DataFrame:
    """events with keys, modifiers (pressed codes after each), emitted (edges in order) and consumed.

    events: key, order, kind (modifierChanged, modifierSnapshot, keyChanged, backendReset), key_code, is_down,
    is_repeat, snapshot (array of codes).  Activations come by falling specificity, then deactivations by rising
    one; a one-shot role has no deactivation.  Ties keep the order of the bindings.
    """
    w = Window.partitionBy(key).orderBy(order)
    kind, code = F.col("kind"), F.col("key_code")
    reset = F.when(kind == "backendReset", F.lit(False))
    change = (kind == "keyChanged") & ~F.coalesce("is_repeat", F.lit(False))
    of_key = lambda c: F.when(change & (code == c), F.col("is_down")).otherwise(reset)
    of_modifier = lambda c: F.when((kind == "modifierChanged") & (code == c), F.col("is_down")).when(kind == "modifierSnapshot", F.array_contains("snapshot", c)).otherwise(reset)
    now = lambda flag: F.coalesce(F.last(flag, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(False))
    named = sorted({b.code for b in bindings if b.kind == "key"})
    held = events.select("*", *[now(of_key(c)).alias(f"_k{c}") for c in named], *[now(of_modifier(c)).alias(f"_m{c}") for c in MODIFIERS])
    codes = lambda p, some: F.array_compact(F.array(*[F.when(F.col(f"{p}{c}"), c) for c in some]).cast("array<int>"))
    states = held.select(*[F.col(f"`{c}`") for c in events.columns], codes("_k", named).alias("keys"), codes("_m", MODIFIERS).alias("modifiers"))
    states = states.select("*", *[is_active(b, F.col("keys"), F.col("modifiers"), permitted).alias(f"_a{i}") for i, b in enumerate(bindings)])
    before = lambda i: F.coalesce(F.lag(f"_a{i}").over(w), F.lit(False))
    states = states.select("*", *[before(i).alias(f"_b{i}") for i in range(len(bindings))])
    rising = sorted(range(len(bindings)), key=lambda i: -bindings[i].specificity)
    falling = sorted((i for i in range(len(bindings)) if bindings[i].role not in one_shot), key=lambda i: bindings[i].specificity)
    emitted = F.array_compact(F.array(
        *[F.when(F.col(f"_a{i}") & ~F.col(f"_b{i}"), bindings[i].role + ("Triggered" if bindings[i].role in one_shot else "Activated")) for i in rising],
        *[F.when(F.col(f"_b{i}") & ~F.col(f"_a{i}"), bindings[i].role + "Deactivated") for i in falling],
    ))
    some = lambda test: _any([test(b) & (F.col(f"_a{i}") | F.col(f"_b{i}")) for i, b in enumerate(bindings)])
    consumed = (
        F.when(kind == "keyChanged", some(lambda b: (code == b.code) if b.kind == "key" else F.lit(False)))
        .when(kind == "modifierChanged", some(lambda b: _concerns(b, code)))
        .when(kind == "modifierSnapshot", F.size(emitted) > 0)
        .otherwise(F.lit(False))
    )
    return states.select(*[F.col(f"`{c}`") for c in events.columns], "keys", "modifiers", emitted.alias("emitted"), F.coalesce(consumed, F.lit(False)).alias("consumed"))


def cancel_action(transcribing: Column, pending: Column, active: Column) -> Column:
    """What a cancel key does: null lets it through."""
    return F.when(transcribing, "cancelTranscription").when(pending.eqNullSafe(F.lit("toggle")) | active.eqNullSafe(F.lit("toggle")), "cancelToggle")


def trusted_modifiers(codes: Column, function_down: Column) -> Column:
    """Pressed codes in which a known state of the function key stands over the event's own flag."""
    rest = F.array_except(codes, F.array(F.lit(CODES["function"][0])))
    return F.when(function_down.isNull(), codes).when(function_down, F.array_append(rest, F.lit(CODES["function"][0]))).otherwise(rest)


def mouse_hold(state: dict, event: dict) -> tuple[dict, str | None]:
    """A button's press holds while nothing else runs; its release ends only its own session."""
    if event["is_down"]:
        return (state, None) if state.get("mode") or event["busy"] else ({"mode": "mouse"}, "start:hold")
    return ({}, "stop") if state.get("mode") == "mouse" else (state, None)


def controlled(state: dict, event: dict, transition) -> tuple[dict, str | None]:
    """A session's transition with its controls: begin a mode by hand, force toggle, reset."""
    kind = event["event"]
    if kind.startswith("begin:"):
        return {"mode": kind.removeprefix("begin:")}, None
    if kind == "forceToggle":
        return {"mode": "toggle", "armed": True}, None
    return ({}, None) if kind == "reset" else transition(state, event)
