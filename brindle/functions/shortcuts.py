"""Shortcut bindings: modifier sets, bit masks, matching and conflicts as native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Modifier bits, and the left and right key codes of each.
BITS = {"command": 1, "control": 2, "option": 4, "shift": 8, "function": 16}
CODES = {"command": (55, 54), "control": (59, 62), "option": (58, 61), "shift": (56, 60), "function": (63,)}
DEFAULT_CANCEL = 53

_BIT_OF = {c: BITS[m] for m, codes in CODES.items() for c in codes}
_LEFT_OF = {c: codes[0] for codes in CODES.values() for c in codes}


# The names of modifiers, and of their keys by side.
NAMES = {"command": "Cmd ⌘", "control": "Ctrl ⌃", "option": "Option ⌥", "shift": "Shift ⇧", "function": "Fn 🌐"}
SIDES = {54: "Right ", 62: "Right ", 61: "Right ", 60: "Right "}


def bit_of(code: int) -> int:
    return _BIT_OF.get(code, 0)


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def logical_modifier(code: Column) -> Column:
    """The bit of a modifier key, else null."""
    return F.try_element_at(_map(_BIT_OF), code)


def canonical_code(code: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(_LEFT_OF), code), code)


def mask_of(codes: Column) -> Column:
    """Bit mask of a set of pressed key codes."""
    return F.aggregate(codes, F.lit(0), lambda a, c: a.bitwiseOR(F.coalesce(logical_modifier(c), F.lit(0))))


def codes_of(mask: Column) -> Column:
    """All key codes of the modifiers in a mask, in display order."""
    return F.filter(F.array(*[F.lit(c) for codes in CODES.values() for c in codes]), lambda c: mask.bitwiseAND(logical_modifier(c)) != 0)


def names_of(mask: Column) -> Column:
    return F.filter(F.array(*[F.when(mask.bitwiseAND(F.lit(b)) != 0, m) for m, b in BITS.items()]), lambda x: x.isNotNull())


def specificity(mask: Column) -> Column:
    return F.bit_count(mask)


def contains_modifiers(active: Column, wanted: Column) -> Column:
    return active.bitwiseAND(wanted) == wanted


def exact_match(pressed: Column, exact: Column, permitted: Column | None = None) -> Column:
    """Of every modifier: no exact code allows no pressed one (unless its bit is permitted); both sides allow any; one side is itself."""
    tests = []
    for m, codes in CODES.items():
        own = F.array(*[F.lit(c) for c in codes])
        p, e = F.array_intersect(pressed, own), F.array_intersect(exact, own)
        free = permitted.bitwiseAND(F.lit(BITS[m])) != 0 if permitted is not None else F.lit(False)
        same = (F.size(F.array_except(p, e)) == 0) & (F.size(F.array_except(e, p)) == 0)
        full = F.size(e) == len(codes)
        tests.append(F.when(F.size(e) == 0, free | (F.size(p) == 0)).when(full & F.lit(len(codes) > 1), F.size(p) > 0).otherwise(same))
    return reduce(lambda a, b: a & b, tests)


def cancels(kind: Column, code: Column, modifiers: Column, pressed_code: Column, active: Column) -> Column:
    return (kind == "key") & (code == pressed_code) & contains_modifiers(active, modifiers)


def cancel_code(kind: Column, code: Column) -> Column:
    return F.coalesce(F.when(kind == "key", code), F.lit(DEFAULT_CANCEL))


def binding_id(kind: Column, code: Column, modifiers: Column, preset: Column, exact: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat_ws(":", kind, text(code), text(modifiers), text(preset), F.coalesce(F.array_join(F.array_sort(exact).cast("array<string>"), ","), F.lit("")))


def conflicts(bindings: DataFrame) -> DataFrame:
    """(a, b) of bindings (id, kind, code, modifiers) that some set of pressed modifiers triggers alike: same kind and key, equal specificity.

    A set of pressed modifiers that holds both masks triggers both, so one exists for every pair (their union);
    what remains is equal specificity, an equi-join.
    """
    b = bindings.withColumn("spec", specificity(F.col("modifiers")))
    other = b.select(F.col("id").alias("b"), "kind", "code", "spec")
    return b.select(F.col("id").alias("a"), "kind", "code", "spec").join(other, ["kind", "code", "spec"]).where("a < b").select("a", "b")


def bars(level: Column, multipliers: tuple[float, ...] = (0.35, 0.55, 0.75, 0.9, 1.0, 0.9, 0.75, 0.55, 0.35)) -> Column:
    """Heights of a level meter's bars."""
    return F.transform(F.array(*[F.lit(m) for m in multipliers]), lambda m: F.least(level * m, F.lit(1.0)))


# Phases of the bars' pulse.
_WAVE, _SHIMMER = (6.2, -0.78, 0.22), (3.1, 0.5, 0.06)


def pulsing_bars(level: Column, time: Column, multipliers: tuple[float, ...] = (0.35, 0.55, 0.75, 0.9, 1.0, 0.9, 0.75, 0.55, 0.35)) -> Column:
    """Heights of a level meter's bars while a pulse runs along them."""
    wave = lambda i, speed, phase, weight: (F.sin(time * speed + i * phase) * 0.5 + 0.5) * weight
    pulse = lambda i: wave(i, *_WAVE) + wave(i, *_SHIMMER)
    return F.transform(bars(F.greatest(level, F.lit(0.0)), multipliers), lambda a, i: F.least(a * (pulse(i) + 0.74) + (1 - a) * (pulse(i) * 0.28 + 0.04), F.lit(1.0)))


def pill_phases(time: Column, n: int, cycle: float = 1.05, stagger: float = 0.11) -> Column:
    """Height of each of n dots of a waiting indicator (0 to 1)."""
    phase = lambda i: ((time - i * stagger) % cycle) / cycle
    return F.array(*[F.pow(F.lit(0.5) + F.sin(phase(F.lit(i)) * 2 * F.pi() - F.pi() / 2) * 0.5, F.lit(1.9)) for i in range(n)])


def known_codes(exact: Column) -> Column:
    """Exact codes that are modifiers, in display order; null stays null."""
    return F.array_intersect(F.array(*[F.lit(c) for codes in CODES.values() for c in codes]).cast("array<int>"), exact)


def normalized(kind: Column, code: Column, modifiers: Column, exact: Column) -> Column:
    """struct(modifiers, exact) as stored: only known codes, and the modifiers that they imply (not a modifier key's own)."""
    known = known_codes(exact)
    implied = F.coalesce(mask_of(F.when(kind == "modifierKey", F.array_except(known, F.array(code))).otherwise(known)), F.lit(0))
    return F.struct(modifiers.bitwiseOR(implied).alias("modifiers"), known.alias("exact"))


def augmented(kind: Column, modifiers: Column, exact: Column, extra: Column) -> Column:
    """struct(modifiers, exact) with more modifiers, both sides of each; disabled bindings and empty exact sets stay."""
    more = F.when(F.size(exact) > 0, known_codes(F.array_union(exact, codes_of(extra)))).otherwise(exact)
    off = kind == "disabled"
    return F.struct(F.when(off, modifiers).otherwise(modifiers.bitwiseOR(extra)).alias("modifiers"), F.when(off, exact).otherwise(more).alias("exact"))


def display_names(modifiers: Column, exact: Column) -> Column:
    """Names of the modifiers: of the exact sides, or the general one for both sides or none."""
    known, parts = F.coalesce(known_codes(exact), F.array().cast("array<int>")), []
    for m, codes in CODES.items():
        own = F.array(*[F.lit(c) for c in codes]).cast("array<int>")
        held = F.array_intersect(own, known)
        sides = F.array_compact(F.array(*[F.when(F.array_contains(held, c), SIDES.get(c, "") + NAMES[m]) for c in codes]))
        general = F.array(F.lit(NAMES[m]))
        parts.append(F.when(F.size(held) == len(codes), general).when(F.size(held) > 0, sides).when(modifiers.bitwiseAND(F.lit(BITS[m])) != 0, general).otherwise(F.array().cast("array<string>")))
    return F.flatten(F.array(*parts))


def key_label(code: Column, special: Column, typed: Column) -> Column:
    """The modifier's name, else a special key's (null if none), else what was typed, one character in upper case."""
    own = {c: SIDES.get(c, "") + NAMES[m] for m, codes in CODES.items() for c in codes}
    t = F.trim(F.coalesce(typed, F.lit("")))
    return F.coalesce(F.try_element_at(_map(own), code), special, F.when(F.length(t) == 1, F.upper(t)).otherwise(t))


def binding_of_key(code: Column, label: Column, repeat: Column, pressed: Column) -> Column:
    """struct(kind, code, label, modifiers, exact) of a key event; null for repeats, modifiers and keys without label."""
    fine = ~repeat & logical_modifier(code).isNull() & (label != "")
    return F.when(fine, F.struct(F.lit("key").alias("kind"), code.alias("code"), label.alias("label"), mask_of(pressed).alias("modifiers"), known_codes(pressed).alias("exact")))


def binding_of_modifier(code: Column, pressed: Column, bare: Column) -> Column:
    """struct(kind, code, modifiers, exact) of a modifier key that is pressed, with others unless bare ones are allowed."""
    own, active = logical_modifier(code), mask_of(pressed)
    extra = active.bitwiseAND(F.bitwise_not(own))
    fine = own.isNotNull() & (active.bitwiseAND(own) != 0) & (bare | (extra != 0))
    return F.when(fine, F.struct(F.lit("modifierKey").alias("kind"), code.alias("code"), extra.alias("modifiers"), known_codes(pressed).alias("exact")))


# What stands in the way of a shortcut, by the role that wants it and the role that has it, in order.
COLLISIONS = {
    "hold": {"toggle": "Hold and tap shortcuts must be distinct.", "cancel": "This shortcut is already used by Cancel Dictation.", "copyAgain": "This shortcut is already used by Paste Again."},
    "toggle": {"hold": "Hold and tap shortcuts must be distinct.", "cancel": "This shortcut is already used by Cancel Dictation.", "copyAgain": "This shortcut is already used by Paste Again."},
    "cancel": {"hold": "Cancel Dictation cannot share a shortcut with Hold to Talk.", "toggle": "Cancel Dictation cannot share a shortcut with Tap to Toggle.", "copyAgain": "This shortcut is already used by Paste Again."},
    "copyAgain": {"cancel": "Paste Again cannot share a shortcut with Cancel Dictation.", "hold": "Paste Again cannot share a shortcut with Hold to Talk.", "toggle": "Paste Again cannot share a shortcut with Tap to Toggle."},
}
NOT_A_KEY = "Cancel Dictation must use a regular key, optionally with modifiers."
SHARED_MODIFIER = "Paste Again cannot share the Edit Mode modifier."


def alike(kind: Column, code: Column, modifiers: Column, other: Column) -> Column:
    """Whether a binding conflicts with another (struct of kind, code, modifiers), by the rule of conflicts()."""
    return (kind != "disabled") & (kind == other["kind"]) & (code == other["code"]) & (specificity(modifiers) == specificity(other["modifiers"]))


def collision(role: Column, kind: Column, code: Column, modifiers: Column, taken: dict[str, Column], manual: Column | None = None) -> Column:
    """The first message against a shortcut for a role, or null; taken: the bindings of the roles; manual: an edit mode's modifier bit."""
    out = F.when((role == "cancel") & (kind != "key"), NOT_A_KEY)
    for own, others in COLLISIONS.items():
        for other, message in others.items():
            out = out.when((role == own) & alike(kind, code, modifiers, taken[other]), message)
    if manual is not None:
        out = out.when((role == "copyAgain") & collides(kind, code, modifiers, manual), SHARED_MODIFIER)
    return out


def collides(kind: Column, code: Column, modifiers: Column, manual: Column) -> Column:
    """Whether a binding holds the manual modifier or is that key."""
    return (kind != "disabled") & (contains_modifiers(modifiers, manual) | ((kind == "modifierKey") & logical_modifier(code).eqNullSafe(manual)))


def modifier_collision(manual: Column, taken: dict[str, Column]) -> Column:
    """The first message against an edit mode's modifier, or null: part of a shortcut first, then one itself."""
    names = {"hold": "hold", "toggle": "tap", "copyAgain": "Paste Again"}
    inside = {r: (taken[r]["kind"] != "disabled") & contains_modifiers(taken[r]["modifiers"], manual) for r in names}
    itself = {r: (taken[r]["kind"] == "modifierKey") & logical_modifier(taken[r]["code"]).eqNullSafe(manual) for r in names}
    tests = [(inside[r], f"That modifier is already part of the {n} shortcut.") for r, n in names.items()] + [(itself[r], f"That modifier is already the {n} shortcut.") for r, n in names.items()]
    return F.coalesce(*[F.when(test, message) for test, message in tests])


# The stored forms of shortcuts, the presets and what stands where nothing is stored.
STORED = "keyCode int, keyDisplay string, modifiers int, kind string, preset string, exactModifierKeyCodes array<int>"
KINDS = ("disabled", "key", "modifierKey")
PRESETS = {"fn": (63, "Fn", "modifierKey"), "rightOption": (61, "Right Option", "modifierKey"), "f5": (96, "F5", "key")}
CANCEL, DISABLED = (DEFAULT_CANCEL, "Esc", "key"), (0, "Disabled", "disabled")


def _binding(code: Column, label: Column, kind: Column, modifiers: Column, preset: Column, exact: Column) -> Column:
    return F.struct(kind.alias("kind"), code.alias("code"), label.alias("label"), modifiers.alias("modifiers"), preset.alias("preset"), exact.alias("exact"))


def _fixed(values: tuple, preset: Column | None = None) -> Column:
    code, label, kind = values
    return _binding(F.lit(code), F.lit(label), F.lit(kind), F.lit(0), F.lit(None).cast("string") if preset is None else preset, F.lit(None).cast("array<int>"))


def stored_binding(blob: Column) -> Column:
    """struct(binding, rewrite) of a stored shortcut: null binding where nothing is stored or it does not decode; rewrite: whether the normal form differs."""
    raw = F.from_json(blob, f"{STORED}, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    known = raw.preset.isNull() | raw.preset.isin(*PRESETS)
    fine = raw.broken.isNull() & raw.keyCode.isNotNull() & raw.keyDisplay.isNotNull() & raw.modifiers.isNotNull() & raw.kind.isin(*KINDS) & known
    normal = normalized(raw.kind, raw.keyCode, raw.modifiers, raw.exactModifierKeyCodes)
    binding = _binding(raw.keyCode, raw.keyDisplay, raw.kind, normal.modifiers, raw.preset, normal.exact)
    as_set = lambda c: F.array_sort(F.array_distinct(c))
    same = (normal.modifiers == raw.modifiers) & as_set(normal.exact).eqNullSafe(as_set(raw.exactModifierKeyCodes))
    return F.struct(F.when(fine, binding).alias("binding"), (F.coalesce(fine, F.lit(False)) & ~same).alias("rewrite"))


def stored_configuration(hold: Column, toggle: Column, copy_again: Column, cancel: Column, preset: Column) -> Column:
    """struct(hold, toggle, copy_again, cancel, rewrite_hold, ...) of the stored shortcuts and the older preset setting.

    Hold and toggle fall back to the preset (toggle with command added) and are then to be written; paste again falls back to
    none; cancel is a regular key, else the default one.
    """
    chosen = F.when(preset.isin(*PRESETS), preset).otherwise("fn")
    of = lambda i: F.element_at(F.create_map(*[x for name, v in PRESETS.items() for x in (F.lit(name), F.lit(v[i]))]), chosen)
    none = F.lit(None).cast("array<int>")
    fallback = lambda bits: _binding(of(0), of(1), of(2), F.lit(bits), F.when(F.lit(bits == 0), chosen), none)
    h, t, c, x = map(stored_binding, (hold, toggle, copy_again, cancel))
    regular = F.coalesce(x.binding.kind == "key", F.lit(False))
    return F.struct(
        F.coalesce(h.binding, fallback(0)).alias("hold"), F.coalesce(t.binding, fallback(BITS["command"])).alias("toggle"), F.coalesce(c.binding, _fixed(DISABLED)).alias("copy_again"),
        F.when(regular, x.binding).otherwise(_fixed(CANCEL)).alias("cancel"),
        (h.binding.isNull() | h.rewrite).alias("rewrite_hold"), (t.binding.isNull() | t.rewrite).alias("rewrite_toggle"), c.rewrite.alias("rewrite_copy_again"), (x.rewrite | (x.binding.isNotNull() & ~regular)).alias("rewrite_cancel"),
    )
