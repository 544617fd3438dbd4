"""Cleanup and recognition of utterance text as native Column expressions (Column -> Column).

Case rules are Unicode-aware ((?iu)); white space is Unicode white space ((?U)\\s).  Lengths are code points.
Null text gives null.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The filler words, the words of which repeats collapse, the scratch commands and the words that are never candidates.
FILLERS = ("uh", "uhh", "uhhh", "uhm", "um", "umm", "ummm", "erm")
COLLAPSIBLE = ("a", "an", "and", "are", "at", "but", "for", "he", "i", "in", "is", "it", "of", "or", "she", "that", "the", "they", "this", "to", "we", "was", "were", "will", "with", "you")
SCRATCH = ("scratch that", "scratch this", "delete that", "delete this")
COMMON = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "can", "do", "for", "from", "had", "has", "have", "he", "her", "here", "his", "how", "i",
    "if", "in", "is", "it", "its", "just", "me", "my", "no", "not", "of", "on", "or", "our", "please", "she", "so", "that", "the", "their", "them", "then",
    "there", "they", "this", "to", "up", "us", "was", "we", "were", "what", "when", "where", "which", "who", "will", "with", "would", "yes", "you", "your",
)

# What bounds a word, what a term is made of, and a beginning of a word that the word itself follows.
_BEFORE, _AFTER = r"(?<![\p{L}\p{M}\p{N}_])", r"(?![\p{L}\p{M}\p{N}_])"
_TERM = r"[\p{L}\p{N}][\p{L}\p{N}'’._+-]{1,63}"
_STUTTER = rf"(?iu){_BEFORE}([\p{{L}}]{{1,3}})[-–—]\s+\1([\p{{L}}\p{{M}}]+){_AFTER}"

_SPACE = r"(?U)\s+"
_WORD = r"[\p{L}\p{M}\p{N}_]+"
#: Unicode white space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Those of them that are separators of words within a line: the class Zs, and the tab.
LINE_BLANKS = "".join(c for c in BLANKS if unicodedata.category(c) == "Zs") + "\t"

# Letters that decompose into a base and marks, and their base: by Unicode decomposition.
_PARTS = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in [*range(0xC0, 0xAC00), *range(0xF900, 0xFFF0)]}
_ACCENTED = [c for c, x in _PARTS.items() if len(x) > 1 and all(unicodedata.combining(m) for m in x[1:])]
_BASE = "".join(_PARTS[c][0] for c in _ACCENTED)


def fold(column: Column) -> Column:
    """Lower case, without accents."""
    return F.lower(F.regexp_replace(F.translate(column, "".join(_ACCENTED), _BASE), r"\p{Mn}+", ""))


def _folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()


def _any_accent(word: str) -> str:
    """A pattern of the word whatever the accents of its letters."""
    letters = unicodedata.normalize("NFC", _folded(word))
    return "".join(f"[{re.escape(c)}{''.join(x for x in _ACCENTED if _folded(x) == c)}]\\p{{Mn}}*" if c.isalpha() else re.escape(c) for c in letters)


def _either(words: Iterable[str]) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def _starts(words: Iterable[str]) -> str:
    """A look at the first letter, which fails faster than a look behind it."""
    return "(?=[" + "".join(sorted({re.escape(c) for w in words for c in (w[0].lower(), w[0].upper())})) + "])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends; no pattern, which would take the square of a run of blanks inside."""
    return F.btrim(text, F.lit(BLANKS))


def normalize_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def remove_fillers(text: Column, fillers: Sequence[str] = FILLERS) -> Column:
    return F.regexp_replace(text, f"(?iu){_starts(fillers)}{_BEFORE}(?:{_either(fillers)}){_AFTER}", "")


def collapse_repeats(text: Column, words: Sequence[str] = COLLAPSIBLE) -> Column:
    """Runs of one listed word keep its first spelling.

    One pass over words and the gaps between them: a listed word that equals the word before it, with white space
    between the two, goes with that gap.  A recursive pattern would need a stack as deep as the run.
    """

    def collapsed(t: Column) -> Column:
        found, gaps = F.regexp_extract_all(t, F.lit(_WORD), F.lit(0)), F.split(t, _WORD, -1)
        near = lambda own, low: F.arrays_zip(gaps.alias("gap"), own.alias("own"), low.alias("low"), F.concat(F.array(F.lit("")), low).alias("before"))
        again = lambda x: x.low.isin(*words) & (x.low == x.before) & x.gap.rlike(r"\A(?U)\s+\z")
        kept = lambda x: F.when(again(x), "").otherwise(F.concat(x.gap, F.coalesce(x.own, F.lit(""))))
        return let(found, lambda own: F.array_join(F.transform(near(own, F.transform(own, F.lower)), kept), ""))

    some = text.rlike(rf"(?iuU){_starts(words)}{_BEFORE}({_either(words)})\s+\1{_AFTER}")
    return F.when(some, collapsed(text)).otherwise(text)


def collapse_stutters(text: Column) -> Column:
    """A beginning of up to three letters, a dash, and a word that begins so: one word, in the spelling of its beginning."""
    return F.regexp_replace(text, _STUTTER, "$1$2")


def normalize_punctuation(text: Column) -> Column:
    """One mark where several meet, none after white space, no weak mark at either end, one blank between words.

    Commas with nothing between them, and dashes with nothing between them, are a blank.  Of marks without blanks
    the last stands; a weak mark (comma, semicolon, colon) before an end of a sentence goes.
    """
    text = F.regexp_replace(text, r"(?U),\s*+,|[–—]\s*+[–—]", " ")
    text = F.regexp_replace(text, r"(?U)(?<!\s)\s++(?=[,.;:!?])", "")  # a run of blanks is looked at once
    text = F.regexp_replace(text, "[,.;:!?]+(?=[,.;:!?])", "")
    text = F.regexp_replace(text, r"(?U)[,;:]\s*+(?=[.!?])", "")
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\A\s*+[,;:]\s*+|(?<!\s)\s*+[,;:]\s*+\z", ""), _SPACE, " ")


def apply_corrections(text: Column, corrections: Sequence[tuple[str, str]], any_accent: bool = False) -> Column:
    """One pass over (spoken, replacement) pairs, longest spoken first; replacements are not read again.

    What is found is told by case only (any_accent: nor by accents); of the pairs that fit it whatever its accents the first
    stands.  The rest of the text stays as it is.  The pairs are a parameter list, so the pattern is a literal that
    the JVM compiles once.
    """
    pairs = sorted(((s.split(), r) for s, r in corrections if s.split() and r), key=lambda p: -len(" ".join(p[0])))
    if not pairs:
        return text
    quoted = _any_accent if any_accent else re.escape
    pattern = f"(?iuU){_BEFORE}(?:" + "|".join(r"\s+".join(quoted(w) for w in s) for s, _ in pairs) + f"){_AFTER}"
    first: dict[str, str] = {}
    for s, r in pairs:
        first.setdefault(_folded(" ".join(s)), r)
    table = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])

    def replaced(t: Column) -> Column:
        hits = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda h: F.coalesce(F.try_element_at(table, fold(F.regexp_replace(h, _SPACE, " "))), h))
        return F.array_join(F.zip_with(F.split(t, pattern, -1), hits, lambda g, h: F.concat(g, F.coalesce(h, F.lit("")))), "")

    return let(text, replaced)


def tidy(text: Column, corrections: Sequence[tuple[str, str]] = ()) -> Column:
    """White space, fillers, repeats, stutters, corrections, punctuation, trim: in this order."""
    text = collapse_stutters(collapse_repeats(remove_fillers(normalize_whitespace(text))))
    return F.trim(normalize_punctuation(apply_corrections(text, corrections)))


def separated_key(text: Column) -> Column:
    """Lower case, with punctuation and symbols as single spaces: commands and names."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[\p{P}\p{S}\s]+", " "))


def macro_key(text: Column) -> Column:
    """Lower case, with punctuation deleted: "meeting-notes" and "meetingnotes" are one."""
    return strip(F.regexp_replace(F.lower(text), r"\p{P}+", ""))


def is_scratch(text: Column) -> Column:
    return separated_key(text).isin(*SCRATCH)


_ENTER = r"(?iU)(?:^|(?<![ \t\r\n,;:\-])[ \t\r\n,;:\-]++)press[ \t\r\n]++enter[\s\p{P}]*+\z"


def has_enter_command(text: Column) -> Column:
    return text.rlike(_ENTER)


def without_enter_command(text: Column) -> Column:
    return strip(F.regexp_replace(text, _ENTER, ""))


_APART = r"[\s\p{P}\p{S}]"


def _spoken(names: Sequence[str]) -> str:
    """The names, with whatever separates words for their blanks."""
    return _either(names).replace("\\ ", f"{_APART}+")


def wake_pattern(greetings: Sequence[str], names: Sequence[str]) -> str:
    return rf"(?iuU)^{_APART}*+(?:{_either(greetings)}){_APART}+(?:{_spoken(names)})(?=\z|{_APART}){_APART}*"


def plain_wake_pattern(names: Sequence[str]) -> str:
    return rf"(?iuU)^{_APART}*+(?:{_spoken(names)})(?=\z|{_APART}){_APART}*"


def wake_match(text: Column, greetings: Sequence[str], names: Sequence[str], fuzzy: Sequence[str] = (), plain: bool = False, segmented: Sequence[str] = ()) -> Column:
    """struct(phrase, trailing) where the text starts with a greeting and a name (fuzzy names need the greeting), or, if plain, with a name.

    segmented: names in parts that are so rare that they stand for a greeting that was not heard.
    """
    found = lambda phrase, pattern: F.when(text.rlike(pattern), F.struct(F.lit(phrase).alias("phrase"), F.regexp_replace(text, pattern, "").alias("trailing")))
    out = [found("greeting", wake_pattern(greetings, [*names, *fuzzy]))]
    if segmented:
        out.append(found("greeting", plain_wake_pattern(segmented)))
    if plain:
        out.append(found("plain", plain_wake_pattern(names)))
    return F.coalesce(*out)


def candidate_terms(text: Column) -> Column:
    """Names and technical tokens worth learning, in order, repeats included.

    Tokens that hold neither a capital nor a digit nor a joining mark are told by one pattern and looked at no more.
    """
    terms, gaps = F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)), F.split(text, _TERM, -1)
    last = lambda s: F.right(F.rtrim(s, F.lit(BLANKS)), F.lit(1))

    def keep(x: Column) -> Column:  # the term, the gap before it and the term before that
        t = x.t
        letters = F.regexp_replace(t, r"\P{L}", "")
        gap = last(x.g)
        prior = F.coalesce(F.when(gap != "", gap), F.right(x.p, F.lit(1)))
        initial = prior.isNull() | prior.isin(".", "!", "?")
        capitals = letters.rlike(r"[\p{Lu}\p{Lt}].*[\p{Lu}\p{Lt}]") & ~letters.rlike(r"\p{Ll}")
        marked = t.rlike(r"[\p{Nd}_+-]|^.+[\p{Lu}\p{Lt}]")
        named = t.rlike(r"[\p{Lu}\p{Lt}]") & ~initial
        return t.rlike(r"[\p{Lu}\p{Lt}\p{Nd}_+-]") & (letters != "") & (capitals | marked | named) & ~F.lower(t).isin(*COMMON) & ~F.lower(t).startswith("http")

    near = F.arrays_zip(terms.alias("t"), gaps.alias("g"), F.concat(F.array(F.lit(None).cast("string")), terms).alias("p"))
    return F.transform(F.filter(near, lambda x: x.t.isNotNull() & keep(x)), lambda x: x.t)


def split_terms(text: Column, delimiters: str = ",\n") -> Column:
    """Trimmed, non-empty parts; the delimiter sets of vocabularies differ, so they are a parameter."""
    return F.filter(F.transform(F.split(text, f"[{re.escape(delimiters)}]"), strip), lambda x: x != "")


def merged_corrections(local: Column, imported: Column) -> Column:
    """Struct (text, added): local and, after it, imported lines that it lacks; case and outer blanks of a line do not count.

    Null counts as empty; without a new line, local comes back as it is.  Lines are sorted by key, local ones first, so that
    of each key the first is found at once; a look for each key among all lines would take the square of their number.
    """

    def entries(c: Column, place: Callable[[Column], Column]) -> Column:
        trimmed = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(LINE_BLANKS)))
        return F.transform(trimmed, lambda x, i: F.struct(F.lower(x).alias("key"), place(i).alias("at"), x.alias("line")))

    def merged(fresh: Column) -> Column:
        added = F.transform(F.sort_array(F.transform(fresh, lambda x: F.struct(x["at"].alias("at"), x["line"].alias("line")))), lambda x: x["line"])
        kept = F.filter(F.array(strip(F.coalesce(local, F.lit("")))), lambda x: x != "")
        whole = F.when(F.size(fresh) > 0, F.array_join(F.concat(kept, added), "\n")).otherwise(F.coalesce(local, F.lit("")))
        return F.struct(whole.alias("text"), F.size(fresh).alias("added"))

    lines = F.sort_array(F.concat(entries(local, lambda i: F.lit(-1)), entries(imported, lambda i: i)))
    fresh = let(lines, lambda s: F.filter(s, lambda x, i: (x["at"] >= 0) & (x["key"] != "") & ~x["key"].eqNullSafe(F.get(s, i - 1)["key"])))
    return let(fresh, merged)


def truncate_middle(text: Column, limit: int) -> Column:
    head = limit * 2 // 5
    tail = limit - head - 4
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(head)), F.lit("\n[…]\n"), F.right(text, F.lit(tail)))).otherwise(text)


def snippet(text: Column, limit: int = 48) -> Column:
    t = F.trim(F.replace(text, F.lit("\n"), F.lit(" ")))
    return F.when(t == "", "(no transcript)").when(F.length(t) > limit, F.concat(F.left(t, F.lit(limit)), F.lit("..."))).otherwise(t)


def flatten(text: Column) -> Column:
    return F.nullif(F.replace(strip(text), F.lit("\n"), F.lit(" ")), F.lit(""))


def notes_body(text: Column) -> Column:
    return F.nullif(strip(F.substring_index(strip(text), "\n## Download", 1)), F.lit(""))


def duration(seconds: Column) -> Column:
    s = F.floor(seconds).cast("int")
    return F.format_string("%d:%02d", F.floor(s / 60).cast("int"), s % 60)
