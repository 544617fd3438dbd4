"""Routing, classification, repair and validation rules as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

# The names by which contexts are told, answer keys in order of preference, words that must be kept.
CODE_APPS = ("terminal", "iterm", "ghostty", "warp", "xcode", "visual studio code", "vscode", "cursor", "zed")
DOCUMENT_APPS = ("pages", "notes", "obsidian", "notion", "microsoft word")
MARKDOWN_SURFACES = ("obsidian", "notion", "bear", "typora", "ia writer", "zettlr", "logseq", "github", "gitlab", "hackmd", "stack overflow")
ANSWER_KEYS = ("cleaned_text", "clean_text", "cleaned", "corrected_text", "rewritten_text", "text", "output", "result", "response", "answer")
CHAT_APPS, CASUAL_APPS, MAIL_NAMES = ("slack", "msteams", "microsoft teams"), ("discord", "whatsapp", "telegram"), ("outlook", "gmail")
CASUAL_BUNDLE, CASUAL_NAME, MAIL_BUNDLE, MAIL_NAME, DOCUMENT_TITLE = "com.apple.mobilesms", "messages", "com.apple.mail", "mail", "google docs"
ASSISTANT_PREFIXES = ("here is", "here's", "certainly", "sure,", "i'm sorry", "i am sorry", "as an ai", "i can't", "i cannot")
# Why an answer is rejected, the marks that wrap a text in markdown, the words that ask for them.
EMPTY, ASSISTANT, EXPANDED, SHORTENED, WRAPPED = "empty output", "assistant-style response", "unexpectedly expanded the transcript", "dropped most of the transcript", "wrapped the transcript in markdown"
DROPPED = 'dropped the spoken word "%s"'
MARKS, ASKS_FOR_MARKS = ("```", "> ", "#"), ("code block", "code fence", "heading", "quote", "markdown")
# Codes and words of messages that tell of a missing connection or a late answer, and what is shown for them.
OFFLINE_CODES, LATE_CODE = ("notConnectedToInternet", "networkConnectionLost", "cannotConnectToHost", "cannotFindHost", "dnsLookupFailed"), "timedOut"
OFFLINE_WORDS, LATE_WORDS = ("offline", "internet connection", "not connected", "network", "cannot find host"), ("timed out", "timeout")
OFFLINE, LATE = "No internet — check connection", "Request timed out — try again"


def _any(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def _lower(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def writing_context(app: Column, bundle: Column, title: Column) -> Column:
    app, bundle, title = _lower(app), _lower(bundle), _lower(title)
    identity = F.concat_ws(" ", app, bundle)
    everything = F.concat_ws(" ", identity, title)
    bare = F.regexp_replace(everything, "[a-z0-9._%+-]+@[a-z0-9.-]+", " ")
    return (
        F.when(_any(everything, CHAT_APPS), "workChat")
        .when(_any(everything, CASUAL_APPS) | bundle.contains(CASUAL_BUNDLE) | (app == CASUAL_NAME), "casualChat")
        .when(bundle.contains(MAIL_BUNDLE) | (app == MAIL_NAME) | _any(bare, MAIL_NAMES), "email")
        .when(_any(identity, CODE_APPS), "codeOrTerminal")
        .when(_any(identity, DOCUMENT_APPS) | title.contains(DOCUMENT_TITLE), "document")
        .otherwise("neutral")
    )


def markdown_surface(app: Column, bundle: Column, title: Column) -> Column:
    return _any(F.concat_ws(" ", _lower(app), _lower(bundle), _lower(title)), MARKDOWN_SURFACES)


def formality(config: Column, context: Column) -> Column:
    """Of a map context -> formality; code is exempt, unknown values are balanced."""
    found = F.try_element_at(config, context)
    return F.when(context == "codeOrTerminal", "balanced").when(found.isin("casual", "balanced", "formal"), found).otherwise("balanced")


def display_text(clean: Column, raw: Column) -> Column:
    return F.coalesce(F.nullif(strip(clean), F.lit("")), strip(raw))


def full_text(clean: Column, raw: Column) -> Column:
    return F.when(strip(clean) != "", clean).otherwise(raw)


def revert_target(raw: Column, clean: Column) -> Column:
    r, c = strip(raw), strip(clean)
    return F.when((r != "") & (c != "") & (r != c), r)


def replaces_previous(raw: Column) -> Column:
    return F.upper(F.regexp_extract(raw, r"^([^\r\n]*)[\r\n]", 1)).rlike(r"(?U)^\s*REPLACE_PREVIOUS\s*\z")


def routed_text(raw: Column) -> Column:
    route = F.upper(F.trim(F.regexp_extract(raw, r"^([^\r\n]*)[\r\n]", 1)))
    return F.when(route.isin("REPLACE_PREVIOUS", "INSERT"), strip(F.regexp_replace(raw, r"^[^\r\n]*[\r\n]", ""))).otherwise(raw)


def strip_fence(text: Column) -> Column:
    """The inside of a text that is one fenced block."""
    t = strip(text)
    return F.when(t.rlike(r"(?s)^```[a-zA-Z0-9+#-]*[ \t]*\n(?:.*\n)?[ \t]*```\z"), strip(F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n", ""), r"\n?[ \t]*```\z", ""))).otherwise(t)


def json_answer(text: Column) -> Column:
    """The first string among the answer keys, whatever their case, of an object that has no other keys; else null."""
    known = F.array(*[F.lit(k) for k in ANSWER_KEYS])

    def found(entries: Column) -> Column:
        texts = lambda k: F.get(F.filter(entries, lambda e: (F.lower(e.key) == k) & (F.schema_of_variant(e.value) == "STRING")), F.lit(0))["value"]
        fine = (F.size(entries) > 0) & ~F.exists(entries, lambda e: ~F.array_contains(known, F.lower(e.key)))
        return F.when(fine, F.coalesce(*[F.try_variant_get(texts(k), "$", "string") for k in ANSWER_KEYS]))

    def answer(t: Column) -> Column:
        return F.when(t.startswith("{") & t.endswith("}"), let(F.map_entries(F.from_json(t, "map<string,variant>")), found))

    return let(strip(text), answer)


def unwrap(text: Column) -> Column:
    return let(strip(text), lambda t: F.coalesce(strip(json_answer(t)), F.when(t.startswith("```"), strip(json_answer(strip_fence(t)))), t))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)))


def rejection(output: Column, source: Column, must_keep: tuple[str, ...] = (), allows_expansion: bool = False) -> Column:
    """Why a cleaned text is rejected, or null; must_keep: words that may not be dropped."""
    n, m = F.greatest(F.length(source), F.lit(1)), F.length(output)
    out = F.when(output == "", EMPTY)
    start = F.lit(False)
    for p in ASSISTANT_PREFIXES:
        start = start | F.lower(output).startswith(p)
    out = out.when(start, ASSISTANT)
    if allows_expansion:
        return out
    out = out.when(m > F.greatest(n * 2, n + 200), EXPANDED).when(m * 2 < n, SHORTENED)
    if must_keep:
        dropped = F.array_min(F.array_except(F.array_intersect(word_set(source), F.array(*[F.lit(w) for w in must_keep])), word_set(output)))
        out = out.when(dropped.isNotNull(), F.format_string(DROPPED, dropped))
    wrapped = F.lit(False)
    for mark in MARKS:
        wrapped = wrapped | (strip(output).startswith(mark) & ~strip(source).startswith(mark))
    return out.when(wrapped & ~_any(F.lower(source), ASKS_FOR_MARKS), WRAPPED)


_WORD = r"[\p{L}\p{N}'’]+"


def strip_repeated_prefix(text: Column, before: Column) -> Column:
    """Without the words at the start that the text before the caret ends with: 3 or more, or all of 2."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(_WORD), F.lit(0))

    def repeated(x: Column) -> Column:
        most = F.least(F.size(x.b), F.size(x.o))
        ks = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
        k = F.coalesce(F.array_max(F.filter(ks, lambda i: F.slice(x.b, -i, i) == F.slice(x.o, F.lit(1), i))), F.lit(0))
        return F.when((k >= 3) | ((k == F.size(x.b)) & (k >= 2)), k)

    def rest(k: Column) -> Column:  # the gaps after the first k words, each with its word
        gaps, own = F.split(text, _WORD, -1), F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
        left = F.zip_with(F.slice(gaps, k + 1, F.greatest(F.size(gaps) - k, F.lit(0))), F.slice(own, k + 1, F.greatest(F.size(own) - k, F.lit(0))), lambda g, w: F.concat(g, F.coalesce(w, F.lit(""))))
        return F.nullif(F.regexp_replace(F.array_join(left, ""), r"(?U)^[\s,;:—–-]+", ""), F.lit(""))

    count = let(F.struct(words(before).alias("b"), words(text).alias("o")), repeated)
    return F.coalesce(let(count, lambda k: F.when(k.isNotNull(), rest(k))), text)


def caret_continues(before: Column) -> Column:
    newline = before.rlike(r"(?U)[\n\r\x{85}\x{2028}\x{2029}]\s*\z")
    scan = F.regexp_replace(strip(before), "[\"'”’)\\]]+\\z", "")
    return F.coalesce(~newline & (scan != "") & ~scan.rlike(r"[.!?…]\z"), F.lit(False))


def harmonize_case(text: Column, transcript: Column, before: Column) -> Column:
    first = F.regexp_extract(text, r"^[\p{L}'’]+", 0)
    mixed = F.substr(first, F.lit(2)).rlike(r"\p{Lu}")
    heard = F.array_contains(F.regexp_extract_all(transcript, F.lit(r"[\p{L}'’]+"), F.lit(0)), F.lower(first))
    head, rest = F.left(text, F.lit(1)), F.substr(text, F.lit(2))
    lowered = caret_continues(before) & head.rlike(r"^\p{Lu}") & ~mixed & heard
    raised = ~caret_continues(before) & head.rlike(r"^\p{Ll}") & ~mixed
    usable = before.isNotNull() & (strip(before) != "") & (text != "")
    return F.when(usable & lowered, F.concat(F.lower(head), rest)).when(usable & raised, F.concat(F.upper(head), rest)).otherwise(text)


def error_message(code: Column, message: Column, online: Column) -> Column:
    none = F.lit(OFFLINE)
    late = F.when(online, LATE).otherwise(none)
    lower = F.lower(message)
    return (
        F.when(code.isin(*OFFLINE_CODES), none)
        .when((code == LATE_CODE) | _any(lower, LATE_WORDS), late)
        .when(_any(lower, OFFLINE_WORDS), none)
        .otherwise(message)
    )


def mouse_button(n: Column) -> Column:
    """struct(bindable, label, normalized) of a 0-based button number; 2 is the middle button, 3 the default."""
    fine = n >= 2
    return F.struct(fine.alias("bindable"), F.when(~fine, "Unsupported button").when(n == 2, "Middle Button").otherwise(F.concat(F.lit("Button "), (n + 1).cast("string"))).alias("label"), F.when(fine, n).otherwise(3).alias("normalized"))


def session_intent(mode: Column, enabled: Column, selection: Column, modifier_held: Column) -> Column:
    """dictation or command; null where a manual command has no selection."""
    some = F.coalesce(strip(selection), F.lit("")) != ""
    return F.when(~enabled, "dictation").when(mode == "automatic", F.when(some, "command:automatic").otherwise("dictation")).when(~modifier_held, "dictation").when(some, "command:manual")


def restored_intent(intent: Column, selection: Column) -> Column:
    """A stored intent as it may run again: a command only with its selection (an empty one is one), else dictation."""
    return F.when(intent.isin("command:automatic", "command:manual") & selection.isNotNull(), intent).otherwise("dictation")


def thumbnail_url(url: Column, pixels: int = 44) -> Column:
    """A picture's address that asks for a size."""
    return F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit(f"s={pixels}"))


def recognition_terms(terms: Column, hints: list[str], enabled: Column) -> Column:
    """The text of the active terms, and where wake phrases are on, a line for each of their spellings."""
    lines = F.filter(F.array(terms, *map(F.lit, hints)), lambda x: x != "")
    return F.when(F.coalesce(enabled, F.lit(False)), F.array_join(lines, "\n")).otherwise(terms)
