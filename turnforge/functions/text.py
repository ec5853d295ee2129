"""Text helpers: cleaning, tokens, sentences, fences, transcript lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnforge.constants import END_MARKER

# Fixed patterns.
# A run of letters of any script, or one Han character (Chinese has no spaces between words).
TOKEN_PATTERN = "\\p{IsHan}|[^\\P{L}\\p{IsHan}]+"
SENTENCE_SPLIT = "[.!?。！？]+"
PLACEHOLDER_PATTERN = "Person ?[XYZ]"
SPEAKER_TAG_PATTERN = "(?i)(user|assistant):"
FENCE_PATTERN = r"\A\s*```[a-zA-Z]*\s*|\s*```\s*\z"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_compat(c) -> Column:
    """Character-set strip of quotes, then of the characters ``u s e r : space``.

    This reproduces the original cleaning exactly, including its surprises:
    ``user: hello there`` becomes ``hello th`` and ``user: sure`` becomes empty.
    """
    return F.btrim(F.btrim(_c(c), F.lit('"')), F.lit("user: "))


def clean_prefix(c) -> Column:
    """Strip surrounding quotes, then one leading ``user: `` prefix (the evident intent)."""
    unquoted = F.btrim(_c(c), F.lit('"'))
    return F.when(unquoted.startswith("user: "), unquoted.substr(F.lit(7), F.length(unquoted))).otherwise(unquoted)


def clean(c, mode: str = "prefix") -> Column:
    if mode == "compat":
        return clean_compat(c)
    if mode == "prefix":
        return clean_prefix(c)
    raise ValueError(f"unknown clean mode {mode!r}")


def has_end_marker(c) -> Column:
    return F.coalesce(_c(c).contains(END_MARKER), F.lit(False))


def tokens(c) -> Column:
    """Lower-cased letter runs, and single Han characters."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(TOKEN_PATTERN), 0)


def token_set(c) -> Column:
    return F.array_distinct(tokens(c))


def sentence_count(c) -> Column:
    """Number of non-blank pieces between sentence-ending punctuation."""
    pieces = F.split(_c(c), SENTENCE_SPLIT, -1)
    return F.size(F.filter(pieces, lambda p: p.rlike(r"\S"))).cast("bigint")


def placeholder_hits(c) -> Column:
    return F.size(F.regexp_extract_all(_c(c), F.lit(PLACEHOLDER_PATTERN), 0)).cast("bigint")


def has_speaker_tag(c) -> Column:
    return F.coalesce(_c(c).rlike(SPEAKER_TAG_PATTERN), F.lit(False))


def strip_fences(c) -> Column:
    """Remove a surrounding fenced code block (```json ... ```)."""
    return F.regexp_replace(_c(c), FENCE_PATTERN, "")


def message_line(m: Column, newline: str = "delete") -> Column:
    """``role: content`` for one message struct; newlines deleted or kept."""
    content = m["content"]
    if newline == "delete":
        content = F.replace(content, F.lit("\n"), F.lit(""))
    elif newline != "keep":
        raise ValueError(f"unknown newline mode {newline!r}")
    return F.concat(m["role"], F.lit(": "), content)


def history_text(dialogue, newline: str = "delete", sep: str = "\n", terminate: bool = False) -> Column:
    """Render a message array as lines.  ``terminate`` puts ``sep`` after every line."""
    lines = F.transform(_c(dialogue), lambda m: message_line(m, newline))
    if terminate:
        return F.array_join(F.transform(lines, lambda s: F.concat(s, F.lit(sep))), "")
    return F.array_join(lines, sep)


def scene_text(fields: dict) -> Column:
    """Render named scene fields as ``Label: value`` lines (NULL fields skipped)."""
    return F.concat_ws("\n", *[F.when(_c(c).isNotNull(), F.concat(F.lit(f"{label}: "), _c(c).cast("string")))
                               for label, c in fields.items()])
