"""Text expressions: tags, markers, fenced JSON, choices, tags and fingerprints.

All native Columns but `strip_thinking`, `outer_object` and `sequence_similarity`,
which need positions that regular expressions cannot count; those are Arrow UDFs.
"""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(x: Column) -> Column:
    """Strip every kind of white space, not blanks alone."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def split_words(x: Column) -> Column:
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def word_count(x: Column) -> Column:
    return F.size(split_words(x))


def last_tag_block(x: Column, tag: str, fallback: Column | None = None) -> Column:
    """Text after the last start tag up to the next end tag, or to the end; without a tag the fallback (default null)."""
    parts = F.split(x, rf"(?i)<{re.escape(tag)}>")
    inner = F.element_at(F.split(F.element_at(parts, -1), rf"(?i)</{re.escape(tag)}>"), 1)
    return F.when(F.size(parts) > 1, trimmed(inner)).otherwise(fallback if fallback is not None else F.lit(None))


def observation(x: Column, tag: str) -> Column:
    """The tagged block, else the whole text, else a notice."""
    whole = trimmed(F.coalesce(x, F.lit("")))
    return F.when(whole == "", "No output").otherwise(last_tag_block(x, tag, whole))


def strip_marker(x: Column, marker: str) -> Column:
    """Drop a leading marker, or failing that every occurrence."""
    cut = F.when(F.startswith(x, F.lit(marker)), F.substr(x, F.lit(len(marker) + 1))).otherwise(F.replace(x, F.lit(marker), F.lit("")))
    return trimmed(cut)


def remove_marked_block(x: Column, begin: str, end: str) -> Column:
    return F.regexp_replace(x, rf"(?s)\Q{begin}\E.*?\Q{end}\E\n?", "")


FENCE = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"


def fenced_json(x: Column) -> Column:
    """The last fenced object with "scores", else the last fenced object, else null."""
    found = F.regexp_extract_all(x, F.lit(FENCE), F.lit(1))
    scored = F.filter(found, lambda b: b.contains('"scores"'))
    return F.coalesce(F.try_element_at(scored, F.lit(-1)), F.try_element_at(found, F.lit(-1)))


#: Spark's reader takes single quotes and bare names; commas before a closing bracket are dropped first, outside of strings.
LENIENT = {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true"}


def lenient_json(x: Column, schema: str) -> Column:
    return F.from_json(F.regexp_replace(x, r"""("(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+')|,(?=\s*[\]}])""", "$1"), schema, LENIENT)


def scores_alone(x: Column) -> Column:
    """The object that follows a first "scores", as text, however the rest is broken; else null."""
    return F.nullif(F.regexp_extract(x, r'"scores"\s*:\s*(\{[^{}]+\})', 1), F.lit(""))


def strip_fence(x: Column) -> Column:
    """A reply without the code fence around it and its language."""
    return trimmed(F.regexp_replace(F.regexp_replace(trimmed(x), r"^```(?:json)?", ""), r"```$", ""))


# The forms of a boxed choice, best first (the last one counts), and of a spoken one (the first counts).
BOXED = (r"(?i)\\boxed\{\s*([AB])\s*\}", r"(?i)\\\\boxed\{\s*([AB])\s*\}", r"(?i)\$\\boxed\{\s*([AB])\s*\}\$", r"(?i)boxed\{\s*([AB])\s*\}")
SPOKEN = (
    r"(?i)(?:answer|choice|select|choose|pick)\s*(?:is|:)?\s*\**\s*([AB])\b",
    r"(?i)\b([AB])\s*(?:is|appears|seems)\s+(?:more\s+)?(?:realistic|correct|better)",
    r"(?i)(?:Response|Option)\s+([AB])\s+is\s+(?:the\s+)?(?:real|correct|better)",
)


def boxed_choice(x: Column) -> Column:
    """A or B, once the thinking is removed; null where the text settles on neither."""
    x = strip_thinking(x)
    boxed = [F.try_element_at(F.regexp_extract_all(x, F.lit(p), F.lit(1)), F.lit(-1)) for p in BOXED]
    spoken = [F.nullif(F.regexp_extract(x, p, 1), F.lit("")) for p in SPOKEN]
    return F.upper(F.coalesce(*boxed, *spoken))


def choice_reward(choice: Column) -> Column:
    return F.when(choice == "A", 1.0).otherwise(0.0).cast("double")


def normalise_tag(x: Column) -> Column:
    slug = F.regexp_replace(F.lower(trimmed(F.coalesce(x, F.lit("")))), r"[^\p{L}\p{N}]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(slug, "^-+|-+$", ""), F.lit("")), F.lit("general"))


def content_tokens(x: Column) -> Column:
    """The set of lower-case words of three letters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def fingerprint(model: Column, lines: Column) -> Column:
    """Twelve hex digits of the SHA-1 of the model and the sorted lines."""
    return F.substring(F.sha1(F.concat(model, F.lit("\n"), F.array_join(F.array_sort(lines), "\n"))), 1, 12)


def model_key(x: Column) -> Column:
    """Lower-case last part of a model's path."""
    return F.lower(F.element_at(F.split(F.regexp_replace(x, "/+$", ""), "/"), -1))


def problem_kind(x: Column) -> Column:
    """A problem's text up to its details, 90 characters at most."""
    return F.left(F.split_part(F.split_part(F.split_part(x, F.lit(" ("), F.lit(1)), F.lit(";"), F.lit(1)), F.lit(":"), F.lit(1)), F.lit(90))


def clip(x: Column, limit: int = 6000) -> Column:
    note = F.concat(F.left(x, F.lit(limit)), F.lit("\n[truncated "), (F.length(x) - limit).cast("string"), F.lit(" characters]"))
    return F.when(F.length(x) > limit, note).otherwise(x)


def percent(x: Column) -> Column:
    return F.replace(trimmed(x), F.lit("%"), F.lit("")).try_cast("double")


def accepts(x: Column) -> Column:
    return F.startswith(F.upper(trimmed(x)), F.lit("ACCEPT"))


def redact(x: Column, secret: str) -> Column:
    return F.replace(x, F.lit(secret), F.lit("REDACTED"))


_TAGS = re.compile(r"<(/?)think>", re.I)


def thinking_removed(text: str, stop_tag: str = "") -> str:
    """One text without its thinking parts.

    An open tag reaches to the first later close tag that no earlier open one
    took. A close tag left over removes everything before it. An open tag left
    over removes up to `<stop_tag>` after it, or to the end.
    """
    tags = [(m.start(), m.end(), bool(m.group(1))) for m in _TAGS.finditer(text)]
    if not tags:
        return text
    closes = [(start, end) for start, end, closing in tags if closing]
    gone, free = [], 0  # both kinds come in order, so the closes before `free` are taken or left over
    for start, end, closing in tags:
        if closing:
            continue
        while free < len(closes) and closes[free][0] < start:
            gone.append((0, closes[free][1]))
            free += 1
        if free < len(closes):
            gone.append((start, closes[free][1]))
            free += 1
        else:
            stop = re.compile(rf"<{re.escape(stop_tag)}>", re.I).search(text, end) if stop_tag else None
            gone.append((start, stop.start() if stop else len(text)))
            if not stop:
                break  # the rest is gone
    gone.extend((0, end) for _, end in closes[free:])
    out, at = [], 0
    for start, end in sorted(gone):
        if start > at:
            out.append(text[at:start])
        at = max(at, end)
    return ("".join(out) + text[at:]).strip()


def strip_thinking(x: Column, stop_tag: str = "") -> Column:
    """`thinking_removed` of texts that hold a tag; the others stay in the JVM."""
    tagged = x.rlike("(?i)</?think>")

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else thinking_removed(t, stop_tag))

    return F.when(tagged, run(F.when(tagged, x))).otherwise(x)


_MARKS = re.compile(r'[{}"\\]')


def brace_mates(text: str) -> list[tuple[int, int | None]]:
    """(place of each opening brace, place just after the one that closes it), as a reader sees it who begins there; None if none does.

    Within braces, quotes open texts, in which a backslash takes the next character with it. Two readers can differ in whether they
    are within a text, so both views are kept, from the end to the start: for each mark and view the mark at which the depth first
    falls below that before it. Linear in the text.
    """
    marks = [(m.start(), m.group()) for m in _MARKS.finditer(text)]
    n = len(marks)
    plain: list[int | None] = [None] * (n + 2)
    quoted: list[int | None] = [None] * (n + 2)
    for k in range(n - 1, -1, -1):
        at, ch = marks[k]
        if ch == '"':
            plain[k], quoted[k] = quoted[k + 1], plain[k + 1]
        elif ch == "\\":
            plain[k], quoted[k] = plain[k + 1], quoted[k + 2] if k + 1 < n and marks[k + 1][0] == at + 1 else quoted[k + 1]
        elif ch == "}":
            plain[k], quoted[k] = k, quoted[k + 1]
        else:
            inner = plain[k + 1]
            plain[k], quoted[k] = None if inner is None else plain[inner + 1], quoted[k + 1]
    return [(at, None if (end := plain[k + 1]) is None else marks[end][0] + 1) for k, (at, ch) in enumerate(marks) if ch == "{"]


def balanced_objects(text: str, to_the_first_gap: bool = False) -> list[tuple[int, str]]:
    """(place, text) of the balanced objects that lie in no other one; a brace that is never closed hides nothing after it.

    to_the_first_gap: stop at an unclosed brace once there is one.
    """
    out, free = [], 0
    for at, end in brace_mates(text):
        if at < free:
            continue
        if end is not None:
            out.append((at, text[at:end]))
            free = end
        elif to_the_first_gap and out:
            break
    return out


def outer_braces(text: str, backward: bool = False, prefer: str = "") -> str | None:
    """The first balanced object, or the last one (if some hold `prefer`, the last of those), with strings and escapes honoured.

    A brace that is never closed does not hide the objects after it, but the last one is sought before the next of these.
    """
    found = [x for _, x in balanced_objects(text, to_the_first_gap=True)]
    if not backward:
        return found[0] if found else None
    wanted = [x for x in found if prefer and prefer in x]
    return (wanted or found)[-1] if found else None


@F.udtf(returnType="place int, start int, object string")
class BalancedObjects:
    """A lateral table of a text's balanced objects, in order; none for null. start counts code points from 0."""

    def eval(self, text: str):
        for i, (at, found) in enumerate(balanced_objects(text or "")):
            yield i, at, found


def greedy_object(x: Column) -> Column:
    """From the first opening brace to the last closing one, once the thinking is removed; null where there are none."""
    clean = strip_thinking(x)
    return F.nullif(F.regexp_extract(clean, r"(?s)\{.*\}", 0), F.lit(""))


def stable_id(prefix: str, *key: Column) -> Column:
    """An id of twelve hex digits that follows from the key: rows that agree in it have one id, nulls are told from empty texts."""
    parts = [F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("-")) for k in key]
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 12))


def outer_object(x: Column, backward: bool = False, prefer: str = "") -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else outer_braces(t, backward, prefer))

    return run(x)


def sequence_similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two canonical texts."""

    @F.pandas_udf("double")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(left, right, strict=True)], dtype="float64")

    return run(a, b)


def all_strings(x: Column) -> Column:
    """The distinct keys and texts of a JSON value, at any depth.

    Escaped backslashes and quotes are put aside as control characters, which no
    valid JSON text holds, so that a text ends at the next quote.
    """
    aside = F.replace(F.replace(x, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    back = lambda s: F.replace(F.replace(s, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    found = F.regexp_extract_all(aside, F.lit('"([^"]*+)"'), F.lit(1))
    return F.array_distinct(F.transform(found, lambda s: F.from_json(F.concat(F.lit('["'), back(s), F.lit('"]')), "array<string>")[0]))
