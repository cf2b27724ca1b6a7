"""Text rules as Column expressions: names, places, kinds. (STR, FIL-01, FIL-09, FIL-11)"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def flat(text: Column) -> Column:
    """White space collapsed and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def strip_stamp(text: Column) -> Column:
    """A name without a leading or trailing ISO date and time and without loose punctuation at its end. (STR-01)"""
    stamp = r"\d{4}-\d{2}-\d{2}(?:[ T_]\d{2}[:.-]?\d{2}(?:[:.-]?\d{2})?)?"
    return F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(flat(text), rf"^{stamp}\s*", ""), rf"\s*{stamp}$", "")), r"[ .:,;-]+$", "")


def clean_name(text: Column, fallback: Column) -> Column:
    """The stripped name, or ``fallback`` if nothing or only a recorder's placeholder is left. (STR-01)"""
    own = strip_stamp(text)
    return F.when((own == "") | F.lower(own).startswith("saved track"), fallback).otherwise(own)


def squeeze(text: Column) -> Column:
    """Spelling reduced to letters, with w-u, c-k, j-y and q-k made equal and doubles squeezed. (STR-05)"""
    letters = F.regexp_replace(F.lower(text), "[^a-z]", "")
    return F.regexp_replace(F.translate(letters, "wcjq", "ukyk"), r"(.)\1+", "$1")


def place_tokens(text: Column, stop: Sequence[str]) -> Column:
    """Capitalised words that are not stop words, each once, in order. (STR-03)"""
    words = F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), "'s", ""), F.lit(r"([A-Z][A-Za-z]+\d*)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: ~F.lower(w).isin(*stop)))


def name_variants(name: Column) -> Column:
    """Spellings to try in order: as given, without a village or station suffix, without a trailing 1 or 2, parts of slashes. (STR-10)"""
    bare = F.trim(F.regexp_replace(name, r"(?i)\s+(village|station)$", ""))
    numberless = F.trim(F.regexp_replace(bare, r"\s*[12]$", ""))
    parts = F.transform(F.split(bare, r"[/()]"), lambda p: F.trim(p))
    return F.array_distinct(F.filter(F.concat(F.array(F.trim(name), bare, numberless), parts), lambda p: p != ""))


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str | None) -> Column:
    """The label of the first pattern (case-insensitive, anywhere) that matches. (FIL-01, FIL-09)"""
    out = None
    for pattern, label in rules:
        test = F.coalesce(text, F.lit("")).rlike(f"(?i){pattern}")
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(default) if out is not None else F.lit(default)


def kind_set(text: Column, kinds: Sequence[tuple[str, str]], fallback: str) -> Column:
    """The sorted set of kinds whose word the text contains, or the fallback alone. (FIL-11)"""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(lowered.contains(word), F.lit(kind)) for word, kind in kinds)))))
    return F.when(F.size(found) == 0, F.array(F.lit(fallback))).otherwise(found)


def natural_key(text: Column) -> tuple[Column, Column]:
    """Sort keys: the number at the start (99 if none), then the text. (SRT-06)"""
    return F.coalesce(F.regexp_extract(text, r"^(\d+)", 1).try_cast("int"), F.lit(99)), text


def human_bytes(n: Column) -> Column:
    """1.5 KB, 3.0 MB and so on, in steps of 1024. (STR-17)"""
    out = None
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        value = F.format_string(f"%.1f {unit}", n / float(1024**power))
        out = F.when(n >= 1024**power, value) if out is None else out.when(n >= 1024**power, value)
    return out.otherwise(F.format_string("%d B", n.cast("long")))


@pandas_udf(DoubleType())
def sequence_ratio(a, b):  # noqa: ANN001, ANN201
    """Ratcliff-Obershelp similarity of two strings, in Arrow batches; no built-in function computes it. (STR-06)"""
    from difflib import SequenceMatcher

    import pandas as pd

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def file_label(stem: Column) -> Column:
    """A readable name from a file's stem: parts at its end that begin with a digit and hold a dash, or are a number, go; dashes are spaced. A stem of such parts alone stays. (STR-02)"""
    left = F.regexp_replace(stem, r"(^|_)(?:\d[^_]*-[^_]*|\d+)(?:_(?:\d[^_]*-[^_]*|\d+))*$", "")
    return F.when(left == "", stem).otherwise(F.replace(F.replace(left, F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" – ")))


def names_in_file(stem: Column, noise: Sequence[str]) -> Column:
    """The places that a file's stem names around the word "to", the first word of over two letters of each part; null if there are not two. (STR-04)"""
    plain = F.regexp_replace(F.regexp_replace(stem, r"\d{4}-\d{2}-\d{2}[_ ]?\d{0,2}-?\d{0,2}", " "), "[_,]+", " ")
    parts = F.split(plain, r"(?i)\bto\b")
    words = lambda p: F.filter(F.regexp_extract_all(F.regexp_replace(p, rf"(?i)\b(?:{'|'.join(noise)})\b", " "), F.lit("([A-Za-z][A-Za-z'’]+)"), F.lit(1)), lambda w: F.length(w) > 2)
    firsts = F.array_compact(F.transform(parts, lambda p: F.get(words(p), F.lit(0))))
    return F.when((F.size(parts) >= 2) & (F.size(firsts) >= 2), firsts)


def shorter_stems(name: Column) -> Column:
    """The name without its last word, without its last two, and so on: the longest first. (STR-09)"""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > 1, F.transform(F.sequence(F.size(words) - 1, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(words, 1, n), " "))).otherwise(F.array().cast("array<string>"))


def village_tokens(name: Column, noise: Sequence[str] = ("govt", "station", "village", "not", "named", "1", "2")) -> Column:
    """Lower-case words of letters and digits, without those that tell no village apart. (STR-11)"""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " ")), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*noise))


def alnum(text: Column) -> Column:
    """Lower-case letters and digits alone. (STR-12)"""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def compound_parts(label: Column) -> Column:
    """The places that a label like ``A / B (C)`` names. (STR-13)"""
    return F.filter(F.transform(F.split(F.regexp_replace(label, "[()]", "/"), "/"), lambda p: F.trim(p)), lambda p: p != "")


# Words that a facility's entry must all hold, and what it is called in a question; the first that fits.
PLAIN_FACILITIES = (
    (("airstrip",), "the airstrip"), (("aid post", "chw"), "the aid post with the CHW house"), (("aid post",), "the aid post"), (("elementary",), "the elementary school"),
    (("primary",), "the primary school"), (("high school",), "the high school"), (("health",), "the health centre"),
)


def plain_facility(facility: Column) -> Column:
    """What a facility is called in a question, else its entry up to the first comma. (STR-14)"""
    lowered, out = F.lower(facility), None
    for words, name in PLAIN_FACILITIES:
        has = lowered.contains(words[0])
        for w in words[1:]:
            has = has & lowered.contains(w)
        out = F.when(has, name) if out is None else out.when(has, name)
    return out.otherwise(F.split(lowered, ",")[0])
