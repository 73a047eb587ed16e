"""Column functions on texts and times."""

from __future__ import annotations

import string
import sys
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def char_width(c: str) -> int:
    """Two for characters of East Asian width F or W, one for others."""
    return 2 if unicodedata.east_asian_width(c) in "FW" else 1


def narrow(text: str) -> bool:
    """Whether every character surely is one wide: the first wide one is U+1100."""
    return text.isascii() or max(text) < "\u1100"


def text_width(text: str) -> int:
    return len(text) if narrow(text) else sum(map(char_width, text))


def _wide_ranges() -> str:
    """A character class of all that is two wide, from the Unicode table Python has."""
    wide = [p for p in range(sys.maxunicode + 1) if char_width(chr(p)) == 2]
    begins = [p for p, q in zip(wide, [-2, *wide], strict=False) if p != q + 1]
    ends = [p for p, q in zip(wide, [*wide[1:], -2], strict=True) if q != p + 1]
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{z:X}}}" for a, z in zip(begins, ends, strict=True)) + "]"


WIDE = _wide_ranges()
BLANKS = " \t\r\n"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def visible(c: Column) -> Column:
    """A text without what the pattern \\s matches; literal replacement takes a fraction of the pattern's time."""
    return reduce(lambda acc, x: F.replace(acc, F.lit(x)), " \t\n\x0b\f\r", c)


def apply_replacements(c: Column, pairs: dict[str, str]) -> Column:
    """Literal replacements one after another, longest source first (given order among equals)."""
    order = sorted((k for k in pairs if k), key=len, reverse=True)
    return reduce(lambda acc, k: F.replace(acc, F.lit(k), F.lit(pairs[k])), order, c)


def censor(c: Column, words: list[str], replacement: str = "*") -> Column:
    return apply_replacements(c, dict.fromkeys(words, replacement))


def truncate_text(c: Column, n: int) -> Column:
    """Texts of more than n characters: the first n - 3, right-trimmed, and three dots."""
    if n <= 3:
        return F.when(F.length(c) <= n, c).otherwise("." * max(0, n))
    short = F.concat(F.rtrim(F.substring(c, 1, n - 3), F.lit(BLANKS)), F.lit("..."))
    return F.when(F.length(c) <= n, c).otherwise(short)


def visual_width(c: Column) -> Column:
    """Two units for a wide character, one for others; texts of one byte a character aren't searched."""
    return F.when(F.octet_length(c) == F.length(c), F.length(c)).otherwise(F.length(c) + F.regexp_count(c, F.lit(WIDE)))


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm"""
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, ms % 1000)


def _two(n: Column) -> Column:
    """A number with two digits at least; format_string() parses its pattern for every row."""
    return F.when(n.between(0, 9), F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))


def ass_time(ms: Column) -> Column:
    """H:MM:SS.cc, to the nearest hundredth (half to even, as decimal rounding does)."""
    cs = F.floor(ms / 10)
    rest = ms - cs * 10
    cs = cs + F.when((rest > 5) | ((rest == 5) & (cs % 2 != 0)), 1).otherwise(0)
    parts = [F.floor(cs / 360000).cast("string"), ":", _two(F.floor(cs / 6000) % 60), ":", _two(F.floor(cs / 100) % 60), ".", _two(cs % 100)]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def escape_ass(c: Column) -> Column:
    for a, b in (("\\", r"\\"), ("{", r"\{"), ("}", r"\}"), ("\n", r"\N")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


#: Between two of these characters joined words keep a blank (fixed values).
SPACED = frozenset(string.ascii_letters + string.digits + "'\"")


def join_words(words: Column) -> Column:
    """Words as one text, with a blank only between two characters of SPACED."""
    spaced = "[" + "".join(sorted(SPACED)) + "]"
    return F.aggregate(
        words,
        F.lit(""),
        lambda acc, w: F.when(acc.rlike(f"{spaced}$") & w.rlike(f"^{spaced}"), F.concat(acc, F.lit(" "), w)).otherwise(F.concat(acc, w)),
    )


def safe_stem(path: Column, n: int = 80) -> Column:
    """The file name without suffix, other characters than letters, digits, - and _ dropped."""
    name = F.regexp_extract(F.regexp_replace(path, r"\\", "/"), r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    kept = F.substring(F.regexp_replace(F.replace(stem, F.lit(" "), F.lit("-")), r"[^\p{L}\p{N}_-]", ""), 1, n)
    return F.when(kept == "", "recording").otherwise(kept)


def half_up(c: Column) -> Column:
    """One decimal, halves up."""
    return F.floor(c * 10 + 0.5) / 10
