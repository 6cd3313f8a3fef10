"""Comparators as native sort keys, and word patterns as regular expressions.

A comparator is a function of a text column whose values order and equal as the comparator says;
null stays null and sorts last. Everything stays inside the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.errors import SemanticFault, SyntaxFault

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A number (its sign only at a break; dotted sequences part by part), a word, or any other sign.
_TOKEN = r"(?<![0-9A-Za-z.])[+-]?\d+(?:\.\d+)?(?!\.?\d)|\d+|[A-Za-z\x{80}-\x{10FFFF}]+|[^\sA-Za-z0-9]"
_NUMBER = r"^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[Ii]nf(?:inity)?)$"
_DIGITS, _FLIPPED = "0123456789", "9876543210"


def folded(c: Column) -> Column:
    return F.translate(c, _UP, _LOW)


def _sized(text: Column, number: Column) -> list[Column]:
    """Fields that order numbers exactly: as a double first, then as a decimal, then (beyond 20 whole or 18 other digits) as digits."""
    plain = F.when(number, text)
    long = F.length(text) > 19
    exact = F.when(long, F.regexp_replace(plain, r"(\.\d{18})\d+$", "$1")).otherwise(plain).try_cast("decimal(38,18)")
    tail = F.when(long, F.regexp_extract(text, r"\.\d{18}(\d*?)0*$", 1)).otherwise("")
    tail = F.when(text.startswith("-"), F.concat(F.translate(tail, _DIGITS, _FLIPPED), F.lit("~"))).otherwise(tail)
    rest = F.when(number & exact.isNull(), F.regexp_replace(text, r"^[+-]?0*", "")).when(number, tail).otherwise(folded(text))
    kind = F.when(number, 0).otherwise(1)
    return [kind.alias("kind"), plain.try_cast("double").alias("about"), exact.alias("exact"), rest.alias("text")]


def default_key(c: Column) -> Column:
    """Words, numbers and signs one by one: numbers first and by size, words without case, shorter first."""
    tokens = F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(0))
    return F.when(c.isNotNull(), F.transform(tokens, lambda t: F.struct(*_sized(t, t.rlike(r"^[+-]?\d")))))


def number_key(c: Column) -> Column:
    """Numbers by value (exponents and infinities too) before all other texts, which go without case."""
    clean = F.trim(c)
    return F.when(c.isNotNull(), F.struct(*_sized(clean, clean.rlike(_NUMBER))))


def datetime_key(c: Column) -> Column:
    """ISO texts without case; those before the era (a minus) first, in reverse of their text."""
    low = folded(c)
    flipped = F.concat(F.translate(low, _DIGITS, _FLIPPED), F.lit("~"))
    old = c.startswith("-")
    return F.when(c.isNotNull(), F.struct(F.when(old, 0).otherwise(1).alias("era"), F.when(old, flipped).otherwise(low).alias("text")))


def octet_key(c: Column) -> Column:
    return c


KEYS = {
    "default": default_key, "unspecified": default_key, "": default_key, "octet": octet_key, "case-sensitive": octet_key,
    "case-insensitive": folded, "case": folded, "number": number_key, "numeric": number_key, "datetime": datetime_key,
}


def named(name: str | None) -> str:
    """The comparator's own name; a locale before ``;`` does not count."""
    short = (name or "default").rpartition(";")[2].lower()
    if short not in KEYS:
        raise SemanticFault(f"unknown comparator {name!r}")
    return {"unspecified": "default", "": "default", "case-sensitive": "octet", "case": "case-insensitive", "numeric": "number"}.get(short, short)


def compared(c: Column, op: str, text: str, comparator: str) -> Column:
    """``c op text``. An upper range that is open takes null in (null is greatest), but not for number and datetime."""
    if op == "~=":
        return matched(c, text, comparator)
    if op in ("=", "!="):
        if comparator == "default" and re.fullmatch(r"[A-Za-z]+", text):  # one word: no need of tokens
            same = F.trim(folded(c)) == text.lower()
        else:
            same = KEYS[comparator](c) == KEYS[comparator](F.lit(text))
        return same if op == "=" else ~F.coalesce(same, F.lit(False))
    key, bound = KEYS[comparator](c), KEYS[comparator](F.lit(text))
    if op in ("<", "<="):
        return F.coalesce(key < bound if op == "<" else key <= bound, F.lit(False))
    above = key > bound if op == ">" else key >= bound
    if comparator == "number":
        return F.coalesce(above & (key["kind"] == 0), F.lit(False))
    return F.coalesce(above, F.lit(comparator != "datetime"))


_LETTER = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
_GAP = rf"[^0-9A-Za-z\x{{80}}-\x{{10FFFF}}]"


def pattern_regex(text: str) -> str:
    """A word pattern as a Java regular expression.

    Words match whole words unless ``*`` (any word characters) adjoins; white space stands for any
    gap, signs for an optional one; ``^`` and ``$`` anchor; ``\\x`` is x itself; a number also
    matches itself with leading zeros or a zero fraction.
    """
    out, at, body = [], 0, text
    start = body.startswith("^")
    end = body.endswith("$") and not body.endswith("\\$")
    body = body[1 if start else 0 : -1 if end else None].strip()
    word = loose = False  # whether the last piece ended inside a word; whether it was a sign, which may be missing
    while at < len(body):
        ch = body[at]
        if ch == "\\" and at + 1 < len(body):
            out.append(re.escape(body[at + 1]))
            word, at = False, at + 2
        elif ch == "*":
            out.append(_LETTER + "*")
            word, at = False, at + 1
        elif ch.isspace():
            while at < len(body) and body[at].isspace():
                at += 1
            if word:
                out.append(rf"(?!{_LETTER})")
            out.append(_GAP + "+")
            word = loose = False
        elif m := re.compile(r"\d+(?:\.\d+)?(?!\.?\d)|\d+").match(body, at):
            lead = "" if at and (body[at - 1] == "*" or word or loose) else rf"(?<!{_LETTER})"
            whole, _, part = m[0].partition(".")
            part = part.rstrip("0")
            out.append(f"{lead}0*{whole.lstrip('0') or '0'}" + (rf"\.{part}0*" if part else r"(?:\.0+)?(?!\.?\d)"))
            word, loose, at = True, False, m.end()
        elif ch.isalnum() or ord(ch) >= 128:
            if not (word or loose or at and body[at - 1] == "*"):
                out.append(rf"(?<!{_LETTER})")
            out.append(re.escape(ch))
            word, loose, at = True, False, at + 1
        else:
            out.append(_GAP + "*")
            word, loose, at = False, True, at + 1
    if word:
        out.append(rf"(?!{_LETTER})")
    return (rf"^{_GAP}*" if start else "") + "".join(out) + (rf"{_GAP}*$" if end else "")


def matched(c: Column, text: str, comparator: str) -> Column:
    if comparator == "case-insensitive":
        raise SyntaxFault("this comparator has no ~=")
    if comparator == "number":
        raise SemanticFault("this comparator has no ~=")
    if comparator == "datetime":  # parts by their delimiters, from the start
        regex = "^" + "[^-:T]*".join(re.escape(p) for p in text.split("*"))
        return F.coalesce(folded(c).rlike(regex.lower()), F.lit(False))
    return F.coalesce(c.rlike(("" if comparator == "octet" else "(?i)") + pattern_regex(text)), F.lit(False))
