"""Ids, timestamps and datatype numbers as texts, and back."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.errors import SemanticFault

#: The first 17 digits of an id's text (the database's part), fixed so that texts are comparable.
DATABASE = "00000012400034568"
#: Names of datatype numbers 1 to 9. Fixed values of the format.
DATATYPES = ("null", "string", "integer", "float", "guid", "timestamp", "url", "bytestring", "boolean")


def guid(c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.lit(DATABASE), F.lpad(F.lower(F.hex(c)), 15, "0")))


def guid_text(n: int | None) -> str | None:
    return None if n is None else f"{DATABASE}{n:015x}"


def guid_number(text: str) -> int:
    """The id of a rendered guid; also of the plain short hexadecimal form."""
    if not re.fullmatch(r"[0-9a-fA-F]{1,32}", text):
        raise SemanticFault(f"{text!r} is no guid")
    return int(text[-15:], 16)


def timestamp(c: Column) -> Column:
    """(seconds << 16 | sequence) as yyyy-mm-ddThh:mm:ss.nnnnZ; the digits after the point are the sequence."""
    seconds = F.shiftright(c, 16)
    day = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")
    sequence = c.bitwiseAND(65535).cast("string")
    return F.concat(day, F.lit("."), F.lpad(sequence, F.greatest(F.length(sequence), F.lit(4)), "0"), F.lit("Z"))


def timestamp_number(text: str, last: bool = False) -> int:
    """The number of a timestamp text; parts left out are the least (or, with ``last``, a missing sequence the greatest)."""
    m = re.fullmatch(r"(\d{4})(?:-(\d\d)(?:-(\d\d)(?:T(\d\d)(?::(\d\d)(?::(\d\d)(?:\.(\d+))?)?)?)?)?)?Z?", text)
    if not m:
        raise SemanticFault(f"{text!r} is no timestamp")
    year, month, day, hour, minute, second = (int(x) if x else d for x, d in zip(m.groups()[:6], (1970, 1, 1, 0, 0, 0)))
    seconds = int(datetime(year, month, day, hour, minute, second, tzinfo=timezone.utc).timestamp())
    return seconds << 16 | (int(m[7]) if m[7] else 65535 if last else 0)


def datatype(c: Column) -> Column:
    """The name of a datatype number, or the number as text; null for 1."""
    out = F.when(c == 1, F.lit(None).cast("string"))
    for n, name in enumerate(DATATYPES[1:], 2):
        out = out.when(c == n, F.lit(name))
    return out.otherwise(c.cast("string"))


def datatype_number(text: str) -> int:
    n = DATATYPES.index(text) + 1 if text in DATATYPES else int(text) if text.isdigit() else 0
    if not 1 <= n <= 255:
        raise SemanticFault(f"{text!r} is no datatype")
    return n
