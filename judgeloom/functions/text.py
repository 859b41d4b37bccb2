"""Strings as Python's text methods see them, canonical JSON and its digests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

_WHITE = r"[\s\x1c-\x1f\x85\p{Z}]"
# The digest of a payload is as many hex digits of the SHA-256 of its JSON with sorted keys, ", " and ": "
# between parts, and everything but printable ASCII escaped.
DIGEST_DIGITS = 16
ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}


def strip(c: Column) -> Column:
    """Both ends without any Unicode white space; the built-in trim takes spaces only."""
    return F.regexp_replace(c, rf"^{_WHITE}+|{_WHITE}+\z", "")


def first_letter(c: Column) -> Column:
    """The first character behind leading white space, in upper case; empty where there is none."""
    return F.upper(F.regexp_extract(c, rf"(?s)^{_WHITE}*(.)", 1))


def payload_digest(payload: dict) -> str:
    """The digest of a payload on the driver."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True).encode("ascii")).hexdigest()[:DIGEST_DIGITS]


def _unit(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))


def _escaped(text: Column) -> Column:
    """JSON's inside of a string. Printable runs are left whole; only other characters are looked at one by one."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))

    def part(x: Column) -> Column:
        code = F.ascii(x)
        far = code - 0x10000
        pair = F.concat(_unit(F.lit(0xD800) + F.shiftright(far, 10)), _unit(F.lit(0xDC00) + far.bitwiseAND(0x3FF)))
        out = F.when(x.rlike("^[ -~]"), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')))
        for raw, escape in ESCAPES.items():
            out = out.when(x == raw, F.lit(escape))
        return out.when(code > 0xFFFF, pair).otherwise(_unit(code))

    parts = F.transform(F.regexp_extract_all(text, F.lit("([ -~]+|[^ -~])"), F.lit(1)), part)
    return F.when(text.rlike("[^ -~]"), F.array_join(parts, "")).otherwise(plain)


def canonical_json(value: Column | dict | list | None) -> Column:
    """Canonical JSON of a string or integer column, or of objects (dict) and lists of such."""
    if value is None:
        return F.lit("null")
    if isinstance(value, dict):
        fields = [F.concat(F.lit(f"{json.dumps(k)}: "), canonical_json(value[k])) for k in sorted(value)]
        return F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    if isinstance(value, list):
        return F.concat(F.lit("["), F.concat_ws(", ", *map(canonical_json, value)), F.lit("]"))
    text = value.cast("string")
    number = F.typeof(value).isin("tinyint", "smallint", "int", "bigint", "boolean")
    return F.when(value.isNull(), "null").when(number, text).otherwise(F.concat(F.lit('"'), _escaped(text), F.lit('"')))


def digest_column(fields: dict) -> Column:
    """``payload_digest`` of an object of columns, within the engine's own code."""
    return F.substring(F.sha2(F.encode(canonical_json(fields), "UTF-8"), 256), 1, DIGEST_DIGITS)
