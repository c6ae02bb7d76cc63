"""Several values packed in one string field: one value per row, with its place.

Method: the string is split on its structural quote characters. Pieces at odd places are literals and kept as
they are; pieces at even places are split on delimiters; an ordered fold puts both back together, and the place
in the result is the value's ordinal. All of it is Catalyst expressions: no shuffle, no Python.

Defined results
- null, blank, bracket-only or placeholder fields have no values;
- an empty entry has no place and is not counted; repeated values stay;
- outside quotes a delimiter ends a value only where a value can end: ``,`` ``;`` ``|`` inside ``?ids=1,21`` or
  ``;v=9`` belong to the value, white space never does;
- an absolute URL that starts inside a run of text starts a value of its own, unless ``=`` stands before it
  (a URL handed over as a parameter);
- an unclosed quote is closed at the end of the field;
- private code points stand for literal quotes while the field is cut; a field that holds them itself keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.session import spread

_DOUBLE = "﷐"
_SINGLE = "﷑"
_HELD = "\ufdd2"  # stands before a digit for one of these three that the field holds itself
_SPACE = r"[\s  -​　﻿]"
_NUMBER = r"[\(\[]?\d{1,4}[\]\).:]+"
#: Tokens that only separate: joining words, marks, bullets and numbering.
_SEPARATOR = rf"(?:[-*•·‖|,;&+/→\[\]\(\)]+|->|=>|{_NUMBER}|(?i:and|or|und|oder|et|ou|y|o|e))"
#: What a field holds that was filled in only to hold something.
PLACEHOLDERS = ("", "-", "--", "none", "null", "nil", "n/a", "na", "nan", "tbd", "unknown", "?", "[]", "{}", "()")


def _quotes_marked(text: Column) -> Column:
    """``text`` with ``"`` for structural quotes only, literal ones as private code points."""
    first = F.regexp_extract(text, rf"(?:^|{_SPACE}|[,;|\[\(<，；、>])([\"'])", 1)
    escaped = F.regexp_replace(text, r'\\"', _DOUBLE)
    escaped = F.regexp_replace(escaped, r"\\'", _SINGLE)
    # a doubled quote is an escape unless it is an empty entry of its own
    doubled = F.regexp_replace(
        escaped, rf'(?<=[^\s ,;|\[\("])""(?=[^"])|(?<=[^"])""(?=[^\s ,;|\]\)"])', _DOUBLE
    )
    single = F.regexp_replace(F.regexp_replace(escaped, '"', _DOUBLE), r"''(?=\w)|(?<=\w)''(?=\s\w)", _SINGLE)
    single = F.regexp_replace(
        single, rf"(?<=^|{_SPACE}|[,;|\[\(，；、>])'|'(?=$|{_SPACE}|[,;|\]\)，；、<])", '"'
    )
    return (
        F.when(first == F.lit('"'), doubled).when(first == F.lit("'"), single).otherwise(F.regexp_replace(text, '"', _DOUBLE))
    )


def _delimited(piece: Column) -> Column:
    """Values of a piece outside quotes."""
    # a pattern is tried only where its sign is: most fields hold none of them
    text = F.when(F.contains(piece, F.lit("<")), F.regexp_replace(piece, r"(?i)<br\s*/?>", " ")).otherwise(piece)
    text = F.translate(text, "<、，；‖•·→", " " * 8)
    text = F.when(F.contains(text, F.lit(">")), F.translate(F.regexp_replace(text, rf"(?<=^|{_SPACE})(?:->|=>)(?=$|{_SPACE})", " "), ">", " ")).otherwise(text)
    text = F.regexp_replace(text, r"(?<=[^=\s])(?=https?://)", " ")
    text = F.regexp_replace(text, rf"[,;|]+(?=$|{_SPACE}|[,;|\]\)]|[\w.-]+/)|(?<=^|{_SPACE})[,;|]+", " ")
    tokens = F.split(text, rf"{_SPACE}+")
    plain = lambda t: F.startswith(t, F.lit("http"))  # noqa: E731 - no numbering in front, no separator
    tokens = F.transform(tokens, lambda t: F.when(plain(t), t).otherwise(F.regexp_replace(t, rf"^(?:{_NUMBER})(?=https?://|[a-z])|^[\[\(]+(?=[a-z])", "")))
    tokens = F.filter(tokens, lambda t: (t != F.lit("")) & (plain(t) | ~t.rlike(rf"^{_SEPARATOR}$")))
    tokens = F.transform(tokens, lambda t: F.when(t.rlike(r"[\(\[]"), t).otherwise(F.regexp_replace(t, r"[\]\)]+$", "")))
    return F.filter(tokens, lambda t: t != F.lit(""))


def packed_values(text: Column) -> Column:
    """``ARRAY<STRING>`` of the bare values of a packed field; empty for null, blank and placeholder fields."""
    own = F.coalesce(text.rlike(f"[{_DOUBLE}{_SINGLE}{_HELD}]"), F.lit(False))
    kept = text
    for k, mark in ((2, _HELD), (0, _DOUBLE), (1, _SINGLE)):
        kept = F.replace(kept, F.lit(mark), F.lit(f"{_HELD}{k}"))
    pieces = F.split(_quotes_marked(F.when(own, kept).otherwise(text)), '"')
    folded = F.flatten(
        F.transform(
            pieces,
            lambda piece, place: F.when(
                place % 2 == 1, F.filter(F.array(F.regexp_replace(piece, rf"^{_SPACE}+|{_SPACE}+$", "")), lambda v: v != F.lit(""))
            ).otherwise(_delimited(piece)),
        )
    )
    def back(v: Column) -> Column:
        for k, mark in ((0, _DOUBLE), (1, _SINGLE), (2, _HELD)):
            v = F.replace(v, F.lit(f"{_HELD}{k}"), F.lit(mark))
        return v

    quoted = F.transform(folded, lambda v: F.translate(v, _DOUBLE + _SINGLE, "\"'"))
    bare = F.when(own, F.transform(quoted, back)).otherwise(quoted)
    empty = F.array().cast("array<string>")
    placeholder = F.lower(F.trim(text)).isin(*PLACEHOLDERS)
    return F.when(text.isNull() | placeholder, empty).otherwise(bare)


def unpack(df: DataFrame, key: str, field: str, least: int = 1, key_name: str = "row_key") -> DataFrame:
    """One row per value of ``field``: ``(key_name, val_pos, val)``; fields of fewer than ``least`` values give none.

    Only the two named columns are read, whatever else the table holds.
    """
    rows = spread(df.select(F.col(key).alias(key_name), F.col(field).alias("__field")))
    # the marker, which no filter may pass, keeps Catalyst from computing the array again in the filter and the explosion
    cut = rows.select(key_name, packed_values(F.col("__field")).alias("__values"), F.monotonically_increasing_id().alias("__once"))
    kept = cut.where((F.col("__once") >= 0) & (F.size("__values") >= least))
    return kept.select(key_name, F.posexplode("__values").alias("val_pos", "val"))
