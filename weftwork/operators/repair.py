"""Repair of replies before strict parsing, as columns and, for the retry loop, in plain Python."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.functions.text import JS_SPACE, SPACES, js_trim

_FENCE = r"(?s)^```(?:json)?{s}*(.*?){s}*```$".replace("{s}", f"[{JS_SPACE}]")
_TRAILING = rf",([{JS_SPACE}]*[}}\]])"
_PLAIN_SPACE = "".join(map(chr, (*range(0x09, 0x0E), *SPACES, 0xFEFF)))
# Strings, hidden characters and everything else up to the next bracket, in one step.
_SKIP = r'''(?:[^"\\{}\[\]]++|"[^"\\]*+(?:\\.[^"\\]*+)*+"|\\.)*+'''
_TO_BRACKET = re.compile(_SKIP + r"([{}\[\]])", re.DOTALL)
_TO_END = re.compile(_SKIP, re.DOTALL)


def first_bracket(text: str) -> int:
    """Place of the first opening bracket of either kind, or -1."""
    m = re.search(r"[{\[]", text)
    return m.start() if m else -1


def scan(text: str, start: int = 0, to_end: bool = False) -> tuple[int, bool, int]:
    """(end, in string, depth) of the bracket that opens at ``start``.

    The end is behind the bracket that closes it, or -1. Brackets within strings do
    not count, their kinds need not match, and a backslash hides the next character
    anywhere. With ``to_end`` the scan goes on to the end of the text.
    """
    depth, at = 0, start
    while m := _TO_BRACKET.match(text, at):
        at = m.end()
        depth += 1 if m.group(1) in "{[" else -1
        if depth == 0 and not to_end:
            return at, False, 0
    rest = _TO_END.match(text, at).end()
    return -1, text[rest : rest + 1] == '"', depth


def balanced(text: str) -> str:
    """The first balanced bracket expression, or the text unchanged."""
    start = first_bracket(text)
    end = scan(text, start)[0] if start >= 0 else -1
    return text[start:end] if end > 0 else text


def looks_truncated(raw: str) -> bool:
    """Whether a reply begins with JSON that never closes. Text behind a closed value counts too."""
    text = raw.strip(_PLAIN_SPACE)
    if text[:1] not in ("{", "["):
        return False
    _, quoted, depth = scan(text, 0, to_end=True)
    return quoted or depth > 0


@F.pandas_udf(T.StringType())
def _balanced(text: pd.Series) -> pd.Series:
    return text.map(balanced, na_action="ignore")


@F.pandas_udf(T.BooleanType())
def truncated_column(raw: pd.Series) -> pd.Series:
    """``looks_truncated`` over a column; null stays null."""
    return raw.map(looks_truncated, na_action="ignore").astype("boolean")


def strip_fence(text: Column) -> Column:
    """Inner text where the whole text is one fenced block that is not empty."""
    inner = js_trim(F.regexp_extract(text, _FENCE, 1))
    return F.when(text.startswith("```") & text.endswith("```"), F.coalesce(F.nullif(inner, F.lit("")), text)).otherwise(text)


def extract_balanced(text: Column) -> Column:
    """``balanced`` over a column.

    Texts that already are JSON skip the Python scan: with duplicate keys allowed
    the tolerant parser accepts exactly those whose first value the scan would cut
    out, and trailing text does not change what is parsed.
    """
    ready = text.rlike(r"^[{\[]") & F.try_parse_json(text).isNotNull()
    return F.coalesce(_balanced(F.when(~F.coalesce(ready, F.lit(False)), text)), text)


def drop_trailing_commas(text: Column) -> Column:
    """No commas before closing brackets, within strings neither; one pass."""
    return F.regexp_replace(text, _TRAILING, "$1")


def with_repaired(df: DataFrame, raw: str, name: str) -> DataFrame:
    """``df`` with the repaired text of ``raw`` as ``name``.

    Each step is a column of its own, since the next one uses it several times.
    """
    steps = df.withColumn("__fence", strip_fence(js_trim(F.col(raw)))).withColumn("__cut", extract_balanced(F.col("__fence")))
    return steps.withColumn(name, drop_trailing_commas(F.col("__cut"))).drop("__fence", "__cut")


def repaired_text(raw: str) -> str:
    """The same in plain Python."""
    space = f"[{re.escape(_PLAIN_SPACE)}]"
    text = raw.strip(_PLAIN_SPACE)
    m = re.match(rf"^```(?:json)?{space}*(.*?){space}*```\Z", text, re.DOTALL)
    if m and m.group(1).strip(_PLAIN_SPACE):
        text = m.group(1).strip(_PLAIN_SPACE)
    return re.sub(rf",({space}*[}}\]])", r"\1", balanced(text))


def parse_failure(raw: str) -> str | None:
    """Why a reply holds no graph, or None if it does."""

    def refuse(name):
        raise ValueError(f"unexpected {name}")

    try:
        value = json.loads(repaired_text(raw), parse_constant=refuse)
    except (ValueError, RecursionError) as error:
        return f"Failed to parse JSON: {error}"
    return None if isinstance(value, (dict, list)) else "Response is not a JSON object"
