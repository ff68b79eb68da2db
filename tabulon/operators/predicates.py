"""Search predicates as Columns that the optimizer can push down, and as text for engines that take SQL."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains_any(columns: list[str], values: list[str]) -> Column:
    """Some column holds some value, ignoring case."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c)), F.lit(v.lower())) for c in columns for v in values])


def equals_any(columns: list[str], values: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(F.col(c)).isin(*[v.lower() for v in values]) for c in columns])


def as_sql(columns: list[str], values: list[str], exact: bool = False) -> str:
    """The same as text: values as they are, their % and _ escaped by ! where they have any."""
    quoted = [v.lower().replace("'", "''") for v in values]
    held = [v.replace("!", "!!").replace("%", "!%").replace("_", "!_") for v in quoted]
    if exact:
        return " OR ".join(f"lower({c}) = '{v}'" for c in columns for v in quoted)
    return " OR ".join(f"lower({c}) like '%{h}%'" + " escape '!'" * (h != v) for c in columns for v, h in zip(quoted, held, strict=True))


def as_regex(values: list[str]) -> str:
    """An alternation of the values as they are."""
    return "|".join(re.sub(r"([^\w\s])", r"\\\1", v) for v in values)


def search_text(columns: list[str], values: list[str], kind: str = "like", exact: bool = False) -> str:
    """A predicate as text, by kind: like (equality if exact) or regex."""
    if kind == "like":
        return as_sql(columns, values, exact)
    if kind != "regex":
        raise ValueError(f"unknown kind {kind}")
    pattern = as_regex([v.lower() for v in values]).replace("\\", "\\\\").replace("'", "\\'")
    return " OR ".join(f"lower({c}) rlike '{pattern}'" for c in columns)


def phrase(column: str, text: str) -> Column:
    """The phrase, ignoring case, before the end or a character that is no word character, dot or star."""
    return F.col(column).rlike("(?i)^.*" + re.escape(text) + r"([^\w.*]|$)")


def without_codes(df: DataFrame, codes: list[str], columns: list[str]) -> DataFrame:
    """Rows none of whose ^-separated code lists has one of the codes."""
    found = reduce(lambda a, b: a | b, [F.coalesce(F.arrays_overlap(F.split(F.col(c), r"\^"), F.array(*map(F.lit, codes))), F.lit(False)) for c in columns])
    return df.where(~found)
