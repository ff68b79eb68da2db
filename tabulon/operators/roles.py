"""Column roles, decided on names before any data is read."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_prefix(columns: list[str], prefixes: dict[str, list[str]], other: str = "other") -> dict[str, list[str]]:
    """role -> columns whose names begin with one of its prefixes, the first role that fits; the rest are other. Order stays."""
    out: dict[str, list[str]] = {role: [] for role in [*prefixes, other]}
    for c in columns:
        out[next((role for role, starts in prefixes.items() if c.startswith(tuple(starts))), other)].append(c)
    return out


def require(columns: list[str], wanted: list[str]) -> None:
    missing = [c for c in wanted if c not in columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")


def partition(df: DataFrame, roles: dict[str, list[str]], keep: list[str] | None = None) -> dict[str, DataFrame]:
    """role -> df with that role's columns, and keep (keys) in each, so that parts can be joined again."""
    keep = keep or []
    return {role: df.select(*keep, *[c for c in cs if c not in keep]) for role, cs in roles.items()}


def features_and_label(df: DataFrame, label: str, drop: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """(df without the dropped columns, names of its feature columns)."""
    require(df.columns, [label])
    df = df.drop(*(drop or []))
    return df, [c for c in df.columns if c != label]


def pair_names(left: list[str], right: list[str], suffix: str = "", sep: str = "_") -> list[tuple[str, str, str]]:
    """(left, right, name) for every pair of columns that is to be compared."""
    return [(a, b, sep.join([x for x in (a, b, suffix) if x])) for a, b in product(left, right)]


def short_names(columns: list[str], drop_prefix: str, shorten: dict[str, str]) -> dict[str, str]:
    """old -> new names: without a prefix, with long parts replaced by short ones."""
    out = {}
    for c in columns:
        new = c.removeprefix(drop_prefix)
        for long, short in shorten.items():
            new = new.replace(long, short)
        out[c] = new
    return out


def to_xy(df: DataFrame, label: str, features: list[str] | None = None, untracked: list[str] | None = None, scaler: str | None = None, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(features, label) as two tables with a shared row key _row: the columns named, or all but the label and the untracked ones;
    scaler: minmax or zscore. keys: columns that tell the rows apart; without them equal rows are numbered, in parts of a
    table written once, so that both tables agree and no row of one joins two of the other."""
    from .encode import scale
    from .steps import written

    require(df.columns, [label, *(features or []), *(keys or [])])
    names = features or [c for c in df.columns if c not in (label, *(untracked or []))]
    if keys:
        rows = df.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in keys]))
    else:
        rows = written(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    x = rows.select("_row", *names)
    return (scale(x, names, scaler) if scaler else x), rows.select("_row", label)
