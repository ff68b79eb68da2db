"""Text cleaning and token functions, Column to Column; all of them stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the cleaner, words that stand for no code, marks that become spaces, dates, and the tail of a code.
STOP_WORDS = ["IN", "FROM", "ON", "OR", "OF", "BY", "AND", "&", "TO"]
NOISY_CODES = ["request", "no loinc needed", ".", ";", "coumt", "unloinc"]

_TO_SPACE = ",.:\t^+*~()![]{}_|\""
DATES = r"\d{1,2}[/-]\d{1,4}([/-]\d{2,4})*|\d{6}"
TAIL = r"(\.|;)[a-zA-Z0-9]*"


def standardize(c: Column) -> Column:
    """Upper-cased and trimmed; null is empty."""
    return F.coalesce(F.upper(F.trim(c)), F.lit(""))


def _any_of(marks: str) -> str:
    return "[" + "".join("\\" + x if x in "^[]\\-" else x for x in marks) + "]"


def _cuts(stop: Iterable[str]) -> str:
    """What a cut removes from tokens that stand one blank apart: all of a token from its first empty piece or stop word on, where
    / \\ and - part the pieces."""
    words = "|".join("".join(x if x.isalnum() else "\\" + x for x in w) for w in stop)
    whole = rf"(?:{words})(?=[/\\ -]|\z)" if words else r"(?!)"
    return rf"(?<![^ ])(?:[/\\-]|{whole})[^ ]*|[/\\-](?:[/\\-]|{whole})[^ ]*"


def clean_tokens(c: Column, stop: Iterable[str] = STOP_WORDS) -> Column:
    """Tokens of a term: punctuation to space, dates out, first occurrences only; then each token is cut at / \\ - and its
    pieces count up to the first empty one or stop word. Regular expressions run over the whole term, as they never cross a blank."""
    plain = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("'"), F.lit("")), DATES, "")  # dates hold no mark
    tokens = F.array_distinct(F.filter(F.split(plain, _any_of(_TO_SPACE + " ")), lambda t: t != ""))
    pieces = F.regexp_replace(F.array_join(tokens, " "), _cuts(stop), "")
    return F.filter(F.split(pieces, r"[ /\\-]"), lambda t: t != "")


def clean_term(c: Column, stop: Iterable[str] = STOP_WORDS) -> Column:
    return F.array_join(clean_tokens(c, stop), " ")


def dictionary_tokens(c: Column, stop: Iterable[str] = STOP_WORDS) -> Column:
    """Tokens of a dictionary text: more marks are spaces, stop words go, repeats stay."""
    marks = _TO_SPACE + "-/\\#?%<>@="
    text = F.translate(F.coalesce(c, F.lit("")), marks + "'", " " * len(marks))
    return F.filter(F.split(text, " "), lambda t: ~t.isin("", *stop))


def strip_brackets(c: Column) -> Column:
    """Removes brackets that hold letters, digits, blanks and slashes only."""
    return F.regexp_replace(c, r"\[[A-Za-z0-9\s/]*\]", "")


def dedup_words(c: Column, sep: str = " ") -> Column:
    return F.array_join(F.array_distinct(F.split(c, sep)), sep)


def remove_null_like(values: Column) -> Column:
    """Entries without punctuation, trimmed; empty and null ones go."""
    return F.filter(F.transform(values, lambda v: F.trim(F.regexp_replace(v, r"\p{Punct}", ""))), lambda v: v.isNotNull() & (v != ""))


def conjoin(*columns: Column, sep: str = " ") -> Column:
    """Trimmed values joined; nulls and empties are skipped."""
    return F.concat_ws(sep, *[F.nullif(F.trim(c), F.lit("")) for c in columns])


def dehyphenate(c: Column, drop_check_digit: bool = False) -> Column:
    return F.regexp_replace(c, r"-\d+", "") if drop_check_digit else F.replace(c, F.lit("-"), F.lit(""))


def dequote(c: Column) -> Column:
    return F.replace(c, F.lit('"'), F.lit(""))


def trim_tail(c: Column) -> Column:
    """Lower-cased, without every . or ; and the letters and digits behind it."""
    return F.regexp_replace(F.lower(c), TAIL, "")


def replace_values(c: Column, values: Iterable[str], new: str) -> Column:
    """Lower-cased; a whole cell that equals one of values becomes new."""
    return F.when(F.lower(c).isin(*values), F.lit(new)).otherwise(F.lower(c))


def resolve_value(name: Column, value: Column) -> tuple[Column, Column]:
    """(name, value): a name that is a number is no name. Equal to the value it is dropped; beside another number it stays
    as text; beside a text, that text is the name."""
    as_number = lambda c: F.try_to_number(c, F.lit("S9999999999D999999"))
    is_number = as_number(name).isNotNull()
    new = F.when(~is_number, name).when(name == value, F.lit("")).when(as_number(value).isNotNull() | value.isNull(), name).otherwise(value)
    return new, value


def tokenize(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([-0-9a-z_:.]+)"), 1)


def ngrams(tokens: Column, n: int, ordered: bool = True) -> Column:
    """Runs of n tokens, none if there are fewer; ordered=False: each run sorted, so that order does not count."""
    def runs(t: Column) -> Column:
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(t, i, F.lit(n)))

    run = F.flatten(F.transform(F.array(tokens), runs))  # tokens are bound once, however often they are read
    return run if ordered else F.transform(run, lambda r: F.array_sort(r))


def common_tokens(a: Column, b: Column) -> Column:
    return F.arrays_overlap(F.split(a, " "), F.split(b, " "))


def common_prefix(a: Column, b: Column, n: int = 1) -> Column:
    return F.slice(F.split(a, " "), 1, n) == F.slice(F.split(b, " "), 1, n)


def slots(c: Column) -> Column:
    """struct(unit, compound, abbrev, note): [unit] not at the start, "X (Y)" as compound and abbreviation, -- note."""
    unit = F.regexp_extract(c, r"^[^\[]+\[([^\]]*)\]", 1)
    pair = r"([A-Za-z0-9,' -]+?)\s*\(([A-Za-z0-9 .-]+)\)"
    return F.struct(unit.alias("unit"), F.trim(F.regexp_extract(c, pair, 1)).alias("compound"), F.regexp_extract(c, pair, 2).alias("abbrev"), F.trim(F.regexp_extract(c, r"--\s*(.*)$", 1)).alias("note"))


def age(year: Column, as_of: int, mean_year: Column) -> Column:
    """Age in the year as_of; a missing year takes the mean (an age)."""
    return F.coalesce(F.lit(as_of) - year.cast("int"), mean_year.cast("int"))


def icd_dotted(code: Column) -> Column:
    return F.concat(F.substring(code, 1, 3), F.lit("."), F.substring(code, 4, 20))


def clean_tag(c: Column, sites: Iterable[str] = ()) -> Column:
    """The tag with the names of sites taken out as whole words, then cleaned."""
    for s in sites:
        c = F.regexp_replace(c, "(?i)(^|[^\\w])" + re.escape(s) + "(?![\\w])", "$1")
    return clean_term(standardize(c))


def codes_of(names: Iterable[str], description: Column, code: Column) -> Column:
    """The dotted code where the description holds one of the names, ignoring case; else null."""
    found = F.lit(False)
    for n in names:
        found = found | F.contains(F.lower(description), F.lit(n.lower()))
    return F.when(found, icd_dotted(code))
