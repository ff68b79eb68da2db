"""File sources and sinks with explicit schemas."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import dehyphenate, dequote, icd_dotted, resolve_value
from ..operators.canonical import canonicalize
from ..operators.cleaning import clean_columns, process_text
from ..operators.dictionary import one_tag
from ..operators.profile import merge_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_delimited(spark: SparkSession, path: str | list[str], schema: StructType | str, sep: str = ",", columns: list[str] | None = None, **options) -> DataFrame:
    """Delimited text with a header; rows of the wrong width go. Options go to Spark (encoding, quote, nullValue ...)."""
    df = spark.read.schema(schema).options(header=True, sep=sep, mode="DROPMALFORMED", **options).csv(path)
    return df.select(*columns) if columns else df


def read_folds(spark: SparkSession, pattern: str, schema: StructType | str) -> DataFrame:
    """All files of a cross-validation, gzipped or not, with the number in each file's name."""
    return read_delimited(spark, pattern, schema).withColumn("fold", F.regexp_extract(F.input_file_name(), r"-(\d+)\.csv", 1).cast("int"))


def read_acronyms(spark: SparkSession, path: str, sep: str = "\t", expansion: int = 2) -> DataFrame:
    """Headerless: the first column is the acronym, the column of that number (from 0) its expansion; upper-cased."""
    df = spark.read.options(sep=sep, header=False).csv(path)
    return df.select(F.upper(F.trim("_c0")).alias("acronym"), F.upper(F.trim(f"_c{expansion}")).alias("expansion"))


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of k=v lines; # begins a comment."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')")
    return lines.select(F.trim(F.substring_index("value", "=", 1)).alias("key"), F.trim(F.expr("substring(value, instr(value, '=') + 1)")).alias("value")).where("key <> ''")


def read_nominals(spark: SparkSession, path: str) -> DataFrame:
    """(name, values) of the nominal attributes of an ARFF header."""
    found = spark.read.text(path).select(F.regexp_extract("value", r"(?i)^@attribute\s+(\S+)\s+\{(.*)\}", 1).alias("name"), F.regexp_extract("value", r"(?i)^@attribute\s+(\S+)\s+\{(.*)\}", 2).alias("v"))
    return found.where("name <> ''").select("name", F.transform(F.split("v", ","), lambda v: F.trim(v)).alias("values"))


def read_tokens(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    lines = spark.read.option("encoding", encoding).option("sep", "\x01").option("quote", "").schema("line string").csv(path)
    return lines.select(F.filter(F.split("line", r"\s+"), lambda t: t != "").alias("tokens"))


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").options(header=True, sep=sep).csv(path)


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str]) -> None:
    """Merges rows into a parquet table: new rows win. The merged table is written once, beside the old one, and takes its place
    by renaming; the old one is kept aside until that is done."""
    merged = merge_rows(spark.read.parquet(path), new, keys)
    mark = uuid.uuid4().hex  # two writers do not share folders
    merged.write.parquet(f"{path}.{mark}.new")
    at = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{mark}.new", f"{path}.{mark}.old")]
    fs = at[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not (fs.rename(at[0], at[2]) and fs.rename(at[1], at[0])):
        raise OSError(f"could not put the merged table at {path}")
    fs.delete(at[2], True)
    spark.catalog.refreshByPath(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one only where a local session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tabulon-')}"
    return f"{base}/tabulon/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def load_or_make(spark: SparkSession, path: str, make: Callable[[], DataFrame], again_if_empty: bool = False) -> DataFrame:
    """The table at path; where none was written whole (its _SUCCESS mark is missing), that of make().

    It is written beside and takes its place by renaming, so that a failed write is never taken for the table; of two writers
    the first one's table stays. again_if_empty: a table without rows is made again too."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = exists(spark, f"{path}/_SUCCESS")
    if whole and not (again_if_empty and spark.read.parquet(path).isEmpty()):
        return spark.read.parquet(path)
    new = f"{path}.{uuid.uuid4().hex}.new"
    make().write.parquet(new)
    if fs.exists(at) and (whole or not exists(spark, f"{path}/_SUCCESS")):  # empty, or left by a failed write
        fs.delete(at, True)
    beside = spark._jvm.org.apache.hadoop.fs.Path(new)
    if fs.exists(at) or not fs.rename(beside, at):
        fs.delete(beside, True)
        if not exists(spark, f"{path}/_SUCCESS"):
            raise OSError(f"could not put the table at {path}")
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path)


def read_descriptors(spark: SparkSession, folder: str, names: list[str], schema: StructType | str, clean: bool = False, dedup: bool = False, sep: str = ",") -> dict[str, DataFrame]:
    """name -> the variables file <folder>/<name>-vars, without nulls in its texts, for those names that have one; clean: the column of
    that name is cleaned again, dedup: without repeated words."""
    out = {}
    for name in names:
        path = f"{folder}/{name}-vars"
        if not exists(spark, path):
            continue
        df = read_delimited(spark, path, schema, sep)
        if clean:
            df = df.withColumn(name, process_text(F.col(name), dedup=dedup))
        out[name] = df.fillna("")
    return out


def silver(spark: SparkSession, raw: DataFrame, path: str, code: str, order: str, clean: list[str] | None = None, targets: DataFrame | None = None) -> DataFrame:
    """The table at path; where there is none, raw with clean columns cleaned, rows alike in all but order once (the last by
    order stays), and code made canonical, is written there first."""
    def make() -> DataFrame:
        rows = clean_columns(raw, clean) if clean else raw
        once = rows.groupBy(*[c for c in rows.columns if c != order]).agg(F.max(order).alias(order)).select(*raw.columns)
        return canonicalize(once, code, targets)

    return load_or_make(spark, path, make)


def import_records(df: DataFrame, name: str, value: str, texts: list[str]) -> DataFrame:
    """Records with name and value told apart (a name that is a number is no name, see resolve_value()) and texts cleaned."""
    a, b = resolve_value(F.col(name), F.col(value))
    return clean_columns(df.withColumns({name: a, value: b}), texts)


def dictionary_table(df: DataFrame, code: str, tag: str | None = None, order: str | None = None) -> DataFrame:
    """Codes without hyphens, texts without quotes, exact repeats once; with tag one row per code, see one_tag()."""
    texts = [c for c, t in df.dtypes if t == "string" and c != code]
    rows = df.withColumns({code: dehyphenate(F.col(code)), **{c: dequote(F.col(c)) for c in texts}}).distinct()
    return one_tag(rows, code, tag, order or tag) if tag else rows


def write_dictionary(df: DataFrame, path: str, code: str, sep: str = ",") -> None:
    write_delimited(dictionary_table(df, code), path, sep)


def write_pairs(df: DataFrame, path: str, roles: dict[str, list[str]], sep: str = ",") -> None:
    """A data set of pairs, its columns in the order of roles."""
    write_delimited(df.select(*[c for cs in roles.values() for c in cs]), path, sep)


def read_pairs(spark: SparkSession, path: str, schema: StructType | str, roles: dict[str, list[str]], untracked: list[str] | None = None, sep: str = ",") -> DataFrame:
    """The data set again, without the columns that are not tracked."""
    df = read_delimited(spark, path, schema, sep)
    gone = set(untracked or [])
    return df.select(*[c for cs in roles.values() for c in cs if c not in gone])


def write_scores(df: DataFrame, path: str) -> None:
    """Scores in long form (method, metric, fold, value)."""
    write_delimited(df.select("method", "metric", "fold", "value"), path, "|")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, "method string, metric string, fold int, value double", "|")


def write_searches(df: DataFrame, path: str) -> None:
    """Saved predicates (name, kind, text)."""
    write_delimited(df.select("name", "kind", "text"), path, "|")


def read_searches(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, "name string, kind string, text string", "|")


def read_code_map(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """(code, dotted, name) of a file that maps codes of one list to names."""
    rows = read_delimited(spark, path, f"{key} string, {value} string")
    return rows.select(F.trim(key).alias("code"), icd_dotted(F.trim(key)).alias("dotted"), F.trim(value).alias("name")).where("code <> ''").distinct()


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """Records of an ARFF file, columns named and typed by its header (numeric: double, else string); ? is null. Names and values may
    stand in single or double quotes, with commas, blanks and, behind a backslash, quotes in them."""
    lines = spark.read.text(path)
    pattern = r"""(?i)^\s*@attribute\s+('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|\S+)\s+(\S+)"""
    head = lines.where(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1), F.lower(F.regexp_extract("value", pattern, 2))).collect()  # one row per column
    names = [re.sub(r"\\(.)", r"\1", n[1:-1]) if n[:1] in "'\"" else n for n, _ in head]
    cells = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^,'"\s][^,]*|(?=,|$)"""  # quoted, plain or empty
    data = lines.where(~F.col("value").rlike(r"^\s*([@%].*)?$")).select(F.regexp_extract_all("value", F.lit(rf"(?:^|,)\s*({cells})\s*"), 1).alias("c"))

    def cell(i: int, kind: str):
        raw = F.trim(F.get(F.col("c"), F.lit(i)))
        quoted = F.substring(raw, 1, 1).isin("'", '"')
        value = F.when(quoted, F.regexp_replace(F.expr(f"substring(trim(c[{i}]), 2, length(trim(c[{i}])) - 2)"), r"\\(.)", "$1")).when(~raw.isin("?", ""), raw)
        return value.cast("double") if kind in ("numeric", "real", "integer") else value

    return data.select(*[cell(i, kind).alias(name) for i, (name, (_, kind)) in enumerate(zip(names, head, strict=True))])


def find_files(spark: SparkSession, base: str, pattern: str) -> DataFrame:
    """(path) of all files under base, at any depth, whose names fit the glob pattern."""
    found = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=pattern).load(base)
    return found.select("path")


def match_folds(files: DataFrame, pattern: str = r"(train|test)-(.+)-(\d+)\.csv") -> DataFrame:
    """(method, fold, train, test): the paths of each method's folds that have both files."""
    part = lambda i: F.regexp_extract(F.regexp_extract("path", r"([^/]+)$", 1), pattern, i)
    told = files.select("path", part(1).alias("kind"), part(2).alias("method"), part(3).alias("fold")).where("kind <> ''")
    by = told.groupBy("method", F.col("fold").cast("int").alias("fold")).agg(*[F.max(F.when(F.col("kind") == k, F.col("path"))).alias(k) for k in ("train", "test")])
    return by.where("train is not null and test is not null")


def read_methods(spark: SparkSession, base: str, schema: StructType | str, pattern: str = r"(train|test)-(.+)-(\d+)\.csv", kind: str = "test") -> DataFrame:
    """Rows of all files of one kind under base, with method and fold from their names."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    rows = spark.read.schema(schema).options(header=True, recursiveFileLookup=True).csv(base)
    part = lambda i: F.regexp_extract(name, pattern, i)
    return rows.withColumns({"method": part(2), "fold": part(3).try_cast("int"), "_kind": part(1)}).where(F.col("_kind") == kind).drop("_kind")


def random_fold(df: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of one fold per method, drawn by a hash."""
    folds = df.select("method", "fold").distinct()
    pick = folds.groupBy("method").agg(F.min(F.struct(F.xxhash64(F.lit(seed), "method", "fold").alias("h"), "fold")).alias("p")).select("method", F.col("p.fold").alias("fold"))
    return df.join(pick, ["method", "fold"], "left_semi")


def prior_and_posterior(prior: DataFrame, posterior: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both with prior and posterior scores side by side; both have a column score."""
    return prior.withColumnRenamed("score", "prior").join(posterior.select(*keys, F.col("score").alias("posterior")), keys)


def write_groups(df: DataFrame, path: str, keys: list[str]) -> None:
    """Every group as a folder of its own, however large it is."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def read_group(spark: SparkSession, path: str, **values) -> DataFrame:
    """One group again: only its folder is read."""
    df = spark.read.parquet(path)
    for c, v in values.items():
        df = df.where(F.col(c) == v)
    return df


def sample_records(spark: SparkSession, n: int, codes: int = 20, seed: int = 0) -> DataFrame:
    """Made-up records (id, code, test, value): a code's name, noisy hyphens and nulls, values around the code's own level."""
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(1 << 20)) / float(1 << 20)
    code = F.floor(F.pow(u(0), F.lit(2.0)) * codes).cast("int")
    rows = spark.range(n).withColumns({"_c": code, "value": F.round(10 * code + 3 * (u(1) + u(2) + u(3)), 3)})
    text = F.concat(F.lpad(F.col("_c").cast("string"), 4, "1"), F.when(u(4) < 0.2, F.lit("-")).otherwise(F.lit("")), (F.col("_c") % 10).cast("string"))
    return rows.select("id", F.when(u(5) >= 0.05, text).alias("code"), F.concat(F.lit("Test "), F.col("_c")).alias("test"), "value")
