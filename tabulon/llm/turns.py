"""Repair of conversation structure: a forward Viterbi pass over four grammar states, per conversation or per fragment of one."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .common import BLANKS, materialize, read_table, tidy

#: Grammar states: nothing yet, after system, after user, after assistant. Conversations end in the first or the last one.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
ENDS = (START, ASSISTANT)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: Which role an insertion or a new role gives in each state; insertions never give system.
FILL = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = {"su", "ua", "au"}
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

Row = tuple[str, str, int, int]  # role, text, fault, copies
Layer = list  # by state: (cost, audit) or None


def damage(rows: DataFrame) -> DataFrame:
    """rows with copies (int), nulls in role and text as one space, damaged by crc32 of conv_id:turn (a null is one space there
    too) modulo 20: 0 drops a row (no copies, no text), 1 empties its text, 2 takes [.!?] out of it, 3 makes two copies, 4 sets
    role user. conv_id and turn stay as they are."""
    code = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return rows.select("conv_id", "turn", F.when(code == 4, "user").otherwise(role).alias("role"), F.when(code.isin(0, 1), "").when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"))


def better(a: tuple | None, b: tuple) -> tuple:
    return b if a is None or b < a else a


def close(layer: Layer) -> Layer:
    """Adds insertions: two at most, as a third would only return to a state at a higher cost."""
    for _ in range(2):
        out = list(layer)
        for state, best in enumerate(layer):
            if best:
                to = FILL[state][1]
                out[to] = better(out[to], (best[0] + INSERT, best[1] + "I"))
        layer = out
    return layer


def advance(layer: Layer, row: Row) -> Layer:
    """The layer behind a row and the insertions after it. Of equal costs the least audit stays: no audit of a state's layer
    begins with another of the same cost, so that what follows cannot turn their order."""
    role, _, fault, copies = row
    out: Layer = [None] * 4
    initial, more = role[:1], "D" * (copies - 1)  # copies behind the first are duplicates
    for state, best in enumerate(layer):
        if not best:
            continue
        cost, audit = best
        out[state] = better(out[state], (cost + DELETE * copies, audit + "D" + more))
        if fault in (BLANK, DUPLICATE):
            continue
        cost += DELETE * (copies - 1) + CUT_OFF * (fault == TRUNCATED)
        for r, to in NEXT[state].items():
            if r == initial:
                out[to] = better(out[to], (cost, audit + "K" + more))
            elif r != "s":
                out[to] = better(out[to], (cost + REROLE, audit + "R" + more))
    return close(out)


def edited(rows: list[Row], audit: str, state: int) -> list[tuple[str, str]]:
    """What an audit makes of rows, from a state on: (role, text)."""
    out, items = [], ((r, t) for r, t, _, n in rows for _ in range(n))
    for letter in audit:
        role, text = (FILL[state][0], "") if letter == "I" else next(items)
        if letter == "D":
            continue
        if letter == "R":
            role = FILL[state][0]
        out.append((role, text))
        state = NEXT[state][role[:1]]
    return out


def fault_of(text: str, seen: bool) -> int:
    inner = text.rstrip(BLANKS)
    return BLANK if not inner else DUPLICATE if seen else NONE if inner[-1] in ".!?" else TRUNCATED


def counts_of(rows: list[Row]) -> list[int]:
    """Blank, duplicate and truncated rows, and neighbours whose roles do not follow each other."""
    n = [0, 0, 0, 0]
    last = None
    for role, _, fault, copies in rows:
        if fault:
            n[fault - 1] += 1
        n[(fault if fault == BLANK else DUPLICATE) - 1] += copies - 1
        r = role[:1]
        n[3] += (last is not None and last + r not in LEGAL) + (copies - 1) * (r + r not in LEGAL)
        last = r
    return n


def repair_whole(turns: list, roles: list[str], texts: list[str], copies: list[int]) -> tuple[list[int], str, list[tuple[str, str]]]:
    """Report, audit and repaired turns of rows in order."""
    rows, seen, own = [], set(), []
    for turn, role, text, n in zip(turns, roles, texts, copies, strict=True):
        if n:
            rows.append((role, text, fault_of(text, (role, text) in seen), n))
            seen.add((role, text))
            own.append(turn)
    layer = close([(0, ""), None, None, None])
    for row in rows:
        layer = advance(layer, row)
    cost, audit = min(layer[e] for e in ENDS if layer[e])
    numbers = {t for t in own if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    return [gaps, *counts_of(rows), cost], audit, edited(rows, audit, START)


def _turns(lists: list[list[tuple[str, str]]]) -> pa.Array:
    flat = [x for own in lists for x in own]
    ends = [0]
    for own in lists:
        ends.append(ends[-1] + len(own))
    pairs = pa.StructArray.from_arrays([pa.array([r for r, _ in flat], pa.string()), pa.array([t for _, t in flat], pa.string())], ["role", "text"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)


def _lists(column: pa.ListArray, k: int) -> list[list]:
    """Field k of every row's list of structs."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, at = column.flatten().field(k).to_pylist(), [0]
    for n in column.value_lengths().to_pylist():
        at.append(at[-1] + (n or 0))
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


REPORT = ", ".join(f"{c} long" for c in COUNTS) + ", audit string"
TURNS = "turns array<struct<role:string,text:string>>"


def _whole(rows: DataFrame) -> DataFrame:
    """Conversations of bounded size: each is gathered and repaired in one go."""
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "copies"))).alias("rows"))
    conv = rows.schema["conv_id"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                got = [repair_whole(*x) for x in zip(*(_lists(part.column("rows"), k) for k in range(4)), strict=True)]
                counts = [pa.array([g[0][k] for g in got], pa.int64()) for k in range(len(COUNTS))]
                own = [part.column("conv_id"), pa.array([0] * len(got), pa.int64()), pa.array([1] * len(got), pa.int64()), *counts, pa.array([g[1] for g in got], pa.string()), _turns([g[2] for g in got])]
                yield pa.RecordBatch.from_arrays(own, names=["conv_id", "fragment", "fragments", *COUNTS, "audit", "turns"])

    return gathered.mapInArrow(run, f"conv_id {conv}, fragment long, fragments long, {REPORT}, {TURNS}")


def _fragments(rows: DataFrame, most_rows: int, most_chars: int) -> DataFrame:
    """Long conversations in sorted pieces: equal rows as one with its copies, faults by joins, then ranges of rows, cut into
    fragments. A fragment's table of paths has, for each state before it, the cheapest way to each state behind it."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    turn = rows.schema["turn"].dataType.simpleString()
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = rows.withColumn("said", F.md5(F.concat_ws(":", F.length("role"), "role", "text")))
    first = rows.where("copies > 0").groupBy(F.col("conv_id").alias("_conv"), F.col("said").alias("_said")).agg(F.min(F.struct("turn")).alias("_first"))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("said") == F.col("_said")), "left")
    rows = rows.select("conv_id", "turn", "role", "text", "copies", (~F.col("turn").eqNullSafe(F.col("_first.turn"))).alias("seen"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    names = ["conv_id", "part", "seq", "n", "low", "high", "turns_seen", "counts", "ends", "paths", "roles", "texts", "faults", "copies"]

    def record(conv_id, part: int, seq: int, turns: list, rows: list[Row]) -> tuple:
        numbers = [t for t in turns if t is not None]
        paths = []
        for state in STATES:
            layer: Layer = [(0, "") if s == state else None for s in STATES]
            for row in rows:
                layer = advance(layer, row)
            paths += [{"cost": x[0], "audit": x[1]} if x else None for x in layer]
        ends = [rows[0][0][:1], rows[-1][0][:1]] if rows else None
        return (conv_id, part, seq, len(rows), min(numbers, default=None), max(numbers, default=None), len(set(numbers)), counts_of(rows), ends, paths, *([r[k] for r in rows] for k in range(4)))

    kinds = f"conv_id {conv}, part long, seq long, n long, low {turn}, high {turn}, turns_seen long, counts array<long>, ends array<string>, paths array<struct<cost:long,audit:string>>, roles array<string>, texts array<string>, faults array<int>, copies array<long>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, seq, now, turns, own, chars = TaskContext.get().partitionId(), 0, None, [], [], 0
        for batch in batches:
            for conv_id, turn, role, text, copies, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is not None and (now[0] != conv_id or len(own) >= most_rows or chars >= most_chars):
                    yield record(now[0], part, seq, turns, own)
                    seq, turns, own, chars = seq + 1, [], [], 0
                now = (conv_id,)
                if copies:
                    turns.append(turn)
                    own.append((role, text, fault_of(text, seen), copies))
                    chars += len(text) + copies
        if now is not None:
            yield record(now[0], part, seq, turns, own)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in cut(batches):
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(r, types, strict=True)], names=names)

    schema = StructType.fromDDL(kinds)
    types = [to_arrow_type(f.dataType) for f in schema.fields]
    return materialize(rows.mapInArrow(run, schema), "fragments")


def _chosen(fragments: DataFrame) -> DataFrame:
    """Which path each fragment takes: the tables of paths of a conversation are joined one after the other, and only four paths
    and the states between fragments are kept. Rows (part, seq) with fragment, state before it, its audit and, at fragment 0, the report."""
    table = fragments.drop("roles", "texts", "faults", "copies").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    head = [f.name for f in table.schema.fields]

    def settle(own: list[dict]) -> Iterator[tuple]:
        layer, steps = close([(0, ""), None, None, None]), []
        opening, trail = layer, []
        for f in own:
            out: Layer = [None] * 4
            came: list = [None] * 4
            for s in STATES:
                if not layer[s]:
                    continue
                for to in STATES:
                    p = f["paths"][4 * s + to]
                    if p and (out[to] is None or (layer[s][0] + p["cost"], layer[s][1] + p["audit"]) < out[to]):
                        out[to], came[to] = (layer[s][0] + p["cost"], layer[s][1] + p["audit"]), s
            layer = out
            trail.append(came)
        end = min((e for e in ENDS if layer[e]), key=lambda e: layer[e])
        cost, audit = layer[end]
        state = end
        for f, came in zip(reversed(own), reversed(trail), strict=True):
            steps.append((f, came[state], state))
            state = came[state]
        steps.reverse()
        counts, last, low, high, distinct = [0, 0, 0, 0], None, None, None, 0
        for f in own:
            counts = [a + b for a, b in zip(counts, f["counts"], strict=True)]
            if f["ends"]:
                counts[3] += last is not None and last + f["ends"][0] not in LEGAL
                last = f["ends"][1]
            if f["low"] is not None:
                distinct += f["turns_seen"] - (high is not None and high == f["low"])
                low, high = f["low"] if low is None else low, f["high"]
        gaps = high - low + 1 - distinct if high is not None else 0
        for k, (f, s, e) in enumerate(steps):
            piece = f["paths"][4 * s + e]["audit"]
            if k == 0:
                piece, s = opening[s][1] + piece, START
            report = [gaps, *counts, cost, audit] if k == 0 else [None] * 7
            yield (f["part"], f["seq"], k, len(steps), s, piece, *report)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        now, own = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if now is not None and now[0] != row["conv_id"]:
                    yield own
                    own = []
                now = (row["conv_id"],)
                own.append({k: row[k] for k in head})
        if own:
            yield own

    names = ["part", "seq", "fragment", "fragments", "state", "piece", *COUNTS, "audit"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.string()] + [pa.int64()] * 6 + [pa.string()]
        for own in groups(batches):
            cols = zip(*settle(own), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return table.mapInArrow(run, f"part long, seq long, fragment long, fragments long, state long, piece string, {REPORT}")


def _long(rows: DataFrame, most_rows: int, most_chars: int) -> DataFrame:
    """Conversations of any size, by fragments."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    fragments = _fragments(rows, most_rows, most_chars)
    joined = fragments.select("conv_id", "part", "seq", "roles", "texts", "faults", "copies").join(materialize(_chosen(fragments), "chosen"), ["part", "seq"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                r = {c: part.column(c)[0].as_py() for c in ("roles", "texts", "faults", "copies", "piece", "state")}
                own = edited(list(zip(r["roles"], r["texts"], r["faults"], r["copies"], strict=True)), r["piece"], r["state"])
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("conv_id", "fragment", "fragments", *COUNTS, "audit")] + [_turns([own])], names=["conv_id", "fragment", "fragments", *COUNTS, "audit", "turns"])

    return joined.mapInArrow(run, f"conv_id {conv}, fragment long, fragments long, {REPORT}, {TURNS}")


def _repaired(rows: DataFrame, most_rows: int, most_chars: int) -> tuple[DataFrame, DataFrame | None]:
    """Repaired conversations of bounded size, and the longer ones if there are any."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    rows = rows.select("conv_id", "turn", role, text, F.col("copies").cast("long").alias("copies"))
    size = rows.groupBy("conv_id").agg(F.sum(F.greatest("copies", F.lit(1))).alias("n"), F.sum(F.length("text")).alias("chars"))
    large = materialize(size.where((F.col("n") > most_rows) | (F.col("chars") > most_chars)).select(F.col("conv_id").alias("_large")), "large")
    if large.isEmpty():
        return _whole(rows), None
    same = F.col("conv_id").eqNullSafe(F.col("_large"))
    return _whole(rows.join(large, same, "left_anti")), _long(rows.join(large, same, "left_semi"), most_rows, most_chars)


def repair(rows: DataFrame, most_rows: int = 2000, most_chars: int = 8 << 20) -> DataFrame:
    """The cheapest repair of each conversation, from rows (conv_id, turn, role, text, copies): one row each with its report
    (gaps, blank, duplicate, truncated, illegal, cost, audit) and the repaired turns.

    Rows stand by turn, nulls first, then role and text (ties and repeated rows therefore too); a null role or text is one space,
    a null conv_id a conversation of its own. Rows without copies only keep their conversation in the result: one without other
    rows has zeros, an empty audit and no turns. A conversation of more than most_rows rows or most_chars characters, of any size,
    is repaired by fragments of about that size, joined by their tables of paths, with the same outcome: then further rows
    (fragment 1, 2, ... of fragments) hold the turns that follow, and nulls in the report. Other columns are not read; an empty
    table gives no rows."""
    whole, long = _repaired(rows, most_rows, most_chars)
    return whole.union(long) if long is not None else whole


def _lines() -> Column:
    return F.concat_ws("\n", F.transform("turns", lambda t: F.concat_ws(":", t["role"], t["text"])))


def _digests(long: DataFrame) -> DataFrame:
    """(_conv, repaired_sha256) of conversations in fragments, whose lines are hashed in their order as a stream."""
    conv = long.schema["conv_id"].dataType.simpleString()
    parts = long.select("conv_id", "fragment", F.size("turns").alias("n"), _lines().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], kind), pa.array([h.hexdigest()])], names=["_conv", "repaired_sha256"])

        now, h, started = None, None, False
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv_id, n, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n", "text")), strict=True):
                if now is None or now[0] != conv_id:
                    if now is not None:
                        yield out()
                    now, h, started = (conv_id,), hashlib.sha256(), False
                if n:
                    h.update((b"\n" if started else b"") + text.encode("utf-8"))
                    started = True
        if now is not None:
            yield out()

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "fragment").mapInArrow(run, f"_conv {conv}, repaired_sha256 string")


def report(rows: DataFrame, most_rows: int = 2000, most_chars: int = 8 << 20) -> DataFrame:
    """The report of repair() per conversation, with the digest of the repaired turns as role:text, one a line."""
    whole, long = _repaired(rows, most_rows, most_chars)
    columns = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    out = whole.withColumn("repaired_sha256", F.sha2(_lines(), 256)).select(columns)
    if long is None:
        return out
    long = materialize(long, "long")
    return out.union(long.where("fragment = 0").join(_digests(long), F.col("conv_id").eqNullSafe(F.col("_conv"))).select(columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(damage(read_table(spark, sf_dir, "conversations")))
