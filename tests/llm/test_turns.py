import hashlib
import itertools
import random
import re
import zlib

from tabulon.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, other int"


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        out += [(t, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def tried(rows):
    """Every edit of every row and up to two insertions round each."""
    options = []
    seen = set()
    faults = []
    for _, role, text in rows:
        inner = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        own = [("D", 4, None)]
        if fault in ("", "truncated"):
            more = 3 * (fault == "truncated")
            own += [("K", more, (role, text)), ("R", 3 + more, ("user", text)), ("R", 3 + more, ("assistant", text))]
        options.append(own)
    fill = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    best = None
    for edits in itertools.product(*options):
        for gaps in itertools.product(fill, repeat=len(rows) + 1):
            cost = sum(e[1] for e in edits) + 3 * sum(map(len, gaps))
            audit = "".join("I" * len(g) + (edits[k][0] if k < len(edits) else "") for k, g in enumerate(gaps))
            if best and (cost, audit) >= best[:2]:
                continue
            final = []
            for k, g in enumerate(gaps):
                final += [(r, "") for r in g] + ([edits[k][2]] if k < len(edits) and edits[k][2] else [])
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in final)):
                best = (cost, audit, final)
    return best, faults


def want(rows):
    rows = damaged(rows)
    (cost, audit, final), faults = tried(rows)
    numbers = {t for t, _, _ in rows if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in final).encode()).hexdigest()
    return (gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


def conversations(seed=3, n=150):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for _ in range(rng.randint(1, 3)):
            rows.append((c if c else None, rng.choice([None, 0, 1, 2, 3, 5, 8]), rng.choice(["user", "assistant", "system", "tool", "", None, "User"]), rng.choice(["Hi.", "Yes!", "so", "", " \t", None, "Why? ", "é\n"])))
    return rows


def got(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_against_all_edits(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    expected = {k: want(v) for k, v in by_key(rows).items()}
    assert got(turns.report(turns.damage(df))) == expected
    assert got(turns.report(turns.damage(df), most_rows=1, most_chars=1)) == expected  # all by fragments of one row


def test_long_conversations_in_fragments(spark):
    rng = random.Random(5)
    rows = [(c, rng.randint(0, 300), rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b!", "c", " "]) * rng.randint(1, 3)) for c in (1, 2) for _ in range(600)]
    rows += [(1, 7, "user", "same.")] * 400 + [(3, 0, "user", "x."), (3, 1, "assistant", "y.")]
    df = turns.damage(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA))
    assert got(turns.report(df, most_rows=90)) == got(turns.report(df, most_rows=10**6))
    whole = {r.conv_id: r.turns for r in turns.repair(df, most_rows=10**6).collect()}
    parts = {}
    for r in turns.repair(df, most_rows=90).orderBy("conv_id", "fragment").collect():
        parts.setdefault(r.conv_id, []).extend(r.turns)
        assert r.fragment == 0 or r.cost is None and r.audit is None
    assert parts == whole


def test_empty(spark):
    assert turns.report(turns.damage(spark.createDataFrame([], SCHEMA))).count() == 0


def test_query(spark, small):
    rows = by_key([tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
    out = got(turns.query(spark, small))
    assert set(out) == set(rows)
    short = {k: v for k, v in rows.items() if len(damaged(v)) <= 4}
    for k, v in short.items():
        assert out[k] == want(v)
