"""Template decontamination against a plain version of it, short items, runs of names, numbers with units, crowds of items."""

import re

import numpy as np

from tabulon.llm import templates

MARKS = "\"'`.,;:!?()[]{}<>|*#%&$_-/\\~^+=…“”‘’«»¡¿"


def plain(text):
    """Words, and tokens (code, first word, end word, value or None) of a text, word by word."""
    words, kinds, first = [], [], True
    for w in text.replace("\n", " \n ").split(" "):
        bare = w.strip(MARKS)
        if w != "\n" and bare:
            low = bare.lower()
            if any(c.isdigit() for c in bare) and not any(c.isalpha() for c in bare.rstrip("kKmMbBthsdrnxX")):
                k = "number"
            elif bare[0].isdigit() and low.lstrip("0123456789.,") in templates.UNITS:
                k = "quantity"
            elif low in templates.UNITS:
                k = "unit"
            else:
                k = "name" if bare[0].isupper() and bare[1:].islower() and not first else "word"
            words.append((low, w.lower().strip(".,;:!?\"'()")))
            kinds.append(k)
        if w == "\n" or bare or w.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", ":"):
            first = w == "\n" or w.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", ":")
    tokens = []
    for i, k in enumerate(kinds):
        if k == "unit" and i and kinds[i - 1] == "number":
            tokens[-1] = ("<quantity>", tokens[-1][1], i + 1, f"{tokens[-1][3]} {words[i][1]}")
        elif k == "name" and i and kinds[i - 1] == "name":
            tokens[-1] = ("<name>", tokens[-1][1], i + 1, f"{tokens[-1][3]} {words[i][1]}")
        elif k in ("word", "unit"):
            tokens.append((words[i][0], i, i + 1, None))
        else:
            tokens.append((f"<{k}>", i, i + 1, words[i][1]))
    return [w for w, _ in words], tokens


def brute(docs, items, width=8, min_words=5, coverage=0.5):
    out = {}
    for d, text in docs:
        words, tokens = plain(text or "")
        for n, item in items:
            own, parts = plain(item or "")
            w, wt = min(width, len(own)), min(width, len(parts))
            if not own:
                continue
            total, found = len(own) - w + 1, set()
            for j in range(total):
                if any(words[i : i + w] == own[j : j + w] for i in range(len(words) - w + 1)):
                    found.add(j)
            lines = {}
            for j in range(len(parts) - wt + 1 if len(own) >= min_words else 0):
                mine = parts[j : j + wt]
                slots = [s for s, t in enumerate(mine) if t[3] is not None]
                if not slots or 2 * len(slots) > wt:
                    continue
                for i in range(len(tokens) - wt + 1):
                    theirs = tokens[i : i + wt]
                    if [t[0] for t in mine] == [t[0] for t in theirs] and slots == [s for s, t in enumerate(theirs) if t[3] is not None]:
                        lines.setdefault(i - j, []).append((mine[0][1], max(mine[0][1], mine[-1][2] - w), [(mine[s][3], theirs[s][3]) for s in slots]))
            for line in lines.values():
                stands = {}
                for _, _, pairs in line:
                    for a, b in pairs:
                        stands.setdefault(a, set()).add(b)
                for a, b, pairs in line:
                    if all(len(stands[x]) == 1 for x, _ in pairs):
                        found |= set(range(a, b + 1))
            if len(found) >= coverage * total:
                out[d, n] = len(found)
    return out


def leaks(spark, docs, items):
    found = templates.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, r.item_id): r.n_windows for r in found.collect()}


def test_against_plain(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    draw = np.random.default_rng(2)
    names = ["Mary Ann Smith", "Bob", "Carol", "Dave Jones"]
    for n, (_, item) in enumerate(items[:12]):
        changed = re.sub(r"\d+", lambda m: str(draw.integers(2, 99)), item)
        docs.append((9000 + n, f"Before it. {changed} And after."))
        docs.append((9100 + n, item.upper() if n % 2 else "so " + item.lower()))
    template = "Yesterday {} gave {} apples and 3 kg of flour to {} who paid {} euros for them in the market of {} at noon"
    items.append((900, template.format("Bob", 4, "Carol", 12, "Rome")))
    items += [(901 + n, " ".join(f"In this question you are asked to say what {x} is".split()[: 4 + n])) for n, x in enumerate(("gold", "a lake", "Bob"))]
    for n in range(8):
        docs.append((9200 + n, template.format(*(draw.choice(names), draw.integers(2, 9), draw.choice(names), draw.integers(2, 9), draw.choice(names)))))
    docs += [(9300, "In this question you are asked to say what gold is"), (9301, "5kg of flour"), (9302, ""), (9303, None)]
    got = leaks(spark, docs, items)
    assert got == brute(docs, items) and any(d >= 9200 for d, _ in got)


def test_short_items(spark):
    docs = [(1, "we said: Carbon dioxide, and no more"), (2, "carbon and dioxide"), (3, "Yes"), (4, "yesterday")]
    assert leaks(spark, docs, [(1, "carbon dioxide"), (2, "yes."), (3, "...")]) == {(1, 1): 1, (3, 2): 1}


def test_crowd_of_items(spark):
    """All items begin alike; a document that holds only that beginning meets none of them, and is not joined with each."""
    head = "answer the following question about the history of the old harbour with one word"
    items = [(n, f"{head} {' '.join(f'q{n}w{j}' for j in range(20))}") for n in range(50)]
    docs = [(n, f"{head} and then nothing {n}") for n in range(50)] + [(100, items[7][1])]
    assert leaks(spark, docs, items) == {(100, 7): 27}
