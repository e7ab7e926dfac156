import hashlib
import random
import re
from collections import Counter

from llm.helpers import documents, lower, mixed_rows

from volpanel.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, items, size=10):
    wins = {}
    for i, t in items:
        w = WORD.findall(lower(t or ""))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[k:k + size]), set()).add(i)
    out = []
    for d, t, _ in rows:
        w, hit, got = WORD.findall(lower(t or "")), set(), set()
        for n in {len(x) for x in wins}:
            for p in range(len(w) - n + 1):
                if (x := tuple(w[p:p + n])) in wins:
                    hit |= set(range(p, p + n))
                    got |= wins[x]
        ids = sorted(str(i) for i in got if i is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def fixture():
    r = random.Random(2)
    rows = mixed_rows(3, 40)
    texts = [t for _, t, _ in rows if t and len(t.split()) > 14]
    items = [(i, " ".join(t.split()[2:2 + r.choice((9, 10, 11, 25))])) for i, t in enumerate(texts[:20])]
    items += [(100, "one"), (101, None), (102, ""), (103, "B A!"), (104, "nowhere to be found"), (105, "a b-C"), (105, "b a"), (106, "!!"), (None, "one")]
    rows += [(7000 + i, f"{r.choice(texts)} --{t.upper() if i % 2 else t}-- x" if t else None, "s") for i, (_, t) in enumerate(items)]
    return rows, items


def result(spark, rows, items, **k):
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, hits int")
    got = dc.digest(dc.find_contaminated(documents(spark, rows), bench, **k))
    return Counter(map(tuple, got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()))


def test_hits_equal_brute_force(spark):
    rows, items = fixture()
    assert result(spark, rows, items) == Counter(brute(rows, items))


def test_slices_add_up(spark):
    rows, items = fixture()
    assert result(spark, rows, items, slice_words=120) == Counter(brute(rows, items))


def test_empty_tables(spark):
    rows, items = fixture()
    assert result(spark, rows[:5], []) == Counter(brute(rows[:5], []))
    assert result(spark, [], items) == Counter()
