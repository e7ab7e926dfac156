import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from llm.helpers import documents, lower, mixed_rows

from volpanel.llm import impact_grid as ig

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, items, k=10):
    docs = [(i, Counter(TERM.findall(lower(t or "")))) for i, t, *_ in rows]
    docs = [(i, c) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(c.total() for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, c in docs:
            m = 10 + 90 * c.total() * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10 ** 9 * c[w] // (1000 * c[w] + 8 * m))
                    for w in set(TERM.findall(lower(text or ""))) if c[w])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return Counter(out)


def fixture():
    r = random.Random(4)
    rows = mixed_rows(8, 60)
    texts = [t for _, t, _ in rows if t and len(t.split()) > 6]
    rows += [(5000 + i, texts[0], "s") for i in range(40)] + [(6000 - i, "tie one two", "s") for i in range(30)] + [(7000, "!? .,", "s"), (7001, "x" * 30000, "s")]
    items = [(i, " ".join(r.sample(t.split(), min(6, len(t.split()))))) for i, t in enumerate(texts[:25])]
    items += [(100, None), (101, ""), (102, "?!"), (103, "Tie"), (104, "nowhere"), (105, "one one ONE"), (105, "one two"), (105, "one two"), (None, "w1 w2"), (106, "日本語 é")]
    return rows, items


def result(spark, rows, items, **k):
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    return Counter(map(tuple, ig.rank(documents(spark, rows), bench, **k).select("item_id", "rank", "doc_id", "score").collect()))


def test_equals_brute_force(spark):
    rows, items = fixture()
    want = brute(rows, items)
    assert len(want) > 150
    assert result(spark, rows, items) == want


def test_small_shards_and_blocks_change_nothing(spark):
    rows, items = fixture()
    assert result(spark, rows, items, shard=2000, block_terms=20, k=4) == brute(rows, items, 4)


def test_empty_tables(spark):
    rows, items = fixture()
    assert result(spark, [], items) == Counter()
    assert result(spark, rows, []) == Counter()
    assert result(spark, [(1, None, "s"), (2, "...", "s")], items) == Counter()


def test_text_ids_are_kept(spark):
    docs = spark.createDataFrame([("b", "tie"), ("a", "tie"), (None, "tie"), ("c", "else")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "tie")], "item_id string, text string")
    assert [tuple(r)[1:3] for r in ig.rank(docs, items).orderBy("rank").collect()] == [(1, "a"), (2, "b"), (3, None)]


def grid(seed, n_rows, n_cols, n):
    r = np.random.default_rng(seed)
    cells = np.unique(np.stack([r.integers(0, n_rows, n) ** 2 // n_rows, r.integers(0, n_cols, n)], 1), axis=0)
    return cells[:, 0], cells[:, 1], r.integers(1, 50, len(cells))


def test_cells_hold_the_greatest_impact():
    for seed, shape in enumerate([(1, 1, 1), (1, 40, 30), (50, 1, 30), (40, 300, 2000), (700, 30, 900)]):
        rows, cols, values = grid(seed, *shape)
        height, masks, drops = ig.build(rows, cols, values)
        raw = ig.pack(masks, drops)
        back = ig.unpack(*(np.frombuffer(raw[c], d) for c, d in (("masks", np.uint8), ("changes", np.uint8), ("drops", np.int32))), raw["cells"], len(values))
        assert (back[0] == masks).all() and (back[1] == drops).all()
        t = ig.Treap(height, *back)
        for r, c, v in zip(rows.tolist(), cols.tolist(), values.tolist(), strict=True):
            cell = np.zeros(1, np.int64)
            for level in range(height):
                s = height - level
                inside = (rows >> s == r >> s) & (cols >> s == c >> s)
                assert t.top[cell[0]] == values[inside].max()
                cell = t.quarter(cell, np.array([(r >> (s - 1) & 1) << 1 | c >> (s - 1) & 1]))
            assert t.top[cell[0]] == v
        assert (drops[1:] >= 0).all()


def test_descent_finds_the_best_columns_and_leaves_the_rest_alone():
    rows, cols, values = grid(9, 400, 4096, 30000)
    t = ig.Treap(*ig.build(rows, cols, values))
    by = defaultdict(dict)
    for r, c, v in zip(rows.tolist(), cols.tolist(), values.tolist(), strict=True):
        by[r][c] = v
    rnd = random.Random(1)
    for wide in (1, 7, 256):
        for _ in range(12):
            q = rnd.sample(sorted(by), rnd.choice((1, 2, 9)))
            w = [rnd.choice((1, 5, 40)) for _ in q]
            total = Counter()
            for r, x in zip(q, w, strict=True):
                for c, v in by[r].items():
                    total[c] += x * v
            want = sorted((-s, c) for c, s in total.items())[:10]
            s, c = t.search(np.array(q), np.array(w), 10, 0, wide)
            assert list(zip((-s).tolist(), c.tolist(), strict=True)) == want
    seen = []
    quarter = t.quarter
    t.quarter = lambda cells, which: seen.append(len(cells)) or quarter(cells, which)
    rare = max(by, key=lambda r: (max(by[r].values()), -len(by[r])))
    t.search(np.array([rare]), np.array([1]), 1, 0, 1)
    assert sum(seen) / 2 < 1024  # of 4096 columns, each with its path
