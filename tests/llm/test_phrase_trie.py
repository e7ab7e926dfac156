import random
import re
from collections import Counter, defaultdict

import numpy as np
from llm.helpers import lower

from volpanel.llm import phrase_trie as pt


def brute(rows, least=10, top=2000, percent=50):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            if any(len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) and 100 * b >= percent * a for q, b in cand.items()):
                continue
            s, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, i, p.decode(), -a, l, r, n[lang], -s))
    return Counter(out)


def rows(seed=5, n=300):
    r = random.Random(seed)
    vocab = ["the", "of", "New", "york", "CITY", "é", "日本", "a\x1cb", "x\x85y", "\x00", "in", "it's"]
    out = []
    for _ in range(n):
        text = "".join(r.choice(vocab) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?"]) for _ in range(r.choice((0, 1, 2, 9, 40))))
        out.append((r.choice(["en", "en", "en", "de", None, "und", ""]), text))
    out += [("en", "new york city hall " * 40), ("de", None), ("fr", None), (None, ""), ("en", " .,; \n"), ("fr", "z " * 5000), ("fr", "w" * 20000)]
    out += [("es", "uno dos tres.")] * 12
    return out


def frame(spark, data):
    return spark.createDataFrame([(i, t, l, 1, "p") for i, (l, t) in enumerate(data)], "doc_id long, text string, lang string, f long, phrase string")


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def result(df):
    return Counter(map(tuple, df.select(*COLUMNS).collect()))


def test_equals_brute_force(spark):
    data = rows(5, 3000)
    want = brute(data)
    assert len(want) > 80
    assert result(pt.mine(frame(spark, data))) == want


def test_spills_bursts_and_new_ids_change_nothing(spark):
    data = rows(6)
    want = brute(data, least=3, top=7)
    got = pt.mine(frame(spark, data).repartition(3), least=3, top=7, entries=40, burst=3, ids=5)
    assert result(got) == want


def test_no_rows(spark):
    assert result(pt.mine(frame(spark, []))) == Counter()
    assert result(pt.mine(frame(spark, [("en", None), (None, "one two")]))) == Counter()


def test_exact_beyond_64_bits():
    import pyarrow as pa
    a, l, r = 9 * 10 ** 15, 9 * 10 ** 15 + 1, 9 * 10 ** 15 + 7
    batch = pa.RecordBatch.from_pylist([{"lang": "en", "phrase": "x y", "a": a, "parts": [{"k": 1, "l": l, "r": r}]}])
    assert next(pt.weakest(batch))["score"] == [1_000_000 * a * a // (l * r)]


def test_ties_take_the_first_cut():
    import pyarrow as pa
    parts = [{"k": 2, "l": 20, "r": 10}, {"k": 1, "l": 10, "r": 20}]
    batch = pa.RecordBatch.from_pylist([{"lang": "en", "phrase": "x y z", "a": 10, "parts": parts}])
    out = next(pt.weakest(batch))
    assert (out["l"], out["r"], out["score"]) == ([10], [20], [500000])


def test_trie_keeps_counts_through_bursts_and_spills():
    r = np.random.default_rng(1)
    trie, want = pt.HatTrie(3, burst=4), Counter()
    got = Counter()
    for _ in range(30):
        codes = (r.integers(1, 6, 400) << 42) | (r.integers(1, 9, 400) << 21) | r.integers(1, 9, 400)
        want.update(codes.tolist())
        trie.add(*np.unique(codes, return_counts=True))
        assert len(trie) == sum(len(x.flat()) if isinstance(x, pt.Burst) else len(x) for x in trie.children.values())
        for a, sub in trie.spill(100):
            got.update({a << 42 | k: n for k, n in sub.items()})
        assert len(trie) <= 100
    for a, sub in trie.spill(-1):
        got.update({a << 42 | k: n for k, n in sub.items()})
    assert got == want


def test_chunks_keep_all_phrases_of_a_long_text():
    r = random.Random(3)
    text = " ".join(r.choice(["a", "bb", "ccc", "dd.", "e\n"]) for _ in range(3000)).encode().translate(pt.PLAIN)
    got = []
    for size in (7, 100, 1 << 20):
        c = pt.Counting(3, pt.Filter(), pt.Filter())
        c.add("en", text, size)
        total = Counter()
        for out in c.runs(True):
            total.update(dict(zip(out["phrase"].to_pylist(), out["f"].tolist(), strict=True)))
        got.append(total)
    assert got[0] == got[1] == got[2] and len(got[0]) > 20


def test_filter_never_rules_out_a_member(spark):
    phrases = [("en", f"w{i} v{i % 7}") for i in range(500)]
    df = spark.createDataFrame([(l, p, 10) for l, p in phrases], "lang string, phrase string, f long")
    filtered = pt.filter_of(df)
    ids = pt.Ids("en", pt.Filter())
    h = np.array([[ids.hashes[ids[w.encode()]] for w in p.split()] for _, p in phrases], np.uint64)
    members = pt.pair_hash(h[:, 0], h[:, 1])
    assert filtered(members).all() and all(map(filtered.one, members.tolist()))
    strange = np.random.default_rng(2).integers(0, 1 << 63, 4000).astype(np.uint64)
    assert filtered(strange).mean() < 0.2
    assert filtered(strange).tolist() == list(map(filtered.one, strange.tolist()))
