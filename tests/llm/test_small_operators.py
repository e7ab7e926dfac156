import hashlib
import random
import re
from collections import Counter

import numpy as np
from llm.helpers import documents, lower, mixed_rows, words

from volpanel.llm import chat_format as cf
from volpanel.llm import html_text, license_scan, quality_rules, source_mix, url_rules
from volpanel.llm import language_model as lm


# --- mixing ---------------------------------------------------------------------------------------

def test_mix_meets_targets_and_repeats(spark):
    r = random.Random(4)
    rows = [(i, "w " * r.randrange(1, 60), ["hot", "a", "b", None, "tiny", "zero"][min(5, int(r.expovariate(0.7)))]) for i in range(3000)]
    rows = [(i, "" if s == "zero" else t, s) for i, t, s in rows] + mixed_rows()
    df = documents(spark, rows)
    got = source_mix.mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for (_, _, s), in zip(rows):
        sizes[s] += 0
    for i, t, s in rows:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    want, capped, total = {}, set(), 1.5 * sum(sizes.values())
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        level = left / sum(w[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and level * w[s] > 2 * sizes[s]}
        if not more:
            break
        capped |= more
    want = Counter((sizes[s], round(min(2.0 * sizes[s], level * w[s]), 6)) for s in order)
    assert Counter({(g.source_size, round(g.target, 6)) for g in got}) == Counter(set(want))
    by = Counter()
    for g in got:
        assert g.taken <= 2 * g.size and g.taken == g.copies * g.size
        by[g.source_size, round(g.target, 6)] += g.taken
    longest = max(len(words(t)) for _, t, _ in rows)
    for (_, t), n in by.items():
        assert abs(n - t) <= 2 * longest
    assert sum(by.values()) <= total < sum(by.values()) + 2 * longest
    assert Counter(map(tuple, got)) == Counter(map(tuple, source_mix.mix(df.repartition(7)).collect()))


def test_cut_is_the_same_however_narrow_the_windows(spark, monkeypatch):
    df = documents(spark, [(i, "w " * (1 + i * 7 % 31), f"s{i % 3}") for i in range(900)])
    want = Counter(map(tuple, source_mix.mix(df).collect()))
    monkeypatch.setattr(source_mix, "WINDOW_ROWS", 3)
    monkeypatch.setattr(source_mix, "RANGE_ROWS", 7)
    monkeypatch.setattr(source_mix, "FAN", 8)
    assert Counter(map(tuple, source_mix.mix(df).collect())) == want


def test_mix_of_nothing(spark):
    assert source_mix.mix(documents(spark, [])).collect() == []
    assert [(g.taken, g.target) for g in source_mix.mix(documents(spark, [(1, None, "a"), (2, "", None)])).collect()] == [(0, 0.0)] * 2


# --- urls -----------------------------------------------------------------------------------------

URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y", "http://example.com/en/", "http://example.com/EN/", "http://sub.example.com/en/1", "https://badexample.com/en/",
        "http://a.net/es/1#z", "http://net/fr/", "http://x.net/de/", "http://com", "http://a.com?x=/en/", "http://a.com#/", "https://play-casino.org/", "http://casinos.org/", "https://x.org/Poker/1",
        "a://b://c.com/d", "http://é.com/\n/x", "http://www.example.com/en/", "http://www.example.com/en/", "x://shop.com/casino"]


def brute_url(u):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
    host, path = (lower(m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), h + p, v) for h, p, v in url_rules.SITES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    word = any(re.search(rf"(?<![0-9a-z]){w}(?![0-9a-z])", (host + path).lower()) for w in url_rules.WORDS)
    return host, path, best and best[1], best[2] if best else "block" if word else "allow"


def test_urls(spark):
    df = spark.createDataFrame([(i, u, 1, "t") for i, u in enumerate(URLS)], "page_id long, url string, token int, host string")
    got = url_rules.judge(df).select("page_id", "host", "path", "rule", "verdict").collect()
    assert Counter(map(tuple, got)) == Counter((i, *brute_url(u)) for i, u in enumerate(URLS))
    assert url_rules.judge(df.where("false")).collect() == []
    assert {r.verdict for r in url_rules.judge(df, sites=[], words=["casino"]).collect()} == {"allow", "block"}


def test_rule_goes_under_its_rarest_literal(spark):
    tokens = spark.createDataFrame([("com",)] * 9 + [("example",)] * 2 + [("en",)] * 5, "token string")
    index = {r.rule: r.token for r in url_rules.filed(tokens, [url_rules.site_rule("example.com", "/en/", "block"), url_rules.site_rule("com", "/part", "block")]).collect()}
    assert index == {"example.com/en/": "example", "com/part": "com"}


def test_words_beside_other_letters(spark):
    urls = ["http://x.org/日本casino/", "http://x.org/casinoé", "http://épokeré.org/", "http://x.org/casinos日", "http://日本.example.com/en/ä"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_rules.judge(df).select("page_id", "host", "path", "rule", "verdict").collect()
    assert Counter(map(tuple, got)) == Counter((i, *brute_url(u)) for i, u in enumerate(urls))
    assert [r.verdict for r in sorted(got)] == ["block", "block", "block", "allow", "block"]
    assert [r.verdict for r in url_rules.judge(df, sites=[], words=["日本casino"]).orderBy("page_id").collect()] == ["block"] + ["allow"] * 4


# --- chats ----------------------------------------------------------------------------------------

def test_chats_come_back(spark):
    said = ["", None, "hi", "<|im_end|>\n", r"<\|im_sep|> <\\|x", "a<", "|im_start|>", "é\n日本" * 50, "</s>[INST]", "&lt;"]
    r = random.Random(1)
    rows = [(c, t, r.choice(("user", "assistant", "system", None, "<|odd|>\n")), r.choice(said), 1) for c in (1, 2, 3, None) for t in range(9)]
    rows += [(5, 0, "assistant", "x", 1), (5, 0, "assistant", "x", 1), (5, None, "user", "y", 2)] + [(6, t, "user", f"t{t}", 1) for t in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node int")
    want = []
    for c in {x[0] for x in rows}:
        own = sorted(((t is not None, t or 0, ro is not None, ro or "", x is not None, x or "") for cc, t, ro, x, _ in rows if cc == c),
                     key=lambda o: (o[0], o[1], o[3].encode(), o[5].encode()))
        loss = "".join(o[5] for o in own if o[3] == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((c, len(own), sha("".join(f"{o[3]}\n{o[5]}\n" for o in own)), len(loss), sha(loss)))
    got = cf.read_back(cf.format_trees(cf.as_tree(df))).drop("formatted_chars").collect()
    assert Counter(map(tuple, got)) == Counter(want)
    assert cf.read_back(cf.format_trees(cf.as_tree(df.where("false")))).collect() == []


def test_best_branches_of_a_tree(spark):
    # 1 - 2 - 3 - 4 (leaf), 2 - 5 (leaf), 3 - 6 - 7 (leaf); 8: parent missing; 9 <-> 10: a cycle
    edges = [(1, None, 1.0), (2, 1, 1.0), (3, 2, 1.0), (4, 3, 9.0), (5, 2, 2.0), (6, 3, 0.0), (7, 6, 0.0), (8, 99, 0.5), (9, 10, 9.0), (10, 9, 9.0)]
    rows = [("a", n, p, "assistant" if n % 2 else "user", f"t{n}", s) for n, p, s in edges]
    tree = spark.createDataFrame(rows, "c string, node long, parent long, role string, text string, score double").selectExpr("7L as conv", "node", "parent", "role", "text", "score")
    got = cf.format_trees(tree, best=9).orderBy("path").collect()
    assert [re.findall(r"t\d+", g.formatted) for g in got] == [["t1", "t2", "t3", "t4"], ["t1", "t2", "t5"], ["t1", "t2", "t3", "t6", "t7"], ["t8"]]
    assert [got[0].formatted[s.start:s.start + s.len] for s in got[0].spans] == ["t1", "t3"]
    assert cf.format_trees(tree).count() == 1


# --- quality --------------------------------------------------------------------------------------

def brute_base(t):
    w = words(t)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines, dup, seen = (t or "").split("\n"), 0, set()
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit)


def test_base_counts_and_verdicts(spark):
    r = random.Random(8)
    clean = lambda: " ".join(r.choice(("the", "of", "house", "river", "and", "green", "walks", "to", "seldom")) + r.choice(("", "", ",")) + str(r.randrange(99)) * (r.random() < .5) for _ in range(60)) + "."
    good = [(10_100 + i, clean(), "s") for i in range(80)]
    bad = [(10_300 + i, clean().replace(" ", "### ") + "###" if i % 2 else clean().upper().replace(" ", "!! "), "s") for i in range(20)]
    other = mixed_rows() + [(400, "a b c d e f\na b c d e f\n\n \na b c d e f", "s"), (401, "x y z v w x y z v w", "s"), (402, "q " * 7, "s")]
    rows = good + bad + other
    df = documents(spark, rows)
    got = quality_rules.judge(df).collect()
    base = Counter((i, *brute_base(t), brute_base(t)[0] < 10 or 100 * brute_base(t)[4] > 20 * brute_base(t)[0]) for i, t, _ in rows)
    assert Counter((g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) for g in got) == base
    kept = {g.doc_id: g.kept for g in got}
    assert all(kept[i] for i, _, _ in good) and not any(kept[i] for i, _, _ in bad)
    assert not any(g.kept and g.base_failed for g in got)
    assert Counter((r.doc_id, r.text) for r in quality_rules.keep_good(df).collect()) == Counter(
        (i, t) for i, t, _ in rows if next(g.kept for g in got if g.doc_id == i and g.n_words == len(words(t))))
    assert quality_rules.judge(documents(spark, [])).collect() == [] and quality_rules.keep_good(documents(spark, [])).collect() == []


# --- language model -------------------------------------------------------------------------------

def chained(n):
    """Texts in which a word says much about the next."""
    r = random.Random(21)
    after = {w: [r.randrange(120) for _ in range(3)] for w in range(120)}
    rows = []
    for i in range(n):
        w, text = r.randrange(120), []
        for _ in range(60):
            text.append(f"w{w}")
            w = r.choice(after[w])
        rows.append((i, " ".join(text), "s"))
    return rows


def test_score_is_normalised_and_beats_the_unigram(spark, monkeypatch):
    seen = {}

    def spy(spark, model, run=lm.normalisers):
        seen["model"], seen["z"] = model, run(spark, model)
        return seen["z"]

    monkeypatch.setattr(lm, "normalisers", spy)
    got = [g for g in lm.score(documents(spark, chained(3000))).collect() if g.held_out]
    assert sum(g.score - g.base_score for g in got) > 0.1 * sum(g.n_tokens for g in got)
    m = seen["model"]
    p = np.exp(m.scores(m.hidden()) - seen["z"][:, None])
    assert p.shape == (m.k + 1, m.k) and np.allclose(p.sum(1), 1, atol=1e-4)


def test_score_of_a_text_is_the_product_of_its_steps(spark, monkeypatch):
    """Held against a plain walk over each text with the fitted parameters."""
    seen = {}

    def spy(spark, model, run=lm.normalisers):
        seen["model"] = model
        return run(spark, model)

    monkeypatch.setattr(lm, "normalisers", spy)
    rows = chained(400) + [(9000, "never seen w1", "s"), (9001, None, "s")]
    got = {g.doc_id: g for g in lm.score(documents(spark, rows).repartition(3)).collect()}
    m = seen["model"]
    score = m.scores(m.hidden()).astype(np.float64)
    log_p = (score - lm.log_sum(score)[:, None]) / np.log(10)
    toks = {i: [*words(lower(t or "")), None] for i, t, _ in rows}
    c = Counter(w for i, ws in toks.items() if not got[i].held_out for w in ws)
    least = max(2.0, sum(c.values()) ** 0.5 / lm.SPREAD)
    hashed = {w: int(lm.word_hashes([(w or "").encode()])[0]) for w in c}
    known = sorted((w for w in c if c[w] >= least), key=lambda w: (-c[w], lm.signed(np.array([hashed[w]], np.uint64))[0]))
    cls = {w: k for k, w in enumerate(known)}
    rest = [c[w] for w in c if w not in cls]
    for i, ws in toks.items():
        want, before = 0.0, m.k
        for w in ws:
            k = cls.get(w, len(known))
            want += log_p[before, k]
            if w not in cls:
                want += np.log10((c[w] + 1) / (sum(rest) + len(rest) + 1))
            before = k
        assert abs(got[i].score - want) < 1e-2, i


def test_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 60)  # several shards
    monkeypatch.setattr(lm, "PORTION", 3000)
    df = documents(spark, chained(600) + mixed_rows())
    first, second = (sorted(((g.doc_id is None, g.doc_id or 0, g.n_tokens, g.score) for g in lm.score(d).collect()))
                     for d in (df.coalesce(1), df.repartition(7)))
    assert [x[:3] for x in first] == [x[:3] for x in second]
    assert np.allclose([x[3] for x in first], [x[3] for x in second], atol=1e-3)


def check_scores(spark, rows):
    import math
    import zlib

    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    toks = [[*words(lower(t or "")), None] for _, t, _ in rows]
    c = Counter(w for (i, _, _), ws in zip(rows, toks) if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, out(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for (i, _, _), ws in zip(rows, toks))
    got = lm.score(documents(spark, rows).repartition(4), vocabulary=50).collect()
    assert Counter((g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6)) for g in got) == want
    assert all(g.score < 0 for g in got)
    return {(g.doc_id, g.n_tokens): round(g.score, 6) for g in got}


def test_scores_equal_brute_force_with_and_without_rare_rows(spark, monkeypatch):
    rows = mixed_rows()
    whole = check_scores(spark, rows)
    monkeypatch.setattr(lm, "COMMON", 200)
    assert check_scores(spark, rows) == whole


def test_scores_of_little(spark):
    assert lm.score(documents(spark, [])).collect() == []
    held = next(i for i in range(50) if __import__("zlib").crc32(str(i).encode()) % 7 == 2)
    assert [(g.train_tokens, g.n_known, g.base_score) for g in lm.score(documents(spark, [(held, "a b", "s")])).collect()] == [(0, 0, 0.0)]


def test_vocabulary_and_training_follow_the_corpus(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * 5 + j) % 1500}" for j in range(40)), "s") for i in range(900)]
    seen = {}

    def spy(runs, model, epochs, run=lm.train_everywhere):
        seen["k"], seen["pairs"] = model.k, [(r.run, r.turn) for r in runs.collect()]
        seen["model"] = run(runs, model, epochs)
        return seen["model"]

    monkeypatch.setattr(lm, "train_everywhere", spy)
    got = lm.score(documents(spark, rows).repartition(4)).collect()
    trained = [g for g in got if not g.held_out]
    assert seen["k"] == 1500 + 1 + 1  # words, the end, the shared class
    before, after, times = lm.pairs_of([r for r, _ in seen["pairs"]], seen["k"])
    assert times.sum() == sum(g.n_tokens for g in trained) == 41 * len(trained)
    assert (before == seen["k"]).any() and times.max() <= lm.HEAVY and {t for _, t in seen["pairs"]} == set(range(lm.ROUNDS))
    moved = seen["model"].rows[:, -2] > 0  # what has been summed up for each class before
    assert moved[np.unique(before)].all()
    z = lm.log_sum(seen["model"].scores(seen["model"].hidden()))
    assert np.allclose(lm.normalisers(spark, seen["model"]), z, atol=1e-4)


def test_steps_grow_with_the_pairs():
    r = np.random.default_rng(1)
    steps = []
    for n in (5000, 50000):
        m = lm.Model(np.full(20, 0.05))
        m.learn(r.integers(0, 21, n), r.integers(0, 20, n), np.ones(n, np.float32), r)
        steps.append(m.c[0, -1])
    assert steps == [2, 13]


def plain_step(m, before, after, times, r, noise, rate):
    """One step of noise-contrastive estimation over the whole matrix of pairs and draws, in doubles."""
    d = m.c.shape[0]
    wrong = np.minimum(np.searchsorted(m.cum, r.random(noise) * m.cum[-1], side="right"), m.k - 1)
    log_noise = m.log_unigram.astype(np.float64) + np.log(noise)
    c, rows, out = (x.astype(np.float64) for x in (m.c, m.rows, m.out))
    q, right, false_r = rows[before, :d], out[after, :d], out[wrong, :d]
    h = q @ c[:, :d].T
    weight = times / times.mean() / len(times)
    dt = weight / (1 + np.exp((h * right).sum(1) + out[after, d] - log_noise[after]))
    df = -weight[:, None] / (1 + np.exp(-(h @ false_r.T + out[wrong, d] - log_noise[wrong])))
    dh = dt[:, None] * right + df @ false_r

    def add(table, at, gradient):
        g = np.zeros((len(table), gradient.shape[1]))
        np.add.at(g, at, gradient)
        at = np.unique(at)
        for a, b, s in ((0, d, g.shape[1]), (d, g.shape[1], g.shape[1] + 1)):
            if b > a:
                table[at, s] += (g[at, a:b] ** 2).mean(1)
                table[at, a:b] += rate * g[at, a:b] / np.sqrt(table[at, s] + 1e-12)[:, None]
        table[at, -1] += 1

    add(c, np.arange(d), dh.T @ q)
    add(rows, before, dh @ c[:, :d])
    add(out, np.concatenate([after, wrong]), np.concatenate([np.concatenate([dt[:, None] * h, df.T @ h]), np.concatenate([dt, df.sum(0)])[:, None]], 1))
    return c, out, rows


def test_a_step_takes_equal_classes_once_and_is_the_plain_one():
    import tracemalloc

    r = np.random.default_rng(4)
    m = lm.Model((u := r.random(60) + 0.01) / u.sum())
    before, after, times = r.integers(0, 61, 4096), r.integers(0, 60, 4096), r.integers(1, 17, 4096).astype(np.float32)
    for seed in range(3):
        want = plain_step(m, before, after, times, np.random.default_rng(seed), 256, 0.1)
        tracemalloc.start()
        m.step(before, after, times, np.random.default_rng(seed), 256, 0.1)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        for x, y in zip((m.c, m.out, m.rows), want, strict=True):
            assert np.allclose(x, y, rtol=1e-4, atol=1e-5)
        assert most < 4 << 20  # 61 classes before by at most 60 drawn, not 4096 pairs by 256 draws


def test_normalisers_are_exact_and_taken_by_parts(monkeypatch):
    import tracemalloc

    r = np.random.default_rng(5)
    m = lm.Model((u := r.random(30000) + 0.01) / u.sum())
    for scale in (1, 30, 100):  # best scores far above those of the first part
        m.rows[:, :24] = r.normal(0, 1, (30001, 24))
        m.out[:, :24] = r.normal(0, scale, (30000, 24))
        m.out[-1, 24] = 500
        hidden = m.hidden()[:lm.ROWS]
        want = lm.log_sum(m.scores(hidden.astype(np.float64)))
        right = np.ascontiguousarray(lm.with_one(m.out[:, :25]).T)
        tracemalloc.start()
        got = lm.log_sums(hidden, right)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert np.allclose(got, want, rtol=1e-5, atol=1e-4)
        assert most < 2 << 20


def test_rounds_leave_no_shuffle_files(spark):
    import time

    def left():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",").split(",")
        return {f.rsplit("/", 1)[-1] for f in files if "/shuffle_" in f}

    runs = spark.createDataFrame([(i % lm.ROUNDS, i % 3, i, 0, np.array([20, *(np.arange(i, i + 50) % 20)], np.int32).tobytes()) for i in range(200)],
                                 "turn int, shard int, hash long, place int, run binary")
    before = left()
    lm.train_everywhere(runs, lm.Model(np.full(20, 0.05)), 1)
    for _ in range(50):  # they go in the background
        if not left() - before:
            break
        time.sleep(0.1)
    assert not left() - before
    assert spark.conf.get(lm.DROP, None) in (None, "false")


def test_long_texts_are_walked_across_runs(spark, monkeypatch):
    seen = {}

    def spy(spark, model, run=lm.normalisers):
        seen["model"] = model
        return run(spark, model)

    monkeypatch.setattr(lm, "normalisers", spy)
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 300}" for j in range(n)), "s") for i, n in enumerate([900, 40, 513, 512, 511, 3] * 8)]
    got = {g.doc_id: g for g in lm.score(documents(spark, rows).repartition(3)).collect()}
    c = Counter(w for i, t, _ in rows if not got[i].held_out for w in [*t.split(), ""])
    assert min(c.values()) > 1 and all(w in c for _, t, _ in rows for w in t.split())
    hashed = {w: lm.signed(lm.word_hashes([w.encode()]))[0] for w in c}
    cls = {w: k for k, w in enumerate(sorted(c, key=lambda w: (-c[w], hashed[w])))}
    m = seen["model"]
    score = m.scores(m.hidden()).astype(np.float64)
    log_p = (score - lm.log_sum(score)[:, None]) / np.log(10)
    for i, t, _ in rows:
        steps = [cls[w] for w in [*t.split(), ""]]
        assert got[i].n_tokens == len(steps)
        assert abs(got[i].score - sum(log_p[a, b] for a, b in zip([m.k, *steps], steps))) < 1e-2, i


# --- html -----------------------------------------------------------------------------------------

BODY = "The river and the house of the green hill are in the middle of this land, as it was for all who came to it."
PAGES = [
    (None, ""), ("", ""), ("plain words only", "plain words only"),
    (f"<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/a>A</a></ul></nav><div class=ad>{BODY}</div>"
     f"<article><h1>Head</h1><p><b>{BODY}<br><p>Short.</p><p>x &amp; y&nbsp;&lt;z&#233; \n\t w</p><div class='reader-comments'><p>{BODY}</div><form>{BODY}</form><script>if (a < b) '</p>';</script></article>"
     f"<aside>{BODY}</aside><div id='cookie-notice'>{BODY}</div><footer>&copy; f {BODY}</footer></body></html>", f"Head\n{BODY}\nShort.\nx & y <zé w"),
    (f"<body><ul class=menu><li><a>one</a><li><a>two</a></ul><p>{BODY}</p><p>Short one.</p><p>{BODY}</p><div class=footer><p>{BODY}</p></div>", f"{BODY}\nShort one.\n{BODY}"),
    (f"<main><p>{BODY}</p><p>cut &am", f"{BODY}\ncut &am"), (f"<article><p>{BODY}<!-- never closed <p>x", BODY), (f"<article><p title='a > b'>{BODY}</p><p class=\"x", BODY),
    ("<article><p>kurz</p></article>", "kurz"), (f"<article>a<span>b</span>c<div>d</div>{BODY}</article>", f"abc\nd\n{BODY}"),
]


def test_main_text(spark):
    for page, text in PAGES:
        assert html_text.main_text(page) == text, page
    df = spark.createDataFrame([(i, f"u{i}", p, "x") for i, (p, _) in enumerate(PAGES)] + [(None, None, None, None)], "page_id long, url string, html string, text string")
    assert Counter(map(tuple, html_text.extract(df).collect())) == Counter([(i, f"u{i}", t, len(t)) for i, (_, t) in enumerate(PAGES)] + [(None, None, "", 0)])
    assert html_text.extract(df.where("false")).collect() == []
    assert html_text.main_text("<div>" * 5000 + "<p>" * 5000 + "x</div>" * 3) != ""


def test_part_of_a_name_does_not_condemn_the_article():
    for kind in ("article class='post category-social'", "article class='post tag-search'", "main class='with-sidebar'", "div id=main class='has-sidebar'"):
        assert html_text.main_text(f"<{kind}><p>{BODY}</p></{kind.split()[0]}>") == BODY
        assert html_text.main_text(f"<div class='site has-sidebar'><div class='no-topbar'><{kind}><p>{BODY}</p><div class='post-share'>{BODY}</div></{kind.split()[0]}></div>"
                                   f"<div class='right-sidebar'><p>{BODY}</p></div></div>") == BODY
    for name, stays in (("social-history", True), ("news-alert-body", True), ("lead post-promo2b", True), ("ad", False), ("x ad-slot-2", False), ("related-posts", False)):
        for tag in ("p", "div"):
            assert html_text.main_text(f"<article><p>{BODY}</p><{tag} class='{name}'>B x</{tag}></article>") == (f"{BODY}\nB x" if stays else BODY), name
    page = f"<article><p>{BODY}</p><div class=comments><article class=comment>{BODY}</article></div></article><div class=sidebar><article>{BODY}</article></div>"
    assert html_text.main_text(page) == BODY


# --- licences -------------------------------------------------------------------------------------

def brute_licences(t, templates, dice=0.8):
    word = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s))
    grams = lambda w: {(a, b) for a, b in zip(w, w[1:])}
    lines = [(k, word(x)) for k, x in enumerate((t or "").split("\n")) if word(x)]
    found = []
    for name, texts in templates.items():
        for s in (grams(word(x)) for x in texts):
            for i in range(len(lines)):
                for j in range(i, len(lines)):
                    g = grams([w for _, x in lines[i:j + 1] for w in x])
                    if s and g and 2 * len(s & g) >= dice * (len(s) + len(g)):
                        v = (-2 * len(s & g) / (len(s) + len(g)), lines[i][0], lines[j][0])
                        found.append((*v, name))
    out = []
    for v, i, j, name in sorted(found):
        if all(j < a or i > z for _, _, a, z in out):
            out.append((name, -v, i, j))
    return sorted(out)


def test_licences_equal_brute_force(spark):
    mit = license_scan.TEMPLATES["MIT"][2]
    cut = mit.split()
    texts = [None, "", "\n\n", "Released under the MIT License.", "intro\nReleased under\nthe  MIT license\nmore text here", mit, "\n".join(" ".join(cut[i:i + 7]) for i in range(0, len(cut), 7)),
             " ".join(w for i, w in enumerate(cut) if i % 15), " ".join(w for i, w in enumerate(cut) if i % 4), "This work is licensed under the GNU General Public License, version 3.\n\nLicensed under CC BY-NC 4.0.",
             "LICENSED UNDER CC BY NC 4 0", "under the License\n" * 30, "Licensed under the Apache License, Version 2.0."]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + mixed_rows()[:40]
    got = license_scan.scan(documents(spark, rows)).collect()
    want = Counter((i, n, round(v, 9), a, z) for i, t, _ in rows for n, v, a, z in brute_licences(t, license_scan.TEMPLATES))
    assert Counter((g.doc_id, g.license, round(g.dice, 9), g.first_line, g.last_line) for g in got) == want
    assert license_scan.scan(documents(spark, [])).collect() == []


def best_window(t, template, dice=0.8):
    w, m = license_scan.words(t.encode()), license_scan.words(template.encode())
    s = set(zip(m, m[1:]))
    out = 0.0
    for i in range(len(w)):
        for j in range(i + 2, min(len(w), i + 200) + 1):
            g = set(zip(w[i:j], w[i + 1:j]))
            out = max(out, 2 * len(s & g) / (len(s) + len(g)))
    return out if out >= dice else None


def test_each_notice_of_a_licence_is_found(spark):
    one, other = "Released under the MIT License.", "Licensed under CC BY 4.0."
    prose = lambda n: " ".join(f"w{i}" for i in range(n))
    lines = [one, prose(40), one, other, f"{prose(30)} {one} {prose(20)} {one} {prose(9)} {other}", prose(7), one]
    many = " ".join(f"{one} {prose(12)}" for _ in range(400))
    got = license_scan.scan(documents(spark, [(1, "\n".join(lines), "s"), (2, many, "s")])).collect()
    assert sorted((g.license, g.first_line, g.last_line) for g in got if g.doc_id == 1) == [
        ("CC-BY-4.0", 3, 3), ("CC-BY-4.0", 4, 4), ("MIT", 0, 0), ("MIT", 2, 2), ("MIT", 4, 4), ("MIT", 4, 4), ("MIT", 6, 6)]
    assert [(g.license, g.dice, g.first_line, g.last_line) for g in got if g.doc_id == 2] == [("MIT", 1.0, 0, 0)] * 400


def test_licences_inside_longer_lines(spark):
    mit = license_scan.TEMPLATES["MIT"][2]
    gpl = "This work is licensed under the GNU General Public License, version {}."
    prose = " ".join(f"w{i}" for i in range(90))
    texts = ["Copyright 2020 Foo. Licensed under CC BY 4.0. Contact us at any time for more of this.", f"Copyright (c) 2001 A B {mit} The above copyright notice shall be included. THE SOFTWARE IS PROVIDED AS IS. {prose}",
             prose + " " + " ".join(x for i, x in enumerate(mit.split()) if i % 15) + " and it goes on",
             f"intro words stand here before. {gpl.format(2)} Then other words. {gpl.format(3)} Then some more words follow.", f"{gpl.format(3)}\nIt is said here that: {gpl.format(2)} And more words follow.",
             "a line\nand it is Released under the\nMIT License. So be it for ever and ever", "under the license " * 3000, "Licensed under it. Contact us at CC BY, please."]
    got = {}
    for g in license_scan.scan(documents(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect():
        got.setdefault(g.doc_id, {})[g.license] = (round(g.dice, 9), g.first_line, g.last_line)
    want = lambda t, name: round(max(best_window(t, x) or 0 for x in license_scan.TEMPLATES[name]), 9)
    assert got == {0: {"CC-BY-4.0": (1.0, 0, 0)}, 1: {"MIT": (want(texts[1], "MIT"), 0, 0)}, 2: {"MIT": (want(texts[2], "MIT"), 0, 0)},
                   3: {"GPL-2.0": (1.0, 0, 0), "GPL-3.0": (1.0, 0, 0)}, 4: {"GPL-3.0": (1.0, 0, 0), "GPL-2.0": (1.0, 1, 1)}, 5: {"MIT": (1.0, 1, 2)}}
