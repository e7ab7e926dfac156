import random
import re
import zlib

import numpy as np

from volpanel.llm import language_id as li

WORDS = {"aa": ["bano", "tiru", "kelo", "sami"], "bb": ["struck", "brandt", "schwelm", "knorpf"], "": ["öäü", "åäö", "ñuñ", "éèê"]}


def text(r, lang, n=None):
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", r.choice(WORDS[lang])]) for _ in range(n or r.choice((1, 3, 12, 40))))


def brute_grams(s):
    s = " " + re.sub(r"[\W\d_]+", " ", s.lower()).strip() + " "
    return {s[i:i + n] for n in (1, 2, 3, 4) for i in range(len(s) - n + 1)}


def brute(train, landmarks, texts, ridge):
    """Dense kernels over plain sets and the primal-free solution on the landmarks."""
    sets = [brute_grams(t) for t, _ in train]
    k = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    z = [sets[i] for i in landmarks]
    k_zz = np.array([[k(a, b) for b in z] for a in z])
    k_xz = np.array([[k(a, b) for b in z] for a in sets])
    names = sorted({lang for _, lang in train})
    y = np.array([[1.0 if lang == n else -1.0 for n in names] for _, lang in train])
    alpha = np.linalg.pinv(k_xz.T @ k_xz + ridge * k_zz, rcond=1e-12) @ k_xz.T @ y
    return names, np.array([[k(brute_grams(t), b) for b in z] for t in texts]) @ alpha


def rows(seed=3, n=300):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(sorted(WORDS))
        out.append((i, text(r, lang), lang if i % 5 else None))
    out += [(n + i, "copy bano tiru", "aa") for i in range(30)]
    return out + [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !?", "aa"), (903, "bano " * 30000, "aa"), (904, "bano", "aa"), (904, "bano", "aa"),
                  (None, "schwelm brandt", None), (905, "日本語", None), (906, "_", "bb"), (907, "²", "aa")]


def frame(spark, data):
    return spark.createDataFrame([(i, t, l, 0.5, "x") for i, t, l in data], "doc_id long, text string, lang string, score double, lang_pred string")


def test_scores_equal_dense_kernel_ridge_regression():
    r = random.Random(1)
    train = [(text(r, lang, 6), lang) for lang in sorted(WORDS) for _ in range(20)]
    landmarks = [0, 1, 5, 21, 22, 30, 41, 45]
    texts = [text(r, lang) for lang in WORDS for _ in range(10)] + ["q", "bano schwelm"]
    model = li.solve([li.grams(t) for t, _ in train], [lang for _, lang in train], landmarks, 0.3)
    names, want = brute(train, landmarks, texts, 0.3)
    assert names == model.names
    assert np.abs(model.scores([li.grams(t) for t in texts]) - want).max() < 1e-4


def test_grams_are_those_of_the_whole_text(monkeypatch):
    s = "Ünï-code 日本 é _x_ 12\tABC" * 50
    one = li.grams(s)
    assert len(one) == len(brute_grams(s))
    monkeypatch.setattr(li, "CHUNK", 7)
    assert (li.grams(s) == one).all()


def test_all_rows_are_judged(spark):
    data = rows()
    got = li.identify(frame(spark, data)).collect()
    assert len(got) == len(data)
    by = {}
    for g in got:
        by.setdefault(g["doc_id"], set()).add(tuple(g))
        assert g["held_out"] == (zlib.crc32(("" if g["doc_id"] is None else str(g["doc_id"])).encode()) % 4 == 2)
        assert 0 <= g["score"] <= 1
    assert len(by[904]) == 1
    for i in (900, 901, 902, 906, 907):
        assert {(g[2], g[3]) for g in by[i]} == {("und", 0.0)}
    truth = {i: next(lang for lang in WORDS if t.split()[0][:3] in {w[:3] for w in WORDS[lang]}) for i, t, _ in data[:300]}
    assert np.mean([next(iter(by[i]))[2] == lang for i, lang in truth.items()]) > 0.97
    assert next(iter(by[903]))[2] == "aa" and next(iter(by[None]))[2] == "bb"


def test_nothing_is_learned_from_held_out_rows_or_other_columns(spark):
    data = [(i, t, lang) for i, t, lang in rows() if i is not None]
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in data]
    lied = [(i, t, "lie" if h else lang) for (i, t, lang), h in zip(data, held, strict=True)]
    a, b = ({tuple(r) for r in li.identify(frame(spark, d)).collect()} for d in (data, lied))
    assert a == b


def test_nothing_to_learn(spark):
    assert li.identify(frame(spark, [])).count() == 0
    got = li.identify(frame(spark, [(1, "abc", None), (5, None, "aa")])).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = li.identify(docs).where("held_out").join(docs.select("doc_id", "lang", "text"), "doc_id").where("lang is not null and length(text) > 40").collect()
    assert len(got) > 150 and np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97


def test_sample_is_even_and_without_copies(spark):
    data = [(i, f"bano {i}", "aa") for i in range(3000)] + [(9000 + i, "same schwelm", "bb") for i in range(500)] + [(9900 + i, f"tiru {i}", "bb") for i in range(10)]
    got = li.sample(frame(spark, data), 200).groupBy("lang").count().collect()
    n = {r["lang"]: r["count"] for r in got}
    assert n["bb"] == 11 and 70 < n["aa"] < 180
