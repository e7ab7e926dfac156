from collections import Counter

import corpus_pipeline
from llm import test_decontaminate, test_overlap_join, test_suffix_dedup
from llm.helpers import documents, mixed_rows, words

from volpanel.llm import source_mix


def corpus():
    import random

    r = random.Random(12)
    text = lambda n: " ".join(r.choice(("the", "of", "and", "to", "in")) + " " + r.choice("abcdefghijkl") + str(r.randrange(400)) for _ in range(n)) + "."
    rows = [(i, text(r.choice((6, 20, 60))), f"s{i % 3}") for i in range(60)]
    passage = text(40)
    rows += [(100 + i, text(20) + "\n" + passage + "\n" + text(20), "s1") for i in range(8)]
    rows += [(200 + i, rows[i][1] + " tail", "s2") for i in range(0, 60, 6)] + [(300, rows[5][1], None), (300, rows[5][1], None)]
    items = [(k, " ".join(rows[k][1].split()[:12])) for k in (2, 11, 65)]
    return rows + mixed_rows()[-16:], items


def as_rows(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_each_stage_equals_brute_force(spark, tmp_path):
    rows, items = corpus()
    docs = documents(spark, rows)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for name in list(stages)[:-1]:
        before = as_rows(docs)
        out = stages[name](spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        after = as_rows(out)
        if name == "quality rules":
            assert set(after) <= set(before) and all(len(words(t)) >= 10 for _, t, _ in after)
            assert {i for i, _, _ in after} >= {i for i, _, _ in rows if i is not None and 100 <= i < 108}
        elif name == "n-gram Jaccard join":
            want = {(d, t, s) for (d, t, s), (_, _, c) in zip(before, test_overlap_join.brute(before)) if d == c}
            assert Counter(after) == Counter(want)
        elif name == "suffix-array dedup":
            cut = {d: (n, removed) for d, n, removed, _, _ in test_suffix_dedup.brute(before)}
            assert {d: len(t.encode()) for d, t, _ in after} == {d: n - r for d, (n, r) in cut.items() if n > r or not n}
            assert any(r for _, r in cut.values())
        else:
            want = [row for row, b in zip(before, test_decontaminate.brute(before, items)) if not b[5]]
            assert Counter(after) == Counter(want) and len(after) < len(before)
        docs = spark.createDataFrame(out.collect(), out.schema)
    mixed = stages["mixing sources"](spark, docs, str(tmp_path))
    assert Counter({r.doc_id: r.copies for r in mixed.collect()}) and all(r.copies in (1, 2) and r.finish > 0 for r in mixed.collect())
    plan = source_mix.mix(docs.selectExpr("xxhash64(doc_id, text) k", "source", "text"), key="k")
    assert mixed.groupBy().sum("copies").first()[0] == plan.groupBy().sum("copies").first()[0]
    assert Counter(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == Counter(map(str, mixed.collect()))


def test_stages_take_raw_and_empty_tables(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (documents(spark, rows), documents(spark, [])):
        for name, fn in corpus_pipeline.STAGES:
            out = fn(spark, table, str(tmp_path))
            assert out.count() <= table.count()


def test_stages_take_any_column_names(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = documents(spark, rows, extra=False)
    odd = plain.selectExpr("*", "1 AS `a.b`", "2 AS `__text`", "3 AS Head", "4 AS code", "5 AS `__k`", "6 AS copies", "7 AS hits", "8 AS `row`", "9 AS spots", "10 AS doc", "11 AS `tick``s`")
    for name, fn in corpus_pipeline.STAGES:
        want, got = fn(spark, plain, str(tmp_path)), fn(spark, odd, str(tmp_path))
        if name != "mixing sources":
            assert got.columns == odd.columns
            assert all(list(r)[-11:] == list(range(1, 12)) for r in got.collect())
        assert Counter(as_rows(got)) == Counter(as_rows(want))
