import hashlib
import random
from collections import Counter

from llm.helpers import documents, mixed_rows

from volpanel.llm import suffix_dedup as sd


def test_suffix_array_equals_sorting():
    r = random.Random(3)
    for alphabet in (b"a", b"ab", b"abc", bytes(range(256))):
        for n in (1, 2, 3, 5, 8, 13, 50, 300):
            for _ in range(20):
                s = bytes(r.choice(alphabet) for _ in range(n))
                assert sd.suffix_array(s) == sorted(range(n), key=lambda i: s[i:]), s


def brute(rows, length=100):
    first = {}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    for k in order:
        b = (rows[k][1] or "").encode()
        for p in range(len(b) - length + 1):
            at = (rows[k][0] is None, rows[k][0] or 0, p)
            first[b[p:p + length]] = min(at, first.get(b[p:p + length], at))
    out = []
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < (i is None, i or 0, p):
                gone[p:p + length] = b"\1" * length
        spans = sum(gone[p] and not (p and gone[p - 1]) for p in range(len(b)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def check(spark, rows):
    got = sd.digest(sd.remove_repeats(documents(spark, rows).repartition(5)))
    assert Counter(map(tuple, got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == Counter(brute(rows))


def test_removal_equals_brute_force(spark):
    r = random.Random(5)
    rows = mixed_rows(7, 40)
    unit = "".join(r.choice("abcdé ") for _ in range(130))
    for i in range(40):  # one passage with small edits, at shifting offsets
        at = r.randrange(130)
        rows.append((3000 + i, "".join(r.choice("xyz") for _ in range(r.randrange(60))) + unit[:at] + r.choice(("", "Q", "é")) + unit[at:] + f" {i}", "s"))
    rows += [(4000 + i, "ab" * r.randrange(40, 140), "s") for i in range(6)]
    rows += [(4100, unit + unit, "s"), (4101, unit[:99], "s"), (4102, unit[:100], "s"), (4103, "é" * 80, "s"), (4104, "日" * 90 + unit, "s")]
    check(spark, rows)


def test_blocks_of_one_anchor_meet(spark, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK", 400)
    r = random.Random(9)
    middle = "".join(r.choice("abcdefgh") for _ in range(60))
    rows = [(i, r.choice("pq") * (i % 40) + middle + r.choice("rs") * 60, "s") for i in range(60)]
    blocks = sd.sort_block([(i, 7, sd.pack(0, 10, 0), (t * 3)[:109].encode()) for i, t, _ in rows[:20]], 100)
    assert blocks[1]
    check(spark, rows)


def test_texts_that_share_an_id(spark):
    r = random.Random(11)
    passages = ["".join(r.choice("abcdefgh") for _ in range(150)) for _ in range(6)]
    rows = [(r.choice((None, None, None, 5, 6, 7)), r.choice(passages) + "".join(r.choice("xy") for _ in range(r.randrange(30)))
             + r.choice(passages), "s") for _ in range(150)]
    check(spark, rows + rows[:20])
    # level in several texts of an id, and earlier in a smaller id of another partition
    check(spark, [(5, passages[0] + "A", "s"), (5, passages[0] + "B", "s"), (5, passages[0] + "B", "s"), (1, "z" + passages[0], "s")])
    check(spark, [(5, passages[0] + "A", "s"), (5, passages[0] + "B", "s")])


def test_many_rows_without_id(spark):
    """Rows without an id spread by their text: one joined array of marks a text, not one for all of them."""
    r = random.Random(12)
    passage = "".join(r.choice("abcdefgh") for _ in range(200))
    rows = [(None, f"{i} " * (i % 9) + passage + f" {i}", "s") for i in range(5000)]
    check(spark, rows)
    docs = documents(spark, rows)
    spots = sd.find_repeats(docs, "doc_id", "text", 100)
    assert spots.groupBy("doc", "tag").count().where("count > 1").isEmpty()
    windows = max(len(t) for _, t, _ in rows) - 99
    assert spots.selectExpr("max(size(spots))").first()[0] <= windows  # those of its own text


def test_column_names_with_dots(spark):
    docs = documents(spark, [(1, "a" * 150, "s"), (2, "b", "s")]).withColumnRenamed("source", "a.`b")
    assert sd.without_repeats(docs).columns == docs.columns
    assert sd.without_repeats(docs).count() == 2


def test_empty_table(spark):
    assert sd.digest(sd.remove_repeats(documents(spark, []))).collect() == []
