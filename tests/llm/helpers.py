"""Small tables with the awkward rows that every operator must take, and brute-force pieces."""

import random
import re

WS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def words(s):
    return WS.findall(s or "")


def documents(spark, rows, extra=True):
    """documents with the usual columns plus columns whose names clash with results."""
    out = [(i, t, "en", s, None if t is None else len(t), 7, "x") for i, t, s in rows]
    df = spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long, sid long, kept string")
    return df if extra else df.drop("sid", "kept")


def mixed_rows(seed=1, n=60):
    """Null, empty, blank, one-word, very long, repeated and near-copied texts; ties and repeated rows."""
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)] + ["Ünï", "é", "日本語", "A", "a,b"]
    base = [" ".join(r.choice(vocab) for _ in range(r.choice((3, 5, 6, 8, 12, 40, 90)))) for _ in range(n)]
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(base)]
    for i in range(0, n, 3):
        w = base[i].split()
        for _ in range(r.choice((1, 1, 2, 4))):
            if len(w) > 1:
                w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((n + i, " ".join(w), "s1"))
        rows.append((2 * n + i, base[i].upper() if i % 2 else base[i], None))
    passage = " ".join(r.choice(vocab) for _ in range(30))
    rows += [(1000 + i, f"{base[i]}\n{passage} {base[(i + 7) % n]}", "s2") for i in range(12)]
    rows += [(2000, None, "s0"), (2001, "", "s0"), (2002, " \t\n ", None), (2003, "one", ""), (2004, "one", "s3"),
             (2005, "a b c d", "s3"), (2006, "a\tb\nc  d", "s3"), (2007, "x " * 3000, "s1"), (2008, " ".join(base * 3), "s2"),
             (2009, "b a", "s1"), (2009, "b a", "s1"), (None, "a b c d", "s1"), (2010, base[1], "s9"), (2010, base[1], "s9")]
    return rows
