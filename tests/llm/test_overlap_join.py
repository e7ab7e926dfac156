from collections import Counter

import pytest
from llm.helpers import documents, lower, mixed_rows, words

from volpanel.llm import overlap_join as oj


def brute(rows):
    sets = []
    for _, t, _ in rows:
        w = words(lower(t or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    par = list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                par[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), least.get(find(k))) for k, (i, _, _) in enumerate(rows)]


def test_classes_equal_brute_force(spark):
    rows = mixed_rows()
    # chains of small edits over short texts: light sets, sets at the boundary, heavy sets
    for size in (6, 7, 8, 9, 10, 12, 13, 14, 15, 16, 17, 30, 60):
        for step in range(6):
            w = [f"c{size}_{k}" for k in range(size)]
            rows.append((5000 + 100 * size + step, " ".join(w[:size - step // 2] + [f"n{size}_{step}_{j}" for j in range(step % 2)]), "s0"))
    got = oj.jaccard_classes(documents(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows))


def test_a_large_group_of_near_copies(spark):
    base = [f"g{k}" for k in range(120)]
    rows = [(10_000 + i, " ".join(base[:i % 120] + [f"e{i}"] + base[i % 120:]) + (f" t{i}" * (i % 25)), "s0") for i in range(150)]
    got = oj.jaccard_classes(documents(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows))


def brute_links(rows):
    """For each row, how many different sets link with its own."""
    sets = []
    for _, t, _ in rows:
        w = words(lower(t or ""))
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    distinct = [s for s in set(sets) if s]
    count = {s: sum(s is not o and 100 * len(s & o) >= 80 * len(s | o) for o in distinct) for s in distinct}
    return [(i, count.get(s, 0)) for (i, _, _), s in zip(rows, sets, strict=True)]


@pytest.mark.parametrize("block", [None, 2500])
def test_every_link_between_different_sets_is_counted(spark, monkeypatch, block):
    if block:  # large components in several blocks, small ones in several bundles
        monkeypatch.setattr(oj, "BLOCK_SHINGLES", block)
    rows = mixed_rows()
    base = [f"g{k}" for k in range(120)]
    rows += [(10_000 + i, " ".join(base[:i] + [f"e{i}"] + base[i:]) + (f" t{i}" * (i % 25)), "s0") for i in range(90)]
    rows += [(10_500 + i, rows[-1 - i][1], "s0") for i in range(5)] + [(None, rows[-20][1], "s1"), (None, rows[-21][1] + " z", "s1")]
    # light sets around a common one, and a chain: neighbours link, its ends do not
    rows += [(11_000 + i, " ".join(f"h{k}" for k in range(12 + i)), "s2") for i in range(6)]
    rows += [(12_000 + i, " ".join(f"k{k}" for k in range(5 * i, 5 * i + 100)), "s2") for i in range(30)]
    got = oj.jaccard_classes(documents(spark, rows)).select("doc_id", "n_linked_sets").collect()
    want = Counter(brute_links(rows))
    assert len({d for _, d in want}) > 5
    assert Counter(map(tuple, got)) == want


def test_empty_table(spark):
    assert oj.jaccard_classes(documents(spark, [])).collect() == []


def test_boundary_follows_cost():
    assert oj.choose_boundary({}, 80) == 0
    assert oj.choose_boundary({6: 1000}, 80) >= 6
    assert oj.choose_boundary({22: 1000}, 80) < 22
