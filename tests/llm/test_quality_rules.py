"""The estimation of op5 against an independent one, and on planted accuracies."""

import math
from collections import Counter

import numpy as np

from volpanel.llm import quality_rules as q

K = len(q.RULES)
B, N, G = q.BAD, q.NONE, q.GOOD
# rates of (bad, abstain, good) votes by rule: six defects, two merits; the second rule fires in a quarter of the good texts
PLANTED = np.array([
    [[.5, .5, 0], [.3, .7, 0], [.1, .9, 0], [.4, .6, 0], [.2, .8, 0], [.25, .75, 0], [0, .6, .4], [0, .7, .3]],
    [[.05, .95, 0], [.25, .75, 0], [.02, .98, 0], [.01, .99, 0], [.03, .97, 0], [.02, .98, 0], [0, .1, .9], [0, .2, .8]]])


def planted(n=10_000, share=0.75, seed=0):
    r = np.random.default_rng(seed)
    good = r.random(n) < share
    votes = np.stack([(r.random(n)[:, None] > PLANTED[good.astype(int), j].cumsum(1)).sum(1) for j in range(K)], 1)
    return good, votes


def code(v):
    return int(sum(x * 3 ** (K - 1 - j) for j, x in enumerate(v)))


def plain_em(votes, rounds):
    """Text by text, without patterns or arrays."""
    rates = [[list(map(float, prior[c])) for _, prior in q.RULES.values()] for c in (0, 1)]
    prior = [[[x * q.WEIGHT for x in rule] for rule in c] for c in rates]
    defects = [j for j, (_, p) in enumerate(q.RULES.values()) if p is q._DEFECT]
    share, post = 0.8, []
    for _ in range(rounds):
        post = []
        for v in votes:
            like = [(share if c else 1 - share) * math.prod(rates[c][j][x] for j, x in enumerate(v)) for c in (0, 1)]
            post.append(like[1] / sum(like))
        count = [[list(rule) for rule in c] for c in prior]
        for v, p in zip(votes, post, strict=True):
            for j, x in enumerate(v):
                count[1][j][x] += p
                count[0][j][x] += 1 - p
        rates = [[[x / sum(rule) for x in rule] for rule in c] for c in count]
        for j in range(K):
            for vote, better in ((B, 0), (G, 1)):
                if rates[better][j][vote] < rates[1 - better][j][vote]:
                    rates[0][j][vote] = rates[1][j][vote] = (rates[0][j][vote] + rates[1][j][vote]) / 2
        short = q.LEAST_DEFECTS - sum(rates[0][j][B] for j in defects)
        for j in defects if short > 0 else []:
            rates[0][j][B] += short / len(defects)
        for c in (0, 1):
            for j in range(K):
                rule = rates[c][j]
                rule[N] = max(1 - rule[B] - rule[G], 1e-9)
                rates[c][j] = [x / sum(rule) for x in rule]
        share = (sum(post) + 0.8 * q.WEIGHT) / (len(votes) + q.WEIGHT)
    return post, rates


def test_posteriors_and_rates_equal_a_plain_estimation():
    _, votes = planted(300, seed=4)
    want, want_rates = plain_em(votes.tolist(), 25)
    post, rates = q.fit(Counter(map(code, votes)), rounds=25)
    assert max(abs(post[code(v)] - p) for v, p in zip(votes, want, strict=True)) < 1e-9
    assert np.abs(rates - np.array(want_rates)).max() < 1e-9


def test_rates_move_to_the_planted_accuracies():
    good, votes = planted()
    post, rates = q.fit(Counter(map(code, votes)))
    assert np.abs(rates - PLANTED).max() < 0.05
    kept = np.array([post[code(v)] >= 0.5 for v in votes])
    all_pass = (votes != B).all(1)
    assert (kept == good).mean() > 0.9 > 0.8 > (all_pass == good).mean()


def test_a_verdict_weighs_conflicting_votes():
    """A defect beside two merits: as likely good as the planted rates make it, whichever rule fired."""
    _, votes = planted()
    post, _ = q.fit(Counter(map(code, votes)))
    seen = {}
    for j in range(6):
        v = [N] * 6 + [G, G]
        v[j] = B
        like = [share * math.prod(PLANTED[c, k, x] for k, x in enumerate(v)) for c, share in ((0, 0.25), (1, 0.75))]
        seen[j] = post[code(v)]
        assert abs(seen[j] - like[1] / sum(like)) < 0.1
    assert seen[1] > 0.9 > 0.7 > seen[3]  # it also fires in good texts; it hardly ever does
    v = [N] * 3 + [B] + [N] * 2 + [G, N]
    assert post[code(v)] < 0.5


def test_priors_do_not_grow_with_the_corpus():
    _, votes = planted(4000)
    counts = Counter(map(code, votes))
    few, many = q.fit(counts)[1], q.fit({p: 100 * n for p, n in counts.items()})[1]
    assert np.abs(many - PLANTED).max() <= np.abs(few - PLANTED).max() + 0.01


def test_clean_texts_stay_and_no_rule_is_worse_than_chance():
    clean = {code([N] * 6 + [G, G]): 900, code([N] * 7 + [G]): 300, code([N] * 6 + [G, N]): 200}
    post, _ = q.fit(clean)
    assert all(p >= 0.5 for p in post.values())
    inverted = Counter({code([N] * 6 + [G, G]): 100, code([B] + [N] * 5 + [G, G]): 100, code([N] * 8): 50})
    _, rates = q.fit(inverted)
    assert (rates[0, :, B] >= rates[1, :, B] - 1e-12).all() and (rates[1, :, G] >= rates[0, :, G] - 1e-12).all()
    assert np.allclose(rates.sum(2), 1)
    assert q.fit({})[0] == {}
