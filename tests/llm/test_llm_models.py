"""Learnt models against plain loops."""

import itertools
import math
import random

import numpy as np
import pandas as pd

from riskboard.llm import langid, quality


def plain_ftrl(rows):
    """Follow-the-regularised-leader, one weight at a time."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * quality.L1) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)
    for _ in range(quality.ROUNDS):
        for at, value, label in rows:
            places = [*zip(at, value), (quality.SPACE, 1.0)]
            w = {i: weight(i) for i, _ in places}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[i] * x for i, x in places)))))
            for i, x in places:
                g = (p - label) * x
                step = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA
                z[i] = z.get(i, 0.0) + g - step * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_weights_equal_a_plain_loop():
    rnd = random.Random(3)
    rows = []
    for _ in range(150):
        at = sorted(rnd.sample(range(40), rnd.randrange(0, 9)))
        rows.append((at, [float(np.float32(rnd.random() * 5)) for _ in at], int(sum(at) % 3 == 0)))
    frame = pd.DataFrame({"label": [r[2] for r in rows], "at": [np.array(r[0], np.int32) for r in rows],
                          "value": [np.array(r[1], np.float32) for r in rows]})
    told = np.frombuffer(next(quality.learn(iter([frame.iloc[:60], frame.iloc[60:]])))["weights"].iloc[0], "<f4")
    want = plain_ftrl(rows)
    assert len(told) == quality.SPACE + 1
    for i, w in want.items():
        assert abs(told[i] - w) <= 1e-5 * max(1, abs(w))
    assert set(np.flatnonzero(told)) <= set(want)


def words_of(seed, docs, langs):
    rng = np.random.default_rng(seed)
    size = rng.integers(1, 30, docs)
    like = rng.random((int(size.sum()), langs)) ** 4 + 1e-9
    starts = np.cumsum(size) - size
    return like, starts, np.repeat(np.arange(docs), size), size


def test_mixture_equals_a_plain_loop():
    like, starts, doc, size = words_of(5, 12, 4)
    got = langid.mixture(like, starts, doc, np.full((12, 4), 0.25))
    share = [[0.25] * 4 for _ in range(12)]
    for _ in range(langid.ROUNDS):
        new = []
        for d in range(12):
            total = [0.0] * 4
            for w in range(starts[d], starts[d] + size[d]):
                part = [like[w, k] * share[d][k] for k in range(4)]
                for k in range(4):
                    total[k] += part[k] / sum(part)
            new.append([t / size[d] for t in total])
        moved = max(abs(a - b) for x, y in zip(new, share) for a, b in zip(x, y))
        share = new
        if moved < 1e-4:
            break
    assert np.abs(got - np.array(share)).max() < 1e-9
    # each round can only raise the likelihood, so the end is no worse than the beginning
    fit = lambda s: np.log((like * s[doc]).sum(1)).sum()
    assert fit(got) >= fit(np.full((12, 4), 0.25))


def test_chosen_sets_have_the_best_penalised_likelihood():
    like, starts, doc, size = words_of(7, 15, 4)
    share = langid.mixture(like, starts, doc, np.full((15, 4), 0.25))
    kept = langid.chosen(like, starts, doc, share)
    for d in range(15):
        own = like[starts[d]:starts[d] + size[d]]
        order = sorted(range(4), key=lambda k: (-share[d, k], k))

        def fit(group):
            part = np.array([share[d, k] if k in group else 0.0 for k in range(4)])
            return float(np.log((own * (part / part.sum())).sum(1)).sum()) - 0.5 * (len(group) - 1) * math.log(max(2, size[d]))
        nested = [set(order[:k]) for k in range(1, 5)]
        best = max(nested, key=fit)
        assert abs(fit(set(np.flatnonzero(kept[d]).tolist())) - fit(best)) < 1e-9
        # among all sets that hold the main language none of the same size has larger shares
        for other in itertools.combinations(range(4), int(kept[d].sum())):
            assert share[d, list(other)].sum() <= share[d, kept[d]].sum() + 1e-12
