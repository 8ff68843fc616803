"""The similarity join against a comparison of everything with everything."""

import random
import re

import pytest

from burstlake.operators import matching


def similar(a, b):
    fa, fb = (re.sub("[^a-z0-9]+", "", x.lower()) for x in (a, b))
    ta, tb = (set(re.findall("[a-z0-9]+", x.lower())) for x in (a, b))
    if not fa or not fb:
        return 0.0
    return 1.0 if fa == fb else 0.86 if fa in fb or fb in fa else len(ta & tb) / max(len(ta), len(tb))


def brute(names, entries, minimum=0.34):
    out = {}
    for name, make in {(n, m or "") for n, m in names}:
        scored = []
        for model, maker in set(entries):
            m = similar(name, model)
            if m:
                score = m * 0.78 + (similar(make, maker) if make else 0.5) * 0.22
                if score >= minimum:
                    scored.append((-round(score, 9), model, maker))
        best = min(scored, default=(None, None, None))
        out[name, make] = (best[1], best[2], best[0] and -best[0])
    return out


def made(rng, n, hot):
    words = [f"{rng.choice('abcdefg')}{rng.choice('xyz')}{k}" for k in range(60)]
    out = []
    for _ in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(0, 5))]
        if rng.random() < 0.9:
            t.insert(rng.randint(0, len(t)), hot)
        out.append(rng.choice((" ", "-", "", " f/2.8 ")).join(t))
    return out


@pytest.mark.parametrize("minimum", [0.34, 0.6])
def test_equal_to_brute_force_with_a_word_that_nearly_all_have(spark, minimum):
    rng = random.Random(6)
    makers = ["Hot Optics", "Other", "optics hot", "", "B"]
    names = [(n, rng.choice([*makers, None])) for n in made(rng, 150, "mount")] + [("A7", "B"), ("!!", "Other"), ("", None)]
    entries = [(n, rng.choice(makers)) for n in made(rng, 200, "mount")] + [("Sony A7 III", "B"), ("7", "B"), ("??", "Other")]
    got = matching.best_matches(spark.createDataFrame(names, "name string, make string"), spark.createDataFrame(entries, "model string, maker string"), minimum).collect()
    want = brute(names, entries, minimum)
    assert len(got) == len(want) and sum(v[0] is not None for v in want.values()) > 100
    for r in got:
        model, maker, score = want[r["name"], r["make"]]
        assert (r["model"], r["maker"]) == (model, maker) and (r["score"] == pytest.approx(score) if score is not None else r["score"] is None), r


def test_a_frequent_word_joins_few_pairs(spark):
    rng = random.Random(8)
    text = lambda k: " ".join(["mount", *(f"w{rng.randrange(3000)}" for _ in range(5))])
    a, b = ([(text(k),) for k in range(1500)] for _ in range(2))
    left, right = (spark.createDataFrame(x, "text string") for x in (a, b))
    pairs = {(r["a"], r["b"]) for r in matching.token_pairs(left, right, 0.5).collect()}
    close = {(x, y) for x, in a for y, in b if len(set(x.split()) & set(y.split())) >= 0.5 * max(len(set(x.split())), len(set(y.split())))}
    assert close <= pairs and len(pairs) < 1500 * 30  # of 2.25 million that share the word


def test_nothing_to_match(spark):
    names, entries = spark.createDataFrame([("a", None)], "name string, make string"), spark.createDataFrame([], "model string, maker string")
    assert [tuple(r) for r in matching.best_matches(names, entries).collect()] == [("a", "", None, None, None)]
    assert matching.best_matches(names.limit(0), entries).count() == 0
