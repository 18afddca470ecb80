import math
import random
from collections import Counter

import pytest

from weftline.llm.source_mixing import Target, apply_mixture, mixture

SCHEMA = "doc_id long, text string, source string"


def rows(seed=0, n=600):
    rng = random.Random(seed)
    return [(i, "w " * rng.randrange(0, 40), rng.choices(["a", "b", "c", "d", None], [60, 20, 10, 5, 5])[0]) for i in range(n)]


def shares(data):
    t = Counter()
    for _, text, s in data:
        t[s] += len(text.split())
    return t


def weights(tokens, alpha):
    total = sum(tokens.values())
    z = sum((t / total) ** alpha for t in tokens.values())
    return {s: (t / total) ** alpha / z for s, t in tokens.items()}


def entropy(w):
    return -sum(x * math.log(x) for x in w.values())


def collected(spark, data, target):
    return mixture(spark.createDataFrame([(*r, 7, "q") for r in data], SCHEMA + ", copies int, block string"), target).collect()


def test_entropy_is_met(spark):
    data = rows()
    tokens = shares(data)
    got = {r.source: r.weight for r in collected(spark, data, Target(entropy=0.9))}
    assert sum(got.values()) == pytest.approx(1, abs=1e-4)
    assert entropy(got) == pytest.approx(0.9 * math.log(len(tokens)), abs=1e-3)
    lo, hi = 0.0, 1.0
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if entropy(weights(tokens, mid)) >= 0.9 * math.log(len(tokens)) else (lo, mid)
    assert got == pytest.approx(weights(tokens, lo), abs=1e-5)


def test_natural_shares_that_are_even_enough_stay(spark):
    data = rows()
    tokens = shares(data)
    got = {r.source: r.weight for r in collected(spark, data, Target(entropy=0.1, budget=sum(tokens.values())))}
    assert got == pytest.approx(weights(tokens, 1), abs=1e-5)


@pytest.mark.parametrize("budget", [None, 500, 5000, 40000])
def test_quotas_are_realised(spark, budget):
    data = rows()
    tokens = shares(data)
    got = collected(spark, data, Target(entropy=0.95, budget=budget))
    taken, size = Counter(), {r.source: r.weight for r in got}
    for r in got:
        taken[r.source] += r.copies * r.n_tokens
    total = budget if budget is not None else max(tokens[s] / w for s, w in size.items())
    for s, w in size.items():
        assert w * total - 45 <= taken[s] <= w * total + 1
        copies = {r.copies for r in got if r.source == s}
        assert max(copies) - min(copies) <= 1
    for s in size:  # one more epoch is a beginning of the permutation
        order = [r.copies for r in sorted((r for r in got if r.source == s), key=lambda r: (r.block_key, r.doc_key))]
        assert order == sorted(order, reverse=True)


def test_repetition_limit(spark):
    data = rows()
    got = collected(spark, data, Target(entropy=0.99, repeats=1.5))
    assert {r.copies for r in got if r.n_tokens} <= {1, 2}
    taken, tokens = Counter(), shares(data)
    for r in got:
        taken[r.source] += r.copies * r.n_tokens
    assert all(1 - 45 / tokens[s] <= taken[s] / tokens[s] <= 1.5 + 1e-6 for s in tokens)


def test_passes_and_both_limits(spark):
    """A budget of one and a half passes: alpha under 1, rows taken more and less often, no token over the limit."""
    data = rows()
    tokens = shares(data)
    got = collected(spark, data, Target(entropy=0.97, passes=1.5))
    assert got and len({r.copies for r in got}) > 2
    w = {r.source: r.weight for r in got}
    assert entropy(w) == pytest.approx(0.97 * math.log(len(tokens)), abs=1e-3)
    taken = Counter()
    for r in got:
        taken[r.source] += r.copies * r.n_tokens
    assert all(w[s] * 1.5 * sum(tokens.values()) - 45 <= taken[s] <= w[s] * 1.5 * sum(tokens.values()) + 1 for s in tokens)
    limited = collected(spark, data, Target(entropy=0.99, passes=1.5, repeats=2.5))
    assert max(r.copies for r in limited) == 3 and max(1.5 * r.weight * sum(tokens.values()) / tokens[r.source] for r in limited) == pytest.approx(2.5, abs=1e-3)


def test_epochs_are_numbered(spark):
    data = rows(n=200)
    docs = spark.createDataFrame([(*r, "x") for r in data], "`i.d` long, text string, source string, epoch string")
    got = apply_mixture(docs, Target(entropy=0.95, repeats=2.0), id_col="i.d", epoch_col="turn").collect()
    by = Counter(r["i.d"] for r in got)
    assert {(r["i.d"], r.turn) for r in got} == {(i, k + 1) for i, n in by.items() for k in range(n)}


def test_rows_without_ids_and_long_texts(spark):
    data = [(None, f"w{i} " * (1 + i % 5), "ab"[i % 2]) for i in range(300)] + [(1, "w " * 150_000, "c")]
    got = collected(spark, data, Target(entropy=1.0, passes=1.0))
    assert len({r.block_key for r in got if r.doc_id is None}) > 5 and max(r.n_tokens for r in got) == 150_000


def test_rows_with_all_columns(spark):
    data = rows(n=200)
    docs = spark.createDataFrame([(*r, 7, "q", f"x{r[0]}") for r in data], SCHEMA + ", copies int, epochs string, __src string")
    target = Target(entropy=0.95, repeats=2.0)
    copies = {r.doc_id: r.copies for r in mixture(docs, target).collect()}
    got = apply_mixture(docs, target)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter({i: n for i, n in copies.items() if n})


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixture(empty, Target()).collect() == [] and apply_mixture(empty, Target()).collect() == []
    got = collected(spark, [(1, None, "a"), (2, "", "a"), (3, " ", None)], Target())
    assert {(r.doc_id, r.n_tokens, r.weight, r.copies) for r in got} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0), (3, 0, 0.0, 0)}
    got = collected(spark, [(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s")], Target())
    assert sorted(r.copies for r in got) == [1, 1, 1]
