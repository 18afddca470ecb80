import itertools
import random

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from weftline.llm import near_dup as nd
from weftline.llm.graph import components


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs of shingle sets of strings."""
    sets = {}
    for i, text in rows:
        w = bytes(text or "", "utf-8").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {(i, len(sets[i]), root(i), root(i) == i) for i in sets}


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for base in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 20, 60, 200, 900]))]
        for copy in range(10):
            w = list(words)
            for _ in range(copy // 2):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((n, " ".join(x.upper() if rng.random() < 0.3 else x for x in w)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "one"), (n + 4, "ONE\x0b"), (n + 5, "ONÉ"), (n + 6, "oné")]


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(t, i, "x", "y") for i, t in rows], "text string, doc_id long, kept string, n_shingles string")
    assert {tuple(r) for r in nd.near_duplicates(docs).collect()} == brute(rows)


def test_blocks_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_TEXTS", 7)
    rng = random.Random(2)
    words = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):
        w = list(words)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == brute(rows)


def near_copies(n):
    """n texts, each with one of 300 words changed; and three that share much with them but too little."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(n):
        w = list(base)
        w[rng.randrange(300)] = f"v{i}"
        rows.append((i + 10, " ".join(w)))
    return rows, [(k, " ".join(base[: 270 - 40 * k] + [f"z{k}_{j}" for j in range(60)])) for k in range(3)]


def test_groups_of_long_texts_meet_once(spark, monkeypatch, shipped):
    """Two groups that share three quarters of their words meet under many rare shingles, and each text comes once."""
    monkeypatch.setattr(nd, "BLOCK_TEXTS", 10)
    base = [f"w{k}" for k in range(2000)]
    rows = [(100 * g + i, " ".join([*base[:1500], *(f"g{g}_{k}" for k in range(500)), f"own{i}"])) for g in range(3) for i in range(20)]
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {100 * g + i: 100 * g for g in range(3) for i in range(20)}
    assert shipped["post"] <= 4 * len(rows) * 3


@pytest.fixture
def shipped(monkeypatch):
    """Rows with texts that meet hubs, and that the rest of a large cluster takes."""
    seen = {"hub": 0, "post": 0}
    hub_links, sided = nd._hub_links, nd._sided_blocks

    def counted(key, f):
        def run(first, *rest):
            out = f(first, *rest)
            seen[key] += (first if key == "hub" else out).count()
            return out

        return run

    monkeypatch.setattr(nd, "_hub_links", counted("hub", hub_links))
    monkeypatch.setattr(nd, "_sided_blocks", counted("post", sided))
    return seen


def test_a_large_group_costs_in_proportion(spark, monkeypatch, shipped):
    """Every near copy meets its hub, and strays too far away meet no text of the group afterwards."""
    monkeypatch.setattr(nd, "BLOCK_TEXTS", 100)
    copies, strays = near_copies(1500)
    for rows, most in ((copies, 2), (copies + strays, 4)):
        shipped.update(hub=0, post=0)
        got = {r.doc_id: r.component_id for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert {got[i] for i, _ in copies} == {10} and [got.get(k, k) for k in range(3)] == [0, 1, 2]
        assert sum(shipped.values()) <= most * 1500


def test_texts_that_are_alike_but_not_linked_cost_in_proportion(spark, monkeypatch, shipped):
    """Pages of one template with eight fillings each: candidates of each other, none linked."""
    monkeypatch.setattr(nd, "BLOCK_TEXTS", 50)
    rows = []
    for i in range(1000):
        w = [f"w{k}" for k in range(300)]
        for k in range(8):
            w[20 + 35 * k] = f"v{i}_{k}"
        rows.append((i, " ".join(w)))
    rows += [(2000, rows[4][1] + " one more"), (2001, rows[-1][1].replace("w299", "v"))]
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(1000)} | {2000: 4, 2001: 999}
    assert sum(shipped.values()) <= 4 * len(rows)


@pytest.mark.parametrize("few", [64, 3, 1])
def test_groups_in_one_cluster(spark, monkeypatch, few):
    """Several groups, large and small, whose texts are candidates of each other."""
    monkeypatch.setattr(nd, "BLOCK_TEXTS", 8)
    monkeypatch.setattr(nd, "FEW", few)
    rng = random.Random(8)
    rows, n = [], 0
    base = [f"w{k}" for k in range(80)]
    for group in range(9):
        mine = list(base)
        for k in range(8):
            mine[(group * 8 + k) % 80] = f"g{group}_{k}"
        for _ in range([25, 12, 3, 1, 1, 2, 9, 1, 6][group]):
            w = list(mine)
            w[rng.randrange(80)] = f"v{n % 7}"
            rows.append((n, " ".join(w)))
            n += 1
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_odd_names(spark):
    text = "a b c d e f g"
    docs = spark.createDataFrame([(1, text, "p", 1), (2, text, "q", 2), (2, "h i j k l", "r", 3), (3, None, "s", 4)], "`i.d` long, `te``xt` string, `__id` string, key int")
    left = nd.drop_near_duplicates(docs, "i.d", "te`xt")
    assert left.columns == docs.columns and sorted(r["__id"] for r in left.collect()) == ["p", "r", "s"]


def test_texts_count_and_not_ids(spark):
    """Texts under one id are apart, copies without an id are not, and one row of each group stays."""
    a, b, c = "a b c d e f g h", "totally other text that shares nothing with it", "one two three four five six"
    rows = [(1, a), (1, b), (None, a), (None, a), (None, c), (None, c), (7, b), (None, None), (None, ""), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = nd.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got if r.n_shingles), key=str) == sorted([(1, 1, True), (1, 1, True), (None, 1, False), (None, 1, False), (None, None, True), (None, None, True), (7, 1, False)], key=str)
    left = sorted(((r.doc_id, r.text) for r in nd.drop_near_duplicates(docs).collect()), key=str)
    assert left == sorted([(1, a), (1, b), (None, c), (None, None), (None, ""), (1, None)], key=str)


def test_empty_table_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert nd.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, None)], schema)
    got = sorted((tuple(r) for r in nd.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(3, 2, 3, True), (3, 2, 3, True), (5, 2, 3, False), (None, 2, 3, False), (None, 0, None, True)], key=str)
    left = nd.drop_near_duplicates(rows).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in left))) == sorted(map(str, [(3, "a b c d e f"), (None, None)]))


def test_threshold_is_checked(spark):
    with pytest.raises(ValueError):
        nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), num=1, den=2)


def test_very_long_text(spark):
    words = " ".join(f"w{k}" for k in range(200_000))
    got = nd.near_duplicates(spark.createDataFrame([(1, words), (2, words + " more")], "doc_id long, text string"))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(1, 1), (2, 1)}


def test_registers_hold_zeros_and_mantissa():
    value = (0b0001_1010_1010_101 << 33) | 5  # of the 48 bits below a bucket's number
    regs = nd.registers(np.array([3 << 56 | value << 8], np.uint64))
    assert (regs != nd.EMPTY).sum() == 1
    shifted = value << (48 - value.bit_length())
    assert regs[3] == (48 - value.bit_length()) << nd.R | (shifted >> (47 - nd.R)) & ((1 << nd.R) - 1)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1), min_size=1, max_size=6), st.lists(st.sets(st.integers(0, 40), min_size=1), min_size=1, max_size=6))
def test_overlaps(a, b):
    sets = [[np.array(sorted(s), np.uint64) for s in side] for side in (a, b)]
    want = [[len(x & y) for y in b] for x in a]
    for most in (1, 7, 1000):
        assert nd.overlaps(*sets, most=most).tolist() == want


def test_estimate_keeps_links():
    """No pair at the threshold or above is ruled out."""
    rng = np.random.default_rng(0)
    for n in (7, 12, 40, 150, 2000):
        for _ in range(60):
            pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
            drop = int(n * 0.15 / 1.15)
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[drop:n], pool[n : n + 0]]))
            assert nd.estimates(np.array([nd.registers(a)]), np.array([nd.registers(b)]), np.array([len(a)]), np.array([len(b)]), 0.85).all()


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=25))
@example([(k, k + 1) for k in range(15)])
@example([(15, k) for k in range(15)])
@example([(k, 15 - j) for j in range(4) for k in range(3 * j, 3 * j + 3)])
def test_components(spark, edges):
    parent = list(range(16))
    for _ in range(16):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = {(r.node, r.component) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, parent[x]) for x in nodes}
