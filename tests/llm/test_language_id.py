import math
import random
from decimal import Decimal

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import language_id as li
from weftline.llm.language_id import UNKNOWN, Model, fit_language, predict, train

SCHEMA = "doc_id long, text string, lang string"
VOCABULARY = {p: i for i, p in enumerate(["a", "b", "ab", "▁a", "▁ab", "ba", "▁b", "bab"])}


def letter_words(text):
    return regex.findall(r"\p{L}+", text.lower())


def fit(counts, rounds, smooth):
    log_p = fit_language([w for w, _ in counts], np.array([n for _, n in counts], float), VOCABULARY, rounds, smooth)
    return Model(["x"], VOCABULARY, log_p[:, None])


def plain_score(word, p):
    """Summed probability of all segmentations, by recursion."""

    def rest(at):
        if at == len(word):
            return 1.0
        total = 0.0
        for size in range(1, len(word) - at + 1):
            piece = ("▁" if at == 0 else "") + word[at : at + size]
            k = VOCABULARY.get(piece, len(VOCABULARY) if size == 1 else None)
            total += 0 if k is None else p[k] * rest(at + size)
        return total

    return rest(0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=9), min_size=1, max_size=8))
def test_forward_sums_all_segmentations(words):
    p = np.random.default_rng(1).dirichlet(np.ones(len(VOCABULARY) + 1), 2).T
    got = Model(["x", "y"], VOCABULARY, np.log(p)).word_scores(words)
    want = [[math.log(plain_score(w, p[:, k])) for k in range(2)] for w in words]
    assert np.allclose(got, want)


def test_long_words_are_scored_whole(monkeypatch):
    """Words of any length have the sum over all segmentations, by decimals, however the passes are cut up."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abc") for _ in range(n)) for n in (30, 30, 64, 300, 2000)]
    p = np.random.default_rng(3).dirichlet(np.ones(len(VOCABULARY) + 1), 1).T * 0.5
    exact = [Decimal(float(x)) for x in p[:, 0]]
    want = []
    for w in words:
        sums = [Decimal(1)]
        for end in range(1, len(w) + 1):
            total = Decimal(0)
            for size in range(1, min(end, 3) + 1):
                piece = ("▁" if size == end else "") + w[end - size : end]
                k = VOCABULARY.get(piece, len(VOCABULARY) if size == 1 else None)
                total += 0 if k is None else exact[k] * sums[end - size]
            sums.append(total)
        want.append(float(sums[-1].ln()))
    for cells in (li.CELLS, 64):
        monkeypatch.setattr(li, "CELLS", cells)
        got = Model(["x"], VOCABULARY, np.log(p)).word_scores(words)[:, 0]
        assert np.allclose(got, want, rtol=1e-9)


def test_backward_agrees_with_forward():
    p = np.append(np.random.default_rng(2).dirichlet(np.ones(len(VOCABULARY) + 1)), 0)
    with np.errstate(divide="ignore"):
        log_p = np.log(p)
    words = ["abab", "bcab", "aaaa"]
    ids = li.lattice(words, VOCABULARY, 3, 0, 4)
    before, after = li._log_sums(ids, log_p, True), li._log_sums(ids, log_p, False)
    assert np.allclose(before[-1], after[0]) and np.allclose(np.exp(before[-1]), [plain_score(w, p) for w in words])


def plain_fit(counts, rounds, smooth):
    """Expectation-maximisation over all segmentations, listed one by one."""

    def cut_up(word, at=0):
        if at == len(word):
            yield ()
        for size in range(1, len(word) - at + 1):
            k = VOCABULARY.get(("▁" if at == 0 else "") + word[at : at + size], len(VOCABULARY) if size == 1 else None)
            if k is not None:
                yield from ((k, *rest) for rest in cut_up(word, at + size))

    p = np.full(len(VOCABULARY) + 1, 1 / (len(VOCABULARY) + 1))
    for _ in range(rounds):
        expected = np.full(len(p), smooth)
        for word, n in counts:
            ways = list(cut_up(word))
            chance = np.array([np.prod(p[list(w)]) for w in ways])
            for w, c in zip(ways, chance / chance.sum(), strict=True):
                np.add.at(expected, list(w), n * c)
        p = expected / expected.sum()
    return np.log(p)


def test_fitting_equals_listing_all_segmentations():
    counts = [("abab", 5), ("ab", 9), ("ba", 2), ("bcab", 1), ("c", 3), ("babbab", 2)]
    assert np.allclose(fit(counts, 3, 0.05).logp[:, 0], plain_fit(counts, 3, 0.05), atol=1e-5)


def test_predictions_equal_plain_posteriors(spark):
    p = np.random.default_rng(5).dirichlet(np.ones(len(VOCABULARY) + 1), 3).T
    model = Model(["p", "q", "r"], VOCABULARY, np.log(p))
    texts = ["ab ba, Bab!", "a", "ccc abab", "ab ab ab ab", "ABBA abc"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in frame.select("doc_id", predict(F.col("text"), model).alias("p")).collect():
        words = letter_words(texts[r.doc_id])
        like = np.array([np.prod([plain_score(w, p[:, k]) for w in words]) for k in range(3)])
        assert r.p.lang == model.langs[like.argmax()] and r.p.score == pytest.approx(like.max() / like.sum())


def test_ties_repeated_rows_and_broken_text(spark):
    p = np.repeat(np.random.default_rng(6).dirichlet(np.ones(len(VOCABULARY) + 1), 1).T, 2, axis=1)
    rows = spark.createDataFrame([(1, "ab"), (1, "ab"), (2, "ba")], "doc_id long, text string")
    got = [(r.doc_id, r.p.lang, r.p.score) for r in rows.select("doc_id", predict(F.col("text"), Model(["p", "q"], VOCABULARY, np.log(p))).alias("p")).collect()]
    assert got == [(1, "p", 0.5), (1, "p", 0.5), (2, "p", 0.5)]
    broken = spark.sql("select 1L as doc_id, cast(unhex('ff61ff') as string) as text, 'x' as lang")
    model = train(broken)
    assert [r.p.lang for r in broken.select(predict(F.col("text"), model).alias("p")).collect()] == ["x"]
    assert train(broken.where("false")) is None and broken.where("false").select(predict(F.col("text"), model)).collect() == []


def test_teaching_is_bounded(spark):
    rows = [(i, "ab " * 10, f"l{i % 5}") for i in range(50)] + [(100, "ab " * 9000, "l0"), (101, "½ Ⅷ 12", "none")]
    frame = spark.createDataFrame(rows, SCHEMA)
    few = li.sample_words(frame, "text", "lang", "doc_id", 400, 3000).groupBy("lang").agg(F.sum("n")).collect()
    assert {r[0]: r[1] for r in few} == {f"l{k}": 100 + (125 if k == 0 else 0) for k in range(5)}  # of the long text, 375 code points
    assert train(frame).langs == [f"l{k}" for k in range(5)]


def test_every_language_is_learnt(spark):
    """Seventy of them, one with nothing but a long text."""
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)} " * 5, f"l{i}") for i in range(70)] + [(200, "qqq zzz " * 300_000, "long")]
    frame = spark.createDataFrame(rows, SCHEMA)
    model = train(frame)
    assert model.langs == sorted([f"l{i}" for i in range(70)] + ["long"])
    assert [r.p.lang for r in frame.where("doc_id = 200").select(predict(F.col("text"), model).alias("p")).collect()] == ["long"]


def test_fitting_raises_the_likelihood():
    counts = [("abab", 5), ("ab", 9), ("ba", 2), ("bcab", 1)]
    scores = []
    for rounds in (1, 3, 8):
        scores.append(float(fit(counts, rounds, 1e-9).word_scores([w for w, _ in counts])[:, 0] @ [n for _, n in counts]))
    assert scores == sorted(scores)


def made(n, seed):
    rng = random.Random(seed)
    parts = {"one": ["tion", "ing", "th", "er", "and"], "two": ["ung", "keit", "sch", "ei", "und"], "three": ["eau", "oui", "ment", "aux", "le"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))).title() for _ in range(rng.randrange(3, 30))) + ".", lang))
    return rows


def predicted(spark, rows, model):
    docs = spark.createDataFrame([(i, t, lang, "q", 1.0) for i, t, lang in rows], SCHEMA + ", score string, p double")
    return docs.select("doc_id", predict(F.col("text"), model).alias("__p")).select("doc_id", "__p.*").collect()


def test_held_out_accuracy(spark):
    rows = made(400, 1)
    model = train(spark.createDataFrame(rows[:300] + [(900, None, "one"), (901, "xyz", None)], SCHEMA), per_lang=40)
    assert model.langs == ["one", "three", "two"]
    got = {r.doc_id: r.lang for r in predicted(spark, rows[300:], model)}
    assert sum(got[i] == lang for i, _, lang in rows[300:]) >= 98


def test_edges(spark, monkeypatch):
    rows = made(60, 2)
    model = train(spark.createDataFrame(rows, SCHEMA))
    odd = [(1, None, ""), (2, "", ""), (3, "123 !! ___ \n", ""), (4, "und" * 3000, ""), (5, "THE AND " * 20_000, ""), (6, "日本 語", "")]
    got = {r.doc_id: (r.lang, r.score) for r in predicted(spark, odd, model)}
    assert [got[i] for i in (1, 2, 3)] == [(UNKNOWN, 0.0)] * 3
    assert all(got[i][0] in model.langs and 0 < got[i][1] <= 1 for i in (4, 5, 6))
    assert predicted(spark, [], model) == []
    assert [r.lang for r in predicted(spark, rows[:2], None)] == [UNKNOWN] * 2
    assert train(spark.createDataFrame([], SCHEMA)) is None


def test_scores_do_not_depend_on_what_is_remembered(spark, monkeypatch):
    rows = made(80, 3)
    model = train(spark.createDataFrame(rows, SCHEMA))
    monkeypatch.setattr(li, "CACHE", 5)
    scorer = li.Scorer(model)
    for _, text, _ in rows[:20] * 2:
        words = list(dict.fromkeys(letter_words(text)))
        assert np.allclose(scorer(words), model.word_scores(words))
    long = "ab" * 40
    assert np.allclose(scorer([long])[0], model.word_scores(letter_words(long)).sum(axis=0))


def test_long_pieces_are_looked_up():
    """The vocabulary's longest pieces count in a word's score."""
    known = li.read_vocabulary(li.default_vocabulary())
    longest = max(known, key=lambda p: (len(p.lstrip("▁")), p))
    assert len(longest.lstrip("▁")) > 8 and all(p in known for p in ("▁understanding", "▁international"))
    vocabulary = {p: i for i, p in enumerate(["▁a", "b", "c", "▁abcabcabcabc", "abcabcabca"])}
    p = np.array([[0.1], [0.1], [0.1], [0.3], [0.2], [0.2]])  # the last: an unknown letter
    got = Model(["x"], vocabulary, np.log(p)).word_scores(["abcabcabcabc", "babcabcabca"])
    assert np.allclose(np.exp(got[:, 0]), [0.3, 0.2 * 0.2], rtol=1e-3)


def test_unknown_language_column(spark):
    with pytest.raises(Exception):
        train(spark.createDataFrame([(1, "a")], "doc_id long, text string"), lang_col="lang")


def test_words_are_runs_of_letters_of_any_length(spark):
    rows = [(1, "a" * 60, "x"), (2, "It's 3pm, ÀB_c ½Ⅷ", "x"), (3, "--- 12", "x")]
    found = li.sample_words(spark.createDataFrame(rows, SCHEMA), "text", "lang", "doc_id", 400, 3000).collect()
    assert sorted(r["word"] for r in found) == sorted(["a" * 60, "it", "s", "pm", "àb", "c"])
