import random
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import packing
from weftline.llm.packing import Encoder, default_tokenizer, pack, round_robin, sequences, windows

ENCODER = Encoder(default_tokenizer())
TOKENIZER = Tokenizer.from_file(default_tokenizer())


def ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


HARD = ["Foo, bar! İ. Straße, àé. a.. b,. c!x d$% e && |. 'S. o's! ' 9. x9,", "it's I'M ....", "<|endoftext|> x <|ENDOFTEXT|>, y", None, "", " \n\x0b", "ábc. 가 क़. \xa0x\x85y\x1cz", "ÀÉ ÿ, ÷. ß!", "x" * 5000 + " end", "THE THE!! THE,"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_encoder_equals_the_tokenizer(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + HARD
    got = ENCODER(pa.array(texts, pa.string()))
    assert [x.tolist() for x in got] == [ids(t)[:-1] for t in texts]


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 700)
    own = Encoder(default_tokenizer())
    for _ in range(3):
        for texts in (["one two three four five"], ["six one two"], ["seven, eight, one"]):
            assert [x.tolist() for x in own(pa.array(texts))] == [ids(t)[:-1] for t in texts]


def check(rows, got, length):
    """Every id in one piece, sequences gapless, no sequence longer than length or in need of padding but full."""
    by_doc = {}
    for r in got:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    want = {}
    for i, t, _ in rows:
        want.setdefault((i, len(ids(t))), []).append(ids(t))
    assert by_doc.keys() == want.keys()
    for key, texts in want.items():
        pieces = sorted(by_doc[key], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for r in pieces:
                assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(texts[0][at : at + r.length], "<u4").tobytes())
                at += r.length
    per = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert per.get(r.sequence_id, 0) == r.offset and r.length > 0
        per[r.sequence_id] = r.offset + r.length
    assert all(n == length or n < length and n & (n - 1) == 0 for n in per.values())


def test_round_trip(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "of", "thwhing,", "É.", "x9"]) for _ in range(rng.choice([1, 5, 50, 400, 3000]))), rng.choice(["a", "a", "b", None])) for i in range(80)]
    rows += [(100, None, "a"), (101, "", None), (102, "same text", "b"), (102, "same text", "b")]
    docs = spark.createDataFrame([(t, i, s, 1, 2) for i, t, s in rows], "text string, doc_id long, source string, start int, shard int")
    packed = pack(docs, shard_tokens=5000, length=512)
    check(rows, packed.collect(), 512)
    assert all(r.padding == 0 for r in sequences(packed, 512).collect())


def test_copies_do_not_lie_by_each_other(spark):
    rows = [(i, f"text number {i} of sixty", "ab"[i % 2]) for i in range(60)] * 2
    got = sorted(pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), least=1).collect(), key=lambda r: (r.sequence_id, r.offset))
    docs = [r.doc_id for r in got if r.start == 0]
    assert len(docs) == 120 and all(a != b for a, b in zip(docs, docs[1:]))
    assert len(set(docs[:60])) >= 58  # a round over the shard before the next one


def test_rounds():
    seen = packing.rounds([1, 1, 1, 2, 2], [4, 2, 9, 1, 7])
    assert sorted(seen) == list(range(5)) and [[1, 1, 1, 2, 2][i] for i in seen[:2]] in ([1, 2], [2, 1])


def test_equal_rows_spread_over_shards(spark):
    docs = spark.createDataFrame([(7, "the of and to in " * 40, "a")] * 600, "doc_id long, text string, source string")
    got = pack(docs, shard_tokens=10_000, length=1024).groupBy((F.col("sequence_id") / (1 << 32)).cast("long").alias("shard")).agg(F.sum("length").alias("n")).collect()
    assert len(got) >= 10 and max(r.n for r in got) < 3 * sum(r.n for r in got) / len(got)


def test_odd_names_and_broken_text(spark):
    docs = spark.sql("select 1L as `i.d`, cast(unhex('61ff62') as string) as `te``xt`, cast(null as string) as `s.c`, 2 as doc_id, 3 as shard")
    got = pack(docs, "i.d", "te`xt", "s.c").collect()
    assert sum(r.length for r in got) == len(ids("a\ufffdb"))


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_length_is_a_power_of_two(spark):
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([], "doc_id long, text string, source string"), length=1000)


def test_windows():
    assert list(windows(8, 4)) == [4, 4] and list(windows(11, 4)) == [4, 4, 2, 1] and list(windows(0, 4)) == []


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcd"), st.lists(st.integers(1, 90), min_size=1, max_size=12), min_size=1), st.integers(1, 30))
def test_every_window_follows_the_shares(sizes, least):
    total = sum(map(sum, sizes.values()))
    share = {s: sum(x) / total for s, x in sizes.items()}
    queues = {s: deque((f"{s}{i}", n) for i, n in enumerate(x)) for s, x in sizes.items()}
    deficit = dict.fromkeys(sizes, 0.0)
    served, filled, seen = dict.fromkeys(sizes, 0), 0, {}
    for doc, start, n, _, _ in round_robin(queues, share, deficit, 32, least):
        assert seen.get(doc, 0) == start
        seen[doc] = start + n
        served[doc[0]] += n
        filled += n
        for s in sizes:  # no source runs ahead of its share by more than a window and two pieces
            assert served[s] - share[s] * filled <= 32 + 2 * least + 1
    assert seen == {f"{s}{i}": n for s, x in sizes.items() for i, n in enumerate(x)}
    assert all(abs(d) < 1e-6 for d in deficit.values())


def test_weights_order_the_service(spark):
    text = "the of and " * 300
    docs = spark.createDataFrame([(i, text, "a" if i % 2 else "b") for i in range(40)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")
    got = pack(docs, weights=weights, length=512, least=64).collect()
    first = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    half = [r for r in first if r.sequence_id < 30]
    a = sum(r.length for r in half if r.source == "a") / sum(r.length for r in half)
    assert 0.7 < a < 0.8


def test_deficits_are_carried_over_all_shards(spark, monkeypatch):
    """Opening deficits do not depend on how many shards a range of the prefix sum has."""
    rng = random.Random(8)
    rows = [(i, "the of and " * rng.randrange(1, 200), rng.choice(["a", "a", "b", None])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = []
    for lane in (1024, 1, 3):
        monkeypatch.setattr(packing, "LANE", lane)
        got.append(sorted(map(tuple, pack(docs, shard_tokens=3000, length=512).collect()), key=str))
    assert got[0] == got[1] == got[2]
