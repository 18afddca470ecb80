import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from weftline.llm import prefix_trie
from weftline.llm.prefix_trie import turns_of

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows, group, most):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        out[c] = own.get(c - int(math.fmod(c, group)), [])[:h] + turns[h:]
    return out


def brute(rows, group=1, most=1):
    convs = rebuilt(rows, group, most)
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        d = len(key)
        below = [k for k in nodes if k[:d] == key]
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == d)
        parent = min(nodes[key[:-1]]) if key else None
        children = lambda k: sum(1 for x in nodes if len(x) == len(k) + 1 and x[: len(k)] == k)
        saved = sum((len(nodes[k]) - 1) * (len(k[-1][1].encode().split()) if k else 0) for k in below)
        out.append((min(members), d, parent, len(members), children(key), sum(1 for k in below if not children(k)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def got(df, group=1, most=1):
    rows = prefix_trie.prefix_trie(turns_of(df, group, most)).collect()
    return sorted((tuple(r) for r in rows), key=lambda r: r[:2])


def test_equals_brute_force_on_odd_rows(spark):
    rng = random.Random(3)
    texts = ["a", "b c", "", None, "a\x0bb c", "ñ " * 50]
    rows = [(c, rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", None, ""]), rng.choice(texts)) for c in range(45) for _ in range(rng.randrange(6))]
    rows += [(None, 0, "user", "x"), (100, 0, "user", "a"), (-3, 1, "user", "b c"), (-3, 1, "user", "b c")]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.withColumn("digest", F.lit(1)).withColumn("d", F.lit(2)).withColumn("rep", F.lit("x"))
    assert got(clash, 20, 4) == brute(rows, 20, 4)
    assert got(df) == brute(rows)


def test_copies_and_a_long_shared_prefix(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = [(c, t, "user", f"hello {t}") for c in range(40) for t in range(3)]
    rows += [(c, t, "user", f"deep words {t}" if t < 9 else f"{c}") for c in (50, 51, 52) for t in range(11)]
    rows += [(60 + k, t, "user", f"hello {t}") for k in range(3) for t in range(k)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")]])
def test_no_conversations(spark, rows):
    assert got(spark.createDataFrame(rows, SCHEMA)) == []


def test_one_class_and_turnless_conversations(spark):
    rows = [(c, t, "user", "two words") for c in (4, 7) for t in range(2)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)  # no conversation to begin with, and all its turns replaced
    rows = [(c, 0, "user", "gone")]
    assert got(spark.createDataFrame(rows, SCHEMA), 20, 4) == brute(rows, 20, 4) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
