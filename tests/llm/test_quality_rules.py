import random
import re
from collections import Counter

from weftline.llm import quality_rules as qr

SCHEMA = "doc_id long, text string, source string"


def plain(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by loops."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(1)
    made = [None, "", " \t\r\n\x0b\x0c", "a", "é\xa0b c d", "x\x1cy z", "\n\n", "a\na\n a\na", "#*$%&|<> &&", "w " * 7, "w " * 8, "w " * 9, "w " * 500]
    made += [" ".join(f"w{rng.randrange(n)}" for _ in range(m)) for n in (1, 2, 3, 50) for m in (8, 9, 16, 17, 40, 200)]
    made += ["\n".join(rng.choice(["one two", "", " ", "three four five six seven eight nine ten"]) for _ in range(30)) for _ in range(5)]
    return made


def test_measures_equal_loops(spark):
    rows = [(i, t, "s") for i, t in enumerate(texts())]
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA + ", w string, n_words int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in qr.measures(docs).collect()}
    assert got == {i: plain(t) for i, t, _ in rows}


def good(i):
    return " ".join(f"g{(i * 7 + k) % 1000}" for k in range(30))


def test_bad_hosts_lose_their_documents(spark):
    rows = [(i, good(i), f"h{i % 10}") for i in range(400)]
    rows += [(1000 + i, "too short", "bad") for i in range(45)] + [(2000 + i, good(i), "bad") for i in range(5)]
    rows += [(3000, "too short", "h1"), (3001, good(1), None), (3002, good(2), "one")]
    got = {r.doc_id: r for r in qr.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].kept and not got[i].host_rejected for i in range(400))
    assert all(got[1000 + i].base_failed and not got[1000 + i].kept for i in range(45))
    assert all(not got[2000 + i].base_failed and got[2000 + i].host_rejected and not got[2000 + i].kept for i in range(5))
    assert got[3000].base_failed and not got[3000].host_rejected and got[3001].kept and got[3002].kept


def plain_verdicts(data, max_rate=0.5, deviations=1.5):
    """Who is kept, by loops: measures, rates per host, the method of moments, and verdicts."""
    fails = {}
    for i, t, h in data:
        n, _, symbols, dup, repeat = plain(t)
        lines = sum(1 for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
        fails[i] = (h, [n < 20, 100 * repeat > 30 * n, 10 * symbols > n, 10 * dup > 3 * lines])
    hosts = Counter(h for h, _ in fails.values())
    total, over, suspect = len(fails), set(), set()
    for r in range(4):
        f = Counter(h for h, x in fails.values() if x[r])
        mean = sum(f.values()) / total
        v = sum(f[h] ** 2 / n for h, n in hosts.items()) / total - mean * mean - mean * (1 - mean) * len(hosts) / total
        for h, n in hosts.items():
            if v > 1e-12:
                s = mean * (1 - mean) / v - 1
                rate = (f[h] + mean * s) / (n + s)
                low = rate - deviations * (max(rate * (1 - rate), 0) / (n + s + 1)) ** 0.5
                suspect |= {(h, r)} if low > mean else set()
            else:
                low = mean
            over |= {h} if low > max_rate else set()
    return {i for i, (h, x) in fails.items() if not x[0] and not x[1] and h not in over and not any(x[r] and (h, r) in suspect for r in range(4))}


def test_verdicts_equal_loops(spark):
    """Hosts that differ: one that is bad throughout, one whose symbols are suspect, small ones, and the rest."""
    rng = random.Random(2)
    rows = [(i, good(i) + " ###" * (4 if rng.random() < (0.6 if i % 10 == 3 else 0.05) else 0), f"h{i % 10}") for i in range(500)]
    rows += [(1000 + i, "too short" if rng.random() < 0.9 else good(i), "bad") for i in range(60)] + [(2000, "too short", "tiny"), (2001, good(1) + " ####", None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", host int, `host.rate` int")
    got = qr.judge(docs).collect()
    assert {r.doc_id for r in got if r.kept} == plain_verdicts(rows)
    assert any(r.host_rejected for r in got) and any(r.host_failed and not r.base_failed for r in got)
    assert all(r.kept for r in got if r.host == "h1" and not r.base_failed)


def test_hosts_that_do_not_differ_condemn_nothing(spark):
    rows = [(i, good(i) + (" ####" if i // 10 == 3 else ""), f"h{i % 10}") for i in range(400)]
    got = qr.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.kept for r in got) and len({r.host_rate for r in got}) == 1


def test_long_texts_and_odd_names(spark):
    long = " ".join(f"w{k % 9999}" for k in range(120_000))
    docs = spark.createDataFrame([(1, long, "a", 5)], "`i.d` long, `te``xt` string, `h.o` string, n int")
    r = qr.judge(docs, "i.d", "te`xt", "h.o").first()
    assert (r.doc_id, r.n_words, r.n_repeat_words) == (1, 120_000, plain(long)[4])


def test_a_single_failure_does_not_condemn_a_small_host(spark):
    rows = [(i, good(i), f"h{i % 10}") for i in range(400)] + [(999, "too short", "tiny"), (998, good(5), "tiny")]
    got = {r.doc_id: r for r in qr.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not got[999].host_rejected and got[999].base_failed and got[998].kept


def test_empty_table_and_repeated_rows(spark):
    assert qr.judge(spark.createDataFrame([], SCHEMA)).collect() == []
    got = qr.judge(spark.createDataFrame([(1, good(1), "a"), (1, good(1), "a"), (None, None, None)], SCHEMA)).collect()
    assert len(got) == 3 and sum(r.kept for r in got) == 2
