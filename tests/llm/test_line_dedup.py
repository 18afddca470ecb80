from collections import Counter, defaultdict

from weftline.llm.line_dedup import drop_boilerplate

SCHEMA = "doc_id long, text string, source string, n_chars long, host string, line string"


def words(line):
    return line.strip(" \t\n\r\x0b\x0c")


def plain(rows, ratio=0.05, least=2, once=False, spare=False):
    pages, held = defaultdict(set), defaultdict(set)
    for k, (_, text, host) in enumerate(rows):
        if text is not None:
            page = text if once else k
            pages[host].add(page)
            for line in text.split("\n"):
                if words(line):
                    held[host, line].add(page)
    bad = {(h, line) for (h, line), p in held.items() if len(p) >= least and len(p) > ratio * len(pages[h])}
    out = []
    for i, text, host in rows:
        if text is not None:
            left = [x for x in text.split("\n") if (host, x) not in bad]
            if not spare or any(map(words, left)):
                text = "\n".join(left)
        out.append((i, text, host))
    return out


def run(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, "a", "b") for r in rows], SCHEMA)
    got = drop_boilerplate(docs, **options)
    assert got.columns == docs.columns
    return [(r.doc_id, r.text, r.source) for r in got.collect()]


def rows():
    made = []
    for i in range(60):
        host = ["a", "b", None][i % 3]
        lines = [f"unique text number {i} with several words", "", " ", f"shared by few {i % 13}"]
        lines += ["menu | home | about"] * (host != "b") + ["cookies!"] * (i % 2)
        made.append((i, "\n".join(lines[i % 4 :] + lines[: i % 4]), host))
    made += [(100 + i, "copied page\nits second line", "a") for i in range(30)]
    return made + [(200, None, "a"), (201, "", "a"), (202, "menu | home | about", "a"), (203, "x" * 5000 + "\nmenu | home | about\r", "a"), (0, made[0][1], made[0][2])]


def test_equals_loops(spark):
    for ratio, least, once, spare in ((0.05, 2, False, False), (0.05, 2, True, True), (0.5, 2, True, False), (0.0, 1, False, True), (0.9, 3, False, False)):
        options = {"ratio": ratio, "least": least, "once": once, "spare": spare}
        assert Counter(run(spark, rows(), **options)) == Counter(plain(rows(), **options))


def test_copies_are_left_alone_if_asked_for(spark):
    got = {i: t for i, t, _ in run(spark, rows(), once=True, spare=True)}
    assert all(got[100 + i] == "copied page\nits second line" for i in range(30))
    assert "menu" not in got[9] and got[202] == "menu | home | about"
    got = {i: t for i, t, _ in run(spark, rows())}
    assert all(got[100 + i] == "" for i in range(30)) and got[202] == ""


def test_the_divisor_is_the_hosts_page_total(spark):
    """20 pages, the line on 2 of them: 10 %; with 40 more pages 3.3 %."""
    made = [(i, f"page {i}" + ("\nsame" if i < 2 else ""), "a") for i in range(20)]
    assert not any("same" in t for _, t, _ in run(spark, made))
    assert sum("same" in t for _, t, _ in run(spark, made + [(i, f"page {i}", "a") for i in range(20, 60)])) == 2


def test_odd_names(spark):
    docs = spark.createDataFrame([(i, f"own {i}\nmenu", "a", i, "f", f"b{i}") for i in range(3)], "`a.b` int, text string, source string, `__bad` int, flags string, `x``y` string")
    got = drop_boilerplate(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(i, f"own {i}", "a", i, "f", f"b{i}") for i in range(3)]
    renamed = docs.withColumnsRenamed({"text": "t.x", "source": "h.y"})
    assert sorted(r[1] for r in drop_boilerplate(renamed, "t.x", "h.y").collect()) == [f"own {i}" for i in range(3)]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_short_pages_lose_their_boilerplate(spark):
    """Header, menu and footer fill most of every page, and go; a page of nothing else stays if that is asked for."""
    shared = ["The long name of the site and its motto", "home | news | shop | about us | contact", "All about us, our terms and our cookies"]
    made = [(i, "\n".join([*shared[:2], f"item {i}", "", shared[2]]), "a") for i in range(40)]
    made += [(50, "\n".join(shared), "a"), (51, "\n".join([*shared, " "]), "a"), (52, "\n".join(shared), "b")]
    got = {i: t for i, t, _ in run(spark, made, spare=True)}
    assert all(got[i] == f"item {i}\n" for i in range(40))
    assert all(got[i] == t for i, t, _ in made[40:])
