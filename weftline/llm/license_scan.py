"""License texts in documents, by MinHash bands over overlapping text windows.

Texts become lower-case letter and digit words and their 5-word shingle
hashes. Template lengths (in shingles) are rounded up to a class M, of which
one is at most a quarter longer than the one before. For every class a text is
cut into windows of 2M shingles that overlap by M, so a template of the class
lies whole in some window, wherever it begins. A window's MinHash bands (one
minimum each) that equal a template's retrieve it. A window that holds 80 % of
a template has a Jaccard similarity of 0.29 or more with it, at which 40 bands
collide with a probability of 0.999998. Candidates are verified by the exact
share of the template's distinct shingles in the window.

A band of a window can equal a template's only if the window holds the very
shingle that is the template's minimum in that band. So the bands are first
sought from the template's side: the texts' shingles are looked up in a hash
set of the templates' minima, and only windows that hold one get bands. That
loses no collision.

Notices of fewer than five words have no such shingle. Each is one shingle of
all its words instead, whose window is as long as itself: two sets of one
shingle collide in all bands if they are equal and else in none, so the lookup
of that shingle is retrieval and verification in one.

Templates may be any number. Their shingles and bands are tables that are
joined by hash; a plan holds only the 40 minima of each as literals, and a
batch of bounded size is one pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import cut, named, paired, shifted
from weftline.llm.license_texts import NOTICES, TEMPLATES

BANDS, SHINGLE = 40, 5
#: Templates, and shingles of theirs, that one pass over the texts seeks; they are broadcast (about 16 MB at most).
BATCH, BATCH_SHINGLES = 1000, 1 << 20

Template = tuple[str, str, str]


def window_class(shingles: int) -> int:
    """The least class that is not under a length."""
    size = 1
    while size < shingles:
        size = max(size + 1, size * 5 // 4)
    return size


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _with_shingles(df: DataFrame, text: str, out: str, short: set[int] = frozenset()) -> DataFrame:
    """Add out: hashes of the 5-word shingles, made of doubled-up hashes of 1, 2 and 4 words; and out_n: hashes of n words, for each n of short."""
    one, two, three, four = (f"{out}_{n}" for n in range(1, SHINGLE))
    df = df.withColumn(one, F.transform(_words(F.col(text)), lambda w: F.xxhash64(w)))
    df = df.withColumn(two, paired(F.col(one), shifted(F.col(one), 1)))
    if 3 in short:
        df = df.withColumn(three, paired(F.col(two), shifted(F.col(one), 2)))
    df = df.withColumn(four, paired(F.col(two), shifted(F.col(two), 2)))
    df = df.withColumn(out, paired(F.col(four), shifted(F.col(one), 4)))
    return df.drop(*(f"{out}_{n}" for n in range(1, SHINGLE) if n not in short))


def _table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table of literals."""
    made = F.array(*(F.struct(*(v.alias(n) if isinstance(v, Column) else F.lit(v).alias(n) for v, n in zip(r, names, strict=True))) for r in rows))
    return spark.range(1).select(F.inline(made))


def _least(shingles: Column, b: Column) -> Column:
    """The shingle that is the minimum in a band."""
    return F.array_min(F.transform(shingles, lambda h: F.struct(F.xxhash64(h, b).alias("x"), h.alias("h"))))["h"]


def _keys(shingles: Column, size: Column) -> Column:
    """One key for each band of a set: the band, the class, and the minimal shingle of the band."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, size, _least(shingles, b)))


def _hits(grams: str, known: list[int]) -> Column:
    """Where grams holds one of the known hashes, from a hash set of literals; null if nowhere."""
    inside = "h in (" + ",".join(f"{h}L" for h in sorted(set(known))) + ")"
    return F.expr(f"case when exists({grams}, h -> {inside}) then filter(transform({grams}, (h, i) -> case when {inside} then i end), i -> i is not null) end")


def _windows(hits: Column, shingles: Column, size: int) -> Column:
    """The windows of 2 * size shingles that hold one of the hits, as structs of size, start and hashes."""
    near = F.transform(hits, lambda p: F.array(p - p % size, F.greatest(p - p % size - size, F.lit(0))))
    inside = lambda start: F.slice(shingles, start + 1, F.lit(2 * size))
    return F.transform(F.array_distinct(F.flatten(near)), lambda start: F.struct(F.lit(size).alias("size"), start.alias("start"), inside(start).alias("w")))


def _class_of(shingles: Column, most: int) -> Column:
    """window_class() of a column, whose values are at most most."""
    sizes = [1]
    while sizes[-1] < most:
        sizes.append(window_class(sizes[-1] + 1))
    return F.array_min(F.filter(F.array(*map(F.lit, sizes)), lambda c: c >= shingles))


def template_table(spark: SparkSession, templates: list[Template]) -> tuple[DataFrame, list[dict]]:
    """A table (number, template, license, size, s, least, keys) of the templates, and of each its number, size, m and least.

    s: its distinct shingles, of which there are m; size: its class; least:
    its bands' minimal shingles; keys: its bands.
    """
    rows = spark.createDataFrame([(k, *t) for k, t in enumerate(templates)], "number int, template string, license string, text string")
    rows = _with_shingles(rows, "text", "s").select("number", "template", "license", F.size("s").alias("n"), F.array_distinct("s").alias("s"))
    longest = max((len(text) for _, _, text in templates), default=1)  # no text has more words than signs
    rows = rows.withColumn("size", _class_of(F.col("n"), longest))
    least = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: _least(F.col("s"), b)))
    table = cut(rows.select("number", "template", "license", "size", "s", F.when(F.col("n") > 0, least).alias("least"), F.when(F.col("n") > 0, _keys(F.col("s"), F.col("size"))).alias("keys")))
    known = [r.asDict() for r in table.select("number", "template", "size", F.size("s").alias("m"), "least").orderBy("number").collect()]
    if short := [t["template"] for t in known if not t["m"]]:
        raise ValueError(f"templates of fewer than {SHINGLE} words, which are notices: {short}")
    return table, known


def notice_table(spark: SparkSession, notices: list[Template]) -> list[tuple[str, str, int, int]]:
    """(id, license, words, hash of all words) of each notice."""
    if not notices:
        return []
    lengths = range(1, SHINGLE)
    rows = _table(spark, notices, ["template", "license", "text"]).withColumn("n", F.size(_words(F.col("text"))))
    rows = _with_shingles(rows, "text", "s", set(lengths))
    whole = F.coalesce(*(F.when(F.col("n") == n, F.get(f"s_{n}", F.lit(0))) for n in lengths))
    found = [tuple(r) for r in rows.select("template", "license", "n", whole).collect()]
    if wrong := [t for t, _, _, h in found if h is None]:
        raise ValueError(f"notices of no words or of {SHINGLE} and more, which are templates: {wrong}")
    return found


def _batches(known: list[dict]) -> Iterator[list[dict]]:
    batch, held = [], 0
    for t in known:
        if batch and (len(batch) >= BATCH or held + t["m"] > BATCH_SHINGLES):
            yield batch
            batch, held = [], 0
        batch.append(t)
        held += t["m"]
    if batch:
        yield batch


def _candidates(rows: DataFrame, known: list[dict], brief: list[tuple[str, str, int, int]]) -> DataFrame:
    """(doc_id, size, start, w): windows with a minimum of a template, and occurrences of notices as windows of size -n; one pass over the texts, written once."""
    lengths = sorted({n for _, _, n, _ in brief})
    rows = _with_shingles(rows, "text", "s", set(lengths))
    places = [_hits(f"s_{n}", [h for _, _, k, h in brief if k == n]).alias(f"hits_{n}") for n in lengths]
    rows = rows.select("doc_id", "s", *(f"s_{n}" for n in lengths), _hits("s", [h for t in known for h in t["least"]]).alias("hits"), *places)

    def of(size: int) -> Column:
        own = ",".join(f"{h}L" for h in sorted({h for t in known if t["size"] == size for h in t["least"]}))
        return _windows(F.expr(f"filter(hits, p -> s[p] in ({own}))"), F.col("s"), size)

    def whole(n: int) -> Column:
        return F.transform(f"hits_{n}", lambda p: F.struct(F.lit(-n).alias("size"), p.alias("start"), F.array(F.get(f"s_{n}", p)).alias("w")))

    long = F.when(F.col("hits").isNotNull(), F.flatten(F.array(*(of(size) for size in sorted({t["size"] for t in known})))))
    return cut(rows.select("doc_id", F.explode(F.flatten(F.array_compact(F.array(long, *map(whole, lengths))))).alias("x")).select("doc_id", "x.*"))


def _found_templates(windows: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """(doc_id, template, license, start, shared, m) for each of the windows with percent of a template of table, which is small enough to broadcast."""
    keyed = windows.where("size > 0").select("doc_id", "start", "w", _keys(F.col("w"), F.col("size")).alias("collided"))
    banded = keyed.select("doc_id", "start", "w", "collided", F.explode("collided").alias("key"))
    bands = table.select(F.col("number").alias("of"), F.explode(F.array_distinct("keys")).alias("t_key"))
    found = banded.join(F.broadcast(bands), F.col("key") == F.col("t_key")).join(F.broadcast(table), F.col("of") == F.col("number"))
    found = found.where(F.get(F.array_intersect("collided", "keys"), F.lit(0)) == F.col("key"))  # one of the bands that collide is enough
    found = found.select("doc_id", "template", "license", "start", F.size(F.array_intersect("w", "s")).alias("shared"), F.size("s").alias("m"))
    return found.where(100 * F.col("shared") >= percent * F.col("m"))


def _found_notices(windows: DataFrame, brief: list[tuple[str, str, int, int]]) -> DataFrame:
    """(doc_id, template, license, start, shared, m) for each occurrence of a notice."""
    table = _table(windows.sparkSession, [(t, lic, F.lit(-n), F.expr(f"{h}L")) for t, lic, n, h in brief], ["template", "license", "t_size", "t_h"])
    one = F.lit(1)
    found = windows.where("size < 0").join(F.broadcast(table), (F.col("size") == F.col("t_size")) & (F.get("w", F.lit(0)) == F.col("t_h")))
    return found.select("doc_id", "template", "license", "start", one.alias("shared"), one.alias("m"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[Template] | None = None, percent: int = 80, notices: list[Template] | None = None) -> DataFrame:
    """(doc_id, template, license, containment, first_word, windows): a row per document and template or notice found in it.

    templates have five words or more, notices fewer; templates of one's own
    come without NOTICES. containment: the largest share of the template's
    shingles in one window, 1 for a notice; first_word: where the first
    verified window begins, in words; windows of a notice are its occurrences.
    Null and empty texts match nothing; long ones are scanned whole; repeated
    rows of an id count as one document, as do rows without an id; templates
    that tie are all reported; an empty table gives an empty result. Other
    columns of docs are not read.
    """
    spark = docs.sparkSession
    table, known = template_table(spark, templates or TEMPLATES)
    brief = notice_table(spark, notices if notices is not None else [] if templates else NOTICES)
    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text")).where("text is not null")
    found = None
    for k, batch in enumerate(_batches(known)):
        windows = _candidates(rows, batch, brief if k == 0 else [])
        own = table.where(F.col("number").between(batch[0]["number"], batch[-1]["number"]))
        parts = [_found_templates(windows, own, percent), *([_found_notices(windows, brief)] if brief and k == 0 else [])]
        for part in parts:
            found = part if found is None else found.unionByName(part)
    out = found.groupBy("doc_id", "template", "license").agg((F.max("shared") / F.max("m")).alias("containment"), F.min("start").cast("long").alias("first_word"), F.count_distinct("start").alias("windows"))
    return out.select("doc_id", "template", "license", F.round("containment", 6).alias("containment"), "first_word", "windows")


def read_templates(spark: SparkSession, path: str) -> list[Template]:
    """The text files of a folder as templates, each whole and named after its file: license texts of one's own, of five words or more each."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), "value")
    return [(r["name"], r["name"].removesuffix(".txt"), r["value"]) for r in rows.orderBy("path").collect()]
