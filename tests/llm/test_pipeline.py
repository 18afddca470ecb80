import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_near_dup import brute as plain_groups
from tests.llm.test_packing import check, ids
from weftline.llm import language_id
from weftline.llm.source_mixing import mixture

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(11)
    parts = {"one": ["tion", "ing", "th", "er", "and"], "two": ["ung", "keit", "sch", "ei", "und"]}
    rows = []
    for i in range(160):
        lang = rng.choice(list(parts))
        lines = [" ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(4, 12))) for _ in range(rng.randrange(2, 8))]
        source = rng.choices(["a", "b", "c"], [6, 2, 1])[0]
        if source == "a" and i % 2:
            lines.insert(1, "erthing anding tion home")
        text = "\n".join(lines)
        rows.append((i, text, lang, source, len(text)))
    for k in range(20):  # copies and near copies
        i, text, lang, source, n = rows[k]
        text = text if k % 2 else text + " er"
        rows.append((1000 + k, text, lang, source, len(text)))
    return rows + [(2000, None, "one", "a", 0), (2001, "123 ...", "one", "b", 7), (2002, "", None, "c", 0)]


@pytest.fixture(scope="module")
def stages(spark):
    """The documents after each stage, as the pipeline passes them on."""
    docs = spark.createDataFrame(documents(), SCHEMA)
    out = [docs.toPandas()]
    for _, stage in cp.STAGES:
        frame = stage(spark, docs, "").toPandas()
        out.append(frame)
        if list(frame.columns) == docs.columns:
            docs = spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in frame.itertuples(index=False)], SCHEMA)
    return out


def triples(frame):
    return [(r.doc_id, r.text, r.source) for r in frame.itertuples()]


def test_columns_stay(stages):
    assert all(list(f.columns) == [c.split()[0] for c in SCHEMA.split(", ")] for f in stages[:-1])


def test_language_stage(stages):
    lost = set(stages[0].doc_id) - set(stages[1].doc_id)
    assert lost == {2000, 2001, 2002}
    merged = stages[1].merge(stages[0], on="doc_id")
    assert (merged.text_x == merged.text_y).all() and (merged.lang_x == merged.lang_y).mean() > 0.97


def test_line_stage(stages):
    assert Counter(triples(stages[2])) == Counter(plain_lines(triples(stages[1]), once=True, spare=True))
    assert (stages[2].n_chars == stages[2].text.str.len()).all()
    assert stages[2].text.str.contains("erthing anding tion home").sum() < stages[1].text.str.contains("erthing anding tion home").sum()


def test_near_duplicate_stage(stages):
    kept = {i for i, _, _, k in plain_groups([(i, t) for i, t, _ in triples(stages[2])]) if k}
    assert set(stages[3].doc_id) == kept and len(stages[3]) == len(kept) < len(stages[2])


def test_mixing_stage(spark, stages):
    docs = spark.createDataFrame([tuple(r) for r in stages[3].itertuples(index=False)], SCHEMA)
    copies = {r.doc_id: r.copies for r in mixture(docs, cp.MIX).collect()}
    assert Counter(stages[4].doc_id) == Counter(copies) and min(copies.values()) == 1 and max(copies.values()) == 2


def test_packing_stage(stages):
    check(triples(stages[4]), list(stages[5].itertuples()), 4096)
    assert stages[5].length.sum() == sum(len(ids(t)) for t in stages[4].text)


def test_run_equals_the_stages(spark, stages, tmp_path):
    spark.createDataFrame(documents(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = cp.run(spark, str(tmp_path)).toPandas()
    assert Counter(zip(got.doc_id, got.doc_tokens)).keys() == Counter(zip(stages[5].doc_id, stages[5].doc_tokens)).keys()
    assert got.length.sum() == stages[5].length.sum()


ODD = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `__flags` int, row string, found string"


def staged(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], ODD)
    for _, stage in cp.STAGES[:-1]:
        before, docs = docs.columns, cp.cut(stage(spark, docs, ""))
        assert docs.columns == before
    return docs, cp.STAGES[-1][1](spark, docs, "").collect()


def test_stages_with_odd_rows_and_names(spark):
    """Nulls anywhere, empty and very long texts, repeated rows and clashing names, through all stages."""
    long = " ".join(f"thing{k % 5000}er" for k in range(60_000))
    rows = documents() + [(3000, long, "one", None, None), (None, "erthing anding tion", None, None, None), (3001, "a" * 50_000, "one", "a", 1), *documents()[:3] * 2]
    docs, packed = staged(spark, rows)
    left = docs.toPandas()
    assert {3000}.issubset(left.doc_id.dropna().astype(int)) and (left["a.b"] == "x").all() and (left["row"] == "y").all()
    assert left.doc_id.value_counts().max() <= 2 and sum(r.length for r in packed) == sum(len(ids(t)) for t in left.text)


def test_stages_of_an_empty_table(spark):
    docs, packed = staged(spark, [])
    assert docs.collect() == packed == []


def test_held_out_documents_teach_nothing(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    seen = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    assert language_id.train(seen).langs == ["one", "two"]
