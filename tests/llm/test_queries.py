"""The registered queries against their SQL, or their contracts, on the driver's small tables."""

import hashlib
import zlib
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from weftline.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(None if pd.isna(v) else round(v, 6) if isinstance(v, float) else v for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_language_id_is_right_on_held_out_documents(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet")[["doc_id", "lang"]]
    got = QUERIES["op3_language_id"](spark, DATA).toPandas().merge(docs, on="doc_id")
    assert len(got) == len(docs) and (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def test_importance_prefers_good_documents(spark):
    labels = pd.read_parquet(f"{DATA}/labels.parquet")
    got = QUERIES["op6_importance"](spark, DATA).toPandas().merge(labels, on="doc_id")
    assert got[got.quality == 1].kept.mean() > 0.85 and got[got.quality == 0].kept.mean() < 0.4


def test_media_keeps_texts(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    got = QUERIES["op8_media"](spark, DATA).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text):
        raw = t.encode()
        padded = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert (got.n_bytes[i], got.payload_sha256[i]) == (len(raw), hashlib.sha256(padded).hexdigest())


def test_packing_covers_all_tokens(spark):
    got = QUERIES["op9_packing"](spark, DATA).toPandas()
    per = got.groupby("doc_id").agg(n=("length", "sum"), want=("doc_tokens", "first"))
    assert (per.n == per.want).all() and len(per) == len(pd.read_parquet(f"{DATA}/documents.parquet"))
    full = got.groupby("sequence_id").length.sum()
    assert ((full == 4096) | ((full & (full - 1)) == 0)).all()
