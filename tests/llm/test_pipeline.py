import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from strandspark.llm.oracles import SQL
from strandspark.llm.queries import QUERIES

COLS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select(COLS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    r = con.execute(SQL[name])
    names = [d[0] for d in r.description]
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, (tuple(x) for x in got.select(names).collect()))) == sorted(map(str, r.fetchall()))


def test_toxic_stage(spark, sf, docs):
    out = C.drop_toxic(spark, docs, sf)
    assert out.columns == COLS
    insult = lambda t: len(re.findall(r"\b(?:idiot|moron|scum|loser|clown|stupid|pathetic|worthless|trash|disgusting)\b", t.lower())) >= 2
    texts = {r.doc_id: r.text for r in docs.collect()}
    left = {r.doc_id for r in out.collect()}
    assert {d for d, t in texts.items() if insult(t)}.isdisjoint(left) or len(texts) == len(left)


def test_copies_stage(spark, sf, docs):
    both = docs.unionByName(docs.where("doc_id < 5")).unionByName(docs.where("doc_id < 9").withColumns({"doc_id": F.col("doc_id") + 100_000, "text": F.upper("text")}))
    out = C.drop_copies(spark, both, sf)
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    best = {}
    for r in both.collect():
        best[low(r.text)] = max(best.get(low(r.text), -1), r.doc_id)
    assert out.columns == COLS and sorted(r.doc_id for r in out.collect()) == sorted(best.values())


def test_near_copies_stage(spark, sf):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base, "en", "s", 1), (2, base.replace("w30", "x"), "en", "s", 1), (3, "all else", "en", "s", 1), (4, None, "en", "s", 1), (5, "", "en", "s", 1), (None, base, "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = C.drop_near_copies(spark, df, sf)
    assert out.columns == COLS and sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "4", "5", "None"]


def test_mask_stage(spark, sf, docs):
    out = C.mask_personal_data(spark, docs, sf)
    assert out.columns == COLS and out.count() == docs.count()
    assert out.where(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9]+")).count() == 0 and out.where("n_chars <> length(text)").count() == 0


def test_run(spark, sf, docs):
    out = C.run(spark, sf)
    assert 0 < out.select("doc_id").distinct().count() <= docs.count() and {"bin_id", "capacity", "offset"} <= set(out.columns)


def test_stages_on_empty_tables(spark, sf, docs):
    none = docs.limit(0)
    for name, stage in C.STAGES:
        assert stage(spark, none, sf).count() == 0, name
