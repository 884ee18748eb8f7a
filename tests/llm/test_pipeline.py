import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from verbatrix.llm import registry

SF = "/root/testdata/sf0.001"


def norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = registry.queries()[name](spark, SF)
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    assert sorted(tuple(norm(r[c]) for c in sorted(names)) for r in df.collect()) == want


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start, columns = docs, docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] > counts[3] > 0
    ids = {r.doc_id for r in start.select("doc_id").collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} <= ids and {r.doc_id for r in packed} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_edge_cases(spark, tmp_path):
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, shard int"
    english = "the quick brown fox and the lazy dog went over the hills with some other words number "
    rows = [(i, english + str(i) * 3 + " " + " ".join(f"w{i}x{j}" for j in range(30)), "en", "a", 1, "k", 1) for i in range(1, 13)]
    rows += [rows[0], rows[0], (20, None, "en", "a", 1, None, None), (21, "", "en", "a", 0, "k", 1), (None, rows[3][1], None, None, None, "k", 1), (22, english * 3000, None, None, None, None, None), (23, "1 2 3", "en", "b", 5, "k", 2)]
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "some/documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    ids = {r.doc_id for r in out}
    assert not ids & {20, 21, 23} and ids <= {*range(1, 13), 22, None}
    assert all(r.window is not None and r.n_tokens > 0 for r in out)
    spark.createDataFrame([], kinds).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_entry_has_every_query():
    names = set(__spark_entry__.queries())
    assert {"pipeline", *registry.queries()} <= names and set(__spark_entry__.oracle_sql()) <= names
