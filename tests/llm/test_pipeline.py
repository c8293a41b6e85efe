"""The registered queries and the pipeline's stages on the smallest tables."""

import os
import sys
from collections import Counter

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import corpus_pipeline  # noqa: E402
from check import TABLES, compare  # noqa: E402
from tonegrid.llm import near_join, queries, secret_scan  # noqa: E402
from tonegrid.llm.common import table  # noqa: E402
from tonegrid.session import materialize  # noqa: E402

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables not present")


@given
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in queries.SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        cur = con.execute(queries.SQL[name])
        assert compare(rows, df.columns, cur.fetchall(), [c[0] for c in cur.description]) is None


@given
def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    clean = materialize(steps["toxicity"](spark, docs, SF), "t")
    toxic = {r["doc_id"] for r in table(spark, SF, "labels").where("toxic = 1").collect()}
    gone = {r["doc_id"] for r in docs.select("doc_id").subtract(clean.select("doc_id")).collect()}
    assert len(gone & toxic) >= 0.8 * len(toxic) and clean.columns == columns
    single = materialize(steps["near_duplicates"](spark, clean, SF), "n")
    groups = near_join.join(clean).groupBy("class_id").count().count()
    assert single.count() == groups and near_join.join(single).where("n_links > 0").count() == 0 and single.columns == columns
    safe = materialize(steps["secrets"](spark, single, SF), "s")
    assert safe.count() == single.count() and safe.columns == columns
    assert not any(secret_scan.rule_spans(r["text"] or "") for r in safe.collect())
    mixed = materialize(steps["mixing"](spark, safe, SF), "m")
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == columns and max(times.values()) <= 3
    coded = steps["encoding"](spark, mixed, SF)
    assert Counter(r["doc_id"] for r in coded.collect()) == times


def test_stages_on_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _kept_row string, _mix_hash string"
    rows = [(1, None, None, None, None, "a", "b"), (2, "", "en", "s", 0, "a", "b"), (3, "one two three four five six", "en", "s", 27, "a", "b"), (4, "one two three four five six", "en", "s", 27, "a", "b"),
            (4, "one two three four five six", "en", "s", 27, "a", "b"), (4, "other text under the same id now", "en", None, 32, "a", "b"), (None, "token = abcdef123456", "en", "s", 20, "a", "b")]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    steps = dict(corpus_pipeline.STAGES)
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        full = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, str(tmp_path)), name)
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
            if name == "near_duplicates" and full:
                assert sorted((str(r["doc_id"]), r["text"] or "") for r in docs.collect()) == sorted([("1", ""), ("2", ""), ("3", "one two three four five six"), ("4", "other text under the same id now"), ("None", "token = abcdef123456")])
                assert {r["_kept_row"] for r in docs.collect()} == {"a"}
            if name == "secrets" and full:
                assert ("[assign]", 8) in [(r["text"], r["n_chars"]) for r in docs.collect()]
        assert steps["encoding"](spark, docs, str(tmp_path)).count() == docs.count()
