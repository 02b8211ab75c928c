"""Steps whose cost once grew faster than their input."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers the queries)
from weftline import catalog
from weftline.functions import scalar
from weftline.operators import chunk, combine
from weftline.sources import extract


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_are_worked_out_once_a_document(spark):
    rows = spark.createDataFrame([(1, "a \n\n b\na\n　\nlonger"), (2, " \n\t"), (3, None), (4, "")], "doc_id long, text string")
    made = rows.select("doc_id", chunk.numbered(chunk.lines(F.col("text")), F.col("doc_id").cast("string"), F.sha2("text", 256)).alias("c"))
    assert plan(made).count("array_distinct") == plan(made).count("sha2") == 1
    found = {r.doc_id: r.c for r in made.collect()}
    assert [(c["index"], c.total, c.content, c.tokens) for c in found[1]] == [(0, 3, "a", 1), (1, 3, "b", 1), (2, 3, "longer", 2)]
    assert [c.id[-2:] for c in found[1]] == [":0", ":1", ":2"] and found[1][0].id.startswith("1:chunk:") and len(found[1][0].id) == 22
    assert found[2] == found[4] == [] and found[3] is None


def test_trims_as_before(spark):
    texts = ["", " ", "a", " a b \n", "﻿a ", "　 ", "a" + " " * 50 + "b", "x\u0085", "​ a", None]
    old = F.regexp_replace(F.regexp_replace("t", "^" + scalar._SPACE, ""), scalar._SPACE + "$", "")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(scalar.trim_all(F.col("t")).alias("new"), old.alias("old"), scalar.has_text(F.col("t")).alias("some"))
    for r in rows.collect():
        assert r.new == r.old and r.some == (None if r.old is None else r.old != "")


def test_sentences_of_long_keys_stay_whole(spark, tmp_path):
    keys = [0, 7, 99999, 100000, 149999, 8999999, 53999999, 10**12]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    found = catalog.QUERIES["sentence_chunks"](spark, str(tmp_path)).select("doc_id", "index", "content", "total").collect()
    sql = catalog.ORACLE_SQL["sentence_chunks"].replace("from orders", f"from '{tmp_path}/orders.parquet/*.parquet'")
    assert sorted(map(tuple, found)) == sorted(duckdb.sql(f'select doc_id, "index", content, total from ({sql})').fetchall())


def test_only_compared_fields_are_read(spark):
    a = '{"id":"e","objective":{"a":[1, 2],"b":1},"security":null,"facts":[{"id":"x"}]}'
    b = '{"id":"e","objective":{"b":1,"a":[1,2]},"tokenPolicy":{"n":1},"facts":[]}'
    before, after = (spark.createDataFrame([(d,), ("{broken",), (None,)], "document string") for d in (a, b))
    changed = combine.changed_fields(before, after)
    assert "MapType" not in plan(changed)
    assert [tuple(r) for r in changed.collect()] == [("e", ["security", "tokenPolicy"])]


def test_inputs_reach_extractors_once_and_by_slices(spark):
    kinds = ["text", "json", "csv", None, "nosuch"]
    rows = [(i, f'["{i}"]', kinds[i % 5]) for i in range(2 * extract.SLICE + 7)]
    rows = spark.createDataFrame(rows, "i int, t string, name string").coalesce(1)
    made = rows.select("i", extract.extract_any(F.col("t").cast("binary"), F.col("t"), F.col("name")).alias("x"))
    assert plan(made).count("CASE WHEN") == 2
    for r in made.collect():
        kind, x = kinds[r.i % 5], r.x
        assert [s.content for s in x.sections] == {"text": [f'["{r.i}"]'], "json": [str(r.i)]}.get(kind, [])
        assert x.error == {None: "ValueError: nothing to read", "nosuch": "ValueError: no extractor 'nosuch'"}.get(kind)
        assert [w.code for w in x.warnings] == (["empty-content"] if kind == "csv" else [])
