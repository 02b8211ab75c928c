"""The pipeline's stages on a small corpus."""

import corpus_pipeline
from weftline.llm import pii, quality_rules, simhash, suffix_dedup

DATA = "/root/testdata/sf0.001"


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good = quality_rules.judge_documents(docs).where("kept").select("doc_id")
    kept = {r.doc_id for r in good.collect()}
    docs1 = docs.join(good, "doc_id", "left_semi")
    named = {r.doc_id for r in simhash.near_duplicates(docs1).collect() if r.doc_id == r.component_id}
    assert named <= kept
    out = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in out} == named
    texts = {r.doc_id: r.text for r in pii.redact(suffix_dedup.remove_repeats(simhash.keep_one(docs1))).collect()}
    assert set(texts) == named and not any("@mail" in t for t in texts.values())
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns


ODD = "doc_id long, text string, lang string, source string, n_chars long, _row string, _th string, _own0 string, _base string, kept string, fp string, block string"


def odd(spark, texts):
    """Documents with columns whose names clash with those of the stages."""
    return spark.createDataFrame([(i, t, None if k % 3 == 0 else "en", None, None, *"abcdefg") for k, (i, t) in enumerate(texts)], ODD).repartition(3)


PROSE = " ".join(f"the house of the river {w} was green and the stone in that valley" for w in "ab cd ef gh ij kl mn op".split())


def test_stages_on_awkward_rows(spark):
    texts = [(1, None), (2, ""), (3, PROSE), (3, PROSE), (4, PROSE), (None, PROSE + " tail"), (None, None), (5, " \n\t "), (6, "é" * 30_000), (7, (PROSE + " x") * 40), (8, "mail a@b.cd and the rest of it " * 3)]
    docs = odd(spark, texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(tuple(r)[5:] == tuple("abcdefg") for r in rows) and {r.doc_id for r in rows} <= {i for i, _ in texts}, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in texts}


def test_stages_on_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd(spark, []), DATA).count() == 0


def test_near_copies_leave_one_row_of_each_group(spark):
    docs = odd(spark, [(9, PROSE), (4, PROSE), (4, PROSE), (7, "quite another text with words of its own " * 4), (None, PROSE)])
    rows = simhash.keep_one(docs).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["4", "7", "None"]
