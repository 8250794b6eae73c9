"""The pipeline's stages, each on what the one before kept."""

import hashlib
import os
import random

import pytest

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def test_stages(spark, tmp_path):
    import corpus_pipeline
    from murmurlake.llm import decontaminate, line_dedup, ngram_join

    docs, sizes = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if name != "bpe":
            assert docs.columns == columns
        if name == "line_dedup":
            assert line_dedup.covered_lines(docs).count() == 0
        if name == "ngram_join":
            assert ngram_join.near_duplicates(docs).filter("doc_id <> component_id").count() == 0
        if name == "decontaminate":
            assert decontaminate.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 0
    whole = {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {tuple(r) for r in docs.collect()}


KINDS = "doc_id long, text string, line_dedup string, kept string, lid string, row string"


def stage_inputs(spark):
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(12)) for _ in range(40)]
    long = "\n".join(base)
    rows = [(1, long), (2, long), (2, long), (3, None), (4, ""), (5, " \n\n "), (None, "no id\nbut\nlines"), (None, None), (6, "x " * 3000), (7, "no id\nbut\nlines")]
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], KINDS)


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "ngram_join", "decontaminate", "bpe"])
def test_stages_on_nulls_repeated_rows_and_clashing_names(spark, name):
    import corpus_pipeline

    docs = stage_inputs(spark)
    stage = dict(corpus_pipeline.STAGES)[name]
    made = stage(spark, docs, SF)
    rows = made.collect()
    if name == "bpe":
        assert len(rows) == docs.count() and {r["decoded_sha256"] for r in rows if r["n_tokens"] == 0} == {hashlib.sha256(b"").hexdigest()}
    else:
        assert made.columns == docs.columns and {r["line_dedup"] for r in rows} == {"a"}
    texts = sorted((repr(r["doc_id"]), repr(r["text"])) for r in rows) if name != "bpe" else None
    given = sorted((repr(r["doc_id"]), repr(r["text"])) for r in docs.collect())
    if name in ("toxicity", "decontaminate"):
        assert texts == given  # nothing in them is toxic or of the benchmark
    if name == "ngram_join":  # one of the three equal rows stays, and one of the two short texts
        assert len(texts) == len(given) - 3
    if name == "line_dedup":  # the text of id 2 is a later copy; null ids come first
        assert len(texts) == len(given) - 3 and not any(t[0] in ("2", "7") for t in texts)
    assert stage(spark, docs.limit(0), SF).count() == 0
