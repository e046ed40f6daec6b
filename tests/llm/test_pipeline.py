"""The pipeline: each stage's decisions take effect, and run() is its stages in a row."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from runlattice.llm import decontaminate, line_dedup, minhash, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, expected = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "bpe":
            assert out.columns == columns
            out.write.parquet(str(tmp_path / name))
            out = spark.read.parquet(str(tmp_path / name))
            if name == "toxicity":
                bad = {r["doc_id"] for r in toxicity.judged(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").collect()}
                assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()} - bad
            elif name == "line_dedup":
                lines = {r["doc_id"]: r["lines"] for r in line_dedup.deletions(docs).collect()}
                was = {r["doc_id"]: r["text"] for r in docs.collect()}
                for r in out.collect():
                    assert (r["text"] == was[r["doc_id"]]) == (r["doc_id"] not in lines)
            elif name == "minhash":
                assert minhash.near_duplicates(out, k=5).filter("NOT kept").count() == 0
            elif name == "decontamination":
                assert decontaminate.contained(out, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
            docs = out
        else:
            expected = sorted(map(tuple, out.collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == expected


def test_stages_keep_clashing_columns_nulls_and_empty_tables(spark):
    """Every stage but the last over rows with nulls, repeated rows and names that the operators could use themselves; and over no rows."""
    line = " ".join(f"word{i}" for i in range(30))
    rows = [(1, line + "\nend one"), (2, line + "\nend two"), (2, line + "\nend two"), (3, None), (4, ""), (None, "a b c"), (5, " ".join(f"other{i}" for i in range(40)))]
    names = ["gone", "GONE_", "score", "hit", "key", "parts", "own", "was", "doc", "a", "b", "n", "root"]
    df = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        none = stage(spark, df.filter("false"), SF)
        assert none.count() == 0
        if name == "bpe":
            assert out.count() == len(rows)
            continue
        assert out.columns == none.columns == df.columns
        got = sorted((r["doc_id"] or 0, r["text"] or "", r["n_chars"], *(r[c] for c in names)) for r in out.collect())
        if name == "line_dedup":
            want = [(i or 0, t or "") for i, t in rows[:1]] + [(2, "end two")] * 2 + [(i or 0, t or "") for i, t in rows[3:]]
        elif name == "minhash":
            want = [(i or 0, t or "") for i, t in rows]
            kept = {r["doc_id"] for r in minhash.near_duplicates(df, k=5).filter("kept").collect()}
            want = [w for w, (i, _) in zip(want, rows) if i in kept or i is None]
        else:
            want = [(i or 0, t or "") for i, t in rows]
        assert got == sorted((i, t, len(t), *range(len(names))) for i, t in want)
