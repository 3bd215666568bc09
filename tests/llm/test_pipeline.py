"""The corpus pipeline on a small table with odd rows: each stage's decisions and the last one's ids."""

from collections import Counter

import corpus_pipeline
import sentencepiece
from pyspark.sql import functions as F

from deltaweave.llm import neardup, spm

SF = "/root/testdata/sf0.001"


def test_pipeline_on_odd_rows_and_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = "rare words that stand here once and only once in all of these texts, number"
    odd = [(None, None), (9001, None), (9002, ""), (9003, f"{long} one"), (9004, f"{long} one"), (9004, f"{long} one"), (None, "  !!! "), (9005, "Mr. John Smith wrote to a.b@shop.example.com")]
    more = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], docs.schema)
    for name, rows in (("some", docs.unionByName(more)), ("none", docs.limit(0))):
        rows.write.parquet(str(tmp_path / name / "documents.parquet"))
        for other in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{other}.parquet").write.parquet(str(tmp_path / name / f"{other}.parquet"))
    sf = str(tmp_path / "some")
    kept, columns = spark.read.parquet(f"{sf}/documents.parquet"), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialise(stage(spark, kept, sf), f"test-{name}")
        assert out.columns == columns and out.dtypes == kept.dtypes
        before, after = (Counter((r.doc_id, r.text) for r in x.collect()) for x in (kept, out))
        if name == "pii":
            assert sum(before.values()) == sum(after.values())
            assert not any(t and ("shop.example.com" in t or "John Smith" in t) for _, t in after)
        else:
            assert not after - before
        if name == "near_duplicates":
            assert [n for (i, _), n in after.items() if i in (9003, 9004)] == [1] and (9003, f"{long} one") in after
            classes = {r.doc_id: r.class_id for r in neardup.near_duplicates(kept).collect() if r.doc_id is not None}
            assert {i for i, _ in after if i is not None} == set(classes.values())
        assert (9002, "") in after and (9001, None) in after
        kept = out
    sp = sentencepiece.SentencePieceProcessor(model_file=spm.DEFAULT_MODEL)
    want = Counter((r.doc_id, tuple(sp.encode(r.text)) if r.text else ()) for r in kept.collect())
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want and sum(got.values()) > 100
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_pipeline_ignores_further_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20).withColumns({"ids": F.lit(1), "node": F.lit("x"), "kind": F.lit("y"), "score": F.lit(2.0)})
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
