"""The pipeline against a plain account of what each stage must keep."""

import re
from collections import Counter

import corpus_pipeline
from lectern.llm import mixing
from tests.llm.test_operators import DOCS, empty, near_truth, odd  # noqa: F401 (fixtures)


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = kept.toPandas()
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        after = kept.toPandas()
        assert set(after.doc_id) <= set(before.doc_id)
        if name == "exact dedup":
            norm = before.text.fillna("").map(lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t))
            assert sorted(after.doc_id) == sorted(before.groupby(norm).doc_id.min())
        if name == "near dedup":
            truth = near_truth(dict(zip(before.doc_id, before.text, strict=True)))
            assert sorted(after.doc_id) == sorted(i for i, (_, c) in truth.items() if i == c)
        kept = spark.createDataFrame(after, docs.schema)
    plan = mixing.plan_mix(kept).toPandas()
    mixed = Counter(r.doc_id for r in corpus_pipeline.mixing_stage(spark, kept, str(tmp_path)).collect())
    assert all(mixed[i] * n == t for i, n, t in zip(plan.doc_id, plan["size"], plan.taken, strict=True))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == mixed and all(r.round_trip for r in out)


def test_odd_rows_pass_all_stages(spark, odd, empty, tmp_path):  # noqa: F811
    """Nulls in any column, empty and very long texts, ties, repeats and clashing columns; and no rows at all.

    The classifier keeps texts without words. Of equal texts the least id stays, a text without an id is none's copy in near
    dedup, and what has no words is taken with its block, so each stage's rows are known but for the mix's repeats.
    """
    docs = odd
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for stage, f in corpus_pipeline.STAGES:
        before, kept = kept, f(spark, kept, str(tmp_path))
        rows, columns = kept.collect(), kept.columns
        if stage == "sentence pieces":
            break
        assert columns == docs.columns
        kept = spark.createDataFrame(rows, kept.schema)
        ids = lambda df: Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
        if stage != "mixing":
            assert not ids(kept) - ids(before)
        if stage == "exact dedup":
            own = ids(kept)
            assert max(own.values()) == 1 and len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in own}) == len(own)
    assert rows and all(r.round_trip for r in rows) and len(rows) == before.count()
    empty.write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
