"""The whole pipeline, stage by stage, on a small corpus."""

from pyspark.sql import functions as F

import corpus_pipeline
from eddyflow.llm import decontaminate, pii
from eddyflow.llm.common import table
from tests.llm.test_operators import CLASHES, EDGE, base_pii, classes_by_hand, edge, leaks_by_hand  # noqa: F401


def test_stages(spark, small):
    docs = table(spark, small, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "near duplicates", "decontamination", "personal data", "mixing"]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small).cache()
        kept = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "mixing":
            assert set(kept) < set(rows) and {"domain", "tokens", "epoch"} <= set(out.columns)
            break
        assert out.columns == table(spark, small, "documents").columns
        if name == "language ID":
            assert len(kept) >= 0.99 * len(rows)
        if name == "near duplicates":
            assert set(kept) == set(classes_by_hand(list(rows.items())).values())
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in table(spark, small, "benchmark").collect()]
            assert set(kept) == set(rows) - {k for k, _ in leaks_by_hand(list(rows.items()), items)}
        if name == "personal data":
            model = pii.train()
            assert all(kept[k] == pii.redacted(t, [x for part in pii.spans_of(t, model) for x in part]) for k, t in rows.items())
            assert not any(base_pii(t) for t in kept.values())
        docs, rows = out, kept


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.count() > 0 and decontaminate.leaks(out, table(spark, small, "benchmark")).count() == 0


def test_stages_on_odd_rows_and_columns(spark, small, edge):
    """Nulls, empty and long texts, repeated rows, columns that clash, empty tables: no stage fails or changes a column."""
    docs = table(spark, small, "documents")
    odd = edge.select(*(F.col(c).cast(docs.schema[c].dataType).alias(c) if c in edge.columns else F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
    docs = docs.filter("doc_id < 60").unionAll(odd)
    docs = docs.select("*", *(F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id"), F.lit(-1))).alias(c) for c in CLASHES)).cache()
    n = docs.count()
    assert n == 60 + len(EDGE)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small).cache()
        assert set(docs.columns) <= set(out.columns) and out.columns[: len(docs.columns)] == docs.columns
        rows = out.select("doc_id", *CLASHES).collect()
        assert rows and all(r[c] == f"{c} {-1 if r['doc_id'] is None else r['doc_id']}" for r in rows for c in CLASHES)
        assert stage(spark, docs.limit(0), small).count() == 0
