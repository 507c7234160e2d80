"""What the n-gram join leaves to the driver: plans of bounded width, and nothing kept that is used no more."""

import pytest

pytest.importorskip("tidemark.llm")

from tidemark.llm import ngram_join  # noqa: E402


def test_join_spares_the_driver(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sent, plans = [], []
    context, write = type(spark.sparkContext), ngram_join.written

    def broadcast(self, value, f=context.broadcast):
        sent.append(f(self, value))
        return sent[-1]

    def written(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange"))
        return write(df, *args)

    monkeypatch.setattr(context, "broadcast", broadcast)
    monkeypatch.setattr(ngram_join, "written", written)
    beans = [b for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName()]
    before = sum(b.getCollectionCount() for b in beans)
    kept = ngram_join.keep_one(docs, shingle=5, percent=80).count()
    assert 0 < kept < docs.count()
    assert max(plans) <= 10
    assert len(sent) == 2 and not any(b._jbroadcast.isValid() for b in sent)
    assert not beans or sum(b.getCollectionCount() for b in beans) > before
