"""What packing holds in Python: a few MB of texts and of pieces, whatever the rows."""

import pandas as pd
import pytest

pytest.importorskip("tidemark.llm")

from tidemark.llm import packing, token_output  # noqa: E402

MOST = 8 << 20


def test_pieces_come_back_a_few_at_once(spark):
    class Docs:
        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):
            return run

    long = "one and two " * 500_000
    pdf = pd.DataFrame({"doc_id": [1, None, 3, 4], "text": [long, None, "short", long]})
    for keep_ids in (True, False):
        frames = list(packing.token_pieces(Docs(), keep_ids=keep_ids)(iter([pdf])))
        assert max(4 * f["length"].sum() for f in frames) <= MOST and len(frames) > 1
        rows = pd.concat(frames)
        assert list(rows.columns) == ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
        assert rows["doc_id"].isna().sum() == 1 and rows[rows["doc_id"] == 3]["length"].tolist() == [rows[rows["doc_id"] == 3]["doc_tokens"].iloc[0]]
        for doc in (1, 4):
            own = rows[rows["doc_id"] == doc]
            assert own["start"].tolist() == list(range(0, own["doc_tokens"].iloc[0], packing.ROOM)) and own["length"].sum() == own["doc_tokens"].iloc[0]


def test_packing_sends_only_texts_to_python(spark, sf, monkeypatch):
    docs, sent = spark.read.parquet(f"{sf}/documents.parquet"), {}

    def written(df, name, batch_bytes=None, write=packing.written):
        sent[name] = batch_bytes or 1 << 40
        return write(df, name, batch_bytes)

    monkeypatch.setattr(packing, "written", written)
    monkeypatch.setattr(token_output, "written", written)
    rows = packing.pack_documents(docs)
    assert "Pandas" not in rows._jdf.queryExecution().executedPlan().toString()
    token_output.training_order(docs)
    assert set(sent) == {"pieces", "sequences"} and max(sent.values()) <= MOST
    got = rows.toPandas().sort_values(["sequence_id", "offset"])
    ends = got.groupby("sequence_id")["length"].cumsum()
    assert (got["offset"] == ends - got["length"]).all() and ends.max() <= packing.ROOM
    assert len(got.drop_duplicates(["doc_id", "start"])) == len(got) and got["doc_id"].nunique() == docs.count()
