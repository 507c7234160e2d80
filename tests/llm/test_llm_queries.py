"""Every query of the subpackage: against its SQL, or its contract on the stored tables."""

import os
import zlib

import numpy as np
import pytest
from conftest import same
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from test_llm_operators import plain_report
from tidemark.llm import media_gif, queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf, duck, name):
    same(queries.QUERIES[name](spark, sf), duck.sql(queries.SQL[name]))


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())


def held(doc, by):
    return zlib.crc32(str(doc).encode()) % by


def test_language(spark, sf, duck, texts):
    langs = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    rows = queries.op1_language_id(spark, sf).collect()
    assert len(rows) == len(texts) and all(r["held_out"] == (held(r["doc_id"], 4) == 2) for r in rows)
    test = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in test]) > 0.97


def test_packing(spark, sf, texts):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = queries.op2_packing(spark, sf).collect()
    pieces, packs = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        packs.setdefault(r["sequence_id"], []).append(r)
    assert pieces.keys() == texts.keys()
    for doc, parts in pieces.items():
        ids = np.array([*exact.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in packs.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert sum(r["length"] for r in rows) > 0.97 * 2048 * len(packs)


def test_training_order(spark, sf, texts):
    rows = queries.op7_training_order(spark, sf).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert {r["n_bytes"] for r in rows} == {2048} and all(r["row_in_shard"] == r["slot"] % 8192 for r in rows)
    exact, found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {(r["doc_id"], r["seq_no"]): (r["n_tokens"], r["ids_crc32"]) for r in rows}
    want = {}
    for doc, text in texts.items():
        ids = [*exact.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 1024):
            piece = np.array((ids[k : k + 1024] + [0] * 1024)[:1024], "<u2")
            want[doc, k // 1024] = (min(1024, len(ids) - k), zlib.crc32(piece.tobytes()))
    assert found == want and len(rows) == len(want)


def test_media(spark, sf, texts):
    import hashlib

    for r in queries.op8_media_gif(spark, sf).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = media_gif.encode_gif(payload)
        grey = np.bincount(np.frombuffer(payload, np.uint8) >> 6, minlength=4) * 1000 // len(payload)
        assert (r["media_bytes"], r["media_sha256"], r["n_frames"], r["duration_ms"]) == (len(stored), hashlib.sha256(stored).hexdigest(), -(-len(payload) // (192 * 256)), -(-len(payload) // (192 * 256)) * 100)
        assert r["feature"] == f"{np.frombuffer(payload, np.uint8).mean():.3f}:" + ",".join(map(str, grey))


@pytest.fixture(scope="module")
def larger(sf):
    """A folder with enough labels to hold some out."""
    return os.path.join(os.path.dirname(sf), "sf0.01")


def test_quality_of_a_held_out_fold(spark, larger, duck):
    grade = dict(duck.sql(f"SELECT doc_id, quality FROM '{larger}/labels.parquet'").fetchall())
    rows = queries.op9_quality(spark, larger).collect()
    assert all(r["held_out"] == (held(r["doc_id"], 5) == 0) for r in rows)
    test = [r for r in rows if r["doc_id"] in grade and r["held_out"]]
    assert len(test) > 50 and np.mean([r["keep"] == (grade[r["doc_id"]] == 1) for r in test]) > 0.95


def test_toxicity_holds_a_fold_out(spark, sf, texts):
    rows = queries.op10_toxicity(spark, sf).collect()
    assert len(rows) == len(texts)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (held(r["doc_id"], 5) == 0) for r in rows)


def test_toxicity_of_a_held_out_fold(spark, larger, duck):
    larger = larger.replace("sf0.01", "sf0.1")
    toxic = dict(duck.sql(f"SELECT doc_id, toxic FROM '{larger}/labels.parquet'").fetchall())
    test = [r for r in queries.op10_toxicity(spark, larger).collect() if r["doc_id"] in toxic and r["held_out"]]
    right = [[r["predicted"] == toxic[r["doc_id"]] for r in test if toxic[r["doc_id"]] == label] for label in (0, 1)]
    assert len(right[1]) > 50 and np.mean(right[0]) > 0.99 and np.mean(right[1]) > 0.85


def test_secrets_are_those_of_a_plain_pattern(spark, sf, duck):
    want = duck.sql("""SELECT doc_id, sha256(unnest(regexp_extract_all(text, '[0-9a-f]{40}'))) AS s FROM documents WHERE text LIKE '%token = "%'""").fetchall()
    got = queries.op3_secret_scan(spark, sf).collect()
    assert sorted((r["doc_id"], r["secret_sha256"]) for r in got) == sorted(want)


def test_pipeline_stage_by_stage_like_brute_force(spark, sf, duck):
    import re

    from test_llm_operators import brute_components, brute_hits

    from tidemark.llm import quality

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], sf))
    assert all(k.columns == docs.columns for k in kept[:-1])
    rows = [sorted((r["doc_id"], r["text"]) for r in k.select("doc_id", "text").collect()) for k in kept[:-1]]
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = [(d, t) for d, t in rows[0] if model.tails_of(np.array([model.sum_of(t)]))[0, 0] >= 0.5]
    assert rows[1] == good and len(good) < len(rows[0])
    root = brute_components(good, 5, 80)
    single = [(d, t) for d, t in good if root[d][1] == d]
    assert rows[2] == single and len(single) < len(good)
    items = duck.sql("SELECT item_id, text FROM benchmark").fetchall()
    clean = [(d, t) for (d, t), (_, n, hits, _) in zip(single, brute_hits(single, items), strict=True) if not (hits and 20 * len(hits) >= n)]
    assert rows[3] == clean and len(clean) < len(single)
    masked = [(d, t and re.sub(r'(?<=token = ")[0-9a-f]{40}(?=")', "[secret]", t)) for d, t in clean]
    assert rows[4] == masked
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    packed = kept[-1].collect()
    for r in sorted(packed, key=lambda r: (r["doc_id"], r["start"])):
        pieces.setdefault(r["doc_id"], []).extend(np.frombuffer(bytes(r["ids"]), "<u4").tolist())
    assert pieces == {d: [*exact.encode(t or "", add_special_tokens=False).ids, 1] for d, t in masked}
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in packed)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(places, places[1:], strict=False)) and all(o + n <= 2048 for _, o, n in places)


def test_pipeline_runs_its_stages(spark, sf, duck):
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()}
    assert ids and ids < {d for d, in duck.sql("SELECT doc_id FROM documents").fetchall()}


def test_periodic_runs_like_brute_force(spark, sf, texts):
    rows = [tuple(r) for r in queries.op13_periodic_runs(spark, sf).collect()]
    short = {d: t for d, t in texts.items() if len(t or "") < 4_000}  # brute force is quadratic
    assert len(rows) == len(texts) and any(r[1] for r in rows)
    assert {r for r in rows if r[0] in short} == {plain_report(d, t) for d, t in short.items()}


def test_main_text_is_the_articles(spark, sf, duck):
    import html
    import re

    rows = {r["page_id"]: r for r in queries.op11_html_wrapper(spark, sf).collect()}
    pages = duck.sql("SELECT page_id, url, html FROM pages").fetchall()
    assert len(rows) == len(pages)
    for page, url, source in pages:
        inner = re.search(r"<article>(.*?)(</article>|\Z)", source, re.S)
        text = " ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", " ", inner[1])).split())
        assert (rows[page]["url"], rows[page]["text"], rows[page]["n_chars"]) == (url, text, len(text))


def test_first_stage_keeps_columns_named_as_its_own(spark, sf):
    docs = queries.table(spark, sf, "documents")
    for name in ("expected_grade", "tail_prob", "_rated", "row", "_docs", "a.b"):
        docs = docs.withColumn(name, docs["doc_id"].cast("string"))
    kept = corpus_pipeline.good(spark, docs, sf)
    assert kept.columns == docs.columns
    rows = [r.asDict() for r in kept.collect()]
    assert rows and all(r[name] == str(r["doc_id"]) for r in rows for name in ("expected_grade", "tail_prob", "_rated", "row", "_docs", "a.b"))
    plain = corpus_pipeline.good(spark, queries.table(spark, sf, "documents"), sf)
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in plain.collect())
