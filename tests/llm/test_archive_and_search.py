"""Archive round trips, exact search, and the pipeline."""

import base64
import hashlib
import math
import sys
from pathlib import Path

import numpy as np
import pytest

from trialpulse.llm import topk, warc


def test_archive_round_trip(spark, tmp_path):
    pages = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://a/\r\n4", ""), (5, "http://é", "é" * 1000), (6, "u", "<p>x</p>"), (None, "n", "only null"), (None, "m", "<p>x</p>"), (7, "v", "q"), (7, "v", "q")]
    df = spark.createDataFrame([(*p, "extra", 1) for p in pages], "page_id long, url string, html string, sha256 string, size int")
    warc.write(df, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w/payloads")).count() == len({p[2] or "" for p in pages})
    got = sorted(warc.read(spark, str(tmp_path / "w")).collect(), key=lambda r: (r.key is not None, r.key or 0, r.target_uri or ""))
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = sorted(pages, key=lambda p: (p[0] is not None, p[0] or 0, p[1] or ""))
    assert len(got) == len(want)
    for r, (i, _, h) in zip(got, want):
        data = (h or "").encode()
        response = last[h or ""] == (-1 if i is None else i)
        assert (r.key, bytes(r.payload), r.payload_bytes) == (i, data, len(data))
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if response else ("revisit", last[h or ""]))
    record = {r.key: bytes(r.record) for r in warc.records(spark, str(tmp_path / "w")).collect()}
    head, _, rest = record[5].partition(b"\r\n\r\n")
    size = int(head.rpartition(b"Content-Length: ")[2])
    assert rest[:size].endswith("é".encode() * 1000) and rest[size:] == b"\r\n\r\n" and record[1].count(b"<p>x</p>") == 0


def test_a_changed_payload_is_noticed(spark, tmp_path):
    warc.write(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"), str(tmp_path / "w"))
    bad = spark.read.parquet(str(tmp_path / "w/payloads")).selectExpr("sha256", "cast('abd' as binary) payload").collect()
    spark.createDataFrame(bad, "sha256 binary, payload binary").write.mode("overwrite").parquet(str(tmp_path / "w/payloads"))
    with pytest.raises(Exception, match="has other bytes"):
        warc.read(spark, str(tmp_path / "w")).collect()


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_search_is_exact(spark, scale):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 24)) * scale
    x[100:140] = x[99]  # ties
    x[200:260] *= 5
    rows = [(int(i), [float(v) for v in r], "e") for i, r in enumerate(x)]
    rows += [(1000, None, "e"), (1001, [float("nan")] * 24, "e"), (1002, [], "e"), (1003, [None] + [1.0] * 23, "e"), (1004, [math.inf] * 24, "e"), (1020, [1.0, 2.0], "e"), (None, [1.0] * 24, "e"), (0, [0.5 * scale] * 24, "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, q_ids string")
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), k=7, rows=64).collect()
    use = [(i, [math.floor(64 * v) for v in e]) for i, e, _ in rows if i is not None and e and all(v is not None and math.isfinite(v) for v in e)]
    want = set()
    for qi in {i for i, _ in use if i % 20 == 0}:
        scores = sorted(((-sum(a * b for a, b in zip(q, e)), ci) for i, q in use if i == qi for ci, e in use if ci != qi and len(e) == len(q)))[:7]
        want |= {(qi, n + 1, ci, -s) for n, (s, ci) in enumerate(scores)}
    assert {tuple(r) for r in got} == want


def test_search_of_large_components_and_empty_tables(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 0.0]), (3, [0.5, 3.0]), (20, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    most = (1 << 63) - 1
    use = {i: [min(most, max(-most - 1, math.floor(64 * v))) for v in e] for i, e in rows}
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), k=4).collect()
    for q in (0, 20):
        want = sorted((-max(-most, min(most, sum(a * b for a, b in zip(use[q], use[c])))), c) for c in use if c != q)
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(c, -s) for s, c in want]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_empty_archive(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string, key string")
    warc.write(pages, str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none"), with_payload=False).count() == 0 and warc.records(spark, str(tmp_path / "none")).count() == 0


def test_pipeline_stages_keep_the_documents_columns(spark, tmp_path):
    sys.path.insert(0, str(Path(__file__).parents[2]))
    import corpus_pipeline

    rng = np.random.default_rng(0)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(500)]

    def prose(n):
        return " ".join(rng.choice(vocabulary, n))

    leak, passage, twin = prose(20), prose(80), prose(120)
    good = {i: prose(150) for i in range(1, 301)}
    good |= {301: twin, 302: twin + " " + prose(3), 304: prose(60) + " " + passage, 305: prose(60) + " " + passage}
    leaked = {i: prose(70) + " " + leak + " " + prose(70) for i in range(310, 316)}
    good |= leaked
    junk = {400 + i: prose(80).upper().replace(" ", "!! ") for i in range(60)}
    rows = [(i, t, "en", "s", len(t), "b") for i, t in (good | junk).items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block string").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(1, 150)] + [(400 + i, 0, 0) for i in range(20)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        sizes.append({r.doc_id: r.text for r in docs.collect()})
    assert not set(sizes[0]) & set(junk) and len(set(good) - set(sizes[0])) <= 6
    assert 302 not in sizes[1] and 301 in sizes[1]
    assert passage in sizes[2][304] and passage not in sizes[2][305] and sizes[2][1] == good[1]
    assert set(sizes[2]) - set(sizes[3]) == set(leaked) & set(sizes[2]) != set()
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in final} == set(sizes[3]) and all(r.round_trip for r in final)


def test_near_duplicate_stage_with_null_and_repeated_rows(spark):
    sys.path.insert(0, str(Path(__file__).parents[2]))
    import corpus_pipeline

    t, u, v = (" ".join(f"{k}{i}" for i in range(40)) for k in "tuv")
    rows = [(2, t, "a", 1), (None, t, "b", 2), (None, u, "c", 3), (7, v, "d", 4), (7, v, "d", 4), (7, v, "d", 4), (7, u, "e", 5), (8, None, "f", 6), (8, "", "f", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, `_` int").coalesce(1)
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted((str(i), str(x)) for i, x in [(2, t), (7, u), (7, v), (8, None), (8, "")])
    cut = corpus_pipeline.substring_stage(spark, docs, "").collect()
    assert len(cut) == len(rows) and {r["_"] for r in cut} == {1, 2, 3, 4, 5, 6} and all(r.text is not None for r in cut)


def test_pipeline_of_empty_tables(spark, tmp_path):
    sys.path.insert(0, str(Path(__file__).parents[2]))
    import corpus_pipeline

    for name, schema in {"documents": "doc_id long, text string, lang string, n_chars int, `_` string", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_quality_with_every_row_labelled_or_none(spark):
    from trialpulse.llm import quality

    docs = spark.createDataFrame([(i, "word " * 3 + str(i) if i % 3 else "!! " * 9, "q") for i in range(60)], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    assert min(got[i] for i in got if i % 3) > max(got[i] for i in got if i % 3 == 0)
    assert quality.classify(docs, labels.limit(0), good_only=True).count() == 60
