"""The pipeline's stages, the token store against the library, and words made to collide."""

import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from regolith.llm import decontaminate, license_scan, ngram_join, text, token_store, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_store.tokenizer_path())


def _expected(rows, library):
    """(doc_id, start, n_tokens, ids_crc32) of (doc_id, text) in order, by plain calls of the library."""
    at, out = 0, []
    for doc_id, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, token_store.END_ID]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_token_store_equals_the_library_on_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    got = sorted(map(tuple, token_store.op10_token_store(spark, SF).collect()))
    assert got == _expected(rows, _library())


def test_special_tokens_and_long_texts_equal_the_library(spark):
    rows = [(1, "a <|endoftext|> b, <|startoftext|>x"), (2, None), (3, "é. " * 50_000), (4, "x" * 5000), (5, "")]
    got = sorted(map(tuple, token_store.encode_and_read_back(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == _expected(rows, _library())


def test_whole_texts_are_encoded_where_words_cannot_be_cached(monkeypatch):
    monkeypatch.setattr(token_store, "splits_at_space", lambda path: False)
    ts = ["The word, again.", "", "don't"]
    ids, sizes = token_store.Encoder(token_store.tokenizer_path()).encode(*text.buffers(pa.array(ts)))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [[*_library().encode(t, add_special_tokens=False).ids, 2] for t in ts]


def _thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate({97: 98, 98: 97})
    return s


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_collide_under_polynomial_hashes_stay_apart(n):
    a = _thue_morse(n)
    b = a.translate({97: 98, 98: 97})
    ids, sizes = token_store.encoder(token_store.tokenizer_path()).encode(*text.buffers(pa.array([a, b])))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [[*_library().encode(t, add_special_tokens=False).ids, 2] for t in (a, b)]
    f = next(decontaminate.scan_texts(pa.array([a]), [decontaminate.Items(["x"], [b])]))
    assert f["hits"] == [[]]
    w = text.words_of(*text.buffers(pa.array([a, b, a])), text.NOT_SPACE)
    x, y, z = ngram_join.shingle_sets(w)
    assert ngram_join._digest(*x) != ngram_join._digest(*y) and ngram_join._digest(*x) == ngram_join._digest(*z) and ngram_join.common(x, y) == 0


def test_base_phrases_of_long_lists_and_many_benchmark_copies():
    passage = " ".join(f"p{i}" for i in range(12))
    items = decontaminate.Items([str(k) for k in range(50)], [passage] * 50)
    f = next(decontaminate.scan_texts(pa.array([f"x {passage} y"] * 200), [items]))
    assert all(h == [1, 13] for h in f["hits"]) and all(len(x) == 50 for x in f["items"]) and f["longest"] == [12] * 200
    assert len(license_scan.find_notices("released under the mit license " * 2000)) == 2000


def test_large_benchmarks_take_several_passes(spark):
    texts = [" ".join(f"w{k}x{i}" for i in range(12)) for k in range(4)]
    items = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"{texts[0]} z {texts[3]}"), (2, "clean"), (3, texts[2][:60])], "doc_id long, text string")
    one = sorted(map(str, decontaminate.scan(docs, items).collect()))
    passes = list(decontaminate.item_passes(items, "item_id", "text", most=20, blocks=1))
    assert len(passes) > 1 and sorted(map(str, decontaminate.scan(docs, items, passes=iter(passes)).collect())) == one


def _tables(spark, folder, rows, labels, items):
    spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit("clash")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_on_awkward_rows(spark, tmp_path):
    rng = np.random.default_rng(0)
    fresh = lambda: " ".join(f"v{int(x)}" for x in rng.integers(0, 5000, 60))
    base, item = fresh(), " ".join(f"bench{i}" for i in range(14))
    rows = [(1, base, "en", "a", 1), (2, base, "en", "b", 1), (3, base.replace(base.split()[30], "other"), None, None, None), (None, None, None, None, None), (4, "", "en", "a", 0), (5, f"{fresh()} {item}", "en", "a", 1), (6, fresh(), "en", "b", 1), (6, fresh(), "en", "b", 1), (7, "short", "de", None, 1)]
    folder = _tables(spark, tmp_path / "t", rows, [(1, 0, 0), (2, None, None), (None, 1, 1)], [("i", item), (None, None)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        assert kept.columns == docs.columns, name
        kept.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        seen.append(sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()))
    assert seen[0] == sorted(map(str, [1, 2, 3, None, 4, 5, 6, 6, 7]))
    assert seen[1] == sorted(map(str, [1, None, 4, 5, 6, 6, 7])) and seen[2] == sorted(map(str, [1, None, 4, 6, 6, 7]))
    order = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=lambda r: (r[0] is not None, r[0]))
    out = corpus_pipeline.run(spark, folder).orderBy("start").collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in out) == sorted((str(d), n, c) for d, _, n, c in _expected(order, _library()))
    assert [r["start"] for r in out] == [0, *np.cumsum([r["n_tokens"] for r in out])[:-1].tolist()]


def test_pipeline_of_empty_tables(spark, tmp_path):
    folder = _tables(spark, tmp_path / "t", [], [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert toxicity.remove_toxic(docs, spark.read.parquet(f"{folder}/labels.parquet")).count() == 0
    assert ngram_join.keep_one_of_each(docs).count() == 0
    assert decontaminate.remove_contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).count() == 0
