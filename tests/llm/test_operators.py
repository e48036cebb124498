"""The operators on awkward tables: nulls, empty and repeated rows, ties, empty tables, clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

from regolith.llm import chat_format, decontaminate, exact_dedup, language_id, license_scan, mixing, ngram_join, token_store, toxicity, url_filter

LONG = " ".join(f"word{i}" for i in range(400))
ROWS = [
    (1, LONG, "en", "a", 0), (2, LONG.replace("word7 ", "other "), "en", "a", 0), (3, LONG.upper(), "de", "b", 0), (4, None, None, None, None), (5, "", "en", "a", 0), (None, LONG, "en", None, 0),
    (6, "short text", "en", "b", 0), (6, "short text", "en", "b", 0), (7, "short\t\n text", "en", "b", 0), (8, " ", "fr", "b", 0), (9, "äöü ñandú 12", "de", "c", 0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("score", "kept", "tokens", "token", "size", "copies", "n", "id", "key"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty):
    rows = exact_dedup.exact_dedup(docs, heavy=2).collect()
    assert rows and len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r["text_sha256"], []).append(r)
    for group in by.values():
        assert sum(r["kept"] for r in group) == 1 and {r["group_size"] for r in group} == {len(group)}
        ids = [r["doc_id"] for r in group if r["doc_id"] is not None]
        assert {r["keep_id"] for r in group} == {min(ids) if ids else None}
    assert by[hashlib.sha256(b"short text").hexdigest()][0]["group_size"] == 3
    assert exact_dedup.exact_dedup(empty).count() == 0
    # the heavy and the ordinary way agree
    key = lambda rs: sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in rs)
    assert key(rows) == key(exact_dedup.exact_dedup(docs, heavy=1000).collect())


def test_ngram_join(docs, empty, spark):
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_join.ngram_components(docs).collect()}
    assert got[(1, 396)] == got[(3, 396)] == 1 and got[(None, 396)] == 1
    assert got[(2, 396)] == 1  # one word changed in 400
    assert got[(4, 0)] == 4 and got[(5, 0)] == 5 and got[(8, 0)] == 8
    assert got[(6, 1)] == 6 and got[(7, 1)] == 6
    assert ngram_join.ngram_components(empty).count() == 0
    kept = ngram_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "4", "5", "6", "8", "9"])


def test_ngram_join_tells_texts_of_one_id_apart(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(6, a), (6, b), (7, a), (8, b), (None, "a b c d e f g"), (None, "a b c d e f g"), (None, None), (3, ""), (3, ""), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs).collect()))) == sorted(map(str, [(6, 2, 6), (6, 2, 6), (7, 2, 6), (8, 2, 6), (None, 3, None), (None, 3, None), (None, 0, None), (3, 0, 3), (3, 0, 3), (3, 0, 3)]))
    kept = sorted((str(r["doc_id"]), str(r["text"])) for r in ngram_join.keep_one_of_each(docs).collect())
    assert kept == sorted([("6", a), ("6", b), ("None", "a b c d e f g"), ("None", "None"), ("3", ""), ("3", "None")])


def test_ngram_join_chain_is_one_component(spark):
    words = [f"v{i}" for i in range(300)]
    rows = []
    for k in range(12):  # each differs from the next by one more word, the ends do not link
        rows.append((k, " ".join(words)))
        words[k * 20 + 5] = f"new{k}"
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["component_id"] for r in got.collect()} == {0}


def test_decontaminate(docs, empty, spark):
    items = spark.createDataFrame([("x", "word3 word4"), ("y", None), (None, LONG[:200]), ("x", "word3 word4"), ("z", "!!")], "item_id string, text string")
    got = {str(r["doc_id"]) + str(r["n_words"]): r for r in decontaminate.scan(docs, items).collect()}
    assert got["1400"]["n_items"] == 2 and got["1400"]["n_hit"] > 10 and got["40"]["n_words"] == 0 and not got["62"]["contaminated"]
    assert got["1400"]["items_sha256"] == hashlib.sha256(b",x").hexdigest()
    clean = decontaminate.remove_contaminated(docs, items)
    assert clean.columns == docs.columns and clean.count() == 7
    assert decontaminate.scan(empty, items).count() == 0
    assert decontaminate.scan(docs, items.limit(0)).filter("contaminated").count() == 0


def test_mixing(docs, empty, spark):
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == len(ROWS)
    for source in ("a", "b", "c", None):
        own = [r for r in plan if r["source"] == source]
        assert {r["source_size"] for r in own} == {sum(r["size"] for r in own)}
        assert all(0 <= r["copies"] <= 2 for r in own)
    total = sum(r["size"] for r in plan)
    targets = {r["source"]: r["target"] for r in plan}
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    assert sorted(map(str, plan)) == sorted(map(str, mixing.mix_plan(docs).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(r["taken"] for r in plan)
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mixing_comes_near_the_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + (i * 7919) % 40)), f"s{i % 5}") for i in range(2000)]
    plan = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    assert all(abs(r["taken"] - r["target"]) < 100 for r in plan.collect())


def test_tokens(docs, empty):
    rows = token_store.encode_and_read_back(docs).collect()
    assert len(rows) == len(ROWS)
    rows.sort(key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    assert token_store.encode_and_read_back(empty).count() == 0


def test_languages_and_toxicity(docs, empty, spark):
    lang = {(r["doc_id"], r["lang_pred"]) for r in language_id.identify(docs).collect()}
    assert (4, "und") in lang and (5, "und") in lang and (8, "und") in lang
    assert language_id.identify(empty).count() == 0
    labels = spark.createDataFrame([(1, 0, 1), (3, 0, 0), (None, 1, 1), (6, None, None), (6, 0, 0)], "doc_id long, quality int, toxic int")
    scored = toxicity.score(docs, labels).collect()
    assert len(scored) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in scored)
    assert toxicity.score(docs, labels.limit(0)).filter("predicted = 1").count() == 0
    assert toxicity.remove_toxic(docs, labels.limit(0)).columns == docs.columns
    assert toxicity.score(empty, labels).count() == 0


def test_licenses(docs, empty, spark):
    t = spark.createDataFrame([(1, "All  rights, RESERVED. Relesed under the MIT licence. cc by"), (2, None)], "doc_id long, text string")
    a, b = license_scan.license_scan(t).orderBy("doc_id").collect()
    assert (a["n_base"], a["first_word"], a["last_word"], a["base_labels"], a["labels"], a["score"]) == (2, 0, 8, "cc-by,reserved", "cc-by,mit,reserved", 1.0)
    assert [(s["label"], s["edits"]) for s in a["spans"]] == [("mit", 2)]
    assert (b["n_words"], b["n_base"], b["first_word"], b["labels"], b["score"]) == (0, 0, None, "", 0.0)
    assert license_scan.license_scan(docs).count() == len(ROWS) and license_scan.license_scan(empty).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, "no scheme.com/en/"), (3, "http://EXAMPLE.com/en/x?y"), (4, "https://www.example.com/en/"), (5, "x://a.net/es/"), (6, "x://net/fr/#"), (7, "x://notexample.com"), (8, "http://m.casino-win.example.org/a"), (9, "x://b.com"), (9, "x://b.com")]
    got = [(r["page_id"], r["host"], r["rule"], r["verdict"]) for r in url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string")).orderBy("page_id").collect()]
    assert got == [(1, "", None, "allow"), (2, "", None, "allow"), (3, "example.com", "example.com/en/", "block"), (4, "www.example.com", "www.example.com/en/", "allow"), (5, "a.net", "net/es/", "block"), (6, "net", "net/fr/", "block"), (7, "notexample.com", None, "allow"), (8, "m.casino-win.example.org", None, "block"), (9, "b.com", None, "allow"), (9, "b.com", None, "allow")]
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (None, 0, None, "x"), (2, None, "assistant", ""), (1, 1, "assistant", "b"), (3, 0, "a\nb\\", "<|im_end|>\n" * 3)]
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), part_chars=4)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\n\nassistant\nb\nassistant\nb\n") and got[1]["loss_sha256"] == sha("bb") and got[1]["n_turns"] == 3
    assert got[None]["turns_sha256"] == sha("\nx\n") and got[None]["loss_chars"] == 0
    assert got[2]["loss_sha256"] == sha("") and got[3]["turns_sha256"] == sha("a\nb\\\n" + "<|im_end|>\n" * 3 + "\n")
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_url_rules_in_blocks(spark, monkeypatch):
    """A table of rules that is larger than a block gives what a plain search gives; columns of other names do not matter."""
    hosts, paths = ["com", "a.com", "b.a.com", "net", "x.net", "org"], ["/", "/p/", "/p/q", "/z"]
    rules = [("block" if (len(h) + len(p)) % 2 else "allow", h, p) for h in hosts for p in paths]
    urls = [(i, f"http://{h}{p}{t}", "x") for i, (h, p, t) in enumerate((h, p, t) for h in ["a.com", "c.b.a.com", "xcom", "x.net", "q.org", "b.a.com"] for p in paths + ["/y"] for t in ("", "k"))] + [(999, None, "x")]
    want = []
    for i, u, _ in urls:
        host, path = (u[7:].partition("/")[0], "/" + u[7:].partition("/")[2]) if u else ("", "")
        fit = sorted((-len(h + p), h, p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p))
        want.append((i, fit[0][1] + fit[0][2] if fit else None, fit[0][3] if fit else "allow"))
    pages = spark.createDataFrame(urls, "page_id long, url string, rule string").withColumn("verdict", F.lit("clash")).withColumn("host", F.lit("clash"))
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    for block, cells in ((10_000, 1 << 20), (5, 3)):
        monkeypatch.setattr(url_filter, "RULES", block)
        monkeypatch.setattr(url_filter, "CELLS", cells)
        for given in (rules, table):
            got = [(r["page_id"], r["rule"], r["verdict"]) for r in url_filter.url_filter(pages, rules=given).orderBy("page_id").collect()]
            assert got == want
    assert {r["verdict"] for r in url_filter.url_filter(pages, rules=[], block_globs=()).collect()} == {"allow"}
