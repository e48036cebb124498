"""The operators' parts against brute force, without a cluster."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from regolith.llm import chat_format, decontaminate, language_id, license_scan, ngram_join, text, token_store, toxicity, url_filter
from regolith.llm.template import TemplateError, compile_template, fold, parse

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
texts = st.lists(st.text(alphabet="aB cé.,-\n\t0ÀZ\u4e2d", max_size=40), max_size=6)


def words(t, pattern=WORD):
    return pattern.findall(t.translate(LOWER))


@settings(max_examples=60, deadline=None)
@given(texts)
def test_words_are_those_of_the_pattern(ts):
    for pattern, table in ((WORD, text.ALNUM), (SPACED, text.NOT_SPACE)):
        w = text.words_of(*text.buffers(pa.array(ts, pa.string())), table)
        got = [[bytes(text.LOWER[w.buf[a:b]]).decode() for a, b in zip(w.starts[i:j], w.ends[i:j], strict=True)] for i, j in zip(w.offsets[:-1], w.offsets[1:], strict=True)]
        assert got == [words(t, pattern) for t in ts]
        flat = [x for g in got for x in g]
        assert len(set(w.hashes.tolist())) == len(set(flat))


def test_blocks_do_not_cut_words(monkeypatch):
    t = ["ab " * 50, "x" * 500, "", "é. " * 40]
    whole = text.words_of(*text.buffers(pa.array(t)))
    monkeypatch.setattr(text, "BLOCK", 37)
    cut = text.words_of(*text.buffers(pa.array(t)))
    assert (whole.hashes == cut.hashes).all() and (whole.starts == cut.starts).all() and (whole.offsets == cut.offsets).all()


def _hits(doc, items):
    d, hit, found = words(doc), set(), set()
    for name, item in items:
        w = words(item)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if w else ():
            for j in range(len(d) - n + 1):
                if d[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(name)
    return len(d), len(hit), sorted(found)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=80), max_size=5), st.lists(st.text(alphabet="ab ", max_size=60), max_size=3))
def test_suffix_arrays_find_all_windows(docs, items):
    named = [(str(i), t) for i, t in enumerate(items)]
    block = decontaminate.Items([n for n, _ in named], [t for _, t in named])
    got = [row for f in decontaminate.scan_texts(pa.array(docs, pa.string()), [block]) for row in zip(f["n_words"].tolist(), [sum(h[1::2]) - sum(h[::2]) for h in f["hits"]], f["items"], strict=True)]
    assert got == [_hits(d, named) for d in docs]


def test_longest_match_is_located():
    item = " ".join(f"w{i}" for i in range(60))
    doc = "x y " + " ".join(f"w{i}" for i in range(5, 50)) + " z"
    f = next(decontaminate.scan_texts(pa.array([doc, "w1 w2"]), [decontaminate.Items(["7"], [item])]))
    assert (f["longest"], f["longest_at"], f["longest_item"]) == ([45, 0], [2, None], ["7", None])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=60), max_size=5), st.randoms())
def test_re_pair_round_trip_and_random_access(docs, r):
    docs = [d + [2] for d in docs]
    ids, sizes = np.array([x for d in docs for x in d], np.uint32), np.array([len(d) for d in docs], np.int64)
    shard = token_store.Shard.read(token_store.write_shard([None if k % 3 == 2 else k for k in range(len(docs))], ids, sizes))
    assert shard.expand(shard.symbols).tolist() == ids.tolist()
    assert [shard.document(k).tolist() for k in range(len(docs))] == docs
    a = r.randint(0, len(ids))
    b = r.randint(a, len(ids))
    assert shard.ids(a, b).tolist() == ids[a:b].tolist()


def test_re_pair_makes_rules_of_rules():
    ids = np.array(([5, 6, 7, 8] * 50 + [2]) * 4, np.uint32)
    shard = token_store.Shard.read(token_store.write_shard([0, 1, 2, 3], ids, np.full(4, 201)))
    assert len(shard.symbols) < len(ids) / 3 and shard.length.max() >= 4
    assert shard.document(2).tolist() == ids[:201].tolist()


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    t = ["", "The, <|endoftext|> it's, é. 12,5. ...", "don't. WE'LL, \u00a0 A\u030angstrom. \u2014, no.", "word " * 300, "x" * 3000]
    library = Tokenizer.from_file(token_store.tokenizer_path())
    ids, sizes = token_store.encoder(token_store.tokenizer_path()).encode(*text.buffers(pa.array(t)))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [e.ids + [2] for e in library.encode_batch(t, add_special_tokens=False)]
    assert zlib.crc32(ids[: sizes[0]].astype("<u4").tobytes()) == zlib.crc32(b"\2\0\0\0")


def _shingles(t):
    w = words(t, SPACED)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=60), min_size=2, max_size=6))
def test_portions_find_the_links_of_brute_force(ts):
    sets = [_shingles(t) for t in ts]
    w = text.words_of(*text.buffers(pa.array(ts)), text.NOT_SPACE)
    levels = np.zeros(ngram_join.SLOTS, np.uint8)
    levels[ngram_join.slots(w.hashes)] = (ngram_join.slots(w.hashes) % 3).astype(np.uint8)
    own = ngram_join.shingle_sets(w, levels)
    assert [len(t) for t, _ in own] == [len(s) for s in sets]
    some = [i for i, (t, _) in enumerate(own) if len(t)]
    if not some:
        return
    truth = {(i, j) for i in some for j in some if i != j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    for i in some:  # without other members there is nothing that is connected already
        portion = ngram_join.Portion(some, some, [own[j] for j in some])
        assert sorted(portion.match(i, i, own[i]).tolist()) == [j for j in some if (i, j) in truth]
    portion = ngram_join.Portion(some, some, [own[j] for j in some])
    links = [(i, j) for i in some for j in portion.match(i, i, own[i]).tolist()]
    assert set(links) <= truth and len(links) < len(some) and _classes(links, some) == _classes(truth, some)


def _classes(links, nodes):
    of = {i: i for i in nodes}
    for _ in nodes:
        for a, b in links:
            of[a] = of[b] = min(of[a], of[b])
    return of


def test_prefixes_hold_a_shared_token():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a = rng.choice(1000, n, replace=False)
        b = np.unique(np.concatenate([rng.permutation(a)[: int(rng.integers(1, n + 1))], rng.integers(1000, 1010, 2)]))
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            small, large = sorted((np.sort(a), np.sort(b)), key=len)
            assert len(np.intersect1d(small[: ngram_join.short_prefix_size(len(small))], large[: ngram_join.prefix_size(len(large))]))


def test_globs_match_like_their_regular_expressions():
    globs = ["a*b", "*x?z", "ab", "*", "?", "*a*a*"]
    automaton = url_filter.Automaton([url_filter._glob(g) for g in globs] + [[url_filter._HOST_RUN] + url_filter._glob(".com/")])
    rng = np.random.default_rng(0)
    ts = ["", "ab", "aab", "xyz", "xéz", "é", "中", "xéyz", "a.com/", "b/a.com/", *("".join(rng.choice(list("abxzé中/"), int(rng.integers(0, 9)))) for _ in range(300))]
    got = automaton.run(*text.buffers(pa.array(ts)))
    rx = [re.compile(re.escape(g).replace(r"\*", ".*").replace(r"\?", "."), re.S) for g in globs] + [re.compile(r"[^/]*\.com/")]
    assert got.tolist() == [[r.fullmatch(t) is not None for r in rx] for t in ts]


def test_spellings_of_one_place_agree():
    key = url_filter.place_key
    assert key("user:pw@ads-track.com:443", "/a/./b//c") == "ads-track.com/a/b/c"
    assert key("spam%2Dfarm.org.", "/%61%2fb/../c/") == "spam-farm.org/c/"
    assert key("h:8080", "/a/..") == "h:8080/" and key("h", "") == "h" and key("", "") == "" and key("h", "/..") == "h/"


def test_many_globs_span_words():
    automaton = url_filter.Automaton([url_filter._glob(f"*{k:03d}-end") for k in range(60)])
    assert automaton.words > 4
    assert automaton.run(*text.buffers(pa.array(["x-017-end"]))).nonzero()[1].tolist() == [17]


def test_misspelt_notices_are_found_as_by_plain_search():
    import regex

    rng = np.random.default_rng(1)
    for _ in range(60):
        k = int(rng.integers(len(license_scan.NOTICES)))
        notice, most = license_scan.NOTICES[k][0], license_scan.edits_allowed(license_scan.NOTICES[k][0])
        t = list(notice)
        for _ in range(int(rng.integers(0, most + 1))):
            at, kind = int(rng.integers(len(t))), rng.integers(3)
            t[at : at + int(kind != 0)] = ["q"] * int(kind != 2)
        whole = "lorem ipsum " * 5 + "".join(t) + " dolor sit" * 5
        found = license_scan.find_notices(whole)
        assert any(license_scan.NOTICES[f[3]][1] == license_scan.NOTICES[k][1] for f in found) or min(f[2] for f in found) <= most
        plain = regex.search(f"(?b)(?:{regex.escape(notice)}){{e<={most}}}", whole)
        assert plain and any(a < plain.end() and b > plain.start() for a, b, _, _ in found)
    assert license_scan.find_notices("nothing here " * 50) == []


def _spans_by_brute_force(text):
    """Edit distances of all spans to all notices, overlaps resolved as documented."""
    spans = []
    for k, (notice, label) in enumerate(license_scan.NOTICES):
        most = license_scan.edits_allowed(notice)
        for start in range(len(text)):
            row = list(range(len(notice) + 1))
            for end in range(start + 1, min(len(text), start + len(notice) + most) + 1):
                above, row = row, [end - start]
                for i, c in enumerate(notice, 1):
                    row.append(min(above[i] + 1, row[-1] + 1, above[i - 1] + (c != text[end - 1])))
                if row[-1] <= most:
                    spans.append((row[-1], start - end, start, label, end, k))
    kept = []
    for edits, _, start, _, end, k in sorted(spans):
        if all(end <= a or start >= b for a, b, _, _ in kept):
            kept.append((start, end, edits, k))
    return sorted(kept)


def test_adjacent_misspelt_and_exact_notices_are_all_found():
    mit, gpl3, gpl2 = (license_scan.NOTICES[k][0] for k in (1, 3, 4))
    bad = mit.replace("license", "licnse")
    misspelt3 = gpl3.replace("general", "generl").replace("license,", "licens,")
    edits = lambda t: [(f[2], license_scan.NOTICES[f[3]][1]) for f in license_scan.find_notices(t)]
    assert edits(f"{bad}. {mit}. {bad}. {bad}. {mit}.") == [(1, "mit"), (0, "mit"), (1, "mit"), (1, "mit"), (0, "mit")]
    assert edits(f"{misspelt3} or {gpl2}") == [(2, "gpl-3.0"), (0, "gpl-2.0")]
    assert edits(f"{mit} " * 300) == [(0, "mit")] * 300
    for t in (f"{bad}{mit} {bad[1:]}", f"{misspelt3} {gpl2[:-1]}", f"{gpl3}{misspelt3}", "licensed under cc by-n 4.0, licensed under ccby 4.0"):
        assert license_scan.find_notices(t) == _spans_by_brute_force(t)


def test_base_phrases():
    t = ["CC-BY, cc by! all rights\nreserved", "general public licenses", "accby cc", ""]
    w = text.words_of(*text.buffers(pa.array(t)))
    doc, at, phrase = license_scan.base_places(w)
    assert sorted(zip(doc.tolist(), at.tolist(), phrase.tolist(), strict=True)) == [(0, 0, 0), (0, 2, 0), (0, 4, 2)]


@given(st.text(alphabet="<|\\im_endstar\n>a", max_size=30))
def test_escapes_are_reversible(t):
    assert chat_format.unescape(chat_format.escape(t)) == t and "<|" not in chat_format.escape(t)
    assert chat_format.unescape_role(chat_format.escape_role(t)) == t and "\n" not in chat_format.escape_role(t)


def test_template_language():
    run = lambda source, **v: "".join(p for p, _ in compile_template(source, {"upper": str.upper})(v))
    assert run("{% for m in ms %}{{ m.a | upper }}{% if not loop.last %},{% endif %}{% endfor %}", ms=[{"a": "x"}, {"a": "y"}]) == "X,Y"
    assert run("{% if a == 'q' and b != 2 %}1{% elif 'z' in a %}2{% else %}3{% endif %}", a="zz", b=2) == "2"
    assert run("{{ missing.a }}{{ a['k'] ~ '!' }}{{ none }}", a={"k": 1}) == "1!"
    assert [p for p in compile_template("a{% generation %}{{ x }}{% endgeneration %}b", {})({"x": "y"})] == [("a", False), ("y", True), ("b", False)]
    for bad in ("{{ a.__class__ }}", "{{ f() }}", "{% for x %}{% endfor %}", "{% if a %}", "{{ a | nope }}", "{% endif %}", "{{ 'a }}"):
        with pytest.raises(TemplateError):
            compile_template(bad, {})


def test_template_constants_are_folded():
    tree = fold(parse("a{{ 'b' | upper }}{% if 1 == 2 %}x{% else %}c{% endif %}{{ 'd' ~ 'e' }}"), {"upper": str.upper})
    assert len(tree) == 1 and tree[0].of.value == "aBcde"


def test_reader_checks_what_was_written():
    reader = chat_format.Reader()
    pieces = compile_template(chat_format.TEMPLATE, chat_format.FILTERS)({"messages": [{"role": "user", "text": "hi <|im_end|>"}, {"role": "assistant", "text": "yo\n"}]})
    for t, spans in chat_format._parts(pieces, 8):
        reader.add(t, [{"start": a, "end": b} for a, b in spans])
    assert reader.row(1)[1:3] == (2, hashlib.sha256(b"user\nhi <|im_end|>\nassistant\nyo\n\n").hexdigest())
    assert reader.row(1)[3:5] == (3, hashlib.sha256(b"yo\n").hexdigest())


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    crf = language_id.Crf(["a", "b"], np.empty(0, np.uint64))
    crf.transitions, crf.first = rng.normal(size=(2, 2)), rng.normal(size=2)
    lengths = np.array([3, 0, 5, 1])
    steps = language_id.Steps(lengths)
    e = rng.normal(size=(9, 2)).astype(np.float32)
    scores = np.empty_like(e)
    scores[steps.place] = e
    alpha, beta = language_id.forward_backward(crf, scores, steps)
    got = (alpha * beta) / (alpha * beta).sum(1, keepdims=True)
    got, at = got[steps.place], 0
    for n in lengths:
        p = np.zeros((n, 2))
        for path in product((0, 1), repeat=int(n)):
            s = sum(e[at + t, y] for t, y in enumerate(path)) + (crf.first[path[0]] if n else 0) + sum(crf.transitions[a, b] for a, b in zip(path, path[1:], strict=False))
            for t, y in enumerate(path):
                p[t, y] += np.exp(s)
        if n:
            assert np.allclose(got[at : at + n], p / p.sum(1, keepdims=True), atol=1e-4)
        at += n


@pytest.mark.parametrize("strength", [1.0, 6.0])
def test_pieces_of_a_text_have_the_marginals_of_the_whole(monkeypatch, strength):
    rng = np.random.default_rng(4)
    vocab = {"en": ["the", "with", "thing"], "de": ["der", "nicht", "schon"]}
    crf = language_id.fit(pa.array([" ".join(rng.choice(vocab[k], 30)) for k in ("en", "de") for _ in range(20)]), ["en"] * 20 + ["de"] * 20)
    crf.transitions = strength * np.eye(2)
    own = [" ".join(rng.choice(vocab["en"], 40)) + " zz" * 70 + " " + " ".join(rng.choice(vocab["de"], 3)), "der", "", " ".join(rng.choice(vocab["de"], 25))]
    marginals = lambda: {int(k): row for _, place, _, p in language_id.label_words(crf, text.words_of(*text.buffers(pa.array(own)))) for k, row in zip(place, p, strict=True)}
    whole = marginals()
    for cut, batch in ((7, 1 << 19), (10, 15), (1, 1)):
        monkeypatch.setattr(language_id, "CUT", cut)
        monkeypatch.setattr(language_id, "BATCH", batch)
        got = marginals()
        assert got.keys() == whole.keys() and all(np.allclose(got[k], whole[k], atol=1e-5) for k in whole)


def test_languages_are_learned_and_switches_found():
    rng = np.random.default_rng(2)
    vocab = {"en": ["the", "with", "thing", "other", "should"], "de": ["der", "nicht", "schon", "werden", "über"]}
    ts = [(" ".join(rng.choice(vocab[k], 40)), k) for k in ("en", "de") for _ in range(40)]
    crf = language_id.fit(pa.array([t for t, _ in ts]), [k for _, k in ts])
    lang, score, switches = language_id.predict_texts(pa.array(["the other thing", "schon über", "the thing should nicht werden der schon", "12 34", "", None, "!?", "Werdens nichts"]), crf)
    assert lang[:2] == ["en", "de"] and lang[3:7] == ["und"] * 4 and lang[7] == "de"
    assert switches[2] == 1 and (score[3:7] == 0).all() and ((score >= 0) & (score <= 1)).all()
    assert language_id.predict_texts(pa.array(["abc"]), None)[0] == ["und"]


def test_toxicity_learns_stems():
    rng = np.random.default_rng(3)
    clean = [f"w{int(x)}" for x in range(400)]
    ts, y = [], []
    for i in range(600):
        t = list(rng.choice(clean, 30))
        if i % 4 == 0:
            t[int(rng.integers(30))] = f"zlorp{int(rng.integers(50))}"
        ts.append(" ".join(t))
        y.append(int(i % 4 == 0))
    net = toxicity.fit(pa.array(ts), np.array(y))
    p = toxicity.score_texts(pa.array(["w1 w2 zlorpunseen w3", "w1 w2 w3", "", None]), net)
    assert p[0] >= toxicity.THRESHOLD and (p[1:] < toxicity.THRESHOLD).all()
    assert (toxicity.score_texts(pa.array(["a"]), toxicity.fit(pa.array([], pa.string()), np.array([]))) < 0.01).all()


def test_long_texts_are_scored_whole():
    rng = np.random.default_rng(3)
    ts = [" ".join(rng.choice(["aa", "bb", "cc"], 20)) + (" grimblo" if i % 2 else "") for i in range(300)]
    net = toxicity.fit(pa.array(ts), np.array([i % 2 for i in range(300)]))
    assert toxicity.score_texts(pa.array(["aa " * 200_000 + "grimblo"]), net)[0] >= toxicity.THRESHOLD


def test_new_words_are_merged_into_the_cache(monkeypatch):
    """What is learned costs its own sorting, not that of the whole cache; words of any alphabet keep their ids."""
    own = token_store.Encoder(token_store.tokenizer_path())
    texts = [" ".join(f"w{i}é中, x{i}" for i in range(3000)), "neu $$$ w5é中. ñandú <|endoftext|> x7"]
    sorted_lengths, sort = [], np.argsort
    for text in texts:
        monkeypatch.setattr(np, "argsort", lambda a, *rest, **more: sorted_lengths.append(len(a)) or sort(a, *rest, **more))
        sorted_lengths.clear()
        raw = text.encode()
        ids, sizes = own.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        monkeypatch.undo()
        assert ids.tolist() == [*own.tokenizer.encode(text, add_special_tokens=False).ids, token_store.END_ID] and sizes.tolist() == [len(ids)]
    assert max(sorted_lengths) < 20 and (np.diff(own.hashes.astype(object)) > 0).all()
    raw = b"good \xff\xfe bad\xc3 " + "é中".encode()
    ids, _ = own.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert ids.tolist()[:-1] == [x for w in raw.split() for x in own.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids]


@pytest.mark.parametrize("least_count", [1, 2, 3])
def test_pairs_and_places_in_one_number_or_two(least_count):
    rng = np.random.default_rng(3)
    seq = rng.integers(0, 30, 4000).astype(np.uint32)
    here = np.flatnonzero(rng.random(3999) < 0.5)
    one, two = (token_store._sorted_places(seq, here, size, least_count) for size in (30, 1 << 31))
    assert (one[1] == two[1]).all()
    kept = {}
    for p in here.tolist():
        kept.setdefault((int(seq[p]), int(seq[p + 1])), []).append(p)
    assert one[1].tolist() == [p for k in sorted(kept) if least_count == 1 or len(kept[k]) > 1 for p in kept[k]]


def test_rules_expand_alike_once_or_by_level():
    rng = np.random.default_rng(4)
    for ids in (rng.integers(0, 40, 20000), np.zeros(5000, np.int64), np.tile(rng.integers(0, 9, 64), 200)):
        shard = token_store.Shard.read(token_store.write_shard([1, None], np.append(ids, 2).astype(np.uint32), np.array([7, len(ids) - 6])))
        assert (shard.expand(shard.symbols) == np.append(ids, 2)).all()
        assert (shard._expand(shard.symbols, shard._lengths(shard.symbols)) == np.append(ids, 2)).all()
        assert (np.concatenate([shard.document(0), shard.document(1)]) == np.append(ids, 2)).all()


@pytest.mark.parametrize("bits", range(1, 33))
def test_packed_numbers_are_their_bits_in_a_row(bits):
    for n in (0, 1, 7, 8, 9, 1001):
        values = np.random.default_rng(bits).integers(0, 1 << bits, n).astype(np.uint32)
        row = "".join(f"{v:0{bits}b}" for v in values.tolist())
        raw = token_store.pack(values, bits)
        assert raw == bytes(int(row[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(row), 8))
        assert (token_store.unpack(np.frombuffer(raw, np.uint8), n, bits) == values).all()
