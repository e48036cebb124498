"""Token alignment against plain loops over bytes."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from regolith.llm import alignment as al

public_tokenizers = pytest.importorskip("public_tokenizers")

WORDS = ["the", "quick", "brown", "über", "ñandú", "x", "don't", "12,345", "日本語", "é", "🙂", "<|endoftext|>", "</s>", "a\tb", "\n\n", "", "internationalisation", "--", " ", "▁y", "\x00"]


def texts():
    draw = random.Random(3)
    out = [" ".join(draw.choice(WORDS) for _ in range(draw.randrange(1, 40))) for _ in range(120)]
    return [*out, "", " ", "  ", "word ", "word  ", " word", "\tword", "a\n b", "ends in space \n ", "x" * 3000, out[0], out[0], "é " * 50]


def plain(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = al._byte_of_char()
    found = []
    for i, text in rows:
        raw = (" " + (text or "")).encode()
        x = [(k, bytes(byte[c] for c in a.id_to_token(k))) for k in a.encode(raw.decode(), add_special_tokens=False).ids] if text else []
        y = [(k, bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()) for k in b.encode(text)] if text else []
        if not text or b"".join(t for _, t in x) != raw or b"".join(t for _, t in y) != raw:
            found.append((i, [], [], "", []))
            continue
        spans = []
        for side in (x, y):
            at, own = 0, []
            for k, t in side:
                own.append((at, at + len(t), k))
                at += len(t)
            spans.append(own)
        links = [(p[2], q[2]) for p in spans[0] for q in spans[1] if p[0] < q[1] and q[0] < p[1]]
        cuts = sorted({p[1] for p in spans[0]} & {q[1] for q in spans[1]})
        shown = ";".join("|".join(",".join(str(p[2]) for p in side if lo < p[1] <= hi) for side in spans) for lo, hi in zip([0, *cuts[:-1]], cuts, strict=True))
        found.append((i, spans[0], spans[1], shown, links))
    count = Counter(p for f in found for p in set(f[4]))
    best = {}
    for (p, _), c in count.items():
        best[p] = max(best.get(p, 0), c)
    return sorted(
        (i, len(x), len(y), shown.count(";") + 1 if shown else 0, len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if shown else "")
        for i, x, y, shown, links in found
    )


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "c", "d") for i, t in rows], "doc_id long, text string, row_no string, codes string").repartition(3)
    return sorted(tuple(r) for r in al.Alignment(df, **more).documents().select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


@pytest.fixture(scope="module")
def rows():
    return [*enumerate(texts()), (1000, None)]


def test_against_loops(spark, rows):
    want = plain(rows)
    assert sum(w[4] for w in want) > 1000 and run(spark, rows) == want


@pytest.mark.parametrize("names", [("PACK", 300, "BLOCK", 64, "SLICE", 50), ("CACHE", 40, "PAIRS", 20, "BLOCK", 200)])
def test_small_bounds_change_nothing(rows, names):
    """In this process, as workers do not see what is set here: the first pass and the look-up by hand."""
    import pyarrow as pa

    from regolith.llm.text import buffers, slices

    saved = {n: getattr(al, n) for n in names[::2]}
    try:
        for n, v in zip(names[::2], names[1::2], strict=True):
            setattr(al, n, v)
        own = al.Aligner(*al.default_paths())
        buf, offs = buffers(pa.array([t for _, t in rows]))
        counts, names_, pairs = [], [], []
        for i, j in slices(offs, al.PACK):
            c, d, of, codes, times = al.document_rows(own, buf, offs[i : j + 1])
            counts += c.tolist()
            names_ += d
            pairs += list(zip((of + i).tolist(), codes.tolist(), times.tolist(), strict=True))
        documents = Counter(c for _, c, _ in pairs)
        best = {}
        for c, m in documents.items():
            best[c // own.base] = max(best.get(c // own.base, 0), m)
        got = []
        for k, (i, _) in enumerate(rows):
            mine = [(c, t) for of, c, t in pairs if of == k]
            got.append((i, *counts[k], sum(t for c, t in mine if documents[c] == best[c // own.base]), sum(t * documents[c] for c, t in mine), names_[k]))
        assert sorted(got) == plain(rows)
    finally:
        for n, v in saved.items():
            setattr(al, n, v)


def test_slices_and_pieces(spark, rows, monkeypatch):
    monkeypatch.setattr(al, "SLICE", 40)  # read by the driver
    assert run(spark, rows) == plain(rows)


def test_whole_texts_as_chunks(rows):
    """Without cuts at spaces a text is one chunk: the same groups."""
    import pyarrow as pa

    from regolith.llm.text import buffers

    own, whole = al.Aligner(*al.default_paths()), al.Aligner(*al.default_paths())
    assert own.by_chunk
    whole.by_chunk = False
    buf, offs = buffers(pa.array([t for _, t in rows]))
    for x, y in zip(al.document_rows(own, buf, offs), al.document_rows(whole, buf, offs), strict=True):
        assert list(x) == list(y) if isinstance(x, list) else np.array_equal(x, y)


def test_equal_half_hashes_are_told_apart():
    own = al.Aligner(*al.default_paths())
    b = np.frombuffer(b" one two one", np.uint8)
    starts, ends = np.array([0, 4, 8]), np.array([4, 8, 12])
    number = own.numbers(b, starts, ends)
    own._checks.all[:] ^= np.uint64(1)  # as if other chunks had these hashes
    again = own.numbers(b, starts, ends)
    shown = lambda k: own.shown[own.shown_at[k] : own.shown_at[k + 1]].tobytes()
    assert number[0] == number[2] and shown(again[0]) == shown(again[2]) != shown(again[1])


def test_bits():
    draw = np.random.default_rng(1)
    flags = draw.random(300) < 0.3
    bits = al.Bits(300, np.flatnonzero(flags))
    assert bits.rank(np.arange(300)).tolist() == [int(flags[:k].sum()) for k in range(300)]
    assert bits.places().tolist() == np.flatnonzero(flags).tolist()


def test_groups_are_real_spans(spark):
    text = "naïve tokenisation"
    got = sorted(tuple(r) for r in al.groups(spark.createDataFrame([(5, text), (6, None), (7, "")], "doc_id long, text string")).collect())
    assert {r[0] for r in got} == {5} and got[0][2] == 0 and got[-1][3] == len((" " + text).encode())
    own = al.Aligner(*al.default_paths())
    for _, _, lo, hi, a, b in got:
        assert b"".join(own.a.spelling[k] for k in a) == b"".join(own.b.spelling[k] for k in b) == (" " + text).encode()[lo:hi]


def test_empty_table(spark):
    assert run(spark, [])== [] and os.path.exists(al.default_paths()[0])
