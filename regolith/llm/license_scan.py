"""License scan by fuzzy search for short notices.

Two kinds of findings come together.  Base phrases are places where their words
stand consecutively, found by comparing word hashes.  The method's own notices
may be misspelt: a notice of m characters may have k = min(4, m // 10) edits
(1 at least).  It is split into k + 1 pieces, of which one must stand unedited
in any such occurrence (pigeonhole); an automaton over all pieces finds these
seeds in one pass.  From a seed's place the regex library matches the notice's
two sides with bounded errors, backwards to its left and forwards to its right,
which gives the edits and the span.  Of overlapping spans the one with the
fewest edits stays (then the longest, the first, the smallest label); a seed
whose span is overlapped is matched again in the room that is left to it.

Texts are lower-cased in A-Z and read whole.  Spans count characters.  A null
or empty text has no words, no labels and score 0; the score is 1 for a base
phrase or an unedited notice, else 1 - edits / length of the best notice.
Repeated rows give repeated results; an empty table an empty one; further
columns are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.llm.store import table
from regolith.llm.text import ALNUM, LOWER, Words, buffers, slices, streamed, words_of

# Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: The method's notices and labels.
NOTICES = (
    ("licensed under the apache license, version 2.0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
    ("licensed under the gnu general public license, version 3", "gpl-3.0"),
    ("licensed under the gnu general public license, version 2", "gpl-2.0"),
    ("licensed under cc by-nc 4.0", "cc-by-nc-4.0"),
    ("licensed under cc by-sa 4.0", "cc-by-sa-4.0"),
    ("licensed under cc by 4.0", "cc-by-4.0"),
    ("redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    ("subject to the terms of the mozilla public license, v. 2.0", "mpl-2.0"),
    ("this work is released into the public domain", "public-domain"),
    ("all rights are reserved", "reserved-notice"),
)


def edits_allowed(notice: str) -> int:
    return max(1, min(4, len(notice) // 10))


def pieces(notice: str) -> list[tuple[int, str]]:
    """(offset, piece): one more piece than edits allowed, of about equal length."""
    n = edits_allowed(notice) + 1
    cuts = [len(notice) * k // n for k in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@cache
def _automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    seeds: dict[str, list[tuple[int, int]]] = {}
    for k, (notice, _) in enumerate(NOTICES):
        for at, piece in pieces(notice):
            seeds.setdefault(piece, []).append((k, at))
    for piece, owners in seeds.items():
        automaton.add_word(piece, (len(piece), tuple(owners)))
    automaton.make_automaton()
    return automaton


@cache
def _side(part: str, most: int, back: bool):
    """Fuzzy pattern of a notice's side: the match with the fewest edits, read backwards where it ends at the seed."""
    import regex

    return regex.compile(f"(?{'r' if back else ''}bs)(?:{regex.escape(part, special_only=False)}){{e<={most}}}")


def _side_match(text: str, part: str, most: int, lo: int, hi: int, back: bool) -> tuple[int, int] | None:
    """Fewest edits with which the side fits text that ends at hi (begins at lo), and how much text it takes then, the most possible."""
    if not part:
        return 0, 0
    found = _side(part, most, back).match(text, max(lo, hi - len(part) - most) if back else lo, hi if back else min(hi, lo + len(part) + most))
    if found is None:
        return None
    edits = sum(found.fuzzy_counts)
    for size in range(min(len(part) + edits, hi - lo), found.end() - found.start(), -1):
        if _side(part, edits, back).fullmatch(text, hi - size if back else lo, hi if back else lo + size):
            return edits, size
    return edits, found.end() - found.start()


def _match(text: str, seed: tuple[int, int, int, int], lo: int, hi: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of a seed's notice within text[lo:hi], or None beyond its bound."""
    at, end, k, offset = seed
    notice, most = NOTICES[k][0], edits_allowed(NOTICES[k][0])
    before = _side_match(text, notice[:offset], most, lo, at, True)
    if before is None:
        return None
    after = _side_match(text, notice[offset + end - at :], most - before[0], end, hi, False)
    return None if after is None else (before[0] + after[0], at - before[1], end + after[1])


def find_notices(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, edits, notice) of a lower-cased text, overlaps resolved, in order."""
    queue: list[tuple] = []

    def push(seed, lo, hi):
        if (m := _match(text, seed, lo, hi)) is not None:
            heapq.heappush(queue, (m[0], m[1] - m[2], m[1], NOTICES[seed[2]][1], m[2], seed))

    for last, (size, owners) in _automaton().iter(text):
        for k, offset in owners:
            push((last - size + 1, last + 1, k, offset), 0, len(text))
    starts, ends, kept = [], [], []  # of the spans taken, in order
    while queue:
        edits, _, start, _, end, seed = heapq.heappop(queue)
        i = bisect_left(starts, seed[1])  # spans that begin before the seed's end
        lo, hi = ends[i - 1] if i else 0, starts[i] if i < len(starts) else len(text)
        if seed[0] < lo:
            continue
        if start < lo or end > hi:
            push(seed, lo, hi)
            continue
        starts.insert(i, start)
        ends.insert(i, end)
        kept.append((start, end, edits, seed[2]))
    return sorted(kept)


def base_places(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all places of base phrases: the text, the word of the text it starts at, the phrase."""
    doc = w.doc_of()
    out = []
    for k, (phrase, _) in enumerate(BASE):
        own = words_of(*buffers(pa.array([phrase])), ALNUM)
        h, n = own.hashes, len(w.hashes) - len(own.hashes) + 1
        if n <= 0:
            continue
        fits = np.ones(n, bool)
        for j, (x, check) in enumerate(zip(h, own.checks, strict=True)):
            fits &= (w.hashes[j : j + n] == x) & (w.checks[j : j + n] == check)
        at = np.flatnonzero(fits)
        at = at[doc[at] == doc[at + len(h) - 1]]
        out.append(np.stack([doc[at], at - w.offsets[doc[at]], np.full(len(at), k)]))
    return tuple(np.concatenate(out, 1)) if out else (np.empty(0, np.int64),) * 3


_SPAN = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))


def _scan(batches):
    for batch in streamed(batches):
        buf, offs = buffers(batch.column("text"))
        for i, j in slices(offs):
            w = words_of(buf, offs[i : j + 1], ALNUM)
            doc, word, phrase = base_places(w)
            rows = []
            by_doc: dict[int, list[tuple[int, int]]] = {}
            for d, x, k in zip(doc.tolist(), word.tolist(), phrase.tolist(), strict=True):
                by_doc.setdefault(d, []).append((x, k))
            for d in range(j - i):
                text = LOWER[buf[offs[i + d] : offs[i + d + 1]]].tobytes().decode("utf-8", "replace")
                found = find_notices(text)
                base = by_doc.get(d, [])
                own = {BASE[k][1] for _, k in base}
                labels = own | {NOTICES[f[3]][1] for f in found}
                score = max([1.0 if base else 0.0, *(1 - f[2] / len(NOTICES[f[3]][0]) for f in found)])
                rows.append((int(w.offsets[d + 1] - w.offsets[d]), len(base), min((x for x, _ in base), default=None), max((x for x, _ in base), default=None), ",".join(sorted(own)), ",".join(sorted(labels)), score, [{"label": NOTICES[f[3]][1], "start": f[0], "end": f[1], "edits": f[2]} for f in found]))
            columns = zip(*rows, strict=True) if rows else [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPAN]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,edits:long>>")


def op5_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))


def license_base(spark, sf_dir):
    """The columns of op5_license_scan that its base phrases alone decide."""
    return op5_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES = {"op5_license_scan": op5_license_scan, "license_base": license_base}
_PHRASES = ", ".join(f"(['{phrase.replace(' ', chr(39) + ', ' + chr(39))}'], '{label}')" for phrase, label in BASE)
SQL = {
    "license_base": rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
p as (select * from (values {_PHRASES}) t(phrase, label)),
h as (select doc_id, label, i - 1 as i from (select doc_id, w, phrase, label, unnest(range(1, len(w) - len(phrase) + 2)) as i from d, p) where w[i:i + len(phrase) - 1] = phrase),
f as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels from h group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(base_labels, '') as base_labels
from d left join f using (doc_id)"""
}
