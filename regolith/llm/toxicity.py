"""Toxicity by a convolutional text classifier, trained in numpy.

A word is the sum of hashed embeddings of itself and its affixes, so that a
new form of a known stem is recognised.  Filters of several widths run over
the words; their largest values over the whole text, whatever its length, feed
a logistic output.  The embeddings start from smoothed log odds and are trained
with the filters by gradient descent.  A part of the training rows is held
back to calibrate a threshold for each language; a text's language is guessed
from its words alone, by the words that are usual in one language of the
training rows and rare in the others.  A score is the output moved so that its
language's threshold lies at THRESHOLD.

The model is fitted in one task of the cluster on a bounded sample: about
TRAIN_ROWS labelled rows of either label, texts of over TRAIN_CHARS characters
left out (of the fitting only).  Equal texts of one label are learned from
once.  Whole texts are scored.  A null or empty text has the score of a text
without any signal.  Null labels or ids are not learned from; of an id with
contradicting labels both are; documents that share an id share its label.
Repeated rows are scored alike; with no labels at all every score is 0.
Without a column of languages there is one threshold.  Further columns are not
read by score, and remove_toxic returns them as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.llm.features import affix, distinct
from regolith.llm.sampling import bounded_sample, fit_in_a_task, remainder
from regolith.llm.store import table
from regolith.llm.text import ALNUM, Words, buffers, slices, streamed, words_of

THRESHOLD = 0.7
TRAIN_ROWS = 2500
TRAIN_CHARS = 20_000
WIDTHS = (1, 2, 3)
FILTERS = 8
DIM = 8
BUCKETS = 1 << 16
#: Texts that training sees at least, in whole epochs (6 to 30).
TRAIN_STEPS = 30_000
#: A language's usual words: in this share of its rows, and this many times as often as in any other language's.
USUAL_SHARE, USUAL_TIMES, USUAL_WORDS, USUAL_ROWS = 0.2, 4.0, 40, 30


def word_features(w: Words, which: np.ndarray) -> np.ndarray:
    """(words, kinds) buckets; a bucket of -1 stands for no feature."""
    kinds = [w.hashes[which]] + [affix(w, which, k, False) for k in (3, 4, 5, 6)] + [affix(w, which, 4, True)]
    return np.stack([np.where(h == 0, -1, (h % np.uint64(BUCKETS)).astype(np.int64)) for h in kinds], 1).astype(np.int32)


def usual_words(w: Words, langs: list) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, and for each its usual words: sorted hashes with the number of their language."""
    names, counts = np.unique(np.array([x for x in langs if x is not None], object).astype(str), return_counts=True) if any(x is not None for x in langs) else (np.empty(0, object), np.empty(0, int))
    names = [x for x, n in zip(names.tolist(), counts.tolist(), strict=True) if n >= USUAL_ROWS]
    if len(names) < 2:
        return names, np.empty(0, np.uint64), np.empty(0, np.int64)
    number_of = {x: k for k, x in enumerate(names)}
    lang = np.array([number_of.get(x, -1) for x in langs])
    known, number = np.unique(w.hashes, return_inverse=True)
    seen = np.unique(w.doc_of() * len(known) + number)  # each word once a text
    seen = seen[lang[seen // len(known)] >= 0]
    share = np.zeros((len(names), len(known)))
    np.add.at(share, (lang[seen // len(known)], seen % len(known)), 1)
    share /= np.array([(lang == k).sum() for k in range(len(names))])[:, None]
    hashes, owner = [], []
    for k in range(len(names)):
        rest = np.delete(share, k, 0).max(0)
        fit = np.flatnonzero((share[k] >= USUAL_SHARE) & (share[k] >= USUAL_TIMES * rest))
        fit = fit[np.argsort(-(share[k] - rest)[fit], kind="stable")][:USUAL_WORDS]
        hashes.append(known[fit])
        owner.append(np.full(len(fit), k))
    hashes, owner = np.concatenate(hashes), np.concatenate(owner)
    order = np.argsort(hashes)
    return names, hashes[order], owner[order]


class Sequences:
    """Texts as numbers of distinct words, each followed by enough blanks for the widest filter."""

    def __init__(self, w: Words):
        n, pad = len(w.offsets) - 1, max(WIDTHS) - 1
        first, number = distinct(w)
        self.features = word_features(w, first)
        doc = w.doc_of()
        self.first, self.number, self.doc, self.n = w.hashes[first], number, doc, n
        self.blank = len(first)
        self.starts = w.offsets[:-1] + pad * np.arange(n)
        self.seq = np.full(len(number) + pad * n, self.blank, np.int64)
        self.seq[np.arange(len(number)) + pad * doc] = number


class Network:
    def __init__(self, rng: np.random.Generator):
        self.table = np.zeros((BUCKETS + 1, DIM), np.float32)  # the last row is that of no feature
        self.table[:-1] = rng.normal(0, 0.02, (BUCKETS, DIM))
        self.kernels = [rng.normal(0, 0.15, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for k in self.kernels:
            k[:, 0, : FILTERS // 2] += 0.6 / len(k)
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = np.full(len(WIDTHS) * FILTERS, 0.2, np.float32)
        self.out_bias = np.float32(-2)
        self.languages: list[str] = []
        self.usual, self.usual_of = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.thresholds = np.zeros(1)  # of each language and, last, of texts of none

    def guess(self, s: Sequences) -> np.ndarray:
        """For each text the language with most usual words; the number after the last where there are none."""
        many = len(self.languages) + 1
        if not len(self.usual) or not len(s.number):
            return np.full(s.n, many - 1)
        spot = np.minimum(np.searchsorted(self.usual, s.first), len(self.usual) - 1)
        lang = np.where(self.usual[spot] == s.first, self.usual_of[spot], many - 1)[s.number]
        counts = np.bincount(s.doc * many + lang, minlength=s.n * many).reshape(s.n, many)[:, :-1]
        return np.where(counts.max(1) > 0, counts.argmax(1), many - 1)

    def words(self, features: np.ndarray) -> np.ndarray:
        e = np.zeros((len(features) + 1, DIM), np.float32)
        for k in range(features.shape[1]):
            e[:-1] += self.table[features[:, k]]
        return e

    def convolve(self, e: np.ndarray, seq: np.ndarray, k: int) -> np.ndarray:
        n, out = len(seq), None
        for j, kernel in enumerate(self.kernels[k]):
            part = (e @ kernel)[seq[j:]] if j else (e @ kernel)[seq]
            if out is None:
                out = part
            else:
                out[: n - j] += part
        out += self.bias[k]
        out[seq == len(e) - 1] = 0
        return np.maximum(out, 0, out=out)

    def pooled(self, s: Sequences) -> np.ndarray:
        e = self.words(s.features)
        return np.concatenate([np.maximum.reduceat(self.convolve(e, s.seq, k), s.starts, axis=0) for k in range(len(WIDTHS))], 1)

    def raw(self, s: Sequences) -> np.ndarray:
        if not len(s.starts):
            return np.zeros(0)
        return self.pooled(s) @ self.out + self.out_bias

    def scores(self, w: Words) -> np.ndarray:
        s = Sequences(w)
        z = self.raw(s) - self.thresholds[self.guess(s)] + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -50, 50)))


def _start_from_odds(net: Network, s: Sequences, y: np.ndarray) -> None:
    """First dimension: smoothed log odds of a feature, counted once a text."""
    bounds = np.append(s.starts, len(s.seq))
    counts = np.zeros((2, BUCKETS + 1))
    for d in range(len(y)):
        own = np.unique(s.seq[bounds[d] : bounds[d + 1]])
        counts[int(y[d]), np.unique(s.features[own[own < s.blank]])] += 1
    odds = np.log((counts[1] + 1) / (y.sum() + 2)) - np.log((counts[0] + 1) / (len(y) - y.sum() + 2))
    seen = counts.sum(0)
    net.table[:, 0] = np.clip(odds * seen / (seen + 8), -0.5, 4)
    net.table[-1] = 0


def _train(net: Network, s: Sequences, y: np.ndarray, rng: np.random.Generator, epochs: int) -> None:
    """AdaGrad on log loss, labels weighed to balance; gradients flow through the winners of the pooling only."""
    rate, batch = 0.05, 64
    bounds = np.append(s.starts, len(s.seq))
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    weight = np.minimum(weight, 4)
    memory = [np.full_like(net.table, 1e-2)] + [np.full_like(k, 1e-2) for k in net.kernels] + [np.full_like(net.bias, 1e-2), np.full_like(net.out, 1e-2)]
    out_memory = 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            docs = order[at : at + batch]
            parts = [s.seq[bounds[d] : bounds[d + 1]] for d in docs]
            seq = np.concatenate(parts)
            own, local = np.unique(seq, return_inverse=True)
            blank = own[-1] == s.blank
            own_words = own[:-1] if blank else own
            e = net.words(s.features[own_words])
            ends = np.cumsum([len(p) for p in parts])
            begins = ends - [len(p) for p in parts]
            best = np.zeros((len(docs), len(WIDTHS), FILTERS), np.int64)
            top = np.zeros((len(docs), len(WIDTHS), FILTERS), np.float32)
            for k in range(len(WIDTHS)):
                c = net.convolve(e, local, k)
                for i, (b, f) in enumerate(zip(begins, ends, strict=True)):
                    best[i, k] = c[b:f].argmax(0) + b
                    top[i, k] = c[best[i, k], np.arange(FILTERS)]
            flat = top.reshape(len(docs), -1)
            p = 1 / (1 + np.exp(-np.clip(flat @ net.out + net.out_bias, -30, 30)))
            g = ((p - y[docs]) * weight[docs] / len(docs)).astype(np.float32)
            d_top = (g[:, None] * net.out[None]).reshape(top.shape) * (top > 0)
            grads = [None, *[np.zeros_like(k) for k in net.kernels], d_top.sum(0), flat.T @ g + 1e-4 * net.out]
            d_word = np.zeros_like(e)
            for k, w in enumerate(WIDTHS):
                for j in range(w):
                    ids = local[np.minimum(best[:, k] + j, len(local) - 1)]  # (docs, filters)
                    grads[1 + k][j] = np.einsum("dfe,df->ef", e[ids], d_top[:, k])
                    np.add.at(d_word, ids.ravel(), (d_top[:, k][:, :, None] * net.kernels[k][j].T[None]).reshape(-1, DIM))
            touched = np.flatnonzero(np.abs(d_word[: len(own_words)]).sum(1))
            rows = s.features[own_words[touched]]
            flat_rows, flat_grad = rows.ravel(), np.repeat(d_word[touched], rows.shape[1], 0)
            flat_grad, flat_rows = flat_grad[flat_rows >= 0], flat_rows[flat_rows >= 0]
            hit, where = np.unique(flat_rows, return_inverse=True)
            total = np.zeros((len(hit), DIM), np.float32)
            np.add.at(total, where, flat_grad)
            memory[0][hit] += total**2
            net.table[hit] -= rate * total / np.sqrt(memory[0][hit])
            for m, param, grad in zip(memory[1:], [*net.kernels, net.bias, net.out], grads[1:], strict=True):
                m += grad**2
                param -= rate * grad / np.sqrt(m)
            out_memory += float(g.sum()) ** 2
            net.out_bias -= np.float32(rate * float(g.sum()) / out_memory**0.5)


def _best_threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The raw output, half-way between two rows, at which F1 is largest; of equal ones the one with the widest gap."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    gap = np.append(z[:-1] - z[1:], 1.0)
    k = max(range(len(y)), key=lambda i: (round(f1[i], 6), gap[i]))
    return float(z[k] - min(gap[k], 4.0) / 2)


def fit(texts: pa.Array, labels: np.ndarray, langs: list | None = None, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    net = Network(rng)
    y = np.asarray(labels, np.int64)
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        net.out_bias = np.float32(-50 if not len(y) or y.max() == 0 else 50)
        return net
    held = rng.permutation(len(y)) % 4 == 0
    buf, offs = buffers(texts)
    whole = words_of(buf, offs, ALNUM)
    net.languages, net.usual, net.usual_of = usual_words(whole, langs if langs is not None else [None] * len(y))
    s = Sequences(whole)
    pick = np.flatnonzero(~held)
    part = _subset(s, pick)
    _start_from_odds(net, part, y[pick])
    _train(net, part, y[pick], rng, max(6, min(30, TRAIN_STEPS // max(1, len(pick)))))
    rest = np.flatnonzero(held)
    z, lang = net.raw(_subset(s, rest)), net.guess(s)[rest]
    everywhere = _best_threshold(z, y[rest]) if y[rest].any() else 0.0
    net.thresholds = np.full(len(net.languages) + 1, everywhere)
    for k in range(len(net.thresholds)):
        own = lang == k
        if own.sum() >= 40 and y[rest][own].sum() >= 10:
            net.thresholds[k] = _best_threshold(z[own], y[rest][own])
    return net


def _subset(s: Sequences, docs: np.ndarray) -> Sequences:
    out = object.__new__(Sequences)
    bounds = np.append(s.starts, len(s.seq))
    parts = [s.seq[bounds[d] : bounds[d + 1]] for d in docs]
    out.features, out.blank = s.features, s.blank
    out.seq = np.concatenate(parts) if parts else np.empty(0, np.int64)
    out.starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.int64) if parts else np.empty(0, np.int64)
    return out


def _fit_table(sample: pa.Table | None) -> Network:
    if sample is None:
        return fit(pa.array([], pa.string()), np.empty(0, np.int64))
    return fit(sample.column("text").combine_chunks(), sample.column("y").to_numpy(), sample.column("lang").to_pylist())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang", rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Network:
    """Fits the network on labelled rows whose crc32(id) mod 3 is not 1."""
    known = labels.select(F.col(id_col).cast("long").alias("l_id"), F.col(label_col).cast("int").alias("y")).filter("l_id is not null and y in (0, 1)").filter(remainder(F.col("l_id"), 3) != 1)
    picked = bounded_sample(known, "y", "l_id", rows).select("l_id", "y")  # at most 4 * rows short rows
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    found = docs.filter(F.length(text_col) <= chars).select(F.col(id_col).cast("long").alias("l_id"), F.col(text_col).alias("text"), lang.alias("lang")).join(F.broadcast(picked), "l_id")
    once = found.groupBy("y", F.xxhash64("text").alias("hash__")).agg(F.min(F.struct("text", "lang")).alias("row__")).select("y", "hash__", "row__.*")
    return fit_in_a_task(once.orderBy("hash__", "y").limit(4 * rows), _fit_table)


def score_texts(texts: pa.Array, net: Network) -> np.ndarray:
    buf, offs = buffers(texts)
    parts = [net.scores(words_of(buf, offs[i : j + 1], ALNUM)) for i, j in slices(offs)]
    return np.concatenate(parts) if parts else np.zeros(0)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    net = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))  # a few MB, fixed

    def run(batches):
        for batch in streamed(batches):
            p = score_texts(batch.column("text"), net.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    ready = docs.select(F.col(id_col).cast("long").alias("doc_id"), (remainder(F.col(id_col), 3) == 1).alias("held_out"), F.col(text_col).alias("text"))
    return ready.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def remove_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The documents that are not predicted toxic, all their columns as they were; decided where they lie."""
    net = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))

    def run(batches):
        for batch in streamed(batches):
            yield batch.filter(pa.array(score_texts(batch.column(text_col), net.value) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_toxicity": op4_toxicity}
SQL: dict[str, str] = {}
