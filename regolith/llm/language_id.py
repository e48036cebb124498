"""Language identification by a linear-chain conditional random field.

Every word of a text gets a language.  A word's features are its affixes, byte
n-grams and entries of a lexicon (the words that are frequent in the training
sample, each a feature of its own); their weights give the word's score for
each language, and learned transition weights tie neighbouring words, so that
code-switched texts come out in runs.  Forward-backward gives each word's
marginals, and a text's language is that with the largest mean marginal.

Forward-backward runs over many texts at once: the texts of a slice are sorted
by length, and step t handles the t-th word of all texts that have one.  Whole
texts are labelled: those of over CUT words in pieces that run side by side,
BATCH words at a time.  What a piece does to a message is a small matrix; these
are found first, and their products give each piece the exact messages of all
that comes before and after it.

The model is fitted in one task of the cluster on a bounded sample: about
TRAIN_ROWS documents of each language, texts of over TRAIN_CHARS characters
left out of the fitting, of documents whose crc32(id) mod 4 is not 2 and whose
language is known; equal texts of one language are learned from once, and each
word carries the document's language.  Every language of the sample is learned;
the model grows with their number.

A text that is null or has no letter is `und` with score 0, as is every text
when nothing can be learned; letters without a word in the sense of the word
pattern do not occur.  Repeated rows are labelled alike; further columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.llm.features import affix, distinct, grams
from regolith.llm.sampling import bounded_sample, fit_in_a_task, remainder
from regolith.llm.store import table
from regolith.llm.text import ALNUM, Words, buffers, ragged, slices, streamed, words_of

TRAIN_ROWS = 300
TRAIN_CHARS = 10_000
LEXICON_WORDS = 4096
LEXICON_LEAST = 20
BUCKETS = 1 << 15
SEGMENT = 64
CUT, BATCH = 4096, 1 << 19
_U = np.uint64


class Crf:
    """Weights: of features (bucket, language), of transitions, and the lexicon (sorted word hashes)."""

    def __init__(self, languages: list[str], lexicon: np.ndarray):
        n = len(languages)
        self.languages, self.lexicon = languages, lexicon
        self.weights = np.zeros((BUCKETS + len(lexicon) + 1, n), np.float32)
        self.transitions = np.zeros((n, n))
        self.first = np.zeros(n)

    def features(self, w: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of words, word by word, and the bounds of each word's."""
        columns = [affix(w, which, k, end) for k in (1, 2, 3, 4) for end in (False, True)]
        fixed = np.stack([np.where(h == 0, BUCKETS + len(self.lexicon), (h % _U(BUCKETS)).astype(np.int64)) for h in columns], 1)
        if len(self.lexicon):
            spot = np.minimum(np.searchsorted(self.lexicon, w.hashes[which]), len(self.lexicon) - 1)
            entry = np.where(self.lexicon[spot] == w.hashes[which], BUCKETS + spot, BUCKETS + len(self.lexicon))
            fixed = np.concatenate([fixed, entry[:, None]], 1)
        runs = [grams(w, which, k) for k in (2, 3)]
        many = np.full(len(which), fixed.shape[1]) + sum(m for _, m in runs)
        bounds = np.concatenate([[0], np.cumsum(many)])
        out = np.empty(bounds[-1], np.int64)
        at = bounds[:-1].copy()
        for k in range(fixed.shape[1]):
            out[at] = fixed[:, k]
            at += 1
        for h, m in runs:
            begin = np.cumsum(m) - m
            out[np.arange(len(h)) + np.repeat(at - begin, m)] = (h % _U(BUCKETS)).astype(np.int64)
            at += m
        return out, bounds

    def emissions(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Score of each word for each language, scaled by the root of its number of features."""
        if len(bounds) == 1:
            return np.zeros((0, len(self.languages)), np.float32)
        total = np.add.reduceat(self.weights[features], bounds[:-1], axis=0)
        return total / np.sqrt(np.diff(bounds))[:, None].astype(np.float32)


class Steps:
    """Words of many texts in the order of steps: first all first words (longest text first), then all second words."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        size = lengths[self.order]
        steps = int(size[0]) if len(size) else 0
        self.live = np.searchsorted(-size, -np.arange(steps), "left")
        self.begin = np.concatenate([[0], np.cumsum(self.live)])
        rank = np.empty(len(lengths), np.int64)
        rank[self.order] = np.arange(len(lengths))
        total = int(lengths.sum())
        step = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.place = self.begin[step] + np.repeat(rank, lengths)  # of each word in text order


def forward_backward(crf: Crf, scores: np.ndarray, steps: Steps, heads: np.ndarray | None = None, tails: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward and backward messages in step order; their normalised product is the marginal.

    heads and tails: of each text what comes in before its first word and after its last, where it is a piece of a longer one.
    """
    n = len(crf.languages)
    potential = np.exp(scores - scores.max(1, keepdims=True))
    move = np.exp(crf.transitions).astype(np.float32)
    start = np.exp(crf.first).astype(np.float32) if heads is None else heads[steps.order[: steps.live[0]]] if len(steps.live) else None
    alpha, beta = np.empty_like(potential), np.ones_like(potential)
    if tails is not None:
        for t, live in enumerate(steps.live):  # a text's last word is where it is live no more
            after = steps.live[t + 1] if t + 1 < len(steps.live) else 0
            beta[steps.begin[t] + after : steps.begin[t] + live] = tails[steps.order[after:live]]
    total = np.ones((n, 1), np.float32)
    for t, live in enumerate(steps.live):
        a, b = steps.begin[t], steps.begin[t] + live
        x = (alpha[steps.begin[t - 1] : steps.begin[t - 1] + live] @ move if t else start) * potential[a:b]
        x /= x @ total
        alpha[a:b] = x
    back = move.T.copy()
    for t in range(len(steps.live) - 2, -1, -1):
        live = steps.live[t + 1]
        a, c = steps.begin[t], steps.begin[t + 1]
        x = (potential[c : c + live] * beta[c : c + live]) @ back
        x /= x @ total
        beta[a : a + live] = x
    return alpha, beta


def transfers(crf: Crf, scores: np.ndarray, steps: Steps) -> np.ndarray:
    """Of each text (none empty) the matrix that takes a message to its first word into that of its last, up to a factor."""
    n = len(crf.languages)
    potential = np.exp(scores - scores.max(1, keepdims=True))
    move = np.exp(crf.transitions).astype(np.float32)
    x = np.tile(np.eye(n, dtype=np.float32), (len(steps.order), 1, 1))
    for t, live in enumerate(steps.live):
        a = steps.begin[t]
        y = (x[:live] @ move if t else x[:live]) * potential[a : a + live, None, :]
        x[:live] = y / y.sum((1, 2), keepdims=True)
    out = np.empty_like(x)
    out[steps.order] = x
    return out


def chained(crf: Crf, matrices: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Heads and tails of pieces from their matrices; text: which text each belongs to, pieces in order."""
    n = len(crf.languages)
    move = np.exp(crf.transitions).astype(np.float32)
    heads, tails = np.empty((len(text), n), np.float32), np.ones((len(text), n), np.float32)
    new = np.diff(text, prepend=-1) != 0
    for k in range(len(text)):
        heads[k] = np.exp(crf.first) if new[k] else h
        h = heads[k] @ matrices[k] @ move
        h /= h.sum()
    for k in range(len(text) - 1, 0, -1):
        if not new[k]:
            v = move @ (matrices[k] @ tails[k])
            tails[k - 1] = v / v.sum()
    return heads, tails


def fit(texts: pa.Array, langs: list[str], epochs: int = 6, seed: int = 11) -> Crf | None:
    """Gradient descent (AdaGrad) on the conditional log likelihood of segments of SEGMENT words; all words of all texts are used."""
    names = sorted({str(x) for x in langs})
    w = words_of(*buffers(texts), ALNUM)
    if not names or not len(w.hashes):
        return None
    label_of = {x: i for i, x in enumerate(names)}
    y_doc = np.array([label_of.get(x, -1) for x in langs])
    hashes, seen = np.unique(w.hashes, return_counts=True)
    often = np.argsort(-seen, kind="stable")[:LEXICON_WORDS]
    crf = Crf(names, np.sort(hashes[often][seen[often] >= LEXICON_LEAST]))
    first, number = distinct(w)
    features, bounds = crf.features(w, first)
    sizes = np.diff(bounds)
    doc = w.doc_of()
    usable = y_doc[doc] >= 0
    inside = np.arange(len(doc)) - w.offsets[doc]
    new = np.flatnonzero(usable & (inside % SEGMENT == 0))
    ends = np.minimum(new + SEGMENT, w.offsets[doc[new] + 1])
    rng = np.random.default_rng(seed)
    n = len(names)
    memory, t_memory, f_memory = np.full_like(crf.weights, 1e-3), np.full((n, n), 1e-3), np.full(n, 1e-3)
    rate = 0.3
    eye = np.eye(n, dtype=np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(new))
        for at in range(0, len(order), 256):
            segs = order[at : at + 256]
            lengths = ends[segs] - new[segs]
            words = np.concatenate([np.arange(a, b) for a, b in zip(new[segs], ends[segs], strict=True)])
            own, local = np.unique(number[words], return_inverse=True)
            feats = np.concatenate([features[bounds[k] : bounds[k + 1]] for k in own])
            b = np.concatenate([[0], np.cumsum(sizes[own])])
            e = crf.emissions(feats, b)
            steps = Steps(lengths)
            scores = np.empty((len(words), n), np.float32)
            scores[steps.place] = e[local]
            alpha, beta = forward_backward(crf, scores, steps)
            gamma = alpha * beta
            gamma /= gamma.sum(1, keepdims=True)
            truth = np.empty(len(words), np.int64)
            truth[steps.place] = np.repeat(y_doc[doc[new[segs]]], lengths)
            g = gamma - eye[truth]
            d_word = np.zeros((len(own), n), np.float32)
            np.add.at(d_word, local, g[steps.place])
            d_word /= np.sqrt(sizes[own])[:, None].astype(np.float32)
            spread = np.repeat(d_word, sizes[own], 0)
            hit, where = np.unique(feats, return_inverse=True)
            total = np.stack([np.bincount(where, spread[:, k], len(hit)) for k in range(n)], 1) / len(segs)
            total += 1e-5 * crf.weights[hit]
            memory[hit] += total**2
            crf.weights[hit] -= rate * total / np.sqrt(memory[hit])
            # expected minus seen transitions
            potential = np.exp(scores - scores.max(1, keepdims=True))
            move = np.exp(crf.transitions)
            d_move = np.zeros((n, n))
            for t in range(1, len(steps.live)):
                live, a, c = steps.live[t], steps.begin[t - 1], steps.begin[t]
                pair = alpha[a : a + live, :, None] * move[None] * (potential[c : c + live] * beta[c : c + live])[:, None, :]
                d_move += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            same = np.bincount(np.repeat(y_doc[doc[new[segs]]], lengths - 1), minlength=n)
            d_move[np.arange(n), np.arange(n)] -= same
            d_move = d_move / len(segs) + 1e-2 * crf.transitions
            t_memory += d_move**2
            crf.transitions -= 0.1 * d_move / np.sqrt(t_memory)
            d_first = g[: steps.live[0]].sum(0) / len(segs)
            f_memory += d_first**2
            crf.first -= 0.1 * d_first / np.sqrt(f_memory)
    crf.weights[-1] = 0
    return crf


def _fit_table(sample: pa.Table | None) -> Crf | None:
    return fit(sample.column("text").combine_chunks(), sample.column("lang").to_pylist()) if sample is not None else None


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Crf | None:
    known = docs.filter(F.col(id_col).isNotNull() & (remainder(F.col(id_col).cast("long"), 4) != 2)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    known = known.filter(F.col("lang").isNotNull() & F.length("text").between(1, chars))
    return fit_in_a_task(bounded_sample(known, "lang", "text", rows), _fit_table)


def _batches(size: np.ndarray):
    """Ranges of pieces of about BATCH words together."""
    total, at = np.cumsum(size), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(total, total[at] - size[at] + BATCH, "right")))
        yield at, to
        at = to


def label_words(crf: Crf, w: Words):
    """Batch by batch of pieces of texts: their texts and words, how many words each has, and the words' marginals."""
    first, number = distinct(w)
    parts = [crf.emissions(*crf.features(w, first[k : k + 200_000])) for k in range(0, len(first), 200_000)]
    e = np.concatenate(parts) if parts else np.zeros((0, len(crf.languages)), np.float32)
    pieces = -(-np.diff(w.offsets) // CUT)
    doc = np.repeat(np.arange(len(pieces)), pieces)
    a = w.offsets[:-1][doc] + CUT * ragged(np.zeros(len(pieces), np.int64), pieces)
    size = np.minimum(a + CUT, w.offsets[1:][doc]) - a

    def placed(which: np.ndarray):
        steps = Steps(size[which])
        scores = np.empty((int(size[which].sum()), len(crf.languages)), np.float32)
        scores[steps.place] = e[number[ragged(a[which], size[which])]]
        return steps, scores

    heads, tails = np.tile(np.exp(crf.first).astype(np.float32), (len(doc), 1)), np.ones((len(doc), len(crf.languages)), np.float32)
    long = np.flatnonzero(pieces[doc] > 1)
    if len(long):
        found = []
        for i, j in _batches(size[long]):
            steps, scores = placed(long[i:j])
            found.append(transfers(crf, scores, steps))
        heads[long], tails[long] = chained(crf, np.concatenate(found), doc[long])
    for i, j in _batches(size):
        which = np.arange(i, j)
        steps, scores = placed(which)
        alpha, beta = forward_backward(crf, scores, steps, heads[which], tails[which])
        alpha *= beta
        alpha /= alpha.sum(1, keepdims=True)
        yield doc[which], ragged(a[which], size[which]), size[which], alpha[steps.place]


def _without_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Texts with no letter: those of ASCII by a table, the few others by Python."""
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = True
    out = np.zeros(len(offs) - 1, bool)
    for i in range(len(out)):
        b = buf[offs[i] : offs[i + 1]]
        if not letter[b[:256]].any() and not letter[b].any():
            out[i] = not any(c.isalpha() for c in b.tobytes().decode("utf-8", "replace"))
    return out


def predict_texts(texts: pa.Array, crf: Crf | None) -> tuple[list, np.ndarray, np.ndarray]:
    """Language, its mean marginal, and the number of places where the language of neighbouring words changes."""
    buf, offs = buffers(texts)
    n = len(offs) - 1
    lang, score, switches = ["und"] * n, np.zeros(n), np.zeros(n, np.int64)
    if crf is None:
        return lang, score, switches
    for i, j in slices(offs):
        w = words_of(buf, offs[i : j + 1], ALNUM)
        sizes = np.diff(w.offsets)
        some = np.flatnonzero(sizes)
        if not len(some):
            continue
        total, word = np.zeros((j - i, len(crf.languages))), np.empty(len(w.hashes), np.int32)
        for doc, place, many, p in label_words(crf, w):
            np.add.at(total, doc, np.add.reduceat(p.astype(np.float64), np.cumsum(many) - many, axis=0))
            word[place] = p.argmax(1)
        mean = total[some] / sizes[some][:, None]
        best = mean.argmax(1)
        for d, k in zip(some.tolist(), best.tolist(), strict=True):
            lang[i + d] = crf.languages[k]
        score[i + some] = np.clip(mean[np.arange(len(some)), best], 0, 1)
        change = np.concatenate([[0], np.cumsum(word[1:] != word[:-1])])
        switches[i + some] = change[w.offsets[1:][some] - 1] - change[w.offsets[:-1][some]]
    for d in np.flatnonzero(_without_letter(buf, offs)):
        lang[d], score[d], switches[d] = "und", 0.0, 0
    return lang, score, switches


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, switches."""
    crf = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, lang_col))  # buckets and lexicon by languages

    def run(batches):
        for batch in streamed(batches):
            lang, score, switches = predict_texts(batch.column("text"), crf.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(switches, pa.int64())], ["doc_id", "held_out", "lang_pred", "score", "switches"])

    ready = docs.select(F.col(id_col).cast("long").alias("doc_id"), (remainder(F.col(id_col), 4) == 2).alias("held_out"), F.col(text_col).alias("text"))
    return ready.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, switches long")


def op2_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op2_language_id": op2_language_id}
SQL: dict[str, str] = {}
