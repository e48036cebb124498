"""Near-duplicate removal with SetSketch registers.

A document's set holds the hashes of its distinct word 3-grams.  Its sketch has
REGISTERS registers.  Each token visits the registers in an order of its own
with values that grow by exponential spacings, so that every register sees an
exponentially distributed value of each token, and a token stops as soon as no
register of its set can fall any more: about max(n, REGISTERS * ln REGISTERS)
steps for a set of n.  A register keeps the truncated logarithm (to base BASE)
of the least value it has seen.  The sketch of a union is the registers'
maximum (`merged`), and two sets agree in a register with a probability of
about their similarity J.

1. One pass gives each document its set's size, digest and sketch; each distinct
   set is one node.
2. Registers are banded: ROWS of them make a band, and nodes with an equal band
   are a group.  At J = 0.85 a pair has no common band with a probability of
   (1 - 0.85 ** ROWS) ** (REGISTERS / ROWS), here 1.5e-9.
3. Groups are compared as in the n-gram join: each node with its group's smallest,
   then what is not yet connected in blocks of bounded size, in which no pair is
   a row.  Of two members the similarity is first estimated from both sketches
   jointly: the likelihood of the registers that are above, below and equal, with
   the set sizes known, has its maximum at the estimate.  Only pairs whose
   estimate is over MARGIN standard deviations below the threshold are left out
   (1e-9 of pairs at the threshold); all others are verified on their full sets,
   with 16 further bits of each token's hash.

So a link is lost with a probability of about 3e-9, and none is invented.

A null or empty text has an empty set and no links; a set of a shorter text is
its whole word sequence.  Nulls, repeated rows and ids, empty tables and further
columns are treated as by the n-gram join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.llm.ngram_join import Join, Portion, _digest, _marked, kept_rows, rows_wanted, shingle_sets
from regolith.llm.store import table
from regolith.llm.text import NOT_SPACE, mix, streamed, text_slices

SHINGLE, THRESHOLD = 3, 85
REGISTERS, ROWS = 512, 8
#: Registers hold 1 - log(value / RATE) to this base, between 0 and LARGEST.
BASE, RATE, LARGEST = 1.001, 20.0, 65535
#: Standard deviations of the estimate.
MARGIN = 6
_U = np.uint64
_STEP, _TURN = _U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED03)
_STEPS = np.arange(1, REGISTERS + 1, dtype=_U) * _STEP


def _spacing(tokens: np.ndarray, k: int) -> np.ndarray:
    """The k-th exponential spacing of tokens, before it is divided by the registers left."""
    u = (mix(tokens + _STEPS[k]) >> _U(11)).astype(np.float64)
    return -np.log((u + 1) / (1 << 53))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of sets of distinct tokens, one row a set."""
    least = np.full((len(sets), REGISTERS), np.inf)
    flat = least.reshape(-1)
    tokens = np.concatenate(sets) if sets else np.empty(0, _U)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    own = mix(tokens ^ _TURN)
    place, stride = (own & _U(REGISTERS - 1)).astype(np.int64), ((own >> _U(32)) | _U(1)).astype(np.int64) & (REGISTERS - 1)  # an odd stride visits all
    x = np.zeros(len(tokens))
    for k in range(REGISTERS):
        if not len(tokens):
            break
        x = x + _spacing(tokens, k) / (REGISTERS - k)
        np.minimum.at(flat, of * REGISTERS + place, x)
        live = np.flatnonzero(x < least.max(axis=1)[of])
        tokens, of, stride, x = tokens[live], of[live], stride[live], x[live]
        place = (place[live] + stride) & (REGISTERS - 1)
    with np.errstate(divide="ignore"):
        level = np.floor(1 - np.log(least / RATE) / np.log(BASE))
    return np.clip(level, 0, LARGEST).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketches of the unions."""
    return np.maximum(a, b)


def bands(registers: np.ndarray) -> np.ndarray:
    """One hash of each band of each row."""
    parts = registers.reshape(len(registers), -1, ROWS)
    h = np.broadcast_to(np.arange(parts.shape[1], dtype=_U) * _TURN, parts.shape[:2])
    for k in range(ROWS):
        h = mix(h + parts[:, :, k].astype(_U) * _STEP + _U(1))
    return h


def _differs(share: np.ndarray) -> np.ndarray:
    """The probability that a register of the union with this exclusive share is above that of the rest."""
    return -np.log1p(-np.clip(share, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def _likelihood(above: np.ndarray, below: np.ndarray, n: np.ndarray, m: int):
    """The logarithm of the likelihood of a similarity, as a function of it; it is concave."""
    u, v = n / (n + m), m / (n + m)
    equal, tiny = REGISTERS - above - below, 1e-300

    def at(j):
        up, down = _differs(u - v * j), _differs(v - u * j)
        return above * np.log(np.maximum(up, tiny)) + below * np.log(np.maximum(down, tiny)) + equal * np.log(np.maximum(1 - up - down, tiny))

    return at


def estimates(above: np.ndarray, below: np.ndarray, n: np.ndarray, m: int, steps: int = 40) -> np.ndarray:
    """The similarity of sets of n with one of m tokens, where the likelihood of `above` registers over and `below` under the other's is greatest."""
    likelihood = _likelihood(above, below, n, m)
    low, high = np.zeros(len(n)), np.minimum(n, m) / np.maximum(n, m)
    for _ in range(steps):  # thirds that cannot hold the maximum go
        a, b = low + (high - low) / 3, high - (high - low) / 3
        rises = likelihood(a) < likelihood(b)
        low, high = np.where(rises, a, low), np.where(rises, high, b)
    return (low + high) / 2


def reach(above: np.ndarray, below: np.ndarray, n: np.ndarray, m: int, floor: float) -> np.ndarray:
    """Whether the estimates are at least `floor`: whether the likelihood, being concave, still rises there."""
    likelihood = _likelihood(above, below, n, m)
    return likelihood(floor + 1e-5) >= likelihood(floor)


class SketchPortion(Portion):
    """Held sets with their sketches."""

    threshold = THRESHOLD

    def prepare(self) -> None:
        self.registers = np.stack([np.frombuffer(s[2], np.uint16) for s in self.sets])
        t = self.threshold / 100
        self.floor = t - MARGIN * np.sqrt(t * (1 - t) / REGISTERS)

    def may_link(self, fits: np.ndarray, own: tuple) -> np.ndarray:
        some = np.flatnonzero(fits)
        other = np.frombuffer(own[2], np.uint16)
        held = self.registers[some]
        fits[some[~reach((held > other).sum(axis=1), (held < other).sum(axis=1), self.sizes[some], len(own[0]), self.floor)]] = False
        return fits


def _profile(batches):
    kinds = [("doc_id", pa.int64()), ("mark", pa.binary()), ("key", pa.binary()), ("n", pa.int64()), ("more", pa.binary())]
    for batch, i, j, w in text_slices(batches, "text", NOT_SPACE):
        sets = shingle_sets(w, shingle=SHINGLE)
        found = sketches([t for t, _ in sets])
        more = [r.tobytes() if len(s[0]) else None for r, s in zip(found, sets, strict=True)]
        columns = [batch.column("doc_id").slice(i, j - i), batch.column("mark").slice(i, j - i), [_digest(*s) for s in sets], [len(t) for t, _ in sets], more]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], [k for k, _ in kinds])


def _band_rows(batches):
    for batch in streamed(batches):
        keys = bands(np.frombuffer(b"".join(batch.column("more").to_pylist()), np.uint16).reshape(-1, REGISTERS))
        offsets = pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32())
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), pa.array(np.full(n, keys.shape[1]), pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64)))], ["node", "n", "short", "tokens"])


class NearCopies(Join):
    shingle, threshold, portion, besides = SHINGLE, THRESHOLD, SketchPortion, REGISTERS // 4

    def profile(self) -> DataFrame:
        docs = self.docs.withColumn("mark", _marked(F.col("text")))
        return self.scratch.keep(docs.mapInArrow(_profile, "doc_id long, mark binary, key binary, n long, more binary"), "profile")

    def distinct(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.min("n").alias("n"), F.min("doc_id").alias("least"), F.first("more").alias("more"))

    def with_more(self, sets: DataFrame, wanted) -> DataFrame:
        more = self.nodes.select("key", "more")
        if wanted:  # sketches of the others stay where they are
            more = more.mapInArrow(rows_wanted(wanted), "key binary, more binary")
        return sets.join(more, "key")

    def members(self) -> tuple[DataFrame, float]:
        return self.nodes.select("node", "n", "more").mapInArrow(_band_rows, "node long, n long, short int, tokens array<long>"), self.nodes.count() * (REGISTERS // ROWS)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    found = NearCopies(docs, id_col, text_col).run()
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the row with the smallest id, all columns as they were; see the n-gram join."""
    return kept_rows(docs, NearCopies(docs, id_col, text_col).run(), id_col, text_col)


def op12_near_dedup(spark, sf_dir):
    return near_copies(table(spark, sf_dir, "documents"))


QUERIES = {"op12_near_dedup": op12_near_dedup}
#: Sets of 3-grams, links by counting common tokens, components by a closure.
SQL = {
    "op12_near_dedup": r"""
with recursive
nd_w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
nd_s as materialized (select distinct doc_id, array_to_string(w[i:i + 2], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from nd_w where len(w) > 0)),
nd_n as materialized (select doc_id, count(*) as n from nd_s group by doc_id),
nd_c as (select a.doc_id as a, b.doc_id as b, count(*) as c from nd_s a join nd_s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
nd_l as materialized (select a, b from nd_c join nd_n x on x.doc_id = a join nd_n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
nd_e as materialized (select a as u, b as v from nd_l union select b, a from nd_l),
nd_r as (select u, v from nd_e union select r.u, e.v from nd_r r join nd_e e on r.v = e.u),
nd_m as (select u as doc_id, min(v) as m from nd_r group by u)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) as component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) as kept
from documents d left join nd_n using (doc_id) left join nd_m using (doc_id)"""
}
