"""URL filter by a bit-parallel wildcard automaton.

Glob rules (`*` any run of characters, `?` any one character, of whatever number
of bytes) are packed into the bits of multiword Shift-And masks.  All rules step
together over each canonical URL, one URL of the batch per row of a numpy array:
for each byte position there are a handful of vector operations, whatever the
number of rules.

A base rule (host, path) becomes two globs, `host` + path + `*` and `*.host` +
path + `*`, in which the `*` before a host may not cross a slash; they run over
host + path as they stand.  The longest base rule that fits decides; where none
fits, the method's own globs block, and else the URL is allowed.  Own globs run
over a key in which spellings of one place agree: no user name, default port or
final dot of the host, no `.` steps or doubled slashes in the path, escapes of
letters, digits and `-._~` resolved (twice escaped ones once).

Rules may be given as a table (verdict, host, path) of any size.  They are taken
longest first in blocks of RULES, so the first block with a fitting rule decides;
between blocks the URLs are written down.  Slices of URLs shrink as the masks
grow (CELLS words of state at a time).  A null URL or one without `://` has an empty host and path,
fits no rule and is allowed.  Repeated rows give repeated results; an empty
table an empty one; further columns are not read.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.llm.store import Scratch, table
from regolith.llm.text import buffers, slices

# The base rules (verdict, host, path).
BASE_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The method's own globs, over host + path; `*` in them crosses everything.
BLOCK_GLOBS = ("*casino-win.*", "*cheap-pills.*", "*free-bets.*", "*spam-farm.*", "*ads-track.*", "*adult-x.*")
#: Rules of a block, which goes to every task; words of state, and fits of globs, that are held at once.
RULES, CELLS, FITS = 10_000, 1 << 20, 1 << 22
# Tokens of a glob besides its bytes.
_HOST_RUN, _ANY_RUN, _ANY_ONE = -1, -2, -3
_FURTHER = list(range(0x80, 0xC0))  # bytes within a character of UTF-8
_STARTS = [b for b in range(256) if b not in _FURTHER]
_ESCAPE = re.compile("%([0-9A-Fa-f]{2})")
_PLAIN = set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-._~")


def base_name(rule: tuple[str, str, str]) -> str:
    return rule[1] + rule[2]


class Automaton:
    """Globs in the bits of 64-bit words.  Bit k of a state is set when the first k tokens of its glob match what was read."""

    def __init__(self, globs: list[list]):
        sizes = [len([t for t in g if t not in (_HOST_RUN, _ANY_RUN)]) + 1 for g in globs]
        self.bits = sum(sizes)
        self.words = max(1, -(-self.bits // 64))
        self.step = np.zeros((256, self.words), np.uint64)  # bits that a byte may move on to
        self.loop = np.zeros((256, self.words), np.uint64)  # bits that a byte may stay at
        self.start = np.zeros(self.words, np.uint64)
        final: list[tuple[int, np.uint64]] = []
        at = 0
        for glob, size in zip(globs, sizes, strict=True):
            bit = at
            self._set(self.start, bit)
            for t in glob:
                if t == _ANY_RUN:
                    self._set(self.loop, bit, slice(None))
                elif t == _HOST_RUN:
                    self._set(self.loop, bit, [b for b in range(256) if b != 47])
                else:
                    bit += 1
                    self._set(self.step, bit, _STARTS if t == _ANY_ONE else t)
                    if t == _ANY_ONE:  # stays on the further bytes of its character
                        self._set(self.loop, bit, _FURTHER)
            final.append((bit // 64, np.uint64(1) << np.uint64(bit % 64)))
            at += size
        self.last = np.array([w for w, _ in final], np.int64)
        self.bit = np.array([b for _, b in final], np.uint64)

    @staticmethod
    def _set(mask: np.ndarray, bit: int, rows=None) -> None:
        one = np.uint64(1) << np.uint64(bit % 64)
        if rows is None:
            mask[bit // 64] |= one
        else:
            mask[rows, bit // 64] |= one

    def run(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """(texts, globs) booleans: which glob fits which whole text."""
        n = len(offs) - 1
        lengths = np.diff(offs)
        order = np.argsort(-lengths, kind="stable")
        first, size = offs[:-1][order], lengths[order]
        state = np.tile(self.start, (n, 1))
        one, top = np.uint64(1), np.uint64(63)
        live = n
        for i in range(int(size[0]) if n else 0):
            live = int(np.searchsorted(-size[:live], -i, "left"))
            c = buf[first[:live] + i]
            s = state[:live]
            moved = s << one
            moved[:, 1:] |= s[:, :-1] >> top
            state[:live] = (moved & self.step[c]) | (s & self.loop[c])
        out = np.zeros((n, len(self.last)), bool)
        step = max(1, FITS // max(n, 1))
        for k in range(0, len(self.last), step):
            out[order, k : k + step] = (state[:, self.last[k : k + step]] & self.bit[k : k + step]) != 0
        return out

    def first(self, buf: np.ndarray, offs: np.ndarray, together: int = 1) -> np.ndarray:
        """Of each text the first of the globs, taken `together` at a time, that fits; -1 where none does."""
        found = [np.empty(0, np.int64)]
        most = max(1, min(CELLS // self.words, FITS // max(len(self.last), 1)))
        for i, j in slices(offs, 1 << 20):
            for k in range(i, j, most):
                fits = self.run(buf, offs[k : min(k + most, j) + 1])
                fits = fits.reshape(len(fits), -1, together).any(2)
                found.append(np.where(fits.any(1), fits.argmax(1), -1) if fits.shape[1] else np.full(len(fits), -1))
        return np.concatenate(found)


def _glob(text: str) -> list:
    out: list = []
    for b in text.encode():
        out.append(_ANY_RUN if b == 42 else _ANY_ONE if b == 63 else b)
    return out


def canonical(url) -> tuple:
    """Host and path columns of a URL column."""
    after = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(after, "^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def place_key(host: str, path: str) -> str:
    """Host and path in the spelling that own globs are matched with."""
    resolve = lambda t: _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if int(m[1], 16) in _PLAIN else m[0], t)
    if "%" in host or "%" in path:
        host, path = resolve(host).lower(), resolve(path)
    host = re.sub(":(80|443)?$", "", host.rpartition("@")[2]).rstrip(".")
    if "//" in path or "/." in path:
        steps: list[str] = []
        parts = path.split("/")
        for k, x in enumerate(parts):
            if x == ".." and len(steps) > 1:
                steps.pop()
            elif k and (x in (".", "..") or not x) and k < len(parts) - 1:
                continue
            elif x not in (".", ".."):
                steps.append(x)
            if x in (".", "..") and k == len(parts) - 1:
                steps.append("")
        path = "/".join(steps)
    return host + path


def _ruled(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """URLs that have no rule yet get the first of these that fits."""
    globs = [g for r in rules for g in (_glob(r[1]) + _glob(r[2]) + [_ANY_RUN], [_HOST_RUN] + _glob("." + r[1]) + _glob(r[2]) + [_ANY_RUN])]
    names, verdicts = [base_name(r) for r in rules], [r[0] for r in rules]

    def judge(batches):
        automaton = Automaton(globs)
        for batch in batches:
            rule, verdict = batch.column("rule").to_pylist(), batch.column("verdict").to_pylist()
            open_ = np.array([k for k, r in enumerate(rule) if r is None], np.int64)
            keys = pa.array([h + p for h, p in zip(batch.column("host").take(open_).to_pylist(), batch.column("path").take(open_).to_pylist(), strict=True)], pa.string())
            for k, m in zip(open_.tolist(), automaton.first(*buffers(keys), together=2).tolist(), strict=True):
                if m >= 0:
                    rule[k], verdict[k] = names[m], verdicts[m]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")


def _blocks(rules):
    """Rules longest first, RULES at a time; a table is sorted by Spark, and only a block of it is here at once."""
    if isinstance(rules, DataFrame):
        size = F.length("host") + F.length("path")
        rows = (tuple(r) for r in rules.select("verdict", "host", "path").dropna().orderBy(F.desc(size), "host", "path", "verdict").toLocalIterator())
    else:
        rows = iter(sorted(rules, key=lambda r: (-len(base_name(r)), r[1], r[2], r[0])))
    while block := list(islice(rows, RULES)):
        yield block


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=BASE_RULES, block_globs=BLOCK_GLOBS) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, blocked_by (the method's glob, else null)."""
    host, path = canonical(F.col(url_col))
    scratch = Scratch(pages.sparkSession)
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for k, block in enumerate(_blocks(rules)):
        if k:
            urls = scratch.keep(urls, f"ruled-{k}")
            scratch.drop(f"ruled-{k - 1}")
        urls = _ruled(urls, block)
    own_globs, own = [_glob(g) for g in block_globs], list(block_globs)

    def judge(batches):
        blocked = Automaton(own_globs)
        for batch in batches:
            keys = pa.array([place_key(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)], pa.string())
            why = [own[m] if m >= 0 else None for m in blocked.first(*buffers(keys)).tolist()]
            verdict = [v or ("block" if w else "allow") for v, w in zip(batch.column("verdict").to_pylist(), why, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), batch.column("rule"), pa.array(verdict, pa.string()), pa.array(why, pa.string())], ["page_id", "host", "path", "rule", "verdict", "blocked_by"])

    return urls.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string, blocked_by string")


def op6_url_filter(spark, sf_dir):
    return url_filter(table(spark, sf_dir, "pages"))


def _sql() -> str:
    fits = "\n       ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{h}{p}'" for _, h, p in sorted(BASE_RULES, key=lambda r: -len(base_name(r))))
    own = "\n       ".join(f"when place like '{g.replace('*', '%')}' then '{g}'" for g in BLOCK_GLOBS)
    blocked = ", ".join(f"'{base_name(r)}'" for r in BASE_RULES if r[0] == "block")
    return f"""
with a as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from a),
k as (select *, regexp_replace(regexp_replace(host, '^.*@', ''), '[.]*(:(80|443)?)?$', '') || regexp_replace(path, '/+', '/', 'g') as place from h),
r as (select page_id, host, path, case {fits} end as rule, case {own} end as blocked_by from k)
select page_id, host, path, rule, case when rule in ({blocked}) or rule is null and blocked_by is not null then 'block' else 'allow' end as verdict, blocked_by
from r"""


QUERIES = {"op6_url_filter": op6_url_filter}
SQL = {"op6_url_filter": _sql()}
