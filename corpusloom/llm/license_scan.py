"""License scan: exact places of known phrases, and fuzzy search for short notices.

A notice of n characters with at most k errors, split into k + 1 parts, keeps at least one
part whole (pigeonhole). The parts are the seeds: they are looked up exactly, each hit names
the ranges of words around it that the notice may lie in, and the regex library's
bounded-error matching verifies a range and counts its edits. Spans are taken from the left:
of the ranges that overlap the first that matches, the one with the fewest errors (then the
first, then the shortest), and the search goes on behind it. Everything is local to a
document.
"""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Exact phrases and their labels (fixed values of the contract).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Short notices searched with errors, as normalised words, and their labels.
NOTICES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "bsd 3 clause license": "bsd-3",
    "bsd 2 clause license": "bsd-2",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}

_KEEP = b"abcdefghijklmnopqrstuvwxyz0123456789"
#: A-Z to a-z; letters, digits and bytes of other characters stay; all else becomes a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEEP or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text: runs of ASCII letters (lower-cased), digits and characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def seeds(notice: bytes, errors: int) -> list[tuple[int, bytes]]:
    """``errors + 1`` parts of a notice with their places."""
    n = errors + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class _Errors(dict):
    """Errors of a notice in a stretch of text, or None beyond the bound; texts that repeat are verified once."""

    def __init__(self, raw, pattern):
        super().__init__({raw: 0})
        self.raw, self.pattern = raw, pattern

    def __missing__(self, text):
        if len(self) >= 50_000:
            self.clear()
        m = self.pattern.fullmatch(text)
        found = self[text] = sum(m.fuzzy_counts) if m else None
        return found


def _starts(norm: bytes, off: int, seed: bytes):
    """Places of a notice by the places of its seed."""
    at = norm.find(seed)
    while at >= 0:
        yield at - off
        at = norm.find(seed, at + 1)


def _ranges(norm: bytes, start: int, n: int, k: int):
    """Ranges of whole words (start, end) that a notice of ``n`` characters with up to ``k``
    errors fills, if its place by a seed is ``start``."""
    lo = max(0, start - k - 1)
    window = norm[lo : start + n + k + 1]
    spaces = [lo + i for i, c in enumerate(window) if c == 32]
    first = [x + 1 for x in spaces if x < start + k]
    last = [x for x in spaces if x >= start + n - k]
    for a in first:
        for e in last:
            if abs(e - a - n) <= k:
                yield a, e


def _in_order(norm: bytes, parts, n: int, k: int):
    """All ranges by the hits of all seeds, sorted and distinct. A hit's ranges start at most
    ``k`` before it, so those before that are final and little is held at a time."""
    held, last = [], None
    hits = heapq.merge(*(_starts(norm, off, seed) for off, seed in parts))
    for hit in hits:
        while held and held[0][0] < hit - k:
            if (r := heapq.heappop(held)) != last:
                yield (last := r)
        for r in _ranges(norm, hit, n, k):
            heapq.heappush(held, r)
    while held:
        if (r := heapq.heappop(held)) != last:
            yield (last := r)


def _leftmost(norm: bytes, ranges, errors):
    """(start, end, errors) of non-overlapping spans, from the left; ``ranges`` are in order."""
    ahead, behind = deque(), 0
    while ahead or (r := next(ranges, None)):
        a, e = ahead.popleft() if ahead else r
        if a < behind or (d := errors[norm[a:e]]) is None:
            continue
        while not ahead or ahead[-1][0] < e:
            if (r := next(ranges, None)) is None:
                break
            ahead.append(r)
        best = (d, a, e)
        for b, f in ahead:
            if not best[0] or b >= e:
                break
            if (other := errors[norm[b:f]]) is not None:
                best = min(best, (other, b, f))
        yield best[1], best[2], best[0]
        behind = best[2]


class Scanner:
    """Scans one text at a time. ``share`` is the errors allowed per character of a notice."""

    def __init__(self, phrases: dict, notices: dict, share: float = 0.1):
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
        self.notices = []
        for n, label in notices.items():
            raw = n.encode()
            k = max(1, int(len(raw) * share))
            pattern = regex.compile(b"(?b)(?:" + regex.escape(raw) + b"){e<=" + str(k).encode() + b"}", regex.DOTALL)
            self.notices.append((raw, label, k, seeds(raw, k), _Errors(raw, pattern)))

    def base(self, norm: bytes):
        """(start byte of the phrase, label) of every exact place; ``norm`` has a space around each word."""
        for p, label in self.phrases:
            at = norm.find(p)
            while at >= 0:
                yield at + 1, label
                at = norm.find(p, at + 1)

    def fuzzy(self, norm: bytes):
        """(label, start byte, end byte, errors) of the spans of each notice, from the left."""
        for raw, label, k, parts, errors in self.notices:
            yield from ((label, *span) for span in _leftmost(norm, _in_order(norm, parts, len(raw), k), errors))

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        norm = b" " + b" ".join(words) + b" "
        base = list(self.base(norm)) if words else []
        near = list(self.fuzzy(norm)) if words else []
        if base or near:  # word numbers from one pass over the spaces
            spaces = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
            number = lambda at: int(np.searchsorted(spaces, at)) - 1
            base = [(number(at), label) for at, label in base]
            near = [(label, number(s), number(e), errors) for label, s, e, errors in near]
        length = {label: len(raw) for raw, label, *_ in self.notices}
        score = 1.0 if base else max((1 - errors / length[label] for label, _, _, errors in near), default=0.0)
        own = {label for _, label in base}
        return {
            "n_words": len(words),
            "n_base": len(base),
            "first_word": min((at for at, _ in base), default=None),
            "last_word": max((at for at, _ in base), default=None),
            "base_labels": ",".join(sorted(own)),
            "labels": ",".join(sorted(own | {label for label, *_ in near})),
            "score": score,
            "spans": [{"label": x, "first": a, "last": b, "errors": e} for x, a, b, e in near],
        }


SPANS = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("errors", T.IntegerType())]))


def scan_licenses(docs: DataFrame, *, doc_id="doc_id", text="text", phrases: dict | None = None, notices: dict | None = None, share: float = 0.1) -> DataFrame:
    """Scan every whole text.

    Returns doc_id, n_words, n_base (exact places), first_word and last_word (smallest and
    largest start of an exact place, in words from 0; null without one), base_labels,
    labels (fuzzy ones too; both distinct, sorted, comma-joined), score (1 with an exact
    place, else the best share of a notice's characters that match, else 0) and spans
    (label, first and last word, errors of each fuzzy match).

    Null or empty texts have no words and no labels; repeated rows are scanned each; other
    columns are ignored; no rows give no rows. No shuffle.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    long = T.LongType()
    schema = T.StructType([T.StructField("doc_id", src.schema["doc_id"].dataType), *(T.StructField(c, long) for c in ("n_words", "n_base", "first_word", "last_word")), T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)])
    arrow = to_arrow_schema(schema)
    phrases, notices = phrases or PHRASES, notices or NOTICES

    def run(batches):
        scanner = Scanner(phrases, notices, share)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                b = batch.slice(lo, 1024)
                rows = [scanner.scan(t) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[f.name] for r in rows], f.type) for f in list(arrow)[1:])], schema=arrow)

    return src.mapInArrow(run, schema)
