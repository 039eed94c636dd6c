"""Best-fit packing by bin completion.

Documents of one length are alike to a packer, so the packing is found over lengths: how many
pieces there are of each length, a table of at most ``window`` counts whatever the data, goes to
the driver; the packing comes back as fillings (multisets of lengths) with how often each is used.
Every task then places its own documents: the rank of a piece among those of its length, by prefix
sums over tasks, names its sequence and its place there. No text and no id moves, and a length
that a third of all documents share is as good as any other.

Fillings are found by branch and bound. A node takes the largest length that is left and
enumerates its undominated completions, those that fill the sequence best first; a
completion is dominated when a length that is left could stand in for some of its pieces. A
completion is used as often as its lengths allow, then less often. A node is pruned when the waste
bound says that its sequences and those that the rest needs cannot beat the incumbent. Best-fit
decreasing gives the first incumbent, and one at every node for what is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small
from .packing import SUM_ROWS, TextEncoder

#: Nodes that the search opens and completions that it looks at, at most. When they are used up
#: the incumbent is the result: a whole packing, though perhaps not one of the fewest sequences.
NODES, COMPLETIONS = 2_500, 100_000

#: A filling is ((length, pieces), ...) with lengths descending.
Filling = tuple[tuple[int, int], ...]


def waste_bound(counts: np.ndarray, window: int) -> int:
    """Sequences that any packing needs: for each ``k``, pieces over half a window need one each,
    and pieces of ``k`` to half a window need what these leave, where pieces over ``window - k`` leave nothing."""
    size = np.arange(window + 1)
    many, total = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * size)]  # of lengths below
    half = window // 2
    k = np.arange(half + 1)
    large = many[window + 1] - many[half + 1]  # those over half
    middle = total[half + 1] - total[k]  # k to half
    room = (many[window - k + 1] - many[half + 1]) * window - (total[window - k + 1] - total[half + 1])
    return int(large + max(0, int((-(-(middle - room) // window)).max())))


def best_fit(counts: list[int], window: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing: each piece, longest first, goes where least room is left. Sequences that
    are filled alike are one entry, with how many they are."""
    open_: dict[int, list[list]] = {}  # room left: [filling, how many]
    mask, closed = 0, []

    def put(room, filling, n):
        nonlocal mask
        if not n:
            return
        if room:
            open_.setdefault(room, []).append([filling, n])
            mask |= 1 << room
        else:
            closed.append((filling, n))

    for s in range(window, 0, -1):
        left = counts[s]
        while left:
            fits = mask >> s
            if not fits:
                each = min(left, window // s)
                n = left // each
                put(window - each * s, ((s, each),), n)
                if rest := left - n * each:
                    put(window - rest * s, ((s, rest),), 1)
                break
            room = s + (fits & -fits).bit_length() - 1
            filling, n = open_[room].pop()
            if not open_[room]:
                del open_[room]
                mask &= ~(1 << room)
            each = room // s
            full = min(n, left // each)
            put(room - each * s, (*filling, (s, each)), full)
            left -= full * each
            n -= full
            if n and left:  # fewer than ``each`` pieces are left: they end in one sequence
                put(room - left * s, (*filling, (s, left)), 1)
                n, left = n - 1, 0
            put(room, filling, n)
    return closed + [(f, n) for groups in open_.values() for f, n in groups]


def smear(bits: int, n: int) -> int:
    """``bits`` and all its shifts by up to ``n``."""
    step = 1
    while n > 0:
        step = min(step, n)
        bits |= bits << step
        n, step = n - step, step * 2
    return bits


class Completer:
    """Bin completion over counts of lengths."""

    def __init__(self, counts: list[int], window: int, nodes: int = NODES, completions: int = COMPLETIONS):
        self.window, self.nodes, self.looks = window, nodes, completions
        self.start = list(counts)
        self.best = best_fit(counts, window)
        self.fewest = sum(n for _, n in self.best)
        self.least = waste_bound(np.array(counts, np.int64), window)
        self.seen: dict[bytes, int] = {}

    def completions(self, counts: list[int], room: int) -> Iterator[Filling]:
        """Undominated fillings of ``room``, the fullest first, longest pieces first among them."""
        sizes = [s for s in range(room, 0, -1) if counts[s]]
        limit = (1 << room + 1) - 1
        reach = [1] * (len(sizes) + 1)  # sums that the lengths from here on can make
        for i in range(len(sizes) - 1, -1, -1):
            bits, s, left, step = reach[i + 1], sizes[i], min(counts[sizes[i]], room // sizes[i]), 1
            while left:
                step = min(step, left)
                bits |= bits << s * step & limit
                left, step = left - step, step * 2
            reach[i] = bits

        def exactly(i: int, t: int) -> Iterator[Filling]:
            if not t:
                yield ()
                return
            for j in range(i, len(sizes)):
                if not reach[j] >> t & 1:
                    return
                s = sizes[j]
                for k in range(min(counts[s], t // s), 0, -1):
                    if reach[j + 1] >> t - k * s & 1:
                        for rest in exactly(j + 1, t - k * s):
                            yield ((s, k), *rest)

        has = sum(1 << s for s in sizes)
        for slack in range(room + 1):
            if reach[0] >> room - slack & 1:
                for filling in exactly(0, room - slack):
                    self.looks -= 1
                    if self.looks < 0:
                        return
                    if not self.dominated(filling, counts, has, slack):
                        yield filling

    @staticmethod
    def dominated(filling: Filling, counts: list[int], has: int, slack: int) -> bool:
        """Whether a piece that is left over could take the place of some pieces, or of none."""
        for s, k in filling:
            if counts[s] == k:
                has &= ~(1 << s)
        one, any_, several = 0, 1, 0  # sums of single pieces, of any pieces, of two or more
        for s, k in filling:
            one |= 1 << s
            for _ in range(k):
                several |= several << s | (any_ & ~1) << s
                any_ |= any_ << s
        stand_in = smear(several, slack)
        if slack:  # a longer piece for a single one, or one more
            stand_in |= smear((one | 1) << 1, slack - 1)
        return bool(stand_in & has)

    def children(self, counts: list[int], used: int) -> Iterator[tuple[Filling, int]]:
        s = next(s for s in range(self.window, 0, -1) if counts[s])
        counts = counts[:]
        counts[s] -= 1
        for rest in self.completions(counts, self.window - s):
            need = dict(rest)
            need[s] = need.get(s, 0) + 1
            counts[s] += 1
            most = min(counts[x] // k for x, k in need.items())
            counts[s] -= 1
            filling = tuple(sorted(need.items(), reverse=True))
            for n in range(most, 0, -1):
                yield filling, n

    def solve(self) -> list[tuple[Filling, int]]:
        """Fillings with how often each is used: all pieces, in as few sequences as were found."""
        path: list[tuple[Filling, int]] = []
        state, used = self.start[:], 0
        stack = [self.children(state, used)] if self.fewest > self.least else []
        while stack and self.nodes > 0 and self.looks > 0 and self.fewest > self.least:
            step = next(stack[-1], None)
            if step is None:
                stack.pop()
                if path:
                    filling, n = path.pop()
                    used -= n
                    for s, k in filling:
                        state[s] += k * n
                continue
            filling, n = step
            for s, k in filling:
                state[s] -= k * n
            used += n
            self.nodes -= 1
            now = np.array(state, np.int64)
            key = blake2b(now.tobytes(), digest_size=16).digest()
            known, self.seen[key] = self.seen.get(key, used + 1), min(used, self.seen.get(key, used))
            if known > used and used + waste_bound(now, self.window) < self.fewest:
                rest = best_fit(state, self.window)
                if (total := used + sum(m for _, m in rest)) < self.fewest:
                    self.best, self.fewest = [*path, step, *rest], total
                if now.any():
                    path.append(step)
                    stack.append(self.children(state, used))
                    continue
            used -= n
            for s, k in filling:
                state[s] += k * n
        return self.best


class Places:
    """Where the pieces of each length go: the ``r``-th piece of a length, in closed form."""

    def __init__(self, fillings: list[tuple[Filling, int]]):
        rows, first, taken = [], 0, {}
        for filling, n in fillings:
            at = 0
            for s, k in filling:
                rows.append((s, taken.get(s, 0), first, k, at))
                taken[s] = taken.get(s, 0) + n * k
                at += s * k
            first += n
        rows.sort()
        self.sequences = first
        self.size, self.rank, self.first, self.each, self.at = (np.array(c, np.int64) for c in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 5

    def of(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces."""
        far = 1 << 50
        i = np.searchsorted(self.size * far + self.rank, size * far + rank, "right") - 1
        r = rank - self.rank[i]
        return self.first[i] + r // self.each[i], self.at[i] + r % self.each[i] * size


def _tokenise(path: str, eos: int, window: int, schema: pa.Schema, with_ids: bool):
    def run(batches):
        enc = TextEncoder.of(path)
        tail, width = np.array([eos], enc.dtype).tobytes(), enc.dtype.itemsize
        part, seen, whole = TaskContext.get().partitionId(), {}, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                rows = []
                for t in b.column(1):
                    raw = enc.encode(t.as_py() or "") + tail
                    n = len(raw) // width
                    short = n % window
                    cuts = [*([0, short] if short else [0]), *range(short + window, n + 1, window)]
                    ids = np.frombuffer(raw, enc.dtype).astype("<u4")
                    rows.append((part, n, short, seen.get(short, 0), whole, [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(cuts, cuts[1:])], *[ids.tobytes()] * with_ids))
                    seen[short] = seen.get(short, 0) + 1
                    whole += n // window
                yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:])], schema=schema)

    return run


def _emit(places: Places, window: int, schema: pa.Schema, with_ids: bool):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                b = batch.slice(lo, 1024)
                n, short, local, whole, base, whole_base = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1, 7))
                has = (short > 0).astype(np.int64)
                count = has + n // window
                doc = np.repeat(np.arange(len(n)), count)
                piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                first = (piece == 0) & (has[doc] == 1)
                length = np.where(first, short[doc], window)
                start = np.where(first, 0, short[doc] + (piece - has[doc]) * window)
                rank = np.where(first, (base + local)[doc], (whole_base + whole)[doc] + piece - has[doc])
                sequence, offset = places.of(length, rank)
                out = [b.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), b.column(7).flatten(), pa.array(sequence), pa.array(offset), pa.array(n[doc])]
                if with_ids:
                    raw = [x.as_py() for x in b.column(8)]
                    out.append(pa.array([raw[d][4 * s : 4 * (s + k)] for d, s, k in zip(doc.tolist(), start.tolist(), length.tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, schema=schema)

    return run


def fit(docs: DataFrame, tokenizer_path: str, *, doc_id="doc_id", text="text", window=1024, eos_id=2, with_ids=True, nodes=NODES, completions=COMPLETIONS) -> DataFrame:
    """Pack every document into as few sequences of at most ``window`` tokens as the search finds.

    A document's ids end with ``eos_id``. Only documents over ``window`` are cut: into pieces of
    ``window`` tokens, the first of which may be shorter.

    Returns one row per piece: doc_id, piece (from 0), start (ids of the document before it),
    length, ids_crc32, sequence_id, offset (place in the sequence, gapless from 0), doc_tokens, and
    ids (little-endian unsigned 32-bit) if ``with_ids``. Null and empty texts are the closing id
    alone; very long texts are cut as any other; repeated rows and null ids are documents each; other
    columns are ignored; no rows give no pieces.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind, long = src.schema["doc_id"].dataType, T.LongType()
    bytes_ = [T.StructField("ids", T.BinaryType())] * with_ids
    fields = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, long) for c in ("part", "doc_tokens", "short", "local", "whole")), T.StructField("crcs", T.ArrayType(long)), *bytes_])
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), *(T.StructField(c, long) for c in ("start", "length", "ids_crc32", "sequence_id", "offset", "doc_tokens")), *bytes_])
    tokens = materialize(src.mapInArrow(_tokenise(tokenizer_path, eos_id, window, to_arrow_schema(fields), with_ids), fields), "fit-tokens")
    # pieces by task and length; whole windows count under the length of a window
    kinds = ((F.col("short"), F.lit(1)), (F.lit(window), F.floor(F.col("doc_tokens") / window)))
    pieces = F.explode(F.array(*(F.struct(s.cast("long").alias("size"), n.cast("long").alias("n")) for s, n in kinds)))
    sums = tokens.select("part", pieces.alias("p")).filter("p.size > 0 and p.n > 0").groupBy("part", F.col("p.size").alias("size")).agg(F.sum("p.n").alias("n"))
    sums = materialize(sums.withColumn("base", F.sum("n").over(Window.partitionBy("size").orderBy("part")) - F.col("n")), "fit-sums")
    per_size = sums.groupBy("size").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()  # at most ``window`` rows
    counts, rows = [0] * (window + 1), sum(r.rows for r in per_size)
    for r in per_size:
        counts[r["size"]] = r.n
    places = Places(Completer(counts, window, nodes, completions).solve())
    base = small(sums.select(F.col("part").alias("p1"), F.col("size").alias("s1"), "base"), rows, SUM_ROWS)
    full = small(sums.filter(F.col("size") == window).select(F.col("part").alias("p2"), F.col("base").alias("whole_base")), rows, SUM_ROWS)
    placed = tokens.join(base, (F.col("part") == F.col("p1")) & (F.col("short") == F.col("s1")), "left").join(full, F.col("part") == F.col("p2"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    placed = placed.select("doc_id", "doc_tokens", "short", "local", "whole", zero("base"), zero("whole_base"), "crcs", *["ids"] * with_ids)
    return placed.mapInArrow(_emit(places, window, to_arrow_schema(out), with_ids), out)
