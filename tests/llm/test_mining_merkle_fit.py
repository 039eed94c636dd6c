"""Hard negatives, Merkle manifests and bin completion against brute force, with every odd case."""

import math
import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import documents, odd_rows

from corpusloom.llm import bin_completion, hard_negatives, merkle
from corpusloom.llm.queries import tokenizer

# -- hard negatives


def test_planes_give_products():
    rng = np.random.default_rng(3)
    for d, most in ((1, 1), (64, 255), (70, 300), (130, 5)):
        q = rng.integers(-most - 1, most + 1, (40, d))
        bits = int(abs(q).max()).bit_length() + 1
        planes = hard_negatives.sliced(q, bits)
        for i in range(5):
            at, got = hard_negatives.scores(planes, planes[:, i], q[i], np.arange(40), lambda lo, hi: np.ones(len(lo), bool))
            assert at.tolist() == list(range(40)) and got.tolist() == (q @ q[i]).tolist()


def test_rows_are_dropped_before_the_last_plane():
    rng = np.random.default_rng(4)
    q = np.floor(256 * rng.standard_normal((5000, 64)) / 8).astype(np.int64)
    bits = int(abs(q).max()).bit_length() + 1
    planes, left = hard_negatives.sliced(q, bits), []

    def watched(lo, hi):
        left.append(len(lo))
        return hard_negatives.highest(5)(lo, hi)

    at, got = hard_negatives.scores(planes, planes[:, 0], q[0], np.arange(1, 5000), watched)
    best = np.sort(q[1:] @ q[0])[::-1][:5]
    assert sorted(got, reverse=True)[:5] == best.tolist() and left[-1] < 100 < left[0]


def mined(rows, every, positives, negatives):
    """Hard negatives by the definition, over (id, label, vector)."""
    ok = [(i, y, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, y, q) in enumerate(ok):
        if i % every:
            continue
        score = [(sum(s * t for s, t in zip(q, p)), j, n, z) for n, (j, z, p) in enumerate(ok) if n != a]
        rank = lambda r: (-r[0], r[1], r[2])
        for ps, pid, _, _ in sorted((r for r in score if r[3] == y), key=rank)[:positives]:
            band = sorted((r for r in score if r[3] != y and 30 * ps <= 100 * r[0] <= 90 * ps), key=rank)[:negatives]
            out += [(i, pid, k, r[1], ps, r[0]) for k, r in enumerate(band, 1)]
    return Counter(out)


VECTORS = "vec_id long, embedding array<float>, label int, row long, q string, b int, g int, held string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in rows], VECTORS)


@pytest.mark.parametrize("block", [7, 131_072])
def test_hard_negatives_are_those_of_the_definition(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 5)
    rng, rows = random.Random(block), []
    for i in range(150):
        v = [rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5, rng.uniform(-1, 1)]) for _ in range(9)]
        rows.append((i - 20, v, rng.randrange(3)))
    same = [0.5] * 9
    rows += [(200 + i, same, i % 2) for i in range(40)]  # ties
    rows += [(10, rows[30][1], 1)] * 3 + [(None, same, 1), (300, None, 1), (310, same, None), (320, [], 0), (330, [0.1, None], 0), (340, [float("nan")] * 9, 0), (350, [float("inf")] * 9, 1), (360, [0.3, -0.2], 2), (370, [0.0] * 9, 1)]
    got = hard_negatives.hard_negatives(vectors(spark, rows), every=10, positives=3, negatives=4)
    want = mined(rows, 10, 3, 4)
    assert Counter(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == want
    assert sum(want.values()) > 50


def test_no_anchors_no_rows_one_row(spark):
    assert not hard_negatives.hard_negatives(vectors(spark, [])).collect()
    assert not hard_negatives.hard_negatives(vectors(spark, [(1, [0.5], 0), (2, [0.5], 1)])).collect()
    assert not hard_negatives.hard_negatives(vectors(spark, [(0, [0.5], 0)])).collect()
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(vectors(spark, [(0, [1e15], 0), (1, [1e15], 0)])).collect()


# -- Merkle


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def H(s):
    return sha256(s.encode()).hexdigest()


def tree(leaves):
    """(root, for each leaf its runs as (digests, place))."""
    level, at, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for leaf, i in enumerate(at):
            paths[leaf].append((runs[i // 16], i % 16))
        level, at = [H("".join(r)) for r in runs], [i // 16 for i in at]
    return level[0], paths


def by_hand(rows, tampers):
    groups = defaultdict(list)
    for i, t, lang, s in rows:
        fields = lambda x: H("".join(map(enc, (i, s, lang, None if t is None else len(t), x))))
        lower = None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        groups[s].append((i is not None, i or 0, fields(t), fields(lower) if tampers(i) else fields(t)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort()
    own = {s: tree([x[2] for x in groups[s]]) for s in names}
    root, tops = tree([own[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        for (known, i, leaf, other), path in zip(groups[s], own[s][1]):
            steps, folded = path + top, other
            for run, at in steps:
                folded = H("".join(run[:at] + [folded] + run[at + 1 :]))
            out.append((i if known else None, leaf, own[s][0], root, H("".join("".join(r[:a] + r[a + 1 :]) for r, a in steps)), folded, folded == root))
    return Counter(out)


def crc5(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def manifest(spark, rows):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = merkle.manifest(documents(spark, rows), changed=(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, {"text": lower}))
    return Counter(map(tuple, got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()))


@pytest.mark.parametrize("fan", [2, 32])
def test_manifest_is_that_of_the_definition(spark, monkeypatch, fan):
    monkeypatch.setattr(merkle, "FAN", fan)
    monkeypatch.setattr(merkle, "RANGE_LEAVES", 20)
    rows = odd_rows() + [(10_000 + i, f"Text {i}", "en", "z16") for i in range(16)] + [(20_000 + i, None, None, "z17") for i in range(17)]
    rows += [(30_000 + i, "Hot", "en", "hot") for i in range(257)] + [(8, "One", "en", f"é{i}") for i in range(30)] + [(40_000, "Alike", "en", "hot")] * 40
    want = by_hand(rows, crc5)
    assert manifest(spark, rows) == want
    assert {v for *_, v in want} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17])
def test_small_manifests(spark, n):
    rows = [(i, f"A{i}", "en", "s") for i in range(n)]
    assert manifest(spark, rows) == (by_hand(rows, crc5) if n else Counter())


def test_merging_is_associative_and_commutative():
    rng = random.Random(6)
    for _ in range(40):
        sizes = [rng.choice([1, 2, 16, 17, 40, 300]) for _ in range(rng.choice([1, 3, 20]))]
        leaves = [(t, n, 0, i, H(f"{t}/{i}")) for t, n in enumerate(sizes) for i in range(n)]
        rng.shuffle(leaves)
        parts = []
        cuts = sorted(rng.choices(range(len(leaves) + 1), k=rng.randrange(6)))
        for a, z in zip([0, *cuts], [*cuts, len(leaves)]):
            parts.append(merkle.Fragment(len(sizes), 16))
            for node in leaves[a:z]:
                parts[-1].add(*node)
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            a, b = parts[i], parts.pop(i + 1)
            parts[i] = a.merge(b) if rng.random() < 0.5 else b.merge(a)
        want = tree([tree([H(f"{t}/{i}") for i in range(n)])[0] for t, n in enumerate(sizes)])[0]
        assert parts[0].root == want and not list(parts[0].nodes())


def test_a_sorted_range_keeps_few_nodes():
    n = 100_000
    f = merkle.Fragment(1, 16)
    for i in range(12_345, 67_890):
        f.add(0, n, 0, i, "x")
    assert len(list(f.nodes())) <= 2 * 15 * 5


# -- bin completion


def fewest(items, window):
    """The fewest sequences, by search over all ways."""

    @lru_cache(None)
    def rest(items):
        if not items:
            return 0
        best, (first, *others) = len(items), items

        def fill(room, i, taken):
            nonlocal best
            best = min(best, 1 + rest(tuple(x for j, x in enumerate(others) if j not in taken)))
            for j in range(i, len(others)):
                if others[j] <= room:
                    fill(room - others[j], j + 1, taken | {j})

        fill(window - first, 0, frozenset())
        return best

    return rest(tuple(sorted(items, reverse=True)))


def pieces_of(fillings):
    return Counter({s: n for s, n in sum((Counter({s: k * n}) for f, n in fillings for s, k in f), Counter()).items()})


def test_search_finds_the_fewest():
    rng, better = random.Random(9), 0
    for _ in range(150):
        window = rng.choice([10, 20, 50, 100])
        items = [rng.randint(1, window) if rng.random() < 0.5 else rng.randint(window // 5, window // 2) for _ in range(rng.randint(1, 9))]
        counts = [items.count(s) for s in range(window + 1)]
        search = bin_completion.Completer(counts, window)
        first = search.fewest
        got = search.solve()
        assert pieces_of(got) == Counter(items) and all(sum(s * k for s, k in f) <= window for f, _ in got)
        want = fewest(items, window)
        assert sum(n for _, n in got) == want and search.least <= want
        better += first > want
    hard = [0] * 101
    for s in (45, 43, 41, 38, 32, 24, 24, 24, 11):  # best-fit decreasing takes four sequences
        hard[s] += 1
    search = bin_completion.Completer(hard, 100)
    assert (search.fewest, sum(n for _, n in search.solve())) == (4, 3)


def naive_best_fit(items, window):
    rooms = []
    for s in sorted(items, reverse=True):
        fit = [r for r in range(len(rooms)) if rooms[r] >= s]
        if fit:
            rooms[min(fit, key=lambda r: rooms[r])] -= s
        else:
            rooms.append(window - s)
    return sorted(rooms)


def test_best_fit_over_counts_is_best_fit_over_pieces():
    rng = random.Random(10)
    for _ in range(200):
        window = rng.choice([7, 30, 100])
        items = [rng.randint(1, window) for _ in range(rng.randint(0, 80))] + [rng.randint(1, window)] * rng.choice([0, 50])
        got = bin_completion.best_fit([items.count(s) for s in range(window + 1)], window)
        assert pieces_of(got) == Counter(items)
        assert sorted(window - sum(s * k for s, k in f) for f, n in got for _ in range(n)) == naive_best_fit(items, window)


def test_a_spent_budget_still_packs_all():
    rng = random.Random(11)
    counts = [0, *(rng.randint(0, 400) for _ in range(256))]
    for nodes, looks in ((0, 10), (50, 10**6), (10**6, 5)):
        got = bin_completion.Completer(counts, 256, nodes, looks).solve()
        assert pieces_of(got) == Counter({s: n for s, n in enumerate(counts) if n})


def test_places_are_disjoint():
    fillings = [(((5, 1), (2, 2)), 3), (((4, 2),), 2), (((2, 4),), 1), (((5, 1),), 10**9)]
    places = bin_completion.Places(fillings)
    assert places.sequences == 6 + 10**9
    got = {}
    for s, n in ((5, 13), (4, 4), (2, 10)):
        seq, at = places.of(np.full(n, s), np.arange(n))
        for q, a in zip(seq.tolist(), at.tolist()):
            got.setdefault(q, []).append((a, s))
    for q, held in got.items():
        end = 0
        for a, s in sorted(held):
            assert a == end
            end += s
        assert end == [9, 9, 9, 8, 8, 8][q] if q < 6 else end == 5


def test_fit_holds_every_piece_once(spark):
    from tokenizers import Tokenizer

    tok, rows = Tokenizer.from_file(tokenizer()), odd_rows()
    got = bin_completion.fit(documents(spark, rows), tokenizer(), window=128).collect()
    want = Counter()
    for i, t, _, _ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        ends = [len(ids) % 128 or 128]
        while ends[-1] < len(ids):
            ends.append(ends[-1] + 128)
        for k, (a, z) in enumerate(zip([0, *ends], ends)):
            raw = np.array(ids[a:z], "<u4").tobytes()
            want[i, k, a, z - a, zlib.crc32(raw), len(ids), raw] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.doc_tokens, bytes(r.ids)) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for x in held.values():
        x.sort()
        assert [a for a, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))] and sum(n for _, n in x) <= 128
    lengths = [0] * 129
    for r in got:
        lengths[r.length] += 1
    assert len(held) <= sum(n for _, n in bin_completion.best_fit(lengths, 128))


def test_fit_of_no_rows(spark):
    assert not bin_completion.fit(documents(spark, []), tokenizer()).collect()
