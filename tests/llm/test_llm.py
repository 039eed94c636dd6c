"""The training-data operators against brute force, on small tables with every odd case."""

import hashlib
import json
import pickle
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from harness import ROOT, compare
from pyspark.sql import functions as F

from corpusloom.llm import ann, chat, exact_dedup, graph, langid, license_scan, mixing, packing, sharding, simhash, warc
from corpusloom.llm.queries import ORACLE, QUERIES, tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, sha string, size long, key string, b int"


def documents(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    full = [(i, t, lang, s, None if t is None else len(t), "x", "y", 7, "k", 3) for i, t, lang, s in rows]
    return spark.createDataFrame(full, DOCS)


def odd_rows(n=120, seed=5):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "Élan", "naïve", "x,", "the", "of", "1234", "ß"]
    rows = [(None, "no id here", "en", "a"), (-3, None, None, None), (1000, "", "en", "a"), (1001, " \n\t ", "en", None), (1002, "中文 😀 \x1f\x85 end", "fr", "b"), (1003, "long " * 30000, "en", "b"), (1004, "<|endoftext|> don't we'll", "en", "c"), (700, "twice the same", "en", "b"), (700, "twice the same", "en", "b")]
    for i in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 40, 200])))
        rows.append((i, t.upper() if i % 9 == 0 else t, rng.choice(["en", "fr"]), rng.choice("aaab") if i % 7 else None))
    rows += [(5000 + i, "A hot Copy of one text", "en", "a") for i in range(60)] + [(6000 + i, "a HOT copy of one text", "en", "a") for i in range(5)]
    return rows


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE[name], "sf0.001")


# -- packing


def test_encoder_is_the_tokenizers():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(tokenizer()), packing.TextEncoder.of(tokenizer())
    rng, parts = random.Random(2), [*"ab é.,'s \n\t12²\x1c\x85\xa0中😀|-«»", "ll", "  ", "<|endoftext|>", "don't", " we'll", "straße", "İ"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def drr(totals, weights, window, packet):
    """Deficit round-robin, packet by packet: (queue, start, end, round) in the order of service.
    A round's window of credit is handed out by weight; a queue that has its total gets no more."""
    at, credit, out, r = [0] * len(totals), [Fraction(0)] * len(totals), [], 0
    while any(a < t for a, t in zip(at, totals)):
        r, left = r + 1, Fraction(window)
        while left and (live := [s for s, t in enumerate(totals) if credit[s] < t]):
            whole = sum(weights[s] for s in live)
            step = min([left / whole, *((totals[s] - credit[s]) / weights[s] for s in live)])
            for s in live:
                credit[s] += step * weights[s]
            left -= step * whole
        for s, t in enumerate(totals):
            while at[s] < t and (n := min(packet, t - at[s])) <= credit[s] - at[s]:
                out.append((s, at[s], at[s] + n, r))
                at[s] += n
    return out


def test_schedule_is_deficit_round_robin():
    rng = random.Random(4)
    for k in range(60):
        totals = [rng.randint(1, 3000) for _ in range(rng.randint(1, 6))]
        weights = totals if k % 3 == 0 else [rng.choice([1, 2, 3, 7, 1000]) for _ in totals]
        if k % 5 == 0:
            totals, weights = totals + totals, list(weights) * 2  # queues that run dry together
        s = packing.Schedule(totals, weights, 256, 16)
        place = 0
        for q, a, b, r in drr(totals, weights, 256, 16):
            doc, start, n, at = s.pieces(np.array([q]), np.array([a]), np.array([b - a]))
            assert at[0] == place and n.sum() == b - a and s.round_of(np.array([q]), np.array([b])) == [r]
            place += b - a
        assert place == sum(totals) and s.rounds == r
        seen = np.zeros(sum(totals), int)
        for q, t in enumerate(totals):
            _, _, n, at = s.pieces(np.array([q]), np.array([0]), np.array([t]))
            assert ((at // 256) == ((at + n - 1) // 256)).all()
            for x, y in zip(at, n):
                seen[x : x + y] += 1
        assert (seen == 1).all()


def test_schedule_of_very_many_weighted_queues():
    rng = random.Random(8)
    totals, weights = [rng.randint(1, 10**9) for _ in range(10_000)], [rng.randint(1, 10**6) for _ in range(10_000)]
    began = time.perf_counter()
    s = packing.Schedule(totals, weights, 1024, 64)
    assert time.perf_counter() - began < 1 and len(pickle.dumps(s)) < 10**6
    ends = np.array([min(t, 64 * (1 + t // 200)) for t in totals])
    r = s.round_of(np.arange(10_000), ends)
    for i in rng.sample(range(10_000), 60):
        before, now = s.after(np.array([r[i] - 1, r[i]]))[:, i]
        assert before < ends[i] <= now
    few = packing.Schedule(totals[:9], [10**17 + w for w in weights[:9]], 1024, 64)  # beyond 64 bits
    r = few.round_of(np.arange(9), ends[:9])
    assert all(few.after(np.array([r[i] - 1]))[0, i] < ends[i] <= few.after(np.array([r[i]]))[0, i] for i in range(9))


def test_sources_without_a_weight_are_refused(spark):
    with pytest.raises(ValueError, match="no weight"):
        packing.pack(documents(spark, odd_rows()), tokenizer(), weights={"a": 0.7, "b": 0.3})


def test_schedule_keeps_proportions_at_every_size():
    for totals, weights in (([10**10, 3 * 10**9, 1000], None), ([10**9, 10**9], [10**17 + 1, 3 * 10**17])):
        weights = weights or totals
        s = packing.Schedule(totals, weights, 1024, 64)
        whole, rounds = sum(weights), np.array([1, 7, 1000, 500_000])
        for r, row in zip(rounds.tolist(), s.after(rounds).tolist()):
            assert row == [r * 1024 * w // whole // 64 * 64 for w in weights]
        for q, t in enumerate(totals):
            if r_ends := [e for e in (64, 6400) if e <= t]:
                got = s.round_of(np.full(len(r_ends), q), np.array(r_ends))
                assert got.tolist() == [-(-e * whole // (1024 * weights[q])) for e in r_ends]


def test_many_queues_are_looked_at_in_parts(monkeypatch):
    rng = random.Random(11)
    totals = [rng.randint(1, 900) for _ in range(300)]
    s = packing.Schedule(totals, totals, 256, 16)
    q = np.arange(300)
    whole = [x.tolist() for x in s.pieces(q, np.zeros(300, np.int64), np.array(totals))]
    monkeypatch.setattr(packing, "CELLS", 700)
    assert [x.tolist() for x in s.pieces(q, np.zeros(300, np.int64), np.array(totals))] == whole


def test_fractional_weights():
    assert packing.exact_weights([0.7, 0.3]) == [7, 3] and packing.exact_weights([1, 3]) == [1, 3] and packing.exact_weights([0.5, 2]) == [1, 4]
    with pytest.raises(ValueError):
        packing.exact_weights([1, 0])


def check_pieces(rows, pieces, window=1024):
    enc = packing.TextEncoder.of(tokenizer())
    want = Counter()
    for i, t, *_ in rows:
        want[(i, np.frombuffer(enc.encode(t or ""), enc.dtype).astype("<u4").tobytes() + b"\0\0\0\0")] += 1
    placed = sorted((p.sequence_id * window + p.offset, p) for p in pieces)
    end = 0
    for at, p in placed:
        assert at == end and p.offset + p.length <= window and zlib.crc32(bytes(p.ids)) == p.ids_crc32
        end = at + p.length
    assert end == sum(len(x) // 4 * n for (_, x), n in want.items())
    by = defaultdict(list)
    for p in pieces:
        by[(p.doc_id, p.doc_tokens)].append(p)
    for (i, n), ps in by.items():
        texts = [x for (j, x), k in want.items() if j == i and len(x) // 4 == n for _ in range(k)]
        for s in {p.start for p in ps}:
            assert all(bytes(p.ids) == texts[0][4 * s : 4 * (s + p.length)] or len(set(texts)) > 1 for p in ps if p.start == s)
        assert sum(p.length for p in ps) == n * len(texts)


def test_pack(spark):
    rows = odd_rows()
    check_pieces(rows, packing.pack(documents(spark, rows).repartition(5), tokenizer()).collect())
    assert packing.pack(documents(spark, []), tokenizer()).collect() == []
    mixed = packing.pack(documents(spark, rows), tokenizer(), weights={"a": 1, "b": 3, "c": 0.5, None: 1, "unseen": 9}).collect()
    check_pieces(rows, mixed)


# -- chat


def test_chat_reads_back(spark):
    hard = ["\\### Assistant: </turn> ok", "<turn>user<text>", "\\", "\\<", "", None, "a\nb", "</turn>\n<turn>assistant<text>x", "😀" * 50]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(hard)] + [(2, 0, "assistant", "hi"), (2, 0, "assistant", "hi"), (None, 3, "<role>", "t"), (4, None, None, "first"), (4, 1, "assistant", "z" * 100000)]
    rows += [(5, i, "assistant", f"hot {i}") for i in range(700)]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, block string")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(chat.to_events(d))).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(said)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].formatted_chars == len(chat.render([(r, x) for _, r, x in turns])[0])
    assert chat.format_chats(chat.to_events(d.limit(0))).count() == 0


def test_events_fold(spark):
    rng = random.Random(8)
    kinds, log, want = ["delta"] * 6 + ["edit", "regenerate", "delete"], [], {}
    for m in range(40):
        text, alive, role = "", False, None
        for k in range(rng.randint(1, 30)):
            kind, t = rng.choice(kinds), rng.choice("xyz") * rng.randint(0, 3)
            seq = m + 100 * k
            log.append((0, seq, m, kind, "user" if k == 0 else None, t))
            text = "" if kind in ("regenerate", "delete") else t if kind == "edit" else text + t
            alive = kind != "delete"
        if alive:
            want[m] = text
    rng.shuffle(log)
    d = spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string").repartition(4)
    assert {r.message: r.text for r in chat.fold_events(d).collect()} == want


# -- language ID


def test_langid(spark):
    d = spark.read.parquet(f"{ROOT}/sf0.01/documents.parquet")
    got = QUERIES["op3_langid"](spark, f"{ROOT}/sf0.01")
    j = got.join(d.select("doc_id", "lang"), "doc_id").collect()
    assert len(j) == d.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in j)
    held = [r for r in j if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    model = langid.fit(d)
    odd = {r.doc_id: r for r in langid.identify(documents(spark, odd_rows()), model).collect()}
    assert [odd[i].lang_pred for i in (-3, 1000, 1001)] == ["und"] * 3 and odd[1003].lang_pred in model.langs
    assert langid.identify(documents(spark, []), model).count() == 0
    kept = langid.identify(d.limit(5).withColumn("lang_pred", F.lit(1)), model, keep=True)
    assert kept.columns[-4] == "_lang_pred" and kept.count() == 5
    assert langid.identify(d.limit(3), langid.fit(d.limit(0))).first().lang_pred == "und"


def test_langid_decodes_by_definition(spark):
    """Margins and decoding against plain loops; the fit reads a sampled text to its end."""
    import math

    d = spark.read.parquet(f"{ROOT}/sf0.001/documents.parquet")
    model = langid.fit(d)
    for r in d.orderBy("doc_id").limit(40).collect():
        if not r.text or not langid.LETTER.search(r.text):
            continue
        raw = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in r.text.lower().encode())
        norm = b" " + b" ".join(raw.split()) + b" "
        places = [((int.from_bytes(norm[i : i + n], "big") + n) * 2654435761 % 2**32) >> 17 for n in range(1, 5) for i in range(len(norm) - n + 1)]
        m = [sum(float(model.table[p, b]) for p in places) / len(places) * model.scale[b] for b in range(model.table.shape[1])]
        loss = [sum(w * math.log1p(math.exp(-c * x)) for w, c, x in zip(model.bit_weight, row, m)) for row in model.code]
        p = [math.exp(min(loss) - x) for x in loss]
        lang, score, close, bits = model.predict(r.text)
        best = min(range(len(loss)), key=loss.__getitem__)
        assert lang == model.langs[best] and abs(score - p[best] / sum(p)) < 1e-3 and bits == "".join("1" if x > 0 else "0" for x in m)
    tail = "word " * 60_000
    rows = [(i, tail + x * 2000, lang) for i, (x, lang) in enumerate([("qqqq ", "q"), ("zzzz ", "z")] * 5)]
    late = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [late.predict("qqqq qqqq")[0], late.predict("zzzz zz")[0]] == ["q", "z"]


def test_codebook():
    for k in (2, 3, 4, 5, 9, 20):
        c = langid.codebook(k)
        apart = [(c[a] != c[b]).sum() for a in range(k) for b in range(a)]
        assert min(apart) >= (1 if k == 2 else 2)


# -- mixing


def test_mix(spark):
    rows = odd_rows()
    got = mixing.mix(documents(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w])
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        left, w = sum(sizes.values()) - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        target = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / w for s in names}
        over = {s for s in names if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    taken = defaultdict(int)
    for r in got:
        assert r.taken <= 3 * r.size and r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        taken[r.source] += r.taken
    assert all(taken[s] == int(target[s] + 1e-9) for s in names)
    again = mixing.mix(documents(spark, rows).repartition(6)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(documents(spark, [])).count() == 0


def test_mixed_rows(spark):
    rows = odd_rows() + [(None, f"no id {i}", "en", "a") for i in range(300)] + [(9, "one row many times over", "en", "b")] * 400
    d = documents(spark, rows).repartition(4)
    out = mixing.mixed_rows(d)
    assert out.columns == d.columns
    got, words, middle = Counter(), defaultdict(int), {}
    for r in out.collect():
        size = len([w for w in re.split(r"[\x20\x09-\x0D]+", r.text or "") if w])
        got[r.source, r.doc_id, size] += 1
        words[r.source] += size
    want, target = Counter(), {}
    for r in mixing.mix(d).collect():  # whole documents: a pass ends at the one whose middle meets the target
        rest = int(r.target) - r.epochs * r.source_size
        want[r.source, r.doc_id, r["size"]] += r.epochs + (rest > 0 and r.place + r["size"] / 2 <= rest)
        target[r.source] = r.target
        middle[r.source] = max(middle.get(r.source, 0), r["size"])
    assert +want == got
    assert all(abs(words[s] - target[s]) <= middle[s] for s in target)


def test_mixed_rows_cut_inside_equal_rows(spark, tmp_path):
    """A cut through 500 rows of one doc_id takes as many as the target asks for, over files."""
    rows = [(7, "ten words " * 5, "en", "a")] * 500 + [(i, "other words " * 5, "en", "b") for i in range(100)]
    documents(spark, rows).repartition(5).write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    for cycle in ((1, 1), (1, 7)):
        n = Counter(r.source for r in mixing.mixed_rows(d, weight_cycle=cycle).collect())
        goal = {r.source: r.target for r in mixing.mix(d, weight_cycle=cycle).collect()}
        assert all(abs(10 * n[s] - goal[s]) <= 10 for s in goal), (n, goal)


def test_hot_keys_of_mixing_and_sharding_spread(spark, monkeypatch):
    """A third of all rows on one doc_id: stretches are counted, copies come in chunks."""
    monkeypatch.setattr("corpusloom.llm.common.COPIES", 50)
    rows = [(i, f"word {i}", "en", "a") for i in range(400)] + [(5, "the same again", "en", "a")] * 130 + [(None, f"n {i % 3}", "en", "b") for i in range(170)]
    d = documents(spark, rows).repartition(6)
    got = mixing.mix(d).collect()
    assert len(got) == len(rows) and Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)
    for s in "ab":
        placed = sorted((r.place, r["size"]) for r in got if r.source == s and r["size"])
        assert [p for p, _ in placed] == np.cumsum([0] + [n for _, n in placed[:-1]]).tolist()
    shards = sharding.shard(d, shards=4).collect()
    assert len(shards) == len(rows)
    same = Counter(r.vslot for r in shards if r.doc_id == 5)
    assert max(same.values()) <= sharding.PIECE + 1 and len({r.vslot for r in shards if r.doc_id is None}) >= 3


# -- sharding


def test_shard(spark):
    rows = odd_rows()
    got = sharding.shard(documents(spark, rows).repartition(3), shards=6).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"}
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    rest = sorted(sum(r["size"] for r in rs) for rs in by.values())[:-1]
    assert max(rest) - min(rest) < 600  # all but the shard that holds the one long text
    assert sharding.shard(documents(spark, [])).count() == 0
    # an independent assignment: heaviest slot first, each to the lightest shard
    load, rows_of = Counter(), Counter()
    for r in got:
        load[r.vslot] += r["size"]
        rows_of[r.vslot] += 1
    fill, home = [0] * 6, {}
    for v in sorted(load, key=lambda v: (-load[v], v)):
        home[v] = fill.index(min(fill))
        fill[home[v]] += load[v]
    assert all(r.shard == home[r.vslot] for r in got)
    first = {v: sum(rows_of[u] for u in rows_of if home[u] == home[v] and u < v) for v in rows_of}
    for v in rows_of:
        assert sorted(r.slot - first[v] for r in got if r.vslot == v) == list(range(rows_of[v]))


def test_slot_map_versions(spark):
    rng = random.Random(1)
    slots = spark.createDataFrame([(i, rng.randint(1, 500), 1) for i in range(400)], "vslot int, bytes long, rows long")
    one = sharding.assign(slots, 8)
    two = sharding.grow(one, 8)
    a, b = ({r.vslot: r for r in d.collect()} for d in (one, two))
    loads = Counter()
    for r in b.values():
        loads[r.shard] += r.bytes
    assert all(b[v].shard in (a[v].shard, 8) for v in a) and {r.version for r in b.values()} == {2}
    assert len(loads) == 9 and max(loads.values()) < 1.25 * sum(loads.values()) / 9 and loads[8] > 0
    again = {r.vslot: r.shard for r in sharding.assign(slots.repartition(7), 8).collect()}
    assert again == {v: r.shard for v, r in a.items()}


# -- exact dedup


def test_exact(spark):
    rows = odd_rows()
    got = exact_dedup.exact_groups(documents(spark, rows).repartition(4)).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").encode().lower()].append(i)
    assert len(got) == len(rows)
    sha = {hashlib.sha256(n).hexdigest(): ids for n, ids in groups.items()}
    kept = Counter()
    for r in got:
        ids = sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max(ids, key=lambda x: -1e9 if x is None else x) and (r.keep_id == r.doc_id or not r.kept)
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    assert exact_dedup.exact_groups(documents(spark, [])).count() == 0


def test_filters_merge_losslessly(spark):
    rng = np.random.default_rng(0)
    fp = np.r_[rng.integers(-(2**63), 2**63, 30000), np.full(9000, 77), np.repeat(rng.integers(-(2**63), 2**63, 500), 2)]
    d = spark.createDataFrame([(int(x),) for x in fp], "fp long").repartition(6)
    for rows in (len(fp), 2_000_000):  # one block, and several
        got = {r.fp: r.n for r in exact_dedup.repeated_fingerprints(d, rows).collect()}
        short = (fp.view(np.uint64) >> np.uint64(64 - exact_dedup.fingerprint_bits(rows))).tolist()
        assert got == {k: n for k, n in Counter(short).items() if n > 1}


def test_filter_reads_back_and_is_small():
    rng = np.random.default_rng(1)
    for n, width in ((1, 20), (5, 3), (1000, 30), (100_000, 34), (3, 63)):
        values = np.unique(rng.integers(0, 2**width, n).astype(np.uint64))
        counts = np.where(rng.random(len(values)) < 0.1, rng.integers(2, 10**6, len(values)), 1)
        f = exact_dedup.encode_filter(values, counts, width)
        v, c = exact_dedup.decode_filter(f, width)
        assert v.tolist() == values.tolist() and c.tolist() == counts.tolist()
    values = np.unique(rng.integers(0, 2**34, 100_000).astype(np.uint64))
    f = exact_dedup.encode_filter(values, np.ones(len(values), np.int64), 34)
    assert sum(len(f[c]) for c in exact_dedup._BLOB) < 3.2 * len(values)  # bytes; the fingerprints have 8 each


def test_exact_repeated_rows_are_counted(spark, monkeypatch):
    """A third of all rows one document stored again and again: one of them stays."""
    monkeypatch.setattr("corpusloom.llm.common.COPIES", 20)
    rows = [(i, f"text {i % 150}", "en", "a") for i in range(300)] + [(999, "Text 7", "en", "a")] * 170 + [(None, "null id", "en", "a")] * 30
    got = exact_dedup.exact_groups(documents(spark, rows).repartition(4)).collect()
    kept, seen = Counter(), Counter()
    for r in got:
        kept[r.text_sha256] += r.kept
        seen[r.doc_id] += 1
    assert len(got) == len(rows) and set(kept.values()) == {1} and seen[999] == 170 and seen[None] == 30


# -- license scan


def license_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def license_places(text):
    """Words and exact places by definition."""
    words, found = license_words(text), []
    for p, label in license_scan.PHRASES.items():
        want = p.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    return len(words), sorted(found)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def license_spans(text, raw, k):
    """Spans of one notice by definition: of the word ranges that overlap the first with up to
    ``k`` edits, the one with the fewest; then on behind it."""
    words = [w.encode() for w in license_words(text)]
    at = [0]
    for w in words:
        at.append(at[-1] + len(w) + 1)
    near = []
    for i in range(len(words)):
        for j in range(i, len(words)):
            n = at[j + 1] - 1 - at[i]
            if n > len(raw) + k:
                break
            if abs(n - len(raw)) <= k and (d := edits(b" ".join(words[i : j + 1]), raw)) <= k:
                near.append((i, j, d))
    out, behind = [], -1
    for i, j, _ in near:
        if i > behind:
            d, a, e = min((d, a, e) for a, e, d in near if a > behind and i <= a <= j)
            out.append((a, e, d))
            behind = e
    return out


def test_license_spans_by_definition():
    scanner, rng = license_scan.Scanner(license_scan.PHRASES, license_scan.NOTICES), random.Random(9)
    fixed = ["undr the mit license under the mit license", "all rihts reserved all rights reserved all rights rserved", "a under the mit license", "under the mit license " * 30]
    for turn in range(160):
        text = fixed[turn] if turn < len(fixed) else ""
        while len(text) < 120 and turn >= len(fixed):
            t = list(rng.choice([*license_scan.NOTICES]))
            for _ in range(rng.randint(0, 3)):
                p = rng.randrange(len(t))
                t[p : p + 1] = rng.choice([[], ["q"], [t[p], " "], [t[p], "z"], [" "]])
            text += "".join(t) + rng.choice([" ", " a ", " foo the ", " reserved "])
        got = defaultdict(list)
        for s in scanner.scan(text)["spans"]:
            got[s["label"]].append((s["first"], s["last"], s["errors"]))
        for raw, label, k, *_ in scanner.notices:
            assert got[label] == license_spans(text, raw, k), (text, label)


def test_license_long_texts_of_one_phrase():
    import time

    scanner, took = license_scan.Scanner(license_scan.PHRASES, license_scan.NOTICES), []
    for n in (20_000, 80_000):
        start = time.monotonic()
        r = scanner.scan("under the mit license " * n)
        took.append(time.monotonic() - start)
        assert r["n_base"] == len(r["spans"]) == n and r["last_word"] == 4 * (n - 1)
    assert took[1] < 10 * took[0]


def test_license(spark):
    rows = odd_rows(20) + [(9000, "Under the MIT license. under the mit, LICENSE under the mit licenses", "en", "a"), (9001, "licensed under the GNU Genera1 Public Licence!", "en", "a"), (9002, "Apache License, Version 2.0; CC-BY-NC", "en", "a"), (9003, "cc by ncé", "en", "a"), (9004, "x " * 5000 + "All Rights Reservd" + " y" * 5000, "en", "a")]
    got = {(r.doc_id): r for r in license_scan.scan_licenses(documents(spark, rows)).collect()}
    for i, t, *_ in rows:
        n, found = license_places(t)
        r = got[i]
        assert (r.n_words, r.n_base) == (n, len(found)) and r.first_word == (found[0][0] if found else None) and r.last_word == (found[-1][0] if found else None)
        assert r.base_labels == ",".join(sorted({x for _, x in found})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert got[9000].n_base == 2 and got[9001].labels == "gpl" and 0.8 < got[9001].score < 1 and got[9002].base_labels == "apache-2,cc-by-nc" and got[9003].n_base == 0
    assert got[9004].labels == "all-rights-reserved" and got[9004].spans[0].first == 5000
    assert license_scan.scan_licenses(documents(spark, [])).count() == 0


def test_seeds_find_all_errors():
    """Whatever the edits, up to the bound, a notice is found (pigeonhole)."""
    s, rng = license_scan.Scanner(license_scan.PHRASES, license_scan.NOTICES), random.Random(6)
    for raw, label, k, *_ in s.notices:
        for _ in range(40):
            t = list(raw.decode())
            for _ in range(rng.randint(0, k)):
                p = rng.randrange(1, len(t) - 1)
                t[p : p + 1] = rng.choice([[], ["q"], [t[p], "z"]])
            if "  " in "".join(t):
                continue  # a word is gone, which is an edit more
            assert label in s.scan("foo bar " + "".join(t) + " baz")["labels"].split(","), ("".join(t), label)


# -- SimHash


def test_simhash(spark):
    rows = odd_rows()
    got = simhash.near_duplicates(documents(spark, rows).repartition(4)).collect()
    import xxhash

    def brute(t):
        w = (t or "").encode().lower().split()
        g = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in g]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    fp = [brute(t) for _, t, *_ in rows]
    par = list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                par[find(i)] = find(j)
    low = defaultdict(list)
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            low[find(k)].append(i)
    want = Counter((rows[k][0], f"{fp[k]:016x}", min(low[find(k)], default=None)) for k in range(len(rows)))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_links_find_every_near_pair(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {b ^ sum(1 << x for x in rng.sample(range(64), k)) for b in base for k in (0, 1, 2, 3, 4)}
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    d = spark.createDataFrame([(x,) for x in signed], "fp long")
    root = {r.node: r.root for r in graph.components(simhash.links(d)).collect()}
    par = {x: x for x in signed}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in signed:
        for b in signed:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                par[max(find(a), find(b))] = min(find(a), find(b))
    assert {x: root.get(x, x) for x in signed} == {x: find(x) for x in signed}


def test_odd_radius_raises(spark):
    with pytest.raises(ValueError, match="even"):
        simhash.links(spark.createDataFrame([(0,), (7,)], "fp long"), radius=3)


def test_hot_fingerprints_spread(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 20)
    rows = [(i, None if i % 3 else "some other words here", "en", "a") for i in range(300)]
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    assert len(got) == 300 and {r.doc_id: r.component_id for r in got} == {i: 1 if i % 3 else 0 for i in range(300)}


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- WARC


def test_warc(spark):
    inner = "a\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nContent-Length: 100000\r\n\r\n"
    big = "x" * 200
    rows = [(1, "http://a", big), (2, None, big), (3, "u\r\nx", inner), (4, "u", None), (5, "u", ""), (6, "u", "é" * 60), (7, "u", "é" * 60), (8, "u", inner * 3), (9, "q", "short"), (10, "q", "short"), (1, "again", big), (None, "n", "y" * 300), (11, "l", "long " * 50000)]
    rows += [(100 + i, "hot", "z" * 150) for i in range(40)]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(d).collect())
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)

    def want(i, h):
        h = h or ""
        again = i is not None and len(h.encode()) >= 100 and first[h] != i
        return i, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "revisit" if again else "response", first[h] if again else None

    assert got == Counter(want(i, h) for i, _, h in rows)
    assert warc.round_trip(d.limit(0)).count() == 0


def test_warc_repeated_page_ids(spark, monkeypatch):
    """A page stored with two payloads: a revisit returns the payload it was written for. Large
    pages have archives of their own, null ids are responses."""
    monkeypatch.setattr(warc, "LARGE_PAGE", 1000)
    a, b = "A" * 150, "B" * 150
    rows = [(5, "u", b), (5, "u", a), (9, "u", a), (None, "u", a), (10, "u", b), (11, "u", "c" * 5000), (12, "u", "c" * 5000)]
    for part in (rows, rows[::-1]):
        d = spark.createDataFrame(part, "page_id long, url string, html string").repartition(2)
        got = Counter((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(d).collect())
        sha = lambda h: hashlib.sha256(h.encode()).hexdigest()
        assert got == Counter([(5, sha(b), "response", None), (5, sha(a), "response", None), (9, sha(a), "revisit", 5), (None, sha(a), "response", None), (10, sha(b), "revisit", 5), (11, sha("c" * 5000), "response", None), (12, sha("c" * 5000), "revisit", 11)])


def test_many_magics_are_read_once():
    """Magics without a blank line: linear, and the last before a blank line is the candidate."""
    import time

    content = warc.MAGIC * 200_000 + b"Content-Length: 2\r\n\r\nok\r\n\r\n"
    start = time.monotonic()
    found = list(warc.candidates(content))
    assert time.monotonic() - start < 5 and [c[0] for c in found] == [199_999 * len(warc.MAGIC)] and found[0][1] == len(content)


# -- nearest neighbours


def test_index_retrieves_the_whole_ball():
    """Probing by ``reach`` holds every code within tables * (reach + 1) - 1 bits, and reads what
    near substrings hold and nothing else."""
    rng = np.random.default_rng(1)
    x, turn = rng.standard_normal((3000, 40)), ann.rotations(rng.standard_normal((500, 40)), 8 * 11)
    near = x[:20] + 0.05 * rng.standard_normal((20, 40))
    code, asked = ann.Codes(x, turn, 11), ann.Codes(near, turn, 11)
    for reach in (0, 1, 2):
        index = ann.MultiIndex(code, 11, reach)
        radius = 8 * (reach + 1) - 1
        for i in range(20):
            apart = np.bitwise_count(code.sub ^ asked.sub[i])
            assert index.within(asked, i, radius).tolist() == np.flatnonzero(apart.sum(1) <= radius).tolist()
            before = index.touched
            assert index.hits(asked.sub[i]).tolist() == np.flatnonzero((apart <= reach).any(1)).tolist()
            assert index.touched - before == (apart <= reach).sum() < len(x)


def test_index_decides():
    """A wrong table changes the answer, and few rows are touched where vectors have neighbours."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((1000, 32)), 8, axis=0) + 0.2 * rng.standard_normal((8000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ask = rng.permutation(8000)[:200]
    near = np.argsort(-(x[ask] @ x.T), axis=1)[:, 1:6]
    plan = ann.learn(x[rng.permutation(8000)[:2000]], 1.0, np.repeat(x[ask], 5, axis=0), x[near.ravel()], 8000)
    code, asked = ann.Codes(ann.lift(x, 1.0), plan.turn, plan.width), ann.Codes(np.hstack([x[:200], np.zeros((200, 1))]), plan.turn, plan.width)
    index, found = ann.MultiIndex(code, plan.width, plan.reach), 0
    for i in range(200):
        best = set(np.argsort(-(x @ x[i]))[:6].tolist())
        found += len(best & set(index.within(asked, i, plan.radius).tolist())) / 6
    assert found / 200 > 0.9 and index.touched / 200 < 0.02 * 8000
    wrong = ann.MultiIndex(code, plan.width, plan.reach)
    wrong.start[:] = wrong.start[:, :1]  # tables whose lists are empty
    assert all(len(wrong.within(asked, i, plan.radius)) == 0 for i in range(200))


def test_nearest_repeated_queries_and_short_answers(spark):
    """A query row stored twice asks once; rows stored often are candidates each; a query that
    probing leaves short is answered from all rows."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(20, x[20].tolist())] * 3 + [(7, x[7].tolist())] * 30
    rows += [(100, (-x[0]).tolist())]  # a query opposite to most
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score, r.rank))
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    assert sorted(got) == [0, 20, 40, 100]
    for q, found in got.items():
        assert [f[2] for f in found] == list(range(1, 21))
        s = m @ m[np.flatnonzero(ids == q)[0]]
        best = sorted((-s[ids != q]).tolist())[:20]
        times = Counter(f[0] for f in found)
        assert all(times[v] <= (ids == v).sum() for v in times) and q not in times
        assert sum(abs(-b - f[1]) < 1e-9 for b, f in zip(best, found)) >= 10


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 24)) * rng.uniform(0.2, 3, (900, 1))
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    rows += [(1000, None, "n"), (1001, [0.0] * 24, "z"), (1002, [float("nan")] + [1.0] * 23, "f"), (1003, [None] + [1.0] * 23, "c"), (1004, [1.0], "d"), (1005, x[3].tolist(), "tie"), (1005, x[3].tolist(), "twice")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(3)
    got = defaultdict(list)
    for r in ann.nearest(d).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ids, m = np.r_[np.arange(900), 1005, 1005], np.vstack([x, x[3], x[3]])
    assert sorted(got) == list(range(0, 900, 20))
    hit = 0
    for q, found in got.items():
        s = m @ x[q]
        ok = ids != q
        best = sorted(zip(-s[ok], ids[ok]))[:20]
        assert len(found) == 20 and [f[1] for f in found] == sorted((f[1] for f in found), reverse=True)
        assert all(abs(sc - m[np.flatnonzero(ids == v)[0]] @ x[q]) < 1e-9 for v, sc in found)
        hit += len({b[1] for b in best} & {f[0] for f in found}) / len({b[1] for b in best})
    assert hit / len(got) >= 0.95
    few = ann.nearest(d.filter("vec_id < 5")).collect()
    assert len(few) == 4 and ann.nearest(d.limit(0)).count() == 0


# -- pipeline


def test_pipeline(spark):
    import corpus_pipeline as P

    rows = odd_rows() + [(20000 + i, f"Plain document number {i} tells its own story about the {w} and its {v}.", "en", "a") for i, (w, v) in enumerate((w, v) for w in ("sea", "hill", "road") for v in ("end", "start"))]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = documents(spark, rows).select(*names)
    kept = P.language_id(spark, docs, "")
    assert kept.columns == names and sorted((r.doc_id or 0) for r in docs.collect() if r.text and langid.LETTER.search(r.text)) == sorted((r.doc_id or 0) for r in kept.collect())
    once = P.exact_dedup(spark, kept, "")
    texts = [r.text.encode().lower() for r in once.collect()]
    assert once.columns == names and len(texts) == len(set(texts)) == len({r.text.encode().lower() for r in kept.collect()})
    near = P.near_dedup(spark, once, "")
    assert near.columns == names and {20000, 20001, 20002, 20003, 20004, 20005} <= {r.doc_id for r in near.collect()}
    fps = [simhash.fingerprint(r.text) for r in near.collect()]
    assert all((a ^ b).bit_count() > 2 for i, a in enumerate(fps) for b in fps[:i])
    mixed = P.mixing(spark, near, "")
    assert mixed.columns == names and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in near.collect()}
    pieces = P.packing(spark, mixed, "").collect()
    check_pieces([(r.doc_id, r.text) for r in mixed.collect()], pieces)
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name


def test_pipeline_run(spark):
    import corpus_pipeline as P
    from corpusloom.llm import common

    with common.scratch() as made:
        result = P.run(spark, f"{ROOT}/sf0.001")
    there = [p for p in made if spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))]
    assert sorted(p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in there) == ["stage-mixing", "token-sums", "tokens"]
    out = result.agg(F.sum("length"), F.max("sequence_id"), F.countDistinct("sequence_id")).first()
    assert out[1] + 1 == out[2] and 1024 * (out[2] - 1) < out[0] <= 1024 * out[2]


def test_stages_drop_the_same_rows_however_they_are_read(spark, tmp_path):
    """Repeated and null doc_ids; the files are read in other splits the second time."""
    import corpus_pipeline as P

    rows = odd_rows() + [(9, "Stored thrice in this table", "en", "a")] * 3 + [(9, "stored thrice in this table", "en", "b")] + [(None, f"null id number {i}", "en", "a") for i in range(20)]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    documents(spark, rows).select(*names).repartition(24).write.parquet(str(tmp_path / "d"))
    seen = []
    for size in ("128MB", "1KB"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        docs = spark.read.parquet(str(tmp_path / "d"))
        plan = [stage(spark, docs, "") for stage in (P.exact_dedup, P.near_dedup)]
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1KB" if size == "128MB" else "128MB")
        seen.append([sorted(map(str, d.collect())) for d in plan])
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1]
    kept = [r for r in seen[0][0] if "tored thrice" in r]
    assert len(kept) == 1 and len(seen[0][0]) == len({(t or "").encode().lower() for _, t, *_ in rows})


def test_nothing_else_imports_llm():
    import pathlib

    root = pathlib.Path(__file__).parents[2]
    for p in (root / "corpusloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
    assert json is not None


def odd_names(docs):
    """``docs`` with columns of every name that the stages use inside, and some of the file source's."""
    names = ["__row", "__ROW2", "__at", "__file", "__id", "___key", "key", "file", "at", "of", "cut", "some", "_metadata", "lang_pred", "salt", "place", "n"]
    return docs.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in names))


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline as P

    docs = documents(spark, odd_rows()).select("doc_id", "text", "lang", "source", "n_chars")
    odd_names(docs).repartition(3).write.parquet(f"{tmp_path}/odd")
    odd = spark.read.parquet(f"{tmp_path}/odd")
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, odd, "")
        assert got.columns == odd.columns, name
        rows = got.collect()
        assert rows and all(r["__row"] == (None if r.doc_id is None else f"__row{r.doc_id}") for r in rows), name
        want = stage(spark, odd.select("doc_id", "text", "lang", "source", "n_chars"), "").groupBy("doc_id").count().collect()
        assert Counter(r.doc_id for r in rows) == {r.doc_id: r["count"] for r in want}, name


def test_no_id_rules_the_language_fit(spark):
    """Null ids, one id for most rows and one text stored very often leave the fit as good."""
    words = {"en": "the of and that house water people never", "de": "der und nicht haus wasser leute niemals das", "fr": "le et ne pas maison eau gens jamais", "it": "il e non casa acqua gente mai che", "pt": "o e não casa água gente nunca que", "nl": "de en niet huis water mensen nooit het"}
    rng = random.Random(3)
    say = lambda k: " ".join(rng.choice(words[k].split()) for _ in range(40))
    rows = [(None if i % 2 else 7, say(k), k) for k in words for i in range(700)] + [(9, "zzz qqq", "en")] * 4000 + [(None, None, "en"), (1, "", "de"), (2, "x", None)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == sorted(words)
    asked = [(k, model.predict(say(k))) for k in words for _ in range(50)]
    assert sum(k == p[0] for k, p in asked) / len(asked) > 0.98
    by = {k: np.mean([p[1] for kk, p in asked if kk == k]) for k in words}
    assert min(by.values()) > 0.8 * max(by.values()), by


def test_hot_fingerprints_are_spread_by_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 10)
    rows = [(5, "one and the same text", "en", "a")] * 60 + [(None, None, "en", "a")] * 25 + [(i, f"different words {i} " * 9, "en", "a") for i in range(20)]
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert {r.component_id for r in got if r.doc_id == 5} == {5}
    plan = simhash.near_duplicates(documents(spark, rows))._jdf.queryExecution().analyzed().toString()
    assert "salt" in plan and "xxhash64(doc_id" not in plan


def test_edited_log_folds_back_to_the_turns(spark):
    rows = [(1, 0, "user", "abcdefg"), (1, 1, "assistant", ""), (1, 2, None, None), (1, 4, "assistant", "x" * 5000), (2, 0, "user", "é😀"), (None, None, "user", "late"), (3, 7, "assistant", "one"), (3, 7, "assistant", "one"), (4, -2, "user", "before")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    log = chat.edited_log(d)
    assert {r.kind for r in log.select("kind").collect()} == {"delta", "regenerate", "edit", "delete"}
    assert log.count() == 5 * len(rows) + 2 * sum(t is not None and t % 4 == 0 for _, t, _, _ in rows)
    plain = chat.digests(chat.format_chats(chat.to_events(d))).collect()
    assert sorted(map(tuple, chat.digests(chat.format_chats(log)).collect()), key=str) == sorted(map(tuple, plain), key=str)
    folded = Counter((r.conv_id, r.role, r.text) for r in chat.fold_events(log).collect())
    assert folded == Counter((c, r or "", t or "") for c, _, r, t in rows)


def test_the_next_map_moves_slots_into_the_new_shard_only(spark):
    rows = odd_rows() + [(90_000 + i, "filler " * (i % 50), "en", "a") for i in range(2000)]
    got = sharding.shard(documents(spark, rows), shards=5).collect()
    assert all(r.next_shard in (r.shard, 5) for r in got) and {r.next_shard for r in got} == {0, 1, 2, 3, 4, 5}
    load = Counter()
    for r in got:
        load[r.next_shard] += r.size
    assert max(load.values()) < 1.3 * sum(load.values()) / 6 + max(r.size for r in got)


def test_no_good_tables_mean_a_search_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "TABLES", 1)
    monkeypatch.setattr(ann, "REACH", 0)
    rng = np.random.default_rng(12)
    x = rng.standard_normal((400, 32))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    with pytest.warns(UserWarning, match="all rows are searched"):
        got = ann.nearest(d, k=5).collect()
    for q in range(0, 400, 20):
        best = sorted((-float(x[q] @ x[i]), i) for i in range(400) if i != q)[:5]
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [i for _, i in best]


def test_hot_pages_are_spread_over_keys(spark, monkeypatch):
    rows = [(i, f"http://h/{i}", "x" * 150 if i % 2 else f"{i % 7} " * 80) for i in range(400)] + [(1000, "u", "small"), (1001, None, None)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    key = lambda x: sorted(map(tuple, x.collect()), key=str)
    plain = key(warc.round_trip(d))
    monkeypatch.setattr(warc, "REPEATED", 2)
    monkeypatch.setattr(warc, "HOT", 20)
    assert key(warc.round_trip(d)) == plain and sum(r[3] == "revisit" for r in plain) == 400 - 8
