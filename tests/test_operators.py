"""Operators against plain Python models of their descriptions, and edge cases."""

import hashlib
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import kernels as K
from corpusloom.functions import text as X
from corpusloom.operators import bpe, dialogue, joins, logic, sequence, spans, splits, stats, votes
from corpusloom.operators import chunking
from corpusloom.sources import binary, text_files

ODD = ["", " ", "“Æon”—naïve…", "ﬁne é\tñ", "a\r\nb\rc", "\x00x\x7fy", "Straße 12", "中文 «x»", "tab\there  two", None]


def col(spark, expr, rows, name="x"):
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {name} string")
    return [r.o for r in d.select("i", expr.alias("o")).orderBy("i").collect()]


#: Inputs with the result that the description of the normaliser asks for.
GENERALIST = {
    "": "",
    "“Æon”—naïve…": '"on"--naive...',
    "ﬁne é\tñ": "fine en",
    "a\r\nb\rc": "a\nbc",
    "\x00x\x7fy": "xy",
    "Straße 12": "Strae 12",
    "a  b   c": "a b c",
    "one\n\n\n\ntwo\n\nthree": "one\n\ntwo\n\nthree",
    "it’s ‘so’ – 中文": "it's 'so' - ",
    "½ ①": "12 1",
}


def test_generalist_ascii_by_table(spark):
    assert col(spark, X.generalist_ascii(F.col("x")), [*GENERALIST, None]) == [*GENERALIST.values(), None]


def test_browser_ascii_keeps_marks_as_question_marks(spark):
    assert col(spark, X.browser_ascii(F.col("x")), ["é", "—", "a\tb", "😀", "\x01"]) == ["e?", "--", "a b", "?", ""]


def test_strict_ascii(spark):
    assert col(spark, X.ascii_strict(F.col("x")), ["Æé–—…“x” ß"]) == ["AEe--...\"x\" ?"]


def test_clean_book(spark):
    body = "\n\n".join("word " * 120 + "“end”—é [Illustration: x]" for _ in range(10))
    book = f"Title\r\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\r\n{body}\r\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\r\nlicence"
    bad = [book.replace("*** END", "END"), book.replace("Title", "Copyright 1999"), book.replace("word ", "")]
    out = col(spark, X.clean_book(F.col("x")), [book, *bad])
    assert out[0] and '"end"--e' in out[0] and "Illustration" not in out[0] and out[0].endswith("\n") and out[1:] == [None] * 3


def test_clip(spark):
    texts = ["short", "one two three four five six", "x" * 30, "aaaaaaaaaaaaaaa b", None]
    tail = [None if t is None else "".join(map(chr, dialogue._content(t, 16, True))) for t in texts]
    head = [None if t is None else "".join(map(chr, dialogue._content(t, 16, False))) for t in texts]
    assert col(spark, X.clip_tail(F.col("x"), 16), texts) == tail
    assert col(spark, X.clip_head(F.col("x"), 16), texts) == head


def test_spans(spark):
    d = spark.createDataFrame([("Ana", "Zoë")], "a string, b string")
    r = d.select(spans.render_template("é {a} met {b}.", ["a", "b"]).alias("r")).first().r
    assert r.text == "é Ana met Zoë." and [(s.start, s.end) for s in r.spans] == [(3, 6), (11, 15)]
    for s in r.spans:
        assert r.text.encode()[s.start : s.end].decode() == s.text
    x = spark.createDataFrame([(r.text, [(s.field, s.start, s.end) for s in r.spans], {"a": "Bé"})], "text string, spans array<struct<field:string,start:int,end:int>>, v map<string,string>")
    y = x.select(spans.replace_fields(F.col("text"), F.col("spans"), F.col("v")).alias("y")).first().y
    assert y.text == "é Bé met Zoë." and [(s.start, s.end) for s in y.spans] == [(3, 6), (11, 15)]


def test_run_ids_and_merge(spark):
    d = spark.createDataFrame([(0, 1, "a"), (0, 2, "a"), (0, 3, None), (0, 4, "a")], "k int, i int, v string")
    assert [r.run for r in sequence.run_ids(d, ["k"], ["i"], "v").orderBy("i").collect()] == [0, 0, 1, 2]


def test_distributed_offsets_and_packing(spark):
    rng = random.Random(3)
    n = [rng.randint(0, 9) for _ in range(200)]
    d = spark.createDataFrame(list(enumerate(n)), "i long, n long")
    for rows in (7, 65_536):  # many buckets, and one
        got = {r.i: r.start for r in sequence.distributed_offsets(d, "i", "n", rows=rows).collect()}
        assert [got[i] for i in range(200)] == [sum(n[:i]) for i in range(200)]
    odd = spark.createDataFrame([(1, 3), (None, 5), (2, 4), (2, None), (2, 1)], "i long, n long")
    assert sorted((r.i or 0, r.n or 0, r.start) for r in sequence.distributed_offsets(odd, "i", "n", rows=1).collect()) == [(0, 5, 0), (1, 3, 5), (2, 0, 8), (2, 1, 8), (2, 4, 9)]
    assert sequence.distributed_offsets(odd.limit(0), "i", "n").count() == 0
    p = sequence.pack_segments(sequence.distributed_offsets(d, "i", "n"), "start", "n", 16)
    tokens = sorted((r.pack * 16 + r.offset + k, r.i, r.from_token + k) for r in p.collect() for k in range(r.piece))
    assert [t[0] for t in tokens] == list(range(sum(n)))
    assert [t[1:] for t in tokens] == [(i, k) for i in range(200) for k in range(n[i])]


def test_roster_meets_its_budget(spark):
    d = spark.createDataFrame([(0, 7), (1, 4), (2, 6)], "i long, n long")
    rows = sequence.roster(d, "i", "n", 37).orderBy("start").collect()
    assert sum(r["take"] for r in rows) == 37 and [r.i for r in rows] == [0, 1, 2, 0, 1, 2, 0]
    assert sequence.roster(d.limit(0), "i", "n", 5).count() == 0


def test_roster_cycles_through_every_record(spark, tmp_path):
    from corpusloom.plans.registry import QUERIES

    sizes = [3_000_000, 1, 0, 900_000, 40]  # more than 2,500,000 in all
    spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    budget, want, at, epoch = sum(sizes) * 5 // 2, [], 0, 0
    while at < budget:
        for i, n in enumerate(sizes):
            if (take := min(n, budget - at)) > 0:
                want.append((i, epoch, at, take))
                at += take
        epoch += 1
    got = QUERIES["w24_roster"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and {r.epoch for r in got} == {0, 1, 2}


def test_asof(spark):
    r = spark.createDataFrame([(0, 5, "a"), (5, 9, "b"), (20, 21, "c")], "s long, e long, n string")
    p = spark.createDataFrame([(x,) for x in (0, 4, 5, 9, 15, 20, 21)], "at long")
    got = {x.at: x.n for x in joins.asof_ranges(p, r, "at", "s", "e").collect()}
    assert got == {0: "a", 4: "a", 5: "b", 9: None, 15: None, 20: "c", 21: None}
    assert got == {x.at: x.n for x in joins.asof_ranges(p, r, "at", "s", "e", block=3).collect()}


def test_strict_lookup_raises(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="missing key"):
        joins.strict_lookup(a, b, ["k"]).collect()


def test_votes(spark):
    rows = [("e1", "r", 1, "A", 1), ("e2", "r", 1, "B", 2), ("e1", "r", 1, "A", 3), ("e3", "r", 2, "A", 4), ("e4", "r", 2, "withdraw", 5), ("e5", "s", 1, "skip", 6)]
    d = spark.createDataFrame([("p", r[1], r[0], r[2], r[3], r[4]) for r in rows], "packet_id string, reviewer_id string, event_id string, case_id int, choice string, arrival long")
    got = {(r.reviewer_id, r.case_id): r.choice for r in votes.effective_votes(d).collect()}
    assert got == {("r", 1): "B", ("s", 1): "skip"}
    bad = d.withColumn("choice", F.when(F.col("event_id") == "e5", "C").otherwise(F.col("choice"))).withColumn("case_id", F.when(F.col("event_id") == "e4", None).otherwise(F.col("case_id")))
    assert {(r.event_id, r.rule) for r in votes.invalid_votes(bad, "p").collect()} == {("e5", "choice"), ("e4", "case")}


def test_wilson_and_bootstrap(spark):
    r = spark.range(1).select(stats.wilson(F.lit(120.0), F.lit(200.0)).alias("w"), stats.wilson(F.lit(0.0), F.lit(0.0)).alias("z")).first()
    assert abs(r.w.low - 0.5308) < 1e-3 and abs(r.w.high - 0.6654) < 1e-3 and r.z is None
    w = spark.range(20000).select(stats.hash_poisson(F.col("id"), F.lit(1)).alias("w")).agg(F.avg("w"), F.var_samp("w")).first()
    assert abs(w[0] - 1) < 0.03 and abs(w[1] - 1) < 0.05


@pytest.fixture()
def few_windows(spark, tmp_path):
    rng = random.Random(17)
    rows = [(k, w, float(rng.randint(1, 50)), rng.uniform(900, 90000), rng.choice([0.0, 0.03, 0.08])) for k in (1, 2, 98, 195) for w in range(1, rng.randint(3, 5))]
    spark.createDataFrame([(*r, "N", "O") for r in rows], "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path), [(k, w, int(q), p / 1000, p / 1000 * (1 + d - 0.05)) for k, w, q, p, d in rows]


def test_numpy_bootstrap_takes_20000_draws(spark, few_windows):
    from corpusloom.plans.registry import QUERIES

    path, rows = few_windows
    got = {r.set: r for r in QUERIES["a17_numpy_bootstrap"](spark, path).collect()}
    assert sorted(got) == [1, 2]
    for s, r in got.items():
        mine = sorted((x for x in rows if x[0] % 97 == s), key=lambda x: x[3])
        rng, found = np.random.default_rng(1701), []
        for _ in range(40):
            for pick in rng.integers(len(mine), size=(500, len(mine))):
                found.append(sum(mine[i][4] - mine[i][3] for i in pick) / np.log(2) / sum(mine[i][2] for i in pick))
        assert np.allclose([r.low, r.high], np.quantile(found, [0.025, 0.975]), rtol=1e-12) and r.windows == len(mine)


@pytest.mark.parametrize("name, books", [("a17_window_bootstrap", False), ("a18_cluster_bootstrap", True)])
def test_bootstraps_take_20000_draws(spark, few_windows, name, books):
    from corpusloom.plans.registry import QUERIES

    path, rows = few_windows
    units = {}
    for b, w, size, x, y in rows:
        u = units.setdefault(b if books else b * 10 + w, [0.0, 0])
        u[0] += y - x
        u[1] += size
    v = np.array(list(units.values()))
    picks = np.random.default_rng(5).integers(len(v), size=(200_000, len(v)))
    found = v[picks].sum(1)
    want = np.quantile(found[:, 0] / found[:, 1], [0.025, 0.975])
    r = QUERIES[name](spark, path).first()
    assert r.draws == 20_000 and np.abs(np.array([r.low, r.high]) - want).max() < 0.03 * (want[1] - want[0])


def test_resampling_takes_as_many_rows_as_there_are(spark):
    """Counts of a draw sum to the rows; a row's count is that of drawing with replacement; the
    draws are the same however the rows lie."""
    sizes = np.array([5, 0, 1000, 3, 77, 77, 0, 4])
    tree = stats.ResampleTree(sizes, 4000, 3)
    counts = np.array([tree.counts(i) for i in (6, 0, 1, 2, 3, 4, 5, 6, 7, 0)])
    assert (counts[1:9].sum(0) == sizes.sum()).all() and (counts[0] == counts[7]).all() and (counts[1] == counts[9]).all()
    assert not counts[2].any() and np.allclose(counts[1:9].mean(1), sizes, rtol=0.1, atol=0.2)
    assert np.allclose(counts[5].var(), 77 * (1 - 77 / sizes.sum()), rtol=0.15)
    one = stats.leaf_sums(np.array([1, 1j, 100]), np.array([3, 20, 1]), np.full(5000, 24), np.random.default_rng(1))
    assert (one.imag + one.real % 100 + one.real // 100 == 24).all() and np.allclose([one.imag.mean(), (one.real // 100).mean()], [20, 1], rtol=0.1)
    rng = random.Random(2)
    rows = [(rng.random(), 1.0) for _ in range(9000)] + [(0.5, 1.0)] * 4000 + [(None, 1.0)] * 5
    d = spark.createDataFrame(rows, "a double, b double")
    some = stats.resampled_ratios(d.repartition(3), "a", "b", draws=300, leaf_rows=500).orderBy("draw").collect()
    again = stats.resampled_ratios(d.repartition(11, "a"), "a", "b", draws=300, leaf_rows=500).orderBy("draw").collect()
    assert len(some) == 300 and np.allclose([r.ratio for r in some], [r.ratio for r in again], rtol=1e-12)
    whole = stats.resampled_ratios(d.withColumn("c", F.lit(1.0)), "c", "b", draws=50, leaf_rows=500).collect()
    assert {r.ratio for r in whole} == {1.0}
    values = np.array([r[0] or 0 for r in rows])
    mean, sd = values.mean(), values.std() / np.sqrt(len(values))
    ratios = np.array([r.ratio for r in some])
    assert abs(ratios.mean() - mean) < 0.3 * sd and 0.85 * sd < ratios.std() < 1.15 * sd
    assert stats.resampled_ratios(d.limit(0), "a", "b").count() == 0


def test_kernels(spark):
    assert K.fnv(b"") == 14695981039346656037 and K.fnv(b"a") == 0xAF63DC4C8601EC8C
    v = K.holo_vector("The cat sat with the CAT")
    assert abs(float(np.linalg.norm(v)) - 1) < 1e-5 and np.allclose(v, K.holo_vector("cat sat cat"))
    assert not K.holo_vector("the and of").any()
    assert K.holo_words(b"x" * 50) == [b"x" * 47, b"xx"]
    d = spark.createDataFrame([(-5,), (0,), (2**62,)], "x long")
    got = [r[0] for r in d.select(K.mix64("x")).collect()]
    assert got == [K._signed(K.mix(x & K.MASK)) for x in (-5, 0, 2**62)]


THEOREM = "i(a(m(0,s(0)),i(m(0,s(0)),q(0,0))),q(0,0))"
PROOF = "ii(a(m(0,s(0)),i(m(0,s(0)),q(0,0))),ie(ar(h0),al(h0)))"


def test_logic():
    assert logic.verdict(THEOREM, PROOF) == (True, True)
    assert logic.verdict(THEOREM, "h0") == (True, False) and logic.verdict(THEOREM + ")", PROOF) == (False, False)
    assert logic.verdict("m(0,0)", "v(m(0,0))") == (True, False) and logic.verdict("b(0,s(0))", "v(b(0,s(0)))") == (True, True)
    assert logic.verdict("q(u(s(s(0))),s(0))", "v(q(u(s(s(0))),s(0)))") == (True, True)
    deep = "0"
    for _ in range(70):
        deep = f"s({deep})"
    assert logic.verdict(f"q({deep},{deep})", f"v(q({deep},{deep}))") == (True, False)  # too many sets
    kinds = [logic.example(str(i)) for i in range(300)]
    assert {k[0] for k in kinds} == {"prove", "check"} and all(logic.verdict(t, p)[1] == (r == "valid") for _, t, p, r in kinds)


def test_logic_records(spark):
    good = f"@logic hf1\n@task prove\n@theorem {THEOREM}\n@proof {PROOF}\n@result valid\n@end\n"
    d = spark.createDataFrame([(0, good * 2), (1, good.replace("@end\n", "") + good), (2, "x\n" + good), (3, good.replace("@task", "@what"))], "k int, t string")
    got = {}
    for r in text_files.logic_records(d, "k", "t").collect():
        got.setdefault(r.k, []).append(r.fault)
    assert got[0] == [None, None] and "not ended or nested" in got[1] and "stray line" in got[2] and got[3] == ["unknown line"]


def literal_merges(files, rounds):
    """Merges by the description, pair by pair: files are lists of texts, each closed by a line feed."""
    streams = [[c if ord(c) < 128 else "?" for t in texts for c in t + "\n"] for texts in files]
    names, learnt = {chr(i): i for i in range(128)}, []
    for _ in range(rounds):
        score, total = {}, {}
        for s in streams:
            count = {}
            for p in zip(s, s[1:]):
                count[p] = count.get(p, 0) + 1
            for p, n in count.items():
                score[p] = score.get(p, 0) + n / (len(s) - 1)
                total[p] = total.get(p, 0) + n
        ok = [p for p in score if total[p] >= 2 and "\n" not in p[0] + p[1]]
        if not ok:
            break
        best = min(ok, key=lambda p: (-round(score[p], 12), -total[p], names[p[0]], names[p[1]]))
        learnt.append((names[best[0]], names[best[1]]))
        new = Piece(best[0] + best[1], len(learnt))
        names[new] = 127 + len(learnt)
        for k, s in enumerate(streams):
            out = []
            for c in s:
                if out and (out[-1], c) == best:
                    out[-1] = new
                else:
                    out.append(c)
            streams[k] = out
    return learnt


class Piece(str):
    """A merged piece: its text may equal another's, its number does not."""

    def __new__(cls, text, number):
        p = super().__new__(cls, text)
        p.number = number
        return p

    def __hash__(self):
        return hash((str(self), self.number))

    def __eq__(self, other):
        return isinstance(other, Piece) and self.number == other.number


def test_bpe_learns_by_description(spark):
    rng = random.Random(5)
    files = {"a": ["low lower lowest\nlow", "aaaa aaa a é", ""], "b": ["newest widest low", "e e e e e e e e ab"]}
    files["c"] = ["".join(rng.choice("ab \n") for _ in range(300)) for _ in range(3)]
    d = spark.createDataFrame([(f, t) for f, texts in files.items() for t in texts], "f string, t string").repartition(3)
    merges = bpe.learn_merges(d, "f", "t", 20)
    assert merges == literal_merges([files[f] for f in sorted(files)], 20) and len(merges) == 20
    out = d.select("t", bpe.encode(F.col("t"), merges).alias("ids")).select("t", "ids", bpe.decode(F.col("ids"), merges).alias("b")).collect()
    assert all(r.b == "".join(c if ord(c) < 128 else "?" for c in r.t) for r in out)
    spaced = spark.createDataFrame([("x", "e e e e e e e e ab")], "f string, t string")
    assert bpe.learn_merges(spaced, "f", "t", 1) == [(ord("e"), ord(" "))]


def test_bpe_greedy_from_the_left():
    run = lambda ids, a, b: bpe.merged(np.array(ids), a, b, 99)[0].tolist()
    assert run([1, 1, 1, 1, 1], 1, 1) == [99, 99, 1] and run([1, 1, 2, 1, 1, 1], 1, 1) == [99, 2, 99, 1]
    assert run([1, 2, 1, 2, 2], 1, 2) == [99, 99, 2] and run([], 1, 2) == [] and run([3], 3, 3) == [3]


def test_vocabulary_files(spark, tmp_path):
    merges = [(108, 111), (128, 119)]
    raw = binary.vocabulary_bytes(merges)
    assert binary.read_vocabulary(raw) == merges
    with pytest.raises(ValueError):
        binary.read_vocabulary(raw[:-1])
    binary.save_vocabulary(spark, merges, f"{tmp_path}/v")
    assert binary.load_vocabulary(spark, f"{tmp_path}/v") == merges


def test_byte_alphabet(spark):
    letters = bpe.byte_alphabet()
    assert len(set(letters)) == 256 and letters[ord("A")] == "A" and letters[32] == "Ġ" and letters[10] == "Ċ" and letters[173] == chr(256 + 67)
    raws = [bytes(range(256)), b"", "né 中\n".encode()]
    shown = col(spark, bpe.to_alphabet(F.unhex("x")), [r.hex() for r in raws])
    assert shown == ["".join(letters[b] for b in r) for r in raws]
    assert [None if r is None else bytes(r) for r in col(spark, bpe.from_alphabet(F.col("x")), [*shown, "a b", "中"])] == [*raws, None, None]


def test_packs():
    ids, meta = binary.unpack_bytes(binary.pack_bytes([1, 2, 300], 2, name="é"))
    assert ids == [1, 2, 300] and meta["name"] == "é"
    with pytest.raises(ValueError):
        binary.unpack_bytes(b"nothing")


def test_packs_hold_whole_texts(spark, tmp_path):
    from corpusloom.plans.registry import QUERIES

    texts = ["a" * 513, "é" * 700, "short", "", None, "word " * 30_000]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.tokens, r.digest) for r in QUERIES["sc11_packed_tokens"](spark, str(tmp_path)).collect()}
    assert got == {i: (len((t or "").encode()), hashlib.md5((t or "").encode()).hexdigest()) for i, t in rows}

    packs = [(binary.pack_bytes(list((t or "").encode()), document=i),) for i, t in rows]
    binary.write_packs(spark.createDataFrame(packs, "pack binary").coalesce(1), f"{tmp_path}/packs", 2)  # several files, several containers in one
    assert 1 < len(list((tmp_path / "packs").glob("part-*"))) < len(rows)
    back = {r.metadata: bytes(r.tokens) for r in binary.read_packs(spark, f"{tmp_path}/packs").collect()}
    assert len(back) == len(rows) and sorted(back.values()) == sorted((t or "").encode() for t in texts)
    with pytest.raises(ValueError):
        binary.unpack_bytes(packs[0][0][:-1])
    with pytest.raises(OverflowError):
        binary.pack_bytes([70_000])


def test_rectangle_holds_whole_texts(spark, tmp_path):
    from corpusloom.plans.registry import QUERIES

    texts = ["abcdefghij é", "abc", "", None, "中文 😀"]
    spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: r.row for r in QUERIES["x02_padded_rectangle"](spark, str(tmp_path)).collect()}
    assert got == {i: [*map(ord, t or "")] + [0] * (12 - len(t or "")) for i, t in enumerate(texts)}


def test_token_files_hold_every_language(spark, tmp_path):
    import duckdb

    from corpusloom.plans.registry import ORACLE, QUERIES

    rows = [(0, "abc", "de"), (1, "dé f", None), (2, "ghi" * 20_000, "it"), (3, "x", "a/b=%é"), (4, "", "empty"), (5, None, "none"), (6, "jk", ""), (7, "lm", "null"), (8, "n", None), (9, None, "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(ORACLE["sc04_token_files"]).fetchall()
    got = QUERIES["sc04_token_files"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) == 8 and {tuple(r) for r in got} == set(want)


def test_hybrid_searches_all_rows(spark, tmp_path):
    from corpusloom.operators import retrieval
    from corpusloom.plans.registry import QUERIES

    rng = np.random.default_rng(19)
    v = rng.normal(size=(130, 8))
    v[120] = v[100]  # equal vectors
    rows = [(i, v[i].tolist(), int(i % 5)) for i in range(len(v))]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    words = lambda i: [str(i % 5), str(i % 3)]
    want = set()
    for q in range(0, 130, 20):
        score = {i: v[q] @ v[i] / np.linalg.norm(v[q]) / np.linalg.norm(v[i]) + 0.2 * len(set(words(q)) & set(words(i))) / 2 for i in range(130)}
        want |= {(q, r + 1, i, round(score[i], 9)) for r, i in enumerate(sorted(score, key=lambda i: (-round(score[i], 12), i))[:3])}
    got = QUERIES["j19_hybrid_retrieval"](spark, str(tmp_path)).collect()
    near = lambda x: {t[:3] for t in x}
    assert near(map(tuple, got)) == near(want) and max(t[2] for t in want) >= 50
    assert all(abs(r.score - s) < 2e-9 for r in got for q, k, _, s in want if (q, k) == (r.query, r["rank"]))
    e = spark.read.parquet(f"{tmp_path}/embeddings.parquet").withColumn("w", F.array(F.col("label").cast("string"), (F.col("vec_id") % 3).cast("string")))
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"), F.col("w").alias("qw"))
    m = e.select(F.col("vec_id").alias("slot"), F.col("embedding").alias("v"), F.col("w").alias("vw"))
    small = retrieval.hybrid_blocks(q, m, rows=7)  # many blocks
    assert {(r.query, r["rank"], r.slot) for r in small.collect()} == near(want)


def test_chat_rows(spark):
    t = "# head\nc1\tm1\t\tAnn\tHi\tcalm\nc1\tm2\tm1\tBob\tYo\nc2\tx\t\tAnn\té?\nc1\tm3\t\tAnn\tBack\t\tsum\there"
    r = text_files.chat_rows(spark.createDataFrame([(0, t)], "k int, t string"), "k", "t").orderBy("pos").collect()
    assert [x.channel.split("#")[1] for x in r] == ["0", "0", "1", "2"] and r[2].text == "??"[:1] + "?" and r[3].summary == "sum\there" and r[0].vibe == "calm"
    with pytest.raises(Exception, match="5 to 7"):
        text_files.chat_rows(spark.createDataFrame([(0, "a\tb")], "k int, t string"), "k", "t").collect()


def test_channel_records(spark):
    rows = [("c", i, f"m{i}", "m0" if i == 4 else "", "AB"[i % 2], f"text {i}", "", "") for i in range(5)]
    d = spark.createDataFrame(rows, "channel string, pos int, id string, reply string, speaker string, text string, summary string, vibe string")
    r = dialogue.channel_records(d, "S").collect()
    assert len([x for x in r if x.kind == "turn"]) == 8 and len([x for x in r if x.kind == "memory"]) == 4
    last = dialogue.preview(next(x.tokens for x in r if x.pos == 4 and x.kind == "turn" and x.style == "S"))
    assert "text 0" in last and "text 1" not in last and "=> text 4" in last


def test_paragraph_records():
    records = lambda t: chunking.paragraph_records(t, 10)
    assert records("") == records("\n\n \n\n") == []
    assert records("one\n\ntwo") == ["one\n\ntwo"]
    assert records("12345\n\n67890") == ["12345\n\n67890"]  # ten characters and the separator
    assert records("12345\n\n678901") == ["12345", "678901"]
    assert records("\n\na\n\n\n\n\nb\n\n") == ["a\n\nb"]
    assert records("x" * 20) == ["x" * 20]  # twice the size is not over it
    assert records("x" * 21) == ["x" * 10, "x" * 11]
    assert records("abc\ndef\n" + "y" * 30) == ["abc\ndef", "y" * 10, "y" * 20]
    assert records("x" * 27 + "\n\nend") == ["x" * 10, "x" * 17, "end"]
    assert records("x" * 35 + "\n\nend") == ["x" * 10, "x" * 10, "x" * 15, "end"]
    rng = random.Random(8)
    for _ in range(200):
        t = "".join(rng.choice(["a", "bc", " ", "\n", "\n\n", "word " * 6]) for _ in range(rng.randint(0, 60)))
        out = chunking.paragraph_records(t, 20)
        assert "".join("".join(out).split()) == "".join(t.split()) and all(len(r) <= 40 for r in out)


def test_pack_paragraphs(spark):
    d = spark.createDataFrame([(1, "one\n\n" + "z" * 900), (2, None), (3, "tiny")], "k int, t string")
    got = {(r.k, r.chunk): r.body for r in chunking.pack_paragraphs(d, "k", "t", "x", 420, least=4).collect()}
    assert got == {(1, 1): f"<x>\n{'z' * 420}\n", (1, 2): f"<x>\n{'z' * 480}\n", (3, 0): "<x>\ntiny\n"}


def test_split_helpers(spark):
    import hashlib

    names = [f"n{i}|x" for i in range(50)]
    got = col(spark, splits.author_split(F.col("x"), "s"), names)

    def want(n):
        b = int(hashlib.sha256(b"s\0" + n.split("|")[0].encode()).hexdigest()[:8], 16) % 20
        return "test" if b == 0 else "validation" if b == 1 else "train"

    assert got == [want(n) for n in names]
    with pytest.raises(Exception, match="positive"):
        splits.require(spark.createDataFrame([(0,)], "x int"), ["x"], {"positive": F.col("x") > 0}).collect()


def test_short_passages_are_found(spark, tmp_path):
    from corpusloom.plans.registry import QUERIES

    rng = random.Random(9)
    long = " ".join(rng.choice("abcdefgh") for _ in range(20))
    passages = ["one two  three", "alone", long, "", None, " ", "q " * 15, "one two three"]
    texts = ["x one\ntwo three y", f"k {long} k", "not one two, three", "alone at last one two three", "", None, "q " * 40, "alonely"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    wanted = set()
    for p in passages:
        if w := (p or "").split():
            wanted |= {tuple(w)} if len(w) < 16 else grams(w, 16)
    want = {i: n for i, t in enumerate(texts) if (n := sum(g in grams((t or "").split(), len(g)) for g in wanted))}
    got = {r.doc_id: r.hits for r in QUERIES["j09_benchmark_passages"](spark, str(tmp_path)).collect()}
    assert got == want and set(got) == {0, 1, 3, 6}
    docs, bench = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "benchmark"))
    joined = splits.passage_hits(docs, "doc_id", F.col("text"), bench, F.col("text"), 16, limit=2)  # too many grams to send round
    assert {r.doc_id: r.hits for r in joined.collect()} == want


def test_stream_restart_keeps_state(spark, tmp_path):
    from corpusloom.streaming.state import run_once, vote_store

    schema = "packet_id string, reviewer_id string, event_id string, case_id long, choice string, arrival long"
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")

    def add(rows):
        spark.createDataFrame([("p", "r", *r) for r in rows], schema).write.mode("append").parquet(src)
        return sorted((r.event_id, r.arrival, r.status) for r in run_once(vote_store(spark.readStream.schema(schema).parquet(src)), "v", out, checkpoint=cp).collect())

    assert add([("e1", 1, "A", 1), ("e1", 1, "A", 2)]) == [("e1", 1, "stored")]
    assert add([("e1", 1, "B", 3), ("e2", 1, "A", 4)]) == [("e1", 1, "stored"), ("e1", 3, "conflict"), ("e2", 4, "stored")]


def test_encoded_row():
    from corpusloom.operators import encoding as E

    row = {
        "lines": ["# goal: x"],
        "history": [{"speaker": "other", "text": "old " * 40}, {"speaker": "self", "text": "hi"}, {"speaker": "other", "text": "Ann saw Annabel"}],
        "confidence": 30,
        "retold": True,
        "fields": [{"field": 2, "role": 1, "knowledge": 0, "provenance": 4, "spoken": True, "text": "Ann"}, {"field": 0, "role": 0, "knowledge": 1, "provenance": 1, "spoken": None, "text": "hid"}, {"field": 5, "role": 2, "knowledge": 3, "provenance": 1, "spoken": None, "text": "far"}],
        "output": "So Ann left.",
        "copies": [{"field": 2, "start": 3, "end": 6}],
        "typed": {"kind": 7, "move": 2},
    }
    got = E.encode_row(row)
    b = E.byte_ids
    history = b("other: " + "old " * 40 + "\n") + b("self: hi\n") + b("other: ") + [3] + b(" saw Annabel\n")
    prefix = b("# goal: x\n") + history + b("- ? ~ ") + [3, 6] + b("\n")
    said = b("So ") + [3] + b(" left.")
    assert got["tokens"] == prefix + said and got["prefix_length"] == len(prefix)
    assert got["labels"] == [-100] * (len(prefix) - 1) + said + [0] and len(got["labels"]) == len(got["tokens"])
    at = len(prefix) - 3
    assert got["candidates"] == [[at, at]] and got["source_ids"] == [b("Ann")]
    place = len(prefix) + 3 - 1
    assert got["copy_targets"] == [0 if i == place else -1 for i in range(len(got["tokens"]))] and got["weights"][place] == 3.0
    assert got["meta"][at] == [1, 0, 4, 1, 7] + [0] * 11 + [2] and got["meta"][0] == [0] * 4 + [7] + [0] * 11 + [2] and got["meta"][len(prefix)] == [0] * 17
    long = dict(row, history=[{"speaker": "self", "text": "a" * 120}, {"speaker": "other", "text": "b" * 120}, {"speaker": "self", "text": "c" * 120}])
    assert b("a" * 120)[0] not in E.encode_row(long)["tokens"][10:200]  # the earliest message is over the budget
    for bad in (dict(row, history=[{"speaker": "x", "text": ""}]), dict(row, history=[{"speaker": "self", "text": "y" * 300}]), dict(row, copies=[{"field": 5, "start": 0, "end": 2}]), dict(row, output="z" * 600, copies=[])):
        with pytest.raises(ValueError):
            E.encode_row(bad)


def test_encoded_column_keeps_faults(spark):
    from corpusloom.operators import encoding as E

    d = spark.createDataFrame([(1, [], [], "ok"), (2, [], [], "z" * 90)], "i int, fields array<struct<field:int,role:int,knowledge:int,provenance:int,spoken:boolean,text:string>>, copies array<struct<field:int,start:int,end:int>>, output string")
    got = {r.i: r.e for r in d.select("i", E.encoded(F.struct("fields", "copies", "output"), 40).alias("e")).collect()}
    assert got[1].fault is None and got[1].tokens == E.byte_ids("- \nok") and got[2].tokens is None and "context" in got[2].fault


def test_audit_slices_finds_faults(spark):
    from corpusloom.operators import records as RC

    good = "- a\n- bb\nout\n\n"
    content = good + "- c\nother\n\n"
    rows = [("f", 1, 0, 9, 14, "out"), ("f", 2, 14, 18, 11, "wrong")]
    files = spark.createDataFrame([("f", bytearray(content.encode()))], "file string, content binary")
    d = spark.createDataFrame(rows, "file string, id int, text_start int, output_start int, text_bytes int, output string")
    got = {r.id: r for r in RC.audit_slices(files, d, 8).collect()}
    assert got[1].prefix == "- bb\n" and got[1].dropped == 1 and got[1].fits and got[1].contiguous and got[1].target_ok and got[1].events_ok
    assert not got[2].target_ok and got[2].contiguous
    gap = {r.id: r.contiguous for r in RC.audit_slices(files, d.withColumn("text_start", F.expr("text_start + if(id = 2, 1, 0)")), 8).collect()}
    assert gap == {1: True, 2: False}
    tight = {r.id: (r.dropped, r.fits) for r in RC.audit_slices(files, d, 1).collect()}
    assert tight[1] == (1, False) and tight[2] == (0, False)  # the last event always stays


def test_signatures_can_fail(spark, tmp_path):
    from corpusloom.plans.registry import QUERIES

    rng = np.random.default_rng(1)
    spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(9)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in QUERIES["k04_signatures"](spark, str(tmp_path)).collect()}
    assert {i for i, r in got.items() if not r.valid} == {0, 3, 6}
    h = 14695981039346656037
    for byte in np.asarray(spark.read.parquet(f"{tmp_path}/embeddings.parquet").filter("vec_id = 1").first().embedding, np.float32).tobytes():
        h = (h ^ byte) * 1099511628211 % 2**64
    assert got[1].signature % 2**64 == h


def test_near_chunks_against_all_pairs(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(30):
        base = [rng.choice(words) for _ in range(40)]
        for j in range(3):
            texts[3 * i + j] = " ".join(w for k, w in enumerate(base) if k % 40 >= j)
    d = spark.createDataFrame([*texts.items(), (900, None), (901, "")], "k long, t string")
    prints = {r.k: r.f for r in d.select("k", chunking.simhash64(F.col("t")).alias("f")).collect()}
    first = {}
    for k in sorted(prints):
        first.setdefault(prints[k], k)
    keys = sorted(first.values())
    want = {(a, b, bits) for i, b in enumerate(keys) for a in keys[:i] if (bits := ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count()) <= 3}
    assert {tuple(r) for r in chunking.near_chunks(d, "k", "t", 3).collect()} == want and want


def test_repeated_words_and_names(spark):
    from corpusloom.operators import rows as RO

    texts = ["go go go now", "Go GO go", "go go", "the the there the", None, ""]
    assert [bool(x) for x in col(spark, X.is_degenerate(F.col("x")), texts)][:4] == [True, True, False, False]
    names = F.array(F.lit("Ann Lee"), F.lit("Bo Ray"), F.lit("Bo Day"))
    assert col(spark, RO.full_names(F.col("x"), names), ["Ann met Bo.", "Annabel and Ann", "Ann Lee came"])[:2] == ["Ann Lee met Bo.", "Annabel and Ann Lee"]


@pytest.mark.parametrize("block", [5, 1024])
def test_similar_strings_against_difflib(spark, block):
    import difflib

    from corpusloom.operators import retrieval

    rng = random.Random(4)
    rows = [(g, 100 * (g or 0) + i, "".join(rng.choice("abcd ") for _ in range(rng.choice([3, 12, 12, 40])))) for g in (1, 2, None) for i in range(25)]
    rows += [(1, 190, "same same"), (1, 191, "same same"), (1, 192, "same same"), (1, 193, ""), (3, 300, "alone"), (1, 194, None)]
    got = {(r.k, r["rank"]): (r.other, r.ratio) for r in retrieval.nearest_strings(spark.createDataFrame(rows, "g int, k long, t string").repartition(3), "g", "k", "t", 3, block).collect()}
    n = 0
    for g, k, t in rows:
        if t is not None:
            best = sorted((-difflib.SequenceMatcher(None, u, t).ratio(), j) for h, j, u in rows if h == g and j != k and u is not None)[:3]
            assert [got[k, i + 1] for i in range(len(best))] == [(j, -r) for r, j in best]
            n += len(best)
    assert len(got) == n


def test_few_ratios_are_computed(spark):
    from corpusloom.operators import retrieval

    p = spark.read.parquet("/root/testdata/sf0.01/part.parquet").select("p_partkey", "p_name").collect()
    held = [("x", r.p_partkey, r.p_name) for r in p]
    assert retrieval.similar_in([(*r, -1.0) for r in held[:100]], held, 3)[1] < 0.05 * 100 * len(held)
    rng = random.Random(6)
    words = [" ".join(rng.choice(["amber", "birch", "coral", "delta", "ember", "fjord", "grove", "heath"]) for _ in range(rng.choice([2, 3, 6]))) for _ in range(600)]
    held = [("x", i, w) for i, w in enumerate(words)]
    found, _ = retrieval.similar_in([(*r, -1.0) for r in held[:50]], held[:300], 3)
    floors = {}
    for key, _, ratio in found:
        floors[key] = min(ratio, floors.get(key, 1.0))
    far = [retrieval.similar_in([(*r, f(r[1])) for r in held[:50]], held[300:], 3)[1] for f in (lambda k: -1.0, floors.get)]
    assert far[1] < far[0] < 50 * 300  # what a block has found spares ratios in the next one


@pytest.mark.parametrize("last", [0, 3, 10**6])
def test_kept_chunks_against_the_sequential_rule(spark, monkeypatch, last):
    rng = random.Random(12)
    prints = [rng.getrandbits(64) for _ in range(12)]
    for _ in range(150):  # clusters and chains
        fp = rng.choice(prints)
        for b in rng.sample(range(64), rng.randrange(4)):
            fp ^= 1 << b
        prints.append(fp)
    rng.shuffle(prints)
    rows = [(3 * i, str(fp - 2**64 if fp >> 63 else fp)) for i, fp in enumerate(prints)]
    monkeypatch.setattr(chunking, "simhash64", lambda c: c.cast("long"))
    got = {r.k: (r.kept, r.first) for r in chunking.kept_chunks(spark.createDataFrame(rows, "k long, t string").repartition(3), "k", "t", 3, last).collect()}
    kept, want = [], {}
    for k, t in rows:
        stays = all(((int(t) ^ fp) & (2**64 - 1)).bit_count() > 3 for fp in kept)
        want[k] = (stays, min(j for j, u in rows if u == t))
        if stays:
            kept.append(int(t))
    assert got == want and 12 <= sum(v[0] for v in want.values()) < len(rows) - 40


def test_kept_chunks_along_a_chain_and_odd_rows(spark):
    from corpusloom.operators.chunking import kept_chunks

    fp, chain = 0, []
    for i in range(1000):  # each one within three bits of the one before, six and more of those before it
        for b in range(3):
            fp ^= 1 << ((3 * i + b) * 7 % 64)
        chain.append((i, fp))
    decided = list(chunking._in_order(chunking.block_masks(3), 3)([pa.RecordBatch.from_arrays([pa.array([f - 2**64 if f >> 63 else f for _, f in chain]), pa.array([i for i, _ in chain])], ["fp", "k"])]))[0].to_pylist()
    kept = []
    for i, f in chain:
        stays = all((f ^ g).bit_count() > 3 for g in kept)
        assert decided[i]["stays"] == stays
        if stays:
            kept.append(f)
    rows = [(5, "one two"), (5, "one two"), (None, "one two"), (2, None), (7, ""), (9, "quite other words here")]
    got = sorted(map(tuple, kept_chunks(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()), key=repr)
    assert got == sorted([(5, False, None), (5, False, None), (None, True, None), (2, True, 2), (7, False, 2), (9, True, 9)], key=repr)
    assert kept_chunks(spark.createDataFrame([], "k long, t string"), "k", "t").count() == 0


def test_xorshift_and_mix(spark):
    m = 2**64 - 1

    def shift(x):
        x ^= x << 13 & m
        x ^= x >> 7
        return x ^ (x << 17 & m)

    ids = [1, 2, 3, 12345678901234567]
    d = spark.createDataFrame([(i,) for i in ids], "i long")
    assert [r[0] & m for r in d.select(K.xorshift64("i")).collect()] == [shift(i) for i in ids]
    assert [r[0] & m for r in d.select(K.mix64("i")).collect()] == [K.mix(i) for i in ids]


def test_record_preview():
    from corpusloom.operators import dialogue as D

    shown = D.preview([D.CHANNEL, ord("U"), D.SUMMARY, ord("h"), 200, D.END_MESSAGE, D.TARGET, ord("k"), D.END_RECORD])
    assert shown == "\n<CHANNEL:U\n<SUMMARY>h.]\n] => k<END>\n"


def by_stream(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[:2]):
        out.setdefault(r[0], []).append(r[1:])
    return out


def test_memory_streams_against_a_ring(spark, tmp_path):
    from corpusloom.plans.registry import QUERIES

    rng = np.random.default_rng(3)
    rows = [(i, (v / np.linalg.norm(v)).astype(np.float32).tolist(), i % 2) for i, v in enumerate(rng.normal(size=(90, 6)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    memory = {(r.stream, r.arrival): r for r in QUERIES["st03_episodic_memory"](spark, str(tmp_path)).collect()}
    packets = {(r.stream, r.arrival): r for r in QUERIES["st04_vector_exchange"](spark, str(tmp_path)).collect()}
    assert len(memory) == len(packets) == 90
    for stream, seen in by_stream([(label, i, np.array(v, np.float32)) for i, v, label in rows]).items():
        ring, lodged = [], []
        for n, (i, v) in enumerate(seen):
            scores = [float(u @ v) for u in ring[-32:]]
            r = memory[stream, i]
            assert r.slot == n % 32 and (r.recalled == -1) == (not ring)
            if ring:
                assert abs(r.score - max(scores)) < 2e-5
            ring.append(v)
            p = packets[stream, i]
            bad = i % 10 == 3
            assert p.accepted != bad and p.slot == (-1 if bad else len(lodged) % 32)
            assert abs(p.score - (0 if bad else max([0.0, *(float(u @ v) for u in lodged[-32:])]))) < 2e-5
            if not bad:
                lodged.append(v)


def test_rolling_summaries(spark, tmp_path):
    from corpusloom.plans.registry import QUERIES

    turns = [(1, 0, "first words said here"), (1, 1, "second   answer"), (1, 2, None), (1, 3, "fourth"), (1, 4, "left over"), (2, 0, "x")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.stream, r.arrival): r.summary for r in QUERIES["st05_rolling_memory"](spark, str(tmp_path)).collect()}
    one = "chat | first words ; second answe"
    assert got == {(1, 1): one, (1, 3): f"chat | ~{one.partition(' | ')[2][:14]}; {' '[:12]}; fourth"}


@pytest.mark.parametrize("limit", [0, 500_000])
def test_passage_hits_by_key_at_every_size(spark, limit):
    rows = [(1, "a one two b"), (1, "a one two b"), (1, "two three"), (2, "solo"), (None, "one two"), (None, "solo one two"), (3, "none"), (4, None)]
    docs = spark.createDataFrame(rows, "key long, g string")
    bench = spark.createDataFrame([("one two",), ("solo",), ("two three",), ("one two",)], "text string")
    got = {r["key"]: r.hits for r in splits.passage_hits(docs, "key", F.col("g"), bench, F.col("text"), 16, limit=limit).collect()}
    assert got == {1: 2, 2: 1, None: 2}


@pytest.mark.parametrize("limit", [0, 500_000])
def test_names_by_one_rule_at_every_size(spark, limit):
    texts = ["x(Ann)y", "see (Bo) and (Bo)", "C++ and C#", "a.b*c", "back\\Eslash \\E\\Q", "tab\tname", "Élan vital", "dup Ann_", "-Cy", "Q[uote", None, ""]
    names = {"(Ann)": False, "Ann": True, "(Bo)": True, "C++": True, "C#": True, "C": True, "a.b": True, "axb": False, "b*c": True, "back\\Eslash": True, "\\E\\Q": True, "E\\Q": True, "Élan vital": True, "lan vital": False, "Ann_": True, "-Cy": True, "Q[uote": True, "!!": False, "": False, "tab\tname": True}
    t = spark.createDataFrame([(x,) for x in texts * 2], "t string")
    n = spark.createDataFrame([(x,) for x in [*names, *names, None]], "name string")
    assert {r.name for r in splits.names_in(t, F.col("t"), n, limit=limit).collect()} == {k for k, v in names.items() if v}


def test_unseen_pairs(spark):
    texts = spark.createDataFrame([(1, "Ann Lee met Bo."), (2, None), (3, "Annabel; O'Neil, and Élan")], "i int, t string")
    rows = [(1, ["Ann Lee"]), (2, ["Ann Le"]), (3, ["Zed", "Bo"]), (4, ["O'Neil"]), (5, ["Neil and"]), (6, []), (7, ["Anna"]), (8, ["Élan "]), (9, ["Elan"]), (10, ["lan"])]
    pairs = spark.createDataFrame(rows, "k int, names array<string>")
    for limit in (100, 0):
        got = sorted(r.k for r in splits.unseen_pairs(pairs, "names", texts, F.col("t"), limit=limit).collect())
        assert got == [2, 5, 6, 7, 9, 10], limit


@pytest.mark.parametrize("counts", [2, 20_000])
def test_numbered_cuts_groups(spark, monkeypatch, counts):
    monkeypatch.setattr(sequence, "RANGE_COUNTS", counts)
    rng = random.Random(5)
    rows = [("hot", i % 40, rng.randint(0, 9)) for i in range(300)] + [(None, None, 3), (None, 5, None), (None, 5, 1), ("b", 1, 2)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "g string, o int, __part int").repartition(5)
    got = sequence.numbered(d, ["g"], ["o"], "place", "rows", "__part").collect()
    assert sequence.numbered(d, ["g"], ["o"]).columns == ["g", "o", "__part", "n"]
    for g in ("hot", None, "b"):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.place)
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0))
        assert [r.o for r in mine] == [r[1] for r in want] and [r.place for r in mine] == list(range(1, len(want) + 1))
        assert {r.rows for r in mine} == {len(want)} and [r.start for r in mine] == [sum(x["__part"] or 0 for x in mine[:i]) for i in range(len(mine))]
    whole = sequence.numbered(d, [], ["o", "g"], "place").collect()
    assert sorted(r.place for r in whole) == list(range(1, len(rows) + 1)) and sequence.numbered(d.limit(0), ["g"], ["o"]).count() == 0
    if counts == 2:  # joined by shuffle
        return
    plan = sequence.numbered(d, ["g"], ["o"])._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Window" in x or "Exchange" in x]
    assert not any(" o#" in x or "[o#" in x for x in moved)  # only counts by range and group are gathered


def test_even_selection_and_runs(spark):
    for n, count in ((1, 3), (7, 7), (10, 4), (90, 13), (5, 12)):
        d = spark.createDataFrame([("a", i) for i in range(n)] + [("b", 0)], "g string, i2 int")
        got = sorted((r.i, r.i2) for r in sequence.even_selection(d, ["g"], ["i2"], count).filter("g = 'a'").collect())
        assert got == [(i, i * n // count) for i in range(count)]
    values = [None, "x", "x", "y", "x", None, None, "y"]
    d = spark.createDataFrame([(1, i, i + 1, v) for i, v in enumerate(values)] + [(2, 3, 4, "x")], "g int, s int, e int, v string")
    got = sorted(((r.g, r.start, r.end, r.v) for r in sequence.merge_adjacent(d, ["g"], "s", "e", "v").collect()), key=str)
    assert got == sorted([(1, 0, 1, None), (1, 1, 3, "x"), (1, 3, 4, "y"), (1, 4, 5, "x"), (1, 5, 7, None), (1, 7, 8, "y"), (2, 3, 4, "x")], key=str)


class _FakeState(dict):
    """A map or value state that counts its writes."""

    def __init__(self):
        self.writes = 0

    def updateValue(self, key, value):
        self.writes += 1
        self[key] = value

    def iterator(self):
        return iter(list(self.items()))

    def update(self, value):
        self.updateValue(0, value)

    def exists(self):
        return 0 in self

    def get(self):
        return self[0]


def test_a_vector_writes_one_slot():
    import pandas as pd

    from corpusloom.streaming import state

    class Handle:
        def getMapState(self, *_):
            return _FakeState()

        getValueState = getMapState

    p, rng = state._Memory(False), np.random.default_rng(3)
    p.init(Handle())
    for i in range(100):  # the ring is full after 32
        before = p.slots.writes
        frame = pd.DataFrame({"arrival": [i], "vector": [rng.normal(size=4).astype(np.float32)]})
        out = next(p.handleInputRows((1,), iter([frame]), None))
        assert p.slots.writes == before + 1 and out["slot"].tolist() == [i % 32]
    assert len(p.slots) == 32
    r = state._Rolling()
    r.init(Handle())
    for i in range(9):
        list(r.handleInputRows((1,), iter([pd.DataFrame({"arrival": [i], "text": ["word " * 5000]})]), None))
        assert sum(map(len, r.state.get())) <= 92


def test_memory_restarts_from_its_checkpoint(spark, tmp_path):
    from corpusloom.streaming.state import episodic_memory, rolling_memory, run_once

    rng = np.random.default_rng(8)
    schema = "stream long, arrival long, vector array<float>, text string"
    rows = [(s, a, rng.normal(size=5).astype(np.float32).tolist(), f"message {s} {a} goes on") for s in (1, 2) for a in range(60)]
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    spark.createDataFrame(rows, schema).repartition(1).write.parquet(whole)
    for name, f in (("memory", lambda d: episodic_memory(d.select("stream", "arrival", "vector"))), ("rolling", lambda d: rolling_memory(d.select("stream", "arrival", "text")))):
        want = run_once(f(spark.readStream.schema(schema).parquet(whole)), name, f"{tmp_path}/{name}-1").collect()
        for lo, hi in ((0, 7), (7, 40), (40, 60)):  # the query stops and starts again between the parts
            spark.createDataFrame([r for r in rows if lo <= r[1] < hi], schema).repartition(1).write.mode("append").parquet(f"{parts}-{name}")
            got = run_once(f(spark.readStream.schema(schema).parquet(f"{parts}-{name}")), name, f"{tmp_path}/{name}-2", checkpoint=f"{tmp_path}/{name}-cp").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) in (120, 60)


def test_rule_pairs_differ_in_one_field(spark):
    from corpusloom.operators.pairs import Rule, rule_pairs
    from corpusloom.plans.record_queries import _POOLS, _RULES

    d = spark.createDataFrame([(i,) for i in range(2000)] + [(7,), (None,)], "k long")
    got = {}
    for r in rule_pairs(d, "k", _RULES, _POOLS).collect():
        got.setdefault(r.pair, {})[r.member] = r
    assert sorted(got) == list(range(2000))
    unknown = changed = 0
    for k, m in got.items():
        a, b, rule = m[0], m[1], _RULES[k % len(_RULES)]
        assert a.rule == b.rule == rule.name and a.distracted == (k % 3 != 0) and a.prefix.count("\n") == 1 + a.distracted
        same = [c for c in a.__fields__ if c not in ("member", "prefix", "output")]
        assert all(a[c] == b[c] for c in same)
        if a.changed is None:
            assert not rule.named() and a.prefix == b.prefix and a.output == b.output
        else:
            changed += 1
            assert a.changed in rule.named() and a.changed != a.unknown and a.prefix != b.prefix
            assert a.prefix.split("\n")[:-2] == b.prefix.split("\n")[:-2]  # the earlier account is the same
        assert len(a.prefix.split("\n")[-2].encode()) <= 143 + 6
        if a.unknown is not None:
            unknown += 1
            assert rule.partial and "someone" in a.prefix and "someone" in (a.output + b.output).lower()
        if rule.less_than:
            n = [int(x) for x in a.prefix.split("\n")[-2].replace(".", " ").split() if x.isdigit()]
            assert n[-2] < n[-1]
    assert changed > 1400 and 80 < unknown < 220
    with pytest.raises(Exception, match="too little space"):
        rule_pairs(d, "k", [Rule("long", ("actor",), "x" * 140 + "{0}", ("{0}", "{0}"))], _POOLS).collect()


def test_a_changed_file_on_one_executor_is_named(spark, tmp_path):
    import shutil

    from corpusloom.operators import identity

    here = identity.package_root("corpusloom")
    lock = identity.code_digests(here)
    assert identity.attest(spark, "corpusloom", lock).collect() == []
    other = tmp_path / "copy"
    shutil.copytree(here, other, ignore=shutil.ignore_patterns("__pycache__"))
    (other / "session.py").write_text("# not the same\n")
    (other / "registry2.py").write_text("")
    (other / "operators" / "votes.py").unlink()
    moved = str(other)
    got = identity.attest(spark, "corpusloom", lock, 3, lambda i: moved if i == 1 else here).collect()
    assert {(r.task, r.path, r.fault) for r in got} == {(1, "session.py", "changed"), (1, "registry2.py", "extra"), (1, "operators/votes.py", "missing")}
    assert all(r.host for r in got)


def test_verified_load(spark):
    from corpusloom.operators import identity

    schema = "g string, t string"
    d = spark.createDataFrame([("a", "x"), ("a", None), ("a", "x"), ("b", "y"), (None, "z"), ("new", "n")], schema)
    lock = identity.group_digests(spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), ("b", "Y"), (None, "z"), ("gone", "q")], schema), "g", F.col("t"))
    got = {r.g: (r.rows, r.verified) for r in identity.verified_load(d, "g", lock, F.col("t")).collect()}
    assert got == {"a": (3, True), "b": (1, False), None: (1, True), "new": (1, False), "gone": (None, False)}


def test_acts_of_odd_rows(spark):
    from corpusloom.operators.acts import ACTS, act_rows
    from corpusloom.plans.record_queries import _PHRASES

    schema = "key long, act string, own string, heard string, name string, others array<string>, confidence int, retold boolean, voice string, family string, memory string, stress string"
    long = "word " * 40
    base = lambda k, act, **more: {"key": k, "act": act, "own": "Ann left.", "heard": "I saw Ann leave.", "name": "Ann", "others": ["Ann", "Bo"], "confidence": 30, "retold": True, "voice": "guard", "family": "loss", "memory": long, "stress": "high"} | more
    rows = [base(i, a) for i, a in enumerate(ACTS)] + [base(50, "disagree", heard="Nobody left."), base(51, "disagree", others=["Ann"]), base(52, "memory", memory=None), base(None, "say", voice="stranger", family=None), base(54, "certainty", confidence=90, retold=False), base(3, "disagree")]
    d = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    got = {}
    for r in act_rows(d, _PHRASES).collect():
        assert got.setdefault(r.key, r) == r  # a repeated row has the same answer
    assert [got[i].act for i in range(13)] == list(ACTS) and got[50].act == got[51].act == "agree"
    assert got[0].history == [] and got[0].target == "Ann left." and got[0].offset == 0 and got[11].history == []
    differ = got[3]
    assert differ.changed == "Bo" and differ.history[-1].text == "I saw Bo leave." and differ.target.encode()[differ.offset :].startswith(b"Ann left.")
    assert got[4].target.startswith(_PHRASES["unsure"]) and got[54].target.startswith(_PHRASES["held"])
    assert got[10].target.endswith("word...") and len(got[10].target) < 140 and got[52].target in _PHRASES["memory"]["loss"]
    assert got[None].target in _PHRASES["say"]["resident"]["neutral"] and {r.control for r in got.values()} == {"say", "think", "remember"}
    for r in got.values():
        assert len(r.history) in (0, 1, 2, 3, 4, 5, 6) and all(a.speaker != b.speaker for a, b in zip(r.history, r.history[1:]))
