"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Keys are cut into equal ranges, so a source of any
size spreads over many; the sizes in a range are summed, a prefix sum over the ranges of a
source gives each range its base, and a running sum inside a range (sorted by key) gives
each document its place in the source's shuffled stream. Every source is then read up to
its exact budget: whole epochs first, then the stream up to the cut.

Rows alike in source, doc_id and size are counted first, on the map side too, and stand for
one stretch of the stream, so a doc_id that a third of all rows share (or a null one) costs
a range no more than a row per size that occurs with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import expanded, free_prefix, identified, materialize, small

#: Documents that a key range holds on average.
RANGE = 1024
#: Sources up to this many are broadcast, more are joined by shuffle.
SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and tab to carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weight_cycle=(5, 2, 1), most=3) -> DataFrame:
    """Target of each source: ``sizes`` is (source, source_size), one row per source.

    Sources in code point order (null last) weigh ``weight_cycle``, repeating. They share the
    sum of all sizes by weight; a target stops at ``most`` times its source's size and the
    excess is shared by weight among the others until none is above. That is a water level:
    with sources ordered by ``cap / weight``, the level is set by the first source whose cap
    is not reached when all before it are capped.
    """
    cycle = F.array(*(F.lit(w) for w in weight_cycle))
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = sizes.withColumn("n", n).withColumn("weight", F.get(cycle, (F.col("n") - 1) % len(weight_cycle)).cast("long"))
    w = w.withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "n")
    before, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = w.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    w = w.withColumn("open_weight", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    level = (F.sum("source_size").over(all_rows) - F.col("capped")).cast("double") / F.col("open_weight")
    w = w.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    # the first source in order whose cap holds sets the level for all after it
    w = w.withColumn("water", F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.coalesce(F.col("water") * F.col("weight"), F.col("cap").cast("double"))
    return w.select("source", "n", "weight", "source_size", F.least(target, F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, *, doc_id="doc_id", text="text", source="source", weight_cycle=(5, 2, 1), most=3, seed="mix-1") -> DataFrame:
    """How many words of each document the mix takes.

    Returns doc_id, source, size, source_size, target (its source's), taken, epochs (whole
    passes over its source), place (words of its source before it). ``taken`` counts repeats:
    every document of a source is taken in each whole epoch, the last pass ends at the word
    that meets the target, so a source's taken words are its target rounded down.

    A null text has size 0; a null source is a source of its own, last in order; repeated
    rows are separate documents; equal keys are ordered by doc_id and size, so reruns agree;
    other columns are ignored; no rows give no rows.
    """
    stretches = _placed(docs, doc_id, text, source, weight_cycle, most, seed)
    rows = expanded(stretches, "copies", "copy").withColumn("place", F.col("place") + F.col("copy") * F.col("size"))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("place")))
    taken = (F.col("epochs") * F.col("size") + last).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "epochs", "place")


def hash_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mixed_rows(docs: DataFrame, *, doc_id="doc_id", text="text", source="source", weight_cycle=(5, 2, 1), most=3, seed="mix-1") -> DataFrame:
    """The mix itself: rows of ``docs`` with their columns, repeated by whole epochs, the last
    pass ending at the document whose middle meets the target.

    The cut of a source is a stretch (key, doc_id, size) and, where rows alike in all three lie
    across it, the row's place in the files; so documents are chosen where they are read, only a
    row per source is joined to them, and no text is shuffled. Null and repeated doc_ids are rows
    like any other.
    """
    names, p = docs.columns, free_prefix(docs.columns)
    docs = identified(docs, f"{p}row")
    placed = _placed(docs, doc_id, text, source, weight_cycle, most, seed)
    # copies of a stretch whose middle lies before the end of the last pass
    room = F.col("rest") - F.col("place") - F.col("size") / 2
    some = F.when(F.col("rest") <= 0, 0).when(F.col("size") == 0, F.when(room >= 0, F.col("copies")).otherwise(0))
    some = some.otherwise(F.greatest(F.lit(0), F.least(F.col("copies"), F.floor(room / F.col("size")) + 1))).cast("long")
    stretch = F.struct("key", "doc_id", "size")
    last = F.when(some > 0, F.struct(stretch.alias("stretch"), some.alias("some"), F.col("copies")))
    cuts = materialize(placed.groupBy("source").agg(F.max("epochs").alias("epochs"), F.max(last).alias("last")), "cuts")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(source).cast("string").alias("source"), F.col(f"{p}row").alias("row"))
    cuts = materialize(cuts.join(_last_row(rows, cuts, seed), F.col("source").eqNullSafe(F.col("of")), "left").drop("of"), "cuts")
    named = cuts.select(*(F.col(c).alias(p + c) for c in cuts.columns))
    joined = docs.join(small(named, cuts.count(), SOURCES), F.col(source).cast("string").eqNullSafe(F.col(f"{p}source")))
    key, cut = hash_key(F.col(doc_id), seed), F.col(f"{p}last.stretch")
    mine = F.struct(key, F.col(doc_id), word_count(F.col(text).cast("string")))
    whole = (F.col(f"{p}last.some") == F.col(f"{p}last.copies")) | (F.col(f"{p}row") <= F.col(f"{p}until"))
    # texts are only counted where the key is the cut's own
    inside = F.when(F.col(f"{p}last").isNull() | (key > cut["key"]), 0).when(key < cut["key"], 1)
    inside = inside.otherwise(F.when(mine < cut, 1).when((mine == cut) & whole, 1).otherwise(0))
    copies = joined.withColumn(f"{p}copy", F.col(f"{p}epochs") + inside).filter(F.col(f"{p}copy") > 0)
    return copies.withColumn(f"{p}copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{p}copy")))).select(*(docs[c] for c in names))


def _last_row(rows, cuts, seed) -> DataFrame:
    """(of, until): for sources whose cut goes through rows alike, the last row that is taken, by
    a prefix sum of such rows over the files."""
    split = cuts.filter("last.some < last.copies").select(F.col("source").alias("of"), F.col("last.some").alias("some"), F.col("last.stretch").alias("cut"))
    mine = F.struct(hash_key(F.col("doc_id"), seed), F.col("doc_id"), word_count(F.col("text")))
    match = F.col("source").eqNullSafe(F.col("of")) & (hash_key(F.col("doc_id"), seed) == F.col("cut.key"))
    alike = rows.join(small(split, split.count(), SOURCES), match).filter(mine == F.col("cut")).select("of", "some", "row.file", "row.at", "row")
    per_file = alike.groupBy("of", "file").agg(F.count(F.lit(1)).alias("n"), F.first("some").alias("some"))
    before = F.sum("n").over(Window.partitionBy("of").orderBy("file")) - F.col("n")
    ends = per_file.withColumn("need", F.col("some") - before).filter("need between 1 and n").select(F.col("of").alias("o"), F.col("file").alias("f"), "need")
    alike = alike.join(F.broadcast(ends), F.col("of").eqNullSafe(F.col("o")) & (F.col("file") == F.col("f")))  # one file a source
    nth = F.row_number().over(Window.partitionBy("of", "file").orderBy("at"))
    return alike.withColumn("nth", nth).filter("nth = need").select("of", F.col("row").alias("until"))


def _placed(docs, doc_id, text, source, weight_cycle, most, seed) -> DataFrame:
    """Stretches of rows alike: source, key, doc_id, size, copies, place (of the first copy),
    source_size, target, epochs and rest (words of the last pass)."""
    d = F.col(doc_id)
    key = hash_key(d, seed)
    sized = materialize(docs.select(d.alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text).cast("string")).alias("size"), key.alias("key")), "sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = materialize(targets(per_source, weight_cycle, most), "targets")
    bits = min(20, max(0, (sized.count() // RANGE).bit_length()))
    part = F.conv(F.substring("key", 1, 5), 16, 10).cast("long")
    goal = small(goals.withColumnRenamed("source", "named"), goals.count(), SOURCES)
    alike = sized.groupBy("source", "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies"))
    keyed = alike.join(goal, F.col("source").eqNullSafe(F.col("named"))).drop("named").withColumn("part", F.shiftright(part, 20 - bits))
    keyed = keyed.withColumn("words", F.col("size") * F.col("copies"))
    ranges = Window.partitionBy("n", "part")
    run = ranges.orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = materialize(keyed.withColumn("inside", F.sum("words").over(run) - F.col("words")), "placed")
    base = placed.groupBy("n", "part").agg(F.sum("words").alias("in_range"))
    base = base.withColumn("base", F.sum("in_range").over(Window.partitionBy("n").orderBy("part")) - F.col("in_range")).select("n", "part", "base")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    out = placed.join(base, ["n", "part"]).withColumn("place", F.col("base") + F.col("inside")).withColumn("epochs", epochs)
    out = out.withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    return out.select("source", "key", "doc_id", "size", "copies", "place", "source_size", "target", "epochs", "rest")
