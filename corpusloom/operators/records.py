"""Training records: slices by an audit, row encoding, validation rules, moves, ranks and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .generate import hash_int, products
from .sides import side


def audit_slices(files: DataFrame, rows: DataFrame, context: int) -> DataFrame:
    """Examples cut out of concatenated files by an audit.

    ``files`` is (file, content as bytes); ``rows`` is (file, id, text_start, output_start,
    text_bytes, output). A row's slice is event lines, the output with a line feed, and a line
    feed. Adds prefix (event lines that are left), dropped (earliest lines left out until prefix
    and output fit ``context`` and one; the last line always stays) and the checks contiguous,
    target_ok, ascii_ok, events_ok, fits.
    """
    w = Window.partitionBy("file").orderBy("text_start", "id")
    follows = F.col("text_start") == F.coalesce(F.lag(F.col("text_start") + F.col("text_bytes")).over(w), F.lit(0))
    at_end = F.lead("id").over(w).isNotNull() | (F.col("text_start") + F.col("text_bytes") == F.octet_length("content"))
    d = rows.join(files, "file")
    d = d.withColumn("contiguous", follows & at_end & (F.col("text_start") < F.col("output_start")) & (F.col("output_start") < F.col("text_start") + F.col("text_bytes")))
    cut = lambda a, n: F.substring(F.col("content"), (a + 1).cast("int"), n.cast("int"))
    head = F.col("output_start") - F.col("text_start")
    d = d.withColumn("sample", F.decode(cut(F.col("text_start"), F.col("text_bytes")), "UTF-8")).withColumn("head", F.decode(cut(F.col("text_start"), head), "UTF-8")).drop("content")
    target = F.concat("output", F.lit("\n"))
    d = d.withColumn("target_ok", (F.col("sample") == F.concat("head", target, F.lit("\n"))) & F.endswith("head", F.lit("\n")))
    d = d.withColumn("ascii_ok", ~F.col("sample").rlike(r"[^\x01-\x7F]"))
    lines = F.slice(F.split("head", "\n"), 1, F.size(F.split("head", "\n")) - 1)
    d = d.withColumn("__lines", lines).withColumn("__room", F.lit(context + 1) - F.octet_length(target))
    start = F.struct(F.octet_length("head").alias("left"), F.lit(0).alias("dropped"))
    fold = F.aggregate(F.slice("__lines", 1, F.greatest(F.lit(0), F.size("__lines") - 1)), start, lambda a, x: F.when(a["left"] > F.col("__room"), F.struct((a["left"] - F.octet_length(x) - 1).alias("left"), (a["dropped"] + 1).alias("dropped"))).otherwise(a))
    d = d.withColumn("__fold", fold).withColumn("dropped", F.col("__fold.dropped"))
    d = d.withColumn("prefix", F.concat(F.array_join(F.slice("__lines", F.col("dropped") + 1, F.size("__lines")), "\n"), F.lit("\n")))
    d = d.withColumn("events_ok", F.forall(F.slice("__lines", F.col("dropped") + 1, F.size("__lines")), lambda x: F.startswith(x, F.lit("- "))))
    return d.withColumn("fits", F.col("__fold.left") <= F.col("__room")).select("id", "prefix", "dropped", "contiguous", "target_ok", "ascii_ok", "events_ok", "fits")


def participant_rules(encode, formats: tuple[str, ...], *, prompt_most=352, target_most=159, bytes_most=511, least_token=9) -> dict[str, Column]:
    """Rules of a participant row by name, for ``violations``.

    Columns: format, prompt, prompt_tokens, target_text, tokens, labels, review_status,
    source_review_status, world_group. ``encode`` gives a text's ids. A target is a JSON object,
    either a speech (kind and a text that is not blank and has no control character) or the
    action that ends a conversation; labels hide the prompt and are shifted by one.
    """
    status = F.coalesce(F.col("source_review_status"), F.lit(""))
    value = F.from_json("target_text", "map<string,string>")
    keys = F.array_sort(F.map_keys(value))
    speech = (keys == F.array(F.lit("kind"), F.lit("text"))) & (value["kind"] == "speech") & (F.trim(value["text"]) != "") & ~value["text"].rlike(r"[\x00-\x1F\x7F]")
    action = (keys == F.array(F.lit("action"), F.lit("kind"))) & (value["kind"] == "action") & (value["action"] == "end_conversation")
    prefix, target = encode(F.col("prompt")), encode(F.col("target_text"))
    labels = F.concat(F.array_repeat(F.lit(-100), F.size(prefix) - 1), target, F.array(F.lit(0)))
    return {
        "format": F.col("format").isin(*formats),
        "header": F.startswith("prompt", F.concat("format", F.lit("\n"))),
        "source_not_rejected": ~F.startswith(status, F.lit("rejected")),
        "source_not_held": ~F.startswith(status, F.lit("hold")),
        "compact_approved": F.col("review_status") == "approved_compact",
        "source_approved": status == "approved",
        "world_group": F.coalesce(F.col("world_group"), F.lit("")) != "",
        "target_object": value.isNotNull(),
        "target_kind": F.coalesce(speech, F.lit(False)) | F.coalesce(action, F.lit(False)),
        "prompt_budget": F.size(prefix).between(1, prompt_most),
        "target_budget": F.size(target).between(1, target_most),
        "target_bytes": F.octet_length("target_text") <= bytes_most,
        "token_floor": F.forall(F.concat(prefix, target), lambda t: t >= least_token),
        "prompt_tokens": F.col("prompt_tokens") == prefix,
        "row_tokens": F.col("tokens") == F.concat(prefix, target),
        "labels": F.col("labels") == labels,
    }


def rank_candidates(log_p: DataFrame, prompt: list[str], candidate: str, value: str) -> DataFrame:
    """Candidates of each prompt by the sum of their tokens' log-probabilities: prompt, candidate,
    score, rank (ties to the smaller candidate)."""
    s = log_p.groupBy(*prompt, candidate).agg(F.sum(value).alias("score"))
    w = Window.partitionBy(*prompt).orderBy(F.desc(F.round("score", 9)), candidate)
    return s.withColumn("rank", F.row_number().over(w))


def memory_records(records: DataFrame, tokens: str, summary: int, target: int) -> DataFrame:
    """Records in which a summary marker is followed by a target marker at once."""
    pairs = F.zip_with(F.col(tokens), F.slice(tokens, F.lit(2), F.size(tokens)), lambda a, b: (a == summary) & (b == target))
    return records.filter(F.exists(pairs, lambda x: F.coalesce(x, F.lit(False))))


def seed_split(rows: DataFrame, seed: str, train: int, valid_from: int, salt: str, key: Column) -> DataFrame:
    """train for seeds from 1 to ``train``, validation from ``valid_from`` up, none in between;
    adds split and shuffled, the order of a shuffle by hash (ranked only where rows are laid out)."""
    s = F.when(F.col(seed).between(1, train), "train").when(F.col(seed) >= valid_from, "validation")
    return rows.withColumn("split", s).filter("split is not null").withColumn("shuffled", F.sha2(F.concat(F.lit(salt), key.cast("string")), 256))


def field_substitutions(rows: DataFrame, fields: str, names: list[str]) -> DataFrame:
    """Each row as it is (slot null) and with each field replaced by each name: slot (from 0), name, text."""
    options = F.array(*(F.lit(n) for n in names))
    text = lambda f: F.array_join(f, " ")
    swap = lambda i, n: F.array_join(F.transform(fields, lambda f, j: F.when(j == i, n).otherwise(f)), " ")
    changed = F.flatten(F.transform(F.sequence(F.lit(0), F.size(fields) - 1), lambda i: F.transform(options, lambda n: F.struct(i.alias("slot"), n.alias("name"), swap(i, n).alias("text")))))
    plain = F.array(F.struct(F.lit(None).cast("int").alias("slot"), F.lit(None).cast("string").alias("name"), text(fields).alias("text")))
    cases = F.when(F.size(fields) > 0, F.concat(plain, changed)).otherwise(plain)
    return rows.withColumn("__case", F.explode(cases)).select(*rows.columns, "__case.slot", "__case.name", "__case.text")


def overlap_report(train: DataFrame, test: DataFrame, key: str, slots: Column, values: Column) -> DataFrame:
    """Test rows with two flags: whether training has a row of the same pattern of slots, and one
    of the same values too."""
    sides = [("slots_seen", F.sha2(slots, 256)), ("values_seen", F.sha2(F.concat_ws("\x1f", slots, values), 256))]
    out = test.select(key, *(s.alias(f"__{n}") for n, s in sides))
    for name, sign in sides:
        seen = train.select(sign.alias(f"__{name}")).distinct().withColumn(name, F.lit(True))
        out = out.join(seen, f"__{name}", "left")
    return out.select(key, *(F.coalesce(n, F.lit(False)).alias(n) for n, _ in sides))


def move_rows(rows: DataFrame, frames: DataFrame, key: str, level: str, own: str, heard: str) -> DataFrame:
    """A row for every move that a frame of the row's level describes.

    ``frames`` is (move, level, lead, asks, opens, closes, claim). The
    history is what the lead says: nothing; ``heard``; ``ask`` (one of the asks); or ``own`` (the
    own account, then one of the asks). Accepted are all opens before all closes, with the own
    account between them if the move states a claim; the target is one of them by hash, and
    ``offset`` is where the account starts in it, in bytes.
    """
    d = rows.join(side(frames.withColumnRenamed("level", "__level")), F.col(level) == F.col("__level")).drop("__level")
    draw = lambda a, what: F.get(a, (hash_int(F.concat_ws(":", F.lit(what), "move", F.col(key).cast("string"))) % F.size(a)).cast("int"))
    said = lambda who, text: F.struct(F.lit(who).alias("speaker"), text.alias("text"))
    none = F.array(said("self", F.lit(""))).cast("array<struct<speaker:string,text:string>>")
    ask = draw(F.col("asks"), "ask")
    history = F.when(F.col("lead") == "heard", F.array(said("other", F.col(heard)))).when(F.col("lead") == "ask", F.array(said("other", ask)))
    history = history.when(F.col("lead") == "own", F.array(said("self", F.col(own)), said("other", ask))).otherwise(F.slice(none, 1, 0))
    middle = F.transform("closes", lambda c: F.when(F.col("claim"), F.concat(F.col(own), c)).otherwise(c))
    accepted = F.array_sort(F.array_distinct(products(F.col("opens"), middle)))
    d = d.withColumn("history", history).withColumn("accepted", accepted).withColumn("target", draw(F.col("accepted"), "target"))
    before = F.left("target", F.expr(f"instr(target, `{own}`)") - 1)
    return d.withColumn("offset", F.when(F.col("claim"), F.octet_length(before)))


def fingerprint(parts: dict[str, Column]) -> Column:
    """Struct of the SHA-256 of each part and of all of them by name, as a manifest states them."""
    each = {n: F.sha2(c, 256) for n, c in parts.items()}
    lines = F.concat_ws("\n", *(F.concat(F.lit(f"{n} "), each[n]) for n in sorted(each)))
    return F.struct(*(c.alias(n) for n, c in each.items()), F.sha2(lines, 256).alias("all"))


def review_packets(cases: DataFrame, case: str, arm: str, baseline: str, candidate: str, salt: str) -> DataFrame:
    """Baseline against candidate by arm, A and B: in the first half of an arm's cases by hash the
    candidate is A. Cases of an arm are a review packet, of the size that people read."""
    h = F.sha2(F.concat(F.lit(salt), F.col(arm), F.lit(":"), F.col(case).cast("string")), 256)
    w = Window.partitionBy(arm)
    first = F.row_number().over(w.orderBy(h)) <= F.floor(F.count(F.lit(1)).over(w) / 2)
    d = cases.withColumn("candidate_side", F.when(first, "A").otherwise("B"))
    swap = F.col("candidate_side") == "A"
    return d.select(arm, case, F.when(swap, F.col(candidate)).otherwise(F.col(baseline)).alias("a_text"), F.when(swap, F.col(baseline)).otherwise(F.col(candidate)).alias("b_text"), "candidate_side")


def marker_records(streams: DataFrame, key: str, tokens: str, mark: int, share: int = 20) -> DataFrame:
    """(key, place, held): where the records of a stream start, each at a marker, and whether a record
    is of the last 1/``share``."""
    places = F.filter(F.transform(tokens, lambda t, i: F.when(t == mark, i.cast("long"))), lambda x: x.isNotNull())
    d = streams.select(key, places.alias("__at")).withColumn("__n", F.size("__at"))
    d = d.select(key, "__n", F.posexplode("__at").alias("__i", "place"))
    return d.select(key, "place", (F.col("__i") >= F.col("__n") - F.floor(F.col("__n") / share)).alias("held"))


def seed_gate(runs: DataFrame, run: str, seed: str, passed: str, digest: str, pilot: int = 1) -> DataFrame:
    """Adds allowed: the pilot seed is, others only if the run's pilot passed with the same digest."""
    first = runs.filter(F.col(seed) == pilot).select(F.col(run).alias("__run"), F.col(passed).alias("__passed"), F.col(digest).alias("__digest"))
    same = F.coalesce(F.col("__passed"), F.lit(False)) & F.coalesce(F.col("__digest") == F.col(digest), F.lit(False))
    d = runs.join(first, F.col(run) == F.col("__run"), "left").withColumn("allowed", (F.col(seed) == pilot) | same)
    return d.drop("__run", "__passed", "__digest")


def approved_by_group(rows: DataFrame, approved: DataFrame, group: str, text: str, accepted: str, stopped: Column) -> DataFrame:
    """(group, n, approved): rows of a group, and those that stopped with an accepted text."""
    hit = F.coalesce(F.array_contains(accepted, F.col(text)), F.lit(False)) & F.coalesce(stopped, F.lit(False))
    return rows.join(approved, group, "left").groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("approved"))


def faults(rules: dict[str, Column]) -> Column:
    """Names of the broken rules; a rule that is null is broken."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())


def question_probes(exchanges: DataFrame, key: str, question: str, answer: str, other: Column, name: str = "[A-Z][a-z]{2,}") -> DataFrame:
    """Each exchange under the question of the one with the key ``other``: key, expected (the names
    of the answer that stand in its own question, in order), copied (those that stand in the other)
    and whether they are the same. Exchanges without a partner are left out."""
    swapped = exchanges.select(F.col(key).alias("__other"), F.col(question).alias("__question"))
    d = exchanges.withColumn("__of", other).join(swapped, F.col("__of") == F.col("__other"))
    names = F.regexp_extract_all(answer, F.lit(name), F.lit(0))
    stand = lambda text: F.filter(names, lambda x: F.contains(F.col(text), x))
    d = d.select(key, stand(question).alias("expected"), stand("__question").alias("copied"))
    return d.withColumn("same", F.col("expected") == F.col("copied"))
