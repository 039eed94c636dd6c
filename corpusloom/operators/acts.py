"""Answers by act: what a speaker who holds an account says, and the talk that leads up to it.

Nine acts of a conversation are answered from the account alone; four more also from the speaker's
mind. Wordings are a table of phrases; all draws are hashes of the row's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pairs import _drawn

CONVERSATION_ACTS = ("start", "question", "agree", "disagree", "certainty", "source", "check", "close", "end")
MIND_ACTS = ("say", "memory", "thought", "react")
ACTS = CONVERSATION_ACTS + MIND_ACTS
#: Characters of a memory that are told, and how many earlier exchanges a talk has, by draw.
MEMORY_MOST, DEPTHS = 80, (0, 1, 1, 2)


def picked(options, key: Column, what: str) -> Column:
    """One of some phrases by hash."""
    return F.get(F.array(*(F.lit(o) for o in options)), _drawn(key, what, len(options)))


def act_rows(rows: DataFrame, phrases: dict) -> DataFrame:
    """Rows with their answer: key, act, history (speaker and text), target, offset (bytes before
    the account in the target, null without it), changed (the other value in what was heard, null
    if none), stress, control.

    ``rows`` holds key, act, own (the account), heard (another's wording of it), name (a part of it),
    others (what may stand for the name), confidence, retold, voice, family, memory and stress. Who
    cannot disagree, because the name does not stand in what was heard, agrees. A long memory ends
    behind its last whole word. Up to two exchanges stand before the talk, where there is one.
    ``phrases`` has lists for questions, certainty, connectors, shaken and thoughts, one phrase for
    each of agree, differ, sure, unsure, passed, held, check, ask, close, who and end, and lines by
    voice and family (``say``) and by family (``memory``), with ``neutral`` for all others. Null keys
    draw like any other; repeated rows have the same answer.
    """
    p, k = phrases, F.col("key")
    one = {c: F.lit(p[c]) for c in ("agree", "differ", "sure", "unsure", "passed", "held", "check", "ask", "close", "who", "end")}
    turn = lambda who, text: F.struct(F.lit(who).alias("speaker"), text.alias("text"))
    others = F.filter("others", lambda x: x != F.col("name"))
    other = F.get(others, _drawn(k, "other", F.greatest(F.lit(1), F.size(others))))
    differs = (F.col("act") == "disagree") & F.contains("heard", F.col("name")) & other.isNotNull()
    d = rows.withColumn("changed", F.when(F.coalesce(differs, F.lit(False)), other))
    d = d.withColumn("act", F.when((F.col("act") == "disagree") & F.col("changed").isNull(), "agree").otherwise(F.col("act")))
    d = d.withColumn("heard", F.when(F.col("changed").isNotNull(), F.replace(F.col("heard"), F.col("name"), F.col("changed"))).otherwise(F.col("heard")))
    d = d.withColumn("stress", F.when(F.col("act") == "react", "high").otherwise(F.col("stress")))
    heard, own = F.col("heard"), F.col("own")
    act = lambda *names: F.col("act").isin(*names)
    stance = F.when(F.col("confidence") < 40, one["unsure"]).when(F.col("retold"), one["passed"]).otherwise(one["held"])

    def by_family(lines: dict, what: str) -> Column:
        out = picked(lines["neutral"], k, what)
        for family, some in lines.items():
            if family != "neutral":
                out = F.when(F.col("family") == family, picked(some, k, what)).otherwise(out)
        return out

    line = by_family(p["say"][next(iter(p["say"]))], "line")
    for voice, lines in p["say"].items():
        line = F.when(F.col("voice") == voice, by_family(lines, "line")).otherwise(line)
    short = F.concat(F.regexp_replace(F.left("memory", F.lit(MEMORY_MOST)), " [^ ]*$", ""), F.lit("..."))
    memory = F.when(F.length("memory") > MEMORY_MOST, short).otherwise(F.col("memory"))
    recalled = F.concat(by_family(p["memory"], "recall"), F.coalesce(F.concat(picked(p["connectors"], k, "connector"), memory), F.lit("")))
    shaken = (F.col("stress") == "high") & (_drawn(k, "shaken", 2) == 1)
    thought = F.concat(F.when(F.coalesce(shaken, F.lit(False)), picked(p["shaken"], k, "shake")).otherwise(""), picked(p["thoughts"], k, "thought"))
    target = F.when(act("start", "question"), own).when(act("agree"), one["agree"]).when(act("disagree"), F.concat(one["differ"], own, one["sure"]))
    target = target.when(act("certainty"), F.concat(stance, one["check"])).when(act("source"), F.concat(one["held"], one["check"])).when(act("check"), one["ask"])
    target = target.when(act("close"), one["close"]).when(act("end"), one["end"]).when(act("say", "react"), line).when(act("memory"), recalled).otherwise(thought)
    doubt = F.concat(F.when(_drawn(k, "doubt", 2) == 1, F.concat(one["differ"], heard, F.lit(" "))).otherwise(""), picked(p["certainty"], k, "certainty"))
    answer = F.concat(picked([p["unsure"], p["held"], p["passed"]], k, "answer"), one["check"])
    talk = F.when(act("start", "thought"), F.slice(F.array(turn("self", own)), 1, 0)).when(act("question"), F.array(turn("other", picked(p["questions"], k, "question"))))
    talk = talk.when(act("agree", "disagree", "say", "memory", "react"), F.array(turn("other", heard)))
    talk = talk.when(act("certainty"), F.array(turn("self", own), turn("other", doubt))).when(act("source"), F.array(turn("self", own), turn("other", one["who"])))
    talk = talk.when(act("check"), F.array(turn("self", picked(p["certainty"], k, "certainty")), turn("other", answer)))
    talk = talk.when(act("close"), F.array(turn("self", one["check"]), turn("other", one["ask"]))).otherwise(F.array(turn("self", one["ask"]), turn("other", one["close"])))
    d = d.withColumn("target", target).withColumn("talk", talk)
    first = F.col("talk")[0]["speaker"]
    asked = lambda i: F.struct(first.alias("speaker"), picked(p["questions"], k, f"before{i}").alias("text"))
    told = F.struct(F.when(first == "other", "self").otherwise("other").alias("speaker"), F.when(first == "other", own).otherwise(heard).alias("text"))
    depth = F.get(F.array(*map(F.lit, DEPTHS)), _drawn(k, "depth", len(DEPTHS)))
    history = F.when((F.size("talk") == 0) | (depth == 0), F.col("talk")).when(depth == 1, F.concat(F.array(asked(0), told), "talk")).otherwise(F.concat(F.array(asked(1), told, asked(0), told), "talk"))
    offset = F.when(act("start", "question"), 0).when(act("disagree"), F.octet_length(one["differ"]))
    control = F.when(act("thought"), "think").when(act("memory"), "remember").otherwise("say")
    return d.select("key", "act", history.alias("history"), "target", offset.alias("offset"), "changed", "stress", control.alias("control"))
