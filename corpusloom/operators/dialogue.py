"""Dialogue records: contexts, roles, summaries, budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the channel format: control values, limits and texts.
CHANNEL, MESSAGE, REPLY, END_MESSAGE, END_RECORD, TARGET, SUMMARY = 1, 2, 3, 4, 5, 6, 7
CONTEXT_MESSAGES, MEMORY_MESSAGES = 3, 2
SUMMARY_CHARS, CONTEXT_CHARS, TARGET_CHARS = 80, 65, 180
STYLE_SUMMARY = {"S": "Shakespearean dramatic scene", "C": "Crowleyan dramatic scene", "B": "Blakean visionary verse", "D": "mixed literary conversation"}
OTHER_SUMMARY, THREAD_SUMMARY = "human channel conversation", "literary conversation"


def context_roles(messages: DataFrame, thread: str, pos: str, speaker: str, n: int = CONTEXT_MESSAGES) -> DataFrame:
    """Adds roles: a letter per context message; the target's speaker is Z, others A, B, C in
    order of first appearance. Messages without context are left out."""
    w = Window.partitionBy(thread).orderBy(pos).rowsBetween(-n, -1)
    d = messages.withColumn("__c", F.collect_list(speaker).over(w)).filter(F.size("__c") > 0)
    others = F.array_distinct(F.filter("__c", lambda s: s != F.col(speaker)))
    letter = lambda s: F.when(s == F.col(speaker), "Z").otherwise(F.substring(F.lit("ABC"), F.array_position(others, s).cast("int"), F.lit(1)))
    return d.withColumn("roles", F.array_join(F.transform("__c", letter), "")).drop("__c")


def budgeted_messages(messages: DataFrame, thread: str, pos: str, text: str, most: int = 3, budget: int = 300, each: int = 110, least: int = 24) -> DataFrame:
    """Recent messages that fit a budget, oldest first: thread, recent (array of texts).

    Newest first, each message is clipped to its last ``each`` characters and costs its length
    and 5; one over budget ends the walk unless it is the first taken, which is clipped.
    """
    tail = F.right(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(each))
    # At most ``most`` non-empty messages count, so a bounded tail of the thread is enough.
    w = Window.partitionBy(thread).orderBy(F.desc(pos))
    d = messages.select(thread, pos, tail.alias("t")).filter("t <> ''").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    g = d.groupBy(thread).agg(F.sort_array(F.collect_list(F.struct("n", "t"))).alias("all"))
    start = F.struct(F.lit(budget).alias("left"), F.lit(False).alias("over"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(a, m):
        cost = F.length(m["t"]) + 5
        stop = a["over"] | (a["left"] <= least) | ((cost > a["left"]) & (F.size(a["out"]) > 0))
        clipped = F.when(cost > a["left"], F.right(m["t"], F.greatest(F.lit(20), a["left"] - 5))).otherwise(m["t"])
        return F.struct(F.when(stop, a["left"]).otherwise(a["left"] - F.least(cost, a["left"])).alias("left"), stop.alias("over"), F.when(stop, a["out"]).otherwise(F.concat(F.array(clipped), a["out"])).alias("out"))

    return g.select(thread, F.aggregate("all", start, step, lambda a: a["out"]).alias("recent"))


def accept_gate(rounds: DataFrame, key: str, order: str, utility: str) -> DataFrame:
    """Adds accepted: a round stands if its utility is not below the last accepted one, which
    is the running maximum."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(utility).over(w)
    return rounds.select(key, order, utility, (best.isNull() | (F.col(utility) >= best)).alias("accepted"))


def _content(text: str, limit: int, tail: bool) -> list[int]:
    start, end = 0, len(text)
    if end > limit:
        if tail:
            space = text.find(" ", end - limit)
            start = space + 1 if space >= 0 else end
            if end - start < limit // 2:
                start = end - limit
        else:
            space = text.rfind(" ", 0, limit + 1)
            end = space if space > limit // 2 else limit
    return [ord(c) if 32 <= ord(c) < 127 else 32 for c in text[start:end] if 32 <= ord(c) < 127 or c in "\n\t"]


class _Thread:
    """One thread's messages and the records that come of them."""

    def __init__(self, rows: pd.DataFrame, style: str):
        rows = rows[rows["text"] != ""].sort_values("pos")
        self.m = rows[["speaker", "id", "reply", "text", "summary"]].to_dict("records")
        vibe = rows["vibe"].iloc[0] if len(rows) else ""
        self.vibe, self.style = vibe or THREAD_SUMMARY, style

    def roles(self, target: int, context: list[int]):
        own, letters = self.m[target]["speaker"], {}
        for i in context:
            s = self.m[i]["speaker"]
            if s != own:
                letters.setdefault(s, chr(ord("A") + len(letters)))
        return lambda i: "Z" if self.m[i]["speaker"] == own else letters.get(self.m[i]["speaker"], "X")

    def lossy(self, role, upto: int) -> str:
        out = self.vibe[:34]
        if upto == 0:
            return out
        out += " | "
        if self.m[upto - 1]["summary"]:
            return (out + self.m[upto - 1]["summary"])[:SUMMARY_CHARS]
        first = max(0, upto - 2)
        for i in range(first, upto):
            if len(out) + 5 >= SUMMARY_CHARS + 1:
                break
            out = (out + ("; " if i > first else "") + f"{role(i)}: " + self.m[i]["text"][:18])[:SUMMARY_CHARS]
        return out

    def recurrent(self, role, first: int, end: int, old: str) -> str:
        if self.m[end - 1]["summary"]:
            return self.lossy(role, end)
        out, prior = self.vibe[:22] + " | ", old.partition(" | ")[2]
        if prior:
            out += "~" + prior[:14] + "; "
        for i in range(first, end):
            if len(out) + 5 >= SUMMARY_CHARS + 1:
                break
            out = (out + ("; " if i > first else "") + f"{role(i)}: " + self.m[i]["text"][:12])[:SUMMARY_CHARS]
        return out

    def messages(self, context: list[int], role) -> list[int]:
        out = []
        for n, i in enumerate(context):
            out += [MESSAGE, ord(role(i))]
            if n:
                out += [REPLY, ord(role(context[n - 1]))]
            out += [*_content(self.m[i]["text"], CONTEXT_CHARS, True), END_MESSAGE]
        return out

    def turn_record(self, t: int, style: str) -> list[int]:
        first = max(0, t - CONTEXT_MESSAGES)
        context = list(range(first, t))
        wanted = self.m[t]["reply"]
        parent = next((i for i in range(t) if wanted and self.m[i]["id"] == wanted), -1)
        if 0 <= parent < first:
            context[0] = parent
        role = self.roles(t, context)
        answered = role(parent if parent in context else context[-1])
        head = [CHANNEL, ord(style), SUMMARY, *_content(self.lossy(role, context[0]), SUMMARY_CHARS, False), END_MESSAGE]
        return head + self.messages(context, role) + [MESSAGE, ord("Z"), REPLY, ord(answered), TARGET, *_content(self.m[t]["text"], TARGET_CHARS, False), END_MESSAGE, END_RECORD]

    def memory_record(self, t: int, style: str) -> list[int]:
        end = t + 1
        first = max(0, end - MEMORY_MESSAGES)
        context = list(range(first, end))
        role = self.roles(t, context)
        old = self.lossy(role, first)
        new = self.recurrent(role, first, end, old)
        head = [CHANNEL, ord(style), SUMMARY, *_content(old, SUMMARY_CHARS, False), END_MESSAGE]
        return head + self.messages(context, role) + [SUMMARY, TARGET, *_content(new, SUMMARY_CHARS, False), END_MESSAGE, END_RECORD]

    def records(self):
        for t in range(1, len(self.m)):
            for style in dict.fromkeys((self.style, "D")):
                yield t, "turn", style, self.turn_record(t, style)
            if t % MEMORY_MESSAGES == 1:
                for style in dict.fromkeys((self.style, "D")):
                    yield t, "memory", style, self.memory_record(t, style)


RECORDS = "channel string, pos int, kind string, style string, tokens array<int>"


def channel_records(messages: DataFrame, style: str) -> DataFrame:
    """Token records of threads: channel, pos, kind (turn or memory), style, tokens.

    ``messages`` has channel, pos, id, reply, speaker, text, summary and vibe. Each thread is
    one chat, folded in its own group.
    """
    cols = ["channel", "pos", "id", "reply", "speaker", "text", "summary", "vibe"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.fillna("")
        rows = [(pdf["channel"].iloc[0], *r) for r in _Thread(pdf, style).records()]
        return pd.DataFrame(rows, columns=["channel", "pos", "kind", "style", "tokens"])

    return messages.select(*cols).groupBy("channel").applyInPandas(run, RECORDS)


def preview(tokens: list[int]) -> str:
    """Readable form of a record."""
    show = {CHANNEL: "\n<CHANNEL:", MESSAGE: "\n[", REPLY: ">", END_MESSAGE: "]\n", END_RECORD: "<END>\n", TARGET: "] => ", SUMMARY: "\n<SUMMARY>"}
    return "".join(show.get(t, chr(t) if 32 <= t < 127 else ".") for t in tokens)
