"""Stateful, arrival-ordered processes on Structured Streaming.

Each keyed processor keeps only its key's state in the state store and recovers from the
checkpoint; arrival order is the order of an ``arrival`` column within a micro-batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RING = 32
#: Characters of a message that a rolling summary takes.
SAID = 12


def use_rocksdb(spark: SparkSession) -> None:
    """State of these processors needs the RocksDB provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Votes(StatefulProcessor):
    """First content of an event id stands; the same again is silent, other content a conflict.
    Ids have few rows each, so rows come as rows: a frame for every id would outweigh them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "content string")

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        held = self.seen.get()
        first = kept = held[0] if held else None
        for r in sorted(rows, key=lambda r: r.arrival):
            content = json.dumps([r.packet_id, r.reviewer_id, int(r.case_id), r.choice])
            if content == kept:
                continue
            status = "conflict" if kept is not None else "stored"
            kept = content if kept is None else kept
            yield Row(event_id=r.event_id, packet_id=r.packet_id, reviewer_id=r.reviewer_id, case_id=r.case_id, choice=r.choice, arrival=r.arrival, status=status)
        if first is None:
            self.seen.update((kept,))

    def close(self) -> None:
        pass


def vote_store(events: DataFrame) -> DataFrame:
    """Idempotent vote log: stored events once, and conflicts (an id again with other content)."""
    schema = "event_id string, packet_id string, reviewer_id string, case_id long, choice string, arrival long, status string"
    return events.groupBy("event_id").transformWithState(_Votes(), schema, "append", "none")


class _Latest(StatefulProcessor):
    """Latest choice of a (packet, reviewer, case)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "arrival long, choice string")

    def handleInputRows(self, key, rows, timers):
        top = max((r for frame in rows for r in frame.to_dict("records")), key=lambda r: r["arrival"])
        old = self.last.get() if self.last.exists() else None
        if old is None or top["arrival"] > old[0]:
            self.last.update((int(top["arrival"]), str(top["choice"])))
            yield pd.DataFrame([{"packet_id": key[0], "reviewer_id": key[1], "case_id": int(key[2]), "choice": top["choice"], "arrival": int(top["arrival"])}])

    def close(self) -> None:
        pass


def effective_stream(stored: DataFrame) -> DataFrame:
    """Updates of the effective vote per packet, reviewer and case, in order of arrival; the last
    update of a key is its vote, ``withdraw`` removes it."""
    schema = "packet_id string, reviewer_id string, case_id long, choice string, arrival long"
    return stored.groupBy("packet_id", "reviewer_id", "case_id").transformWithStateInPandas(_Latest(), schema, "update", "none")


class Ring:
    """Episodic memory of a fixed number of vectors: recall first, then overwrite the oldest."""

    def __init__(self, slots: dict[int, np.ndarray] | None = None, at: int = 0):
        self.slots, self.at = slots or {}, at

    def recall(self, v: np.ndarray, floor: float = -1.0) -> tuple[int, float]:
        best, slot = floor, -1
        for i in sorted(self.slots):
            s = float(np.dot(self.slots[i], v))
            if s > best:
                best, slot = s, i
        return slot, best

    def remember(self, v: np.ndarray) -> int:
        slot = self.at
        self.slots[slot] = v
        self.at = (slot + 1) % RING
        return slot


def _arrivals(rows: Iterator[pd.DataFrame]) -> list[dict]:
    """A key's rows of one micro-batch (which the source's trigger options bound) as they arrived."""
    return sorted((r for frame in rows for r in frame.to_dict("records")), key=lambda r: r["arrival"])


class _Memory(StatefulProcessor):
    """Ring of a conversation; ``signed`` rows are packets and must carry a right signature.

    Each slot is an entry of its own in the state, so a vector that is remembered writes one slot
    and the place of the next, and the change log of a batch holds the slots that it wrote.
    """

    def __init__(self, signed: bool):
        self.signed = signed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "slot int", "vector array<float>")
        self.next = handle.getValueState("next", "at int")

    def handleInputRows(self, key, rows, timers):
        from ..functions.kernels import _signed, fnv

        held = {k[0]: np.asarray(v[0], np.float32) for k, v in self.slots.iterator()}
        ring, out, written = Ring(held, self.next.get()[0] if self.next.exists() else 0), [], set()
        for r in _arrivals(rows):
            v = np.asarray(r["vector"], np.float32)
            ok = not self.signed or _signed(fnv(v.tobytes())) == int(r["signature"])
            recalled, score = ring.recall(v, 0.0 if self.signed else -1.0)
            score = max(score, 0.0) if self.signed or not ring.slots else score
            slot = ring.remember(v) if ok else -1
            if ok:
                written.add(slot)
            out.append((*key, int(r["arrival"]), slot, recalled if ok and not self.signed else -1, score if ok else 0.0, ok))
        for slot in sorted(written):
            self.slots.updateValue((slot,), ([float(x) for x in ring.slots[slot]],))
        if written:
            self.next.update((ring.at,))
        yield pd.DataFrame(out, columns=["stream", "arrival", "slot", "recalled", "score", "accepted"])

    def close(self) -> None:
        pass


_MEMORY = "stream long, arrival long, slot int, recalled int, score double, accepted boolean"


def episodic_memory(events: DataFrame) -> DataFrame:
    """(stream, arrival, vector) → slot written, slot recalled before writing and its cosine."""
    return events.groupBy("stream").transformWithStateInPandas(_Memory(False), _MEMORY, "append", "none")


def vector_exchange(packets: DataFrame) -> DataFrame:
    """(stream, arrival, vector, signature): a packet with a wrong signature is rejected, others
    report their resonance with the ring (0 at least) and are lodged."""
    return packets.groupBy("stream").transformWithStateInPandas(_Memory(True), _MEMORY, "append", "none")


class _Rolling(StatefulProcessor):
    """Rolling summary of a conversation, replaced after each exchange of two messages. The state
    is the summary and what it will take of a message that waits for its answer: 92 characters."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("memory", "summary string, pending string")

    def handleInputRows(self, key, rows, timers):
        summary, pending = self.state.get() if self.state.exists() else ("", "")
        out = []
        for r in _arrivals(rows):
            text = " ".join((r["text"] or "").split())[:SAID]
            if not pending:
                pending = text or " "
                continue
            prior = summary.partition(" | ")[2]
            summary = f"chat | {'~' + prior[:14] + '; ' if prior else ''}{pending}; {text}"[:80]
            pending = ""
            out.append((*key, int(r["arrival"]), summary))
        self.state.update((summary, pending))
        yield pd.DataFrame(out, columns=["stream", "arrival", "summary"])

    def close(self) -> None:
        pass


def rolling_memory(messages: DataFrame) -> DataFrame:
    """(stream, arrival, text) → a summary after every second message."""
    return messages.groupBy("stream").transformWithStateInPandas(_Rolling(), "stream long, arrival long, summary string", "append", "none")


def run_once(stream: DataFrame, name: str, path: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there, into Parquet at ``path``, and read the result."""
    spark = stream.sparkSession
    use_rocksdb(spark)
    if mode == "append":
        q = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint or f"{path}-checkpoint").trigger(availableNow=True).format("parquet").start(path)
    else:
        q = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint or f"{path}-checkpoint").trigger(availableNow=True).foreachBatch(lambda df, i: df.write.mode("append").parquet(path)).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Extension: tumbling event-time windows with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
