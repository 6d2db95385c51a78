"""Operators over unending streams, with state of their own: segments of words, buffers of slow readers, subscribers.

State lives in the RocksDB store and is written with the stream's checkpoint, so a query that dies goes on where
it stopped. Output is appended; a row is given out once.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState

from ..functions import script as S
from ..params import SEG, SENTENCE_END
from ..sources.shared import tidy

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the setting is put back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def appended(result: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all there is, adds what it gives out to ``path``, and returns all that is there."""
    spark = result.sparkSession
    with rocksdb(spark), tidy(spark):
        query = result.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        query.option("compression", "zstd").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(path)


def caught_up(result: DataFrame, path: str, checkpoint: str, wait_s: float = 600) -> DataFrame:
    """As ``appended``, for a stream with timers of the clock, which never runs out of batches: it is stopped after
    the first batch that finds nothing new."""
    spark = result.sparkSession
    with rocksdb(spark):
        query = result.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        query = query.trigger(processingTime="200 milliseconds").start()
    until = time.time() + wait_s
    try:
        while query.isActive and time.time() < until and not any(p.batchId > 0 and p.numInputRows == 0 for p in query.recentProgress):
            time.sleep(0.1)
    finally:
        query.stop()
    if query.exception():
        raise query.exception()
    return spark.read.schema(result.schema).parquet(path)


class Kept(StatefulProcessor):
    """A processor with one state for each key, a dictionary."""

    empty: dict = {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("kept", "kept string")

    def load(self) -> dict:
        return json.loads(self.state.get()[0]) if self.state.exists() else json.loads(json.dumps(self.empty))

    def save(self, kept: dict) -> None:
        self.state.update((json.dumps(kept),))

    def wake(self, at: int) -> None:
        """One timer for each key, at ``at``."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(at))


SEGMENTS = "vid long, segment long, start_ms long, end_ms long, speaker string, n_words long, words array<struct<seq:long,text:string>>, late long"
#: A word as the rules read it; what is held of one is a list of these in this order.
HEARD = ("seq", "text", "t_ms", "stop", "spk", "brk", "bucket", "ends")
SEQ, TEXT, T_MS, STOP, SPK, BRK, BUCKET, ENDS = range(len(HEARD))


class Line:
    """The rules of ``words.sessions`` for one video, one word after another.

    Held for a video: the open segment, the last word, the script that counts, whether a mark was seen, and
    at most two words of a run of the target script that may still grow; and when it is to be looked at again.
    """

    def __init__(self, wake=0, n=0, last=None, script=None, marks=False, open=(), run=(), settled=False, late=0):
        self.wake, self.n, self.last, self.script, self.marks, self.settled, self.late = wake, n, last, script, marks, settled, late
        self.open, self.run = list(open), list(run)
        self.out: list[tuple] = []

    def kept(self) -> tuple:
        return self.wake, self.n, self.last, self.script, self.marks, self.open, self.run, self.settled, self.late

    def newest(self) -> list | None:
        return self.run[-1] if self.run else self.last

    def hear(self, words: list[tuple]) -> None:
        newest = self.newest()
        seen = newest[SEQ] if newest else None
        for w in words:
            if seen is not None and w[SEQ] <= seen:
                self.late += 1
                continue
            seen = w[SEQ]
            if w[BUCKET] == "target" and not self.settled:
                self.run.append(w)
                if len(self.run) == SEG.foreign_min_words:
                    self.release(embedded=False)
                    self.settled = True
                continue
            if w[BUCKET] != "target":
                self.release(embedded=True)
                self.settled = False
            self.take(w, w[BUCKET])

    def release(self, embedded: bool) -> None:
        run, self.run = self.run, []
        for w in run:
            self.take(w, None if embedded else w[BUCKET])

    def take(self, w: tuple, own: str | None) -> None:
        last = self.last
        gap = max(0, w[T_MS] - last[STOP]) if last else 0
        if (
            last is None or gap >= SEG.gap or w[BRK] or last[ENDS]
            or (not self.marks and w[SPK] != last[SPK] and gap >= SEG.speaker_gap)
            or (own is not None and self.script is not None and own != self.script)
        ):
            self.finish()
            self.n += 1
        self.open.append(w)
        self.marks = self.marks or w[BRK]
        self.script, self.last = own or self.script, w

    def finish(self) -> None:
        words, self.open = self.open, []
        if words:
            weights: dict = {}
            for w in words:
                weights[w[SPK]] = weights.get(w[SPK], 0) + max(SEG.word_overlap, w[STOP] - w[T_MS])
            speaker = max(weights, key=weights.get)  # the first heard wins ties
            said = [{"seq": w[SEQ], "text": w[TEXT]} for w in words]
            self.out.append((self.n, words[0][T_MS], words[-1][STOP], speaker, len(words), said, self.late))


#: Groups that videos share in ``segment_stream``; what a call costs is paid for each group, not for each video.
GROUPS = 1024


def _segmenter(settle_ms: int) -> Callable[[tuple, Iterable[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """``Line`` for every video of a group: for its words in one batch, or for the time that it has been silent."""
    columns = [f.split(" ")[0] for f in SEGMENTS.split(", ")]

    def each(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lines = {vid: Line(*kept) for vid, *kept in json.loads(state.get[0])} if state.exists else {}
        now, heard, out = state.getCurrentWatermarkMs(), {}, []
        if not state.hasTimedOut:
            for part in parts:
                for vid, *w in zip(*(part[c].tolist() for c in ("vid", *HEARD))):
                    heard.setdefault(vid, []).append(w)
        for vid, words in heard.items():
            line = lines.setdefault(vid, Line())
            words.sort(key=itemgetter(SEQ))
            line.hear(words)
            line.wake = max(line.newest()[STOP] + (settle_ms if line.run else SEG.gap), now + 1)
            out += [(vid and int(vid), *row) for row in line.out]
        for vid in [vid for vid, line in lines.items() if line.wake < now]:
            line = lines[vid]
            if not line.run and not line.open:
                del lines[vid]
                continue
            # No word can come any more that joins what is open.
            line.release(embedded=True)
            line.finish()
            line.wake = now + settle_ms
            out += [(vid and int(vid), *row) for row in line.out]
        if lines:
            state.update((json.dumps([(vid, *line.kept()) for vid, line in lines.items()]),))
            state.setTimeoutTimestamp(max(int(min(line.wake for line in lines.values())), now + 1))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=columns)

    return each


def segment_stream(words: DataFrame, src: str = "he", tgt: str = "en", late: str = "1 second", settle_ms: int = 600_000, groups: int = GROUPS) -> DataFrame:
    """ST8: a stream of words (vid, seq, text, t_ms, end_ms, spk, brk, ts) as the segments of ``words.sessions``.

    ``ts`` is the event time that the watermark follows. A segment is given out by the word that starts the
    next one, or once the watermark is a pause past it; ``late`` counts the words of its video so far that came
    after a later one, which are left out. A run of under three target words that nothing follows for
    ``settle_ms`` counts as embedded, and a video that is silent for so long is forgotten. Whether a video has
    marks is known from the first mark on, so speaker changes before it count, unlike in a batch. Videos are
    kept by ``groups`` of a hash, each with one state, which is written anew when one of its videos is heard.
    """
    guess = F.col("t_ms") + F.least(F.lit(SEG.word_max), 100 + 60 * F.length("text"))
    ready = words.withWatermark("ts", late).select(
        F.pmod(F.xxhash64("vid"), F.lit(groups)).alias("group"), F.col("vid").cast("string").alias("vid"), "seq", "text", "t_ms",
        F.coalesce("end_ms", guess).cast("long").alias("stop"), "spk",
        F.coalesce("brk", F.lit(False)).alias("brk"), S.text_bucket(F.col("text"), src, tgt).cast("string").alias("bucket"),
        F.coalesce(F.col("text").rlike(SENTENCE_END), F.lit(False)).alias("ends"), "ts",
    )
    return ready.groupBy("group").applyInPandasWithState(_segmenter(settle_ms), SEGMENTS, "kept string", "Append", "EventTimeTimeout")


SENT = "sub string, seq long, kind string, n long, frame string"


class Buffer(StatefulProcessor):
    """The newest frames that a slow reader has not taken yet, and how many older ones were dropped."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getListState("pending", "seq long, frame string")
        self.dropped = handle.getValueState("dropped", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pending = [tuple(r) for r in self.pending.get()]
        dropped = self.dropped.get()[0] if self.dropped.exists() else 0
        out = []
        for part in [pd.concat(list(rows)).sort_values(["t", "seq"], kind="stable")]:
            for seq, frame, takes in zip(part["seq"], part["frame"], part["takes"], strict=True):
                if not takes:
                    pending.append((int(seq), frame))
                    if len(pending) > self.most:
                        pending.pop(0)
                        dropped += 1
                    continue
                taken, pending = pending[: int(takes)], pending[int(takes) :]
                if taken and dropped:
                    out.append((key[0], None, "dropped", dropped, None))
                    dropped = 0
                out += [(key[0], s, "frame", 1, f) for s, f in taken]
        self.pending.put(pending) if pending else self.pending.clear()
        self.dropped.update((int(dropped),))
        yield pd.DataFrame(out, columns=["sub", "seq", "kind", "n", "frame"])


def buffer_stream(offers: DataFrame, most: int = 2048) -> DataFrame:
    """ST3: a stream of offers (sub, t, seq, frame, takes) as what each subscriber is sent.

    A row with ``takes`` null offers a frame; of more than ``most`` frames that wait, the oldest go. A row with
    ``takes`` n is the reader taking up to n frames, oldest first; what was dropped since it last took is
    announced first, by a row of kind ``dropped`` with the number. Rows of a subscriber in one batch go by (t, seq).
    """
    ready = offers.select("sub", "t", "seq", "frame", F.coalesce("takes", F.lit(0)).cast("long").alias("takes"))
    return ready.groupBy("sub").transformWithStateInPandas(Buffer(most), SENT, "Append", "None")


LIVE = "sub string, kind string, seq long, t long, job long, stage string, status string"


class Subscriber(Kept):
    """What a subscriber is sent: its prelude once, then frames past the snapshot, and a heartbeat when idle."""

    empty = {"mark": None, "prelude": []}

    def __init__(self, heartbeat_ms: int):
        self.heartbeat = heartbeat_ms

    def handleInitialState(self, key, initialState, timerValues) -> None:
        kept = self.load()
        for row in initialState.to_dict("records"):
            kept["mark"] = int(row["mark"])
            kept["prelude"].append([int(row["seq"]), int(row["t"]), int(row["job"]), row["stage"], row["status"]])
        self.save(kept)
        self.wake(timerValues.getCurrentProcessingTimeInMs() + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = self.load()
        out = self.prelude(key, kept)
        frames = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for r in frames.itertuples(index=False):
            if kept["mark"] is None or r.seq > kept["mark"]:
                out.append((key[0], "frame", r.seq, r.t, r.job, r.stage, r.status))
        self.save(kept)
        self.wake(timerValues.getCurrentProcessingTimeInMs() + self.heartbeat)
        yield self.told(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept, now = self.load(), timerValues.getCurrentProcessingTimeInMs()
        out = self.prelude(key, kept) or [(key[0], "heartbeat", None, now, None, None, None)]
        self.save(kept)
        self.wake(now + self.heartbeat)
        yield self.told(out)

    def prelude(self, key, kept: dict) -> list:
        rows, kept["prelude"] = kept["prelude"], []
        return [(key[0], "prelude", *row) for row in rows]

    def told(self, out: list) -> pd.DataFrame:
        told = pd.DataFrame(out, columns=[f.split(" ")[0] for f in LIVE.split(", ")])
        return told.astype({c: "Int64" for c in ("seq", "t", "job")})


def snapshot(frames: DataFrame) -> DataFrame:
    """The state that a subscriber starts from: sub, mark, and the last frame of each of its jobs.

    ``mark`` is the largest seq of all frames that the snapshot has seen; the live stream goes on behind it.
    """
    last = frames.groupBy("sub", "job").agg(F.max_by(F.struct("seq", "t", "stage", "status"), "seq").alias("f"))
    marks = frames.groupBy("sub").agg(F.max("seq").alias("mark"))
    return last.join(marks, "sub").select("sub", "mark", "f.seq", "f.t", "job", "f.stage", "f.status")


def live_stream(frames: DataFrame, start: DataFrame, heartbeat_ms: int = 15_000) -> DataFrame:
    """ST4: a stream of frames (sub, seq, t, job, stage, status) for subscribers that start from ``snapshot``.

    The snapshot is the initial state of the stream, so both commit with its first batch: a restart neither
    loses nor repeats a frame between them. Frames that the snapshot has seen, by their seq, are not sent
    again. A subscriber without frames for ``heartbeat_ms`` is sent a heartbeat by a timer of its own.
    """
    ready = frames.select("sub", "seq", "t", "job", "stage", "status")
    return ready.groupBy("sub").transformWithStateInPandas(Subscriber(heartbeat_ms), LIVE, "Append", "ProcessingTime", start.groupBy("sub"))
