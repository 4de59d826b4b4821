"""Log questions and answers as the messages arrive.

A user message and the assistant message directly after it, in the order of ``turn`` and
whatever the gaps, are a pair. The messages of a conversation wait as keyed state, a row per turn:

* neighbours without a gap are paired as soon as both are there, in whichever batch and order;
* with a gap, a message may still come between them. They are paired by a timer, when the watermark
  has passed the later one and everything before it has arrived.

A paired message loses its text at once and stays as a mark until the watermark has passed it. An
open question waits for its answer until ``wait`` is over. So the state holds the messages
of the time ``wait``, and nothing after that.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from passageloom import schemas
from passageloom.functions.text import LOG_SOURCE_ZONE, LOG_TARGET_ZONE
from passageloom.operators.activity import activity_rows
from passageloom.sources.files import reserve_ids
from passageloom.streaming.state import state_store

_LOG = T.StructType([*schemas.ACTIVITY.fields, T.StructField("batch", T.LongType(), True)])
_EPOCH = dt.datetime(1970, 1, 1)

PAIRS = "conv_id long, turn long, question string, answer string, ts timestamp_ntz"


class PairTurns(StatefulProcessor):
    """Pairs of one conversation; ``wait`` in milliseconds."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # at: the message's instant in milliseconds; wall: its wall-clock time in microseconds; role null: paired already.
        self.waiting = handle.getMapState("waiting", "turn long", "role string, text string, at long, wall long")

    def _pair(self, conv: int, turn: int, question, turn2: int, answer) -> dict | None:
        if question[0] != "user" or answer[0] != "assistant" or not question[2] <= answer[2] <= question[2] + self.wait:
            return None
        self.waiting.updateValue((turn,), (None, None, *question[2:]))
        self.waiting.updateValue((turn2,), (None, None, *answer[2:]))
        said = _EPOCH + dt.timedelta(microseconds=answer[3])
        return {"conv_id": conv, "turn": turn, "question": question[1], "answer": answer[1], "ts": said}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (conv,) = key
        for batch in rows:
            found = []
            # One timer for all that came together: it fires when the last of them is behind the watermark.
            self.handle.registerTimer(int(batch["at"].max()))
            for turn, role, text, at, wall in zip(*(batch[c] for c in ("turn", "role", "text", "at", "wall"))):
                turn = int(turn)
                message = (role or "", text if role in ("user", "assistant") else None, int(at), int(wall))
                self.waiting.updateValue((turn,), message)
                if role == "user" and self.waiting.containsKey((turn + 1,)):
                    found.append(self._pair(conv, turn, message, turn + 1, self.waiting.getValue((turn + 1,))))
                elif role == "assistant" and self.waiting.containsKey((turn - 1,)):
                    found.append(self._pair(conv, turn - 1, self.waiting.getValue((turn - 1,)), turn, message))
            found = [pair for pair in found if pair]
            if found:
                yield pd.DataFrame(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Everything up to the watermark is there: pair what has a gap, and forget all but an open question at the end."""
        (conv,) = key
        passed = timerValues.getCurrentWatermarkInMs()
        messages = sorted((turn[0], tuple(value)) for turn, value in self.waiting.iterator())
        # Only a front part is complete: a message that is still to come may lie before a later turn.
        done = 0
        while done < len(messages) and messages[done][1][2] <= passed:
            done += 1
        found, last = [], None
        for turn, message in messages[:done]:
            if last is not None:
                pair = self._pair(conv, last[0], last[1], turn, message)
                if pair:
                    found.append(pair)
                    message = (None, None, *message[2:])
                self.waiting.removeKey((last[0],))
            last = turn, message
        if last is not None:
            over = last[1][2] + self.wait
            if last[1][0] == "user" and passed < over:
                self.handle.registerTimer(over)
            else:
                self.waiting.removeKey((last[0],))
        if found:
            yield pd.DataFrame(found)

    def close(self) -> None:
        pass


def _millis(wait: str) -> int:
    amount, unit = wait.split()
    return int(pd.Timedelta(int(amount), unit.rstrip("s")).total_seconds() * 1000)


def stream_pairs(messages: DataFrame, wait: str) -> DataFrame:
    """``(conv_id, turn, question, answer, ts)`` of a stream ``(conv_id, turn, role, text, ts)``.

    The pairs of ``pair_turns`` whose answer comes within ``wait`` of its question; ``wait`` is also how much
    later than others a message may arrive. Messages without an id, turn or time are left out.
    """
    # Event times are instants; the log's own times are wall-clock times.
    instant = F.col("ts").cast("timestamp")
    timed = messages.filter("conv_id is not null and turn is not null and ts is not null").select(
        "conv_id", "turn", "role", "text", instant.alias("_time"), F.unix_millis(instant).alias("at"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)").alias("wall"),
    ).withWatermark("_time", wait)
    return timed.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=PairTurns(_millis(wait)), outputStructType=PAIRS, outputMode="Append", timeMode="EventTime"
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The activity log with the number of the batch that wrote each row; appends beside the stream have negative ones."""
    return spark.read.schema(_LOG).parquet(path)


def activity_stream(
    messages: DataFrame,
    path: str,
    checkpoint: str,
    wait: str,
    every: str | None = None,
    src: str = LOG_SOURCE_ZONE,
    dst: str = LOG_TARGET_ZONE,
) -> StreamingQuery:
    """Start logging to ``path``: every ``every``, or everything available if None."""

    def log(batch: DataFrame, number: int) -> None:
        # A retried batch takes the same numbers again and overwrites itself.
        def start(count: int) -> int:
            return reserve_ids(batch.sparkSession, path, count, checkpoint, number)

        activity_rows(batch, src, dst, start).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream_pairs(messages, wait).writeStream.foreachBatch(log).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    with state_store(messages.sparkSession):
        return writer.start()
