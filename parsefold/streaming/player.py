"""The playback state machine: one ordered log of commands and callbacks for each
session, in batch or as a stream.

A log row is (session_key, seq, command, number, text, epoch): number is the count of
texts to load, the place to seek, or the rate; text the voice or an error code; epoch
the fence that a callback carries. Every cancel raises the epoch, and a callback of an
older epoch changes nothing, as a late event.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parsefold.functions import fixed_values as v
from parsefold.functions.shipping import ship

LOG = "session_key string, seq long, command string, number double, text string, epoch long"
OUTPUT = "session_key string, seq long, step int, index int, status string, epoch long, said int, message string"
STATE = "epoch long, count int, index int, status string, rate double, voice string"
COMMANDS = ("load", "configure", "play", "pause", "stop", "seek", "end", "error", "fail", "destroy")


@dataclass
class Player:
    """State between log rows. apply() returns what is emitted: (index, status, said,
    message), said being the place handed to the voice, if any."""

    epoch: int = 0
    count: int = 0
    index: int = 0
    status: str = "idle"
    rate: float = 1.0
    voice: str | None = None

    def _emit(self, said: bool = False, message: str | None = None) -> list[tuple]:
        return [(self.index, self.status, self.index if said else None, message)]

    def _play(self) -> list[tuple]:
        if not self.count:
            return []
        if self.status == "ended":
            self.index = 0
        self.epoch += 1
        self.status = "playing"
        return self._emit(said=True)

    def apply(self, command: str, number: float | None = None, text: str | None = None, epoch: int | None = None) -> list[tuple]:
        if command in ("end", "error"):
            if epoch != self.epoch:
                return []  # late
            if command == "error":
                return self._stop(message=v.ERROR_NOT_ALLOWED if text == "not-allowed" else v.ERROR_VOICE)
            if self.status != "playing":
                return []
            if self.index + 1 < self.count:
                self.index += 1
                return self._emit(said=True)
            self.status = "ended"
            return self._emit()
        if command == "play":
            return self._play()
        if command == "configure":
            again = self.status == "playing"
            self.epoch += 1
            self.rate, self.voice = 1.0 if number is None else float(number), text
            return self._play() if again else []
        if command == "fail":
            return self._stop(message=v.ERROR_START)
        if command == "pause":
            return self._stop()
        self.epoch += 1
        if command == "destroy":
            return []
        if command == "seek":
            at = math.floor((number or 0) + 0.5)
            self.index = max(0, min(self.count - 1, at))
            if self.status == "playing":
                return self._emit(said=True)
            self.status = "paused"
            return self._emit()
        if command == "load":
            self.count = int(number or 0)
        elif command != "stop":
            raise ValueError(f"unknown command: {command}")
        self.index, self.status = 0, "idle"
        return self._emit()

    def _stop(self, message: str | None = None) -> list[tuple]:
        self.epoch += 1
        self.status = "paused"
        return self._emit(message=message)


def _played(player: Player, key: str, log: pd.DataFrame) -> pd.DataFrame:
    rows = []
    null = lambda x: None if x is None or x != x else x
    for r in log.sort_values("seq", kind="stable").itertuples(index=False):
        epoch = null(r.epoch)
        for step, (index, status, said, message) in enumerate(player.apply(r.command, null(r.number), null(r.text), None if epoch is None else int(epoch))):
            rows.append((key, r.seq, step, index, status, player.epoch, said, message))
    out = pd.DataFrame(rows, columns=["session_key", "seq", "step", "index", "status", "epoch", "said", "message"])
    return out.astype({"said": "Int32"})


#: Rows that a task hands on at once.
_ROWS = 4096


def _emitted(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["session_key", "seq", "step", "index", "status", "epoch", "said", "message"])


def play_log(log: DataFrame) -> DataFrame:
    """What each session emits, from its whole log in order of seq (of rows with one seq, in
    order of their other columns). A session's rows meet in one task, sorted, and are played
    as they come: neither a log nor what it emits is ever held as a whole. Rows without a
    session key are a session of their own; an empty log emits nothing."""
    ship(log.sparkSession)
    columns = ["session_key", "seq", "command", "number", "text", "epoch"]

    def played(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        player, current, out = Player(), (), []
        for part in parts:
            for key, seq, command, number, text, epoch in zip(*(c.to_pylist() for c in part.columns)):
                if current != (key,):
                    player, current = Player(), (key,)
                for step, (index, status, said, message) in enumerate(player.apply(command, number, text, epoch)):
                    out.append((key, seq, step, index, status, player.epoch, said, message))
                if len(out) >= _ROWS:
                    yield _emitted(out)
                    out = []
        if out:
            yield _emitted(out)

    rows = log.select(F.col("session_key").cast("string").alias("session_key"), F.col("seq").cast("long").alias("seq"), "command", F.col("number").cast("double").alias("number"), "text", F.col("epoch").cast("long").alias("epoch"))
    return rows.repartition("session_key").sortWithinPartitions(*columns).mapInArrow(played, OUTPUT)


def play_stream(log: DataFrame) -> DataFrame:
    """The same for a streaming log: a session's state is kept between batches; inside a
    batch its rows are taken in order of seq."""
    ship(log.sparkSession)

    def one(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        player = Player(*state.get) if state.exists else Player()
        rows = pd.concat(list(parts))
        yield _played(player, key[0], rows)
        state.update((player.epoch, player.count, player.index, player.status, player.rate, player.voice))

    return log.groupBy("session_key").applyInPandasWithState(one, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def page_follow(emitted: DataFrame, queue: DataFrame) -> DataFrame:
    """The page to show for each emission while playing: that of the queue's passage."""
    playing = emitted.where(F.col("status") == "playing")
    return playing.join(queue.select("session_key", F.col("queue_index").alias("index"), "page"), ["session_key", "index"]).select("session_key", "seq", "step", "page")
