"""Playback sessions as a stream with state of their own: timers end what nobody ends.

The player's state lives in a state store between batches and between runs; callbacks of an
older epoch change nothing, in whatever batch they arrive. A session in which nothing
happens for `idle` of event time has expired: it says so once, and its state is dropped, by
a timer that the watermark sets off or by the next row, whichever comes first. Both give the
same rows, so what is emitted does not depend on how the log is cut into batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parsefold.functions.shipping import ship
from parsefold.streaming.player import OUTPUT, STATE, Player

LOG_COLUMNS = ("session_key", "seq", "command", "number", "text", "epoch", "at")
HELD = f"{STATE}, last long, seq long, ended boolean"
#: What of a log's row the player reads, held in one column: each value of each row is made a
#: Python object by a call of its own, which costs more than to play it.
ENTRY = ("at", "seq", "command", "number", "text", "epoch")
EMITTED = Row("session_key", "seq", "step", "index", "status", "epoch", "said", "message")
EXPIRED = "expired"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Sessions(StatefulProcessor):
    """One player for each session."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("player", HELD)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        name, player, last, seq, ended = key[0], Player(), None, None, False
        if self.held.exists():
            *state, last, seq, ended = self.held.get()
            player = Player(*state)
        before = last
        for at, n, command, number, text, epoch in sorted(map(_entry, rows), key=lambda e: e[:2]):
            if last is not None and at - last > self.idle_ms:
                yield from self._expired(name, player, seq, ended)
                player, ended = Player(), False
            last, seq = at, n
            ended = command == "destroy" or (ended and command in ("end", "error"))
            for step, (index, status, said, message) in enumerate(player.apply(command, number, text, epoch)):
                yield EMITTED(name, seq, step, index, status, player.epoch, said, message)
        self.held.update((player.epoch, player.count, player.index, player.status, player.rate, player.voice, last, seq, ended))
        if before != last:
            if before is not None:
                self.handle.deleteTimer(self._due(before))
            self.handle.registerTimer(self._due(last))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.held.exists():
            *state, last, seq, ended = self.held.get()
            if self._due(last) > timerValues.getCurrentWatermarkInMs():
                # Set by a run with a shorter `idle`.
                self.handle.registerTimer(self._due(last))
                return
            yield from self._expired(key[0], Player(*state), seq, ended)
            self.held.clear()

    def _due(self, last: int) -> int:
        """When the timer of a session goes off whose last row is of this time."""
        return last + self.idle_ms + 1

    @staticmethod
    def _expired(name: str, player: Player, seq: int, ended: bool) -> Iterator[Row]:
        """What an idle session says; nothing if it was destroyed."""
        if not ended:
            yield EMITTED(name, seq, -1, player.index, EXPIRED, player.epoch, None, None)

    def close(self) -> None:
        pass


def _entry(row: Row) -> tuple:
    held = json.loads(row[-1])
    number = held.get("number")
    # JSON has no numbers that are not finite: they are texts in it.
    return (held.get("at"), held.get("seq"), held.get("command"), float(number) if isinstance(number, str) else number, held.get("text"), held.get("epoch"))


def play_sessions(log: DataFrame, idle: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """What the sessions of a streaming log emit. The log has the columns of the player's and
    `ts`, a timestamp; rows later than `delay` behind the latest are dropped by the watermark.
    Rows of a session are taken in order of ts and seq inside a batch. An expired session has
    a row of status `expired` at its last seq, step -1, unless it was destroyed; what comes
    after finds a new player, to which no earlier callback belongs."""
    spark = log.sparkSession
    ship(spark)
    ms = spark.sql(f"SELECT CAST(1000 * (unix_micros(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {idle}) DIV 1000000) AS BIGINT)").first()[0]
    entry = F.to_json(F.struct(*[F.col(c) for c in ENTRY]), {"ignoreNullFields": "true"})
    marked = log.withWatermark("ts", delay).withColumn("at", F.unix_millis("ts")).select("session_key", "ts", entry.alias("entry"))
    return marked.groupBy("session_key").transformWithState(Sessions(ms), OUTPUT, "append", "EventTime")


def run_available(emitted: DataFrame, path: str, checkpoint: str) -> None:
    """Play what is there and stop; what is played is appended to path as Parquet. State and
    progress stay under checkpoint for the next run."""
    spark: SparkSession = emitted.sparkSession
    conf, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(conf, PROVIDER)
    try:
        running = emitted.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        running.awaitTermination()
    finally:
        spark.conf.set(conf, before)
