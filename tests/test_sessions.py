"""Streamed sessions against the player in memory: any cut into batches gives the same rows."""

import json
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from parsefold.functions import fixed_values as v
from parsefold.streaming import sessions
from parsefold.streaming.player import Player

KIND = "session_key string, seq long, command string, number double, text string, epoch long, ts timestamp"
MINUTE = 60


def plain(rows, idle, watermark):
    """What a log of all sessions emits, in order of time, with sessions that expire."""
    out = []
    for key in {r[0] for r in rows}:
        player, last, seq, ended = Player(), None, None, False

        def expire():
            if not ended:
                out.append((key, seq, -1, player.index, "expired", player.epoch, None, None))

        for _, n, command, number, text, epoch, at in sorted((r for r in rows if r[0] == key), key=lambda r: r[6]):
            if last is not None and at - last > idle:
                expire()
                player, ended = Player(), False
            last, seq = at, n
            ended = command == "destroy" or (ended and command in ("end", "error"))
            out += [(key, n, step, i, s, player.epoch, said, m) for step, (i, s, said, m) in enumerate(player.apply(command, number, text, epoch))]
        if last is not None and last + idle < watermark:
            expire()
    return sorted(out, key=repr)


def made(seed, n=160):
    draw, at, rows = random.Random(seed), 0, []
    for seq in range(n):
        at += draw.choice([5, 30, 90, 20 * MINUTE])
        command = draw.choice(["load", "load", "play", "play", "end", "end", "end", "error", "pause", "seek", "configure", "destroy", "stop"])
        rows.append((draw.choice("abcd"), seq, command, float(draw.randrange(1, 5)), draw.choice([None, "not-allowed"]), draw.choice([None, 0, 1, 2, 3, 4]), at))
    return rows


def test_batches_and_runs_make_no_difference(spark, tmp_path):
    rows, idle, delay = made(2), 45 * MINUTE, 10 * MINUTE
    base = str(tmp_path)
    table = spark.createDataFrame([(*r[:6], None) for r in rows], KIND).drop("ts").join(spark.createDataFrame([(r[1], r[6]) for r in rows], "seq long, at long"), "seq").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    for low, high in ((0, 50), (50, 51), (51, 160)):
        table.where((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(2).write.mode("append").parquet(f"{base}/log")
        stream = spark.readStream.schema(table.schema).parquet(f"{base}/log")
        sessions.run_available(sessions.play_sessions(stream, "45 minutes", "10 minutes"), f"{base}/out", f"{base}/state")
    got = sorted((tuple(r) for r in spark.read.parquet(f"{base}/out").select("session_key", "seq", "step", "index", "status", "epoch", "said", "message").collect()), key=repr)
    want = plain(rows, idle, max(r[6] for r in rows) - delay)
    assert got == want
    assert sum(r[2] == -1 for r in want) > 3 and {r[7] for r in want} >= {v.ERROR_VOICE, v.ERROR_NOT_ALLOWED}
    # A run without new rows emits nothing more.
    sessions.run_available(sessions.play_sessions(spark.readStream.schema(table.schema).parquet(f"{base}/log"), "45 minutes", "10 minutes"), f"{base}/out", f"{base}/state")
    assert spark.read.parquet(f"{base}/out").count() == len(want)


class Held:
    """A session's state and timers, which counts what is asked of them."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, kind):
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):
        return self.watermark


def row(**entry):
    return Row(session_key="a", ts=None, entry=json.dumps(entry))


def test_a_session_s_timer_is_moved_without_listing_timers():
    held = Held()
    one = sessions.Sessions(1000)
    one.init(held)
    list(one.handleInputRows(("a",), iter([row(at=7, seq=1, command="load", number=3.0), row(at=5, seq=0, command="stop")]), None))
    assert held.timers == {1008} and held.calls == 3
    list(one.handleInputRows(("a",), iter([row(at=9, seq=2, command="configure", number="NaN", text="v")]), None))
    assert held.timers == {1010} and held.calls == 8
    assert held.value[4] != held.value[4] and held.value[5:8] == ("v", 9, 2)
    # A timer of a run with a shorter idle time: the session has not expired yet.
    held.watermark = 1009
    assert list(one.handleExpiredTimer(("a",), held, None)) == [] and held.timers == {1010} and held.value
    held.watermark = 1010
    assert [r.status for r in one.handleExpiredTimer(("a",), held, None)] == ["expired"] and held.value is None
