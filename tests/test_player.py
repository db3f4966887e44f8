"""The playback state machine, in memory, in batch and as a stream; cancellable tasks."""

import time

import pytest

from parsefold.functions import fixed_values as v
from parsefold.streaming.player import LOG, Player, play_log, play_stream
from parsefold.streaming.tasks import Cancelled, Signal, abortable, reporter


def loaded(n=3):
    p = Player()
    assert p.apply("load", n) == [(0, "idle", None, None)]
    return p


def test_pause_repeats_and_late_callbacks_change_nothing():
    p = loaded()
    assert p.apply("play") == [(0, "playing", 0, None)]
    old = p.epoch
    assert p.apply("pause") == [(0, "paused", None, None)]
    assert p.apply("end", epoch=old) == []
    assert p.apply("play") == [(0, "playing", 0, None)]
    now = p.epoch
    p.apply("stop")
    assert p.apply("end", epoch=now) == [] and (p.index, p.status) == (0, "idle")


def test_seek_and_natural_end():
    p = loaded()
    p.apply("play")
    assert p.apply("seek", 2) == [(2, "playing", 2, None)]
    assert p.apply("end", epoch=p.epoch) == [(2, "ended", None, None)]
    assert p.apply("play") == [(0, "playing", 0, None)]
    assert p.apply("seek", 99) == [(2, "playing", 2, None)] and p.apply("seek", -3) == [(0, "playing", 0, None)]
    p.apply("stop")
    assert p.apply("seek", 1.5) == [(2, "paused", None, None)]


def test_configure_restarts_only_what_plays():
    p = loaded()
    assert p.apply("configure", 1.5, "a") == []
    p.apply("play")
    old = p.epoch
    assert p.apply("configure", 2.0, "b") == [(0, "playing", 0, None)] and p.apply("end", epoch=old) == []
    assert (p.rate, p.voice) == (2.0, "b")


def test_errors_pause_with_a_message():
    p = loaded()
    p.apply("play")
    assert p.apply("error", text="not-allowed", epoch=p.epoch) == [(0, "paused", None, v.ERROR_NOT_ALLOWED)]
    p.apply("play")
    assert p.apply("error", text="network", epoch=p.epoch) == [(0, "paused", None, v.ERROR_VOICE)]
    assert p.apply("fail") == [(0, "paused", None, v.ERROR_START)]
    assert p.apply("destroy") == [] and Player().apply("play") == []
    with pytest.raises(ValueError):
        p.apply("dance")


ROWS = [("a", 0, "load", 2.0, None, None), ("a", 1, "play", None, None, None), ("a", 2, "end", None, None, 2), ("a", 3, "end", None, None, 2), ("b", 0, "load", 1.0, None, None), ("b", 1, "play", None, None, None), ("b", 2, "end", None, None, 1)]
WANT = [("a", 0, 0, "idle"), ("a", 1, 0, "playing"), ("a", 2, 1, "playing"), ("a", 3, 1, "ended"), ("b", 0, 0, "idle"), ("b", 1, 0, "playing")]


def told(df):
    return sorted((r.session_key, r.seq, r["index"], r.status) for r in df.collect())


def test_batch(spark):
    assert told(play_log(spark.createDataFrame(ROWS, LOG))) == WANT


def test_stream_keeps_state_between_batches(spark, tmp_path):
    for n in range(2):
        part = [r for r in ROWS if (r[1] >= 2) == bool(n)]
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = play_stream(stream).writeStream.format("memory").queryName("played").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert told(spark.table("played")) == WANT


def test_tasks_end_by_value_error_signal_or_time():
    assert abortable(lambda: 3, Signal()) == 3
    with pytest.raises(ZeroDivisionError):
        abortable(lambda: 1 / 0, Signal())
    with pytest.raises(TimeoutError, match="too long"):
        abortable(lambda: time.sleep(5), Signal(), 20)
    s = Signal()
    s.abort()
    with pytest.raises(Cancelled):
        abortable(lambda: time.sleep(5), s)
    s = Signal()
    import threading

    threading.Timer(0.05, s.abort).start()
    with pytest.raises(Cancelled):
        abortable(lambda: time.sleep(5), s)
    seen = []
    tell = reporter(s, lambda m, p: seen.append((m, p)))
    tell("late", 3)
    assert seen == []


def test_a_long_log_and_rows_without_a_session(spark):
    """Sessions longer than a batch of rows, one of them without a key, in no order."""
    import random

    draw = random.Random(2)
    rows = [(draw.choice(["long", "long", None, "a"]), n, draw.choice(["load", "play", "end", "seek", "pause", "error"]), float(draw.randrange(6)), None, draw.randrange(4) + n // 9) for n in range(30_000)]
    got = play_log(spark.createDataFrame(rows, LOG).repartition(5)).collect()
    want = []
    for key in ("long", None, "a"):
        player = Player()
        for _, seq, command, number, text, epoch in (r for r in rows if r[0] == key):
            want += [(key, seq, step, i, s, player.epoch, said, m) for step, (i, s, said, m) in enumerate(player.apply(command, number, text, epoch))]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want)) and len(want) > 10_000
    assert play_log(spark.createDataFrame([], LOG)).count() == 0
