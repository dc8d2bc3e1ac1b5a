"""Rules of presence, one by one, and a stream of several runs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pelagia.streaming import presence
from pelagia.streaming.presence import Clock, Rules

SCENES = {
    "a beat opens, silence closes": ([(10, "beat"), (190, "beat"), (400, "beat")], [(10, "open", None), (370, "closed", "stale"), (400, "open", None)]),
    "silence of just the stale time keeps it open": ([(10, "beat"), (190, "beat")], [(10, "open", None)]),
    "nothing but beats opens": ([(1, "tick"), (5, "leave"), (500, "tick")], []),
    "who left is gone after the grace": ([(10, "beat"), (20, "leave"), (40, "beat")], [(10, "open", None), (35, "closed", "left"), (40, "open", None)]),
    "a beat within the grace, as of a page that was loaded anew, keeps it open": ([(10, "beat"), (20, "leave"), (34, "beat"), (60, "beat")], [(10, "open", None)]),
    "ticks decide where there are any": ([(0, "tick"), (1, "beat"), *((t, "tick") for t in range(2, 190, 2))], [(1, "open", None), (182, "closed", "stale")]),
    "ticks close who left": ([(0, "tick"), (1, "beat"), (2, "tick"), (3, "leave"), *((t, "tick") for t in range(4, 40, 2))], [(1, "open", None), (20, "closed", "left")]),
    "a sleeping machine closes nobody": ([(0, "tick"), (1, "beat"), (2, "tick"), (5000, "tick"), (5002, "tick"), (5003, "beat")], [(1, "open", None)]),
    "after a sleep the stale time runs anew": ([(0, "tick"), (1, "beat"), (2, "tick"), *((t, "tick") for t in range(5000, 5200, 2))], [(1, "open", None), (5182, "closed", "stale")]),
    "after a sleep the grace runs anew": ([(0, "tick"), (1, "beat"), (2, "leave"), (2, "tick"), *((t, "tick") for t in range(5000, 5030, 2))], [(1, "open", None), (5016, "closed", "left")]),
}


@pytest.mark.parametrize("scene", SCENES)
def test_rules(scene):
    signals, expected = SCENES[scene]
    clock, found = Clock(), []
    for at, kind in signals:
        found.extend((ms // 1000, *rest) for ms, *rest in clock.hear(at * 1000, kind, Rules()))
    assert found == expected


def test_a_stream_shows_who_is_there_and_frees_its_state(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    at = lambda name: f"file://{tmp_path}/{name}"

    def arrive(name, rows):
        table = spark.createDataFrame([(c, start + dt.timedelta(seconds=s) if s is not None else None, k) for c, s, k in rows], "client string, at timestamp, kind string")
        table.coalesce(1).write.parquet(at(f"in/{name}"))

    def run():
        stream = spark.readStream.schema("client string, at timestamp, kind string").option("recursiveFileLookup", "true").parquet(at("in"))
        table = presence.appended(presence.changes(stream, "10 seconds"), at("table"), at("progress"))
        zero = int(start.timestamp())
        return sorted((r["client"], r["at_ms"] // 1000 - zero, r["state"], r["reason"]) for r in table.collect()), {r["client"]: r["state"] for r in presence.now(table).collect()}

    arrive("a", [("x", 5, "beat"), ("y", 8, "leave"), ("y", 2, "beat"), ("z", 100, "beat"), (None, 3, "beat"), ("x", None, "beat"), ("x", 4, "wave")])
    changes, now = run()
    assert changes == [("x", 5, "open", None), ("y", 2, "open", None), ("y", 23, "closed", "left"), ("z", 100, "open", None)]
    assert now == {"x": "open", "y": "closed", "z": "open"}
    arrive("b", [("z", 270, "beat"), ("y", 210, "beat")])
    changes, now = run()
    assert changes[1] == ("x", 185, "closed", "stale") and ("y", 210, "open", None) in changes
    assert now == {"x": "closed", "y": "open", "z": "open"}
    arrive("c", [("w", 3000, "beat")])
    changes, now = run()
    assert now == {"w": "open", "x": "closed", "y": "closed", "z": "closed"} and len(changes) == len(set(changes)) == 9
    arrive("d", [("w", 3100, "beat")])
    assert run()[1]["w"] == "open"
