"""Who is there: a state machine over the signals of clients, in event time.

Signals are (client, at timestamp, kind): beat says that the client is there, leave that it is going, tick is
the clock of the machine that it runs on. Ticks that are further apart than ticks can be mean that the machine slept, so
silence in between says nothing of the client.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ORDER = {"beat": 0, "leave": 1, "tick": 2}


@dataclass(frozen=True)
class Rules:
    """Milliseconds: silence until a client counts as lost, grace after it left, the longest step between two ticks of a
    machine that was awake, how long a closed client is remembered, and a machine that sends no tick any more."""

    stale: int = 180_000
    grace: int = 15_000
    awake: int = 12_000
    remembered: int = 600_000
    asleep: int = 86_400_000


@dataclass
class Clock:
    """What is known of a client; -1 is never."""

    open: int = 0
    seen: int = -1
    gone: int = -1
    tick: int = -1
    closed: int = -1

    def end(self, rules: Rules) -> tuple[int, str]:
        """When an open client closes if nothing more is heard of it, and why."""
        stale = self.seen + rules.stale
        left = self.gone + rules.grace if self.gone >= 0 else stale
        return (left, "left") if left < stale else (stale, "stale")

    def close(self, at: int) -> None:
        self.open, self.gone, self.closed = 0, -1, at

    def hear(self, at: int, kind: str, rules: Rules) -> Iterator[tuple[int, str, str | None]]:
        """Takes one signal; gives changes (at, state, reason)."""
        if kind == "tick":
            if at <= self.tick:
                return
            slept, self.tick = self.tick >= 0 and at - self.tick > rules.awake, at
            if self.open and slept:
                self.seen, self.gone = max(self.seen, at), at if self.gone >= 0 else -1
            elif self.open and at > self.end(rules)[0]:
                reason = self.end(rules)[1]
                self.close(at)
                yield at, "closed", reason
            return
        if self.open and self.tick < 0 and at > self.end(rules)[0]:  # no clock: silence alone decides
            end, reason = self.end(rules)
            self.close(end)
            yield end, "closed", reason
        if kind == "leave":
            if self.open and at >= self.seen:
                self.gone = max(self.gone, at)
        elif at > self.closed:
            if not self.open:
                yield at, "open", None
            self.open, self.seen = 1, max(self.seen, at)
            self.gone = self.gone if self.gone > at else -1

    def timer(self, rules: Rules) -> int:
        """When to look at the client again without a signal."""
        if not self.open:
            return max(self.closed, self.seen, self.tick) + rules.remembered
        return self.end(rules)[0] if self.tick < 0 else max(self.tick, self.seen) + rules.asleep


def changes(signals: DataFrame, lateness: str = "30 seconds", rules: Rules | None = None) -> DataFrame:
    """(client, at_ms, state open or closed, reason left, stale, asleep or null) whenever a client comes or goes.

    A client is open from its first beat on. It closes when it left and nothing was heard for the grace, or when nothing
    was heard for the stale time. Where its machine ticks, ticks decide, and the first one after a sleep starts both times
    anew; a machine that sends none for the asleep time is given up. Without ticks event time decides. Signals of a
    batch are taken in order of time; those later than the watermark are dropped; an unknown kind and a null client or
    time are left out. The state of closed clients is freed once they need not be remembered.
    """
    rules = rules or Rules()

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clock, found = Clock(*state.get) if state.exists else Clock(), []
        if state.hasTimedOut:
            if not clock.open:
                state.remove()
                return
            end, reason = clock.end(rules) if clock.tick < 0 else (clock.timer(rules), "asleep")
            clock.close(end)
            found.append((end, "closed", reason))
        else:
            heard = sorted((int(ms), ORDER[kind], kind) for batch in batches for ms, kind in zip(batch["ms"], batch["kind"], strict=True))
            for ms, _, kind in heard:
                found.extend(clock.hear(ms, kind, rules))
        state.update((clock.open, clock.seen, clock.gone, clock.tick, clock.closed))
        state.setTimeoutTimestamp(max(clock.timer(rules), state.getCurrentWatermarkMs()) + 1)
        if found:
            yield pd.DataFrame([(key[0], *row) for row in found], columns=["client", "at_ms", "state", "reason"])

    known = signals.where(F.col("client").isNotNull() & F.col("at").isNotNull() & F.col("kind").isin(*ORDER))
    timed = known.select(F.col("client").cast("string").alias("client"), F.col("at").cast("timestamp").alias("at"), "kind").withWatermark("at", lateness)
    rows = timed.withColumn("ms", F.unix_millis("at"))
    return rows.groupBy("client").applyInPandasWithState(decide, "client string, at_ms long, state string, reason string", "open int, seen long, gone long, tick long, closed long", "append", GroupStateTimeout.EventTimeTimeout)


def appended(stream: DataFrame, table: str, progress: str) -> DataFrame:
    """Appends what a stream gives, each row once, to a table that outlives the query, and returns the table."""
    stream.writeStream.format("parquet").outputMode("append").option("path", table).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(table)


def now(transitions: DataFrame) -> DataFrame:
    """(client, state, since_ms, reason): the last change of each client."""
    last = F.max_by(F.struct("state", F.col("at_ms").alias("since_ms"), "reason"), F.struct("at_ms", F.col("state") == "closed"))
    return transitions.groupBy("client").agg(last.alias("last")).select("client", "last.*")
