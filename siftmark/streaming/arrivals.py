"""Arrivals as streams: listings of a folder in, complete and new files out; jobs that lost their owner.

A listing row is (vuelta, poll, ruta, tamano, mtime, incompleto): vuelta numbers the polls without gaps. State of a path is a value for the
present run (what was last seen, at which poll, how often in a row, how often it was put off), and a map with a row for every
identity (size and time) that was served. A poll that misses the path ends the run: its value is cleared by a timer once the
watermark has passed, or by the next listing, whichever comes first. Identities are remembered for good, so a file
that changes and changes back isn't served twice; serving one writes one row, whatever was served before.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

OUT = "ruta string, poll timestamp, tamano long, mtime timestamp, estado string"
RUN = "tamano long, mtime long, vuelta long, vistos int, pospuesto int, reloj long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(t: pd.Timestamp) -> int:
    return t.value // 1000


class Arrivals(StatefulProcessor):
    def __init__(self, polls: int, patience: int):
        self.polls, self.patience = polls, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", RUN)
        self.served = handle.getMapState("served", "tamano long, mtime long", "vuelta long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        out, now = [], self.run.get() if self.run.exists() else None
        before = now[5] if now else None
        listed = pd.concat(list(rows)).sort_values(["vuelta", "mtime", "tamano"]).drop_duplicates("vuelta", keep="last")
        for r in listed.itertuples():
            size, mtime = int(r.tamano), _micros(r.mtime)
            if now is not None and r.vuelta <= now[2]:  # late, or listed before
                continue
            same = now is not None and r.vuelta == now[2] + 1 and now[:2] == (size, mtime)
            seen, late = (now[3] + 1, now[4]) if same else (1, 0)
            if seen >= self.polls and not self.served.containsKey((size, mtime)):
                if r.incompleto and late < self.patience:
                    late += 1
                else:
                    self.served.updateValue((size, mtime), (int(r.vuelta),))
                    out.append((key[0], r.poll, size, r.mtime, "desistido" if r.incompleto else "servido"))
            now = (size, mtime, int(r.vuelta), seen, late, r.poll.value // 1_000_000 + 1)
        if now is not None and now[5] != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(now[5])
            self.run.update(now)
        yield pd.DataFrame(out, columns=["ruta", "poll", "tamano", "mtime", "estado"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A later poll has come, and the path wasn't in it."""
        if self.run.exists() and self.run.get()[5] <= expiredTimerInfo.getExpiryTimeInMs():
            self.run.clear()
        yield pd.DataFrame([], columns=["ruta", "poll", "tamano", "mtime", "estado"])


def mature(listings: DataFrame, polls: int = 2, patience: int = 3, delay: str = "10 seconds") -> DataFrame:
    """A stream of (ruta, poll, tamano, mtime, estado): each identity once, when it has been listed `polls` times in a row
    unchanged. An incomplete file is put off up to `patience` times, then given up and served as desistido.

    listings: a stream of (vuelta, poll, ruta, tamano, mtime, incompleto). A poll that misses the path, by its number, begins the count
    anew, as in the batch twin. delay: event time by which rows of a poll may come after those of a later one; what is
    later, or belongs to a poll of the path that was seen already, is passed over. Of rows of one path and
    poll in one micro-batch the latest by mtime, then the largest, counts.
    """
    spark = listings.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = listings.select("vuelta", "poll", "ruta", "tamano", "mtime", "incompleto").withWatermark("poll", delay)
    return rows.groupBy("ruta").transformWithStateInPandas(Arrivals(polls, patience), OUT, "append", "EventTime")


def unless_existing(served: DataFrame, outputs: DataFrame) -> DataFrame:
    """served (a stream) with accion: omitido where the output exists already (a static table), else servido."""
    return served.join(outputs.select("ruta", F.lit(True).alias("_e")).distinct(), "ruta", "left").withColumn("accion", F.when(F.col("_e"), "omitido").otherwise("servido")).drop("_e")


def orphans(heartbeats: DataFrame, delay: str = "10 minutes", patience_ms: int = 3_600_000) -> DataFrame:
    """A stream of (job, ts, estado): jobs still working when no heartbeat (job, ts, estado) came for patience_ms of event
    time are closed as failed. Late heartbeats beyond the delay are dropped by the watermark."""

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame([(key[0], pd.Timestamp(last, unit="ms"), "failed")], columns=["job", "ts", "estado"])
            return
        rows = pd.concat(list(batches)).sort_values("ts")
        last, word = int(rows["ts"].iloc[-1].timestamp() * 1000), rows["estado"].iloc[-1]
        if state.exists and state.get[0] > last:
            return
        if word == "working":
            state.update((last,))
            state.setTimeoutTimestamp(max(last + patience_ms, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    beats = heartbeats.withWatermark("ts", delay)
    return beats.groupBy("job").applyInPandasWithState(work, "job long, ts timestamp, estado string", "ultimo long", "append", GroupStateTimeout.EventTimeTimeout)
