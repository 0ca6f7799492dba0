"""Event-time windows, sessions, latest-per-key and a stateful limiter on streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events(spark: SparkSession, path: str, schema, files: int = 4) -> DataFrame:
    """A file stream of events with a timestamp column ``ts``."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(df: DataFrame, size: str, late: str, keys: list[str]) -> DataFrame:
    w = F.window("ts", size)
    return df.withWatermark("ts", late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sliding(df: DataFrame, size: str, slide: str, late: str, keys: list[str]) -> DataFrame:
    w = F.window("ts", size, slide)
    return df.withWatermark("ts", late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(df: DataFrame, gap: str, late: str, key: str) -> DataFrame:
    w = F.session_window("ts", gap)
    return df.withWatermark("ts", late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def latest(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The value of the greatest ``order`` of each key, in update mode."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct("ts", order)).alias(value), F.max("ts").alias("ts"))


LATE_SCHEMA = "key {kind}, kind string, start timestamp, n long, total double, arrival long, ts timestamp"


def with_late(df: DataFrame, key: str, size: int, delay: int) -> DataFrame:
    """(key, kind, start, n, total, arrival, ts): closed windows of ``size`` seconds (kind 'window'), and as a side output the rows that came too late for theirs ('late').

    ``df`` is a stream of (key, ts, arrival, value). A key's clock is the greatest
    ``ts`` among its earlier arrivals, less ``delay`` seconds; a window closes,
    and is told once, when the clock reaches its end. So what is late depends on
    the order of arrival alone, not on where batches end. State is the clock and
    the open windows of a key; a key that falls silent keeps them open.
    """

    def step(name, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clock, held = json.loads(state.get[0]) if state.exists else (None, {})
        held = {int(k): v for k, v in held.items()}
        rows = pd.concat(list(batches)).sort_values("arrival")
        out = []
        for at, arrival, value in zip(rows["ts"].astype("datetime64[us]").astype("int64"), rows["arrival"], rows["value"]):
            start = at - at % (size * 10**6)
            if clock is not None and start + size * 10**6 <= clock - delay * 10**6:
                out.append((name[0], "late", None, None, None, arrival, at))
            else:
                n, total = held.get(start, (0, 0.0))
                held[start] = (n + 1, total + float(value))
                clock = at if clock is None else max(clock, at)
            for done in sorted(k for k in held if k + size * 10**6 <= clock - delay * 10**6):
                n, total = held.pop(done)
                out.append((name[0], "window", done, n, total, None, None))
        state.update((json.dumps([clock, held]),))
        found = pd.DataFrame(out, columns=["key", "kind", "start", "n", "total", "arrival", "ts"])
        for c in ("start", "ts"):
            found[c] = pd.to_datetime(found[c].astype("Int64"), unit="us")
        yield found.astype({"n": "Int64", "arrival": "Int64"})

    rows = df.select(F.col(key).alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("arrival").cast("long").alias("arrival"), F.col("value").cast("double").alias("value"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").applyInPandasWithState(step, LATE_SCHEMA.format(kind=kind), "held string", "append", GroupStateTimeout.NoTimeout)


def with_late_batch(df: DataFrame, key: str, size: int, delay: int) -> DataFrame:
    """What ``with_late`` tells of all rows, as a batch."""
    before = Window.partitionBy("key").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    rows = df.select(F.col(key).alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "arrival", F.col("value").cast("double").alias("value"))
    long, wait = size * 10**6, delay * 10**6
    # a late row is behind the clock, so it never moves it
    told = rows.withColumn("start", F.col("at") - F.pmod("at", F.lit(long))).withColumn("clock", F.max("at").over(before) - wait)
    told = told.withColumn("late", F.coalesce(F.col("start") + long <= F.col("clock"), F.lit(False)))
    none = lambda t: F.lit(None).cast(t)
    late = told.where("late").select("key", F.lit("late").alias("kind"), none("timestamp").alias("start"), none("long").alias("n"), none("double").alias("total"), "arrival", F.timestamp_micros("at").alias("ts"))
    last = told.groupBy("key").agg((F.max("at") - wait).alias("last"))
    held = told.where("not late").groupBy("key", "start").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).join(last, "key").where(F.col("start") + long <= F.col("last"))
    return held.select("key", F.lit("window").alias("kind"), F.timestamp_micros("start").alias("start"), "n", "total", none("long").alias("arrival"), none("timestamp").alias("ts")).union(late)


#: Hits and seconds: 20 in a minute, 8 in ten seconds.
LIMITS = ((20, 60.0), (8, 10.0))


def admit(times: list[float], t: float, limits=LIMITS) -> bool:
    """Whether a hit at ``t`` is accepted, given the accepted hits before; drops those past all limits from ``times`` and adds ``t`` if so."""
    longest = max(s for _, s in limits)
    times[:] = [x for x in times if t - x < longest]
    if any(sum(t - x < s for x in times) >= n for n, s in limits):
        return False
    times.append(t)
    return True


class Limiter(StatefulProcessor):
    """Keeps the accepted hits of a key; rejected ones leave no trace."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getValueState("accepted", "times array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        times = list(self.accepted.get()[0]) if self.accepted.exists() else []
        hits = pd.concat(list(rows)).sort_values(["t", "event_id"])
        ok = [admit(times, float(t)) for t in hits["t"]]
        self.accepted.update((times,))
        yield pd.DataFrame({"key": key[0], "event_id": hits["event_id"].to_numpy(), "accepted": ok})

    def close(self) -> None:
        pass


def rate_limit(df: DataFrame, key: str) -> DataFrame:
    """(key, event_id, accepted) in batch: each key's hits pass in order, in Arrow batches sorted by Spark, with only the accepted times held."""
    rows = df.select(F.col(key).alias("key"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[str, list[float]] = {}
        last = None
        for b in batches:
            ok = []
            for k, t in zip(b["key"], b["t"]):
                if k != last:
                    state, last = {k: []}, k
                ok.append(admit(state[k], float(t)))
            yield pd.DataFrame({"key": b["key"], "event_id": b["event_id"], "accepted": ok})

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key").sortWithinPartitions("key", "t", "event_id").mapInPandas(run, f"key {rows.schema['key'].dataType.simpleString()}, event_id long, accepted boolean")
