"""Findings that arrive over time: reports of many runs as a stream, each finding counted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVIDENCE = "repo string, fingerprint string, rule string, severity string, confidence string, path string, seen timestamp"


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of JSON findings; lines that do not parse become rows of nulls and are dropped."""
    return spark.readStream.schema(EVIDENCE).json(folder).where("fingerprint IS NOT NULL AND seen IS NOT NULL")


def first_seen(findings: DataFrame, late: str = "1 day") -> DataFrame:
    """Each (repo, fingerprint) once while its state is kept."""
    return findings.withWatermark("seen", late).dropDuplicatesWithinWatermark(["repo", "fingerprint"])


def counts(findings: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Findings of each rule and severity in tumbling windows of event time."""
    w = findings if findings.isStreaming and "seen" not in findings.columns else findings.withWatermark("seen", late)
    return w.groupBy(F.window("seen", width), "rule", "severity").agg(F.count("*").alias("n"), F.approx_count_distinct("repo").alias("repos"))


def event_counts(spark: SparkSession, path: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The same for a table of (ts, event_type, value) read as a stream of files."""
    kind = spark.read.parquet(path).schema
    events = spark.readStream.schema(kind).parquet(path)
    ts = F.col("ts").cast("timestamp")
    return events.withColumn("at", ts).withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


STATE = "repo string, fingerprint string, first_seen timestamp, last_seen timestamp, runs long, status string"


def lifecycles(findings: DataFrame, expiry_ms: int, late: str = "0 seconds") -> DataFrame:
    """A stream of states of each (repo, fingerprint): open whenever it is seen, resolved once event time has passed its last
    sight by ``expiry_ms``; then its state is dropped.  The last row of a key is its state, as ``plans.evidence.states`` has it.
    """

    def update(key, frames, state):
        import pandas as pd

        def row(first, last, runs, status):
            stamp = lambda ms: pd.Timestamp(ms, unit="ms")
            return pd.DataFrame({"repo": [key[0]], "fingerprint": [key[1]], "first_seen": [stamp(first)], "last_seen": [stamp(last)], "runs": [runs], "status": [status]})

        if state.hasTimedOut:
            first, last, runs = state.get
            state.remove()
            yield row(first, last, runs, "resolved")
            return
        first, last, runs = state.get if state.exists else (None, None, 0)
        for f in frames:
            ms = f["seen"].astype("datetime64[ms]").astype("int64")
            first, last, runs = min(ms.min(), first if first is not None else ms.min()), max(ms.max(), last if last is not None else ms.max()), runs + len(f)
        first, last = int(first), int(last)
        state.update((first, last, runs))
        state.setTimeoutTimestamp(max(last + expiry_ms, state.getCurrentWatermarkMs() + 1))
        yield row(first, last, runs, "open")

    known = findings.where("fingerprint IS NOT NULL AND seen IS NOT NULL").select("repo", "fingerprint", "seen").withWatermark("seen", late)
    return known.groupBy("repo", "fingerprint").applyInPandasWithState(update, STATE, "first long, last long, runs long", "update", "EventTimeTimeout")
