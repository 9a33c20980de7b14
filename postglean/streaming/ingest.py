"""The mail stream: resumable ingest, idempotent sinks, running profiles, windows over event time."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..operators import profiles
from ..plans import pipeline
from ..policy import Policy
from ..sources import store


def fresh() -> str:
    """A name that no other run has."""
    return uuid.uuid4().hex


def message_stream(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 10) -> DataFrame:
    """Stream of the Parquet files of a folder with the schema of ``like``; the checkpoint keeps what was read."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def score_stream(stream: DataFrame, out: str, checkpoint: str, policy: Policy | None = None, registry: pipeline.Registry | None = None, learn: bool = False) -> DataStreamWriter:
    """Each micro-batch scored, acted on and learnt from: verdicts, emails, audit rows and observations under ``out``.

    Every table lies in ``<table>/batch=<id>``: a repeated batch overwrites its own folders, so nothing counts twice. Rows
    of one (mailbox, uid) in a batch are one message. With ``learn`` the observations of allowed messages (by the policy)
    are kept, of which :func:`learnt` makes the profiles. A backlog stays on the source; a failed batch is run again by
    the restarted query. One query serves all mailboxes.
    """
    policy = policy or Policy()

    def step(batch: DataFrame, number: int) -> None:
        own = registry or pipeline.default_registry(with_history=False)
        rows = batch.dropDuplicates(["mailbox", "uid"])
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        put(pipeline.score(rows, policy, own), "verdicts")
        scored = batch.sparkSession.read.parquet(f"{out}/verdicts/batch={number}")
        put(store.emails_table(rows), "emails")
        put(store.audit_rows(scored, F.current_timestamp()), "audit_log")
        if learn:
            put(pipeline.learn(None, rows, scored, policy, own), "observations")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def learnt(spark: SparkSession, out: str, keys: list[str] | None = None) -> profiles.Profiles:
    """Profiles of all observations of a stream, each (mailbox, uid) once."""
    obs = spark.read.parquet(f"{out}/observations").drop("batch").dropDuplicates(["mailbox", "uid"])
    return profiles.fold(None, obs, keys or profiles.SENDER)


def written(spark: SparkSession, out: str, keys: tuple[str, ...] = ("mailbox", "uid")) -> DataFrame:
    """The verdicts of all batches, of each key the one of the latest batch."""
    rows = spark.read.parquet(f"{out}/verdicts")
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("r")).select(*keys, "r.*")


def tumbling(events: DataFrame, time: str, width: str, *by: str, late: str = "1 day") -> DataFrame:
    """Counts per window and key; in a stream, rows later than ``late`` are dropped."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sliding(events: DataFrame, time: str, width: str, step: str, *by: str, late: str = "1 day") -> DataFrame:
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width, step).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, time: str, gap: str, *by: str, late: str = "1 day") -> DataFrame:
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


class RunningProfile(StatefulProcessor):
    """Per key the number of messages, of those with files, the last time and the mean interval, kept without end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("profile", "n bigint, files bigint, last double, intervals bigint, total double")

    def handleInputRows(self, key, rows, timers):
        n, files, last, k, total = self.state.get() if self.state.exists() else (0, 0, None, 0, 0.0)
        seen = []  # two numbers a message: the chunks of a batch come in any order
        for part in rows:
            seen += zip(part["at"], part["n_files"])
        for at, own in sorted(seen):
            if last is not None and at >= last:
                k, total = k + 1, total + at - last
            n, files, last = n + 1, files + (own > 0), at if last is None else max(last, at)
        self.state.update((n, files, last, k, total))
        yield pd.DataFrame({**{f"key_{i}": [v] for i, v in enumerate(key)}, "messages": [n], "file_messages": [files], "last_seen": [last], "mean_interval": [total / k if k else None]})

    def close(self) -> None:
        pass


def running_profiles(observations: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The keys (``sender``, or sender and ``recipient``) with ``messages, file_messages, last_seen, mean_interval`` after each batch.

    ``observations`` has the keys, ``at`` (seconds) and ``n_files``. Rows of one batch are taken in order of time.
    """
    keys = keys or ["sender"]
    schema = ", ".join(f"key_{i} string" for i in range(len(keys))) + ", messages bigint, file_messages bigint, last_seen double, mean_interval double"
    out = observations.groupBy(*keys).transformWithStateInPandas(RunningProfile(), schema, "Update", "None")
    return out.withColumnsRenamed({f"key_{i}": k for i, k in enumerate(keys)})
