"""Stateless lifecycle rows, guards, once-a-day marker, ledger sink and alert stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.functions import text as T
from provlake.operators import reconcile, risk, validate
from provlake.session import scratch_path
from provlake.sources import ledger as S
from provlake.sources.keys import KeySource


# ── ST-03 ───────────────────────────────────────────────────────────────────────────────────
def _row(df: DataFrame, op: str, detail: Column, severity: Column | str = "info",
         gaps: Column | None = None) -> DataFrame:
    none = F.array().cast("array<string>")
    return df.select(
        "session_id", F.lit(op).alias("op"), detail.alias("detail"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        (none if gaps is None else gaps).alias("known_gaps"))


def prompt_rows(df: DataFrame) -> DataFrame:
    """Digest and length of a prompt, never its text (session_id, prompt, prompt_id)."""
    text = F.coalesce("prompt", F.lit(""))
    return _row(df, "prompt.submit", F.to_json(F.struct(
        F.length(text).alias("prompt_chars"),
        F.concat(F.lit("sha256:"), T.sha(text)).alias("prompt_digest"), "prompt_id"),
        {"ignoreNullFields": "false"}))


def failure_rows(df: DataFrame) -> DataFrame:
    """Shape and length of an error (session_id, tool, tool_use_id, error, is_interrupt)."""
    shape = F.when(F.col("error").isNull(), "NoneType").otherwise("str")
    return _row(df, "tool.result", F.to_json(F.struct(
        F.length(F.coalesce("error", F.lit(""))).alias("error_chars"),
        shape.alias("error_shape"), F.coalesce("is_interrupt", F.lit(False)).alias("is_interrupt"),
        F.lit(False).alias("success"), F.coalesce("tool", F.lit("?")).alias("tool"),
        "tool_use_id"), {"ignoreNullFields": "false"}), "warning")


def open_rows(df: DataFrame, ledgers: DataFrame) -> DataFrame:
    """Session opens with the ledger's state (stream-static join on ledger_id).

    ``ledgers(ledger_id, records, intact, usable, reason)``; a ledger that is not there is normal.
    """
    j = df.join(ledgers, "ledger_id", "left")
    bad = ~F.coalesce("usable", F.lit(True))
    gaps = F.array_compact(F.array(
        F.when(bad, F.concat(F.lit("ledger not usable at session start: "),
                             F.coalesce("reason", F.lit("None")))),
        F.when(F.coalesce("isolation_tier", F.lit(0)) == 0,
               "isolation tier 0: no recorder daemon; records written in-process")))
    detail = F.to_json(F.struct(
        F.col("intact").alias("chain_intact"), F.col("usable").alias("chain_usable"),
        F.coalesce("isolation_tier", F.lit(0)).alias("isolation_tier"),
        F.coalesce("records", F.lit(0).cast("long")).alias("ledger_records"), "source"))
    return _row(j, "session.open", detail, F.when(F.size(gaps) > 0, "critical").otherwise("info"),
                gaps)


def close_rows(df: DataFrame) -> DataFrame:
    return _row(df, "session.close", F.to_json(F.struct("reason"), {"ignoreNullFields": "false"}))


# ── ST-05 ───────────────────────────────────────────────────────────────────────────────────
def guard_sink(path: str) -> Callable[[DataFrame, int], None]:
    """ST-05: a ``foreachBatch`` function that marks all but the first use of a guarded shape.

    A batch needs one minimum per (project, shape), taken with partial aggregation, and the keys seen
    before; rows stay where they are and meet both by joins. Each batch owns its folders: its rows
    (project, shape, seq, blocked) and the keys known after it, so a batch that runs again gives the
    same result. The first use is that of the least seq in the batch that has it first.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        epoch = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"
        shaped = batch.select("project", "seq", risk.guard_shape(F.col("command")).alias("shape")).where(
            "shape IS NOT NULL")
        first = shaped.groupBy("project", "shape").agg(F.min("seq").alias("first"))
        if batch_id:
            seen = spark.read.schema("project string, shape string").parquet(
                f"{path}/seen/epoch={epoch}/batch={batch_id - 1}")
        else:
            seen = spark.createDataFrame([], "project string, shape string")
        known = seen.withColumn("again", F.lit(True))
        out = (shaped.join(first, ["project", "shape"]).join(known, ["project", "shape"], "left")
               .select("project", "shape", "seq", (F.coalesce("again", F.lit(False))
                                                   | (F.col("seq") > F.col("first"))).alias("blocked")))
        out.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}/batch={batch_id}")
        seen.unionByName(first.select("project", "shape")).distinct().write.mode("overwrite").parquet(
            f"{path}/seen/epoch={epoch}/batch={batch_id}")
    return run


# ── ST-06 ───────────────────────────────────────────────────────────────────────────────────
def disabled_once(notices: DataFrame) -> DataFrame:
    """ST-06: one notice per profile and day (profile, at); the watermark bounds the state."""
    return (notices.withColumn("day", F.date_format("at", "yyyy-MM-dd"))
            .withWatermark("at", "1 day")
            .dropDuplicatesWithinWatermark(["profile", "day"]))


# ── ST-07 ───────────────────────────────────────────────────────────────────────────────────
def ledger_sink(path: str, key: KeySource | None = None) -> Callable[[DataFrame, int], None]:
    """ST-07: a ``foreachBatch`` function that validates, chains and appends events.

    Events are (ledger_id, ord, event).  Each batch of a query owns its own folders: records,
    refusals and the heads after it.  A batch that runs again starts from the heads before it and
    overwrites its own folders, so every event is in the ledger exactly once.  A query with a new
    checkpoint is another epoch: it keeps the folders of earlier ones and goes on from their heads.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        good, bad = validate.split_events(batch)
        accepted, reserved = S.admit(good)
        epoch = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"
        mine_at = f"epoch={epoch}/batch={batch_id}"
        last = _last_heads(spark, path, epoch, batch_id)
        chained = S.append(accepted, last, key)
        chained.write.mode("overwrite").parquet(f"{path}/records/{mine_at}")
        refused = bad.select("ledger_id", "ord", "event", F.array_join("problems", "; ").alias(
            "refusal")).unionByName(reserved.select("ledger_id", "ord", "event", "refusal"))
        refused.write.mode("overwrite").parquet(f"{path}/refused/{mine_at}")
        mine = spark.read.parquet(f"{path}/records/{mine_at}").groupBy("ledger_id").agg(
            (F.max("seq") + 1).alias("next_seq"), F.max_by("hash", "seq").alias("head"))
        heads = mine if last is None else mine.unionByName(
            last.join(mine, "ledger_id", "left_anti"))
        heads.write.mode("overwrite").parquet(f"{path}/heads/{mine_at}")
    return run


def _last_heads(spark: SparkSession, path: str, epoch: str, batch_id: int) -> DataFrame | None:
    """Heads after the batch before this one; before an epoch's first batch, the furthest heads
    that other epochs have left."""
    if batch_id:
        return spark.read.parquet(f"{path}/heads/epoch={epoch}/batch={batch_id - 1}").select(
            "ledger_id", "next_seq", "head")
    try:
        every = spark.read.parquet(f"{path}/heads")
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc) and "UNABLE_TO_INFER_SCHEMA" not in str(exc):
            raise
        return None
    return every.where(F.col("epoch") != epoch).groupBy("ledger_id").agg(
        F.max("next_seq").alias("next_seq"), F.max_by("head", "next_seq").alias("head"))


# ── ST-08 ───────────────────────────────────────────────────────────────────────────────────
def alert_stream(records: DataFrame) -> DataFrame:
    """ST-08: alerting records only, with reason and who is woken."""
    return reconcile.classify_alerts(records).where("alert")


# ── running a finite stream ─────────────────────────────────────────────────────────────────
def run_available(stream: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """Process what is available now into Parquet under the shared folder and read it back.

    ``base`` names the folder, for those who want to look into its checkpoint.
    """
    spark = stream.sparkSession
    base = base or scratch_path(spark, name)
    q = (stream.writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/checkpoint").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_sink(stream: DataFrame, name: str, make: Callable[[str], Callable],
             ledger: str | None = None) -> str:
    """Run a ``foreachBatch`` sink over what is available now, with a new checkpoint; returns its
    folder, which is ``ledger`` where one is given."""
    base = scratch_path(stream.sparkSession, name)
    ledger = ledger or f"{base}/ledger"
    q = (stream.writeStream.foreachBatch(make(ledger))
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return ledger

