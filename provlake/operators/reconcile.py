"""Dispatch/report reconciliation, turn reconciliation, alerts and nonces."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake import vocab
from provlake.sources.keys import KeySource


# ── R-01 ────────────────────────────────────────────────────────────────────────────────────
def reconcile(dispatched: DataFrame, reported: DataFrame) -> DataFrame:
    """R-01: one row per finding (ledger_id, seq, report_no, kind, finding).

    The first report per (ledger, seq) is a min, not a ranked window, and all joins are on
    (ledger_id, seq), so neither a hot ledger nor a much repeated seq meets in one task.
    """
    first = reported.groupBy("ledger_id", "seq").agg(F.min("report_no").alias("_first"))
    d = dispatched.select("ledger_id", "seq", F.col("actor").alias("d_actor"),
                          F.col("action").alias("d_action"), F.col("nonce").alias("d_nonce"))
    base = d.join(first, ["ledger_id", "seq"], "left")
    both = reported.join(base, ["ledger_id", "seq"], "left")
    s = F.concat(F.lit("seq "), F.col("seq").cast("string"))
    found = F.col("d_actor").isNotNull()

    def row(cond: Column, kind: str, *text) -> Column:
        return F.when(cond, F.struct(F.lit(kind).alias("kind"), F.concat(*[
            t if isinstance(t, Column) else F.lit(t) for t in text]).alias("finding")))

    tests = F.array_compact(F.array(
        row(~found, "fabricated", "report at ", s, " (", F.col("actor"), "/", F.col("action"),
            ") was never dispatched — fabricated or replayed"),
        row(found & (F.col("report_no") > F.col("_first")), "replayed", s,
            " reported more than once — replayed"),
        row(found & (F.col("actor") != F.col("d_actor")), "actor", s, ": dispatched to ",
            F.col("d_actor"), " but ", F.col("actor"), " claims it — attribution mismatch"),
        row(found & (F.col("action") != F.col("d_action")), "action", s, ": dispatched ",
            F.col("d_action"), " but ", F.col("actor"), " reports ", F.col("action")),
        row(found & F.col("nonce").isNull(), "no-nonce", s,
            ": no nonce returned — the dispatch cannot be bound"),
        row(found & (F.col("nonce") != F.col("d_nonce")), "nonce", s,
            ": nonce mismatch — expected the value issued at dispatch, got '", F.col("nonce"),
            "'")))
    seen = both.select("ledger_id", "seq", "report_no", F.explode(tests).alias("_f")).select(
        "ledger_id", "seq", "report_no", "_f.*")
    silent = base.where("_first IS NULL").select(
        "ledger_id", "seq", F.lit(None).cast("long").alias("report_no"),
        F.lit("unreported").alias("kind"), F.concat(
            s, F.lit(" ("), "d_actor", F.lit("/"), "d_action",
            F.lit(") was dispatched but no report corroborates it — unreported execution")
        ).alias("finding"))
    return seen.unionByName(silent)


def reconciliation_verdict(dispatched: DataFrame, findings: DataFrame) -> DataFrame:
    """R-01: verified iff no finding, per ledger."""
    n = findings.groupBy("ledger_id").agg(F.count(F.lit(1)).alias("findings"))
    every = dispatched.select("ledger_id").distinct()
    return every.join(n, "ledger_id", "full_outer").select(
        "ledger_id", F.coalesce("findings", F.lit(0).cast("long")).alias("findings"),
        F.col("findings").isNull().alias("verified"))


# ── R-02 ────────────────────────────────────────────────────────────────────────────────────
def turn_reconciliation(instances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R-02: (one row per session, unclosed action ids).

    ``instances(session_id, id, phase)``.  Pairs on the action id; the record's own seq cannot
    pair a dispatch with its result.  Counts are made per (session, id) first.
    """
    per = instances.where(F.coalesce("id", F.lit("")) != "").groupBy("session_id", "id").agg(
        F.count_if(F.col("phase") == "dispatch").alias("d"),
        F.count_if(F.col("phase") == "result").alias("r"))
    unclosed = per.where("d > 0 AND r = 0").select("session_id", "id")
    bad = (F.col("d") > 0) != (F.col("r") > 0)
    sums = per.groupBy("session_id").agg(
        F.sum("d").alias("dispatched"), F.sum("r").alias("reported"),
        F.count(F.lit(1)).alias("action_instances"),
        F.count_if((F.col("d") > 0) & (F.col("r") == 0)).alias("unclosed"),
        F.count_if(bad).alias("_bad"))
    sessions = instances.select("session_id").distinct()
    zero = {c: F.coalesce(c, F.lit(0).cast("long"))
            for c in ("dispatched", "reported", "action_instances", "unclosed", "_bad")}
    out = sessions.join(sums, "session_id", "left").withColumns(zero)
    examined = (F.col("dispatched") + F.col("reported")) > 0
    return out.withColumn("examined_anything", examined).withColumn(
        "severity", F.when(F.col("_bad") > 0, "critical").when(examined, "info")
        .otherwise("warning")).drop("_bad"), unclosed


# ── R-03 / R-04 ─────────────────────────────────────────────────────────────────────────────
def classify_alerts(records: DataFrame) -> DataFrame:
    """R-03: adds alert, reason, wake.  Anything unrecognised alerts the operator.

    The operation is ``op`` or, where that is missing or blank, ``kind`` if there is such a column.
    """
    op = F.col("op")
    if "kind" in records.columns:
        op = F.coalesce(F.when(op != "", op), "kind")
    severity = F.coalesce("severity", F.lit("info"))
    reason, wake = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for name, why in vocab.WAKE_HUMAN.items():
        reason, wake = reason.when(op == name, why), wake.when(op == name, "human")
    for name, why in vocab.WAKE_OPERATOR.items():
        reason, wake = reason.when(op == name, why), wake.when(op == name, "operator")
    critical = severity == "critical"
    routine = F.coalesce(op.isin(*vocab.ROUTINE), F.lit(False))
    reason = reason.when(critical, F.concat(
        F.lit("record marked critical: "), F.coalesce("detail", F.lit("")))).when(
        routine, "routine activity").otherwise(F.concat(
            F.lit("unrecognised op "), F.coalesce(F.concat(F.lit("'"), op, F.lit("'")),
                                                  F.lit("None")),
            F.lit(" — refusing to ignore what is not understood")))
    wake = wake.when(critical, "human").when(routine, F.lit(None).cast("string")).otherwise(
        "operator")
    return records.withColumns({"reason": reason, "wake": wake, "alert": wake.isNotNull()})


def alert_report(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """R-04: ledger_id, priority, seq, reason, wake — the chain's own alert first (priority 0)."""
    at = F.coalesce("broken_at", F.lit(0)).cast("string")
    broken = ~F.col("intact")
    chain = verdicts.where(broken | ((F.col("records") > 0) & ~F.col("verified_keyed"))).select(
        "ledger_id", F.lit(0).alias("priority"),
        F.when(broken, F.coalesce("broken_at", F.lit(0)).cast("long")).alias("seq"),
        F.when(broken, F.concat(F.lit("LEDGER CHAIN BROKEN at entry "), at, F.lit(": "), "reason",
                                F.lit(" — tampering or corruption"))).otherwise(
            "chain shape is intact but could not be verified against its key — report this as "
            "'chain-only', never as tamper-proof").alias("reason"),
        F.when(broken, "human").otherwise("operator").alias("wake"))
    rows = classify_alerts(records).where("alert").select(
        "ledger_id", F.lit(1).alias("priority"), F.col("seq").cast("long").alias("seq"), "reason",
        "wake")
    return chain.unionByName(rows)


# ── R-05 ────────────────────────────────────────────────────────────────────────────────────
_LOW32 = 0xFFFFFFFF


def _mul32(a: Column, factor: int) -> Column:
    """(a * factor) mod 2^32 for a < 2^32, without leaving 64 bits."""
    high, low = factor >> 16, factor & 0xFFFF
    top = F.shiftleft((a * high).bitwiseAND(0xFFFF), 16)
    return (top + a * low).bitwiseAND(_LOW32)


def derived_nonce(instance: Column, seq: Column) -> Column:
    """Fallback nonce without a key: two 32-bit running hashes over the text, in hex."""
    text = F.concat(instance, F.lit("#"), seq.cast("string"), F.lit(vocab.NONCE_SUFFIX))
    # Code points come from UTF-32; its last bytes are taken as one number per character.
    points = F.transform(F.split(text, ""), lambda ch: F.conv(
        F.hex(F.encode(ch, "UTF-32")), 16, 10).cast("long"))
    start = F.struct(F.lit(0x811C9DC5).cast("long").alias("a"),
                     F.lit(0x01000193).cast("long").alias("b"), F.lit(7).cast("long").alias("w"))
    done = F.aggregate(points, start, lambda s, c: F.struct(
        _mul32(s["a"].bitwiseXOR(c), 0x01000193).alias("a"),
        _mul32((s["b"] + c * s["w"]).bitwiseAND(_LOW32), 0x85EBCA6B).alias("b"),
        (s["w"] + 1).alias("w")))
    return F.lower(F.concat(F.lpad(F.hex(done["a"]), 8, "0"), F.lpad(F.hex(done["b"]), 8, "0")))


def keyed_nonce(key: KeySource):
    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        material = key.read()
        return text.map(lambda t: hmac.new(material, t.encode(), hashlib.sha256).hexdigest()[:16])
    return run


def issue_nonces(dispatches: DataFrame, instance: str = "instance_id", seq: str = "seq",
                 key: KeySource | None = None) -> DataFrame:
    """R-05: adds nonce and nonce_mode."""
    if key is None:
        return dispatches.withColumns({
            "nonce": derived_nonce(F.col(instance), F.col(seq)),
            "nonce_mode": F.lit("fnv1a-derived")})
    text = F.concat(F.col(instance), F.lit("#"), F.col(seq).cast("string"),
                    F.lit(vocab.NONCE_SUFFIX))
    return dispatches.withColumns({"nonce": keyed_nonce(key)(text),
                                   "nonce_mode": F.lit(vocab.ALGO_KEYED)})
