"""Corpus scans and audit findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake import vocab
from provlake.functions import text as T
from provlake.functions.ordered import top_k_per_key
from provlake.functions.rules import search, strings


# ── M-01 ────────────────────────────────────────────────────────────────────────────────────
def call_sites(lines: DataFrame, allowed: DataFrame | None = None,
               patterns=vocab.NETWORK_PATTERNS, ipc: str = vocab.LOCAL_IPC_PATTERN) -> DataFrame:
    """M-01: one row per (path, line_no, pattern) on non-comment lines, with allowed and reason.

    ``allowed(path, pattern, reason)`` lists named exceptions.
    """
    text = F.trim("line")
    code = lines.where(~text.startswith("#") & ~text.startswith('"'))
    found = strings(*[F.when(search(F.col("line"), p), F.lit(n)) for n, p in patterns])
    sites = T.unnest(code, found, ["*"], "pattern").drop("_pos").withColumn(
        "text", F.substring(F.trim("line"), 1, 100))
    # The whole line decides; the text is cut for display only.
    local = (F.col("pattern") == "socket") & search(F.col("line"), ipc)
    if allowed is None:
        sites = sites.withColumn("_why", F.lit(None).cast("string"))
    else:
        sites = sites.join(allowed.select("path", "pattern", F.col("reason").alias("_why")),
                           ["path", "pattern"], "left")
    return sites.withColumn("allowed", local | F.col("_why").isNotNull()).withColumn(
        "reason", F.when(local, "AF_UNIX — local IPC, no network address family").otherwise(
            F.coalesce("_why", F.lit("")))).drop("_why")


def offline_verdict(sites: DataFrame) -> DataFrame:
    return sites.agg(F.count(F.lit(1)).alias("sites"), F.count_if(~F.col("allowed")).alias(
        "unexpected"), F.coalesce(F.bool_and("allowed"), F.lit(True)).alias("offline_by_default"))


# ── M-02 ────────────────────────────────────────────────────────────────────────────────────
def prefix_hits(lines: DataFrame, replacements: list[tuple[str, str]]) -> DataFrame:
    """M-02: lines that contain a listed prefix."""
    hit = F.lit(False)
    for old, _ in replacements:
        hit = hit | F.col("line").contains(old)
    return lines.where(hit).withColumn("text", F.substring(F.trim("line"), 1, 120))


def rewrite(files: DataFrame, replacements: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """M-02: files with the prefixes replaced, and how many lines changed."""
    new = F.col(text)
    for old, sub in replacements:
        new = F.replace(new, F.lit(old), F.lit(sub))
    df = files.withColumn("rewritten", new)
    pairs = F.arrays_zip(F.split(text, "\n").alias("a"), F.split("rewritten", "\n").alias("b"))
    return df.withColumn("changed_lines", F.when(F.col("rewritten") == F.col(text), 0).otherwise(
        F.size(F.filter(pairs, lambda p: ~p["a"].eqNullSafe(p["b"])))).cast("long"))


def local_roots(lines: DataFrame, pattern: str = vocab.LOCAL_ROOT_PATTERN) -> DataFrame:
    """M-02: other absolute roots, one row per mention outside comments."""
    found = F.regexp_extract_all("line", F.lit(f"({pattern})"), F.lit(1))
    return T.unnest(lines.where(~F.ltrim("line").startswith("#")), found, ["*"], "root").drop("_pos")


# ── M-03 ────────────────────────────────────────────────────────────────────────────────────
def triage(hits: DataFrame, tracked: DataFrame, deliberate: list[str]) -> DataFrame:
    """M-03: non-comment hits as real, deliberate or not-shipped; ``tracked(path)``."""
    df = hits.where(~F.ltrim("line").startswith("#")).join(
        tracked.select("path").distinct().withColumn("_t", F.lit(True)), "path", "left")
    meant = F.lit(False)
    for suffix in deliberate:
        meant = meant | F.col("path").endswith(suffix)
    return df.withColumn("bucket", F.when(F.col("_t").isNull(), "not-shipped").when(
        meant, "deliberate").otherwise("real")).drop("_t")


# ── M-04 / M-05 / M-06 ──────────────────────────────────────────────────────────────────────
def status_rollup(findings: DataFrame) -> DataFrame:
    """M-04: counts by status; absent ones split by how they were established."""
    return findings.groupBy("status").agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_if(F.col("confidence") == "behavioural").alias("behavioural"),
        F.count_if(F.col("confidence") != "behavioural").alias("structural"))


def weak_ids(findings: DataFrame, shown: int = vocab.WEAK_IDS_SHOWN,
             order: Column | None = None) -> DataFrame:
    """M-04: the first ids that rest on structure alone."""
    weak = findings.where("status = 'ABSENT' AND confidence <> 'behavioural'")
    return weak.orderBy(F.col("id") if order is None else order).limit(shown).select("id")


def outstanding(findings: DataFrame, top: int = vocab.OUTSTANDING_TOP,
                order: Column | None = None) -> DataFrame:
    """M-05: the first of the critical present findings, or of all present ones when none is.

    ``order`` is the findings' place in their document; without it they stand by id.
    Critical ones sort first, so the pool decision needs only the kept rows.
    """
    present = findings.where("status = 'PRESENT'").withColumn(
        "critical", F.col("severity") == "CRITICAL")
    kept = top_k_per_key(present, [], [F.col("critical").desc(), F.col("id") if order is None else order], top)
    return kept.orderBy("rank").withColumn("_any", F.max("critical").over(_whole())).where(
        F.col("critical") == F.col("_any")).select("rank", "id", "title", "severity")


def _whole():
    from pyspark.sql import Window
    return Window.partitionBy(F.lit(1))


def outstanding_counts(findings: DataFrame, top: int = vocab.OUTSTANDING_TOP) -> DataFrame:
    """M-05: present, fixed, unverified counts and how many are not shown."""
    crit = F.count_if((F.col("status") == "PRESENT") & (F.col("severity") == "CRITICAL"))
    n = findings.agg(F.count_if(F.col("status") == "PRESENT").alias("present"),
                     F.count_if(F.col("status") == "ABSENT").alias("fixed"),
                     F.count_if(F.col("status") == "DYNAMIC").alias("unverified"),
                     crit.alias("_c"))
    pool = F.when(F.col("_c") > 0, F.col("_c")).otherwise(F.col("present"))
    return n.select("present", "fixed", "unverified",
                    F.greatest(pool - top, F.lit(0)).cast("long").alias("more"))


def to_file(findings: DataFrame, known: DataFrame,
            statuses: tuple[str, ...] = ("PRESENT", "DYNAMIC")) -> DataFrame:
    """M-06: findings in scope whose title is not filed yet; ``known(title)``."""
    rows = findings.where(F.col("status").isin(*statuses)).withColumn(
        "issue_title", F.concat("id", F.lit(": "), "title"))
    return rows.join(known.select(F.col("title").alias("issue_title")).distinct(), "issue_title",
                     "left_anti")
