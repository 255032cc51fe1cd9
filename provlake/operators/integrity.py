"""Chain verification, key admission, seals, heads and tails."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake import vocab
from provlake.functions import text as T
from provlake.functions.ordered import CHUNK_ROWS, running, top_k_per_key
from provlake.sources.keys import KeySource
from provlake.sources.ledger import record_hash


# ── L-02 ────────────────────────────────────────────────────────────────────────────────────
def record_findings(entries: DataFrame, key: KeySource | None = None,
                    chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per record the first failing test, or null.

    ``entries(ledger_id, idx, raw, body, seq, prev_hash, hash, hash_alg)`` with a dense 0-based
    ``idx``.  The link test reads the row before; chunks keep a hot ledger over many tasks.
    """
    df = record_hash(entries, key)
    df = running(df, ["ledger_id"], "idx", {"_prev": ("last", F.col("hash"))},
                 chunk_rows=chunk_rows)
    i = F.col("idx").cast("string")
    body = F.col("body")
    reason = F.lit(None).cast("string")
    keyed = F.col("hash_alg").eqNullSafe(vocab.ALGO_KEYED)

    def say(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    tests = [(T.json_at(body, f).isNull(), say("entry ", i, f" is missing '{f}'"))
             for f in vocab.REQUIRED_CHAIN_FIELDS]
    tests += [
        (~F.col("seq").eqNullSafe(F.col("idx")),
         say("entry ", i, " carries seq ", F.coalesce(T.json_at(body, "seq"), F.lit("null")),
             " — entries were reordered or removed")),
        (~F.col("prev_hash").eqNullSafe(F.coalesce("_prev", F.lit(vocab.GENESIS))),
         say("entry ", i,
             " does not chain to its predecessor — an entry was altered or removed"))]
    if key is not None:
        tests.append((~keyed, say(
            "entry ", i, f" is unkeyed ({vocab.ALGO_UNKEYED}) but a key was supplied — a keyed "
            "ledger with an unkeyed entry has been spliced")))
    checkable = ~keyed if key is None else F.lit(True)
    tests.append((checkable & ~F.col("recomputed").eqNullSafe(F.col("hash")), say(
        "entry ", i, " content does not match its own hash — it was edited in place")))
    reason = F.when(tests[0][0], tests[0][1])
    for cond, text in tests[1:]:
        reason = reason.when(cond, text)
    return df.withColumn("finding", reason).drop("_prev", "recomputed")


def verify(entries: DataFrame, key: KeySource | None = None, chunk_rows: int = CHUNK_ROWS,
           ledgers: DataFrame | None = None) -> DataFrame:
    """L-02: one verdict per ledger: intact, broken_at, reason, verified_keyed, checked.

    Ledgers listed in ``ledgers`` without an entry are intact, with nothing checked.
    """
    rows = record_findings(entries, key, chunk_rows)
    agg = rows.groupBy("ledger_id").agg(
        F.min(F.when(F.col("finding").isNotNull(), F.struct("idx", "finding"))).alias("_f"),
        F.bool_or(F.col("hash_alg").eqNullSafe(vocab.ALGO_KEYED)).alias("_keyed"),
        F.count(F.lit(1)).alias("records"))
    if ledgers is not None:
        agg = (ledgers.select("ledger_id").join(agg, "ledger_id", "left")
               .fillna(False, ["_keyed"]).fillna(0, ["records"]))
    intact = F.col("_f").isNull()
    return agg.select(
        "ledger_id", intact.alias("intact"), F.col("_f.idx").alias("broken_at"),
        F.col("_f.finding").alias("reason"),
        (intact & F.col("_keyed") & F.lit(key is not None)).alias("verified_keyed"),
        F.coalesce("_f.idx", "records").alias("checked"), "records")


def usability(damaged: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Complete and verified per ledger, with the reason where not (L-01 with L-02, X-01)."""
    d = damaged.groupBy("ledger_id").agg(
        F.bool_or("truncated").alias("truncated"), F.min("malformed_at").alias("malformed_at"),
        F.min("decode_error_at").alias("decode_error_at"))
    both = d.join(verdicts, "ledger_id", "full_outer")
    reason = (F.when(~F.coalesce("intact", F.lit(True)), F.col("reason"))
              .when(F.col("malformed_at").isNotNull(), F.concat(
                  F.lit("line "), "malformed_at",
                  F.lit(" is unparseable and is not the final line — corruption, not an "
                        "interrupted write")))
              .when(F.col("decode_error_at").isNotNull(), F.concat(
                  F.lit("line "), "decode_error_at", F.lit(" is not valid UTF-8 — corruption")))
              .when(F.col("truncated"), "the final record is partial; the ledger is a prefix, "
                    "not a ledger"))
    return both.withColumn("reason", reason).withColumn("usable", reason.isNull())


# ── L-05 / L-09 / L-10 ──────────────────────────────────────────────────────────────────────
def admission(entries: DataFrame, registry: DataFrame) -> DataFrame:
    """L-05: downgrade and key mismatch per ledger; ``registry(ledger_id, keyid)``, null = no key."""
    led = entries.groupBy("ledger_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("keyid") != "", F.col("keyid")))).alias("recorded"),
        F.bool_or(F.col("hash_alg").eqNullSafe(vocab.ALGO_KEYED)).alias("keyed"))
    out = led.join(registry.select("ledger_id", F.col("keyid").alias("supplied")), "ledger_id",
                   "left")
    refusal = (F.when(F.col("supplied").isNull() & F.col("keyed"),
                      "refusing to append without its chain key: this ledger is keyed")
               .when(F.col("supplied").isNotNull() & (F.size("recorded") > 0)
                     & ~F.array_contains("recorded", F.col("supplied")),
                     F.concat(F.lit("KEY MISMATCH, not tampering: written under "),
                              F.array_join("recorded", ", "), F.lit(", supplied "), "supplied")))
    return out.withColumn("refusal", refusal)


def heads(entries: DataFrame, ledgers: DataFrame | None = None) -> DataFrame:
    """L-09: head hash, next seq and first keyid of each ledger; genesis for listed empty ones."""
    found = entries.groupBy("ledger_id").agg(
        F.max_by("hash", "idx").alias("head"), F.count(F.lit(1)).alias("next_seq"),
        F.min_by("keyid", F.when(F.coalesce("keyid", F.lit("")) != "", F.col("idx"))
                 ).alias("keyid"))
    if ledgers is None:
        return found
    return (ledgers.select("ledger_id").join(found, "ledger_id", "left")
            .fillna(vocab.GENESIS, ["head"]).fillna(0, ["next_seq"]))


def dump(damaged: DataFrame, verdicts: DataFrame) -> DataFrame:
    """L-10: per ledger the number of records, the verdict, and whether its end is torn."""
    torn = damaged.groupBy("ledger_id").agg(F.bool_or("truncated").alias("truncated"))
    return verdicts.join(torn, "ledger_id", "left").select(
        "ledger_id", "records", "intact", "broken_at", "reason", "verified_keyed",
        F.coalesce("truncated", F.lit(False)).alias("truncated"))


def tail(entries: DataFrame, n: int) -> DataFrame:
    """L-10: the last ``n`` records of each ledger."""
    return top_k_per_key(entries.drop("body"), ["ledger_id"], [F.col("idx").desc()], n)


# ── L-06 ────────────────────────────────────────────────────────────────────────────────────
SEAL = ("segment string, path string, records long, first_seq long, last_seq long, "
        "head_hash string, file_digest string, prev_seal_digest string, sealed_at string, "
        "mac string, keyid string")
_SEAL_FIELDS = [f.split()[0] for f in SEAL.split(", ")]


def seal_material(seal: dict) -> bytes:
    body = {k: seal[k] for k in _SEAL_FIELDS if k not in ("mac", "keyid")}
    return json.dumps(body, sort_keys=True, separators=(",", ":")).encode()


def seal_mac(seal: dict, key: bytes) -> str:
    return hmac.new(key, vocab.SEAL_MAC_PREFIX.encode() + seal_material(seal),
                    hashlib.sha256).hexdigest()


def seal_digest(seal: dict) -> str:
    body = {k: seal[k] for k in _SEAL_FIELDS}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()
                          ).hexdigest()


_ARROW_SEAL = pa.schema([("series", pa.string()), ("index", pa.int64())] + [
    (n, pa.int64() if n in ("records", "first_seq", "last_seq") else pa.string())
    for n in _SEAL_FIELDS] + [("seal_digest", pa.string())])


def refused_segments(state: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """L-06: ledgers that may not be sealed (ledger_id, refusal).

    ``state`` is ``dump`` over all ledgers, empty ones included; ``digests(ledger_id, file_digest)``
    names the files that could be read. The first reason counts: broken, partial, empty, unreadable.
    """
    why = (F.when(~F.col("intact"), F.concat(F.lit("broken at entry "),
                                             F.col("broken_at").cast("string")))
           .when(F.col("truncated"), "the last record is partial")
           .when(F.col("records") == 0, "nothing to seal"))
    if digests is not None:
        state = state.join(digests.select("ledger_id", "file_digest"), "ledger_id", "left")
        why = why.when(F.col("file_digest").isNull(), "the file cannot be digested")
    return state.select("ledger_id", why.alias("refusal")).where("refusal IS NOT NULL")


def seal(segments: DataFrame, files: DataFrame, sealed_at: str,
         key: KeySource | None = None) -> DataFrame:
    """L-06: seals of verified segments, each naming the digest of the seal before it.

    ``segments(series, index, path, records, first_seq, last_seq, head_hash, refusal)`` has one
    row per segment; ``files(path, content)`` whole segment files, or ``files(path, file_digest)``
    where they are large (``ledger.file_digests``).  The caller leaves out what
    ``refused_segments`` names.  Only these small rows are chained.
    """
    digests = files.select("path", F.col("file_digest") if "file_digest" in files.columns
                           else T.sha(F.col("content")).alias("file_digest"))
    rows = segments.join(digests, "path").withColumns({
        "segment": F.format_string("seg-%06d", F.col("index").cast("long")),
        "sealed_at": F.lit(sealed_at)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        material = key.read() if key else None
        series, prev = None, vocab.GENESIS
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["series"] != series:
                    series, prev = r["series"], vocab.GENESIS
                r["prev_seal_digest"], r["mac"], r["keyid"] = prev, None, None
                if material is not None:
                    r["mac"], r["keyid"] = seal_mac(r, material), key.keyid
                prev = r["seal_digest"] = seal_digest(r)
                out.append(r)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW_SEAL)

    ordered = rows.repartition("series").sortWithinPartitions("series", "index")
    return ordered.mapInArrow(run, f"series string, index long, {SEAL}, seal_digest string")


def segment_facts(entries: DataFrame) -> DataFrame:
    """Per ledger file: records, first and last seq, head hash."""
    return entries.groupBy("ledger_id").agg(
        F.count(F.lit(1)).alias("records"), F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"), F.max_by("hash", "idx").alias("head_hash"))


def next_segment_event(seals: DataFrame) -> DataFrame:
    """L-06: the record that opens the segment after each seal, as input of L-04."""
    detail = F.to_json(F.struct(
        F.concat_ws(".", F.regexp_replace("path", r"\.[^./]*$", ""), "segment").alias("archived_to"),
        F.col("seal_digest").alias("follows_seal_digest"),
        F.col("segment").alias("follows_segment"), (F.col("index") + 1).alias("next_index")))
    return seals.select(F.col("series").alias("ledger_id"), F.col("index").alias("ord"), F.to_json(
        F.struct(F.lit("recorder/segments").alias("actor"),
                 F.array().cast("array<string>").alias("alterations"),
                 F.col("sealed_at").alias("at"), detail.alias("detail"),
                 F.array().cast("array<string>").alias("known_gaps"),
                 F.lit("ledger.seal").alias("op"), F.lit("info").alias("severity"))
    ).alias("event"))


# ── L-07 / L-08 ─────────────────────────────────────────────────────────────────────────────
def _seal_check(key: KeySource | None):
    """Arrow check of seal rows: digest, and what the MAC says."""
    @F.pandas_udf("struct<digest:string,mac_finding:string>")
    def run(seals: pd.DataFrame) -> pd.DataFrame:
        material = key.read() if key else None
        out = []
        for s in seals.to_dict("records"):
            if not s["segment"]:
                out.append((None, None))
                continue
            for n in ("records", "first_seq", "last_seq"):
                s[n] = int(s[n])
            if s["mac"] is None:
                why = "seal carries no MAC — it is unauthenticated and can be rewritten"
            elif material is None:
                why = "seal MAC present but no key supplied; authenticity unverified"
            elif hmac.compare_digest(seal_mac(s, material), s["mac"]):
                why = None
            else:
                why = "seal MAC does not verify — the seal was rewritten"
            out.append((seal_digest(s), why))
        return pd.DataFrame(out, columns=["digest", "mac_finding"]).astype(object)
    return run


def verify_sealed(segments: DataFrame, seals: DataFrame,
                  key: KeySource | None = None) -> DataFrame:
    """L-07: findings per segment; hostile input yields findings, never an error.

    ``segments(series, index, path, intact, broken_at, reason, n_entries, last_hash, digest_now)``
    against ``seals``.
    """
    s = seals.select("path", F.struct(*_SEAL_FIELDS).alias("seal"))
    df = segments.join(s, "path", "left")
    safe = F.struct(*[F.coalesce(F.col(f"seal.{n}"), F.lit(0).cast("long")).alias(n)
                      if n in ("records", "first_seq", "last_seq")
                      else F.col(f"seal.{n}").alias(n) for n in _SEAL_FIELDS])
    df = df.withColumn("_chk", _seal_check(key)(safe))
    z = F.col("seal")
    short = lambda c: F.concat(F.substring(c, 1, 16), F.lit("…"))
    tests = [
        F.col("_chk.mac_finding"),
        F.when(~F.coalesce("intact", F.lit(True)), F.concat(
            F.lit("chain broken at "), "broken_at", F.lit(": "), "reason")),
        F.when(~F.col("digest_now").eqNullSafe(z["file_digest"]), F.concat(
            F.lit("segment file digest changed since sealing (sealed "), short(z["file_digest"]),
            F.lit(", now "), short(F.coalesce("digest_now", F.lit("unreadable"))),
            F.lit(") — the sealed file was modified"))),
        F.when((F.col("n_entries") > 0) & F.col("last_hash").isNull(),
               "the final record has no hash field — a malformed record was appended after "
               "sealing").when(
            (F.col("n_entries") > 0) & (F.col("last_hash") != z["head_hash"]),
            "head hash does not match the seal — records were appended after sealing"),
        F.when(F.coalesce("n_entries", F.lit(0)) != z["records"], F.concat(
            F.lit("seal records "), z["records"].cast("string"), F.lit(" entries, file has "),
            F.coalesce("n_entries", F.lit(0)).cast("string"),
            F.lit(" — records were added or removed after sealing")))]
    findings = F.when(z.isNull(), F.array(F.concat(F.lit("no seal beside "), "path"))).otherwise(
        F.array_compact(F.array(*tests)))
    return (df.withColumn("findings", findings).withColumn("ok", F.size("findings") == 0)
            .withColumn("seal_digest", F.col("_chk.digest")).drop("_chk"))


def verify_series(checked: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """L-08: each passing seal must name the digest of the last *passing* seal before it."""
    rows = running(checked, ["series"], "index", {
        "_expected": ("last", F.when(F.col("ok"), F.col("seal_digest")))}, chunk_rows=chunk_rows)
    want = F.coalesce("_expected", F.lit(vocab.GENESIS))
    got = F.col("seal.prev_seal_digest")
    link = F.when(F.col("ok") & (got != want), F.concat(
        F.lit("chains to "), F.substring(got, 1, 16), F.lit("… but the previous seal digests to "),
        F.substring(want, 1, 16), F.lit("… — a segment was replaced or removed")))
    return rows.withColumn("series_findings", F.when(F.col("ok"), F.array_compact(F.array(link)))
                           .otherwise(F.col("findings"))).drop("_expected")


def series_summary(series: DataFrame) -> DataFrame:
    return series.groupBy("series").agg(
        F.bool_and(F.size("series_findings") == 0).alias("ok"),
        F.sum(F.size("series_findings")).alias("findings"),
        F.count(F.lit(1)).alias("segments"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("seal.records"))), F.lit(0)).alias("records"))
