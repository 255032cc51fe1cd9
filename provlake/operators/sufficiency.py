"""Evidence sufficiency: regimes, rollup, questions, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake import vocab
from provlake.functions import text as T
from provlake.functions.ordered import top_k_per_key


def path_missing(pred: Column, path: str) -> Column:
    """Absent or empty; for assertion paths presence is enough."""
    json = T.json_at(pred, path)
    if path in vocab.ASSERTION_PATHS:
        return json.isNull()
    return json.isNull() | json.isin("null", '""', "[]", "{}")


def regime_missing(pred: Column) -> dict[str, Column]:
    """Q-01: per regime the missing paths of one record; complete iff empty."""
    return {r: F.array_compact(F.array(*[F.when(path_missing(pred, p), F.lit(p)) for p in paths]))
            for r, paths in vocab.REGIMES.items()}


def regime_applies(regime: str, op: Column) -> Column:
    kinds = vocab.REGIME_OPS.get(regime)
    return F.lit(True) if kinds is None else F.coalesce(op.isin(*kinds), F.lit(False))


def assess(records: DataFrame) -> DataFrame:
    """Q-02: per ledger and regime the counts and the missing-path histogram.

    ``records(ledger_id, pred)``.  One aggregation with conditional counts: nothing is exploded,
    and one row per ledger leaves the map side.
    """
    op = F.coalesce(F.when(T.string_at(F.col("pred"), "action.op") != "",
                           T.string_at(F.col("pred"), "action.op")),
                    T.string_at(F.col("pred"), "op"), F.lit(""))
    paths = sorted({p for ps in vocab.REGIMES.values() for p in ps})
    flags = records.select("ledger_id", op.alias("_op"), *[
        path_missing(F.col("pred"), p).alias(f"_m{i}") for i, p in enumerate(paths)])
    at = {p: F.col(f"_m{i}") for i, p in enumerate(paths)}
    aggs = [F.count(F.lit(1)).alias("total")]
    for i, (r, ps) in enumerate(vocab.REGIMES.items()):
        applies = regime_applies(r, F.col("_op"))
        any_missing = at[ps[0]]
        for p in ps[1:]:
            any_missing = any_missing | at[p]
        aggs += [F.count_if(applies).alias(f"a{i}"),
                 F.count_if(applies & ~any_missing).alias(f"c{i}")]
        aggs += [F.count_if(applies & at[p]).alias(f"h{i}_{j}") for j, p in enumerate(ps)]
    wide = flags.groupBy("ledger_id").agg(*aggs)
    rows = [F.struct(
        F.lit(r).alias("regime"), F.col(f"c{i}").alias("complete_records"),
        F.col(f"a{i}").alias("applicable_records"), F.col("total").alias("total_records"),
        (F.col("total") - F.col(f"a{i}")).alias("not_applicable"),
        ((F.col(f"a{i}") > 0) & (F.col(f"c{i}") == F.col(f"a{i}"))).alias("fully_populated"),
        F.filter(F.array(*[F.struct(F.lit(p).alias("path"), F.col(f"h{i}_{j}").alias("records"))
                           for j, p in enumerate(ps)]), lambda x: x["records"] > 0
                 ).alias("missing")) for i, (r, ps) in enumerate(vocab.REGIMES.items())]
    return wide.select("ledger_id", F.inline(F.array(*rows)))


def questions(regimes: DataFrame, ledgers: DataFrame | None = None) -> DataFrame:
    """Q-03: per ledger and question whether it is answerable and what blocks it.

    ``ledgers(ledger_id)`` adds ledgers without records: an empty ledger answers nothing.
    """
    per = regimes.groupBy("ledger_id").agg(
        F.collect_set(F.when(F.col("fully_populated"), F.col("regime"))).alias("_full"))
    if ledgers is not None:
        per = ledgers.select("ledger_id").distinct().join(per, "ledger_id", "left")
    full = F.coalesce("_full", F.array().cast("array<string>"))
    rows = [F.struct(F.lit(q).alias("question"), F.array_except(
        F.array(*[F.lit(r) for r in rs]), full).alias("blocked_by"))
        for q, rs in vocab.QUESTIONS.items()]
    return per.select("ledger_id", F.inline(F.array(*rows))).withColumn(
        "answerable", F.size("blocked_by") == 0)


def verdict(asked: DataFrame) -> DataFrame:
    """Q-03: sufficient iff every question is answerable."""
    return asked.groupBy("ledger_id").agg(
        F.count_if("answerable").alias("answerable"),
        F.count(F.lit(1)).alias("questions_total"),
        F.when(F.bool_and("answerable"), "sufficient").otherwise("incomplete").alias("verdict"))


def gaps(regimes: DataFrame, top: int = 3) -> DataFrame:
    """Q-04: the most frequent missing paths per ledger and regime; ties in path order."""
    rows = regimes.select("ledger_id", "regime", F.posexplode("missing").alias("ord", "m")).select(
        "ledger_id", "regime", "ord", "m.*")
    return top_k_per_key(rows, ["ledger_id", "regime"],
                         [F.col("records").desc(), F.col("ord")], top).drop("ord")
