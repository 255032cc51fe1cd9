"""Questionnaire answers derived from proven claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake import vocab


class FillRefused(Exception):
    """The whole fill is refused; nothing is written."""


def derive(status: DataFrame, claim_control: DataFrame, tool: str = vocab.TOOL,
           negatives: dict[str, str] | None = None) -> DataFrame:
    """Q-05: control, answer, ssrm, implementation, claims[], refs[].

    ``status`` is E-07 output with ``statement``.  Unproven claims contribute nothing, so an
    unassessed control is absent; the fixed negative controls are always there.
    """
    negatives = vocab.NEGATIVE_CONTROLS if negatives is None else negatives
    used = status.where(F.col("proven") & ~F.col("claim").isin(
        *vocab.RELEASE_ATTESTATION_CLAIMS)).select("claim", "statement", "live_ref")
    per = (claim_control.select("claim", "control").distinct().join(used, "claim")
           .groupBy("control").agg(
               F.array_sort(F.collect_list(F.struct("claim", F.regexp_replace(
                   F.trim("statement"), r"\.+$", "").alias("text")))).alias("_c"),
               F.array_sort(F.collect_set("live_ref")).alias("refs")))
    neg = F.lit(None).cast("string")
    for control, why in negatives.items():
        neg = F.when(F.col("control") == control, F.lit(why)).otherwise(neg)
    text = F.concat(
        F.array_join(F.transform("_c", lambda x: x["text"]), "; "), F.lit(". Proven by "),
        F.size("refs").cast("string"),
        F.lit(" record(s) in this toolchain's own keyed chain-of-custody ledger ("),
        F.array_join("refs", ", "),
        F.lit(f"), each produced by an executable procedure and re-verified by `{tool} claims "
              "check`."))
    found = per.select("control", F.transform("_c", lambda x: x["claim"]).alias("claims"), "refs",
                       text.alias("_t"), neg.alias("_n")).select(
        "control", F.when(F.col("_n").isNotNull(), "No").otherwise("Yes").alias("answer"),
        F.lit(vocab.DEFAULT_OWNER).alias("ssrm"),
        F.coalesce("_n", "_t").alias("implementation"), "claims", "refs")
    none = F.array().cast("array<string>")
    fixed = status.sparkSession.createDataFrame(
        sorted(negatives.items()), "control string, implementation string")
    missing = fixed.join(found.select("control"), "control", "left_anti").select(
        "control", F.lit("No").alias("answer"), F.lit(vocab.DEFAULT_OWNER).alias("ssrm"),
        "implementation", none.alias("claims"), none.alias("refs"))
    return found.unionByName(missing)


def published(answers: DataFrame) -> DataFrame:
    """Q-06: controls that exist in the published sheet."""
    return answers.where(~F.col("control").isin(*vocab.PROPOSED_CONTROLS))


def proposed(answers: DataFrame) -> DataFrame:
    return answers.where(F.col("control").isin(*vocab.PROPOSED_CONTROLS))


def counts(answers: DataFrame, status: DataFrame) -> DataFrame:
    """Q-06: measure, value rows; claims count application claims only."""
    new = F.col("control").isin(*vocab.PROPOSED_CONTROLS)
    a = answers.agg(F.count_if(~new).alias("p"), F.count_if(new).alias("q"))
    app = status.where(~F.col("claim").isin(*vocab.RELEASE_ATTESTATION_CLAIMS)).agg(
        F.count_if("proven").alias("v"), F.count(F.lit(1)).alias("t"))

    def rows(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
        return df.select(F.inline(F.array(*[
            F.struct(F.lit(n).alias("measure"), F.col(c).alias("value")) for n, c in pairs])))

    return rows(a, ("published_controls_answered", "p"), ("proposed_controls_recorded", "q")
                ).unionByName(rows(app, ("claims_proven", "v"), ("claims_total", "t")))


def drift(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """Q-07: control, finding rows where the stored answers disagree with the ledger."""
    s = stored.select("control", F.struct("answer", "ssrm", "implementation", "claims", "refs"
                                          ).alias("got"))
    d = derived.select("control", F.struct("answer", "ssrm", "implementation", "claims", "refs"
                                           ).alias("want"))
    g, w, c = F.col("got"), F.col("want"), F.col("control")

    def quoted(x: Column) -> Column:
        return F.coalesce(F.concat(F.lit("'"), x, F.lit("'")), F.lit("None"))

    empty = F.array().cast("array<string>")
    text = lambda x: F.trim(F.coalesce(x["implementation"], F.lit("")))
    items = lambda x, n: F.array_sort(F.coalesce(x[n], empty))
    blank = lambda x: F.when(x["ssrm"] != "", x["ssrm"])
    tests = F.array(
        F.when(w.isNull(), F.concat(c, F.lit(": present in the file, not produced by the ledger"))),
        F.when(g.isNull(), F.concat(c, F.lit(": derived from the ledger, missing from the file"))),
        *[F.when(g.isNotNull() & w.isNotNull() & cond, msg) for cond, msg in (
            (~g["answer"].eqNullSafe(w["answer"]), F.concat(
                c, F.lit(": answer is "), quoted(g["answer"]), F.lit(", ledger derives "),
                quoted(w["answer"]))),
            (~blank(g).eqNullSafe(blank(w)), F.concat(
                c, F.lit(": ssrm is "), quoted(g["ssrm"]), F.lit(", ledger derives "),
                quoted(w["ssrm"]))),
            (text(g) != text(w), F.concat(
                c, F.lit(": implementation text differs from the derived text"))),
            (items(g, "claims") != items(w, "claims"), F.concat(
                c, F.lit(": claim set differs from what the ledger derives"))),
            (items(g, "refs") != items(w, "refs"), F.concat(
                c, F.lit(": evidence refs differ from those the ledger derives"))))])
    return s.join(d, "control", "full_outer").select(
        "control", F.explode(F.array_compact(tests)).alias("finding"))


def stale_evidence(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Q-08: cited (control, ref) pairs that no longer resolve; ``live(ref)``."""
    cited = stored.select("control", F.explode("refs").alias("ref"))
    return cited.join(live.select("ref").distinct(), "ref", "left_anti")


def evidence_counts(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Q-08: total, resolving and stale refs per control."""
    cited = stored.select("control", F.explode("refs").alias("ref"))
    known = live.select("ref").distinct().withColumn("_ok", F.lit(True))
    return cited.join(known, "ref", "left").groupBy("control").agg(
        F.count(F.lit(1)).alias("total"), F.count("_ok").alias("resolving"),
        F.count_if(F.col("_ok").isNull()).alias("stale"))


def control_of(question_id: Column) -> Column:
    """Everything before the last dot."""
    return F.regexp_replace(question_id, r"\.[^.]*$", "")


def fill_refusals(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Q-09: control, refusal rows; any row refuses the whole fill."""
    a, o = F.col("answer"), F.coalesce("ssrm", F.lit(""))
    bad = (F.when(~F.coalesce(a.isin(*vocab.VALID_ANSWERS), F.lit(False)), "invalid answer")
           .when((a == "NA") & (o != ""), "an NA answer must leave ownership blank")
           .when((o != "") & ~o.isin(*vocab.VALID_OWNERS), "ownership not in the vocabulary"))
    invalid = answers.withColumn("refusal", bad).where("refusal IS NOT NULL").select(
        "control", "refusal")
    known = questions.where(F.col("question_id").contains(".")).select(
        control_of(F.col("question_id")).alias("control")).distinct()
    unknown = answers.join(known, "control", "left_anti").select(
        "control", F.lit("control not present in the questionnaire").alias("refusal"))
    return invalid.unionByName(unknown)


def fill_rows(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Q-09: every question with its control's answer; unassessed ones stay null."""
    q = questions.withColumn("control", F.when(
        F.col("question_id").contains("."), control_of(F.col("question_id"))))
    return q.join(answers.select("control", "answer", "ssrm", "implementation"), "control", "left")


def fill(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Q-09: the filled questionnaire, or :class:`FillRefused`."""
    why = fill_refusals(questions, answers).take(5)
    if why:
        raise FillRefused("; ".join(f"{r['control']}: {r['refusal']}" for r in why))
    return fill_rows(questions, answers)
