"""Policy tables of any size, matched by content and counted.

``operators.policy.decide`` unrolls a small policy set into one expression. Here policies are rows.
Every condition becomes a row too, and calls are reduced to *situations* first: the values of the
context paths, where numbers only matter by their place among the bounds that conditions name.
Situations are few, whatever the number of calls. Their values meet the distinct tests of the
conditions in equi-joins (equality, membership, elements), in joins on sorted bounds, or through the
literal index (substrings and patterns). Situations are taken in blocks of 64, so that those meeting a
test, a condition or a policy are the bits of one long; a policy fires in a situation that meets all
its positive conditions and violates none of its negative ones. Only policies that fire, or are in
scope where that is asked for, become rows of a situation. Decisions go back to the calls by the situation.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, NumericType

from provlake import vocab
from provlake.functions import literals
from provlake.functions.rules import OPERATORS
from provlake.session import cut_lineage, unsized

#: Different numbers that conditions may compare one context path with.
MOST_BOUNDS = 1 << 16
#: Situations of a block: the bits of a long.
BLOCK = 64
#: Scope is matched like a condition.
ACTION, POSTURE = "@action", "@posture"
_NEGATED = {"ne": "eq", "is_false": "is_true"}
_ORDERED = ("gte", "gt", "lte", "lt")
_CONDITIONS = "ord int, no int, path string, op string, negative boolean, item string, number double"


def _text(value) -> str | None:
    """How a scalar operand is written in the tables; null stays null."""
    if value is None or isinstance(value, str):
        return value
    return json.dumps(float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value)


def conditions(policies: DataFrame) -> DataFrame:
    """One row per condition and operand item of a policy table (``operators.policy.policy_table``).

    A condition holds if one of its items is met; ``negative`` ones must not be.
    """
    def rows(p) -> Iterator[tuple]:
        found = [(ACTION, "in", list(p.actions))] * bool(len(p.actions)) + [
            (POSTURE, "in", list(p.postures))] * bool(len(p.postures))
        for path, cond in json.loads(p.when_json or "{}").items():
            found += [(path, *kv) for kv in (cond if isinstance(cond, dict) else {"eq": cond}).items()]
        for no, (path, op, want) in enumerate(found):
            if op not in OPERATORS:
                raise ValueError(f"{p.id}: unknown condition operator {op!r}")
            negative, op = op in _NEGATED, _NEGATED.get(op, op)
            items = (want or []) if op in ("in", "contains_any") else [True if op == "is_true" else want]
            op = {"in": "eq", "is_true": "eq", "contains_any": "contains_any"}.get(op, op)
            if op in _ORDERED and not isinstance(want, (int, float)):
                raise ValueError(f"{p.id}: {path} is compared with {want!r}")
            for x in items or [None]:
                never = not items
                number = float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
                yield p.ord, no, path, "never" if never else op, negative, _text(x), number

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([r for p in b.itertuples() for r in rows(p)],
                               columns=[c.split()[0] for c in _CONDITIONS.split(", ")])
            yield out.astype({"number": float, "item": object})

    given = policies.select("ord", "id", F.coalesce("actions", F.array().cast("array<string>")).alias("actions"),
                            F.coalesce("postures", F.array().cast("array<string>")).alias("postures"), "when_json")
    return given.mapInPandas(run, _CONDITIONS).withColumn("number", F.nanvl("number", F.lit(None).cast("double")))


def _bounds(known: DataFrame) -> dict[str, list[float]]:
    out: dict[str, list[float]] = {}
    rows = (known.where("number IS NOT NULL").groupBy("path").agg(
        F.slice(F.array_sort(F.collect_set("number")), 1, MOST_BOUNDS + 1).alias("b")).collect())
    for r in rows:
        if len(r["b"]) > MOST_BOUNDS:
            raise ValueError(f"{r['path']} is compared with more than {MOST_BOUNDS} numbers")
        out[r["path"]] = r["b"]
    return out


def _place(value: Column, bounds: list[float]) -> Column:
    """Twice the number of bounds below a value, and one more where it is a bound: binary search."""
    b = F.lit(bounds) if bounds else F.array().cast("array<double>")
    steps = F.sequence(F.lit(len(bounds).bit_length() - 1), F.lit(0), F.lit(-1))
    below = F.aggregate(steps, F.lit(0), lambda acc, k: acc + F.when(
        F.coalesce(F.get(b, acc + F.call_function("shiftleft", F.lit(1), k) - 1) < value, F.lit(False)),
        F.call_function("shiftleft", F.lit(1), k)).otherwise(0)) if bounds else F.lit(0)
    return 2 * below + F.when(F.coalesce(F.get(b, below) == value, F.lit(False)), 1).otherwise(0)


def situations(df: DataFrame, action: Column, posture: Column, context: dict[str, Column],
               bounds: dict[str, list[float]], paths: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with ``_situation`` (JSON text of the paths conditions name), and each path's kind."""
    given = {ACTION: action, POSTURE: posture, **context}
    kinds, fields = {}, []
    types = df.select(*[c.alias(f"c{i}") for i, c in enumerate(given.values())]).schema
    for (path, c), f in zip(given.items(), types, strict=True):
        if path not in paths:
            continue
        kinds[path] = ("array" if isinstance(f.dataType, ArrayType) else "number" if isinstance(
            f.dataType, NumericType) else "flag" if isinstance(f.dataType, BooleanType) else "text")
        value = {"array": F.array_sort(c.cast("array<string>")) if kinds[path] == "array" else None,
                 "number": _place(c.cast("double"), bounds.get(path, [])) if kinds[path] == "number" else None,
                 "flag": c.cast("string"), "text": c.cast("string")}[kinds[path]]
        fields.append(F.when(c.isNotNull(), value).alias(path.replace(".", "/")))
    return df.withColumn("_situation", F.to_json(F.struct(*fields)) if fields else F.lit("{}")), kinds


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once, with a number of each row that stays as it is."""
    return unsized(cut_lineage(df.withColumn(name, F.monotonically_increasing_id())))


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (at % BLOCK).cast("int"))


def _bits(mask: Column) -> Column:
    """The places of the bits that are set."""
    return F.filter(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: F.getbit(mask, i) == 1)


def _met(found: DataFrame, known: DataFrame, kinds: dict[str, str], bounds: dict[str, list[float]]) -> DataFrame:
    """(_block, test, mask): the tests met in each block of situations, and by which of them."""
    body = F.from_json("_situation", "map<string,string>")
    kind = F.coalesce(F.get(F.from_json(F.lit(json.dumps({k: [v] for k, v in kinds.items()})),
                                        "map<string,array<string>>")[F.col("path")], 0), F.lit("none"))
    # One row per situation and named path, with a null value where the path has none.
    named = found.select("_s", F.explode(F.array(*[F.struct(F.lit(p).alias("path"), body[
        p.replace(".", "/")].alias("value")) for p in kinds])).alias("v")).select("_s", "v.*") if kinds else (
        found.select("_s", F.lit("").alias("path"), F.lit(None).cast("string").alias("value")).limit(0))
    values = named.select("path", "value").distinct().withColumn("kind", kind)
    key = ["path", "value", "test"]
    known = known.withColumn("kind", kind)
    # Numbers are compared by their places, text and flags as they are written.
    at = F.from_json(F.lit(json.dumps({p: {json.dumps(x): 2 * i + 1 for i, x in enumerate(b)}
                                       for p, b in bounds.items()})), "map<string,map<string,int>>")
    placed = known.withColumn("operand", F.when(F.col("kind") == "number", F.try_element_at(
        F.try_element_at(at, F.col("path")), F.col("item")).cast("string")).otherwise(F.col("item")))
    equal = placed.where("op = 'eq' AND item IS NOT NULL").join(
        values.where("kind <> 'array'").select("path", F.col("value").alias("operand")), ["path", "operand"]).select(
        "path", F.col("operand").alias("value"), "test")
    null = known.where("op = 'eq' AND item IS NULL").join(values.where("value IS NULL").select("path", "value"), "path")
    v, o = F.col("value").cast("int"), F.col("operand").cast("int")
    ordered = placed.where(F.col("op").isin(*_ORDERED) & (F.col("kind") == "number")).join(
        values.where("kind = 'number' AND value IS NOT NULL").select("path", "value"), "path").where(
        F.when(F.col("op") == "gte", v >= o).when(F.col("op") == "gt", v > o).when(F.col("op") == "lte", v <= o)
        .otherwise(v < o))
    lists = values.where("kind = 'array'").select("path", "value", F.explode(
        F.from_json("value", "array<string>")).alias("item"))
    elements = known.where("op IN ('contains', 'contains_any') AND kind = 'array'").join(lists, ["path", "item"])
    texts = values.where("kind = 'text' AND value <> ''").select("path", "value")
    letters = known.where("op = 'contains_any' AND kind = 'text'").join(
        texts.select("path", "value", F.explode(F.array_distinct(F.split("value", ""))).alias("item")), ["path", "item"])
    parts = known.where("op = 'contains' AND kind = 'text' AND item <> ''")
    held = literals.scan(texts.select(F.col("value").alias("hit"), F.col("value").alias("text")).distinct(),
                         parts.select(F.col("item").alias("low")).distinct())
    inside = parts.join(held.select(F.col("low").alias("item"), F.col("hit").alias("value")).distinct(), "item").join(
        texts, ["path", "value"])
    tried = known.where("op = 'matches' AND kind IN ('text', 'array', 'flag')")
    shown = values.where("kind IN ('text', 'flag') AND value <> ''").select("path", "value")
    patterns = tried.select(F.col("item").alias("id"), F.col("item").alias("pattern")).distinct()
    hits = literals.match_table(shown, patterns, "value", "(?Ud)")
    matched = tried.join(hits.withColumnRenamed("id", "item"), "item").join(shown, ["path", "value"])
    all_met = equal.select(*key)
    for part in (null, ordered, elements, letters, inside, matched):
        all_met = all_met.unionByName(part.select(*key))
    # A null value met its condition by path alone.
    return named.join(all_met.distinct().withColumnRenamed("path", "_p").withColumnRenamed("value", "_v"),
                      (F.col("path") == F.col("_p")) & F.col("value").eqNullSafe(F.col("_v"))).groupBy(
        F.floor(F.col("_s") / BLOCK).alias("_block"), "test").agg(F.bit_or(_bit(F.col("_s"))).alias("mask"))


def _masks(found: DataFrame, known: DataFrame, kinds: dict[str, str], bounds: dict[str, list[float]],
           policies: DataFrame) -> DataFrame:
    """(_block, ord, in_scope, fires): where policies are in scope and where they fire, as bits; those
    in scope nowhere in a block are left out."""
    test = ["path", "op", "item"]
    tests = _numbered(known.select(*test).distinct(), "test")
    met = unsized(cut_lineage(_met(found, tests, kinds, bounds)))
    scoped = known.where(F.col("path").isin(ACTION, POSTURE)).select("ord", "no").distinct().withColumn(
        "scoped", F.lit(True))
    wants = policies.select("ord").join(known.groupBy("ord").agg(
        F.count_distinct(F.when(~F.col("negative"), F.col("no"))).alias("n"),
        F.count_distinct(F.when(F.col("path").isin(ACTION, POSTURE), F.col("no"))).alias("n_scope")), "ord", "left").select(
        "ord", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_scope", F.lit(0)).alias("n_scope"))
    t = tests.select("test", *[F.col(c).alias(f"_{c}") for c in test])
    asked = known.join(t, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in test]).select(
        "test", "ord", "no", "negative").join(scoped, ["ord", "no"], "left")
    mask, positive = F.col("mask"), ~F.col("negative")
    have = (asked.join(met, "test").groupBy("_block", "ord", "no", "negative", "scoped")
            .agg(F.bit_or("mask").alias("mask")).groupBy("_block", "ord").agg(
        F.count_if(positive).alias("have"), F.bit_and(F.when(positive, mask)).alias("all"),
        F.bit_or(F.when(~positive, mask)).alias("broken"), F.count("scoped").alias("have_scope"),
        F.bit_and(F.when(F.col("scoped"), mask)).alias("all_scope")))
    blocks = found.groupBy(F.floor(F.col("_s") / BLOCK).alias("_block")).agg(
        F.bit_or(_bit(F.col("_s"))).alias("whole"))
    # Policies without a scope are evaluated in every situation; the others where theirs is met.
    free = wants.where("n_scope = 0").select("ord").distinct()
    rows = have.select("_block", "ord").unionByName(blocks.select("_block").crossJoin(free)).distinct().join(
        have, ["_block", "ord"], "left").join(wants, "ord").join(blocks, "_block")

    def met_all(n: str, have: str, bits: str) -> Column:
        return F.when(F.col(n) == 0, F.col("whole")).when(F.col(have) == F.col(n), F.col(bits)).otherwise(0)

    return rows.withColumn("in_scope", met_all("n_scope", "have_scope", "all_scope")).where("in_scope <> 0").select(
        "_block", "ord", "in_scope", F.col("in_scope").bitwiseAND(met_all("n", "have", "all")).bitwiseAND(
            F.bitwise_not(F.coalesce("broken", F.lit(0).cast("long")))).alias("fires"))


def decide_by_table(df: DataFrame, action: Column, posture: Column, context: dict[str, Column],
                    policies: DataFrame, derived: dict[str, Column] | None = None) -> DataFrame:
    """P-02 for policy tables of any size: the columns that ``operators.policy.decide`` adds.

    A condition on a path outside ``context`` sees it as null. A number compared with a text path, a
    pattern on a number or an order on text never holds. ``derived`` are columns over the decision's
    that are worked out once a situation, not once a call: ``counterfactual`` names every overridden
    policy, so it is as long as the table.
    """
    odd = policies.where(~F.col("effect").isin(*vocab.EFFECT_PRECEDENCE)).select("id", "effect").first()
    if odd:
        raise ValueError(f"{odd['id']}: unknown effect {odd['effect']!r}")
    # What grows with the table is joined by its real size: an estimate would send it all to the driver.
    policies = unsized(cut_lineage(policies.select(
        "ord", "id", "effect", "when_json", "reason", "actions", "postures", "guidance", "priority")))
    known = unsized(cut_lineage(conditions(policies)))
    bounds = _bounds(known)
    paths = {r[0] for r in known.select("path").distinct().collect()}
    absent = {p: F.lit(None).cast("string") for p in paths if p not in context and not p.startswith("@")}
    df, kinds = situations(df, action, posture, {**context, **absent}, bounds, paths)
    found = _numbered(df.select("_situation").distinct(), "_s")
    names = policies.select("ord", "id", "effect", "priority")
    prec = F.get(F.from_json(F.lit(json.dumps({k: [v] for k, v in vocab.EFFECT_PRECEDENCE.items()})),
                             "map<string,array<int>>")[F.col("effect")], 0)
    rows = unsized(cut_lineage(_masks(found, known, kinds, bounds, policies)))

    def expanded(bits: str) -> DataFrame:
        return rows.where(F.col(bits) != 0).join(names, "ord").select(
            "_block", F.explode(_bits(F.col(bits))).alias("_at"), "ord", "id", "priority", prec.alias("prec")).select(
            (F.col("_block") * BLOCK + F.col("_at")).alias("_s"), "ord", "id", "priority", "prec")

    win = F.col("_win")
    fired = expanded("fires").groupBy("_s").agg(
        F.max(F.struct("prec", "priority", (-F.col("ord")).alias("ord"), "id")).alias("_win"),
        F.array_sort(F.collect_list(F.struct("ord", "id", "prec"))).alias("_fired"))
    tried = expanded("in_scope").groupBy("_s").agg(
        F.array_sort(F.collect_list(F.struct("ord", "id"))).alias("_all")).select("_s", F.col("_all.id").alias("evaluated"))
    over = F.transform(F.filter("_fired", lambda x: x["prec"] < win["prec"]), lambda x: x["id"])
    effect = F.element_at(F.array(F.lit("permit"), F.lit("ask"), F.lit("forbid")), win["prec"])
    texts = policies.select("ord", "reason", "guidance")
    none = F.array().cast("array<string>")
    decided = fired.withColumn("ord", -win["ord"]).join(texts, "ord", "left").select(
        "_s", win["prec"].alias("_prec"), win["id"].alias("_id"), "reason", "guidance", F.array_join(over, ", ").alias("_over"),
        F.size(over).alias("_n"), effect.alias("_effect"))
    p = F.col("_prec")
    decided = found.join(decided, "_s", "left").join(tried, "_s", "left").select(
        "_situation", F.when(p == 3, "deny").when(p == 2, "ask").when(p == 1, "allow").otherwise("deny").alias("outcome"),
        F.coalesce("_id", F.lit(vocab.DEFAULT_DENY_ID)).alias("determining_policy"),
        F.when(p.isNull(), vocab.DEFAULT_DENY_REASON).otherwise(F.coalesce("reason", F.lit(""))).alias("reason"),
        F.coalesce("guidance", F.lit("")).alias("guidance"), F.coalesce("evaluated", none).alias("evaluated"),
        F.when(F.col("_n") > 0, F.concat(F.lit("would have been "), F.col("_over"), F.lit(" but "), F.col("_effect"),
                                         F.lit(" overrides"))).otherwise("").alias("counterfactual"))
    added = [c for c in decided.columns if c != "_situation"]
    return df.drop(*added).join(decided.withColumns(derived or {}), "_situation", "left").drop("_situation")
