"""Record shapes: normalisation, tier checks, strength ladder and the record builder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake import vocab
from provlake.functions import text as T
from provlake.operators.taint import DERIVED, REF


# ── V-01 ────────────────────────────────────────────────────────────────────────────────────
def predicate_of(body: Column) -> Column:
    """The predicate of a ledger entry, a bare Statement or a bare predicate."""
    def get(path: str) -> Column:
        return F.try_variant_get(body, f"$.{path}", "variant")

    is_obj = F.coalesce(F.to_json(get("statement")).startswith("{"), F.lit(False))
    return F.when(is_obj, F.coalesce(get("statement.predicate"), get("statement"))).otherwise(
        F.coalesce(get("predicate"), body))


def normalise(df: DataFrame, body: str = "body") -> DataFrame:
    """V-01: one typed record per entry; the nested path first, the flat mirror second.

    A blank operation, outcome or action id counts as absent and falls through to the next place;
    a session id only when it is missing.
    """
    df = df.withColumn("pred", predicate_of(F.col(body)))
    p, r = F.col("pred"), F.col(body)

    def some(c: Column) -> Column:
        return F.when(c != "", c)

    def text(nested: str, flat: str, keep=some) -> Column:
        return F.coalesce(*[keep(T.string_at(b, path)) for b, path in
                            ((p, nested), (p, flat), (r, flat))])

    def refs(name: str, kind: str) -> Column:
        nested = F.from_json(T.json_at(p, f"resources.{name}"), kind)
        flat = F.from_json(T.json_at(r, f"resources.{name}"), kind)
        return F.coalesce(F.when(F.size(nested) > 0, nested), flat, F.array().cast(kind))

    keep = [c for c in ("ledger_id", "idx", "seq", "hash") if c in df.columns]
    return df.select(
        *keep, "pred",
        text("lifecycle.session_id", "session_id", lambda c: c).alias("session_id"),
        text("action.op", "op").alias("op"),
        text("decision.outcome", "outcome").alias("outcome"),
        F.coalesce(*[some(T.string_at(p, path)) for path in (
            "actor.runtime_action_id", "runtime_action_id", "action.tool.call_id")]
                   ).alias("action_id"),
        refs("used", REF).alias("used"), refs("generated", REF).alias("generated"),
        F.coalesce(F.from_json(T.json_at(p, "resources.derived_from"), DERIVED),
                   F.array().cast(DERIVED)).alias("derived_from"),
        T.string_at(p, "decision.basis.declassified_artifact").alias("declassified"))


# ── V-02 / V-03 / V-04 ──────────────────────────────────────────────────────────────────────
def _problems(*tests: tuple[Column, Column | str]) -> Column:
    """The messages of the tests that hold, in order."""
    return F.array_compact(F.array(*[
        F.when(c, m if isinstance(m, Column) else F.lit(m)) for c, m in tests]))


def _members(body: Column, paths, values, of) -> Column:
    """``of(json, text)`` over the members of ``body``: JSON texts at ``paths``, scalars at ``values``.

    Spark works out what stands inside a filtered array anew at every mention, so the body and each
    member are bound first and read once.
    """
    paths, values = list(dict.fromkeys(paths)), list(dict.fromkeys(values))
    return T.bound(body, lambda b: T.bound(
        F.struct(*[T.json_at(b, p).alias(f"j{i}") for i, p in enumerate(paths)],
                 *[T.string_at(b, p).alias(f"s{i}") for i, p in enumerate(values)]),
        lambda m: of(lambda p: m[f"j{paths.index(p)}"], lambda p: m[f"s{values.index(p)}"])))


def _vocabulary(json: Column, value: Column, path: str, allowed: tuple[str, ...], tail: str) -> tuple:
    bad = json.isNotNull() & (json != "null") & ~F.coalesce(value.isin(*allowed), F.lit(False))
    return bad, F.concat(F.lit(f"{path} ("), T.python_repr(value), F.lit(f" {tail})"))


def tier_a(pred: Column) -> Column:
    """V-02: every problem that refuses a write, in path order."""
    def listed(values) -> str:
        return "not in [" + ", ".join(f"'{v}'" for v in sorted(values)) + "]"

    known = {"action.op": (vocab.OPS, "is not in the controlled vocabulary"),
             "decision.outcome": (vocab.OUTCOMES, listed(vocab.OUTCOMES)),
             "authority.posture": (vocab.POSTURES, listed(vocab.POSTURES)),
             "action.method.kind": (vocab.METHOD_KINDS, listed(vocab.METHOD_KINDS))}

    def found(at, text) -> Column:
        tests = []
        for path in vocab.TIER_A:
            json = at(path)
            if path in vocab.TIER_A_ASSERTIONS:
                present = (json.isNotNull() & ~T.is_list(json), (
                    f"{path} (must be a list; [] asserts 'nothing', absent means 'nobody looked')"))
            else:
                present = (json.isin("null", '""'), f"{path} (empty)")
            tests += [(json.isNull(), f"{path} (absent)"), present]
        return _problems(*tests, *[_vocabulary(at(p), text(p), p, *k) for p, k in known.items()])

    return _members(pred, [*vocab.TIER_A, *known], known, found)


def boundary(event: Column) -> Column:
    """V-03: what the recorder's boundary refuses in a flat event."""
    kinds = {'"': "str", "{": "dict", "t": "bool", "f": "bool", "n": "NoneType"}

    def found(at, _) -> Column:
        tests = [(T.is_falsy(at(f)), f"missing {f}") for f in vocab.REQUIRED_EVENT_FIELDS]
        js = {k: at(k) for k in vocab.REQUIRED_ASSERTIONS}
        tests += [(v.isNull(), f"missing {k} (use [] to assert there is nothing to report; a missing "
                   "key means nobody looked)") for k, v in js.items()]
        for k, v in js.items():
            kind = F.lit("int")
            for first, name in kinds.items():
                kind = F.when(v.startswith(first), name).otherwise(kind)
            kind = F.when(v.rlike(r"^-?[0-9]+(\.|[eE])"), "float").otherwise(kind)
            tests.append((v.isNotNull() & ~T.is_list(v),
                          F.concat(F.lit(f"{k} must be a list, got "), kind)))
        return _problems(*tests)

    return _members(event, [*vocab.REQUIRED_EVENT_FIELDS, *vocab.REQUIRED_ASSERTIONS], (), found)


def split_events(events: DataFrame, column: str = "event") -> tuple[DataFrame, DataFrame]:
    """V-03: (accepted, refused with problems)."""
    df = events.withColumn("problems", boundary(F.try_parse_json(column)))
    return df.where(F.size("problems") == 0).drop("problems"), df.where(F.size("problems") > 0)


def tier_b(pred: Column) -> Column:
    """V-04: what blocks sealing and certification; posture sensitive."""
    on = "actor.acted_on_behalf_of"
    passed = "action.method.script.test_result.passed"

    def found(at, text) -> Column:
        observing = F.coalesce(text("authority.posture") == "observe", F.lit(False))
        tests = []
        for path in vocab.TIER_B:
            missing = at(path).isNull() | at(path).isin("null", '""')
            if path == f"{on}.prompt_id":
                missing = missing & ~observing
            tests.append((missing, path))
        deep = ~T.is_falsy(at(f"{on}.delegation_depth"))
        tests += [
            (deep & T.is_falsy(at(f"{on}.delegation_chain")),
             f"{on}.delegation_chain (delegation_depth > 0)"),
            (F.coalesce(text("action.op").isin(*vocab.DATA_OPS), F.lit(False))
             & T.is_falsy(at("resources.used")), "resources.used (data-touching op)"),
            (F.coalesce(text("action.method.kind") == "delegated-script", F.lit(False))
             & ~at(passed).eqNullSafe("true"), f"{passed} (must be true)")]
        return _problems(*tests)

    return _members(pred, [*vocab.TIER_B, f"{on}.delegation_depth", f"{on}.delegation_chain", "resources.used", passed],
                    ["authority.posture", "action.op", "action.method.kind"], found)


# ── V-05 / V-06 ─────────────────────────────────────────────────────────────────────────────
def strength(pred: Column) -> Column:
    """V-05: the last applicable rung of the ladder."""
    return T.bound(pred, _strength)


def _strength(pred: Column) -> Column:
    keyed = F.coalesce(T.string_at(pred, "verification.chain.algo") == vocab.ALGO_KEYED,
                       F.lit(False))
    tier = F.coalesce(F.try_variant_get(pred, "$.verification.recorder.isolation_tier", "double"),
                      F.lit(0.0))
    signed = ~T.is_falsy(T.json_at(pred, "verification.signature.present"))
    stamped = ~T.is_falsy(T.json_at(pred, "verification.timestamp.tsa"))
    return (F.when(stamped, "+tsa").when(signed, "+signed")
            .when(keyed & (tier >= vocab.ISOLATED_MIN_TIER), "chain-keyed+isolated")
            .when(keyed, "chain-keyed").otherwise("chain-only"))


#: Where a flat column lands in the predicate.
RECORD_COLUMNS = {
    "record_id": "record.id", "at": "record.at", "recorded_at": "record.recorded_at",
    "agent_id": "actor.agent_id", "runtime_action_id": "actor.runtime_action_id",
    "operator": "actor.operator", "posture": "authority.posture",
    "op": "action.op", "method_kind": "action.method.kind", "input_digest": "action.input_digest",
    "policy_set_digest": "policy.policy_set_digest",
    "determining_policy": "policy.determining_policy",
    "outcome": "decision.outcome", "channel": "decision.channel",
    "session_id": "lifecycle.session_id", "chain": "verification.chain",
    "known_gaps": "verification.known_gaps", "alterations": "alterations",
    "isolation_tier": "verification.recorder.isolation_tier",
    "prompt_id": "actor.acted_on_behalf_of.prompt_id",
    "human_id": "actor.acted_on_behalf_of.human_id",
    "capability": "authority.capability", "basis": "decision.basis",
    "used": "resources.used", "generated": "resources.generated",
}


def build_records(df: DataFrame, columns: dict[str, str] | None = None,
                  extra: dict[str, Column] | None = None,
                  predicate_type: str = vocab.PREDICATE_TYPE) -> DataFrame:
    """V-06: custody statements from flat columns.

    ``extra`` (dotted path -> Column) overlays single fields: a non-null overlay wins over the base
    value.  Adds ``statement`` (JSON), ``strength`` and ``problems``; rows with problems must not
    be written (``writable``).
    """
    base = {"record_version": F.lit(vocab.RECORD_VERSION),
            "actor.prov_type": F.lit("prov:SoftwareAgent"),
            "action.prov_type": F.lit("prov:Activity")}
    for name, path in (columns or RECORD_COLUMNS).items():
        if name in df.columns:
            base[path] = F.col(name)
    for path, value in (extra or {}).items():
        base[path] = F.coalesce(value, base[path]) if path in base else value

    def tree(level: Column | None, under: str = "") -> Column:
        fields = {p: v for p, v in base.items() if p == "record_version" or p.startswith(under)}
        if level is not None:
            fields["verification.strength"] = level
        nested: dict = {}
        for path, value in fields.items():
            *heads, leaf = path.split(".")
            node = nested
            for h in heads:
                node = node.setdefault(h, {})
            node[leaf] = value

        def build(node: dict) -> Column:
            return F.struct(*[(build(v) if isinstance(v, dict) else v).alias(k)
                              for k, v in sorted(node.items())])

        return F.to_json(build(nested))

    df = df.withColumn("strength", strength(F.parse_json(tree(None, "verification."))))
    df = df.withColumn("_p", tree(F.col("strength")))
    statement = F.concat(
        F.lit(f'{{"_type":"{vocab.STATEMENT_TYPE}","predicate":'), F.col("_p"),
        F.lit(f',"predicateType":"{predicate_type}","subject":[]}}'))
    return (df.withColumn("problems", tier_a(F.parse_json("_p")))
            .withColumn("statement", statement).drop("_p"))


def writable(built: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V-06: (records, refusals)."""
    return built.where(F.size("problems") == 0), built.where(F.size("problems") > 0)
