"""Artifacts: classification, egress, mentions, aliases, identity, manifests, handlers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake import vocab
from provlake.functions import labels as L
from provlake.functions import text as T
from provlake.functions.literals import match_table
from provlake.functions.rules import check_size, matching, search, strings
from provlake.session import cut_lineage
from provlake.vocab import Rule


# ── C-01 ────────────────────────────────────────────────────────────────────────────────────
def _any_of(path: Column, rules: list[Rule]) -> Column:
    """Does any of these rules match?  One alternation, so one pass over the text."""
    if not rules:
        return F.lit(False)
    return F.coalesce(search(path, "|".join(f"(?:{r.pattern})" for r in rules), True),
                      F.lit(False))


def _rank(rule: Rule) -> int:
    return max([vocab.SENSITIVITY.index(x) for x in rule.labels if x in vocab.SENSITIVITY] or [0])


def _flags(rule: Rule) -> list[str]:
    return [x for x in rule.labels if x not in vocab.SENSITIVITY]


def path_labels(path: Column, rules: list[Rule]) -> Column:
    """Joined labels of all matching rules; no match is ``{public}``."""
    name = F.when(_any_of(path, [r for r in rules if _rank(r) == 3]), F.lit("restricted"))
    for n in (2, 1):
        name = name.when(_any_of(path, [r for r in rules if _rank(r) == n]),
                         F.lit(vocab.SENSITIVITY[n]))
    flags = sorted({x for r in rules for x in _flags(r)})
    found = F.array_sort(strings(name.otherwise("public"), *[
        F.when(_any_of(path, [r for r in rules if f in _flags(r)]), F.lit(f)) for f in flags]))
    # Most paths match nothing: one search decides that.
    return F.when(_any_of(path, rules), found).otherwise(F.array(F.lit("public")))


def path_classified(path: Column, rules: list[Rule]) -> Column:
    """Is the joined label set classified?  Kept free of the label set: filters on it are pushed
    below the projection, and this form costs one search there."""
    return _any_of(path, [r for r in rules if _rank(r) >= L.CONFIDENTIAL or _flags(r)])


def classify(df: DataFrame, path: str = "path", rules: list[Rule] | None = None,
             prefix: str = "") -> DataFrame:
    """C-01: every matching rule contributes; adds labels, matched_rules, sources, classified."""
    rules = check_size(rules or vocab.classify_rules())
    p = F.col(path)
    return df.withColumns({
        f"{prefix}matched_rules": matching(p, rules),
        f"{prefix}sources": matching(p, rules, lambda r: F.lit(f"rules/classify.yaml#{r.id}")),
        f"{prefix}labels": path_labels(p, rules),
        f"{prefix}classified": path_classified(p, rules)})


def classify_by_table(df: DataFrame, rules: DataFrame, key: list[str],
                      path: str = "path") -> DataFrame:
    """C-01 for rule tables (id, pattern, labels) of any size, one row per input row.

    Rules are indexed by a literal that their pattern requires; distinct paths are scanned once for
    all literals and only candidates are tried, see ``functions.literals``.
    """
    hits = match_table(df, rules, path).join(rules.select("id", "labels"), "id")
    found = hits.groupBy(path).agg(
        L.join_agg(F.col("labels")).alias("labels"),
        F.array_sort(F.collect_set("id")).alias("matched_rules"))
    return df.join(found, path, "left").withColumns({
        "labels": F.coalesce("labels", F.array(F.lit("public"))),
        "matched_rules": F.coalesce("matched_rules", F.array().cast("array<string>")),
    }).withColumn("classified", L.is_classified(F.col("labels")))


# ── C-02 ────────────────────────────────────────────────────────────────────────────────────
def egress(df: DataFrame, command: str = "command", rules: list[Rule] | None = None) -> DataFrame:
    """C-02: outbound command shapes; adds egress_rules, egress_reasons, is_egress."""
    rules = check_size(rules or vocab.EGRESS_RULES)
    cmd = F.col(command)
    return df.withColumns({
        "egress_rules": matching(cmd, rules),
        "egress_reasons": matching(cmd, rules, lambda r: F.lit(r.reason)),
        "is_egress": _any_of(cmd, rules)})


def egress_by_table(df: DataFrame, rules: DataFrame, command: str = "command") -> DataFrame:
    """C-02 for rule tables (id, pattern, reason) of any size; rules are listed by id."""
    hits = match_table(df, rules, command).join(rules.select("id", "reason"), "id")
    found = hits.groupBy(command).agg(F.array_sort(F.collect_list(F.struct("id", "reason"))).alias("_hits"))
    none = F.array().cast("array<string>")
    return df.join(found, command, "left").withColumns({
        "egress_rules": F.coalesce(F.col("_hits.id"), none),
        "egress_reasons": F.coalesce(F.col("_hits.reason"), none),
        "is_egress": F.col("_hits").isNotNull()}).drop("_hits")


# ── C-03 ────────────────────────────────────────────────────────────────────────────────────
def mentions(calls: DataFrame, key: list[str], tool: str = "tool", command: str = "command",
             path_args: list[str] = (), list_args: list[str] = ()) -> DataFrame:
    """C-03: one row per path a call touches: (key..., pos, path)."""
    found = T.mentioned_paths(F.col(tool), F.col(command), [F.col(c) for c in path_args],
                              [F.col(c) for c in list_args])
    return T.unnest(calls, found, key, "path", "pos")


# ── C-04 ────────────────────────────────────────────────────────────────────────────────────
#: Links that are unrolled into one map, at most; above, the table form ``resolve`` is used.
MAX_LINKS = 1 << 16


def _links(links: DataFrame) -> DataFrame:
    """(source, target) of a link table (path, canonical_path): absolute sources without dots, a
    relative target taken from the link's own folder. Of several targets of a link the smallest counts."""
    source = T.lexical_path(F.col("path"))
    folder = F.regexp_replace(source, "/[^/]*$", "")
    named = links.select(source.alias("source"),
                         T.absolute_path(F.col("canonical_path"), folder).alias("target"))
    return (named.where("source LIKE '/%' AND target LIKE '/%' AND source <> '/'")
            .where(F.col("source") != T.lexical_path(F.col("target")))
            .groupBy("source").agg(F.min("target").alias("target")))


def _walk(start: DataFrame, table: DataFrame, of_links: bool) -> DataFrame:
    """(key, real, loops) of ``start`` (key, now) by rounds of joins with ``table`` (source, target, loops).

    A round takes the keys not yet settled, joins all their ancestors with the links and replaces
    the longest linked one; where none is linked, the first ``..`` takes a folder away. A key
    loops once it meets a looping link. With ``of_links`` keys are the links themselves: one that
    meets itself loops, and so does, in the next round, whatever meets it.
    """
    spark = start.sparkSession
    settled = spark.createDataFrame([], "key string, real string, loops boolean")
    live = cut_lineage(start.withColumn("hops", F.lit(0)))
    loop = F.coalesce(F.col("link.loops"), F.lit(False)) | (F.col("hops") > T.MOST_LINKS)
    if of_links:
        loop = loop | F.coalesce(F.col("link.source") == F.col("key"), F.lit(False))
    while not live.isEmpty():
        at = live.withColumn("at", T.path_head(F.col("now")))
        linked = (at.select("key", F.explode(T.ancestors(F.col("at.head"))).alias("source"))
                  .join(table, "source").groupBy("key")
                  .agg(F.max_by(F.struct("source", "target", "loops"), F.length("source")).alias("link")))
        step = cut_lineage(at.join(linked, "key", "left").select(
            "key", "now", T.path_step(F.col("at"), F.col("link")).alias("new"), (F.col("hops") + 1).alias("hops"),
            loop.alias("loops")))
        done = step.where("new IS NULL OR loops").select("key", T.lexical_path(F.col("now")).alias("real"), "loops")
        settled = settled.unionByName(done)
        live = step.where("new IS NOT NULL AND NOT loops").select("key", F.col("new").alias("now"), "hops")
        if of_links:
            found = done.where("loops").select(F.col("key").alias("source"), F.lit(True).alias("_loops"))
            table = cut_lineage(table.join(found, "source", "left").select(
                "source", "target", (F.col("loops") | F.coalesce("_loops", F.lit(False))).alias("loops")))
    return settled


def real_links(links: DataFrame) -> DataFrame:
    """(source, target, loops) of a link table with every target resolved to its end."""
    table = cut_lineage(_links(links).withColumn("loops", F.lit(False)))
    found = _walk(table.select(F.col("source").alias("key"), F.col("target").alias("now")), table, True)
    return found.select(F.col("key").alias("source"), F.col("real").alias("target"), "loops")


def link_map(links: DataFrame) -> Column:
    """A link table of checked size as a map for ``text.real_path``."""
    rows = real_links(links).limit(MAX_LINKS + 1).collect()
    if len(rows) > MAX_LINKS:
        raise ValueError(f"more than {MAX_LINKS} links; use the table form")
    return F.from_json(F.lit(json.dumps({r["source"]: "" if r["loops"] else r["target"] for r in rows})),
                       "map<string,string>")


def resolve(paths: DataFrame, links: DataFrame, path: str = "path") -> DataFrame:
    """C-05: (path, canonical_path, loops) of every distinct path, links followed.

    Links are resolved first, so a path takes a round of joins for every link and ``..`` on its
    way, not for every link of a chain.  Only unsettled distinct paths are in a round.  A path
    through a loop of links keeps its lexical form; relative paths are settled lexically.
    """
    p = F.col("path")
    start = paths.select(F.col(path).alias("path")).where("path IS NOT NULL").distinct()
    found = _walk(start.where(p.startswith("/")).select(p.alias("key"), p.alias("now")),
                  cut_lineage(real_links(links)), False)
    return found.select(F.col("key").alias("path"), F.when(F.col("loops"), T.lexical_path(F.col("key"))).otherwise(
        F.col("real")).alias("canonical_path"), "loops").unionByName(
        start.where(~p.startswith("/")).select("path", T.lexical_path(p).alias("canonical_path"),
                                               F.lit(False).alias("loops")))


def canonicalise(df: DataFrame, path: str = "path", links: DataFrame | None = None,
                 cwd: Column | None = None, home: Column | None = None) -> DataFrame:
    """C-05: adds canonical_path: home and working folder put in, links followed, dots taken out."""
    full = T.absolute_path(F.col(path), cwd, home)
    if links is None:
        return df.withColumn("canonical_path", T.lexical_path(full))
    df = df.withColumn("_full", full)
    found = resolve(df, links, "_full").select(F.col("path").alias("_full"), "canonical_path")
    return df.join(found, "_full", "left").drop("_full")


def with_aliases(paths: DataFrame, aliases: DataFrame | None = None,
                 rules: list[Rule] | None = None, cwd: Column | None = None,
                 home: Column | None = None) -> DataFrame:
    """Classify the given and the resolved spelling; labels are united, never dropped.

    ``aliases(path, canonical_path)`` are links, of files or of folders above them, which only a
    filesystem knows; chains are followed.  A path classified only once resolved is a finding.
    """
    rules = check_size(rules or vocab.classify_rules())
    df = canonicalise(paths, "path", aliases, cwd, home)
    given, real = F.col("path"), F.col("canonical_path")
    moved = given != real

    def union(of) -> Column:
        return F.when(moved, F.array_union(of(given, rules), of(real, rules))).otherwise(
            of(given, rules))

    return df.withColumns({
        "labels": F.array_sort(union(path_labels)),
        "matched_rules": union(matching),
        "classified": path_classified(given, rules) | (moved & path_classified(real, rules)),
        "alias_finding": moved & path_classified(real, rules) & ~path_classified(given, rules)})


def worst_input(paths: DataFrame, key: list[str]) -> DataFrame:
    """C-04: per call the classified input with the most labels (first wins) and all of them."""
    hit = paths.where("classified")
    size = F.size("labels")
    ref = F.struct("path", "canonical_path", "labels")
    return hit.groupBy(*key).agg(
        F.max_by(ref, F.struct(size, -F.col("pos"))).alias("_w"),
        F.array_sort(F.collect_list(F.struct("pos", "path", "labels"))).alias("_all"),
        F.array_sort(F.collect_list(F.when(F.col("alias_finding"), F.col("path")))
                     ).alias("aliases"),
    ).select(*key, F.col("_w.path").alias("path"), F.col("_w.canonical_path").alias("canonical_path"),
             F.col("_w.labels").alias("labels"), "aliases",
             F.transform("_all", lambda x: F.struct(x["path"], x["labels"])).alias(
                 "classified_inputs"))


# ── C-05 / C-06 / C-07 ──────────────────────────────────────────────────────────────────────
def identify(df: DataFrame, path: str = "path", links: DataFrame | None = None,
             cwd: Column | None = None, home: Column | None = None) -> DataFrame:
    """C-05: canonical path and stable id; content is deliberately not part of the id."""
    return canonicalise(df, path, links, cwd, home).withColumn(
        "artifact_id", T.artifact_id(F.col("canonical_path")))


def binary_files(spark: SparkSession, root: str) -> DataFrame:
    """Whole files under ``root`` as (rel, content)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
            .select(F.substring_index(F.col("path"), root.rstrip("/") + "/", -1).alias("rel"),
                    "content"))


def snapshot(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """C-06: digest and size per wanted path; unreadable ones stay with present = false."""
    seen = files.select("rel", T.sha(F.col("content").cast("binary")).alias("digest"),
                        F.octet_length("content").cast("long").alias("size"))
    return wanted.join(seen, "rel", "left").withColumn("present", F.col("digest").isNotNull())


def manifest_diff(expected: DataFrame, actual: DataFrame, extra: str = "untracked") -> DataFrame:
    """C-07: one bucket per path: ok, changed, missing, or ``extra`` for unlisted ones."""
    e = expected.select("rel", F.col("digest").alias("expected"))
    a = actual.select("rel", F.col("digest").alias("actual"))
    return e.join(a, "rel", "full_outer").withColumn(
        "bucket", F.when(F.col("expected").isNull(), extra)
        .when(F.col("actual").isNull(), "missing")
        .when(F.col("actual") == F.col("expected"), "ok").otherwise("changed"))


def manifest_verdict(diff: DataFrame) -> DataFrame:
    """C-07: bucket counts and whether the tree is intact."""
    def n(bucket: str) -> Column:
        return F.count_if(F.col("bucket") == bucket).alias(bucket)

    return diff.agg(n("ok"), n("changed"), n("missing"), n("untracked"),
                    F.bool_and(F.col("bucket") == "ok").alias("intact"))


# ── C-08 / C-09 ─────────────────────────────────────────────────────────────────────────────
def find_handler(path: Column, labels: Column, handlers: list[dict]) -> Column:
    """C-08: id of the first handler whose labels overlap and whose pattern matches."""
    found = []
    for h in check_size(handlers):
        hit = F.lit(True)
        if h.get("labels"):
            hit = hit & F.arrays_overlap(labels, F.array(*[F.lit(x) for x in h["labels"]]))
        if h.get("pattern"):
            hit = hit & search(path, h["pattern"], ignore_case=True)
        found.append(F.when(hit, F.lit(h["id"])))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def handler_by_table(df: DataFrame, handlers: DataFrame, path: str = "path",
                     labels: str = "labels") -> DataFrame:
    """C-08 for handler tables (ord, id, labels, pattern) of any size: adds ``handler``.

    The first by ``ord`` whose labels overlap (or has none) and whose pattern is found (or has none).
    Patterns are tried through the literal index, labels without a pattern by their first handler.
    """
    wants = F.coalesce(F.size("wanted"), F.lit(0)) > 0
    known = handlers.select("ord", F.col("id").alias("handler"), F.col("labels").alias("wanted"), "pattern")
    by_path = known.where("pattern IS NOT NULL AND pattern <> ''")
    hits = match_table(df, by_path.select(F.col("ord").alias("id"), "pattern"), path, "(?iud)").join(
        by_path.select(F.col("ord").alias("id"), "wanted"), "id")
    # Of the handlers that fit a path, the first for each label and the first for any: calls carry no more.
    of_label = hits.where(wants).select(path, "id", F.explode("wanted").alias("_label")).where("_label IS NOT NULL")
    of_any = hits.where(~wants).select(path, "id", F.lit(None).cast("string").alias("_label"))
    per_path = (of_label.unionByName(of_any).groupBy(path, "_label").agg(F.min("id").alias("id"))
                .groupBy(path).agg(F.array_sort(F.collect_list(F.struct("id", "_label"))).alias("_tried")))
    plain = known.where("pattern IS NULL OR pattern = ''")
    by_label = (plain.where(wants).select("ord", F.explode("wanted").alias("_label")).groupBy("_label")
                .agg(F.min("ord").alias("_ord")))
    sets = df.select(F.array_sort(labels).alias("_set")).where("size(_set) > 0").distinct()
    per_set = (sets.select("_set", F.explode("_set").alias("_label")).join(by_label, "_label")
               .groupBy("_set").agg(F.min("_ord").alias("_by_label")))
    always = plain.where(~wants).agg(F.min("ord")).first()[0]
    fits = F.filter("_tried", lambda t: t["_label"].isNull()
                    | F.coalesce(F.array_contains(F.col(labels), t["_label"]), F.lit(False)))
    least = F.array_min(F.array(F.get(fits, 0)["id"], F.col("_by_label"), F.lit(always).cast("int")))
    return (df.join(per_path, path, "left").withColumn("_set", F.array_sort(labels)).join(per_set, "_set", "left")
            .withColumn("ord", least).drop("_tried", "_set", "_by_label")
            .join(known.select("ord", "handler"), "ord", "left").drop("ord"))


#: What ends a line of text in a disclosure summary.
LINE_ENDS = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"


def disclose(df: DataFrame, output: str = "output", artifact_id: str | None = None) -> DataFrame:
    """C-09: handle, line and byte counts, digest and first-line shape; never the text."""
    out = F.col(output)
    lines = F.split(out, LINE_ENDS)
    count = F.when(out == "", 0).otherwise(
        F.size(lines) - F.when(F.element_at(lines, -1) == "", 1).otherwise(0))
    by_digest = F.concat(F.lit("sha256:"), T.short_sha(out, 16))
    handle = by_digest if artifact_id is None else F.coalesce(
        F.when(F.col(artifact_id) != "", F.col(artifact_id)), by_digest)
    return (df.withColumn("handle", handle)
            .withColumn("lines", count.cast("long"))
            .withColumn("bytes", F.octet_length(out).cast("long"))
            .withColumn("digest", T.sha(out))
            .withColumn("first_line_shape", F.when(count == 0, "").otherwise(
                T.shape_mask(F.element_at(lines, 1)))))
