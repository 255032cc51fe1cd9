"""String, hash and JSON expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake import vocab
from provlake.functions.rules import CASE_SENSITIVE, strings


def sha(value: Column) -> Column:
    return F.sha2(value, 256)


def short_sha(value: Column, width: int) -> Column:
    return F.substring(sha(value), 1, width)


def absolute_path(path: Column, cwd: Column | None = None, home: Column | None = None) -> Column:
    """``~`` and relative spellings under the given home and working folder.

    Where a folder is not given or null the spelling stays as it is.
    """
    if home is not None:
        path = F.when((path == "~") | path.startswith("~/"), F.coalesce(
            F.concat(home, F.substr(path, F.lit(2))), path)).otherwise(path)
    if cwd is not None:
        path = F.when(path.startswith("/"), path).otherwise(
            F.coalesce(F.concat(cwd, F.lit("/"), path), path))
    return path


def _joined(parts: Column, absolute: Column) -> Column:
    return F.concat(F.when(absolute, "/").otherwise(""), F.array_join(parts, "/"))


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))


def lexical_path(path: Column) -> Column:
    """A path with ``.``, ``..``, ``//`` and a trailing slash resolved by its letters alone.

    A relative path stays relative (see ``absolute_path``) and keeps the ``..`` it begins with.
    Links are only known as data: ``operators.artifacts.resolve`` or ``real_path`` follow them.
    """
    absolute = path.startswith("/")
    kept = F.aggregate(
        _parts(path), F.array().cast("array<string>"),
        lambda acc, x: F.when(x != "..", F.concat(acc, F.array(x))).when(
            (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."),
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        ).when(absolute, acc).otherwise(F.concat(acc, F.array(x))))
    needs_work = path.rlike(r"//|(^|/)\.{1,2}(/|$)|.+/$")
    text = _joined(kept, absolute)
    return F.when(needs_work, F.when(text == "", ".").otherwise(text)).otherwise(path)


def path_head(path: Column) -> Column:
    """(head, rest): the folders before the first ``..`` of an absolute path, and what follows."""
    parts = _parts(path)
    up = F.array_position(parts, "..").cast("int")
    n = F.when(up > 0, up - 1).otherwise(F.size(parts))
    return F.struct(F.slice(parts, 1, n).alias("head"),
                    F.slice(parts, n + 1, F.size(parts)).alias("rest"))


def ancestors(head: Column) -> Column:
    """Absolute paths of a folder list: its first folder, the first two, ..., all."""
    return F.transform(head, lambda _, i: _joined(F.slice(head, 1, i + 1), F.lit(True)))


def path_step(at: Column, link: Column) -> Column:
    """One step of a resolution: ``link`` (source, target) replaces the linked ancestor of
    ``at`` (head, rest); without a link the first ``..`` takes the last folder away.
    NULL where nothing is left to do."""
    head, rest = at["head"], at["rest"]
    below = F.slice(head, F.size(_parts(link["source"])) + 1, F.greatest(F.size(head), F.lit(1)))
    popped = F.slice(head, 1, F.greatest(F.size(head) - 1, F.lit(0)))
    return F.when(link.isNotNull(), F.concat(
        link["target"], F.lit("/"), F.array_join(F.concat(below, rest), "/"))).when(
        F.size(rest) > 0, _joined(F.concat(popped, F.slice(rest, 2, F.size(rest))), F.lit(True)))


#: Fixed value: as many links as a system follows in one path.
MOST_LINKS = 40


def bound(value: Column, of) -> Column:
    """``of(value)`` with the value computed once, however often ``of`` uses it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def real_path(path: Column, links: Column) -> Column:
    """An absolute path with links followed and ``..`` taken after them, for a map of links.

    Row-local form of ``operators.artifacts.resolve``, for ``operators.artifacts.link_map``: a
    link table of checked size, whose own targets are resolved and empty for loops. A path through
    a loop keeps its lexical form.
    """
    def stepped(acc: Column, at: Column, source: Column) -> Column:
        link = F.when(source.isNotNull(), F.struct(
            source.alias("source"), F.try_element_at(links, source).alias("target")))

        def moved(link: Column) -> Column:
            loops = F.coalesce(link["target"] == "", F.lit(False)) | (acc["hops"] >= MOST_LINKS)
            return bound(F.when(~loops, path_step(at, link)), lambda new: F.struct(
                F.coalesce(new, acc["path"]).alias("path"), (acc["hops"] + 1).alias("hops"),
                new.isNull().alias("done"), loops.alias("loops")))
        return bound(link, moved)

    def step(acc: Column, _: Column) -> Column:
        return F.when(acc["done"], acc).otherwise(bound(path_head(acc["path"]), lambda at: bound(
            F.try_element_at(F.filter(ancestors(at["head"]), lambda a: F.map_contains_key(links, a)), F.lit(-1)),
            lambda source: stepped(acc, at, source))))

    start = F.struct(path.alias("path"), F.lit(0).alias("hops"), F.lit(False).alias("done"),
                     F.lit(False).alias("loops"))
    return F.when(path.startswith("/"), bound(
        F.aggregate(F.sequence(F.lit(0), F.lit(MOST_LINKS)), start, step), lambda out: F.when(
            out["loops"], lexical_path(path)).otherwise(lexical_path(out["path"])))).otherwise(lexical_path(path))


def artifact_id(canonical: Column) -> Column:
    return F.concat(F.lit("art_"),
                    short_sha(F.concat(F.lit(vocab.ARTIFACT_ID_PREFIX), canonical), 16))


def hex_id(seed: Column, width: int) -> Column:
    """Deterministic hex id of fixed width."""
    return short_sha(F.concat(F.lit(vocab.SPAN_ID_PREFIX), F.coalesce(seed, F.lit(""))), width)


def proof_ref(seq: Column, digest: Column) -> Column:
    return F.concat_ws(":", F.lit(vocab.PROOF_REF_PREFIX), seq.cast("string"),
                       F.substring(digest, 1, 16))


def unix_nanos(ts: Column) -> Column:
    """ISO-8601 text to unix nanoseconds; 0 where it does not parse."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(ts)) * 1000, F.lit(0))


def json_at(body: Column, path: str) -> Column:
    """Canonical JSON text at a dotted path: NULL when absent, ``'null'`` when JSON null."""
    return F.to_json(F.try_variant_get(body, f"$.{path}", "variant"))


def string_at(body: Column, path: str) -> Column:
    """The scalar at a dotted path as a string; NULL when absent or JSON null."""
    return F.try_variant_get(body, f"$.{path}", "string")


def is_falsy(json: Column) -> Column:
    """Absent, null, false, zero or empty."""
    return json.isNull() | json.isin("null", "false", "0", "0.0", "-0", '""', "[]", "{}")


def is_list(json: Column) -> Column:
    return F.coalesce(json.startswith("["), F.lit(False))


def shape_mask(line: Column, width: int = 60) -> Column:
    """Digits as N, letters as A, the rest kept."""
    cut = F.substring(line, 1, width)
    return F.regexp_replace(F.regexp_replace(cut, r"\p{L}", "A"), r"(?U)\p{Nd}", "N")


def mentioned_paths(tool: Column, command: Column, path_args: list[Column],
                    list_args: list[Column] = ()) -> Column:
    """Every path a tool call plausibly touches, in order, without repeats (C-03)."""
    empty = F.array().cast("array<string>")
    cmd = F.when(tool == "Bash", command)
    found = [F.coalesce(F.regexp_extract_all(cmd, F.lit(CASE_SENSITIVE + p), F.lit(1)), empty)
             for p in vocab.COMMAND_PATH_PATTERNS]
    args = strings(*[F.when(a != "", a) for a in path_args]) if path_args else empty
    lists = [F.coalesce(a, empty) for a in list_args]
    return F.array_distinct(F.concat(args, *found, *lists))


def python_repr(value: Column) -> Column:
    """How a plain string is quoted in a finding."""
    return F.concat(F.lit("'"), value, F.lit("'"))


def unnest(df: DataFrame, array: Column, keep: list, name: str, pos: str = "_pos") -> DataFrame:
    """One row per array element.

    The plain generator makes the optimizer test the array's size below the projection, which
    evaluates a computed array twice or more; the outer form does not.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, name)).where(
        F.col(pos).isNotNull())
