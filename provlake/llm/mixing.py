"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is cut into blocks: ranges of its documents' places, a seeded hash of the id. A
source's target is its number of words to take, repeats counted. It gives an exact quota of block
draws: whole passes over the source's blocks plus a part of one more pass. The tree halves the
output shards again and again and draws, at each split, how many blocks of each source go left from
the multivariate hypergeometric distribution, so every shard gets exact block counts of several
sources and each source's counts add up to its quota. The blocks of each pass stand in a seeded
random order of their own; shards cut disjoint draws from that order, and rows are shuffled inside a
shard.

A document is taken because its block is drawn. In the last pass blocks are drawn whole as long as
their documents fit the target; the last draw is filled document by document: those of its block
and of the blocks behind it, in order, each that still fits the room left. A document longer than
the room is left out of a drawn block. So a target is missed by less than the shortest document that is
left out after the last one taken, and no document is taken more than twice.

A document's size is its number of words (null and empty texts: 0; they are taken as often as
their block is and add nothing). Null is a source of its own. Rows with equal ids are taken together,
and so are rows without an id that have equal texts. One row per source passes through the driver,
in each of the few rounds that fill the last pass: sources are what weights are given to, so their
number is that of the mixture's entries. All blocks together are at most BLOCKS rows, and broadcast.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provlake.llm.common import WORD_PATTERN, fresh, lean
from provlake.session import cut_lineage, scratch_path

#: Weights in the order of the source names, repeated; taken share of all sizes; most repeats.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
#: A block has about so many words or fewer: each source has many blocks for every shard, but not
#: more than one for two documents.
BLOCK_WORDS, BLOCKS_PER_SHARD, BLOCK_ROWS = 1 << 16, 16, 2
#: Most blocks of a source, as a power of two, and of all sources together.
BLOCK_BITS, BLOCKS = 16, 1 << 17
#: Output shards: one for so many words, within these numbers.
SHARD_WORDS, SHARDS = 1 << 24, (8, 1 << 16)
SEED = 20


def words(text: str = "text"):
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def place(key: str = "doc_id", seed: int = SEED, text: str = "text"):
    """A document's place in its source, by its id or else by its text: 63 bits."""
    return F.shiftrightunsigned(F.when(F.col(key).isNull(), F.xxhash64(F.lit(seed + 7), F.col(text))).otherwise(
        F.xxhash64(F.lit(seed), F.col(key))), 1)


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            repeats: int = REPEATS) -> list[float]:
    """Words to take from each source: by weight, none above ``repeats`` times its size."""
    w = [float(x) for x in itertools.islice(itertools.cycle(weights), len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        per = left / sum(w[i] for i in open_)
        full = {i for i in open_ if per * w[i] > repeats * sizes[i]}
        for i in full or open_:
            out[i] = float(repeats * sizes[i]) if full else per * w[i]
        if not full:
            break
        left = max(0.0, left - sum(out[i] for i in full))
        open_ -= full
    return out


def split(quotas: list[int], shards: int, rng: np.random.Generator) -> np.ndarray:
    """Block counts per (shard, source): rows differ in size by one at most, columns add up."""
    counts = np.zeros((shards, len(quotas)), np.int64)
    stack = [(0, shards, np.array(quotas, np.int64))]
    while stack:
        lo, hi, have = stack.pop()
        if hi - lo == 1 or not have.sum():
            counts[lo] = have
            continue
        mid = (lo + hi) // 2
        # Shards lo..hi-1 hold total // n blocks each, the first total % n one more.
        each, more = divmod(int(have.sum()), hi - lo)
        left = rng.multivariate_hypergeometric(
            have, each * (mid - lo) + min(more, mid - lo), method="marginals")
        stack += [(lo, mid, left), (mid, hi, have - left)]
    return counts


def _block(at, bits):
    """The block that a place lies in."""
    return F.when(bits == 0, F.lit(0)).otherwise(
        F.call_function("shiftrightunsigned", at, F.lit(63) - bits)).cast("long")


def _fits(at, size, p):
    """Is a document of the last pass taken? Each step (start, most) bounds the sizes from there on."""
    return (at <= p("end")) & F.forall(
        p("steps"), lambda s: (at < s["start"]) | (size <= s["most"]))


def _scan(rows: DataFrame) -> DataFrame:
    """Per source, of one block's rows (n, room, place, size): steps, last place taken, room left."""
    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out = None, []
        for b in batches:
            for n, room, at, size in zip(b["n"], b["room"], b["place"], b["size"], strict=True):
                if n != now:
                    now, most = n, None
                    out.append([n, [], None, room])
                if size <= out[-1][3]:
                    out[-1][2] = at
                    out[-1][3] -= size
                elif most is None or size <= most:
                    most = out[-1][3]
                    out[-1][1].append((at, most))
        yield pd.DataFrame(out, columns=["n", "steps", "end", "left"]).astype({"end": "Int64"})

    return (rows.repartition("n").sortWithinPartitions("n", "place")
            .mapInPandas(run, "n int, steps array<struct<start:long,most:long>>, end long, left long"))


def _fill(places: DataFrame, plans: list[dict]) -> None:
    """Fill the last passes: adds to the plans ``steps``, ``end`` (last place taken) and ``filled``.

    ``places`` has (n, place, size). A round takes whole blocks of all documents that fit by
    themselves up to the block where their sum exceeds the room, and goes through that block in
    order. It goes on behind that block until nothing that follows fits. As the order is random, the
    room shrinks fast and rounds are few.
    """
    spark = places.sparkSession
    for p in plans:
        p |= {"steps": [], "end": None, "filled": 0, "edge": None}
    todo = {p["n"]: 0 for p in plans if p["room"]}
    while todo:
        for n, start in todo.items():
            plans[n]["steps"].append((start, plans[n]["room"] - plans[n]["filled"]))
        state = spark.createDataFrame(
            [(n, start, plans[n]["bits"], plans[n]["steps"][-1][1]) for n, start in todo.items()],
            "n int, start long, bits int, room long")
        live = (places.join(F.broadcast(state), "n").filter("place >= start AND size BETWEEN 1 AND room")
                .withColumn("block", _block(F.col("place"), F.col("bits"))))
        sums = (live.groupBy("n", "room", "block").agg(F.sum("size").alias("words"),
                                                       F.max("place").alias("end"))
                .withColumn("upto", F.sum("words").over(W.partitionBy("n").orderBy("block"))))
        full = F.col("upto") <= F.col("room")
        got = sums.groupBy("n").agg(
            F.max(F.when(full, F.col("upto"))).alias("words"), F.max(F.when(full, F.col("end"))).alias("end"),
            F.min(F.when(~full, F.col("block"))).alias("edge")).collect()
        todo, edges = {}, []
        for r in got:
            p = plans[r["n"]]
            p["filled"] += r["words"] or 0
            p["end"] = p["end"] if r["end"] is None else r["end"]
            if r["edge"] is not None:
                p["edge"] = r["edge"] if p["edge"] is None else p["edge"]
                edges.append((r["n"], r["edge"], p["room"] - p["filled"]))
        if not edges:
            break
        edge = live.drop("room").join(F.broadcast(spark.createDataFrame(
            edges, "n int, block long, room long")), ["n", "block"])
        for r in _scan(edge.select("n", "room", "place", "size")).collect():
            p = plans[r["n"]]
            p["steps"] += [tuple(x) for x in r["steps"]]
            p["end"] = p["end"] if r["end"] is None else r["end"]
            p["filled"] = p["room"] - r["left"]
        for n, at, _ in edges:
            p = plans[n]
            if p["filled"] < p["room"] and at + 1 < 1 << p["bits"]:
                todo[n] = (at + 1) << (63 - p["bits"])
    for p in plans:
        p["steps"] = [s for s in p["steps"] if p["end"] is not None and s[0] <= p["end"]]


def _apart(places: DataFrame, plans: list[dict]) -> str | None:
    """Folder of the places whose rows together are not taken though one of them would fit."""
    spark = places.sparkSession
    steps = spark.createDataFrame([(p["n"], p["end"], p["steps"]) for p in plans],
                                  "n int, end long, steps array<struct<start:long,most:long>>")
    found = (places.filter("least < size").join(F.broadcast(steps), "n")
             .filter(_fits(F.col("place"), F.col("least"), F.col)
                     & ~_fits(F.col("place"), F.col("size"), F.col)))
    path = scratch_path(spark, "mixing-apart")
    found.select("n", "place").write.parquet(path)
    return None if spark.read.parquet(path).isEmpty() else path


def _bits(rows: int, size: int, shards: int, block_words: int) -> int:
    """Number of a source's blocks, as a power of two."""
    wanted = max(size / block_words, BLOCKS_PER_SHARD * shards, 1)
    return max(0, min(math.ceil(math.log2(wanted)), int(math.log2(max(1, rows / BLOCK_ROWS))), BLOCK_BITS))


def _blocks(spark, plans: list[dict], seed: int) -> DataFrame:
    """(n, block, ranks): every block's place in the random order of each pass, the last one too."""
    rows = spark.createDataFrame([(p["n"], (1 << p["bits"]) - 1) for p in plans], "n int, top long").select(
        "n", F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("block"))
    for i in range(REPEATS + 1):
        order = W.partitionBy("n").orderBy(F.xxhash64(F.lit(seed + i), "n", "block"), "block")
        rows = rows.withColumn(f"r{i}", F.row_number().over(order).cast("long") - 1)
    return rows.select("n", "block", F.array(*[f"r{i}" for i in range(REPEATS + 1)]).alias("ranks"))


def _drawn(spark, plans: list[dict], seed: int) -> DataFrame:
    """(n, block, rank, whole, last): the shards that draw a block in the whole passes and, where it
    is reached, in the last one. Draws beyond the last drawn block fill up that draw."""
    spans = [(p["n"], k, lo, hi - 1) for p in plans
             for k, (lo, hi) in enumerate(itertools.pairwise([0, *p["bounds"]])) if hi > lo]
    draws = spark.createDataFrame(spans, "n int, shard int, lo long, hi long").select(
        "n", "shard", F.explode(F.sequence("lo", "hi")).alias("number"))
    of = spark.createDataFrame([(p["n"], 1 << p["bits"], p["whole"], p["part"]) for p in plans],
                               "n int, blocks long, passes int, part long")
    rows = _blocks(spark, plans, seed).join(F.broadcast(of), "n")
    turns = F.transform(F.sequence(F.lit(0), F.col("passes")), lambda i: F.struct(i.alias("turn"), (
        i * F.col("blocks") + F.when(i < F.col("passes"), F.get("ranks", i)).otherwise(
            F.least(F.get("ranks", i), F.col("part") - 1))).alias("number")))
    turned = rows.select("n", "block", "passes", F.get("ranks", F.col("passes")).alias("rank"),
                         F.explode(turns).alias("t")).select("*", "t.*")
    return turned.join(draws, ["n", "number"], "left").groupBy("n", "block", "passes", "rank").agg(
        F.array_sort(F.collect_list(F.when(F.col("turn") < F.col("passes"), F.struct("turn", "shard")))).alias("w"),
        F.max(F.when(F.col("turn") == F.col("passes"), F.col("shard"))).alias("last")).select(
        "n", "block", "rank", F.col("w.shard").alias("whole"), "last")


def _turned(at, rank, bits):
    """A place after its block has moved to its rank in the order of the last pass."""
    low = F.lit(63) - bits
    mask = F.call_function("shiftright", F.lit((1 << 63) - 1), bits)
    return at.bitwiseAND(mask).bitwiseOR(F.when(bits == 0, F.lit(0).cast("long")).otherwise(
        F.call_function("shiftleft", rank, low)))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
         shards: int | None = None, seed: int = SEED, block_words: int = BLOCK_WORDS) -> list[dict]:
    """One entry per source, in the order of names, null last: sizes, target, steps and shard bounds."""
    narrow = cut_lineage(
        docs.select("source", words().alias("size"), place(seed=seed).alias("place"))
        .groupBy("source", "place").agg(F.sum("size").alias("size"), F.min("size").alias("least")))
    got = sorted(narrow.groupBy("source").agg(F.sum("size"), F.max(F.col("least") < F.col("size")),
                                              F.count(F.lit(1))).collect(),
                 key=lambda r: (r[0] is None, r[0] or ""))
    wanted = targets([r[1] for r in got], weights, share)
    shards = shards or int(min(max(sum(wanted) // SHARD_WORDS, SHARDS[0]), SHARDS[1]))
    plans = []
    for n, (r, t) in enumerate(zip(got, wanted, strict=True)):
        whole = min(REPEATS, int(t // r[1])) if r[1] else 1
        room = 0 if whole == REPEATS or not r[1] else int(t - whole * r[1])
        plans.append({"n": n, "source": r[0], "source_size": r[1], "target": t, "whole": whole, "room": room,
                      "bits": _bits(r[3], r[1], shards, block_words)})
    if not plans:
        return []
    while sum(1 << p["bits"] for p in plans) > max(BLOCKS, len(plans)):
        for p in plans:
            p["bits"] = max(0, p["bits"] - 1)
    spark = docs.sparkSession
    keys = spark.createDataFrame([(p["n"], p["source"], p["bits"], p["whole"]) for p in plans],
                                 "n int, name string, bits int, turn int")
    blocks = _blocks(spark, plans, seed).withColumnRenamed("n", "of")
    named = narrow.join(F.broadcast(keys), narrow["source"].eqNullSafe(keys["name"]))
    places = named.join(F.broadcast(blocks), (F.col("n") == F.col("of")) & (
        F.col("block") == _block(F.col("place"), F.col("bits")))).select(
        "n", _turned(F.col("place"), F.get("ranks", F.col("turn")), F.col("bits")).alias("place"), "size", "least")
    _fill(places, plans)
    apart = _apart(places, plans) if any(r[2] for r in got) else None
    quotas = []
    for p in plans:
        blocks = 1 << p["bits"]
        p["part"] = 0 if not p["filled"] else blocks if p["edge"] is None else p["edge"] + 1
        p["apart"] = apart
        quotas.append(p["whole"] * blocks + p["part"])
    counts = split(quotas, shards, np.random.default_rng(seed))
    for p, q, c in zip(plans, quotas, counts.T, strict=True):
        p |= {"quota": q, "bounds": np.cumsum(c).tolist()}
    return plans


def draws(docs: DataFrame, plans: list[dict], seed: int = SEED, as_name: str = "mix") -> DataFrame:
    """``docs`` with a struct (size, source_size, target, place, draws) under ``as_name``.

    ``draws`` is an array of (copy, shard), one for each time that the document is taken; ``place``
    is where it stands in the last pass. The plan has one row per source, the blocks are bounded in
    number: both are broadcast and documents are not moved.
    """
    spark = docs.sparkSession
    schema = ("n int, name string, source_size long, target double, bits int, whole int, "
              "steps array<struct<start:long,most:long>>, end long")
    names = [x.split()[0] for x in schema.split(", ")]
    rows = [tuple(p["source"] if k == "name" else p.get(k) for k in names) for p in plans]
    pl, bl, sz, pc, ap = (fresh(x, docs.columns) for x in ("_plan", "_block", "_size", "_place", "_apart"))
    keys = spark.createDataFrame(rows, schema).select(F.struct(*names).alias(pl))
    p = lambda k: F.col(f"{pl}.{k}")
    b = lambda k: F.col(f"{bl}.{k}")
    sized = docs.select("*", words().alias(sz), place(seed=seed).alias(pc))
    joined = sized.join(F.broadcast(keys), sized["source"].eqNullSafe(p("name")))
    drawn = (_drawn(spark, plans, seed).select(F.struct("*").alias(bl)) if plans else
             spark.createDataFrame([], f"{bl} struct<n:int,block:long,rank:long,whole:array<int>,last:int>"))
    joined = joined.join(F.broadcast(drawn), (p("n") == b("n")) & (_block(F.col(pc), p("bits")) == b("block")))
    at = _turned(F.col(pc), b("rank"), p("bits"))
    fits = _fits(at, F.col(sz), p)
    folder = plans[0]["apart"] if plans else None
    if folder:
        no = spark.read.parquet(folder).select(F.struct("n", "place").alias(ap))
        joined = joined.join(no, (at == F.col(f"{ap}.place")) & (p("n") == F.col(f"{ap}.n")), "left")
        fits = fits & F.col(ap).isNull()
    shards = F.concat(b("whole"), F.when(fits & b("last").isNotNull(), F.array(b("last"))).otherwise(
        F.array().cast("array<int>")))
    taken = F.transform(shards, lambda s, i: F.struct(i.alias("copy"), s.alias("shard")))
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.struct(F.col(sz).alias("size"), p("source_size").alias("source_size"),
                 p("target").alias("target"), at.alias("place"), taken.alias("draws"))
        .alias(fresh(as_name, docs.columns)))


def mix(docs: DataFrame, plans: list[dict], seed: int = SEED) -> DataFrame:
    """The mixed rows: the columns of ``docs``, one row for each draw, with ``_shard`` at its end
    (a longer name where taken), shuffled inside each shard.

    A document travels once to each of its shards, however often that shard draws it.
    """
    m, d, s = (fresh(x, docs.columns) for x in ("_mix", "_draw", "_shard"))
    given = [F.col(f"`{c}`") for c in docs.columns]
    taken = draws(docs, plans, seed, m)
    moved = taken.select(*given, F.col(f"{m}.draws").alias(d), F.explode(
        F.array_distinct(F.col(f"{m}.draws.shard"))).alias(s)).repartition(s)
    copies = F.filter(d, lambda x: x["shard"] == F.col(s))
    return (moved.select(*given, s, F.explode(F.transform(copies, lambda x: F.xxhash64(
        F.lit(seed + 1), F.col("doc_id"), x["copy"]))).alias(d))
        .sortWithinPartitions(s, d).select(*given, s))
