"""Mixing sources to target weights: exact block quotas, a splitting tree over output shards, disjoint permuted blocks. Spark expressions alone."""

from __future__ import annotations

from math import ceil, log2
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is repeated so many times at most.
MOST = 3
#: Documents of a block on average, words of an output shard at most on average, least number of shards as a power of two, and blocks whose words are
#: summed together first.
BLOCK, SHARD_WORDS, LEAST_LEVELS, GROUP = 256, 8 << 20, 3, 1024
#: Levels of the tree that one task splits; the nodes below are dealt over all tasks.
TRUNK = 10
SEED = 17


class Mix(NamedTuple):
    rows: DataFrame
    draws: DataFrame
    shards: int


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: source, sid (rank by code point, null last), words, n, weight, target.

    Sources share all words by weight; no target exceeds most * words, and the excess goes to the others by weight, until none is above. In order of
    words / weight, a source is at its limit just if its share of what the earlier ones leave is over it.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    per = per.withColumn("sid", F.row_number().over(Wd.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("sid") % len(weights) + 1).cast("double"))
    everything, order = Wd.partitionBy(), Wd.orderBy(F.col("words") / F.col("weight"), "sid")
    per = per.withColumn("total", F.sum("words").over(everything)).withColumn("before", F.coalesce(F.sum("words").over(order.rowsBetween(Wd.unboundedPreceding, -1)), F.lit(0)) * most)
    per = per.withColumn("from_here", F.sum("weight").over(order.rowsBetween(0, Wd.unboundedFollowing)))
    per = per.withColumn("full", F.col("words") * most * F.col("from_here") <= F.col("weight") * (F.col("total") - F.col("before")))
    left = F.sum(F.when(F.col("full"), F.col("words") * most).otherwise(0)).over(everything)
    share = F.col("weight") * (F.col("total") - left) / F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("words") * F.lit(float(most))).otherwise(F.least(share, F.col("words") * F.lit(float(most))))
    return per.select("source", "sid", "words", "n", "weight", target.alias("target"))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hypergeometric(hits: Column, total: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` out of `total` items are among the `hits`: the inverse of the distribution function at u, from the mode outwards.

    Probabilities follow from each other by ratios, from 1 at the mode. The walk ends 20 steps and 10 standard deviations from the mode; what lies beyond
    is below the precision of a double.
    """
    p = F.struct(hits.alias("K"), total.alias("T"), drawn.alias("n"), u.alias("u"))

    def limits(p: Column) -> Column:
        share = p["K"] / F.greatest(p["T"], F.lit(1.0))
        reach = F.ceil(10 * F.sqrt(F.greatest(p["n"] * share * (1 - share), F.lit(0.0)))).cast("double") + 20
        return F.struct(p.alias("p"), F.greatest(F.lit(0.0), p["n"] + p["K"] - p["T"]).alias("low"), F.least(p["n"], p["K"]).alias("high"), reach.alias("reach"), F.floor((p["n"] + 1) * (p["K"] + 1) / (p["T"] + 2)).cast("double").alias("mode"))

    def walk(q: Column) -> Column:
        K, N, n, mode = q["p"]["K"], q["p"]["T"], q["p"]["n"], q["mode"]
        up, down = F.least(q["high"], mode + q["reach"]) - mode, mode - F.greatest(q["low"], mode - q["reach"])
        return F.struct(K.alias("K"), n.alias("n"), (N - K - n).alias("r"), mode.alias("mode"), up.alias("up"), q["p"]["u"].alias("u"), F.sequence(F.lit(0), (up + down).cast("int")).alias("steps"))

    def found(v: Column) -> Column:
        at = lambda k, w: F.struct(k.alias("k"), w.alias("w"))

        def step(last: Column, j: Column) -> Column:
            last = F.when(j == v["up"] + 1, at(v["mode"], F.lit(1.0))).otherwise(last)
            rise = lambda x: at(x["k"] + 1, x["w"] * (v["K"] - x["k"]) * (v["n"] - x["k"]) / ((x["k"] + 1) * (v["r"] + x["k"] + 1)))
            fall = lambda x: at(x["k"] - 1, x["w"] * x["k"] * (v["r"] + x["k"]) / ((v["K"] - x["k"] + 1) * (v["n"] - x["k"] + 1)))
            return _let(last, lambda x: F.when(j == 0, x).when(j <= v["up"], rise(x)).otherwise(fall(x)))

        first = at(v["mode"], F.lit(1.0))
        add = lambda a, j: _let(step(a["x"], j), lambda x: F.struct(x.alias("x"), (a["sum"] + x["w"]).alias("sum")))
        whole = F.aggregate(v["steps"], F.struct(first.alias("x"), F.lit(0.0).alias("sum")), add)["sum"]
        find = lambda a, j: _let(step(a["x"], j), lambda x: F.struct(x.alias("x"), (a["left"] - x["w"]).alias("left"), F.when(a["k"].isNull() & (a["left"] < x["w"]), x["k"]).otherwise(a["k"]).alias("k")))
        start = F.struct(first.alias("x"), (v["u"] * whole).alias("left"), F.lit(None).cast("double").alias("k"))
        return F.coalesce(F.aggregate(v["steps"], start, find)["k"], v["mode"])

    return _let(_let(_let(p, limits), walk), found)


def split_quotas(quotas: DataFrame, levels: int = LEAST_LEVELS, seed: int = SEED) -> DataFrame:
    """(sid, quota) to (shard, sid, blocks): a binary tree whose every node deals its blocks to its two halves by a multivariate hypergeometric draw.

    A node's row is the vector of its quotas; sources are drawn one after another from what is left. Sums over shards are the quotas, exactly, and
    shards of one tree differ by a block at most.
    """
    node = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("sid", F.col("quota").cast("double").alias("q")))), lambda x: x["q"]).alias("q")).withColumn("node", F.lit(1))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    half = F.floor((total(F.col("q")) + (F.xxhash64(F.lit(seed), "node").bitwiseAND(1))) / 2).cast("double")

    def draw(a: Column, hits: Column) -> Column:
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("node"), F.size(a["out"])), 11).cast("double") / 2.0**53
        return _let(_hypergeometric(hits, a["total"], a["half"], u), lambda x: F.struct((a["total"] - hits).alias("total"), (a["half"] - x).alias("half"), F.concat(a["out"], F.array(x)).alias("out")))

    start = F.struct(total(F.col("q")).alias("total"), half.alias("half"), F.array().cast("array<double>").alias("out"))
    left = F.aggregate("q", start, draw)["out"]
    side = lambda k, q: F.struct((F.col("node") * 2 + k).alias("node"), q.alias("q"))
    halves = F.explode(F.array(side(0, F.col("left")), side(1, F.zip_with("q", "left", lambda q, x: q - x)))).alias("x")
    for level in range(levels):
        node = node.repartition("node") if level == TRUNK else node
        node = node.select("node", "q", left.alias("left")).select(halves).select("x.node", "x.q")
    return node.select((F.col("node") - 2**levels).alias("shard"), F.posexplode("q").alias("sid", "blocks")).withColumn("blocks", F.col("blocks").cast("long"))


def _rank(block: Column, epoch: Column, bits: Column, sid: Column, seed: int) -> Column:
    """Where a block stands in an epoch: a permutation of 0 .. 2^bits - 1 for each source and epoch, without sorting."""
    mask = F.expr("shiftleft(1L, bits) - 1")
    h = lambda k: F.xxhash64(F.lit(seed + k), sid, epoch)
    return (block.bitwiseXOR(h(1).bitwiseAND(mask)) * (h(2).bitwiseAND(F.lit(0xFFFFFFFE)) + 1) + h(3).bitwiseAND(F.lit(0xFFFFFFFF))).bitwiseAND(mask)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, most: int = MOST, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> Mix:
    """rows: doc_id, source, size, source_size, target, one per document. draws: doc_id, source, copy, shard, position, one per drawn copy. shards: how many,
    a power of two, from the mix's words over shard_words.

    1. A source's target is met by whole epochs over it and a part of one more. Documents are dealt to blocks by a hash of their id, and an epoch has
       the blocks in a permutation of its own. The part is the beginning of its epoch: its last block is found from sums of groups of blocks, and of
       that block (of about `block` documents) comes each document that still fits, the longest first, and the next if that is nearer.
    2. The numbers of blocks so fixed are split over the shards (split_quotas), and each shard takes the next blocks of each source's sequence:
       shards' blocks are disjoint, and shards are as mixed as chance makes them.
    3. position orders a shard's rows at random.

    All draws are hashes of ids and the seed, so reruns agree. Text null or without words: size 0. Source null: a source, the last. A doc_id that repeats
    within a source is drawn as one unit. doc_id null: as one unit per source. An empty table gives no rows. Other columns are not read.
    The table of sources and the numbers of blocks by shard and source are small; nothing of documents reaches one task or the driver.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = scratch.keep(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size")), "sizes")
    sources = source_targets(sizes, weights, most)
    sources = sources.withColumn("full", F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words") + 1e-12)).otherwise(0).cast("long"))
    sources = sources.withColumn("part", F.greatest(F.lit(0.0), F.col("target") - F.col("full") * F.col("words")))
    sources = scratch.keep(sources.withColumn("bits", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / block))).cast("int")), "sources")
    words = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    levels = max(LEAST_LEVELS, ceil(log2(max(1.0, words / shard_words))))
    here = sizes.alias("d").join(sources.alias("s"), F.expr("d.source <=> s.source")).select("d.*", *(f"s.{c}" for c in ("sid", "words", "target", "full", "part", "bits")))
    rows = here.select("doc_id", "source", "size", F.col("words").alias("source_size"), "target")
    units = here.groupBy("doc_id", "sid", "full", "bits", "part").agg(F.sum("size").alias("size"), F.first("source").alias("source"))
    units = units.withColumn("block", F.xxhash64(F.lit(seed), "doc_id").bitwiseAND(F.expr("shiftleft(1L, bits) - 1")))
    units = scratch.keep(units.withColumn("rank", _rank(F.col("block"), F.col("full"), F.col("bits"), F.col("sid"), seed)), "units")

    def last(sums: DataFrame, key: str) -> DataFrame:
        """The row of each source in which its running sum reaches `part`; `part` becomes what is left for it."""
        run = F.sum("size").over(Wd.partitionBy("sid").orderBy(key))
        sums = sums.withColumn("run", run).filter("part > run - size and part <= run")
        return sums.groupBy("sid").agg(F.min(F.struct(key, (F.col("part") - F.col("run") + F.col("size")).alias("part"))).alias("x")).select("sid", "x.*")

    blocks = scratch.keep(units.groupBy("sid", "rank").agg(F.sum("size").alias("size"), F.first("part").alias("part")).withColumn("group", F.floor(F.col("rank") / GROUP)), "blocks")
    groups = last(blocks.groupBy("sid", "group").agg(F.sum("size").alias("size"), F.first("part").alias("part")), "group")
    edge = scratch.keep(last(blocks.drop("part").join(groups, ["sid", "group"]), "rank").withColumnRenamed("rank", "edge"), "edge")
    one = F.struct((-F.col("size")).alias("less"), F.xxhash64(F.lit(seed + 9), "doc_id").alias("h"), "doc_id", "size")
    inside = units.drop("part").join(edge, "sid").filter("rank = edge").groupBy("sid").agg(F.array_sort(F.collect_list(one)).alias("all"), F.first("part").alias("part"))

    def fit(a: Column, x: Column) -> Column:
        taken = F.struct((a["left"] - x["size"]).alias("left"), F.concat(a["out"], F.array(x["doc_id"])).alias("out"), a["over"].alias("over"))
        return F.when(x["size"] <= a["left"], taken).otherwise(F.struct(a["left"].alias("left"), a["out"].alias("out"), x.alias("over")))

    def nearest(a: Column) -> Column:
        more = a["over"].isNotNull() & (a["over"]["size"] - a["left"] < a["left"])
        return F.when(more, F.concat(a["out"], F.array(a["over"]["doc_id"]))).otherwise(a["out"])

    start = F.struct(F.col("part").cast("double").alias("left"), F.array().cast("array<long>").alias("out"), F.lit(None).cast("struct<less:long,h:long,doc_id:long,size:long>").alias("over"))
    taken = F.aggregate("all", start, fit, nearest)
    inside = inside.select("sid", F.explode(taken).alias("doc_id"), F.lit(1).alias("extra"))
    copies = units.join(edge.select("sid", "edge"), "sid", "left").alias("u").join(inside.alias("i"), F.expr("u.sid = i.sid and u.doc_id <=> i.doc_id"), "left")
    copies = copies.select("u.*", (F.col("full") + F.when(F.col("rank") < F.col("edge"), 1).otherwise(0) + F.coalesce("extra", F.lit(0))).alias("copies"))
    quotas = sources.join(edge, "sid", "left").select("sid", (F.col("full") * F.expr("shiftleft(1L, bits)") + F.coalesce(F.col("edge") + 1, F.lit(0))).alias("quota"))
    dealt = split_quotas(quotas, levels, seed).withColumn("end", F.sum("blocks").over(Wd.partitionBy("sid").orderBy("shard"))).filter("blocks > 0")
    dealt = scratch.keep(dealt.select("sid", "shard", F.explode(F.expr("sequence(end - blocks, end - 1)")).alias("place")), "dealt")
    drawn = copies.filter("copies > 0").select("*", F.explode(F.expr("sequence(0L, copies - 1)")).alias("copy"))
    drawn = drawn.withColumn("place", F.col("copy") * F.expr("shiftleft(1L, bits)") + _rank(F.col("block"), F.col("copy"), F.col("bits"), F.col("sid"), seed))
    draws = drawn.join(dealt, ["sid", "place"]).select("doc_id", "source", "copy", "shard", F.xxhash64(F.lit(seed + 5), "doc_id", "copy", "sid").alias("position"))
    return Mix(rows, draws, 2**levels)


def mixed_rows(docs: DataFrame, draws: DataFrame, shards: int, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The mix itself: docs' rows, once per draw, with copy, shard and position, which replace columns of these names; partition i has shard i, in the order of position."""
    own = draws.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "copy", "shard", "position")
    rows = docs.drop("copy", "shard", "position")
    same = rows[id_col].cast("long").eqNullSafe(own["_id"]) & rows[source_col].cast("string").eqNullSafe(own["_source"])
    out = rows.join(own, same).drop(own["_id"], own["_source"])
    return out.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("position")
