"""Near-duplicate documents: SetSketch registers, banding, joint likelihood, exact check."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from . import words as W
from .components import connected
from .scratch import Scratch

U = np.uint64
#: Registers of a sketch, base of their exponential spacing, rate of the hash values.
REGISTERS, BASE, RATE = 256, 1.001, 20.0
#: Registers in a band. At similarity 0.75, no band of the 51 agrees for 1 pair in 900,000, if registers are independent, as they are of large sets.
ROWS = 5
#: Sets of up to so many shingles have few independent registers; pairs with one of them meet by shingles too, which loses none.
EXACT = 16
#: A pair goes on to the exact check unless its likelihood at every similarity over the threshold is below exp(-SLACK) of its best.
SLACK = 12.0
#: Pairs of a document that are checked before any components are known, documents of a tile, and their shingles together.
FIRST, TILE, TILE_SHINGLES = 4, 1024, 4 << 20
SEED = W.odd(4, 21)
BAND = W.odd(8, 22)


def setsketch(h: np.ndarray, at: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """The registers of each set of distinct hashes, as uint16; h[at[i]:at[i+1]] is set i.

    Level j deals every element to one register, by a permutation of its own, with a value in the j-th of m intervals that are equally likely under
    an exponential law. A register's minimum comes from the first level that reaches it, so later levels run only for sets with open registers.
    Minima are truncated to powers of BASE. Registers of a union are the larger ones of its parts.
    """
    n = len(at) - 1
    best = np.full(n * m, np.iinfo(U).max, U)
    sets = np.repeat(np.arange(n), np.diff(at))
    z = W.mix(h ^ SEED[0])
    start, stride = z & U(m - 1), ((z >> U(20)) & U(m - 1)) | U(1)
    live, open_ = np.arange(len(h)), np.diff(at) > 0
    for j in range(m):
        register = (start[live] + U(j) * stride[live]) & U(m - 1)
        value = W.mix(h[live] + SEED[1] * np.array([j + 1], U)) >> U(11)
        np.minimum.at(best, sets[live] * m + register.astype(np.int64), value + U(j << 53))
        open_ &= (best.reshape(n, m) == np.iinfo(U).max).any(1)
        if not open_.any():
            break
        live = live[open_[sets[live]]]
    share = ((best >> U(53)).astype(float) + (best & U(2**53 - 1)).astype(float) / 2**53) / m
    with np.errstate(divide="ignore", over="ignore"):
        x = -np.log1p(-np.minimum(share, 1 - 1e-12)) / RATE
        k = np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE))
    return np.clip(k, 0, 65535).astype(np.uint16).reshape(n, m)


def _bands(registers: np.ndarray, rows: int) -> np.ndarray:
    n, m = registers.shape
    parts = registers[:, : m // rows * rows].reshape(n, m // rows, rows).astype(U)
    h = np.zeros(parts.shape[:2], U)
    for i in range(rows):
        h = W.mix(h + parts[:, :, i] * BAND[i] + U(i + 1))
    return W.mix(h + np.arange(1, m // rows + 1, dtype=U) * BAND[7])


SKETCH = "doc_id long, n int, d1 long, d2 long, registers binary, bands array<long>"


def _prefixes(s: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the small sets, and how many each set has: the smallest of its hashes, as many as leave fewer than a linked set must share. Two linked sets
    have one of them in common."""
    n = np.diff(at)
    small = (n > 0) & (n * percent <= EXACT * 100)
    many = np.where(small, n - -(-n * percent // 100) + 1, 0)
    place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(at[:-1], many)
    return W.mix(s[place] ^ BAND[6]), many


def _sketch(batches, k: int, rows: int, percent: int):
    for batch in batches:
        ids = batch.column(0)
        for a, b, h, first in W.texts(batch.column(1), True):
            s, at = W.distinct(*W.shingles(h, first, k), b - a)
            registers = setsketch(s, at)
            sums = [np.concatenate([[U(0)], np.cumsum(W.mix(s ^ x))]) for x in SEED[2:4]]
            full = np.diff(at) > 0
            bands = _bands(registers, rows)[full]
            keys, many = _prefixes(s, at, percent)
            owner = np.concatenate([np.repeat(np.flatnonzero(full), bands.shape[1]), np.repeat(np.arange(b - a), many)])
            keys = np.concatenate([bands.ravel(), keys])[np.argsort(owner, kind="stable")]
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=b - a))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(np.diff(at).astype(np.int32)), *(pa.array(W.signed(c[at[1:]] - c[at[:-1]])) for c in sums), pa.array([r.tobytes() if f else None for r, f in zip(registers, full, strict=True)], pa.binary()), pa.ListArray.from_arrays(ends, W.signed(keys))], ["doc_id", "n", "d1", "d2", "registers", "bands"])


def likelihood(ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The most likely similarity of each pair given both sketches and both set sizes, and the log-likelihood that it loses at best beyond threshold."""
    equal, more = (ka == kb).sum(1), (ka > kb).sum(1)
    less = ka.shape[1] - equal - more
    u, v = na / (na + nb), nb / (na + nb)
    most = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 201)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    out, loss = np.empty(len(na)), np.empty(len(na))
    for k in range(0, len(na), 4096):
        s = slice(k, k + 4096)
        j = most[s, None] * grid
        up, down = p(u[s, None] - v[s, None] * j), p(v[s, None] - u[s, None] * j)
        log = lambda x: np.log(np.maximum(x, 1e-12))
        value = more[s, None] * log(up) + less[s, None] * log(down) + equal[s, None] * log(1 - up - down)
        out[s] = j[np.arange(len(j)), value.argmax(1)]
        loss[s] = value.max(1) - np.where(j >= np.minimum(threshold, most[s, None]), value, -np.inf).max(1)
    return out, loss


def _chance(na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """The least share of agreeing registers that a pair may have: 4 standard deviations below the threshold for small sets, whose registers are as
    few as their shingles, and 7 for others."""
    n = np.minimum(na, nb)
    return threshold - np.where(n <= EXACT, 4 * np.sqrt(threshold * (1 - threshold) / np.maximum(n, 1)), 0.2)


def plausible(ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The most likely similarity of each pair, and whether the exact check must decide."""
    j, loss = likelihood(ka, kb, na, nb, threshold)
    small = np.minimum(na, nb) <= EXACT
    return j, np.where(small, (ka == kb).mean(1) >= _chance(na, nb, threshold), loss <= SLACK)


def _likely(batches, threshold: float):
    for batch in batches:
        a, b, na, nb = (batch.column(i) for i in range(4))
        ka, kb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
        j, keep = plausible(ka, kb, na.to_numpy().astype(float), nb.to_numpy().astype(float), threshold)
        yield pa.RecordBatch.from_arrays([a, b, pa.array(j)], ["a", "b", "j"]).filter(pa.array(keep))


class _Union:
    """Which of a few numbered things are joined so far."""

    def __init__(self, n: int):
        self.to = list(range(n))

    def find(self, x: int) -> int:
        while self.to[x] != x:
            self.to[x] = x = self.to[self.to[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.to[max(x, y)] = min(x, y)
        return x != y


def _meet(table: pa.Table, threshold: float) -> pa.Table:
    """Likely pairs of one tile of one bucket, as few as join the same clusters: columns id, cluster, n, registers, i, j, t."""
    ids, cluster, n, t = (np.asarray(table.column(c).combine_chunks()) for c in ("id", "cluster", "n", "t"))
    registers = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    number = np.unique(cluster, return_inverse=True)[1]
    same = bool((t == t[0]).all()) and table.column("i")[0] == table.column("j")[0]
    joined, out, root = _Union(int(number.max()) + 1), [], number.copy()
    for x in range(len(ids) - 1):
        y = np.arange(x + 1, len(ids))
        y = y[(root[y] != root[x]) & (n[y] >= threshold * n[x]) & (n[x] >= threshold * n[y]) & (same | (t[y] != t[x]))]
        if len(y):
            # agreeing registers beyond any doubt too few for the threshold
            y = y[(registers[y] == registers[x]).mean(1) >= _chance(n[x], n[y], threshold)]
        if len(y):
            ok = plausible(registers[[x] * len(y)], registers[y], n[[x] * len(y)].astype(float), n[y].astype(float), threshold)[1]
            new = [(ids[x], ids[i]) for i in y[ok] if joined.join(int(number[x]), int(number[i]))]
            if new:
                out += new
                root = np.array([joined.find(int(k)) for k in number])
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table({"u": pa.array(a, pa.int64()), "v": pa.array(b, pa.int64())})


def _check(table: pa.Table, percent: int) -> pa.Table:
    """Links between the strays of one tile and all documents of another, as few as join the same components: columns id, component, probe, s."""
    ids, component, probe = (np.asarray(table.column(c).combine_chunks()) for c in ("id", "component", "probe"))
    lists = table.column("s").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(np.asarray(lists.offsets))
    code = np.unique(np.asarray(lists.flatten()), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(ids)), sizes)
    order = np.argsort(code, kind="stable")
    at = np.searchsorted(code[order], np.arange(int(code.max()) + 2))
    at_doc = np.concatenate([[0], np.cumsum(sizes)])
    number = np.unique(component, return_inverse=True)[1]
    joined, out = _Union(int(number.max()) + 1), []
    for x in np.flatnonzero(probe):
        own = code[at_doc[x] : at_doc[x + 1]]
        many = at[own + 1] - at[own]
        place = np.repeat(at[own] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        both = np.bincount(owner[order[place]], minlength=len(ids))
        for y in np.flatnonzero((100 * both >= percent * (sizes[x] + sizes - both)) & (number != number[x])):
            if joined.join(int(number[x]), int(number[y])):
                out.append((ids[x], ids[y]))
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table({"u": pa.array(a, pa.int64()), "v": pa.array(b, pa.int64())})


def _sets(batches, k: int):
    for batch in batches:
        ids = batch.column(0)
        for a, b, h, first in W.texts(batch.column(1), True):
            s, at = W.distinct(*W.shingles(h, first, k), b - a)
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.ListArray.from_arrays(at.astype(np.int32), W.signed(s))], ["id", "s"])


def _open(scratch: Scratch, name: str, rows: DataFrame, within: list[str], part: str, percent: int) -> DataFrame:
    """The ids of rows (id, within, part, s) that may be linked with a row of another part: of those, enough shingles occur in another part.

    A document that is linked with another shares at least percent of its own shingles with it. So one that shares fewer with all documents of other parts
    together has no such link, and pages of one template with a body of their own go here, however many they are, without being compared. The shared
    shingles are written before they are joined, so that one in very many documents is split by the join.
    """
    one = rows.select(*within, "id", part, F.size("s").alias("n"), F.explode("s").alias("x"))
    shared = scratch.keep(one.groupBy(*within, "x").agg(F.min(part).alias("low"), F.max(part).alias("high")).filter("low < high").select(*within, "x"), f"{name}-shared")
    found = one.join(shared.hint("merge"), [*within, "x"]).groupBy("id").agg(F.count("*").alias("many"), F.first("n").alias("n"))
    found = scratch.keep(found.filter(f"100 * many >= {percent} * n").select("id"), name)
    scratch.drop(f"{name}-shared")
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, words: int = 5, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A document's set holds the distinct hashes (64 bits) of its lower-cased runs of `words` words; a shorter text has its whole sequence as one. Documents are
    linked where 100 * intersection >= percent * union; component_id is the smallest doc_id reachable, kept marks the document that has it.

    1. One pass makes each document's SetSketch. Equal sets become one representative before anything else.
    2. Representatives meet in buckets of `rows` registers. In a bucket each is paired with the smallest and the largest id, so pairs grow with the rows.
       Pairs whose joint likelihood allows the threshold join clusters; in buckets where several clusters meet, all pairs across them are estimated, and
       as many returned as join the same clusters. So a cluster holds every pair that shares a bucket and may be linked: no bucket is capped.
    3. Of each document's pairs the likeliest few are checked on full sets; links give components.
    4. In a cluster that is more than one component, every document outside the largest is compared with all others on full sets, by counting shared
       shingles, and as many links returned as join the same components.
    Where several clusters meet in a bucket (2), or several components in a cluster (4), only documents with enough shingles in common with the others
    together are compared (_open), dealt over tiles of bounded size. Rows grow with the square of a group only where so many documents are made of one
    another's shingles for at least percent, and yet are not linked.

    Text null, empty or without words: n_shingles 0, linked with nothing, kept. doc_id null: component_id null, kept, linked with nothing. Rows that repeat
    a doc_id are one document's: each row is returned, with that id's component. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-duplicates")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = scratch.keep(docs.mapInArrow(partial(_sketch, k=words, rows=rows, percent=percent), SKETCH), "sketch")
    alike = ["d1", "d2", "n"]
    classes = scratch.keep(sketch.filter("n > 0 and doc_id is not null").groupBy(*alike).agg(F.min("doc_id").alias("rep")), "classes")
    wide = sketch.join(classes.select(*(F.col(c).alias(f"c_{c}") for c in alike), F.col("rep").alias("c_rep")).hint("merge"), F.expr("doc_id = c_rep and d1 = c_d1 and d2 = c_d2 and n = c_n"), "left_semi").withColumnRenamed("doc_id", "id")
    wide = scratch.keep(wide, "representatives")
    row = wide.select("id", F.explode("bands").alias("h"))
    buckets = scratch.keep(row.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z"), "buckets")
    members = scratch.keep(row.join(buckets.hint("merge"), "h"), "members")
    pairs = members.select(F.explode(F.array(F.struct("a", F.col("id").alias("b")), F.struct(F.col("id").alias("a"), F.col("z").alias("b")))).alias("x")).select("x.*")
    star = scratch.keep(pairs.filter("a < b").distinct(), "star")

    def likely(pairs: DataFrame) -> DataFrame:
        side = lambda x: wide.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"k{x}")).hint("merge")
        both = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        return both.select("a", "b", "na", "nb", "ka", "kb").mapInArrow(partial(_likely, threshold=percent / 100), "a long, b long, j double")

    def sets_of(ids: DataFrame, name: str) -> DataFrame:
        return scratch.keep(docs.join(ids.select(F.col("id").alias("doc_id")).hint("merge"), "doc_id", "left_semi").mapInArrow(partial(_sets, k=words), "id long, s array<long>"), name)

    likeliest = scratch.keep(likely(star), "likely")
    clusters = scratch.keep(connected(scratch, likeliest.select(F.col("a").alias("u"), F.col("b").alias("v")), "near"), "clusters")
    # buckets in which several clusters meet
    placed = members.select("h", "id").join(clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")).hint("merge"), "id", "left")
    placed = scratch.keep(placed.withColumn("cluster", F.coalesce("cluster", "id")), "placed")

    def mixed(rows: DataFrame, name: str) -> DataFrame:
        """The rows of the buckets that hold several clusters."""
        found = rows.groupBy("h").agg(F.min("cluster").alias("least"), F.max("cluster").alias("most"), F.count("*").alias("many")).filter("least < most")
        found = scratch.keep(found.select("h", F.ceil(F.col("many") / TILE).cast("int").alias("tiles")), name)
        return rows.join(found.hint("merge"), "h")

    first = scratch.keep(mixed(placed, "mixed").select("h", "id", "cluster"), "meeting")
    ids = first.select("id", "cluster").distinct()
    able = _open(scratch, "able", ids.join(sets_of(ids, "mixed-sets").hint("merge"), "id"), [], "cluster", percent)
    meeting = mixed(first.join(able.hint("merge"), "id", "left_semi"), "mixed-able")
    meeting = meeting.join(wide.select("id", "n", "registers").hint("merge"), "id").withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    meeting = meeting.withColumn("o", F.explode(F.expr("sequence(0, tiles - 1)"))).select("h", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "t", "id", "cluster", "n", "registers")
    met = scratch.keep(meeting.groupBy("h", "i", "j").applyInArrow(lambda t: _meet(t, percent / 100), "u long, v long"), "met")
    if not met.isEmpty():
        near = likeliest.select(F.col("a").alias("u"), F.col("b").alias("v")).union(met)
        clusters = scratch.keep(connected(scratch, near, "nearer"), "all-clusters")
    sets = sets_of(clusters.select(F.col("node").alias("id")), "sets")
    # each document and its likeliest partners, on full sets
    side = lambda x: sets.select(F.col("id").alias(x), F.col("s").alias(f"s{x}")).hint("merge")
    # each task keeps the first few of a document before they meet, so a document with very many partners is no large group
    top = likeliest.withColumn("k", F.row_number().over(Wd.partitionBy("b").orderBy(F.desc("j"), "a"))).filter(F.col("k") <= FIRST).select("a", "b")
    tried = top.join(side("b"), "b").join(side("a"), "a").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    links = scratch.keep(tried.filter(f"100 * both >= {percent} * (size(sa) + size(sb) - both)").select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    parts = scratch.keep(connected(scratch, links, "linked"), "parts")
    # clusters that are not yet one component: what is outside the largest component against everything
    inside = clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")).join(parts.select(F.col("node").alias("id"), "component").hint("merge"), "id", "left")
    inside = scratch.keep(inside.withColumn("component", F.coalesce("component", "id")), "inside")
    several = inside.groupBy("cluster").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most").select("cluster")
    several = scratch.keep(several, "several")  # written, so that the join can split a large cluster
    apart = scratch.keep(inside.join(several.hint("merge"), "cluster", "left_semi").join(sets.hint("merge"), "id"), "apart")
    able = _open(scratch, "able-apart", apart, ["cluster"], "component", percent)
    apart = scratch.keep(apart.join(able.hint("merge"), "id", "left_semi"), "open")
    size = F.size("s").cast("long")
    most = apart.groupBy("cluster", "component").agg(F.count("*").alias("n"), F.sum(size).alias("m")).groupBy("cluster").agg(F.max(F.struct("n", "component", "m")).alias("x"), F.sum("n").alias("n"), F.sum("m").alias("m")).filter("x.n < n")
    tiles = lambda n, m: F.ceil(F.greatest(n / TILE, m / TILE_SHINGLES)).cast("int")
    most = scratch.keep(most.select("cluster", F.col("x.component").alias("main"), tiles(F.col("n") - F.col("x.n"), F.col("m") - F.col("x.m")).alias("ts"), tiles(F.col("n"), F.col("m")).alias("tm")), "split")
    open_ = apart.drop("s").join(most.hint("merge"), "cluster").withColumn("stray", F.col("component") != F.col("main"))
    open_ = open_.withColumn("t", F.when(F.col("stray"), F.pmod(F.xxhash64("id"), F.col("ts"))).otherwise(F.col("ts") + F.pmod(F.xxhash64("id"), F.col("tm"))).cast("int"))
    role = lambda i, j, probe: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(probe).alias("probe"))
    asked = F.transform(F.expr("sequence(0, ts - 1)"), lambda i: role(i, F.col("t"), False))
    asking = F.transform(F.expr("sequence(0, ts + tm - 1)"), lambda j: role(F.col("t"), j, True))
    # a stray that asks in its own tile stands there once
    both = F.when(F.col("stray"), F.concat(asking, F.filter(asked, lambda x: x["i"] != F.col("t")))).otherwise(asked)
    open_ = open_.select("cluster", "id", "component", F.explode(both).alias("x")).select("cluster", "id", "component", "x.*").join(apart.select("id", "s").hint("merge"), "id")
    more = scratch.keep(open_.groupBy("cluster", "i", "j").applyInArrow(lambda t: _check(t, percent), "u long, v long"), "more-links")
    if not more.isEmpty():
        parts = scratch.keep(connected(scratch, links.union(more), "all"), "all-parts")
    scratch.drop("representatives", "buckets", "members", "star", "likely", "placed", "mixed", "meeting", "mixed-sets", "able", "mixed-able", "met", "clusters", "all-clusters", "sets", "inside", "several", "apart", "able-apart", "open", "split")
    out = sketch.select("doc_id", *alike).join(classes, alike, "left")
    out = out.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
