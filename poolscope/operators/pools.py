"""Competitor pools: what is live, or was listed some time ago, as of each listing's instant.

Every pool is a set of intervals: a listing belongs to the pool from `enter` until before `leave`, with a weight, and a focal listing asks at its own time.
One sweep over the instants of a group answers all questions of all pools, without pairs.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from poolscope.plans.spec import DAY, SPEC, Spec

#: Span of a block of a sweep. A group's sweep is dealt over its blocks, so a large group is no single task.
BLOCK = 30 * DAY
#: Half-lives after which a weight is below the precision of a double.
FORGOTTEN = 64


def block_of(at: Column, block: int = BLOCK) -> Column:
    return F.floor(at / F.lit(block)).cast("long")


def growth(u0: Column, at: Column, spec: Spec = SPEC, block: int = BLOCK) -> Column:
    """2^(time / half-life) of a listing's time, from the beginning of the block of `at`; ratios of it within a block are half-life weights.

    A listing that counts now was listed within the pool's span, so the power is moderate whatever span the table has.
    """
    return F.pow(F.lit(2.0), (u0 - block_of(at, block) * F.lit(block)) / F.lit(spec.half_life_days * DAY))


def sweep(moves: DataFrame, asks: DataFrame, keys: list[str], sums: list[str], fading: list[str] = (), covered: bool = False, spec: Spec = SPEC, block: int = BLOCK) -> DataFrame:
    """asks (keys, at, and others) with the sums of the moves (keys, at, sums and fading) up to and including `at`.

    Moves of one instant are added up first, so that no window has more rows than there are instants, however many listings share one. Sums before a
    block come from the totals of the blocks, of which there are few; sums inside a block from a window over its instants. Columns in `fading` are
    multiples of growth(), each from its block's beginning: totals of earlier blocks fade by the half-lives that lie between, and are forgotten after 64.
    covered: every row of asks has a move at its own instant; else its instant is added.
    """
    values = [*sums, *fading]
    steps = moves.select(*keys, "at", *values)
    if not covered:
        steps = steps.union(asks.select(*keys, "at", *(F.lit(0).cast(moves.schema[v].dataType).alias(v) for v in values)))
    steps = steps.groupBy(*keys, block_of(F.col("at"), block).alias("block"), "at").agg(*(F.sum(v).alias(v) for v in values))
    totals = steps.groupBy(*keys, "block").agg(*(F.sum(v).alias(v) for v in values))
    earlier = W.partitionBy(*keys).orderBy("block")
    before = [F.coalesce(F.sum(v).over(earlier.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"b_{v}") for v in sums]
    if fading:
        each = block / (spec.half_life_days * DAY)
        last = F.collect_list(F.struct("block", *fading)).over(earlier.rangeBetween(-ceil(FORGOTTEN / each) - 1, -1)).alias("last")
        totals = totals.select(*keys, "block", *before, last)
        faded = lambda v: F.aggregate("last", F.lit(0.0), lambda a, x: a + x[v] * F.pow(F.lit(2.0), (x["block"] - F.col("block")) * F.lit(each)))
        totals = totals.select(*keys, "block", *(f"b_{v}" for v in sums), *(faded(v).alias(f"b_{v}") for v in fading))
    else:
        totals = totals.select(*keys, "block", *before)
    inside = W.partitionBy(*keys, "block").orderBy("at").rangeBetween(W.unboundedPreceding, 0)
    run = steps.select(*keys, "block", "at", *(F.sum(v).over(inside).alias(v) for v in values)).join(totals, [*keys, "block"])
    run = run.select(*keys, "at", *((F.col(f"b_{v}") + F.col(v)).alias(v) for v in values))
    return asks.join(run, [*keys, "at"])


def interval(kind: str, spec: Spec = SPEC) -> tuple[Column, Column]:
    """enter and leave of a pool: current, recent, completed (recent and funded by then), or a mirror of so many days."""
    u0, u1 = F.col("u0"), F.col("u1")
    lag, end = u0 + F.lit(spec.lag_from_days * DAY), u0 + F.lit(spec.lag_to_days * DAY)
    if kind == "current":
        return u0, u1
    if kind == "recent":
        return lag, end
    if kind == "completed":
        return F.greatest(lag, u1), end
    return u0, u0 + F.lit(int(kind.removeprefix("mirror").rstrip("d")) * DAY)


def weighs(kind: str) -> bool:
    """Whether ages weigh in a pool."""
    return kind in ("recent", "completed")


def at_once(kind: str) -> bool:
    """Whether a listing enters a pool as it is listed."""
    return kind == "current" or kind.startswith("mirror")


def own(kind: str, spec: Spec = SPEC) -> Column:
    """1 where a listing would be in its own pool at its own time, else 0."""
    enter, leave = interval(kind, spec)
    return ((enter <= F.col("u0")) & (F.col("u0") < leave) & F.lit(spec.exclude_self)).cast("long")


def moves_of(kind: str, amounts: dict[str, Column], fading: dict[str, Column], spec: Spec = SPEC) -> list[Column]:
    """The two moves of a listing in a pool, as structs of at and named values: what it adds on entering goes on leaving, each faded to its own block."""
    enter, leave = interval(kind, spec)
    live = enter < leave
    one = lambda at, sign: F.struct(at.alias("at"), *(F.when(live, sign * x).otherwise(F.lit(0).cast("double" if name[0] != "n" else "long")).alias(name) for name, x in amounts.items()), *(F.when(live, sign * x * growth(F.col("u0"), at, spec)).otherwise(0.0).alias(name) for name, x in fading.items()))
    return [one(enter, 1), one(leave, -1)]


def _stacked(rows: DataFrame, keep: list[str], per_kind: list[tuple[dict, dict, str]], spec: Spec) -> DataFrame:
    """One row per move, with a column for every value of every kind; those of other kinds are 0."""
    names = [n for a, f, _ in per_kind for n in (*a, *f)]
    structs = []
    for amounts, fading, kind in per_kind:
        for move in moves_of(kind, amounts, fading, spec):
            structs.append(F.struct(move["at"].alias("at"), *((move[n] if n in amounts or n in fading else F.lit(0).cast("long" if n[0] == "n" else "double")).alias(n) for n in names)))
    return rows.select(*keep, F.explode(F.array(*structs)).alias("e")).select(*keep, "e.*")


def pools(loans: DataFrame, kinds: list[str], keys: list[str] | None = None, spec: Spec = SPEC) -> DataFrame:
    """id, and for each kind n_<kind>, and where ages weigh v_<kind>: the sizes of each listing's pools as of its time, and their half-life weighted sizes.

    Intervals are half open; listings of the same instant are in each other's pool where the pool begins at listing; a listing is not in its own
    (spec.exclude_self), also not one that is funded at its own instant. An empty pool has size 0. keys: the groups that compete; [] for all together.
    Listings without a key or a time are in no pool and have none.
    """
    keys = ["sector"] if keys is None else keys
    rows = loans.select("id", *keys, "u0", "u1")
    if not keys:
        rows, keys = rows.withColumn("everyone", F.lit(0)), ["everyone"]
    per = [({f"n_{k}": F.lit(1).cast("long")}, {f"v_{k}": F.lit(1.0)} if weighs(k) else {}, k) for k in kinds]
    moves = _stacked(rows, keys, per, spec)
    asks = rows.select("id", *keys, F.col("u0").alias("at"), "u0", "u1")
    out = sweep(moves, asks, keys, [f"n_{k}" for k in kinds], [f"v_{k}" for k in kinds if weighs(k)], any(map(at_once, kinds)), spec)
    columns = []
    for k in kinds:
        n = F.col(f"n_{k}") - own(k, spec)
        columns.append(n.alias(f"n_{k}"))
        if weighs(k):
            v = F.when(n > 0, F.greatest(F.lit(0.0), F.col(f"v_{k}") / growth(F.col("u0"), F.col("u0"), spec) - own(k, spec))).otherwise(0.0)
            columns.append((F.log1p(v) if spec.log_volume else v).alias(f"v_{k}"))
    return out.select("id", *columns)


def pool(loans: DataFrame, kind: str = "current", keys: list[str] | None = None, spec: Spec = SPEC) -> DataFrame:
    """id, n, and for pools with age weights v: pools() of one kind."""
    return pools(loans, [kind], keys, spec).withColumnsRenamed({f"n_{kind}": "n", f"v_{kind}": "v"})


def saturation(n: str | Column = "n") -> Column:
    """C: log of one more than the live competitors."""
    return F.log1p(F.col(n).cast("double") if isinstance(n, str) else n.cast("double"))


def platform_volume(times: DataFrame, column: str = "u0", days: int = 7) -> DataFrame:
    """day, n, volume: listings of a day, and of the `days` days up to it. Days are aggregated first, so the one global window has a row per day."""
    daily = times.groupBy(F.floor(F.col(column) / DAY).cast("long").alias("day")).agg(F.count("*").alias("n"))
    return daily.select("day", "n", F.sum("n").over(W.orderBy("day").rangeBetween(-(days - 1), 0)).alias("volume"))
