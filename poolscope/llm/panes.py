"""Hourly panes over a stream in batches: panes are emitted when due, revised while they last, and then forgotten."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from poolscope.sources.tables import micros

from .scratch import Scratch

HOUR = 3_600_000_000
DAY = 24 * HOUR
#: How long after its end a pane is due, and closed.
DUE, KEEP = 6 * HOUR, 4 * DAY
#: Many small stores: changes are saved as a log, and no file gets its space before it is needed.
STORES = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
RESULT = "batch long, hour long, click_id long, n_rows long, cents long, record string, kind string"
#: Panes that a task of the combiner gathers before it gives them on.
GATHERED = 100_000
#: From this size a value is not an amount of money.
HUGE = 1e13


def dealt(clicks: DataFrame, batches: int = 8) -> DataFrame:
    """(batch, click_id, event, hour, kind, cents): rows with a time, each click once, in batches by day of arrival with some that come later.

    batch: the day since 1970 modulo `batches`, moved on by max(0, CRC-32 of the decimal id modulo 30, less 23), the last batch at most. event: ts in
    microseconds, moved by the days that lie between the day of arrival and its remainder. cents: floor(100 * value + 0.5).
    ts null: dropped. Rows that repeat a click_id are one click, that of the least (arrived_at, ts, kind, value), nulls first; all without an id are one.
    arrived_at null: as ts. kind null: `none`. value null, not finite, or of 10^13 or more: 0 cents. Other columns are not read.
    """
    ts = micros(clicks, "ts")
    rows = clicks.select("click_id", F.struct(F.coalesce(micros(clicks, "arrived_at"), ts).alias("arrived"), ts.alias("ts"), "kind", F.col("value").cast("double").alias("value")).alias("x")).filter("x.ts is not null")
    rows = rows.groupBy("click_id").agg(F.min("x").alias("x")).select("click_id", "x.*")
    day = F.floor(F.col("arrived") / DAY).cast("long")
    late = F.greatest(F.lit(0), F.crc32(F.coalesce(F.col("click_id").cast("string"), F.lit("")).cast("binary")) % 30 - 23)
    amount = F.when(F.abs("value") < HUGE, F.floor(100 * F.col("value") + 0.5)).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("q", F.pmod(day, F.lit(batches))).withColumn("event", F.col("ts") - (day - F.col("q")) * DAY)
    return rows.select(F.least(F.lit(batches - 1), F.col("q") + late).cast("long").alias("batch"), "click_id", "event", F.floor(F.col("event") / HOUR).cast("long").alias("hour"), F.coalesce("kind", F.lit("none")).alias("kind"), F.coalesce(amount, F.lit(0).cast("long")).alias("cents"))


def _ends(hour: Column | int) -> Column | int:
    return (hour + 1) * HOUR


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (batch, hour, kind, cents, click_id, late) as sums by pane, once a task; late ones as they are, dealt by their id."""
    sums: dict[tuple, list[int]] = {}
    names = ["role", "batch", "hour", "kind", "n_rows", "cents", "click_id"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def out():
        rows = [("pane", *key, *own, None) for key, own in sums.items()]
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        single = table.filter(table["late"])
        for part in single.to_batches():
            n = part.num_rows
            columns = [pa.array(["late"] * n, pa.string()), part["batch"], part["hour"], part["kind"], pa.array([1] * n, pa.int64()), part["cents"], part["click_id"]]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types, strict=True)], names)
        grouped = table.filter(pc.invert(table["late"])).group_by(["batch", "hour", "kind"]).aggregate([("cents", "count"), ("cents", "sum")])
        for b, h, k, n, cents in zip(*(grouped[c].to_pylist() for c in ("batch", "hour", "kind", "cents_count", "cents_sum")), strict=True):
            own = sums.setdefault((b, h, k), [0, 0])
            own[0] += n
            own[1] += cents
        if len(sums) >= GATHERED:
            yield out()
    if sums:
        yield out()


class Panes(StatefulProcessor):
    """A shard of the panes, as a map from (hour, kind) to (rows, cents, emitted).

    A batch brings the shard sums for its panes, late rows, and one control row with W and whether the batch is the last. Sums are added as they come; the
    control row then settles which panes are emitted, revised and forgotten. A batch without rows has its control row all the same.
    """

    def __init__(self, due: int, keep: int):
        self.due, self.keep = due, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.panes = handle.getMapState("panes", "hour long, kind string", "n long, cents long, emitted boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        added: dict[tuple[int, str], list[int]] = {}
        control, newest = None, None
        for df in rows:
            own = df[df["role"] == "pane"]
            for hour, kind, n, cents in zip(own["hour"].tolist(), own["kind"].tolist(), own["n_rows"].tolist(), own["cents"].tolist(), strict=True):
                sums = added.setdefault((int(hour), kind), [0, 0])
                sums[0] += int(n)
                sums[1] += int(cents)
            late = df[df["role"] == "late"]
            if len(late):
                newest = int(late["hour"].max()) if newest is None else max(newest, int(late["hour"].max()))
                yield late.assign(record="late")[["batch", "hour", "click_id", "n_rows", "cents", "record", "kind"]]
            for row in df[df["role"] == "control"].itertuples():
                control = (int(row.batch), None if pd.isna(row.w) else int(row.w), bool(row.last))
        if control is None:
            raise ValueError(f"shard {key}: a batch without its control row")
        batch, w, is_last = control
        passed = lambda hour, by: w is not None and w >= _ends(hour) + by
        if newest is not None and not passed(newest, self.keep):
            raise ValueError(f"batch {batch}: rows were dealt as late whose pane is not closed at {w}")
        out = []
        for (hour, kind), (n, cents) in sorted(added.items()):
            have = self.panes.getValue((hour, kind)) if self.panes.containsKey((hour, kind)) else (0, 0, False)
            total = (int(have[0]) + n, int(have[1]) + cents)
            if have[2]:
                out += [(batch, hour, -1, int(have[0]), int(have[1]), "retract", kind), (batch, hour, -1, *total, "replace", kind)]
            self.panes.updateValue((hour, kind), (*total, bool(have[2])))
        for (hour, kind), (n, cents, emitted) in list(self.panes.iterator()):
            hour, n, cents = int(hour), int(n), int(cents)
            due = passed(hour, self.due)
            if not emitted and (due or is_last):
                out.append((batch, hour, -1, n, cents, "emit" if due else "final", kind))
            if passed(hour, self.keep) or is_last:
                self.panes.removeKey((hour, kind))
            elif due and not emitted:
                self.panes.updateValue((hour, kind), (n, cents, True))
        if out:
            yield pd.DataFrame(out, columns=["batch", "hour", "click_id", "n_rows", "cents", "record", "kind"])


def _move(spark: SparkSession, source: str, target: str) -> None:
    """Give a folder another name, where it exists; else make the new one's parent."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    source, target = of(source), of(target)
    store = source.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(target.getParent())
    if store.exists(source) and not store.rename(source, target):
        raise OSError(f"{source} could not be moved to {target}")


def revised(rows: DataFrame, batches: int = 8, due: int = DUE, keep: int = KEEP, shards: int | None = None) -> DataFrame:
    """(batch, hour, click_id, n_rows, cents, record, kind): what a stream over rows (batch, click_id, event, hour, kind, cents) writes, batch by batch.

    W is the largest event of all earlier batches. A pane, which is a kind and an hour, is due when W has reached its end and `due` more, closed at its end
    and `keep` more. In each batch rows of closed panes are written as `late`, and others added; then panes that are due and were not emitted are written as
    `emit`; such as were emitted in earlier batches and have new rows as `retract`, with the old totals, and `replace`; closed ones are forgotten. The last
    batch writes those that were never emitted as `final`.

    Batches lie as files in the shared folder and are moved under the stream's source one by one; for each, the query is started anew on the same checkpoint
    and ends when it has read them. Before the shuffle each task sums its rows by pane, so a pane of very many rows sends its shard one row a task, and late
    rows go to shards by their ids. W and the last flag reach every shard in the band, as a control row of each batch. The driver holds one number per batch.

    Rows without batch, hour or kind are not allowed; an empty table gives no rows. Tables of every call lie in a folder of their own.
    """
    scratch = Scratch(rows.sparkSession, "panes")
    rows.select("batch", "click_id", "event", "hour", "kind", "cents").write.partitionBy("batch").parquet(scratch.path("dealt"))
    # a session of its own keeps the settings of state stores to this query
    spark = rows.sparkSession.newSession()
    shards = shards or max(16, 2 * spark.sparkContext.defaultParallelism)
    for name, value in {**STORES, "spark.sql.shuffle.partitions": str(shards)}.items():
        spark.conf.set(name, value)
    schema = "click_id long, event long, hour long, kind string, cents long, batch long"
    tops = {r[0]: r[1] for r in spark.read.schema(schema).parquet(scratch.path("dealt")).groupBy("batch").agg(F.max("event")).collect()}
    out, w = scratch.path("out"), None
    for b in range(batches):
        _move(spark, scratch.path(f"dealt/batch={b}"), scratch.path(f"clicks/batch={b}"))
        spark.createDataFrame([(b, w, b == batches - 1)], "batch long, w long, last boolean").coalesce(1).write.parquet(scratch.path(f"control/n={b}"))
        source = spark.readStream.schema(schema).parquet(scratch.path("clicks"))
        late = F.lit(False) if w is None else _ends(F.col("hour")) + keep <= w
        sums = source.select("batch", "hour", "kind", "cents", "click_id", late.alias("late")).mapInArrow(_combined, "role string, batch long, hour long, kind string, n_rows long, cents long, click_id long")
        dealt_by = F.when(F.col("role") == "late", F.xxhash64("click_id")).otherwise(F.xxhash64("hour", "kind"))
        sums = sums.select(F.pmod(dealt_by, F.lit(shards)).cast("int").alias("shard"), "role", "batch", "hour", "kind", "n_rows", "cents", "click_id", F.lit(None).cast("long").alias("w"), F.lit(None).cast("boolean").alias("last"))
        control = spark.readStream.schema("batch long, w long, last boolean, n int").parquet(scratch.path("control"))
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        control = control.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit("control").alias("role"), "batch", none("long", "hour"), none("string", "kind"), none("long", "n_rows"), none("long", "cents"), none("long", "click_id"), "w", "last")
        settled = sums.unionByName(control).groupBy("shard").transformWithStateInPandas(Panes(due, keep), RESULT, "Append", "None")
        query = settled.writeStream.format("parquet").option("checkpointLocation", scratch.path("state")).trigger(availableNow=True).start(out)
        query.awaitTermination()
        if b in tops:
            w = tops[b] if w is None else max(w, tops[b])
    return rows.sparkSession.read.schema(RESULT).parquet(out)
