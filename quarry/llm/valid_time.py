"""Valid-time sale enrichment: each sale takes the version of its client that was valid when it was sold.

Both tables are cut into numbered batches, which a stateful Structured Streaming query takes up
one by one, started anew for each on one checkpoint. State is keyed by a hash bucket of clients:
a bucket holds the columns of all its clients' versions as sorted numpy arrays, and those of the
sales that wait. Every batch sends each bucket one tick with the batch's watermarks, so that empty
batches emit and prune too. On a tick a bucket ranks clients and times together and resolves all
sales that are due by one ``searchsorted`` over the composite ranks.

The contract of a batch: changes below their table's watermark (the largest time of earlier batches
minus a delay; none: minus infinity) are late and go out as such, others become one version each;
sales without a time or below H (the smaller watermark) are emitted, others wait; then of a client's
versions up to H all but the last go. After the last batch waiting sales go out as one batch more.

A client with more than ``large_rows`` rows is cut into slices of time, each a client of its own as far
as buckets are concerned. What a slice has to know of the others is summed up before the stream, by
batch: the last version of earlier slices (``carry``), how many versions the whole client holds, and
the slice of its last version up to H (``info``): a row each for a slice and batch. So no bucket and
no task gets more than its share, however hot a client is (rows of one client and one instant excepted).
Which clients are so large is asked by a join without a hint: Spark broadcasts their short list if it
measures it as small, and else shuffles and splits skewed keys.

To the driver go one row a batch and table, and some counts. Batches, state and results lie in a new
folder below the shared one at every call; a lost executor's tasks run again from the committed state.
The batches and the state are deleted when the last batch is over.

Defined results: changes without a valid time are ignored, equal rows of changes count once, equal
rows of sales each; sales without a client, or whose client has no version, hold 0 and take none; changes
without a client can be late but are nobody's versions; null seq or id orders first; a null balance
or op stays null; times before the first batch count for batch 0, rows without a batch's time for
the last; empty tables give no rows; further columns of changes count only in being equal, those of
sales not at all. Inside, the smallest 64-bit integer stands for null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.llm.common import make_folder, remove, workspace, written

BATCHES, FIRST_DAY, DAYS, DELAY_HOURS = 8, 19723, 152, 12
#: Rows of both tables, all batches together: of a bucket, of a client that is cut into slices, and of a slice. A batch
#: has few of a client's slices, being a stretch of time itself, so slices are small.
BUCKET_ROWS, LARGE_ROWS, PART_ROWS = 1 << 16, 1 << 14, 1 << 11

NONE = -(2**63)
DAY = 86_400_000_000
TICK, CHANGE, SALE, CARRY, INFO = range(5)

#: What a bucket is fed with. Ticks: at is H, seq the watermark of changes, id the batch, cents 1 in the
#: last batch. Infos: id the client's versions in this batch, seq those after it, cents the slice of the last up to H.
FEED = "bucket int, kind int, client long, slice int, id long, at long, seq long, cents long, op string"
RESULT = "rec string, id long, batch long, n_held long, change_id long, balance_cents long, op string"

_VERSION = {"client": np.int64, "slice": np.int32, "at": np.int64, "seq": np.int64, "id": np.int64, "cents": np.int64, "op": np.int32, "carried": np.bool_}
_SALE = {"client": np.int64, "slice": np.int32, "at": np.int64, "id": np.int64}
_STATE = ", ".join(f"v_{c} binary" for c in _VERSION) + ", " + ", ".join(f"s_{c} binary" for c in _SALE) + ", ops array<string>"

_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # Stores of a start that is over go soon, and none takes disk before it has something to keep there.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def _micros(at: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), at.cast("timestamp_ntz"))


def _none(value: Column) -> Column:
    return F.coalesce(value.cast("long"), F.lit(NONE))


def _batch(day: Column, batches: int, first_day: int, days: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(batches - 1), F.floor((day - first_day) * batches / F.lit(days)))).cast("int")


def _day(at: Column) -> Column:
    return F.floor(_micros(at) / DAY)


# ---- what a bucket does with a batch ----


def _longs(values: np.ndarray, null: np.ndarray) -> pd.array:
    return pd.arrays.IntegerArray(np.where(null, 0, values).astype(np.int64), np.asarray(null, dtype=bool).copy())


def _join(a: dict, b: dict) -> dict:
    return {c: np.concatenate([a[c], b[c].astype(a[c].dtype)]) for c in a}


def _take(a: dict, at: np.ndarray) -> dict:
    return {c: v[at] for c, v in a.items()}


def ordered(versions: dict) -> dict:
    """Versions by client, slice and order of validity; of what was carried into a slice only the last."""
    versions = _take(versions, np.lexsort([versions[c] for c in ("id", "seq", "at", "slice", "client")]))
    n = len(versions["at"])
    if n and versions["carried"].any():
        follows = np.zeros(n, bool)
        follows[:-1] = _same(versions)[1:] & versions["carried"][1:]
        versions = _take(versions, ~(versions["carried"] & follows))
    return versions


def _same(versions: dict) -> np.ndarray:
    """Whether each row has the client and slice of the row above."""
    c, s = versions["client"], versions["slice"]
    return np.r_[False, (c[1:] == c[:-1]) & (s[1:] == s[:-1])] if len(c) else np.zeros(0, bool)


class Ranked:
    """Sorted versions under composite ranks: (client, slice) first, then time."""

    def __init__(self, versions: dict):
        self.versions = versions
        self.clients = np.unique(versions["client"])
        self.width = int(versions["slice"].max(initial=0)) + 2
        groups = self._group(versions)
        self.groups, self.counts = np.unique(groups, return_counts=True)
        self.times = np.unique(versions["at"])
        self.ranks = np.searchsorted(self.groups, groups) * (len(self.times) + 1) + np.searchsorted(self.times, versions["at"]) + 1

    def _group(self, rows: dict) -> np.ndarray:
        return np.searchsorted(self.clients, rows["client"]) * self.width + np.minimum(rows["slice"], self.width - 1)

    def find(self, rows: dict) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each row's (client, slice) among those of versions, and whether there is one."""
        if not len(self.clients):
            return np.zeros(len(rows["client"]), np.int64), np.zeros(len(rows["client"]), bool)
        at = np.minimum(np.searchsorted(self.clients, rows["client"]), len(self.clients) - 1)
        group = self._group(rows)
        rank = np.minimum(np.searchsorted(self.groups, group), len(self.groups) - 1)
        return rank, (self.clients[at] == rows["client"]) & (self.groups[rank] == group) & (rows["client"] != NONE)

    def last(self, sales: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The row of the last version up to each sale's time (-1: none), each sale's group and whether it has one."""
        rank, there = self.find(sales)
        wanted = rank * (len(self.times) + 1) + np.searchsorted(self.times, sales["at"], side="right")
        row = np.searchsorted(self.ranks, wanted, side="right") - 1
        first = np.r_[0, np.cumsum(self.counts)[:-1]] if len(self.counts) else np.zeros(1, np.int64)
        found = there & (sales["at"] != NONE)
        return np.where(found & (row >= first[rank]), row, -1), rank, there


class Bucket(StatefulProcessor):
    """The versions of a bucket's clients, and the sales that wait for the watermark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", _STATE)

    def close(self) -> None:
        pass

    def _load(self) -> tuple[dict, dict, list]:
        if not self.state.exists():
            empty = lambda kinds: {c: np.zeros(0, t) for c, t in kinds.items()}
            return empty(_VERSION), empty(_SALE), []
        held = self.state.get()
        columns = [np.frombuffer(x, t) for x, t in zip(held, [*_VERSION.values(), *_SALE.values()], strict=False)]
        return dict(zip(_VERSION, columns, strict=False)), dict(zip(_SALE, columns[len(_VERSION) :], strict=True)), list(held[-1])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fed = pd.concat(list(rows), ignore_index=True)
        versions, waiting, ops = self._load()
        kinds = fed["kind"].to_numpy()
        tick = fed[kinds == TICK]
        if len(tick) != 1:
            raise ValueError(f"bucket {key} has {len(tick)} ticks in one batch")
        horizon, below, batch, last = (int(tick[c].iloc[0]) for c in ("at", "seq", "id", "cents"))
        of = lambda kind, columns: {c: fed[c].to_numpy()[kinds == kind].astype(t) for c, t in columns.items()}

        said = fed["op"].to_numpy(dtype=object)
        ops += sorted({x for x in said[(kinds == CHANGE) | (kinds == CARRY)] if x is not None} - set(ops))
        code = {x: i for i, x in enumerate(ops)}
        fed["op"] = np.fromiter((code.get(x, -1) for x in said), np.int32, len(said))
        fed["carried"] = kinds == CARRY
        changes = of(CHANGE, _VERSION)
        late = changes["at"] < below
        if late.any():
            yield self._late(changes["id"][late], batch)
        new = _join(_take(changes, ~late & (changes["client"] != NONE)), of(CARRY, _VERSION))
        if len(new["at"]):
            versions = ordered(_join(versions, new))
        infos = of(INFO, {"client": np.int64, "slice": np.int32, "id": np.int64, "seq": np.int64, "cents": np.int64})

        sales = _join(waiting, of(SALE, _SALE))
        due = sales["at"] < horizon
        due |= sales["at"] == NONE
        if due.any():
            yield self._resolved(_take(sales, due), versions, infos, "id", batch, ops)
        waiting = _take(sales, ~due)
        versions = self._pruned(versions, infos, horizon)
        if last and len(waiting["at"]):
            yield self._resolved(waiting, versions, infos, "seq", batch + 1, ops)
            waiting = _take(waiting, np.zeros(0, np.int64))
        self.state.update((*(v.tobytes() for v in (*versions.values(), *waiting.values())), ops))

    @staticmethod
    def _late(ids: np.ndarray, batch: int) -> pd.DataFrame:
        n, none = len(ids), np.ones(len(ids), bool)
        nothing = _longs(np.zeros(n), none)
        return pd.DataFrame({"rec": ["late"] * n, "id": _longs(ids, ids == NONE), "batch": np.full(n, batch), "n_held": nothing, "change_id": nothing, "balance_cents": nothing, "op": pd.array([None] * n, dtype=object)})

    @staticmethod
    def _infos(infos: dict, what: str, rows: dict) -> tuple[np.ndarray, np.ndarray]:
        """What the infos say of each row's client and slice, and whether there is one."""
        if not len(infos["client"]):
            return np.zeros(len(rows["client"]), np.int64), np.zeros(len(rows["client"]), bool)
        sorted_ = _take(infos, np.lexsort([infos["slice"], infos["client"]]))
        told = Ranked({"client": sorted_["client"], "slice": sorted_["slice"], "at": np.zeros(len(sorted_["client"]), np.int64)})
        rank, there = told.find(rows)
        return sorted_[what][rank], there

    def _resolved(self, sales: dict, versions: dict, infos: dict, held: str, batch: int, ops: list) -> pd.DataFrame:
        n = len(sales["at"])
        ranked = Ranked(versions)
        row, rank, there = ranked.last(sales)
        n_held = np.where(there, ranked.counts[rank] if len(ranked.counts) else 0, 0)
        whole, sliced = self._infos(infos, held, sales)
        n_held = np.where(sliced, whole, n_held)
        none = row < 0
        at = np.where(none, 0, row)
        pick = lambda c: versions[c][at] if len(versions[c]) else np.zeros(n, np.int64)
        codes = np.where(none, -1, pick("op"))
        names = np.array([*ops, None], dtype=object)
        return pd.DataFrame(
            {
                "rec": ["sale"] * n, "id": _longs(sales["id"], sales["id"] == NONE), "batch": np.full(n, batch), "n_held": n_held.astype(np.int64),
                "change_id": _longs(pick("id"), none | (pick("id") == NONE)), "balance_cents": _longs(pick("cents"), none | (pick("cents") == NONE)), "op": names[codes],
            }
        )

    def _pruned(self, versions: dict, infos: dict, horizon: int) -> dict:
        """Of each client's versions up to the horizon the last stays; a slice before that one keeps none of them."""
        old = versions["at"] <= horizon
        if not old.any():
            return versions
        same = _same(versions)
        next_old = np.zeros(len(old), bool)
        next_old[:-1] = same[1:] & old[1:]
        of_last, told = self._infos(infos, "cents", versions)
        return _take(versions, ~(old & (next_old | (told & (of_last > versions["slice"])))))


# ---- the batches ----


def _watermarks(summed: dict, batches: int, delay: int) -> list[int]:
    """The watermark in each batch, from the largest time of each."""
    out, most = [], NONE
    for k in range(batches):
        out.append(NONE if most == NONE else most - delay)
        if k in summed and summed[k]["most"] is not None:
            most = max(most, summed[k]["most"])
    return out


def _feed(sales: DataFrame, changes: DataFrame, work: str, batches: int, delay: int, bucket_rows: int, large_rows: int, part_rows: int) -> str | None:
    """Write the batches of (batch, client, id, at) and (.., seq, cents, op) for the stream; None without rows."""
    spark = sales.sparkSession

    def summed(df: DataFrame) -> dict:
        known = F.when(F.col("at") != NONE, F.col("at"))
        return {r["batch"]: r for r in df.groupBy("batch").agg(F.max(known).alias("most"), F.min(known).alias("least"), F.count(F.lit(1)).alias("n")).collect()}

    of_sales, of_changes = summed(sales), summed(changes)
    rows = sum(r["n"] for x in (of_sales, of_changes) for r in x.values())
    if not rows:
        return None
    below = _watermarks(of_changes, batches, delay)
    horizons = [min(pair) for pair in zip(below, _watermarks(of_sales, batches, delay), strict=True)]
    times = [r[c] for x in (of_sales, of_changes) for r in x.values() for c in ("least", "most") if r[c] is not None] or [0]
    low, span = min(times), max(times) - min(times) + 1.0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // bucket_rows))

    clients = sales.select("client").unionByName(changes.select("client")).where(F.col("client") != NONE)
    large = clients.groupBy("client").count().where(F.col("count") > large_rows).select("client", F.ceil(F.col("count") / part_rows).cast("int").alias("slices"))
    large = written(large, f"{work}/large")

    def sliced(df: DataFrame) -> DataFrame:
        cut = F.least(F.col("slices") - 1, F.floor((F.col("at") - low) / F.lit(span) * F.col("slices"))).cast("int")
        own = F.when(F.col("at") == NONE, F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")).otherwise(cut)
        return df.join(large, "client", "left").withColumn("slice", F.coalesce(F.when(F.col("slices").isNotNull(), own), F.lit(0)))

    constant = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    cut_changes = sliced(changes)
    hot = cut_changes.where(F.col("slices").isNotNull() & (F.col("at") >= F.get(constant(below), F.col("batch"))))

    def fed(df: DataFrame, kind: int, **columns: Column) -> DataFrame:
        own = {"client": F.lit(NONE), "slice": F.lit(0), "id": F.lit(NONE), "at": F.lit(NONE), "seq": F.lit(NONE), "cents": F.lit(NONE), "op": F.lit(None).cast("string")}
        own |= {c: F.col(c) for c in own if c in df.columns} | columns
        bucket = own.pop("bucket", F.pmod(F.xxhash64(F.when(own["client"] == NONE, own["id"]).otherwise(own["client"]), own["slice"]), F.lit(buckets)))
        types = {"bucket": "int", "slice": "int", "op": "string"}
        every = {"bucket": bucket, "kind": F.lit(kind)} | own
        return df.select("batch", *[v.cast(types.get(c, "int" if c == "kind" else "long")).alias(c) for c, v in every.items()])

    every_batch = F.explode(F.sequence(F.lit(0), F.lit(batches - 1)))
    ticks = spark.range(buckets).select(F.col("id").alias("bucket"), every_batch.alias("batch"))
    ticks = fed(ticks, TICK, bucket=F.col("bucket"), id=F.col("batch"), at=F.get(constant(horizons), F.col("batch")), seq=F.get(constant(below), F.col("batch")), cents=(F.col("batch") == batches - 1).cast("long"))

    # Of a large client: versions so far, those up to H, and the slice of the last of these, after each batch.
    upto = [(F.col("batch") <= k, (F.col("batch") <= k) & (F.col("at") <= horizons[k])) for k in range(batches)]
    per = hot.groupBy("client", "slices").agg(
        F.array(*[F.count_if(came) for came, _ in upto]).alias("came"), F.array(*[F.count_if(old) for _, old in upto]).alias("old"),
        F.array(*[F.coalesce(F.max(F.when(old, F.col("slice"))), F.lit(-1)) for _, old in upto]).alias("top"),
    )
    gone = lambda k: F.greatest(F.lit(0), F.get("old", k) - 1)
    per = large.join(per, ["client", "slices"], "left").select("client", "slices", *[F.coalesce(c, F.array_repeat(F.lit(x), batches)).alias(c) for c, x in (("came", 0), ("old", 0), ("top", -1))])
    per = per.select("*", every_batch.alias("batch")).select(
        "client", "slices", "batch", (F.get("came", F.col("batch")) - F.when(F.col("batch") > 0, gone(F.col("batch") - 1)).otherwise(0)).alias("id"),
        (F.get("came", F.col("batch")) - gone(F.col("batch"))).alias("seq"), F.get("top", F.col("batch")).alias("cents"),
    )
    infos = fed(per.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))), INFO)

    # The last version of this batch in the slices before each: one row a slice.
    best = hot.groupBy("client", "batch", "slice").agg(F.max(F.struct("at", "seq", "id", "cents", "op")).alias("best"))
    grid = large.select("client", "slices", every_batch.alias("batch")).select("client", "batch", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    before = Window.partitionBy("client", "batch").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = grid.join(best, ["client", "batch", "slice"], "left").withColumn("carry", F.max("best").over(before)).where(F.col("carry").isNotNull())
    carries = fed(carried.select("client", "batch", "slice", "carry.*"), CARRY)

    every = ticks.unionByName(fed(sliced(sales), SALE)).unionByName(fed(cut_changes, CHANGE)).unionByName(infos).unionByName(carries)
    every.write.option("compression", "zstd").partitionBy("batch").parquet(f"{work}/batches")
    return f"{work}/batches"


def _release(spark: SparkSession, path: str, folder: str) -> None:
    """Move a written folder below the one that the stream reads."""
    here = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(here, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)):
        raise OSError(f"{path} could not be moved to {folder}")


def enrich_sales(
    sales: DataFrame, changes: DataFrame, batches: int = BATCHES, first_day: int = FIRST_DAY, days: int = DAYS, delay_hours: int = DELAY_HOURS, bucket_rows: int = BUCKET_ROWS,
    large_rows: int = LARGE_ROWS, part_rows: int = PART_ROWS,
) -> DataFrame:
    """rec, id, batch, n_held, change_id, balance_cents, op: a row for every sale, and one for every late change."""
    spark: SparkSession = sales.sparkSession
    work = workspace(spark, "valid-time")
    sold = sales.select(
        _batch(_day(F.col("arrived_at")), batches, first_day, days).alias("batch"), _none(F.col("client_id")).alias("client"), _none(F.col("sale_id")).alias("id"), _none(_micros(F.col("sold_at"))).alias("at"),
    )
    known = changes.where(F.col("valid_at").isNotNull()).distinct()
    shifted = _day(F.col("valid_at")) + F.crc32(F.col("change_id").cast("string")) % 4
    valid = known.select(
        _batch(shifted, batches, first_day, days).alias("batch"), _none(F.col("client_id")).alias("client"), _none(F.col("change_id")).alias("id"), _none(_micros(F.col("valid_at"))).alias("at"),
        _none(F.col("seq")).alias("seq"), _none(F.floor(F.col("balance") * 100 + 0.5)).alias("cents"), "op",
    )
    valid = written(valid, f"{work}/changes")
    staged = _feed(sold, valid, work, batches, delay_hours * 3_600_000_000, bucket_rows, large_rows, part_rows)
    if staged is None:
        return spark.createDataFrame([], RESULT)
    before = {k: spark.conf.get(k, None) for k in _ROCKS}
    for k, v in _ROCKS.items():
        spark.conf.set(k, v)
    try:
        make_folder(spark, f"{work}/feed")
        for k in range(batches):
            _release(spark, f"{staged}/batch={k}", f"{work}/feed/batch={k}")
            batch = spark.readStream.schema(f"{FEED}, batch int").parquet(f"{work}/feed").drop("batch")
            found = batch.groupBy("bucket").transformWithStateInPandas(Bucket(), RESULT, "append", "none")
            found.writeStream.format("parquet").option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start(f"{work}/out").awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for name in ("changes", "large", "batches", "feed", "state"):
        remove(spark, f"{work}/{name}")
    return spark.read.schema(RESULT).parquet(f"{work}/out")


def op13_valid_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich_sales(spark.read.parquet(f"{sf_dir}/sales.parquet"), spark.read.parquet(f"{sf_dir}/client_changes.parquet"))


OP13_SQL = """
WITH k AS (SELECT CAST(unnest(range(9)) AS BIGINT) AS k),
s AS (SELECT sale_id, client_id, sold_at, greatest(0, least(7, CAST(floor((floor(epoch_us(arrived_at) / 86400000000.0) - 19723) * 8 / 152) AS BIGINT))) AS b FROM sales),
d AS (SELECT DISTINCT * FROM client_changes WHERE valid_at IS NOT NULL),
h AS (SELECT *, CAST(change_id AS VARCHAR) AS t FROM d),
z AS (SELECT t, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, length(t) + 1), lambda i: CAST(ascii(substr(t, CAST(i AS INT), 1)) AS BIGINT))),
      lambda c, x: list_reduce(list_concat([xor(c, x)], range(8)), lambda r, j: CASE WHEN r & 1 = 1 THEN xor(r >> 1, CAST(3988292384 AS BIGINT)) ELSE r >> 1 END)) AS c FROM (SELECT DISTINCT t FROM h)),
c AS (SELECT h.*, greatest(0, least(7, CAST(floor((floor(epoch_us(valid_at) / 86400000000.0) + xor(z.c, CAST(4294967295 AS BIGINT)) % 4 - 19723) * 8 / 152) AS BIGINT))) AS b FROM h JOIN z USING (t)),
w AS (SELECT k.k, (SELECT max(sold_at) FROM s WHERE b < k.k) - INTERVAL 12 HOUR AS ws, (SELECT max(valid_at) FROM c WHERE b < k.k) - INTERVAL 12 HOUR AS wc FROM k WHERE k.k < 8),
g AS (SELECT k, wc, CASE WHEN ws IS NULL OR wc IS NULL THEN NULL ELSE least(ws, wc) END AS h FROM w),
late AS (SELECT c.change_id, c.b FROM c JOIN g ON g.k = c.b WHERE c.valid_at < g.wc),
v0 AS (SELECT c.*, (SELECT min(g2.k) FROM g g2 WHERE g2.h >= c.valid_at) AS j0 FROM c JOIN g ON g.k = c.b WHERE (g.wc IS NULL OR c.valid_at >= g.wc) AND c.client_id IS NOT NULL),
v1 AS (SELECT *, min(greatest(b, j0)) FILTER (WHERE j0 IS NOT NULL) OVER (PARTITION BY client_id ORDER BY valid_at, seq NULLS FIRST, change_id NULLS FIRST ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM v0),
v AS (SELECT *, CASE WHEN later IS NULL THEN 99 ELSE greatest(b, later) END AS gone FROM v1),
e AS (SELECT row_number() OVER () AS row, s.*, CASE WHEN sold_at IS NULL THEN b ELSE coalesce((SELECT min(g.k) FROM g WHERE g.k >= s.b AND s.sold_at < g.h), 8) END AS e FROM s),
m AS (SELECT e.row, count(*) AS n_held, arg_max(struct_pack(change_id := v.change_id, balance := v.balance, op := v.op), struct_pack(a := v.valid_at, s := coalesce(v.seq, -9223372036854775808), c := coalesce(v.change_id, -9223372036854775808))) FILTER (WHERE v.valid_at <= e.sold_at) AS best
      FROM e JOIN v ON v.client_id = e.client_id AND v.b <= e.e AND v.gone >= e.e GROUP BY e.row)
SELECT 'sale' AS rec, sale_id AS id, e.e AS batch, coalesce(n_held, 0) AS n_held, best.change_id AS change_id, CAST(floor(100 * best.balance + 0.5) AS BIGINT) AS balance_cents, best.op AS op FROM e LEFT JOIN m USING (row)
UNION ALL SELECT 'late', change_id, b, NULL, NULL, NULL, NULL FROM late
"""
