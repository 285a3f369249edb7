"""An inverted vector file with product codes: a search reads codes of the cells near its query, and few vectors.

``build_cells`` fits centroids and codebooks on a bounded, documented sample (``SAMPLE`` vectors, by a hash of their
key) and indexes every vector. It goes to the cell of its nearest centroid; cells are partitions of a Parquet table,
and a cell that holds many vectors lies in several files. Its code is a byte for every ``WIDTH`` elements, the nearest
of 256 words of that subspace; codes lie in blocks of one cell, a sixteenth of the vectors' bytes. ``cells`` has a row
for each cell (centroid, radius, number) and ``books`` the words, and how many cells to probe: as many as found
``AIM`` of the sample's own nearest neighbours.

* ``nearest_in_cells`` measures the vectors of the nearest cells. With exact=True it then also reads every cell whose
  centroid is so near, and whose radius so large, that it may hold a vector nearer than the k-th found (triangle
  inequality): the result is that of ``nearest``. With fewer than k found it goes on in that way, too.
* ``nearest_of_many`` answers a table of queries: blocks of codes meet blocks of queries by cell, the best ``rerank``
  by code of each query are looked up and measured.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.vector import distances, squared_distance

SAMPLE, MOST_CELLS, PROBES, ITERATIONS, SHARD = 20_000, 4096, 8, 12, 1_000_000
#: Elements of a subspace, its words, the recall that probes are set for, queries of a block.
WIDTH, WORDS, AIM, QUERIES = 4, 256, 0.98, 256
#: Distances that are held at once, and bytes of a batch of codes and queries: a worker's memory depends on neither cells nor vectors.
HELD, BATCH_BYTES = 1 << 20, 16 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _distances(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((rows**2).sum(axis=1)[:, None] - 2 * rows @ centers.T + (centers**2).sum(axis=1)[None], 0.0)


def _steps(n: int, width: int) -> Iterator[slice]:
    """Slices of n rows with at most HELD distances to width others."""
    step = max(1, HELD // max(1, width))
    return (slice(at, at + step) for at in range(0, n, step))


def _nearest(rows: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest center."""
    own, away = np.zeros(len(rows), np.int32), np.zeros(len(rows))
    for part in _steps(len(rows), len(centers)):
        d = _distances(rows[part], centers)
        own[part], away[part] = d.argmin(axis=1), d.min(axis=1)
    return own, away


def _sample(vectors: DataFrame, key: str, column: str, most: int) -> np.ndarray:
    """At most ``most`` vectors, which meet in the driver; the same ones of the same table."""
    some = vectors.where(F.col(column).isNotNull()).orderBy(F.xxhash64(key), key).limit(most).select(column).toArrow()[column].combine_chunks()
    return _matrix(some)


def centroids(rows: np.ndarray, most: int) -> np.ndarray:
    """Centers of at most ``most`` clusters of rows."""
    centers = np.unique(rows, axis=0)
    centers = centers[np.random.default_rng(7).permutation(len(centers))[:most]]
    for _ in range(ITERATIONS):
        own, _ = _nearest(rows, centers)
        sums, n = np.zeros_like(centers), np.bincount(own, minlength=len(centers))
        np.add.at(sums, own, rows)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def _encoded(rows: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    return np.stack([_nearest(rows[:, WIDTH * i : WIDTH * i + WIDTH], book)[0].astype(np.uint8) for i, book in enumerate(books)], axis=1)


def _probes(rows: np.ndarray, centers: np.ndarray, k: int = 10, queries: int = 200) -> int:
    """The fewest nearest cells that hold AIM of the k nearest of some rows among all rows."""
    own, asked = _nearest(rows, centers)[0], rows[:queries]
    near = np.argsort(_distances(asked, rows), axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(_distances(asked, centers), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(AIM * len(needed)))]) + 1


def build_cells(vectors: DataFrame, key: str, column: str, path: str, cells: int | None = None, sample: int = SAMPLE, shard: int = SHARD) -> None:
    """Write the vectors (null ones left out) by cell below path; about the root of their number cells by default."""
    n, spark = vectors.count(), vectors.sparkSession
    rows = _sample(vectors, key, column, sample)
    centers = centroids(rows, cells or max(1, min(MOST_CELLS, round(n**0.5)))) if len(rows) else np.zeros((1, 1))
    books = [centroids(rows[:, i : i + WIDTH], WORDS) for i in range(0, rows.shape[1], WIDTH)]
    kind = vectors.schema[key].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, away = _nearest(_matrix(batch[column]), centers)
            yield pa.RecordBatch.from_arrays([batch[key], batch[column], pa.array(np.sqrt(away)), pa.array(own)], names=["key", "vector", "away", "cell"])

    own = vectors.where(F.col(column).isNotNull()).select(key, F.col(column).cast("array<float>").alias(column))
    placed = own.mapInArrow(assign, f"key {kind}, vector array<float>, away double, cell int")
    placed = placed.repartition("cell", F.pmod(F.xxhash64("key"), F.lit(max(1, n // shard))))
    placed.write.option("compression", "zstd").partitionBy("cell").parquet(f"{path}/vectors")
    stored = _vectors(spark, path, kind)
    per = stored.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n"))
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>")
    known.join(per, "cell").write.parquet(f"{path}/cells")
    probes = _probes(rows, centers) if len(rows) else 1
    spark.createDataFrame([(i, book.ravel().tolist(), probes) for i, book in enumerate(books)], "place int, words array<double>, probes int").coalesce(1).write.parquet(f"{path}/books")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            in_cell = batch["cell"].to_numpy()
            edges = np.flatnonzero(np.diff(in_cell)) + 1
            for begin, end in zip(np.r_[0, edges], np.r_[edges, len(in_cell)], strict=True) if len(in_cell) else ():
                part = batch.slice(begin, end - begin)
                codes = _encoded(_matrix(part["vector"]), books).tobytes()
                keys = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part["key"])
                yield pa.RecordBatch.from_arrays([pa.array([in_cell[begin]], pa.int32()), keys, pa.array([codes], pa.binary())], names=["cell", "keys", "codes"])

    ordered = stored.repartition("cell", F.pmod(F.xxhash64("key"), F.lit(max(1, n // shard)))).sortWithinPartitions("cell", "key")
    ordered.select("key", "vector", "cell").mapInArrow(encode, f"cell int, keys array<{kind}>, codes binary").write.parquet(f"{path}/codes")


def _vectors(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(f"key {kind}, vector array<float>, away double, cell int").parquet(f"{path}/vectors")


def _cells(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, centers, radii), at most MOST_CELLS of them."""
    rows = spark.read.schema("cell int, center array<double>, radius double, n long").parquet(f"{path}/cells").orderBy("cell").collect()
    return np.array([r["cell"] for r in rows], np.int64), np.array([r["center"] for r in rows]), np.array([r["radius"] for r in rows])


def nearest_in_cells(spark: SparkSession, path: str, query: list[float], k: int, probes: int = PROBES, exact: bool = False, kind: str = "long") -> DataFrame:
    """(key, distance) of the k nearest that the nearest cells hold; of all if exact."""
    names, centers, radii = _cells(spark, path)
    rows = _vectors(spark, path, kind)
    if not len(names):
        return distances(rows, "key", "vector", query)
    away = np.sqrt(_distances(np.asarray(query, np.float64)[None], centers)[0])
    order = np.lexsort([names, away])
    first = order[:probes]
    found = lambda some: distances(rows.where(F.col("cell").isin(*names[some].tolist())), "key", "vector", query).orderBy("distance", "key").limit(k)
    near = found(first)
    farthest = [r["distance"] for r in near.select("distance").collect()]
    if len(farthest) == k and not exact:
        return near
    least = max(farthest) ** 0.5 if len(farthest) == k else np.inf
    more = [i for i in order[probes:] if away[i] - radii[i] <= least + 1e-6]
    return near if not more else near.unionByName(found(np.array(more))).orderBy("distance", "key").limit(k)


def nearest_of_many(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None, rerank: int | None = None, kind: str = "long") -> DataFrame:
    """(query, key, distance, rank): k near vectors of each query, measured among the best by code. queries: query, vector.

    probes: cells of a query, by default as many as the index was measured to need; rerank: vectors measured, 10 k by default.
    """
    names, centers, _ = _cells(spark, path)
    books = spark.read.parquet(f"{path}/books").orderBy("place").collect()
    words = [np.array(r["words"]).reshape(-1, min(WIDTH, centers.shape[1] - WIDTH * i)) for i, r in enumerate(books)] if len(names) else []
    probes, rerank = probes or (books[0]["probes"] if books else 1), rerank or 10 * k
    query_kind = queries.schema["query"].dataType.simpleString()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries of each cell, in blocks."""
        for batch in batches:
            for at in range(0, len(batch) if len(names) else 0, QUERIES):
                part = batch.slice(at, QUERIES)
                near = names[np.argsort(_distances(_matrix(part["vector"]), centers), axis=1, kind="stable")[:, :probes]]
                for cell in np.unique(near):
                    own = part.take(pa.array(np.flatnonzero((near == cell).any(axis=1))))
                    one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own[c])  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), one("query"), one("vector")], names=["cell", "queries", "wanted"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best of a block of codes for each query of a block."""
        for batch in batches:
            for i in range(len(batch)):
                keys, asked, wanted = (batch[c][i].values for c in ("keys", "queries", "wanted"))
                codes = np.frombuffer(batch["codes"][i].as_py(), np.uint8).reshape(len(keys), -1)
                rows = _matrix(wanted)
                for part in _steps(len(asked), len(keys)):
                    sums = np.zeros((len(rows[part]), len(keys)))
                    for place, book in enumerate(words):
                        sums += _distances(rows[part, WIDTH * place : WIDTH * place + WIDTH], book)[:, codes[:, place]]
                    best = np.argsort(sums, axis=1, kind="stable")[:, :rerank]
                    of = np.repeat(np.arange(part.start, part.start + len(sums)), best.shape[1])
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(of)), keys.take(pa.array(best.ravel())), pa.array(np.take_along_axis(sums, best, axis=1).ravel())], names=["query", "key", "guess"])

    asked = queries.where(F.col("vector").isNotNull()).select("query", F.col("vector").cast("array<float>").alias("vector"))
    # A row holds a block of codes and one of queries: batches go by their bytes, not by 10,000 rows.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    blocks = asked.mapInArrow(choose, f"cell int, queries array<{query_kind}>, wanted array<array<float>>")
    codes = spark.read.schema(f"cell int, keys array<{kind}>, codes binary").parquet(f"{path}/codes")
    guessed = codes.join(blocks, "cell").select("keys", "codes", "queries", "wanted").mapInArrow(look, f"query {query_kind}, key {kind}, guess double")
    best = guessed.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("guess", "key"))).where(F.col("nth") <= rerank)
    measured = best.select("query", "key").join(_vectors(spark, path, kind).select("key", "vector"), "key").join(asked.withColumnRenamed("vector", "wanted"), "query")
    nth = F.row_number().over(Window.partitionBy("query").orderBy("distance", "key"))
    return measured.select("query", "key", squared_distance(F.col("vector"), F.col("wanted")).alias("distance")).withColumn("rank", nth).where(F.col("rank") <= k)
