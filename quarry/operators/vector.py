"""Vector retrieval: exact distances, scores relative to the candidates, an approximate option."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.fuse import min_max


def squared_distance(a: Column, b: Column) -> Column:
    """Sum of squared differences in double, in order of the elements."""
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)


def distances(vectors: DataFrame, key: str, column: str, query: list[float]) -> DataFrame:
    """(key, distance) of every vector; the query is a literal."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, squared_distance(F.col(column), literal).alias("distance"))


def nearest(vectors: DataFrame, key: str, column: str, query: list[float], k: int) -> DataFrame:
    """The k nearest, by distance and key: a top-k in every task, merged."""
    return distances(vectors, key, column, query).orderBy("distance", key).limit(k)


def semantic_scores(measured: DataFrame, key: str = "vec_id") -> DataFrame:
    """(key, distance, semantic): 1 for the nearest of the candidates, 0 for the farthest, 1 for all if equal."""
    return min_max(measured, "distance", "semantic", nearer_is_better=True)


def nearest_by_matrix(vectors: DataFrame, key: str, column: str, query: list[float], k: int) -> DataFrame:
    """As nearest, with one matrix product per Arrow batch and a top-k in every task (for wide vectors)."""
    q = np.asarray(query, np.float64)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = pd.DataFrame({key: pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})
        for batch in batches:
            m = np.stack(batch[column].to_numpy()).astype(np.float64) if len(batch) else np.empty((0, len(q)))
            found = pd.DataFrame({key: batch[key], "distance": ((m - q) ** 2).sum(axis=1)})
            best = pd.concat([best, found]).sort_values(["distance", key]).head(k)
        yield best

    return vectors.select(key, column).mapInPandas(each, f"{key} long, distance double").orderBy("distance", key).limit(k)


def lsh_nearest(vectors: DataFrame, key: str, column: str, query: list[float], k: int, tables: int = 16, bucket: float = 1.0) -> DataFrame:
    """The approximate option: random projections choose candidates, exact distances rank them; exact if they choose fewer than k."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    dense = vectors.select(key, column, array_to_vector(F.col(column).cast("array<double>")).alias("_dense"))
    model = BucketedRandomProjectionLSH(inputCol="_dense", outputCol="_hashes", bucketLength=bucket, numHashTables=tables, seed=7).fit(dense)
    hashed = model.transform(dense)
    own = [float(h[0]) for h in model.transform(vectors.sparkSession.createDataFrame([(Vectors.dense(query),)], ["_dense"])).first()["_hashes"]]
    same = F.lit(False)
    from pyspark.ml.functions import vector_to_array

    for i, h in enumerate(own):
        same = same | (vector_to_array(F.get("_hashes", F.lit(i)))[0] == h)
    near = hashed.where(same)
    # Too few candidates for k: the exact search, which has them all.
    return nearest(near if near.limit(k).count() == k else vectors, key, column, query, k)
