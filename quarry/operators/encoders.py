"""Encoders as plug-ins: texts to unit vectors, in small batches that shrink when memory runs out."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from quarry.functions.text import TOKEN

#: Texts of a call, and how often a call is tried.
BATCH, TRIES = 2, 3


class Encoder(Protocol):
    """What a model has to offer: a row of numbers for each text; it is pickled to the executors and may load there."""

    width: int

    def documents(self, texts: list[str]) -> np.ndarray: ...

    def queries(self, texts: list[str]) -> np.ndarray: ...


class HashEncoder:
    """The built-in one, without a model: tokens into signed buckets by their CRC-32."""

    def __init__(self, width: int = 64):
        self.width = width

    def documents(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        for row, text in zip(out, texts, strict=True):
            found = re.findall(TOKEN, text)
            hashes = np.fromiter((zlib.crc32(w.lower().encode()) for w in found), np.int64, len(found))
            np.add.at(row, hashes % self.width, np.where(hashes >> 31, 1.0, -1.0))
        return out

    queries = documents


def _out_of_memory(error: Exception) -> bool:
    return isinstance(error, MemoryError) or (isinstance(error, RuntimeError) and "memory" in str(error).lower())


def encode_all(encode, texts: list[str], width: int, batch: int = BATCH, tries: int = TRIES) -> tuple[np.ndarray, int]:
    """Unit vectors of the texts, in their order, and the batch size that worked in the end.

    Texts of like length go together. A call that runs out of memory is tried again with half as many texts, and
    the calls after it stay at that size; with ``tries`` failures in a row, or with one text left, the error stands.
    """
    out = np.zeros((len(texts), width), np.float32)
    order = sorted(range(len(texts)), key=lambda i: (len(texts[i]), i))
    at, failed = 0, 0
    while at < len(order):
        own = order[at : at + batch]
        try:
            rows = np.asarray(encode([texts[i] for i in own]), np.float64)
        except (MemoryError, RuntimeError) as e:
            failed += 1
            if not _out_of_memory(e) or failed >= tries or batch == 1:
                raise
            batch = max(1, batch // 2)
            continue
        norms = np.linalg.norm(rows, axis=1, keepdims=True)
        out[own] = rows / np.where(norms > 0, norms, 1.0)
        at, failed = at + len(own), 0
    return out, batch


def embed(rows: DataFrame, key: str, text: Column, encoder: Encoder, kind: str = "document", batch: int = BATCH, tries: int = TRIES) -> DataFrame:
    """(key, embedding) of every row: unit vectors, zeros where the encoder has nothing to say; null texts are empty.

    kind: ``document`` or ``query``, for models that tell them apart.
    """
    if kind not in ("document", "query"):
        raise ValueError(f"not a kind of text: {kind!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = encoder.documents if kind == "document" else encoder.queries, batch
        for some in batches:
            found, size = encode_all(encode, [x or "" for x in some["text"].to_pylist()], encoder.width, size, tries)
            flat = pa.array(found.ravel())
            yield pa.RecordBatch.from_arrays([some[key], pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * encoder.width), flat)], names=[key, "embedding"])

    told = rows.select(key, text.cast("string").alias("text"))
    return told.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, embedding array<float>")
