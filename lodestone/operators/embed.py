"""Embedding of texts by a provider."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    """Anything that turns texts into vectors of one length; it is sent to the workers."""

    name: str
    dims: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Hashing:
    """Words hashed into a unit vector: repeatable and offline, but no model of meaning."""

    def __init__(self, dims: int = 384):
        self.name, self.dims = f"hashing-{dims}", dims

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), dtype=np.float32)
        for i, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dims] += 1 if h >> 63 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size == 0, 1, size)


def without_vector(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    return chunks.join(embeddings.select("chunk_id"), "chunk_id", "left_anti")


def embedded(rows: DataFrame, provider: Provider, key: str = "chunk_id", text: str = "content", batch: int = 64) -> DataFrame:
    """(key, model, vector, dims) of each row, in batches on the workers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                vectors = provider.embed([t or "" for t in part[text]])
                yield pd.DataFrame({key: part[key].to_numpy(), "vector": list(vectors)})

    found = rows.select(F.col(key).cast("string").alias(key), text).mapInPandas(run, f"{key} string, vector array<float>")
    return found.select(key, F.lit(provider.name).alias("model"), "vector", F.lit(provider.dims).alias("dims"))
