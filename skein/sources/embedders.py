"""Providers of text vectors: a small interface, the hashing one, and a registry of names.

A provider turns a list of texts into unit vectors. It is made once per Python worker from its
settings, so that a model is loaded once; texts travel in Arrow batches. No model and no network
comes with this library: other providers are registered by whoever has them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    """What a provider offers: its name and vectors of many texts, a row each."""

    name: str

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Bag of words hashed into ``dim`` buckets; equal in any process. Texts without words give zeros."""

    def __init__(self, dim: int = 256) -> None:
        self.dim, self.name = dim, f"hashing-{dim}"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for k, t in enumerate(texts):
            for w in (t or "").lower().split():
                out[k, int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "little") % self.dim] += 1
        return unit_rows(out)


class BatchEmbedder:
    """A provider around a function from texts to vectors, called with ``batch`` texts at most.

    The function may give (index, vector) pairs in any order, as services do, or plain vectors;
    ``model`` is what the provider is named after.
    """

    def __init__(self, call: Callable[[list[str]], list], model: str, batch: int = 64) -> None:
        self.call, self.name, self.batch = call, model, batch

    def embed(self, texts: list[str]) -> np.ndarray:
        out: list[np.ndarray] = []
        for a in range(0, len(texts), self.batch):
            some = texts[a : a + self.batch]
            got = self.call(some)
            if got and isinstance(got[0], tuple):
                got = [v for _, v in sorted(got, key=lambda x: x[0])]
            if len(got) != len(some):
                raise ValueError(f"{self.name} gave {len(got)} vectors for {len(some)} texts")
            out.append(np.asarray(got, np.float32))
        return unit_rows(np.concatenate(out)) if out else np.zeros((0, 0), np.float32)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def embed_one(model: Embedder, text: str) -> np.ndarray:
    return model.embed([text])[0]


#: Name -> function from settings to a provider; names are looked up without regard to - and _.
_PROVIDERS: dict[str, Callable[[dict], Embedder]] = {}


def register(make: Callable[[dict], Embedder], *names: str) -> None:
    """Make a provider known under names. ``make`` must be picklable, as tasks call it."""
    for n in names:
        _PROVIDERS[n.lower().replace("-", "_")] = make


def _hashing(cfg: dict) -> Embedder:
    return HashingEmbedder(int(cfg.get("hash_dim", 256)))


register(_hashing, "hashing", "smoke")


def provider(cfg: dict) -> Callable[[dict], Embedder]:
    """The maker that the setting ``backend`` names; ValueError for an unknown one."""
    name = str(cfg.get("backend", "hashing")).lower().replace("-", "_")
    if name not in _PROVIDERS:
        raise ValueError(f"unknown embedding backend: {name}")
    return _PROVIDERS[name]


def build(cfg: dict) -> Embedder:
    return provider(cfg)(cfg)


def embedded(rows: DataFrame, text: str, cfg: dict) -> DataFrame:
    """Rows with embedder (name) and emb (array of floats) of the text; a null text counts as empty."""
    make, at = provider(cfg), rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make(cfg)
        for batch in batches:
            x = model.embed([t or "" for t in batch.column(at).to_pylist()])
            emb = pa.array(list(x), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([model.name] * len(batch)), emb], [*batch.schema.names, "embedder", "emb"])

    schema = T.StructType([*rows.schema.fields, T.StructField("embedder", T.StringType()), T.StructField("emb", T.ArrayType(T.FloatType()))])
    return rows.mapInArrow(run, schema)


def text_sha(text: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of a text: what a stored vector is recognised by."""
    return F.substring(F.sha2(text, 256), 1, 16)
