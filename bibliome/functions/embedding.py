"""Encoders of texts to vectors behind one protocol, and hashed words, which need no model."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")


class Encoder(Protocol):
    """What an encoder has to offer; vectors have length one, or are all zero for a text without words."""

    model_key: str
    dimension: int

    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


class HashedWords:
    """Words of any script, the whole text's, by the root of how often they occur; a word's two hashes give the two coordinates
    it adds to, one upwards and one downwards, so that single collisions don't make texts alike."""

    def __init__(self, dimension: int = 768) -> None:
        self.dimension = dimension
        self.model_key = f"hashed-words-{dimension}"

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        counted = [Counter(_WORD.findall(t.casefold())) for t in texts]
        vocabulary = {w: n for n, w in enumerate({w for c in counted for w in c})}
        raw = b"".join(xxhash.xxh128_digest(w) for w in vocabulary)
        up, down = np.frombuffer(raw, np.uint64).reshape(-1, 2).T % self.dimension if vocabulary else np.zeros((2, 0), np.uint64)
        row = np.repeat(np.arange(len(texts)), [len(c) for c in counted])
        word = np.array([vocabulary[w] for c in counted for w in c], np.int64)
        worth = np.sqrt(np.array([n for c in counted for n in c.values()], np.float32))
        out = np.zeros((len(texts), self.dimension), np.float32)
        np.add.at(out, (row, up[word].astype(np.int64)), worth)
        np.subtract.at(out, (row, down[word].astype(np.int64)), worth)
        length = np.sqrt((out * out).sum(1, keepdims=True))
        return np.divide(out, length, out=out, where=length > 0)


#: Encoders by name.
ENCODERS = {"hashed-words": HashedWords}


def build_encoder(name: str, **options: int) -> Encoder:
    if name not in ENCODERS:
        raise ValueError(f"unknown encoder {name!r}; known are {sorted(ENCODERS)}")
    return ENCODERS[name](**options)


def embedded(df: DataFrame, id_col: str, text_col: str, encoder: Encoder) -> DataFrame:
    """(id, model_key, text_hash, vector): one narrow stage that reads each text once; a null text is an empty one, and each row
    gives a row, also where an id is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = encoder.encode([t or "" for t in b.column(1).to_pylist()])
            offsets = pa.array(np.arange(0, v.size + 1, encoder.dimension, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.ListArray.from_arrays(offsets, pa.array(v.ravel(), pa.float32()))], ["id", "text_hash", "vector"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    x = df.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"), F.sha2(text, 256).alias("text_hash"))
    v = x.mapInArrow(run, "id bigint, text_hash string, vector array<float>")
    return v.select("id", F.lit(encoder.model_key).alias("model_key"), "text_hash", "vector")
