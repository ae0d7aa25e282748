"""A text encoder trained on the texts at hand: words are near where they keep the same company.

Words that stand near each other are counted over the whole corpus, the counts of the WORDS most frequent words become positive pointwise
mutual information, and its leading eigenvectors are the words' vectors. A text is the mean of its words, rarer ones counting more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions import text as X
from framewright.session import cut

#: Words with vectors, which bounds what the driver holds to WORDS ** 2 counts; length of a vector; words to either side that count as near.
WORDS, DIM, NEAR = 2048, 64, 4


@dataclass
class Encoder:
    """Words' places and their weighted vectors."""

    place: dict[str, int]
    vectors: np.ndarray

    def encode(self, tokens: list[str]) -> np.ndarray | None:
        """The vector of length one of a text's words; None where none is known."""
        at = [self.place[t] for t in tokens if t in self.place]
        if not at:
            return None
        v = self.vectors[at].sum(axis=0)
        n = float(np.linalg.norm(v))
        return v / n if n > 0 else None


def fit_encoder(texts: DataFrame, text: str, words: int = WORDS, dim: int = DIM, near: int = NEAR) -> Encoder:
    """An encoder from every text of the table; null and empty texts teach nothing."""
    rows = texts.select(X.word_list(text).alias("w")).where(F.size("w") > 0)
    total = rows.count()
    known = rows.select(F.explode(F.array_distinct("w")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(words).collect()
    place = {r.w: i for i, r in enumerate(known)}
    if not place:
        return Encoder({}, np.zeros((0, dim)))
    shared = texts.sparkSession.sparkContext.broadcast(place)

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = shared.value
        n = len(place)
        counts: dict[int, int] = {}  # combined in the task: at most n * n
        for batch in batches:
            for w in batch.w:
                at = np.array([place.get(t, -1) for t in w])
                for d in range(1, min(near, len(at) - 1) + 1):
                    a, b = at[:-d], at[d:]
                    ok = (a >= 0) & (b >= 0)
                    for x in np.minimum(a, b)[ok] * n + np.maximum(a, b)[ok]:
                        counts[x] = counts.get(x, 0) + 1
        yield pd.DataFrame({"p": list(counts), "n": list(counts.values())}, dtype="int64")

    found = cut(rows.mapInPandas(pairs, "p long, n long").groupBy("p").agg(F.sum("n").alias("n"))).toPandas()
    size = len(place)
    c = np.zeros((size, size), np.float32)
    a, b = np.divmod(found.p.to_numpy(), size)
    c[a, b] += found.n.to_numpy()
    c += c.T
    row = c.sum(axis=1) + 1e-9
    with np.errstate(divide="ignore"):
        m = np.maximum(0, np.log(c * row.sum() / (row[:, None] * row[None, :])))
    values, vectors = np.linalg.eigh(np.nan_to_num(m, neginf=0.0))
    top = np.argsort(-np.abs(values), kind="stable")[:dim]
    vectors = vectors[:, top] * np.sqrt(np.abs(values[top]))
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    rare = np.array([np.log(1 + total / r.n) for r in known])[:, None]
    return Encoder(place, vectors / np.maximum(length, 1e-9) * rare)


def encode_texts(texts: DataFrame, key: str, text: str, encoder: Encoder) -> DataFrame:
    """(key, vector of length one): each text's vector; texts without a known word have none."""
    shared = texts.sparkSession.sparkContext.broadcast(encoder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = [shared.value.encode(list(w)) for w in batch.w]
            keep = [x is not None for x in v]
            yield pd.DataFrame({"k": batch.k[keep].to_numpy(), "vector": pd.Series([x.tolist() for x in v if x is not None], dtype=object)})

    kind = texts.schema[key].dataType.simpleString()
    out = texts.select(F.col(key).alias("k"), X.word_list(text).alias("w")).mapInPandas(run, f"k {kind}, vector array<double>")
    return out.withColumnRenamed("k", key)


def query_vector(encoder: Encoder, query: str) -> list[float]:
    """A query's vector, empty where no word of it is known."""
    import re

    v = encoder.encode(re.findall(r"[a-z']+", query.lower()))
    return [] if v is None else v.tolist()
