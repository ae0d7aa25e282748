"""Personal information in free text: labelers vote, expectation-maximisation weighs them, a classifier decides.

1. Words that the corpus writes in small letters are counted in one pass; frequent ones are one labeler's reason against a name.
2. Grammars propose spots and labelers vote on each (``pii_spans``), in one pass over all texts.
3. Spots with the same votes are counted over the whole corpus. Expectation-maximisation on these counts estimates, per family
   of types, how often a spot is true and how each labeler votes, or abstains, on true and on false ones. Every labeler starts from the
   same belief; the counts may overrule it for each of them.
4. A logistic classifier is trained on a bounded sample of spots with the estimated probabilities as soft labels; its features are the
   votes, the shape and the words of context, so it also decides where labelers abstain.
5. Every spot is classified; of overlapping accepted spots of a text the longest stays.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.pii_spans import GIVEN, NONE, spots_of
from framewright.session import cut, spread

#: Spots per family of the sample that the classifier is trained on; which ones is set by a hash.
TRAIN_SPOTS = 4000
#: Hashed features of the classifier.
FEATURES = 1 << 13
#: Rounds of expectation-maximisation and of gradient descent.
EM_ROUNDS, TRAIN_ROUNDS = 60, 150
#: Share of votes of a labeler that are taken to be right before any text is seen, and the weight of that belief: votes at least,
#: and a share of the spots, so that it counts alike at every size.
PRIOR_RIGHT, PRIOR_WEIGHT, PRIOR_SHARE = 0.9, 40.0, 0.1
#: Share of spots taken to be true before any text is seen, and from which probability a spot is accepted.
PRIOR_TRUE, ACCEPT = 0.5, 0.5
#: A word is common from this share of all words in small letters, so there are 1 / COMMON_SHARE common words at most, and from this count.
COMMON_SHARE, COMMON_COUNT = 1e-5, 3
#: An unlisted name is a fixed phrase from this share of all unlisted candidates, so there are 1 / PHRASE_SHARE phrases at most, and from this count.
PHRASE_SHARE, PHRASE_COUNT = 1e-4, 10
#: Distinct words that a task counts before it hands on partial counts.
TASK_WORDS = 200_000

_SPOT = "array<struct<family:string,start:int,end:int,votes:string,words:array<string>,phrase:string>>"


_SMALL = re.compile(r"(?<![\w@.+'’-])[a-zß-öø-ÿ]{3,}(?=[\s,;:!?)]|\.\s|\.?$)")


def common_words(df: DataFrame, text: str) -> frozenset:
    """Words that make up at least COMMON_SHARE of the corpus's words in small letters; 1 / COMMON_SHARE of them at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(_SMALL.findall(t))
            if len(seen) > TASK_WORDS:
                yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])
                seen.clear()
        yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])

    counts = cut(spread(df.where(F.col(text).isNotNull()).select(F.col(text).alias("t"))).mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return frozenset(r.w for r in counts.where(F.col("n") >= max(COMMON_COUNT, total * COMMON_SHARE)).collect())


def find_spots(df: DataFrame, key: str, text: str, common: frozenset = frozenset(), given_names: frozenset = GIVEN) -> DataFrame:
    """(key, spots): the candidates of each text that has any, with the votes as ``labeler=vote`` joined by blanks."""
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast((common, given_names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common, given = shared.value
        for batch in batches:
            keys, out = [], []
            for k, t in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
                found = spots_of(t, common, given)
                if found:
                    keys.append(k)
                    out.append([(s.family, s.start, s.end, " ".join(f"{n}={v}" for n, v in s.votes.items() if v), s.words, s.phrase) for s in found])
            yield pd.DataFrame({"k": pd.Series(keys, dtype=batch.iloc[:, 0].dtype), "spots": pd.Series(out, dtype=object)})

    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return spread(rows).mapInPandas(run, f"k {kind}, spots {_SPOT}")


class VoteModel:
    """Reliability of the labelers of one family, by expectation-maximisation over counted vote patterns."""

    def __init__(self, counts: dict[str, int], rounds: int = EM_ROUNDS):
        patterns = [[v.split("=") for v in p.split()] for p in counts]
        n = np.array(list(counts.values()), float)
        names = sorted({name for p in patterns for name, _ in p})
        yes = np.array([[any(a == name and v != NONE for a, v in p) for name in names] for p in patterns], float).reshape(len(n), len(names))
        no = np.array([[any(a == name and v == NONE for a, v in p) for name in names] for p in patterns], float).reshape(len(n), len(names))
        # Start from the majority of votes; a belief of the same fixed weight for all keeps rare labelers from being turned around.
        post = 1 / (1 + np.exp(-((yes - no) @ np.full(len(names), math.log(PRIOR_RIGHT / (1 - PRIOR_RIGHT))))))
        weight = max(PRIOR_WEIGHT, PRIOR_SHARE * n.sum())
        for _ in range(rounds):
            w1, w0 = n * post, n * (1 - post)
            share = (w1.sum() + PRIOR_WEIGHT * PRIOR_TRUE) / (n.sum() + PRIOR_WEIGHT)
            # A labeler's votes compared between true and false spots; abstaining tells nothing.
            up = np.log((w1 @ yes + weight * PRIOR_RIGHT) / (w1.sum() + weight)) - np.log((w0 @ yes + weight * (1 - PRIOR_RIGHT)) / (w0.sum() + weight))
            down = np.log((w1 @ no + weight * (1 - PRIOR_RIGHT)) / (w1.sum() + weight)) - np.log((w0 @ no + weight * PRIOR_RIGHT) / (w0.sum() + weight))
            post = 1 / (1 + np.exp(-np.clip(math.log(share / (1 - share)) + yes @ up + no @ down, -30, 30)))
        self.posterior = dict(zip(counts, post.tolist()))
        self.up, self.down, self.share = dict(zip(names, up)), dict(zip(names, down)), float(share)

    def probability(self, votes: str) -> float:
        known = self.posterior.get(votes)
        if known is not None:
            return known
        z = math.log(self.share / (1 - self.share))
        for v in votes.split():
            name, vote = v.split("=")
            z += self.down.get(name, 0.0) if vote == NONE else self.up.get(name, 0.0)
        return 1 / (1 + math.exp(-z))


def features(family: str, votes: str, words: list[str]) -> list[int]:
    """Hashed feature numbers of a spot: its votes, pairs of votes, shape and context."""
    v = votes.split()
    names = [family, *(f"{family}|{x}" for x in v), *(f"{family}|{a}&{b}" for i, a in enumerate(v) for b in v[i + 1 :])]
    return [zlib.crc32(n.encode()) % FEATURES for n in names] + context_features(family, words)


def context_features(family: str, words) -> list[int]:
    return [zlib.crc32(f"{family}|{w}".encode()) % FEATURES for w in words]


def train(spots: list[tuple[str, str, list[str]]], labels: np.ndarray, rounds: int = TRAIN_ROUNDS) -> np.ndarray:
    """Weights of a logistic classifier for soft labels, by adaptive gradient descent with a small penalty."""
    rows = [features(*s) for s in spots]
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.fromiter((c for r in rows for c in r), int)
    w, seen = np.zeros(FEATURES), np.full(FEATURES, 1e-8)
    for _ in range(rounds):
        z = np.bincount(at, weights=w[col], minlength=len(rows))
        err = 1 / (1 + np.exp(-z)) - labels
        grad = np.bincount(col, weights=err[at], minlength=FEATURES) / max(1, len(rows)) + 1e-5 * w
        seen += grad * grad
        w -= 0.3 * grad / np.sqrt(seen)
    return w


_PHRASE = f"name_phrase={NONE}"


def fixed_phrases(spots: DataFrame) -> frozenset:
    """Names without a listed given name that recur like a sign or a firm; 1 / PHRASE_SHARE of them at most."""
    counts = cut(spots.select(F.explode("spots.phrase").alias("p")).where("p is not null").groupBy("p").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return frozenset(r.p for r in counts.where(F.col("n") >= max(PHRASE_COUNT, total * PHRASE_SHARE)).collect())


def fit(spots: DataFrame, phrases: frozenset = frozenset()) -> tuple[dict[str, VoteModel], np.ndarray]:
    """Vote models by family over all spots, and the classifier's weights from a bounded sample."""
    known = spots.sparkSession.createDataFrame([(p,) for p in sorted(phrases)], "phrase string")
    flat = spots.select(F.explode("spots").alias("s")).select("s.*").join(F.broadcast(known.withColumn("fixed", F.lit(_PHRASE))), "phrase", "left")
    flat = cut(flat.select("family", F.trim(F.concat_ws(" ", "votes", "fixed")).alias("votes"), "words", "start"))
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    # As many rows as there are vote patterns, which the labelers bound, not the corpus.
    for r in flat.groupBy("family", "votes").count().orderBy("family", "votes").collect():
        counts[r["family"]][r["votes"]] = r["count"]
    models = {family: VoteModel(c) for family, c in counts.items()}
    sample, labels = [], []
    for family, c in sorted(counts.items()):
        share = min(1.0, TRAIN_SPOTS / max(1, sum(c.values())))
        own = flat.where((F.col("family") == family) & (F.pmod(F.xxhash64("votes", "words", "start"), F.lit(1 << 20)) < int(share * (1 << 20))))
        for votes, words in sorted((r.votes, list(r.words)) for r in own.select("votes", "words").limit(2 * TRAIN_SPOTS).collect()):
            sample.append((family, votes, words))
            labels.append(models[family].probability(votes))
    return models, train(sample, np.array(labels)) if sample else np.zeros(FEATURES)


def detect(df: DataFrame, key: str, text: str, given_names: frozenset = GIVEN) -> DataFrame:
    """(key, pii_type, start_pos BIGINT, end_pos BIGINT): each spot of personal information, in code points from 0.

    start_pos is the first letter or digit, end_pos the place after the last character. Spots of one row don't overlap. Null keys, null
    and empty texts give none; repeated rows give repeated spots; an empty table gives none. Other columns are not read.
    """
    spots = cut(find_spots(df, key, text, common_words(df, text), given_names))
    phrases = fixed_phrases(spots)
    models, weights = fit(spots, phrases)
    shared = df.sparkSession.sparkContext.broadcast((models, weights.astype(np.float32), phrases))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models, w, phrases = shared.value
        weigh = lru_cache(maxsize=1 << 16)(lambda family, votes: (float(w[features(family, votes, [])].sum()), models[family].probability(votes)))
        for batch in batches:
            rows = []
            for k, found in zip(batch.k, batch.spots):
                taken = []
                for s in found:
                    z, expected = weigh(s["family"], f"{s['votes']} {_PHRASE}".strip() if s["phrase"] in phrases else s["votes"])
                    z += float(w[context_features(s["family"], s["words"])].sum())
                    # The classifier decides; where it is undecided the estimate from the votes does.
                    p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
                    if abs(p - ACCEPT) < 0.25:
                        p = (p + expected) / 2
                    if p >= ACCEPT:
                        taken.append((s["end"] - s["start"], p, s["start"], s["end"], s["family"]))
                taken.sort(key=lambda x: (-x[0], -x[1], x[2], x[4]))
                kept: list[tuple[int, int]] = []
                for _, _, a, b, family in taken:
                    if all(b <= c or a >= d for c, d in kept):
                        kept.append((a, b))
                        rows.append((k, family, a, b))
            yield pd.DataFrame(rows, columns=["k", "pii_type", "start_pos", "end_pos"])

    return spots.mapInPandas(run, f"k {kind}, pii_type string, start_pos long, end_pos long").withColumnRenamed("k", key)


def redact(df: DataFrame, key: str, text: str, found: DataFrame | None = None) -> DataFrame:
    """(key, text): each distinct key's text with placeholders like [EMAIL] for its spots, otherwise unchanged; null stays null."""
    found = detect(df, key, text) if found is None else found
    places = found.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("start_pos", "end_pos", "pii_type"))).alias("places"))

    @F.pandas_udf("string")
    def put(texts: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for t, p in zip(texts, places):
            if t is not None and p is not None and len(p):
                parts, at = [], 0
                for s in p:
                    parts += [t[at : s["start_pos"]], f"[{s['pii_type'].upper()}]"]
                    at = s["end_pos"]
                t = "".join(parts) + t[at:]
            out.append(t)
        return pd.Series(out, dtype=object)

    return df.select(key, text).dropDuplicates([key]).join(places, key, "left").select(key, put(F.col(text), F.col("places")).alias(text))
