"""Evaluation passages inside a corpus: BM25 index of the items, block-max WAND per passage, then word alignment.

The items are the indexed side. Each corpus text is cut into passages of PASSAGE words that overlap by half; each is a
query against the index and retrieves every item above a threshold. The threshold is no tuning value: for each item the
least score that any quotation of it with the allowed changes can have is worked out, and the item's weights are divided
by it, so an item with a true quotation always scores 1 or more. For all passages of a text at once the largest weights of
wide blocks of items are summed; where a sum stays below 1 no item of the block can reach it, and a passage without any block
left is done. The others run block-max WAND over the narrow blocks. Retrieved pairs are verified by aligning words.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.session import spread

#: A quotation: words at least, and one changed word (replaced, left out or put in) allowed for so many.
MIN_WORDS, PER_CHANGE = 15, 8
#: Words per passage; half of it must hold a quotation of up to 31 words with its changes.
PASSAGE = 72
#: Items per index, and wide blocks of one; the corpus is read once per index, so that what is broadcast is bounded (about 2 KB an item).
INDEX_ITEMS, WIDE_BLOCKS = 65536, 64
#: Items per block of a posting list, each block with its largest weight.
BLOCK = 16
#: Words of the longest exact stretch that every quotation has at least: its matched words lie in one stretch more than it has
#: changes, so 14 words in 3 stretches are the worst case. Pairs without a common stretch are not aligned.
STRETCH = 5
#: BM25 parameters.
K1, B = 1.2, 0.75

_UNSEEN = re.compile("[­​-‏‪-‮⁠﻿]")
_BROKEN = re.compile(r"(?<=\w)[-‐‑][ \t]*[\r\n]+[ \t>*#|]*(?=\w)")
_MARK = re.compile(r"[\[(]?\b\d{1,2}:[0-5]\d(?::[0-5]\d)?(?:[.,]\d{1,3})?\b[\])]?(?:[ \t]*(?:-->|[-–])[ \t]*\d{1,2}:[0-5]\d(?::[0-5]\d)?(?:[.,]\d{1,3})?)?(?:[ \t]+(?:uh|um|so|right|well|okay)\b,?)?", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,60}>")
_HYPHEN = re.compile(r"(?<=\w)[-‐‑](?=\w)")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Words without case, punctuation, line breaks (hyphens of broken words too), time marks and light markup."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    text = _UNSEEN.sub("", text)
    text = _MARK.sub(" ", _TAG.sub(" ", _BROKEN.sub("", text)))
    return _WORD.findall(_HYPHEN.sub("", text).replace("'", "").replace("’", "").casefold())


class ItemIndex:
    """BM25 postings of items with block maxima; weights are divided by each item's least score of a quotation."""

    def __init__(self, items: list[tuple[int, list[str]]], wide_blocks: int = WIDE_BLOCKS):
        items = sorted((i, w) for i, w in items if len(w) >= MIN_WORDS)
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        mean = sum(map(len, self.words)) / max(1, len(items))
        df = Counter(t for w in self.words for t in set(w))
        idf = {t: math.log(1 + (len(items) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for at, w in enumerate(self.words):
            score = {t: idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(w) / mean)) for t, n in Counter(w).items()}
            least = self._least(w, score)
            for t, s in score.items():
                postings[t].append((at, s / least if least > 1e-9 else 1.0))
        self.stretches: dict[tuple, list[int]] = defaultdict(list)
        for at, w in enumerate(self.words):
            for h in {tuple(w[i : i + STRETCH]) for i in range(len(w) - STRETCH + 1)}:
                self.stretches[h].append(at)
        self.at = {t: np.array([p for p, _ in rows]) for t, rows in postings.items()}
        self.weight = {t: np.array([s for _, s in rows]) for t, rows in postings.items()}
        # Blocks of BLOCK items that a posting list touches, and its largest weight in each.
        self.blocks, self.block_max = {}, {}
        for t, at in self.at.items():
            first = np.flatnonzero(np.diff(at // BLOCK, prepend=-1))
            self.blocks[t], self.block_max[t] = (at // BLOCK)[first], np.maximum.reduceat(self.weight[t], first)
        self.row = {t: i for i, t in enumerate(self.at)}
        self.width = max(1, -(-len(items) // (BLOCK * wide_blocks)))
        self.wide_max = np.zeros((len(self.row) + 1, max(1, -(-len(items) // (BLOCK * self.width)))), np.float32)
        for t, i in self.row.items():
            np.maximum.at(self.wide_max[i], self.blocks[t] // self.width, self.block_max[t])

    @staticmethod
    def _least(words: list[str], score: dict[str, float]) -> float:
        """Least score of a passage that quotes the item: over all windows, without the heaviest words that may be changed."""
        found = math.inf
        for size in (MIN_WORDS, 2 * PER_CHANGE, 3 * PER_CHANGE):
            for i in range(len(words) - size + 1):
                part = sorted((score[t] for t in set(words[i : i + size])), reverse=True)
                found = min(found, sum(part[size // PER_CHANGE :]))
        return found

    def may_score(self, passages: list[set[str]]) -> np.ndarray:
        """For each passage, the wide blocks that may give 1 or more; the sums are of single precision, so the bound is a little below 1."""
        none = len(self.row)  # a row of zeros, so that no passage is empty
        rows = [[none, *(self.row[t] for t in p if t in self.row)] for p in passages]
        begin = np.cumsum([0, *map(len, rows[:-1])])
        sums = np.add.reduceat(self.wide_max[np.fromiter((r for x in rows for r in x), np.int64)], begin, axis=0)
        return sums >= 1.0 - 1e-4

    def search(self, terms: set[str], wide: np.ndarray | None = None) -> list[int]:
        """Positions of all items whose weights over the terms sum to 1 or more, by block-max WAND.

        The threshold is fixed, so WAND's test, the sum of upper bounds against it, is made for all blocks at once: for the wide blocks
        (unless the caller did), for the blocks within those that pass, and the postings of the blocks that pass are summed.
        """
        need = 1.0 - 1e-9
        found = [t for t in terms if t in self.row]
        if not found:
            return []
        wide = self.may_score([set(found)])[0] if wide is None else wide
        edge = np.flatnonzero(np.diff(wide.astype(np.int8), prepend=0, append=0))
        out: list[int] = []
        for a, b in edge.reshape(-1, 2) * self.width:
            cut = [(t, *np.searchsorted(self.blocks[t], (a, b))) for t in found]
            bound = np.bincount(np.concatenate([self.blocks[t][p:q] - a for t, p, q in cut]), np.concatenate([self.block_max[t][p:q] for t, p, q in cut]), b - a)
            passed = bound >= need
            if not passed.any():
                continue
            cut = [(t, *np.searchsorted(self.at[t], (a * BLOCK, b * BLOCK))) for t, p, q in cut if q > p]
            items, weights = np.concatenate([self.at[t][p:q] - a * BLOCK for t, p, q in cut]), np.concatenate([self.weight[t][p:q] for t, p, q in cut])
            keep = passed[items // BLOCK]
            out += (np.flatnonzero(np.bincount(items[keep], weights[keep]) >= need) + a * BLOCK).tolist()
        return out


def quotes(item: list[str], text: list[str]) -> bool:
    """Whether MIN_WORDS or more words of the item in a row stand in the text, one change per PER_CHANGE words allowed.

    A quotation begins and ends with a word of the item. For each start the furthest reach per number of changes and
    diagonal is followed.
    """
    where = defaultdict(list)
    for j, t in enumerate(text):
        where[t].append(j)
    n, m = len(item), len(text)
    for i0 in range(n - MIN_WORDS + 1):
        for j0 in where.get(item[i0], ()):
            if i0 and j0 and item[i0 - 1] == text[j0 - 1]:
                continue
            reach = {j0 - i0: i0}
            for changes in range((n - i0) // PER_CHANGE + 1):
                best = 0
                for diagonal, i in reach.items():
                    j = i + diagonal
                    while i < n and j < m and item[i] == text[j]:
                        i, j = i + 1, j + 1
                    reach[diagonal] = i
                    if i > best and i > i0 and 0 < j <= m and item[i - 1] == text[j - 1]:
                        best = i
                if best - i0 >= max(MIN_WORDS, changes * PER_CHANGE):
                    return True
                nxt: dict[int, int] = {}
                for diagonal, i in reach.items():
                    for d, to in ((diagonal, i + 1), (diagonal - 1, i + 1), (diagonal + 1, i)):
                        if to <= n and 0 <= to + d <= m and to > nxt.get(d, -1):
                            nxt[d] = to
                # After three changes a quotation has had 3 * PER_CHANGE words, or its start is elsewhere.
                if changes >= 3:
                    nxt = {d: i for d, i in nxt.items() if i - i0 >= (changes - 2) * PER_CHANGE}
                if not nxt:
                    break
                reach = nxt
    return False


def leaked_items(corpus: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str) -> DataFrame:
    """(key BIGINT, item_key BIGINT): each pair of a corpus text and an item that it quotes.

    A quotation is MIN_WORDS words that follow each other in the item, with one change per PER_CHANGE words. Null and
    empty texts quote nothing, items of fewer words are never quoted, null keys give no rows. Repeated rows give one pair;
    empty tables give none. Names of other columns don't matter.
    """
    spark = corpus.sparkSession
    texts = corpus.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    rows = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_key).cast("long").alias("i"), F.col(item_text).alias("t"))
    parts = -(-rows.count() // INDEX_ITEMS)
    found = None
    for part in range(parts):
        own = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == part)
        pairs = _search_part(texts, [(r.i, words_of(r.t)) for r in own.collect()])
        found = pairs if found is None else found.unionByName(pairs)
    found = spark.createDataFrame([], "k long, i long") if found is None else found
    return found.distinct().select(F.col("k").alias(key), F.col("i").alias(item_key))


def _search_part(texts: DataFrame, items: list[tuple[int, list[str]]]) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(ItemIndex(items))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for batch in batches:
            out = []
            for k, t in zip(batch.k, batch.t):
                words = words_of(t)
                near = defaultdict(list)
                starts = range(0, max(1, len(words) - PASSAGE // 2), PASSAGE // 2)
                terms = [set(words[at : at + PASSAGE]) for at in starts]
                wide = index.may_score(terms)
                for n in np.flatnonzero(wide.any(axis=1)):
                    if retrieved := index.search(terms[n], wide[n]):
                        at = starts[n]
                        part = words[at : at + PASSAGE]
                        common = {x for i in range(len(part) - STRETCH + 1) for x in index.stretches.get(tuple(part[i : i + STRETCH]), ())}
                        for item in retrieved:
                            if item in common:
                                near[item].append(at)
                for item, places in near.items():
                    # Passages that follow each other are verified as one stretch.
                    stretches = []
                    for at in places:
                        if stretches and at <= stretches[-1][1]:
                            stretches[-1][1] = at + PASSAGE
                        else:
                            stretches.append([at, at + PASSAGE])
                    if any(quotes(index.words[item], words[a:b]) for a, b in stretches):
                        out.append((k, index.ids[item]))
            yield pd.DataFrame(out, columns=["k", "i"]).astype("int64")

    return spread(texts).mapInPandas(run, "k long, i long")
