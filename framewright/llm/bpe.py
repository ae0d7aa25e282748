"""Byte-level BPE by backtracking: exact merge results in time linear in the text.

A text is split by the tokenizer's pattern. Within a piece an Aho-Corasick automaton over all tokens gives the longest
token that starts at each byte. The encoder appends the longest next token while it is compatible with the token
before it, and steps back to the next shorter prefix token where it is not. Two neighbours are compatible if the merge
rules, applied to their joint bytes, give back just these two; answers are kept in a table. The sequence in which all
neighbours are compatible is unique and equals what repeated merging by rank gives.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.session import spread

#: Fixed value: the pattern that the vocabularies of this family split text with before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Folder of the public vocabularies; a parameter of every call.
TOKENIZERS = "/opt/tokenizers"
#: Pieces kept per Python worker with their ids; when full, the memory of pieces starts anew.
PIECES_KEPT = 1 << 18


def load_ranks(path: str | Path) -> list[bytes]:
    """Tokens by id from a rank file of lines ``base64 id``."""
    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    ranks = {int(i): base64.b64decode(t) for t, i in pairs}
    return [ranks[i] for i in range(len(ranks))]


class Encoder:
    """Encoder and decoder of one vocabulary, given as tokens by id (rank order is merge order)."""

    def __init__(self, tokens: list[bytes], pattern: str = PATTERN):
        self.tokens, self.pattern = tokens, pattern
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.split = [self._split(i) for i in range(len(tokens))]
        self.merged = {ab: i for i, ab in enumerate(self.split) if ab[0] != i}
        self.shorter = [next((self.ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids), -1) for t in tokens]
        self.lengths = [len(t) for t in tokens]
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.joined = b"".join(tokens)
        self._live = None

    def __getstate__(self):
        return self.__dict__ | {"_live": None}

    def _split(self, i: int) -> tuple[int, int]:
        """The two tokens whose merge makes token i; (i, i) for a single byte."""
        parts = [self.ids[bytes([b])] for b in self.tokens[i]]
        while len(parts) > 2:
            best, at = i, -1
            for k in range(len(parts) - 1):
                r = self.ids.get(self.tokens[parts[k]] + self.tokens[parts[k + 1]], i)
                if r < best:
                    best, at = r, k
            if at < 0:
                raise ValueError(f"token {i} is no merge of tokens before it")
            parts[at : at + 2] = [best]
        return (parts[0], parts[1]) if len(parts) == 2 else (i, i)

    def _tools(self):
        if self._live is None:
            import ahocorasick
            import regex

            automaton = ahocorasick.Automaton()
            for i, t in enumerate(self.tokens):
                automaton.add_word(t.decode("latin-1"), i)
            automaton.make_automaton()
            self._live = (automaton, regex.compile(self.pattern), {}, {})
        return self._live

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves these two tokens apart.

        The merges that build both tokens are undone from the last one on; at each step the two tokens that touch
        must not form a merge that would have come before the merge undone last.
        """
        known = self._tools()[2]
        key = (left, right)
        if key in known:
            return known[key]
        bound, ok = len(self.tokens), True
        while True:
            joint = self.merged.get((left, right))
            if joint is not None and joint < bound:
                ok = False
                break
            a, b = self.split[left], self.split[right]
            if left > right:
                first, second = ("left", "right")
            else:
                first, second = ("right", "left")
            for side in (first, second):
                if side == "left" and a[0] != left:
                    bound, left = left, a[1]
                    break
                if side == "right" and b[0] != right:
                    bound, right = right + 1, b[0]
                    break
            else:
                break
        if len(known) > 1 << 20:
            known.clear()
        known[key] = ok
        return ok

    def _longest(self, piece: str) -> list[int]:
        at = [-1] * len(piece)
        lengths = self.lengths
        for end, token in self._tools()[0].iter(piece):
            start = end - lengths[token] + 1
            if at[start] < 0 or lengths[at[start]] < lengths[token]:
                at[start] = token
        return at

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ids.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        longest = self._longest(data.decode("latin-1"))
        lengths, shorter = self.lengths, self.shorter
        out: list[int] = []
        dead = bytearray(n + 1)
        pos, token = 0, longest[0]
        while pos < n:
            last = out[-1] if out else -1
            while True:
                end = pos + lengths[token]
                if not dead[end] and (last < 0 or self.compatible(last, token)):
                    out.append(token)
                    pos = end
                    token = longest[end] if end < n else -1
                    break
                if shorter[token] >= 0:
                    token = shorter[token]
                    continue
                dead[pos] = 1
                token = out.pop()
                pos -= lengths[token]
                token_next = shorter[token]
                while token_next < 0:
                    dead[pos] = 1
                    token = out.pop()
                    pos -= lengths[token]
                    token_next = shorter[token]
                token = token_next
                break
        return out

    def encode(self, text: str) -> list[int]:
        _, pattern, _, kept = self._tools()
        out: list[int] = []
        for piece in pattern.findall(text):
            ids = kept.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode("utf-8", "replace"))
                if len(piece) <= 64:
                    if len(kept) >= PIECES_KEPT:
                        kept.clear()
                    kept[piece] = ids
            out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of the ids, each cut from the joined tokens by the offset table."""
        o, joined = self.offsets, self.joined
        return b"".join(joined[o[i] : o[i + 1]] for i in ids).decode("utf-8", "replace")


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> Encoder:
    """The encoder of a rank file, built once per process."""
    key = (folder, name)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(load_ranks(f"{folder}/{name}.tiktoken"))
    return _ENCODERS[key]


def encode_texts(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """Token ids of every row's text, without special tokens (their strings are ordinary text).

    Returns (key, ids ARRAY<INT>), one row per row of ``df``; null and empty texts give an empty list. Lone surrogates
    cannot occur in a Spark string. Repeated rows give repeated rows; other columns are not read.
    """
    kind = df.schema[key].dataType
    shared = df.sparkSession.sparkContext.broadcast(encoder(folder, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared.value
        for batch in batches:
            flat: list[int] = []
            offsets = [0]
            for t in batch.column(1).to_pylist():
                if t:
                    flat.extend(enc.encode(t))
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.record_batch([batch.column(0), ids], names=[key, "ids"])

    return spread(df.select(key, F.col(text).cast("string").alias("__text"))).mapInArrow(run, f"`{key}` {kind.simpleString()}, ids array<int>")


def decode_ids(df: DataFrame, key: str, ids: str = "ids", folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """Inverse of ``encode_texts``: (key, text STRING); a null list gives null, bytes that are no UTF-8 a replacement sign."""
    shared = df.sparkSession.sparkContext.broadcast(encoder(folder, name))

    @F.pandas_udf("string")
    def back(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else shared.value.decode([int(i) for i in x]))

    return df.select(key, back(F.col(ids)).alias("text"))
