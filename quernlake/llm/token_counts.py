"""Operator 7: token counts by rank-synchronous array merging.

A text is cut into pre-tokens (a run of the space mark and what follows it, and each line feed; no piece of the
vocabulary crosses such a cut, which is checked).  Pre-tokens not yet known to the worker are held as one ragged array of symbols, and each round applies, in all
sequences at once, the pair of lowest rank that each of them has; sequences without a pair leave.  The surviving symbols
are counted: a piece is one token, a character outside the vocabulary as many as it has bytes.

Defined cases: null and empty texts have 0 bytes and 0 tokens; texts of any length are taken whole; repeated rows each
get a row; an empty table gives an empty result; extra columns are dropped.  Nothing is shuffled.  A worker remembers the
counts of MEMO pre-tokens at most and starts afresh beyond that, which changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlake.llm.common import slices

MEMO = 400_000
TOKEN_LIMIT = 4096
MARK = "▁"
NONE = np.int64(2**62)


class PieceRanks:
    """Pieces of a BPE model, and the rank of each pair of symbols that makes a piece."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        kept = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.pieces = {model.id_to_piece(i): i for i in kept}
        self.total = model.get_piece_size()
        self.bytes = {byte: model.piece_to_id(f"<0x{byte:02X}>") for byte in range(256)}
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in self.pieces):
            raise ValueError("pieces of this vocabulary cross the cuts between pre-tokens")
        rank = self.rank_of = {p: int(-model.get_score(i)) for p, i in self.pieces.items()}
        symbols = dict(self.pieces)
        for piece in self.pieces:
            for char in piece:
                symbols.setdefault(char, self.total + len(symbols))
        self.base = max(symbols.values()) + 2
        pairs = {}
        for piece, merged in self.pieces.items():
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = (rank[piece], merged)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        self.of_char = np.full(0x110000, self.base - 1, np.int64)
        for text, i in symbols.items():
            if len(text) == 1:
                self.of_char[ord(text)] = i

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where there is no such pair) and merged symbol."""
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        found = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        return np.where(found, self.ranks[at], NONE), self.merged[at]

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token (none of them empty)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        width = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
        # what a character counts if it stays alone: one as a piece, else its bytes
        alone = np.where(self.of_char[chars] < self.total, 1, width)
        symbol, cost, owner = self.of_char[chars], alone, np.repeat(np.arange(len(words)), sizes)
        out = np.zeros(len(words), np.int64)
        rank, merged = np.full(len(symbol), NONE), np.zeros(len(symbol), np.int64)
        rank[:-1], merged[:-1] = self.pair(symbol[:-1], symbol[1:])
        rank[:-1][owner[:-1] != owner[1:]] = NONE
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(owner)]))
            least = np.minimum.reduceat(rank, starts)[group]
            go = least != NONE
            if not go.all():
                out += np.bincount(owner[~go], cost[~go], len(words)).astype(np.int64)
                symbol, cost, owner, rank, merged, least, group = (x[go] for x in (symbol, cost, owner, rank, merged, least, group))
                if not len(symbol):
                    break
            at = self._chosen(symbol, owner, group, rank, merged, least)
            symbol[at], cost[at] = merged[at], 1
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            # only pairs that touch a merged symbol change
            at = at - np.arange(len(at))
            symbol, cost, owner, rank, merged = symbol[keep], cost[keep], owner[keep], rank[keep], merged[keep]
            stale = np.r_[at, at - 1]
            stale = stale[(stale >= 0) & (stale < len(symbol) - 1)]
            rank[stale], merged[stale] = self.pair(symbol[stale], symbol[stale + 1])
            rank[stale[owner[stale] != owner[stale + 1]]] = NONE
            rank[-1] = NONE
        return out

    def _chosen(self, symbol, owner, group, rank, merged, least) -> np.ndarray:  # noqa: ANN001
        """Positions at which a pair of its sequence's lowest rank is applied: from the left, without overlap.

        Applying several at once equals applying one after another unless an applied pair makes a new pair of the
        same rank or a lower one; such a sequence applies only its leftmost pair in this round.
        """
        marked = rank == least
        at = np.flatnonzero(marked)
        first = np.r_[True, np.diff(at) > 1] | np.r_[True, owner[at[1:]] != owner[at[:-1]]]
        run = at[np.flatnonzero(first)[np.cumsum(first) - 1]]
        at = at[(at - run) % 2 == 0]
        own = group[at]
        several = np.r_[False, own[1:] == own[:-1]] | np.r_[own[1:] == own[:-1], False]
        if several.any():
            some = at[several]
            made = symbol.copy()
            made[at] = merged[at]
            taken = np.zeros(len(symbol) + 1, bool)
            taken[at + 1] = True
            low = np.zeros(len(some), bool)
            right = some + 2
            ok = right < len(symbol)
            ok[ok] &= owner[right[ok]] == owner[some[ok]]
            low[ok] |= self.pair(merged[some[ok]], symbol[right[ok]])[0] <= least[some[ok]]
            before = some - 1
            before = np.where((before > 0) & taken[before], before - 1, before)
            ok = before >= 0
            ok[ok] &= owner[before[ok]] == owner[some[ok]]
            low[ok] |= self.pair(made[before[ok]], merged[some[ok]])[0] <= least[some[ok]]
            if low.any():
                single = np.zeros(group[-1] + 1, bool)
                single[group[some[low]]] = True
                single = single[own]
                leftmost = np.r_[True, own[1:] != own[:-1]]
                at = at[~single | leftmost]
        return at


@lru_cache(2)
def ranks_of(path: str) -> PieceRanks:
    return PieceRanks(path)


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text with the space mark in place of spaces and one mark before all; [] for an empty text."""
    if not text:
        return []
    if text[0] != " " and "  " not in text and MARK not in text and text[-1] != " ":
        return list(filter(None, (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ")))
    return re.findall(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+", MARK + text.replace(" ", MARK))


def count_tokens(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) by the BPE vocabulary in ``model``, a path that executors can read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known = ranks_of(model), {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = [len(t.encode()) for t in texts]
            tokens = []
            for a, b in slices(texts):
                words = [pre_tokens(t) for t in texts[a:b]]
                fresh = list(set().union(*words).difference(known))
                if len(known) + len(fresh) > MEMO:
                    known.clear()
                    fresh = list(set().union(*words))
                if fresh:
                    known.update(zip(fresh, vocabulary.counts(fresh).tolist(), strict=True))
                tokens += [sum(map(known.__getitem__, w)) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
