"""Token counts of a byte-fallback BPE model by merging many pre-tokens at once in numpy arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

SPACE = "▁"
#: Score of the pieces that merge last, whatever else is there.
LAST = -1e8
CACHE = 300_000
#: Slots of the table of pairs, as a power of two: well over ten for each pair of a vocabulary of 32,000.
SLOT_BITS = 20
#: Pre-tokens longer than this are merged one at a time, all places of their best pair in one step.
LONG = 256
#: Pre-tokens merged together: bounds the arrays.
BATCH = 16_384


class Merger:
    """Merge rules of a model as a hash table in arrays; symbols are numbered pieces, unknown characters come after."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        known = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        pieces = {model.id_to_piece(i): i for i in known}
        self.size, self.chars = size, {p: i for p, i in pieces.items() if len(p) == 1}
        scores = np.full(size, -np.inf)
        scores[known] = [model.get_score(i) for i in known]
        order = np.unique(-scores[known])  # equal scores share a rank
        rank = np.searchsorted(order, -scores)
        keys, ranks, merged = [], [], []
        joined = set()
        for piece, i in pieces.items():
            if len(piece) > 1:
                joined.update(piece)
            for cut in range(1, len(piece)):
                left, right = pieces.get(piece[:cut]), pieces.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left * size + right)
                    ranks.append(rank[i])
                    merged.append(i)
        self.keys, self.ranks, self.merged = (np.array(x, np.int64) for x in (keys, ranks, merged))
        self.slots = np.full(1 << SLOT_BITS, -1, np.int64)
        for i, slot in enumerate(self._slot(self.keys).tolist()):
            while self.slots[slot] >= 0:
                slot = (slot + 1) % len(self.slots)
            self.slots[slot] = i
        self.none = len(order)
        self.last = int(np.searchsorted(order, -LAST))
        #: Where no piece goes on across a character or a space begins, the merges on either side are independent.
        alone = "".join(re.escape(c) for c in sorted(set(map(chr, range(33))) - joined))
        self.cut = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]")
        self.cache: dict[str, int] = {}

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``none`` where the pair is no piece) and merged symbol of each pair, by open addressing."""
        rank, merged = np.full(len(left), self.none), np.zeros(len(left), np.int64)
        open_ = np.flatnonzero((left < self.size) & (right < self.size))
        key = left[open_] * self.size + right[open_]
        slot = self._slot(key)
        while len(open_):
            at = self.slots[slot]
            used = at >= 0
            open_, key, slot, at = open_[used], key[used], slot[used], at[used]
            hit = self.keys[at] == key
            rank[open_[hit]], merged[open_[hit]] = self.ranks[at[hit]], self.merged[at[hit]]
            open_, key, slot = open_[~hit], key[~hit], (slot[~hit] + 1) % len(self.slots)
        return rank, merged

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ragged arrays of all words: symbols, the word of each, the tokens that each stands for.

        A character that is no piece falls back to its UTF-8 bytes and never merges.
        """
        text = "".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        unique, place = np.unique(points, return_inverse=True)
        ids = np.array([self.chars.get(chr(c), self.size) for c in unique], np.int64)
        cost = np.array([1 if chr(c) in self.chars else len(chr(c).encode("utf-8", "replace")) if not 0xD800 <= c < 0xE000 else 3
                         for c in unique], np.int64)
        return ids[place], np.repeat(np.arange(len(words)), lengths), cost[place]

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each word.

        A round finds the best pair of every word, the leftmost of equals, merges these at once and
        drops the words that have none, whose surviving symbols are their tokens.
        """
        symbol, word, cost = self.symbols(words)
        total = np.zeros(len(words), np.int64)
        rank, merged = self.pair_ranks(symbol, np.append(symbol[1:], self.size))
        rank[np.flatnonzero(np.append(word[1:] != word[:-1], True))] = self.none
        while len(symbol):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbol)))
            done = np.repeat(best == self.none, sizes)
            total += np.bincount(word[done], cost[done], len(words)).astype(np.int64)
            at = np.flatnonzero((rank == np.repeat(best, sizes)) & ~done)
            at = at[np.append(True, word[at][1:] != word[at][:-1])] if len(at) else at  # the leftmost
            symbol[at] = merged[at]
            keep = ~done
            keep[at + 1] = False
            spot = (np.cumsum(keep) - 1)[at]
            symbol, word, cost, rank, merged = symbol[keep], word[keep], cost[keep], rank[keep], merged[keep]
            touched = np.concatenate([spot, spot[spot > 0] - 1])  # the pairs that a merge has changed
            touched = touched[touched < len(symbol) - 1]
            rank[spot] = self.none
            rank[touched], merged[touched] = self.pair_ranks(symbol[touched], symbol[touched + 1])
            rank[touched[word[touched] != word[touched + 1]]] = self.none
        return total

    def count_long(self, word: str) -> int:
        """Tokens of one long word: a step merges every place of its best pair.

        A merge never makes a better pair than itself, so the places do not interfere but where they
        overlap, and there the left one goes first. The runs of spaces, whose pieces all score the
        same, are merged one pair at a time.
        """
        symbol, _, cost = self.symbols([word])
        while len(symbol) > 1:
            rank, merged = self.pair_ranks(symbol[:-1], symbol[1:])
            best = rank.min()
            if best == self.none:
                break
            at = np.flatnonzero(rank == best)
            if best >= self.last:
                at = at[:1]
            else:  # of a run of overlapping places every other one
                run = np.cumsum(np.append(True, np.diff(at) > 1))
                first = np.append(0, np.flatnonzero(np.diff(run)) + 1)
                at = at[(np.arange(len(at)) - first[run - 1]) % 2 == 0]
            symbol[at] = merged[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, cost = symbol[keep], cost[keep]
        return int(cost.sum())

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text: a space begins one, as does what no piece continues across."""
        if not text:
            return []
        return self.cut.findall(SPACE + text.replace(" ", SPACE))

    def count_texts(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Words met before are looked up; the cache is bounded."""
        split = [self.words(t or "") for t in texts]
        new = list({w for words in split for w in words if w not in self.cache})
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = list({w for words in split for w in words})
        short = sorted((w for w in new if len(w) <= LONG), key=len)
        for i in range(0, len(short), BATCH):
            self.cache.update(zip(short[i:i + BATCH], self.count(short[i:i + BATCH]).tolist()))
        self.cache.update((w, self.count_long(w)) for w in new if len(w) > LONG)
        return [sum(map(self.cache.__getitem__, words)) for words in split]


def model_path(name: str) -> str:
    """Where the machine that runs the task has the vocabulary."""
    import public_tokenizers
    return public_tokenizers.path(name)


#: Texts counted together: enough to fill the arrays, few enough to bound the word lists.
TEXTS = 512


def token_counts(text: str | Column = "text", model: str = "piece_bpe_32k.model", path: str | None = None) -> Column:
    """Tokens of each text as a bigint, as the model's library counts them; null and empty texts have 0.

    ``path`` is the vocabulary's place on every executor, else that of the installed ``model``.
    """
    @F.pandas_udf("bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        merger = Merger(path or model_path(model))
        for texts in batches:
            texts = texts.tolist()
            yield pd.Series([n for i in range(0, len(texts), TEXTS) for n in merger.count_texts(texts[i:i + TEXTS])],
                            dtype="int64")
    return run(text)


def count_tokens(docs: DataFrame, limit: int = 4096) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (existing columns of these names are replaced).

    Whole texts are counted, repeated rows each by itself; an empty table gives no rows.
    """
    counted = docs.withColumns({"n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"),
                                "n_tokens": token_counts(F.col("text"))})
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
