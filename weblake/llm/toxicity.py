"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import partial
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from weblake.session import Work

LETTERS = re.compile(r"[^\W\d_]+")
SHOUT = re.compile(r"[!?]{2,}")
#: Lengths of the word starts that count as lexicon entries beside whole words.
STARTS = (4, 5, 6)
PATTERNS = ("two_entries", "dense", "line_start", "shout")


def entries(word: str) -> list[str]:
    """Lexicon entries of a word: itself (``=word``) and its longer starts (``word*``)."""
    return ["=" + word] + [word[:n] + "*" for n in STARTS if len(word) > n]


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows whose labels no model may see."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


@dataclass
class Lexicon:
    """Entries by position; ``hits`` finds those of a text, then the patterns that hold for it."""

    names: list[str]

    def __post_init__(self):
        self.place = {name: i for i, name in enumerate(self.names)}
        self.doors = {name.strip("=*")[:min(STARTS)] for name in self.names}

    def hits(self, text: str | None) -> list[int]:
        lowered = (text or "").lower()
        words = set(LETTERS.findall(lowered))
        found = [w for w in words if w[:min(STARTS)] in self.doors]
        hit = {self.place[e] for w in found for e in entries(w) if e in self.place}
        carriers = {w for w in found if any(e in self.place for e in entries(w))}
        first = {line.split(None, 1)[0].strip(".,;:!?") for line in lowered.split("\n") if line.strip()} if carriers else set()
        holds = (len(carriers) >= 2, len(carriers) * 100 >= len(words) and bool(carriers), bool(carriers & first),
                 bool(SHOUT.search(lowered)))
        return sorted(hit) + [len(self.names) + i for i, x in enumerate(holds) if x]


def _count_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many toxic and clean texts each entry is; counts of many texts are added up before they leave the task."""
    def counted():
        for k, cut in enumerate((0, *STARTS)):
            form = "{}*" if cut else "={}"
            both = counts[0][k].keys() | counts[1][k].keys()
            if both:
                yield pd.DataFrame({"entry": [form.format(w) for w in both], "toxic": [counts[1][k][w] for w in both],
                                    "clean": [counts[0][k][w] for w in both]})

    empty = lambda: [[Counter() for _ in (0, *STARTS)] for _ in range(2)]
    counts = empty()
    for pdf in batches:
        for text, label in zip(pdf["text"], pdf["toxic"]):
            words = set(LETTERS.findall((text or "").lower()))
            found = counts[bool(label)]
            found[0].update(words)
            for k, cut in enumerate(STARTS, 1):
                found[k].update({w[:cut] for w in words if len(w) > cut})
        if sum(len(c) for found in counts for c in found) > 1 << 17:
            yield from counted()
            counts = empty()
    yield from counted()


def mine_lexicon(rows: DataFrame, size: int = 512, least: int = 3, precision: float = 0.9) -> Lexicon:
    """The ``size`` entries that speak most for the toxic class among labelled ``rows`` (text, toxic).

    An entry is in at least ``least`` toxic rows, which are at least ``precision`` of all its rows; with
    half a row added to both classes they still are 0.8, so that a start of few rows needs a clean record.
    """
    n1, n0 = rows.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not n1 or not n0:
        return Lexicon([])
    counted = rows.select("text", "toxic").mapInPandas(_count_entries, "entry string, toxic long, clean long")
    total = counted.groupBy("entry").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    ratio = F.log((F.col("t") + 0.5) / (n1 + 1)) - F.log((F.col("c") + 0.5) / (n0 + 1))
    sure = (F.col("t") + 0.5) / (F.col("t") + F.col("c") + 1) >= 0.8
    sure = sure & (F.col("t") >= precision * (F.col("t") + F.col("c")))
    best = (total.filter((F.col("t") >= least) & sure)
            .orderBy((F.col("t") * ratio).desc(), "entry").limit(size))
    return Lexicon([row.entry for row in best.collect()])


@dataclass
class LabelModel:
    """Class-conditional firing rates of voters, with weights that discount correlated ones."""

    prior: float
    toxic: np.ndarray
    clean: np.ndarray
    weight: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        fired = np.log(self.toxic) - np.log(self.clean)
        quiet = np.log1p(-self.toxic) - np.log1p(-self.clean)
        logit = np.log(self.prior / (1 - self.prior)) + votes @ (self.weight * (fired - quiet)) + (self.weight * quiet).sum()
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_label_model(votes: np.ndarray, steps: int = 25) -> LabelModel:
    """:func:`label_model` of rows x voters (0/1) in memory."""
    votes = votes.astype(np.float64)
    return label_model(lambda sums: sums(votes, np.ones(len(votes))), votes.shape[1], steps)


def label_model(total: Callable, voters: int, steps: int = 25) -> LabelModel:
    """EM over votes, without labels, starting from whether any voter but the last (a style pattern) fires.

    ``total(sums)`` adds up ``sums(votes, n)`` over all rows, where ``n`` says how often each comes; a step
    needs sums of products of votes and posteriors only. A step sets each voter's rate in either class from
    the posteriors, then the correlations of the voters within the classes: what several voters see together
    counts about once.
    """
    def sums(votes, n):
        p = np.where(votes[:, :-1].any(axis=1), 0.9, 0.02) if model is None else model.posterior(votes)
        q = 1 - p
        return np.concatenate([[(n * x).sum() for x in (1, p, q, p * p, p * q, q * q)], votes.T @ (n * p), votes.T @ (n * q),
                               ((votes.T * n) @ votes).ravel()])

    model = None
    for _ in range(steps):
        found = total(sums)
        rows, p, q, pp, pq, qq = found[:6]
        in_toxic, in_clean, both = found[6:6 + voters], found[6 + voters:6 + 2 * voters], found[6 + 2 * voters:].reshape(voters, voters)
        toxic, clean = (in_toxic + 0.5) / (p + 1), (in_clean + 0.05) / (q + 1)
        # The sum over all rows of the outer square of votes - (posterior * toxic + (1 - posterior) * clean).
        cross = np.outer(in_toxic, toxic) + np.outer(in_clean, clean)
        expected = pp * np.outer(toxic, toxic) + qq * np.outer(clean, clean) + pq * (np.outer(toxic, clean) + np.outer(clean, toxic))
        cov = (both - cross - cross.T + expected) / max(1, rows)
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        tied = np.maximum(cov / np.outer(scale, scale), 0)
        np.fill_diagonal(tied, 1)
        model = LabelModel(float(np.clip(p / (p + q), 1e-4, 1 - 1e-4)), np.clip(toxic, 1e-4, 1 - 1e-4),
                           np.clip(clean, 1e-5, 1 - 1e-4), 1 / tied.sum(axis=1))
    return model


def fit_linear(total: Callable, products: np.ndarray, ridge: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient steps; the last weight is the bias.

    ``products`` is the mean of the rows' outer squares, a one for the bias at their ends; ``total(sums)`` adds up ``sums(block)``
    over the blocks of all rows.
    """
    rate = 1 / (0.25 * np.linalg.norm(products, 2) + ridge)
    width = len(products)
    w = past = np.zeros(width)
    for step in range(1, steps + 1):
        ahead = w + (step - 1) / (step + 2) * (w - past)
        found = total(partial(_slopes, ahead))
        gradient = found[:-1] / found[-1] + ridge * ahead * (np.arange(width) < width - 1)
        past, w = w, ahead - rate * gradient
    return w


@dataclass
class Block:
    """Sets of hits as pairs of a row and a hit, how many documents have each set, and their soft label."""

    n: np.ndarray
    row: np.ndarray
    hit: np.ndarray
    soft: np.ndarray | None = None


def _blocks(rows: Iterator, most: int = 4096) -> Iterator[Block]:
    while part := list(islice(rows, most)):
        sizes = [len(r.hits) for r in part]
        yield Block(np.array([r.n for r in part], np.float64), np.repeat(np.arange(len(part), dtype=np.int32), sizes),
                    np.array([h for r in part for h in r.hits], np.int32))


def _slopes(w: np.ndarray, block: Block) -> np.ndarray:
    """Sum of the gradients of a block's documents, then their number."""
    z = np.bincount(block.row, w[block.hit], len(block.n)) + w[-1]
    off = block.n * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - block.soft)
    return np.append(np.bincount(block.hit, off[block.row], len(w) - 1), [off.sum(), block.n.sum()])


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        logit = self.weights[-1] + sum(self.weights[i] for i in self.lexicon.hits(text))
        return 0.0 if logit == -np.inf else float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def _products(sets: DataFrame, width: int) -> np.ndarray:
    """Mean of the outer squares of all rows of ``sets`` (hits, n), with a one at the end of each."""
    pairs = sets.select("n", "hits", F.explode("hits").alias("a")).select("n", "a", F.explode("hits").alias("b"))
    out = np.zeros((width + 1, width + 1))
    for row in pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).collect():  # at most the square of the entries
        out[row.a, row.b] = row.n
    out[:, -1] = out[-1] = np.diag(out)
    out[-1, -1] = sets.agg(F.sum("n")).first()[0]
    return out / out[-1, -1]


def _training_rows(docs: DataFrame, labels: DataFrame, work: Work) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels that may be learned from, as known(doc_id, toxic, copies), the texts (doc_id, text) of ids that ``docs`` has once
    or that may be learned from, and those of ids that it has more often: of these the smallest."""
    known = labels.filter(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = work.table("known", known.join(docs.groupBy("doc_id").agg(F.count("*").alias("copies")), "doc_id"))
    texts = docs.filter(~held_out()).select("doc_id", "text")
    repeated = known.filter("copies > 1")
    if repeated.isEmpty():
        return known, texts, texts.limit(0)
    least = texts.join(repeated.select("doc_id"), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return known, texts, work.table("repeated", least)


def fit(docs: DataFrame, labels: DataFrame, voters: int = 24) -> ToxicityModel:
    """Train on all labelled documents that are not held out.

    The labels choose the lexicon. Its entries are dealt to ``voters`` lexicon voters (words and word
    starts apart) which vote beside the pattern voters; the label model sees votes only, the linear
    classifier the entries and the label model's posteriors. Without both classes the model scores 0.

    Both models see a document as its set of hits; equal sets are counted, and a step of either model is a sum over
    blocks of counted sets, of which the driver gets one row of numbers a partition.
    """
    work = Work(docs.sparkSession, "toxicity")
    known, texts, repeated = _training_rows(docs, labels, work)
    once = known.filter("copies = 1").select("doc_id", "toxic")
    lexicon = mine_lexicon(texts.join(once, "doc_id").unionByName(repeated.join(known.select("doc_id", "toxic"), "doc_id")))
    if not lexicon.names:
        return ToxicityModel(lexicon, np.array([0.0] * len(PATTERNS) + [-np.inf]))

    @F.pandas_udf("array<int>")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([lexicon.hits(t) for t in texts])

    # Narrow rows meet the labels, so that no text is shuffled where these are too many to broadcast.
    found = texts.select("doc_id", hits("text").alias("hits")).join(once.select("doc_id"), "doc_id").select("hits")
    found = found.unionByName(repeated.select(hits("text").alias("hits")))
    sets = work.table("hits", found.groupBy("hits").agg(F.count("*").alias("n")).sortWithinPartitions("hits"))
    width = len(lexicon.names) + len(PATTERNS)
    word = [i for i, n in enumerate(lexicon.names) if n[0] == "="]
    start = [i for i, n in enumerate(lexicon.names) if n[0] != "="]
    groups = [g for kind in (word, start) for i in range(voters // 2) if (g := kind[i::voters // 2])]
    groups += [[i] for i in range(len(lexicon.names), width)]
    voter = np.zeros(width, np.int32)
    for i, group in enumerate(groups):
        voter[group] = i

    def votes(block: Block) -> np.ndarray:
        out = np.zeros((len(block.n), len(groups)))
        out[block.row, voter[block.hit]] = 1
        return out

    # A step is a job: few tasks, each with some ten thousand sets.
    blocks = sets.coalesce(sets.count() // (1 << 16) + 1).rdd.mapPartitions(_blocks).persist(StorageLevel.MEMORY_AND_DISK)
    model = label_model(lambda sums: blocks.map(lambda b: sums(votes(b), b.n)).reduce(np.add), len(groups))
    soft = blocks.map(lambda b: replace(b, soft=model.posterior(votes(b)))).persist(StorageLevel.MEMORY_AND_DISK)
    weights = fit_linear(lambda sums: soft.map(sums).reduce(np.add), _products(sets, width))
    soft.unpersist()
    blocks.unpersist()
    return ToxicityModel(lexicon, weights)


def scores(model: ToxicityModel, text: str | Column = "text") -> Column:
    """Probability from 0 to 1 that a text is toxic; null and empty texts are scored by the bias alone."""
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")
    return run(text)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **limits) -> DataFrame:
    """``docs`` with held_out, score and predicted (existing columns of these names are replaced).

    Whole texts are read; labels, lang, source and doc_id are no inputs of a score. Repeated rows are
    scored each by itself, a null doc_id is not held out, an empty table gives no rows.
    """
    scored = docs.withColumns({"held_out": held_out(), "score": scores(fit(docs, labels, **limits), F.col("text"))})
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
