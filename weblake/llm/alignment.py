"""Alignment of two tokenizers over the same bytes, all documents of a batch advancing in lockstep."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weblake.llm.common import free_names
from weblake.llm.tokens import SPACE, model_path
from weblake.session import Work

#: Characters of the texts that are aligned together, which bounds the arrays; a longer text is alone.
BATCH_CHARS = 1_500_000
#: A document with more A tokens enters as several lanes, so that a long one takes no more steps than others.
LANE = 512
NAMES = ("n_a", "n_b", "n_groups", "n_links", "groups", "links")
LINK = pa.struct([pa.field(f, pa.int32()) for f in ("a", "b", "n")])
TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(LINK))
DDL = "{} long, {} long, {} long, {} long, {} string, {} array<struct<a: int, b: int, n: int>>"


class ByteLevel:
    """Ids and token bytes of a byte-level BPE vocabulary, special strings being plain text.

    The ranks are the vocabulary of ``byte_bpe_50k.json`` and give its library's ids, several times as fast.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.model = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [self.model.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int64) for t in texts]


class Pieces:
    """Ids and token bytes of a piece model with byte fallback, which puts a space in front of a text itself."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode()
                      for i, p in enumerate(pieces)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(i, np.int64) for i in self.model.encode(texts, num_threads=1)]


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, firsts_a: np.ndarray, firsts_b: np.ndarray) -> np.ndarray:
    """For each A token the B token that ends with it, or -1.

    ``ends_*`` are the running byte ends of the tokens of all documents in a row; a document begins at
    the tokens ``firsts_*`` and has the same bytes on both sides. One state vector holds the A and B
    pointer of every lane. A step compares the ends at the pointers: the side that ends first moves on,
    and where both end together a link and a cut are emitted and both move. Finished lanes are dropped.
    """
    found = np.full(len(ends_a), -1, np.int64)
    at_a, at_b, stop = lanes(ends_a, ends_b, firsts_a, firsts_b)
    while len(at_a):
        end_a, end_b = ends_a[at_a], ends_b[at_b]
        both = end_a == end_b
        found[at_a[both]] = at_b[both]
        at_a = at_a + (end_a <= end_b)
        at_b = at_b + (end_b <= end_a)
        going = at_a < stop
        if not going.all():
            at_a, at_b, stop = at_a[going], at_b[going], stop[going]
    return found


def lanes(ends_a: np.ndarray, ends_b: np.ndarray, firsts_a: np.ndarray, firsts_b: np.ndarray) -> tuple:
    """Start of each lane in A and B, and where it stops in A.

    A lane begins with its document, and about every :data:`LANE` tokens after a byte where both sides
    end: the first such byte from there on, which the end of the document is at last.
    """
    last = np.append(firsts_a[1:], len(ends_a)) - 1
    counts = np.maximum((last - firsts_a) // LANE, 0)
    spots = np.repeat(firsts_a, counts) + LANE * (1 + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) - 1
    places = np.searchsorted(ends_b, ends_a[spots])
    open_ = np.flatnonzero(ends_b[places] != ends_a[spots])
    while len(open_):
        spots[open_] += 1
        places[open_] = np.searchsorted(ends_b, ends_a[spots[open_]])
        open_ = open_[ends_b[places[open_]] != ends_a[spots[open_]]]
    inner = ~np.isin(spots, last)
    starts_a = np.concatenate([firsts_a, spots[inner] + 1])
    starts_b = np.concatenate([firsts_b, places[inner] + 1])
    starts_a, order = np.unique(starts_a, return_index=True)
    return starts_a, starts_b[order], np.append(starts_a[1:], len(ends_a))


class Aligner:
    """Alignment of texts by two vocabularies."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.width_a, self.width_b = (np.array([len(x) for x in v.bytes], np.int64) for v in (self.a, self.b))
        self.words = [f"{i}{end}" for i in range(max(len(self.a.bytes), len(self.b.bytes))) for end in ",|;"]

    def texts(self, texts: list[str | None]) -> list[pa.Array]:
        """The columns :data:`NAMES` of some texts."""
        whole = [i for i, t in enumerate(texts) if t]
        ids_a, ids_b = self.a.ids([texts[i] for i in whole]), self.b.ids([texts[i] for i in whole])
        spoken = [(" " + texts[i]).encode("utf-8", "surrogatepass") for i in whole]
        # A has a token for every byte and drops none, so its length tells; B may have changed characters.
        same = [x for x, data in enumerate(spoken) if int(self.width_a[ids_a[x]].sum()) == len(data)
                and b"".join(map(self.b.bytes.__getitem__, ids_b[x].tolist())) == data]
        kept = [whole[x] for x in same]
        sizes_a, sizes_b = (np.array([len(ids[x]) for x in same], np.int64) for ids in (ids_a, ids_b))
        empty = np.array([], np.int64)
        ids_a, ids_b = (np.concatenate([empty, *(ids[x] for x in same)]) for ids in (ids_a, ids_b))
        firsts_a, firsts_b = np.cumsum(sizes_a) - sizes_a, np.cumsum(sizes_b) - sizes_b
        found = lockstep(np.cumsum(self.width_a[ids_a]), np.cumsum(self.width_b[ids_b]), firsts_a, firsts_b)

        cut_a = np.flatnonzero(found >= 0)  # the last A and B token of each group
        cut_b = found[cut_a]
        doc = np.repeat(np.arange(len(kept)), sizes_a)[cut_a]
        last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        last_a[cut_a] = last_b[cut_b] = 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        code = np.empty(len(ids_a) + len(ids_b), np.int64)
        ends_b = np.append(0, cut_b + 1)  # B tokens before each group, A tokens up to its end
        code[np.arange(len(ids_a)) + ends_b[group_a]] = 3 * ids_a + last_a
        code[np.arange(len(ids_b)) + cut_a[group_b] + 1] = 3 * ids_b + 2 * last_b
        code = code.tolist()

        out = {name: [0] * len(texts) for name in NAMES[:4]} | {"groups": [""] * len(texts)}
        groups = np.bincount(doc, minlength=len(kept)).tolist()
        at = 0
        for n, (i, a, b) in enumerate(zip(kept, sizes_a.tolist(), sizes_b.tolist())):
            out["n_a"][i], out["n_b"][i], out["n_groups"][i], out["n_links"][i] = a, b, groups[n], groups[n]
            out["groups"][i] = "".join(map(self.words.__getitem__, code[at:at + a + b]))[:-1]
            at += a + b

        wide = len(self.b.bytes)
        pairs = ids_a[cut_a] * wide + ids_b[cut_b]
        keys, n = np.unique(doc * (len(self.a.bytes) * wide) + pairs, return_counts=True)
        owner, pairs = np.divmod(keys, len(self.a.bytes) * wide)
        per_text = np.zeros(len(texts), np.int64)
        per_text[kept] = np.bincount(owner, minlength=len(kept))
        links = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (*np.divmod(pairs, wide), n)], fields=list(LINK))
        offsets = pa.array(np.append(0, np.cumsum(per_text)).astype(np.int32))
        return [*(pa.array(out[name], t) for name, t in zip(NAMES[:5], TYPES)), pa.ListArray.from_arrays(offsets, links)]


@functools.lru_cache(maxsize=2)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def align(docs: DataFrame, text: str = "text", a_model: str = "byte_bpe_50k.tiktoken", b_model: str = "piece_bpe_32k.model",
          a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``docs`` with n_a, n_b, n_groups, n_links, groups and links (existing columns of these names are replaced).

    A encodes the text with a space in front, B the text; special strings are plain text. Bytes where
    tokens of both end cut them into groups: ``groups`` holds them as ``a1,a2|b1;a3|b2,b3`` in order.
    ``links`` are the distinct pairs (a, b) of tokens that end together and how often each occurs. Texts
    that are null, empty, or that either side does not give back byte by byte have no tokens: zeros, an
    empty string, no links. Rows are aligned each by itself, repeated ones too; an empty table gives no
    rows. Whole texts are read, in batches of bounded size.
    """
    kept = [c for c in docs.columns if c.lower() not in NAMES]
    given, = free_names(kept, "text_read")
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text).alias(given))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path or model_path(a_model), b_path or model_path(b_model))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            start, chars = 0, 0
            for i in range(batch.num_rows):
                chars += len(texts[i].as_py() or "")
                if chars >= BATCH_CHARS or i == batch.num_rows - 1:
                    part = batch.slice(start, i + 1 - start)
                    columns = [*part.columns[:-1], *aligner.texts(part.columns[-1].to_pylist())]
                    yield pa.RecordBatch.from_arrays(columns, names=[*kept, *NAMES])
                    start, chars = i + 1, 0

    return rows.mapInArrow(run, ", ".join(filter(None, [schema, DDL.format(*NAMES)])))


def link_counts(aligned: DataFrame) -> DataFrame:
    """a, b, count of every pair linked anywhere in ``aligned`` (from :func:`align`).

    Of two tokens that end together one ends in the other, so there are no more rows than such pairs of
    the two vocabularies, some 400,000 here, whatever the corpus (:func:`most_pairs`).
    """
    return aligned.select(F.inline("links")).groupBy("a", "b").agg(F.sum("n").alias("count"))


def most_pairs(aligner: Aligner) -> int:
    """How many pairs of tokens can end together at all."""
    a, b = ({} for _ in range(2))
    for index, side in ((a, aligner.a), (b, aligner.b)):
        for token in side.bytes:
            index[token] = index.get(token, 0) + 1
    return (sum(n * b.get(t[i:], 0) for t, n in a.items() for i in range(len(t)))
            + sum(n * a.get(t[i:], 0) for t, n in b.items() for i in range(1, len(t))))


def with_counts(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` with n_best, links whose count is the highest of their B id (ties too), and count_sum, the sum
    over links of their counts, instead of the links.

    ``counts`` (from :func:`link_counts`) is sent to every task: its size is bounded by the vocabularies.
    """
    table = counts.toPandas()
    key = table["a"].to_numpy(np.int64) << 32 | table["b"].to_numpy(np.int64)
    best = (table["count"] == table.groupby("b")["count"].transform("max")).to_numpy()
    order = np.argsort(key)
    sent = aligned.sparkSession.sparkContext.broadcast((key[order], table["count"].to_numpy(np.int64)[order], best[order]))
    kept = [c for c in aligned.columns if c not in ("links", "n_best", "count_sum")]
    schema = ", ".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, count, best = sent.value
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            links = lists.flatten()
            a, b, n = (links.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("a", "b", "n"))
            place = np.searchsorted(keys, a << 32 | b)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            n_best, count_sum = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(n_best, row, n * best[place])
            np.add.at(count_sum, row, n * count[place])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_best), pa.array(count_sum)],
                                             names=[*kept, "n_best", "count_sum"])

    return aligned.select(*(F.col(f"`{c}`") for c in kept), "links").mapInArrow(run, f"{schema}, n_best long, count_sum long")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts and groups_sha256 ('' without tokens) of every row of ``docs`` (doc_id, text), the alignment of
    each document written once, then scored by the corpus' link counts."""
    work = Work(docs.sparkSession, "alignment")
    hashed = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    aligned = work.table("aligned", align(docs.select("doc_id", "text")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", hashed, "links"))
    return with_counts(aligned, link_counts(aligned)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
