"""Packing of token sequences into windows with a bounded number of open windows per partition."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from weblake.llm.tokens import model_path
from weblake.session import Work

#: Ids of documents travel as strings, so that missing and large ones stay what they are.
PIECE = ("doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
         "part long, ids binary")
#: Leftovers of so many partitions are merged by one task.
FAN_IN = 64
WIDTH = 4  # bytes of an id
#: Texts after which a task hands its rows on.
TEXTS = 256


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The ranks are the vocabulary of ``byte_bpe_50k.json`` and give its library's ids, several times as
    fast; the special string inside a text is its own id, as there. No white space or length is special.
    """

    SPECIAL = {"<|endoftext|>": 50256}

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.model = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                       special_tokens=self.SPECIAL)

    def ids(self, text: str) -> bytes:
        return self.model.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


class Packer:
    """Open windows of one partition. Pieces are (doc_id, start, doc_tokens, ids) and may be cut anywhere.

    A piece goes whole into the open window that it leaves least room in. Where it fits in none, a
    window is opened while fewer than ``limit`` are; else the fullest takes the front of the piece,
    is full and emitted, and its place is taken by a window with the rest.
    """

    def __init__(self, size: int, limit: int, first_id: int):
        self.size, self.limit, self.next_id = size, limit, first_id
        self.open: list[list] = []  # [used, pieces]
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple], part: int | None) -> None:
        offset = 0
        for doc, start, total, ids in pieces:
            n = len(ids) // WIDTH
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next_id, offset, part, ids if part is not None else None))
            offset += n
        self.next_id += 1

    def add(self, doc, start: int, total: int, ids: bytes) -> None:
        at, n = 0, len(ids) // WIDTH
        while n - at >= self.size:
            self._emit([(doc, start + at, total, ids[at * WIDTH:(at + self.size) * WIDTH])], None)
            at += self.size
        while at < n:
            rest = n - at
            fitting = [w for w in self.open if self.size - w[0] >= rest]
            if fitting:
                window = max(fitting, key=lambda w: w[0])
            elif len(self.open) < self.limit:
                self.open.append(window := [0, []])
            else:
                window = max(self.open, key=lambda w: w[0])
            take = min(rest, self.size - window[0])
            window[1].append((doc, start + at, total, ids[at * WIDTH:(at + take) * WIDTH]))
            window[0] += take
            at += take
            if window[0] == self.size:
                self._emit(window[1], None)
                self.open = [w for w in self.open if w is not window]

    def leave(self, part: int) -> None:
        """Hand the open windows on, with their ids."""
        for _, pieces in self.open:
            self._emit(pieces, part)
        self.open = []

    def finish(self) -> None:
        """Close the open windows: all their pieces in turn fill windows, and what the last one has is
        cut at powers of two, which need no padding."""
        pieces = [piece for _, window in self.open for piece in window]
        self.open, left = [], sum(len(ids) // WIDTH for *_, ids in pieces)
        room, row = 0, []
        for doc, start, total, ids in pieces:
            at, n = 0, len(ids) // WIDTH
            while at < n:
                if not room:
                    room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
                take = min(room, n - at)
                row.append((doc, start + at, total, ids[at * WIDTH:(at + take) * WIDTH]))
                at, room, left = at + take, room - take, left - take
                if not room:
                    self._emit(row, None)
                    row = []

    def frame(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PIECE.split(", ")]).astype({"part": "Int64"})


def _first_id(round_: int, part: int) -> int:
    return round_ << 58 | part << 32


def pack(docs: DataFrame, size: int = 2048, open_windows: int = 8, end_id: int = 1,
         model: str = "byte_bpe_50k.tiktoken", path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its token ids and ``end_id``; a null text is an empty one. Every partition of ``docs``
    packs its rows as they come, with ``open_windows`` open windows in memory. The windows left open,
    at most that many a partition, are packed again by one task for every :data:`FAN_IN` partitions,
    and so on until one task is left, so no step grows with the table. Repeated rows are packed each by itself; an empty table
    gives no rows.
    """
    work = Work(docs.sparkSession, "packing")
    kind = docs.schema["doc_id"].dataType

    def pack_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        encoder, packer = Encoder(path or model_path(model)), Packer(size, open_windows, _first_id(0, part))
        end = end_id.to_bytes(WIDTH, "little")
        for pdf in batches:
            names, texts = pdf["doc_id"].tolist(), [t or "" for t in pdf["text"]]
            for i in range(0, len(texts), TEXTS):
                for doc, text in zip(names[i:i + TEXTS], texts[i:i + TEXTS]):
                    ids = encoder.ids(text) + end
                    packer.add(doc, 0, len(ids) // WIDTH, ids)
                yield packer.frame()
        packer.leave(part)
        yield packer.frame()

    def merge(round_: int, last: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            packer = group = None
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    if row.group != group:
                        if packer is not None:
                            packer.leave(group)
                            yield packer.frame()
                        group, packer = row.group, Packer(size, open_windows, _first_id(round_, row.group))
                    packer.add(row.doc_id, row.start, row.doc_tokens, row.ids)
                if packer is not None:
                    yield packer.frame()
            if packer is not None:
                packer.finish() if last else packer.leave(group)
                yield packer.frame()
        return run

    rows = work.table("round_0", docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(pack_texts, PIECE))
    done, round_ = [rows.filter("part is null")], 0
    while True:
        left = rows.filter("part is not null")
        most = left.agg(F.max("part")).first()[0]
        if most is None:
            break
        groups = most // FAN_IN + 1
        round_ += 1
        grouped = (left.withColumn("group", F.expr(f"part div {FAN_IN}")).repartition(groups, "group")
                   .sortWithinPartitions("group", "part", "sequence_id", "offset")
                   .select("group", "doc_id", "start", "doc_tokens", "ids"))
        rows = work.table(f"round_{round_}", grouped.mapInPandas(merge(round_, groups == 1), PIECE))
        done.append(rows.filter("part is null"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("doc_id").cast(kind), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
