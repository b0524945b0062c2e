"""Packing: vector bin packing of token pieces by the dot-product heuristic.

Every task packs its own documents, without a shuffle: pieces of a full sequence
leave at once, the rest wait in a pool of bounded size. A pool is packed bin by
bin: of the pieces that still fit under all limits (tokens, segments,
loss-bearing tokens) the one with the largest product of its demand and what the
bin has left, each dimension weighted by what the pool demands of it, goes in.
Afterwards the emptiest bins are cut up to fill the others, and what a task has
left at its end is cut into sequences whose length is a power of two.

Defined results: null and empty texts are a piece with the end id alone; a null
doc_id stays null; repeated rows are packed as often as they occur; other
columns, whatever their names, are not read; an empty table gives an empty
table. Texts of any length are cut.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, col_of, sliced, small_batches
from .tokens import WORD_BPE, shared_encoder, tokenizer_path, with_end


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 128
    loss: int = 2048


class Piece:
    """Ids start to start + len(ids) of a document of `total` ids, of which the last `tail` bear loss."""

    __slots__ = ("doc", "start", "ids", "total", "tail")

    def __init__(self, doc, start, ids, total, tail):
        self.doc, self.start, self.ids, self.total, self.tail = doc, start, ids, total, tail

    @property
    def loss(self) -> int:
        to = self.start + len(self.ids)
        return max(0, to - max(self.start, self.total - self.tail))

    def cut(self, k: int) -> tuple[Piece, Piece]:
        rest = (self.total, self.tail)
        return Piece(self.doc, self.start, self.ids[:k], *rest), Piece(self.doc, self.start + k, self.ids[k:], *rest)

    def most_under(self, gap: int, loss: int) -> int:
        """So many of the first ids fit into a gap with so much loss left."""
        free = max(0, self.total - self.tail - self.start)
        return min(len(self.ids), gap, free + loss)


def dot_product_bins(demand: np.ndarray, caps: np.ndarray) -> list[list[int]]:
    """Bins of item numbers; demand: items by dimensions, none above caps."""
    left = np.arange(len(demand))
    size = demand / caps
    bins = []
    while len(left):
        mine, room, weight = [], caps.astype(float).copy(), size[left].sum(0)
        live = left
        while len(live):
            live = live[(demand[live] <= room).all(1)]
            if not len(live):
                break
            best = int(live[np.argmax(size[live] @ (weight * room / caps))])
            mine.append(best)
            room -= demand[best]
            live = live[live != best]
        bins.append(mine)
        left = left[~np.isin(left, mine)]
    return bins


class Packer:
    def __init__(self, limits: Limits, pool: int = 2048):
        self.lim, self.most, self.pool = limits, pool, []
        self.out: list[tuple] = []

    def _emit(self, pieces: list[Piece]) -> None:
        """The pieces of a sequence, which follow each other, with their place in it."""
        at = 0
        for k, p in enumerate(pieces):
            self.out.append((p.doc, p.start, len(p.ids), p.ids, p.total, k, at, p.loss))
            at += len(p.ids)

    def add(self, doc, ids: np.ndarray, tail: int) -> None:
        rest, lim = Piece(doc, 0, ids, len(ids), tail), self.lim
        while (k := rest.most_under(lim.tokens, lim.loss)) < len(rest.ids) or k == lim.tokens:
            head, rest = rest.cut(k)
            if k == lim.tokens:
                self._emit([head])
            else:  # the loss limit alone cut it
                self.pool.append(head)
            if not len(rest.ids):
                return
        self.pool.append(rest)
        if len(self.pool) >= self.most:
            self.pack(False)

    def pack(self, last: bool) -> None:
        lim, items, self.pool = self.lim, self.pool, []
        if not items:
            return
        demand = np.array([(len(p.ids), 1, p.loss) for p in items], float)
        bins = [[items[i] for i in b] for b in dot_product_bins(demand, np.array([lim.tokens, lim.segments, lim.loss], float))]
        used = lambda b: sum(len(p.ids) for p in b)
        open_ = []
        for b in bins:
            self._emit(b) if used(b) == lim.tokens else open_.append(b)
        queue = deque(sorted(open_, key=used, reverse=True))
        spare: list[Piece] = []  # of the emptiest bin, which is cut up
        rest_bins = []
        while queue:
            b = queue.popleft()
            n, loss = used(b), sum(p.loss for p in b)
            while n < lim.tokens and len(b) < lim.segments and (spare or queue):
                if not spare:
                    spare = queue.pop()
                p = spare.pop()
                k = p.most_under(lim.tokens - n, lim.loss - loss)
                if k <= 0:
                    spare.append(p)
                    break
                head, rest = p.cut(k)
                b.append(head)
                n, loss = n + k, loss + head.loss
                if len(rest.ids):
                    spare.append(rest)
            self._emit(b) if n == lim.tokens else rest_bins.append(b)
        if spare:
            rest_bins.append(spare)
        for b in rest_bins:
            self._finish(b) if last or len(b) >= lim.segments else self.pool.extend(b)

    def _finish(self, pieces: list[Piece]) -> None:
        """One sequence if it is full, else sequences of a power of two."""
        n = sum(len(p.ids) for p in pieces)
        if n == self.lim.tokens:
            return self._emit(pieces)
        todo = pieces[::-1]
        for bit in range(n.bit_length() - 1, -1, -1):
            if n >> bit & 1:
                mine, room = [], 1 << bit
                while room:
                    head, rest = todo.pop().cut(room)
                    mine.append(head)
                    room -= len(head.ids)
                    if len(rest.ids):
                        todo.append(rest)
                self._emit(mine)
        return None


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("place", pa.int64()), ("offset", pa.int64()), ("loss_tokens", pa.int64())])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = WORD_BPE, end_id: int = 1, limits: Limits = Limits(), loss_tail_col: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, loss_tokens.

    loss_tail_col: a column with the number of a document's last ids that bear
    loss (for instruction data the answer); without it all ids bear loss.
    """
    small_batches(docs.sparkSession)
    path = tokenizer_path(tokenizer)
    tail = F.col(loss_tail_col).cast("long") if loss_tail_col else F.lit(None).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), tail.alias("tail"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = shared_encoder(path), Packer(limits)

        def rows_out() -> pa.RecordBatch:
            got, packer.out = packer.out, []
            cols = list(zip(*got)) if got else [[] for _ in _SCHEMA]
            cols[3] = [x.astype("<u4").tobytes() for x in cols[3]]
            return batch_of(_SCHEMA, [list(c) for c in cols])

        for b in sliced(batches, "text"):
            ids, offs = with_end(*enc.encode(col_of(b, "text")), end_id)
            for doc, t, lo, hi in zip(col_of(b, "doc_id").to_pylist(), col_of(b, "tail").to_pylist(), offs[:-1], offs[1:]):
                packer.add(doc, ids[lo:hi].copy(), int(hi - lo) if t is None else max(0, min(t, int(hi - lo))))
            if packer.out:
                yield rows_out()
        packer.pack(True)
        if packer.out:
            yield rows_out()

    pieces = rows.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, place long, offset long, loss_tokens long")
    # A sequence has the number of its first piece; Spark numbers rows by partition and place, and no two partitions share numbers.
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id() - F.col("place")).select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "loss_tokens")
