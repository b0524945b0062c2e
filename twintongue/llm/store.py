"""Token ids in a content-addressed store.

A rolling hash over the last SPAN ids cuts each document's ids into chunks of
about MEAN ids (at most MOST), so that equal passages give equal chunks wherever
they stand. A chunk is named by the SHA-256 of its bytes (a width byte, 2 or 4,
and little-endian ids of that width) and is stored once, by the first document in
ascending order that has it. The store is two Parquet tables in the shared folder:

- packs: a row for each document in ascending doc_id: pack (the file it is in),
  place, ids of the documents before it in the pack, its recipe (names and lengths
  of its chunks), which of them it holds itself, their bytes, and its leaf hash; and
  a row for each pack (kind 1): documents, ids and the root of the Merkle tree over
  its leaves;
- manifest: a row for each pack in order, with the ids of all packs before it and
  its root, and one with the root of the Merkle tree over these.

A pack holds about PACK_BYTES of compressed ids.

Only names travel to find out which chunks are double; the ids themselves are
dealt out once, by ranges of doc_id. Reading checks the manifest against its root
first, then every chunk against its name, every document against its leaf and every
pack of the manifest against its root, and raises if one is wrong or missing; documents with all chunks in place are read without a shuffle, and the
chunks that others hold are fetched by name.

Defined results: null and empty texts have the end id alone; a null doc_id comes
first; repeated ids are in order of their content, repeated rows share all chunks;
other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, col_of, kept, shared_dir, sliced, small_batches
from .tokens import WORD_BPE, shared_encoder, tokenizer_path, with_end

SPAN, MEAN, MOST = 16, 512, 4096
NAME = 32
PACK_BYTES = 64 << 20


def cuts(flat: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where chunks end in flat, the ends of documents included."""
    ends = offs[1:]
    h = flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    power, step = 0xD6E8FEB86659FD93, 1
    while step < SPAN and len(h) > step:
        h = h[:-step] * np.uint64(power) + h[step:]
        power, step = power * power & (1 << 64) - 1, step * 2
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)
    at = np.flatnonzero(h % np.uint64(MEAN) == 0) + SPAN  # the chunk ends after these ids
    doc = np.searchsorted(ends, at, "left")
    at = at[(doc < len(ends)) & (at - SPAN >= offs[np.minimum(doc, len(ends) - 1)])] if len(flat) >= SPAN else at[:0]
    every = np.unique(np.concatenate([at, ends]))
    begin = np.concatenate([[0], every[:-1]])
    long = np.flatnonzero(every - begin > MOST)
    more = [np.arange(begin[i] + MOST, every[i], MOST) for i in long]
    return np.unique(np.concatenate([every, *more])) if more else every


def pack_ids(ids: np.ndarray) -> bytes:
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\x04" + ids.astype("<u4").tobytes()


def unpack_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype("<u4")


def leaf(doc_id, names: bytes) -> bytes:
    return hashlib.sha256(b"leaf" + str(doc_id).encode() + b":" + names).digest()


class Merkle:
    """The root of leaves that come one after the other; holds one node of each height."""

    def __init__(self):
        self.nodes: list[bytes | None] = []

    def add(self, x: bytes) -> None:
        for k, left in enumerate(self.nodes):
            if left is None:
                self.nodes[k] = x
                return
            x, self.nodes[k] = hashlib.sha256(b"node" + left + x).digest(), None
        self.nodes.append(x)

    def root(self) -> bytes:
        x = b""
        for left in self.nodes:
            if left is not None:
                x = hashlib.sha256(b"node" + left + x).digest() if x else left
        return x


_CODED = pa.schema([("doc_id", pa.int64()), ("_doc", pa.binary()), ("_tag", pa.int32()), ("names", pa.binary()), ("lens", pa.binary()), ("data", pa.binary())])
_CODED_DDL = "doc_id long, _doc binary, _tag int, names binary, lens binary, data binary"


def _encoded(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int) -> DataFrame:
    """Of each document its chunks' names, lengths (bytes, 32 bits each) and, compressed, their bytes."""
    path = tokenizer_path(tokenizer)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc, press = shared_encoder(path), zstandard.ZstdCompressor(1).compress
        for b in sliced(batches, "text", 6 << 20):
            flat, offs = with_end(*enc.encode(col_of(b, "text")), end_id)
            ends = cuts(flat, offs)
            chunks = [pack_ids(flat[i:j]) for i, j in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist())]
            names = [hashlib.sha256(c).digest() for c in chunks]
            lens = np.fromiter(map(len, chunks), "<u4", len(chunks))
            upto = np.searchsorted(ends, offs, "right")
            upto[0] = 0
            cols: list[list] = [[] for _ in range(4)]
            for i, j in zip(upto[:-1].tolist(), upto[1:].tolist()):
                mine = b"".join(names[i:j])
                for c, x in zip(cols, (hashlib.sha256(mine).digest()[:16], mine, lens[i:j].tobytes(), press(b"".join(chunks[i:j])))):
                    c.append(x)
            yield batch_of(_CODED, [col_of(b, "doc_id"), cols[0], np.zeros(b.num_rows, np.int32), *cols[1:]])

    return rows.mapInArrow(run, _CODED_DDL)


_OCC = pa.schema([("name", pa.binary()), ("doc_id", pa.int64()), ("_doc", pa.binary()), ("at", pa.int32())])


def _occurrences(coded: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = col_of(b, "names").to_pylist()
            count = np.array([len(x) // NAME for x in names], np.int64)
            each = pa.array(np.repeat(np.arange(b.num_rows), count))
            at = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            flat = [x[i : i + NAME] for x in names for i in range(0, len(x), NAME)]
            yield batch_of(_OCC, [flat, col_of(b, "doc_id").take(each), col_of(b, "_doc").take(each), at.astype(np.int32)])

    return coded.select("doc_id", "_doc", "names").mapInArrow(run, "name binary, doc_id long, _doc binary, at int")


_STORE = pa.schema(
    [("kind", pa.int32()), ("pack", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n_ids", pa.int64()), ("before", pa.int64()), ("names", pa.binary()), ("lens", pa.binary()), ("held", pa.binary()), ("wanted", pa.binary()), ("data", pa.binary()), ("hash", pa.binary())]
)
_STORE_DDL = "kind int, pack int, place long, doc_id long, n_ids long, before long, names binary, lens binary, held binary, wanted binary, data binary, hash binary"


def write(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = WORD_BPE, end_id: int = 2) -> str:
    """Writes the store and returns its path."""
    spark = docs.sparkSession
    small_batches(spark)
    path = path or f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    coded = kept(_encoded(docs, id_col, text_col, tokenizer, end_id))
    found = kept(_occurrences(coded))
    owners = found.groupBy("name").agg(F.min(F.struct("doc_id", "_doc", "at")).alias("_own"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    double = found.join(owners, "name").withColumn("_mine", F.struct("doc_id", "_doc", "at") == F.col("_own"))
    # Of each document: the places of chunks that another place holds (as one less than the negative), and of those that others want.
    notes = double.groupBy("doc_id", "_doc").agg(F.to_json(F.collect_set(F.when(F.col("_mine"), F.col("at")).otherwise(-1 - F.col("at")))).cast("binary").alias("names"))
    notes = notes.select("doc_id", "_doc", F.lit(-1).alias("_tag"), "names", F.lit(b"").alias("lens"), F.lit(b"").alias("data"))
    rows = coded.unionByName(notes)
    size = coded.agg(F.sum(F.length("data"))).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, -(-size // PACK_BYTES))  # a pack each; they are numbered by their tasks, which must not be joined
    rows = rows.repartitionByRange(n, "doc_id", "_doc").sortWithinPartitions("doc_id", "_doc", "_tag")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        import zstandard
        from pyspark import TaskContext

        pack, unpress = TaskContext.get().partitionId(), zstandard.ZstdDecompressor().decompress
        tree, place, before, last, notes = Merkle(), 0, 0, None, ()
        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return batch_of(_STORE, [list(c) for c in zip(*out)])

        for b in batches:
            for doc, key, tag, names, lens, data in zip(*(c.to_pylist() for c in b.columns)):
                if tag < 0:
                    notes = (doc, key, json.loads(names))
                    continue
                n, data = np.frombuffer(lens, "<u4").astype(np.int64), unpress(data)
                held, wanted = np.ones(len(n), np.uint8), np.zeros(len(n), np.uint8)
                if notes and notes[:2] == (doc, key):
                    marks = np.array(notes[2])
                    wanted[marks[marks >= 0]] = 1
                    held[-1 - marks[marks < 0]] = 0
                if last == (doc, key):  # the same again: the row before has all of it
                    held[:] = 0
                    wanted[:] = 0
                last = (doc, key)
                ends = np.cumsum(n)
                width = np.frombuffer(data, np.uint8)[ends - n]
                ids = int(((n - 1) // width).sum())
                mine = data if held.all() else b"".join(data[e - k : e] for e, k, h in zip(ends.tolist(), n.tolist(), held) if h)
                hashed = leaf(doc, names)
                tree.add(hashed)
                out.append((0, pack, place, doc, ids, before, names, lens, held.tobytes(), wanted.tobytes(), mine, hashed))
                place, before, size = place + 1, before + ids, size + len(mine)
                if size > 4 << 20 or len(out) >= 2000:
                    yield batch()
                    out.clear()
                    size = 0
        if place:
            out.append((1, pack, place, None, before, 0, b"", b"", b"", b"", b"", tree.root()))
            yield batch()

    rows.mapInArrow(run, _STORE_DDL).write.option("compression", "zstd").parquet(f"{path}/packs")
    coded.unpersist()
    found.unpersist()
    spark._jvm.System.gc()
    packs = spark.read.parquet(f"{path}/packs").where("kind = 1").select("pack", F.col("place").alias("n_docs"), "n_ids", F.lit(0).cast("long").alias("start"), F.col("hash").alias("root"))
    packs.repartition(1).sortWithinPartitions("pack").mapInArrow(_listed, _MANIFEST_DDL).write.option("compression", "zstd").parquet(f"{path}/manifest")
    return path


_MANIFEST = pa.schema([("pack", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("start", pa.int64()), ("root", pa.binary())])
_MANIFEST_DDL = "pack int, n_docs long, n_ids long, start long, root binary"


def _pack_leaf(pack: int, docs: int, ids: int, root: bytes) -> bytes:
    return hashlib.sha256(b"pack" + f"{pack}:{docs}:{ids}:".encode() + root).digest()


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs in order with the ids before each, and after them the root over all."""
    tree, all_docs, start = Merkle(), 0, 0
    for b in batches:
        out = []
        for pack, docs, ids, _, root in zip(*(c.to_pylist() for c in b.columns)):
            out.append((pack, docs, ids, start, root))
            tree.add(_pack_leaf(pack, docs, ids, root))
            all_docs, start = all_docs + docs, start + ids
        if out:
            yield batch_of(_MANIFEST, [list(c) for c in zip(*out)])
    yield batch_of(_MANIFEST, [[None], [all_docs], [start], [0], [tree.root()]])


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """The packs of the manifest; raises unless they give its root."""
    table = spark.read.parquet(f"{path}/manifest")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, all_docs, at, end = Merkle(), 0, 0, None
        for b in batches:
            for pack, docs, ids, start, root in zip(*(c.to_pylist() for c in b.columns)):
                if pack is None:
                    end = (docs, ids, root)
                    continue
                if start != at:
                    raise ValueError(f"pack {pack} does not follow the packs before it")
                tree.add(_pack_leaf(pack, docs, ids, root))
                all_docs, at = all_docs + docs, at + ids
        if end != (all_docs, at, tree.root()):
            raise ValueError("the manifest does not give its root")
        yield batch_of(_MANIFEST, [[None], [all_docs], [at], [0], [tree.root()]])

    table.repartition(1).sortWithinPartitions(F.col("pack").asc_nulls_last()).mapInArrow(check, _MANIFEST_DDL).collect()
    return table.where("pack IS NOT NULL").select("pack", "n_docs", F.col("n_ids").alias("pack_ids"), "root", F.col("start").alias("pack_start"))


_CHUNK = pa.schema([("name", pa.binary()), ("chunk", pa.binary())])
_READ = pa.schema([("pack", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_ids", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary()), ("leaf", pa.binary())])


def _split(data: bytes, lens: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lens)
    return [data[e - n : e] for e, n in zip(ends.tolist(), lens.tolist())]


def _assembled(rows: DataFrame, with_ids: bool) -> DataFrame:
    """Documents put together and checked; rows have `fetched`, a list of (place in the recipe, chunk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "data"):
            out = []
            columns = ("pack", "place", "doc_id", "n_ids", "before", "names", "lens", "held", "data", "hash", "fetched")
            for pack, place, doc, n_ids, before, names, lens, held, data, hashed, fetched in zip(*(col_of(b, c).to_pylist() for c in columns)):
                n, mine = np.frombuffer(lens, "<u4"), np.frombuffer(held, np.uint8) > 0
                got = dict(zip(np.flatnonzero(mine).tolist(), _split(data, n[mine])))
                got |= {x["at"]: x["chunk"] for x in fetched or ()}
                chunks = [got[i] for i in range(len(n))]
                if any(hashlib.sha256(c).digest() != names[NAME * i : NAME * i + NAME] for i, c in enumerate(chunks)) or leaf(doc, names) != hashed:
                    raise ValueError(f"document {doc}: a chunk or its recipe was changed")
                ids = b"".join(unpack_ids(c).tobytes() for c in chunks)
                if len(ids) != 4 * n_ids:
                    raise ValueError(f"document {doc}: {len(ids) // 4} ids, not {n_ids}")
                out.append((pack, place, doc, before, n_ids, zlib.crc32(ids), ids if with_ids else None, hashed))
            yield batch_of(_READ, [list(c) for c in zip(*out)])

    return rows.mapInArrow(run, "pack int, place long, doc_id long, before long, n_ids long, crc long, ids binary, leaf binary")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (little-endian unsigned 32-bit; null unless with_ids)."""
    small_batches(spark)
    packs = _manifest(spark, path)
    docs = spark.read.parquet(f"{path}/packs").where("kind = 0")
    whole = docs.where(~_misses())
    parted = docs.where(_misses())

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for names, lens, held, want, data in zip(*(c.to_pylist() for c in b.columns)):
                own, n = np.frombuffer(held, np.uint8) > 0, np.frombuffer(lens, "<u4")
                chunks = dict(zip(np.flatnonzero(own).tolist(), _split(data, n[own])))
                got += [(names[NAME * i : NAME * i + NAME], chunks[i]) for i in np.flatnonzero(np.frombuffer(want, np.uint8)).tolist()]
            if got:
                yield batch_of(_CHUNK, [list(c) for c in zip(*got)])

    shared = docs.where(F.instr(F.hex("wanted"), "01") > 0).select("names", "lens", "held", "wanted", "data").mapInArrow(wanted, "name binary, chunk binary")
    at = F.explode(F.sequence(F.lit(0), F.length("held") - 1))
    need = parted.select("pack", "place", "names", "held", at.alias("at")).where(F.substring(F.hex("held"), F.col("at") * 2 + 1, F.lit(2)) == "00")
    need = need.select("pack", "place", "at", F.substring("names", F.col("at") * NAME + 1, F.lit(NAME)).alias("name"))
    fetched = need.join(shared, "name").groupBy("pack", "place").agg(F.collect_list(F.struct("at", "chunk")).alias("fetched"))
    columns = ["pack", "place", "doc_id", "n_ids", "before", "names", "lens", "held", "data", "hash", "fetched"]
    none = F.lit(None).cast("array<struct<at:int,chunk:binary>>").alias("fetched")
    got = _assembled(whole.select(*columns[:-1], none), with_ids).unionByName(_assembled(parted.join(fetched, ["pack", "place"], "left").select(*columns), with_ids))
    rows = packs.join(got, "pack", "left").repartition("pack").sortWithinPartitions("pack", "place")
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Passes the rows on; raises if a pack's documents don't give its root."""
        tree, now, expected, count = Merkle(), None, None, 0

        def close() -> None:
            if now is not None and (tree.root(), count) != expected:
                raise ValueError(f"pack {now} is not what its manifest says")

        for b in batches:
            for pack, root, n, x in zip(*(col_of(b, c).to_pylist() for c in ("pack", "root", "n_docs", "leaf"))):
                if pack != now:
                    close()
                    tree, now, expected, count = Merkle(), pack, (root, n), 0
                if x is not None:
                    tree.add(x)
                    count += 1
            start = pc.add(col_of(b, "before"), col_of(b, "pack_start")) if b.num_rows else col_of(b, "before")
            yield batch_of(out, [col_of(b, "doc_id"), start, col_of(b, "n_ids"), col_of(b, "crc"), col_of(b, "ids")])
        close()

    return rows.mapInArrow(checked, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _misses():
    """The document does not hold all of its chunks."""
    return F.regexp_like(F.hex("held"), F.lit("^(01)*00"))
