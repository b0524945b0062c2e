"""Exact removal of repeated strings with a distributed suffix array.

A byte goes if a string of `length` bytes that covers it starts anywhere else.

1. Anchors. Of the GRAM-byte strings inside a window of `length` bytes, the one
   with the smallest hash (the first of equals) is the window's anchor, so equal
   windows have equal anchors at equal places. Neighbouring windows with one
   anchor form a piece. Pieces whose anchor's hash occurs once in all documents
   cannot match and are dropped; equal pieces are counted and sent once.
2. Suffix array. Pieces with one anchor hash meet in one task and are sorted
   there, by whole groups, in two stages: only suffixes that are smaller than
   their successors are sorted directly; the others follow from one scan over the
   buckets of first bytes, each suffix placing its predecessor. Adjacent common
   prefixes of `length` bytes or more, or a piece that was counted twice, mark
   repeated windows.
3. Marked windows return to all places of their piece, and texts are cut.

An anchor hash with more than `hot` different pieces is not brought into one task:
its windows become pieces of their own, dealt out by their content and counted
before the sort, which is as exact.

Defined results: a null text is empty; texts shorter than `length` are kept; rows
with equal doc_id and text are documents of their own, which repeat each other;
other columns are kept, whatever their names (where one is called as a column that
dedup adds, that has underscores behind its name); an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import SLICE_BYTES, apart, batch_of, col_of, fresh, kept, sliced, small_batches, string_buffers, together, written

LENGTH, GRAM = 200, 32
#: So many positions are hashed at once.
BLOCK = 1 << 18
HOT = 40_000
_PLACE = np.uint64((1 << 20) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each GRAM bytes, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    power, step = 0xD6E8FEB86659FD93, 1
    while step < GRAM:
        h = h[:-step] * np.uint64(power) + h[step:]
        power, step = power * power & (1 << 64) - 1, step * 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def pieces(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Text number, first window and number of windows (in data) and anchor hash of each piece."""
    out = []
    starts, ends = offs[:-1], offs[1:]
    for at in range(0, max(0, len(data) - length + 1), BLOCK):
        part = data[at : at + BLOCK + length - 1]
        h = gram_hashes(part)
        low = h & ~_PLACE | np.arange(len(h), dtype=np.uint64)
        width, have = length - GRAM + 1, 1
        while have * 2 <= width:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if width > have:
            low = np.minimum(low[: -(width - have)], low[width - have :])
        anchor = (low & _PLACE).astype(np.int64)
        first = np.arange(at, at + len(anchor))
        text = np.searchsorted(ends, first, "right")
        inside = first + length <= ends[np.minimum(text, len(ends) - 1)]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
        begin = np.flatnonzero(new & inside)
        if not len(begin):
            continue
        stop = np.append(np.flatnonzero(new | ~inside), len(anchor))
        count = stop[np.searchsorted(stop, begin, "right")] - begin
        out.append((text[begin], begin + at, count, h[anchor[begin]].view(np.int64)))
    if not out:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*out))


def _types(t: np.ndarray, depth: int) -> np.ndarray:
    """True where the suffix is smaller than its successor; equal bytes over `depth` count as smaller."""
    change = np.flatnonzero(t[1:] != t[:-1])
    first = np.concatenate([[0], change + 1])
    lens = np.diff(np.append(first, len(t)))
    char = t[first]
    smaller = np.append(char[:-1] < char[1:], True)
    left = np.repeat(first + lens, lens) - np.arange(len(t))
    return np.repeat(smaller, lens) | (left >= depth)


def _words(t: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as a number of the same order."""
    w = np.ndarray((len(t) - 7,), ">u8", t, strides=(1,))
    return w


def _direct_sort(t: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """at, in the order of the first `depth` bytes from there."""
    words = _words(t)
    key = words[at].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    new = np.ones(len(at), bool)
    new[1:] = key[1:] != key[:-1]
    for d in range(8, depth, 8):
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        key = words[at[tied] + d].astype(np.uint64)
        g = group[tied]
        order = np.lexsort((key, g))
        at[tied] = at[tied][order]
        key, g = key[order], g[order]
        new[tied] = np.concatenate([[True], (key[1:] != key[:-1]) | (g[1:] != g[:-1])])
    return at


def suffix_order(t: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted positions of t (a mask; t ends in `depth` + 8 zeros that are not wanted) by their first `depth` bytes."""
    n = len(t)
    smaller = _types(t, depth)
    smaller[-1] = True
    # What is induced needs its successor: after the last wanted position, up to one that is sorted directly.
    following = np.where(smaller, np.arange(n), n - 1)
    following = np.minimum.accumulate(following[::-1])[::-1]
    last = np.flatnonzero(wanted[:-1] & ~wanted[1:]) + 1
    member = np.zeros(n + 1, np.int32)
    np.add.at(member, last, 1)
    np.add.at(member, following[last] + 1, -1)
    member = (np.cumsum(member[:-1]) > 0) | wanted
    # The zeros at the end are smaller, the first of them ends any such chain, and all words can be read.
    direct = np.flatnonzero(member & smaller)
    direct = _direct_sort(t, direct, depth)
    bounds = np.searchsorted(t[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    can = member & ~smaller
    out = []
    for c in range(256):
        wave = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        done = []
        while len(wave):
            done.append(wave)
            before = wave[wave > 0] - 1
            wave = before[can[before] & (t[before] == c)]
        done.append(direct[bounds[c] : bounds[c + 1]])
        bucket = np.concatenate(done)
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[can[before] & (t[before] > c)]
        if len(before):
            char = t[before]
            order = np.argsort(char, kind="stable")
            before, char = before[order], char[order]
            cuts = np.flatnonzero(char[1:] != char[:-1]) + 1
            for part in np.split(before, cuts):
                induced[t[part[0]]].append(part)
    every = np.concatenate(out) if out else np.zeros(0, np.int64)
    return every[wanted[every]]


def common_prefixes(t: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Of each position in order and the next, how many bytes agree, at most depth."""
    a, b = order[:-1], order[1:]
    words = _words(t)
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for d in range(0, depth, 8):
        differ = words[a[live] + d] ^ words[b[live] + d]
        ended = np.flatnonzero(differ)
        if len(ended):
            x = differ[ended].astype(np.uint64)
            zeros = np.zeros(len(x), np.int64)
            for k in range(1, 8):
                zeros += x >> np.uint64(64 - 8 * k) == 0
            out[live[ended]] = d + zeros
        live = live[differ == 0]
        if not len(live):
            break
    out[live] = depth
    return np.minimum(out, depth)


def repeated_windows(contents: list[bytes], counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of repeated windows: piece number, first window, one after the last; counts: how often each piece occurs."""
    lens = np.array([len(c) for c in contents], np.int64)
    base = np.cumsum(lens) - lens
    t = np.frombuffer(b"".join(contents) + bytes(length + 8), np.uint8)
    windows = lens - length + 1
    delta = np.zeros(len(t) + 1, np.int32)
    np.add.at(delta, base, 1)
    np.add.at(delta, base + windows, -1)
    wanted = np.cumsum(delta[:-1]) > 0
    order = suffix_order(t, wanted, length)
    same = common_prefixes(t, order, length) >= length
    hit = np.zeros(len(t), bool)
    hit[order[:-1][same]] = True
    hit[order[1:][same]] = True
    twice = counts >= 2
    more = np.zeros(len(t) + 1, np.int32)
    np.add.at(more, base[twice], 1)
    np.add.at(more, (base + windows)[twice], -1)
    hit |= np.cumsum(more[:-1]) > 0
    edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.searchsorted(base, begin, "right") - 1
    # Pieces longer than their windows always have length - 1 unwanted positions between them, so that runs end with them.
    return piece, begin - base[piece], stop - base[piece]


_A = pa.schema([("_key", pa.int64()), ("_h", pa.int64()), ("_g", pa.int64()), ("_at", pa.int64())])
_P = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("g", pa.int64()), ("off", pa.int32()), ("n", pa.int64()), ("content", pa.binary())])
_R = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("g", pa.int64()), ("from_", pa.int32()), ("to_", pa.int32())])
_PIECES, _RUNS = "k long, h long, g long, off int, n long, content binary", "k long, h long, g long, from_ int, to_ int"


def _compressed(rows: DataFrame, text_col: str) -> DataFrame:
    """rows with the column _z, the compressed text (null stays null), instead of the text: two thirds of what a shuffle of texts writes."""
    names = [c for c in rows.columns if c != text_col]
    fields = {f.name: f for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(1).compress
        for b in sliced(batches, text_col):
            z = [None if t is None else pack(t.encode()) for t in col_of(b, text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(col_of(b, c) for c in names), pa.array(z, pa.binary())], [*names, "_z"])

    return rows.select(*names, text_col).mapInArrow(run, StructType([*(fields[c] for c in names), StructField("_z", BinaryType())]))


def _unpacked(z: pa.Array) -> tuple[bytes, np.ndarray]:
    """All texts one after the other, and where each begins and ends."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    texts = [b"" if x is None else unpack(x) for x in z.to_pylist()]
    return b"".join(texts), np.cumsum([0, *map(len, texts)])


def _anchored(texts: DataFrame, length: int) -> DataFrame:
    """A row for each piece: its document's key, anchor hash, content hash, and place << 20 | number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in sliced(batches, "_text", 1 << 20):
            data, offs = string_buffers(col_of(b, "_text"))
            text, first, count, h = pieces(data, offs, length)
            if not len(text):
                continue
            raw = memoryview(np.ascontiguousarray(data))
            digest = xxhash.xxh3_64_intdigest
            g = np.fromiter((digest(raw[p : p + n]) for p, n in zip(first.tolist(), (count + length - 1).tolist())), np.uint64, len(text)).view(np.int64)
            keys = col_of(b, "_key").to_numpy(zero_copy_only=False)
            yield batch_of(_A, [keys[text], h, g, first - offs[text] << 20 | count])

    return texts.mapInArrow(run, "_key long, _h long, _g long, _at long")


def _sorted_runs(rows: DataFrame, length: int) -> DataFrame:
    """Repeated runs of windows of the pieces, those with one k together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            k, h, g, off, n, content = zip(*held)
            piece, lo, hi = repeated_windows(list(content), np.array(n), length)
            off = np.array(off)
            return batch_of(_R, [np.array(k)[piece], np.array(h)[piece], np.array(g)[piece], (lo + off[piece]).astype(np.int32), (hi + off[piece]).astype(np.int32)])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if size > SLICE_BYTES and row[0] != last:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[5]), row[0]
        if held:
            yield flush()

    return rows.repartition("k").sortWithinPartitions("k").mapInArrow(run, _RUNS)


def _fetch(texts: DataFrame, reps: DataFrame, length: int) -> DataFrame:
    """The contents of the pieces in reps (_key, _h, _g, _at, _n)."""
    by_doc = reps.groupBy("_key").agg(F.collect_list(F.struct("_h", "_g", "_at", "_n")).alias("_want"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "_z", 1 << 20):
            raw, offs = _unpacked(col_of(b, "_z"))
            want = col_of(b, "_want")
            flat = want.flatten()
            each = np.repeat(np.arange(len(want)), np.diff(want.offsets.to_numpy()))
            h, g, at, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            begin = offs[each] + (at >> 20)
            content = [raw[p : p + c] for p, c in zip(begin.tolist(), ((at & int(_PLACE)) + length - 1).tolist())]
            yield batch_of(_P, [h, h, g, np.zeros(len(h), np.int32), n, content])

    return _compressed(texts, "_text").join(by_doc.hint("shuffle_hash"), "_key").select("_z", "_want").mapInArrow(run, _PIECES)


def _windows(rows: DataFrame, length: int) -> DataFrame:
    """Each window of the pieces as a piece of its own, under a hash of its content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for h, g, n, content in zip(*(col_of(b, c).to_pylist() for c in ("h", "g", "n", "content"))):
                got = [content[i : i + length] for i in range(len(content) - length + 1)]
                m = len(got)
                k = np.fromiter(map(xxhash.xxh3_64_intdigest, got), np.uint64, m).view(np.int64)
                yield batch_of(_P, [k, np.full(m, h), np.full(m, g), np.arange(m, dtype=np.int32), np.full(m, n), got])

    return rows.mapInArrow(run, _PIECES)


def repeated_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """_key (see with_key), _from, _to: byte spans covered by repeated windows; they overlap."""
    small_batches(docs.sparkSession)
    texts = with_key(docs.select(id_col, text_col), text_col, id_col).select("_key", "_text")
    found = _anchored(texts, length)
    # Written, so that the join deals out both sides anew and can split what a common string makes of one hash.
    often = written(found.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h"), "suffix-hashes")
    found = kept(found.join(often, "_h", "left_semi"))
    reps = found.groupBy("_h", "_g").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_key", "_at")).alias("_rep"))
    reps = reps.select("_h", "_g", "_n", "_rep._key", "_rep._at")
    contents = _fetch(texts, reps, length)
    crowded = found.groupBy("_h", "_g").count().groupBy("_h").count().where(F.col("count") > hot).select(F.col("_h").alias("h"))
    if crowded.isEmpty():
        runs = _sorted_runs(contents, length)
    else:
        contents = written(contents, "suffix-contents")
        single = written(_windows(contents.join(crowded, "h", "left_semi"), length), "suffix-windows")
        once = single.groupBy("k").agg(F.sum("n").alias("n"), F.first("content").alias("content"))
        once = once.select("k", F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("g"), F.lit(0).alias("off"), "n", "content")
        marked = _sorted_runs(once, length).select("k").distinct()
        own = single.join(marked, "k", "left_semi").select("k", "h", "g", F.col("off").alias("from_"), (F.col("off") + 1).alias("to_"))
        runs = _sorted_runs(contents.join(crowded, "h", "left_anti").select(*[f.name for f in _P]), length).unionByName(own)
    runs = runs.select(F.col("h").alias("_h"), F.col("g").alias("_g"), "from_", "to_")
    place = F.shiftright("_at", 20)
    return found.join(runs, ["_h", "_g"]).select("_key", (place + F.col("from_")).alias("_from"), (place + F.col("to_") + (length - 1)).alias("_to"))


def with_key(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"_key": F.xxhash64(F.col(id_col), text), "_text": text})


def dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH, hot: int = HOT, as_text: bool = False) -> DataFrame:
    """docs with _kept (the bytes that stay; as_text: as a string, without characters that lost a byte), _n_bytes, _n_removed and _n_spans (maximal removed runs)."""
    spans = repeated_spans(docs, text_col, id_col, length, hot)
    spans = spans.groupBy("_key").agg(F.collect_set(F.struct("_from", "_to")).alias("_spans"))
    bare = docs.select(apart(docs, text_col), F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    keyed = _compressed(with_key(bare, "text", "_id").select("_doc", "_key", "text"), "text")
    rows = keyed.join(spans.hint("shuffle_hash"), "_key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "_z", 2 << 20):
            z = col_of(b, "_z")
            raw, offs = _unpacked(z)
            data = np.frombuffer(raw, np.uint8)
            kept, removed, runs = [], [], []
            for i, spans in enumerate(col_of(b, "_spans").to_pylist()):
                mine = data[offs[i] : offs[i + 1]]
                if not spans:
                    kept.append(mine.tobytes())
                    removed.append(0)
                    runs.append(0)
                    continue
                cover = np.zeros(len(mine) + 1, np.int32)
                np.add.at(cover, [s["_from"] for s in spans], 1)
                np.add.at(cover, [s["_to"] for s in spans], -1)
                gone = np.cumsum(cover[:-1]) > 0
                kept.append(mine[~gone].tobytes())
                removed.append(int(gone.sum()))
                runs.append(int(gone[:1].sum() + np.count_nonzero(gone[1:] & ~gone[:-1])))
            stays = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            texts = pa.array([None if null else raw[i:j].decode() for null, i, j in zip(z.is_null().to_pylist(), offs[:-1].tolist(), offs[1:].tolist())], pa.string())
            yield pa.RecordBatch.from_arrays([col_of(b, "_doc"), texts, stays, pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], [f.name for f in out])

    more = ("_kept", "_n_bytes", "_n_removed", "_n_spans")
    out = StructType([rows.schema["_doc"], StructField("text", StringType()), StructField(more[0], StringType() if as_text else BinaryType()), *(StructField(c, LongType()) for c in more[1:])])
    return rows.select("_doc", "_z", "_spans").mapInArrow(run, out).select(*together(docs, text_col, F.col("text")), *[F.col(c).alias(fresh(c, docs.columns)) for c in more])
