"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its words (A-Z lowered) and an end. A word that training texts have more
than once has a code: six bits say how often it is seen (in half octaves, which the
words above one in OFTEN have for themselves, the end, or "another word"), the rest
which word of these it is.
Four predictors say what the next bit of a code will be: the bits before it; these
with the word before; with the last two very common words before; and with the two
words before. Each predictor is the pair of counts, of both bits, that its hashed
context has in the training texts. A mixer adds the predictors' log-odds with
weights. Gates (for how many words the two words before have told the next one, how
often they were seen, and the place in the code) choose the set of weights, which
are trained online. An adaptive table refines the mixed probability by what really
came, and the mean of both is used. Another word is, after its six bits, spelled in
bytes and a space, with predictors after one to four bytes and all bytes before,
mixed and refined in the same way; these learn from each different word once. Bits
add up to total bits per text. An event of a training text is left out of the counts
that predict it, so a training text is scored by what the other texts, and the rest
of it, say, like a text that is held out.

What grows with the corpus is never in one place. Texts are cut into blocks that
number their different words. Words go to tasks by their hash, which count them and
answer each block with counts, codes and spelling prices. The pairs (two words
before, code) go to tasks by the hash of the two words before, which count exactly
and answer each block with how often the two words were seen and how often the next
word's first bits followed them; hashes are as long as the number of tokens asks
for. If both words before are above one in COMMON, the third predictor has the same
context, so such pairs, which could be many in one task, are not sent. Counts of the
other predictors have at most OFTEN or COMMON squared contexts and few bits each,
whatever the corpus; they and the spelling counts are tables of a fixed size (3
bytes a slot, 55 MB in all), which are broadcast.

Defined results: null and empty texts are an end alone; a null doc_id stays null
and counts as training text; repeated rows are texts of their own; other columns
are not read; an empty table gives an empty table, and without training texts
every bit costs one bit. Memory of a task grows with its longest text.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, col_of, dealt, give_back, kept, ragged, sliced, small_batches, string_buffers

#: Texts of about so many bytes make a block.
BLOCK_BYTES = 8 << 20
END = "\n"
#: A word is often seen with a share of one in OFTEN, and common with one in COMMON.
OFTEN, COMMON = 4096, 256
#: Bits of a code: the class, and which word of the class at most.
CLASS, INDEX = 6, 44
OTHER, LISTED, ENDING = 0, 62, 63
#: Bits of slot numbers, and to which bit of a code they count: no context, the word before, the last two common words.
DENSE_BITS, DENSE_DEPTH = (20, 22, 22), (CLASS + 14, CLASS + 6, CLASS + 4)
#: Bits of slot numbers of the spelling tables: after one to four bytes, and all bytes before.
SPELL_BITS = (16, 20, 21, 21, 22)
SEGMENT = 1 << 16
#: The gates of both mixers, and steps of the refining tables.
GATES, SPELL_GATES, BUCKETS = 40, 12, 24
#: About so many words, and pairs of a context and a code, are one task's at once.
WORDS_AT_ONCE, PAIRS_AT_ONCE = 400_000, 2_000_000
#: A task that counts into a table works on so many bytes of text at least.
COUNTED_BYTES = 256 << 20
#: Bits of spelling, and tokens, that are mixed at once.
PART, TOKENS = 1 << 16, 1 << 12
#: A log-odds of one in a table.
UNIT = 2000
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, each by its bytes' places, as high bytes are alike."""
    import zstandard

    return zstandard.ZstdCompressor(3).compress(b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() for a in map(np.ascontiguousarray, arrays)))


def _unpack(data: bytes, *kinds: tuple[type, int | None]) -> list[np.ndarray]:
    """kinds: type and length of each array; the last may be as long as the rest."""
    import zstandard

    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), 0, []
    for kind, n in kinds:
        size = np.dtype(kind).itemsize
        n = (len(raw) - at) // size if n is None else n
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows that follow each other and have the same key."""
    now, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if rows and r[key] != now:
                yield now, rows
                rows = []
            now = r[key]
            rows.append(r)
    if rows:
        yield now, rows


# Tables of a fixed size ------------------------------------------------------------------------------------------


class Counter:
    """Counts of both bits of slots in one task."""

    def __init__(self, slots: int):
        self.n = np.zeros(2 * slots, np.int32)

    def add(self, slots: np.ndarray, bit: np.ndarray) -> None:
        at = (2 * slots + bit).astype(np.int32)
        at.sort()
        first = np.flatnonzero(np.diff(at, prepend=-1))
        self.n[at[first]] += np.diff(first, append=len(at)).astype(np.int32)

    def add_words(self, x: Texts, times: np.ndarray) -> None:
        """To the slots without a context, all tokens of a word at once."""
        for j in range(DENSE_DEPTH[0]):
            w = np.flatnonzero((x.bits > j) & (times > 0))
            bit = (x.top[w] >> np.uint32(DENSE_DEPTH[0] - 1 - j) & np.uint32(1)).astype(np.int64)
            np.add.at(self.n, 2 * dense_slots(0, np.uint32(0), _nodes(x.top[w], j)) + bit, times[w].astype(np.int32))

    def segments(self) -> Iterator[tuple[int, bytes]]:
        """Number, and used places with both counts, of each segment that is used."""
        for seg in range(-(-len(self.n) // (2 * SEGMENT))):
            mine = self.n[2 * SEGMENT * seg : 2 * SEGMENT * (seg + 1)].reshape(-1, 2)
            used = np.flatnonzero(mine.any(1))
            if len(used):
                yield seg, len(used).to_bytes(4, "little") + _pack(used.astype(np.uint16), mine[used].ravel())


_SEG = pa.schema([("seg", pa.int32()), ("data", pa.binary())])
_SEG_DDL = "seg int, data binary"


def _merged(segments: DataFrame) -> list[tuple[int, bytes]]:
    """Of each segment, the probability of a one (16 bits) and how often the slot was used (8 bits, see Table)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seg, rows in _groups(batches, "seg"):
            n = np.zeros((SEGMENT, 2), np.int64)
            for r in rows:
                k = int.from_bytes(r["data"][:4], "little")
                used, counts = _unpack(r["data"][4:], (np.uint16, k), (np.int32, 2 * k))
                n[used] += counts.reshape(k, 2)
            total = n.sum(1)
            p = np.round(n[:, 1] / np.maximum(total, 1) * 65535).astype(np.uint16)
            q = np.where(total < 128, total, np.minimum(255, np.round(128 + 4 * np.log2(np.maximum(total, 1) / 128)))).astype(np.uint8)
            yield batch_of(_SEG, [[seg], [_pack(p, q)]])

    return [(r["seg"], bytes(r["data"])) for r in segments.repartition("seg").sortWithinPartitions("seg").mapInArrow(run, _SEG_DDL).collect()]


class Table:
    """What the slots of several contexts say."""

    def __init__(self, bits: tuple[int, ...], segments: list[tuple[int, bytes]]):
        slots = sum(1 << b for b in bits)
        slots += -slots % SEGMENT
        self.bits, self.q = bits, np.zeros(slots, np.uint8)
        k = np.arange(256)
        self.times = np.where(k < 128, k, 128 * 2.0 ** ((k - 128) / 4)).astype(np.float32)
        #: For each slot the log-odds of a zero and of a one, each with the event itself and without it.
        self.said = np.zeros((slots, 4), np.int16)
        for seg, data in segments:
            at = slice(seg * SEGMENT, (seg + 1) * SEGMENT)
            p, self.q[at] = _unpack(data, (np.uint16, SEGMENT), (np.uint8, SEGMENT))
            n = self.times[self.q[at]]
            ones = p.astype(np.float32) * (n / np.float32(65535))
            for bit in (0, 1):
                for own in (0, 1):
                    said = odds(n, ones if bit else n - ones, np.float32(own))[0]
                    self.said[at, 2 * bit + own] = np.round(np.clip(said, -16, 16) * UNIT)
        self.said = self.said.ravel()

    def agree(self, slots: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Log-odds of the bits that came; kind: twice the bit, and one if the event is to be left out."""
        return self.said[4 * slots + kind] * np.float32(1 / UNIT)

    def seen(self, slots: np.ndarray, own: np.ndarray) -> np.ndarray:
        """How often the slots were seen, without the event itself where own is 1."""
        return np.maximum(self.times[self.q[slots]] - own, 0)


def odds(n: np.ndarray, same: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.maximum(n - own, 0)
    same = np.clip(same - own, 0, n)
    return np.log((same + np.float32(0.4)) / (n - same + np.float32(0.4))), n


def slots_of(bits: tuple[int, ...], k: int, context: np.ndarray, node: np.ndarray) -> np.ndarray:
    h = (context ^ node) * _U(0xD6E8FEB86659FD93)
    return ((h ^ (h >> _U(32))) * _U(0x9E3779B97F4A7C15) >> _U(64 - bits[k])).astype(np.int64) + int(sum(1 << b for b in bits[:k]))


def dense_slots(k: int, context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """In 32 bits, as the dense contexts are not many."""
    h = (context ^ node) * np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    h >>= np.uint32(32 - DENSE_BITS[k])
    return h.astype(np.int64) + sum(1 << b for b in DENSE_BITS[:k])


# Mixing ----------------------------------------------------------------------------------------------------------


def _bucket(z: np.ndarray) -> np.ndarray:
    return np.minimum(np.abs(z) * np.float32(BUCKETS / 12), np.float32(BUCKETS - 1)).astype(np.int64)


class Mixer:
    """Weights and refining table of each gate. Log-odds are those of the bits that came, so both bits are treated alike."""

    def __init__(self, gates: int, inputs: int, sums: np.ndarray | None = None):
        self.gates, self.w = gates, np.full((gates, inputs), 1.2 / inputs)
        self.seen, self.refine, self.step = np.zeros(gates), np.zeros((gates, BUCKETS, 2)), 0
        if sums is not None and len(sums):
            k = gates * inputs
            seen = sums[k : k + gates, None]
            self.w = np.where(seen > 0, sums[:k].reshape(gates, inputs) / np.maximum(seen, 1e-9), self.w)
            refine = sums[k + gates :].reshape(gates, BUCKETS, 2)
            middle = 1 / (1 + np.exp(-(np.arange(BUCKETS) + 0.5) * (12 / BUCKETS)))
            self.right = (refine[:, :, 1] + 50 * middle) / (refine.sum(2) + 50)
            self.off = ((self.right - 0.5) / 2).astype(np.float32).ravel()
        self._begin()

    def _begin(self) -> None:
        """What a step is taken from: how often each gate was met, and sums of each input."""
        self.mass, self.push, self.bend = np.zeros(self.gates), np.zeros(self.w.shape), np.zeros(self.w.shape)
        self.now = np.ascontiguousarray(self.w.T.astype(np.float32))

    def mix(self, inputs: list[np.ndarray | None], gate: np.ndarray) -> np.ndarray:
        """An input that is None is zero."""
        z = np.zeros(len(gate), np.float32)
        for w, x in zip(self.now, inputs):
            if x is not None:
                z += w[gate] * x
        return z

    def gather(self, inputs: list[np.ndarray | None], gate: np.ndarray) -> None:
        gate = gate.astype(np.int64)
        z = self.mix(inputs, gate)
        self.mass += np.bincount(gate, minlength=self.gates)
        miss = (1 - np.tanh(np.clip(z, -20, 20) / 2)) / 2
        curve = miss * (1 - miss)
        for k, x in enumerate(inputs):
            if x is not None:
                self.push[:, k] += np.bincount(gate, miss * x, self.gates)
                self.bend[:, k] += np.bincount(gate, curve * x * x, self.gates)
        n = np.bincount((gate * BUCKETS + _bucket(z)) * 4 + 2 * (z != 0) + (z > 0), minlength=2 * self.refine.size)
        self.refine += n.reshape(self.gates, BUCKETS, 4)[:, :, 2:]

    def learn(self, inputs: list[np.ndarray | None] = (), gate: np.ndarray | None = None) -> None:
        """One step of the weights towards what came, and what was gathered."""
        if gate is not None:
            self.gather(inputs, gate)
        rate = 0.3 / np.sqrt(1 + self.step / 8)
        self.w += rate * np.clip(self.push / (self.bend + 0.02 * self.mass[:, None] + 1e-9), -1, 1)
        self.seen += self.mass
        self.step += 1
        self._begin()

    def sums(self) -> np.ndarray:
        """What adds up over tasks: weights by their task's share, the shares, and the refining table."""
        return np.concatenate([(self.w * self.seen[:, None]).ravel(), self.seen, self.refine.ravel()])

    def log10(self, inputs: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        """Of the bits that came, log10 of their probability."""
        gate = gate.astype(np.int64)
        z = self.mix(inputs, gate)
        p = np.tanh(z / 2) / 4 + np.sign(z) * self.off[gate * BUCKETS + _bucket(z)]  # around a half: the mean of the mixed and the refined
        return np.log10(np.clip(p + np.float32(0.5), np.float32(2.0**-16), np.float32(1 - 2.0**-16)))


def _summed(rows: DataFrame, size: int) -> np.ndarray:
    """rows: i, v."""
    out = np.zeros(size)
    for r in rows.groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def _sum_rows(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["i", "v"])


# Spelling --------------------------------------------------------------------------------------------------------


class Spelled:
    """The bytes of words and a space, and their contexts."""

    def __init__(self, words: list[str]):
        raw = [w.encode() + b" " for w in words]
        self.lens = np.fromiter(map(len, raw), np.int64, len(raw))
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.word = np.repeat(np.arange(len(raw)), self.lens)
        self.place = np.arange(len(self.data)) - np.repeat(np.cumsum(self.lens) - self.lens, self.lens)
        back = [self._back(k).astype(_U) for k in (1, 2, 3, 4)]
        contexts = [back[0]]
        for k in (1, 2, 3):
            contexts.append(contexts[-1] | back[k] << _U(8 * k))
        self.contexts = [_mixed(c + _U(k + 1 << 40)) for k, c in enumerate(contexts)] + [self._begun()]

    def _back(self, k: int) -> np.ndarray:
        out = np.full(len(self.data), 32, np.uint8)
        if len(out) > k:
            out[k:] = np.where(self.place[k:] >= k, self.data[:-k], 32)
        return out

    def _begun(self) -> np.ndarray:
        longest = int(self.lens.max()) if len(self.lens) else 0
        power = np.cumprod(np.concatenate([np.ones(1, _U), np.full(max(0, longest - 1), 0xD6E8FEB86659FD93, _U)]), dtype=_U)
        total = np.concatenate([np.zeros(1, _U), np.cumsum((self.data.astype(_U) + _U(1)) * power[self.place], dtype=_U)])
        return _mixed(total[:-1] - total[np.arange(len(self.data)) - self.place] + self.place.astype(_U))

    def parts(self) -> Iterator[tuple[slice, list[np.ndarray], np.ndarray]]:
        """Bytes, slots of each context, and bits (8 of each byte)."""
        for lo in range(0, len(self.data), PART // 8):
            part = slice(lo, min(lo + PART // 8, len(self.data)))
            s = self.data[part].astype(np.int64)
            node = _mixed(np.stack([(1 << j) | (s >> (8 - j)) for j in range(8)], 1).ravel().astype(_U))
            bit = np.stack([s >> (7 - j) & 1 for j in range(8)], 1).ravel()
            yield part, [slots_of(SPELL_BITS, k, np.repeat(c[part], 8), node) for k, c in enumerate(self.contexts)], bit

    def inputs(self, t: Table, own: np.ndarray) -> Iterator[tuple[slice, list[np.ndarray], np.ndarray]]:
        """Bytes, log-odds of each predictor, and gates. own: whether the word is among those that were counted."""
        for part, slots, bit in self.parts():
            mine = np.repeat(own[self.word[part]], 8).astype(np.float32)
            kind = 2 * bit + (mine > 0)
            seen = [np.searchsorted(np.array([1, 4, 16], np.float32), t.seen(slots[k], mine), "right") for k in (3, 4)]
            gate = seen[1] * 3 + np.minimum(seen[0], 2)
            yield part, [t.agree(x, kind) for x in slots], gate

    def price(self, t: Table, mixer: Mixer, own: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.lens))
        for part, inputs, gate in self.inputs(t, own):
            out += np.bincount(np.repeat(self.word[part], 8), mixer.log10(inputs, gate), len(out))
        return out


def _some(words: list[str], own: np.ndarray) -> Iterator[tuple[list[str], np.ndarray, slice]]:
    """Words of about a megabyte at most, so that one long word alone takes more."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    at = 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 18), "right")))
        yield words[at:to], own[at:to], slice(at, to)
        at = to


# Blocks and their words ------------------------------------------------------------------------------------------


def _hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), _U, len(words))


class Block:
    """Token numbers of texts, and the words they stand for, by their hashes."""

    def __init__(self, texts: pa.Array, held: np.ndarray):
        if texts.null_count:
            texts = texts.fill_null("")
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
        words, offs = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        offs = offs - offs[0]
        empty = pc.equal(words, "")
        if pc.any(empty).as_py():
            full = pc.invert(empty)
            offs = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[offs]
            words = words.filter(full)
        coded = words.dictionary_encode()
        del words, lists, empty
        known = [*coded.dictionary.to_pylist(), END]
        order = np.argsort(_hashes(known), kind="stable")
        place = np.empty(len(known), np.int32)
        place[order] = np.arange(len(known), dtype=np.int32)
        self.words = [known[i] for i in order]
        own = coded.indices.to_numpy(zero_copy_only=False)
        n = len(offs) - 1
        self.lens = np.diff(offs) + 1
        self.codes = np.full(len(own) + n, place[-1], np.int32)
        spot = np.ones(len(self.codes), bool)
        spot[np.cumsum(self.lens) - 1] = False
        self.codes[spot] = place[own] if len(own) else own
        self.train = np.bincount(self.codes[~np.repeat(held, self.lens)], minlength=len(known))


_BLOCK_DDL = "block long, doc_id array<long>, held binary, lens binary, codes binary, words binary, counts binary, n_words long, n_tokens long, n_train long, n_bytes long"
_BLOCK = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("held", "lens", "codes", "words", "counts")), *((c, pa.int64()) for c in ("n_words", "n_tokens", "n_train", "n_bytes"))])


def _blocks(rows: DataFrame) -> DataFrame:
    """rows: doc_id, held, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard
        from pyspark import TaskContext

        part, waiting, size, done = TaskContext.get().partitionId(), [], 0, 0

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            held = t["held"].to_numpy()
            # A number of partition, place and all that the block holds: a block that is lost comes back the same, and blocks that share a number are equal.
            of = xxhash.xxh64(repr((part, done, t["doc_id"].to_pylist())))
            for x in string_buffers(t["text"]):
                of.update(np.ascontiguousarray(x))
            x = Block(t["text"].chunk(0), held)
            ids = pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t["doc_id"].chunk(0))
            packed = [_pack(held.astype(np.uint8)), _pack(x.lens.astype(np.int32)), _pack(x.codes), zstandard.ZstdCompressor(3).compress(" ".join(x.words).encode()), _pack(x.train.astype(np.int32))]
            return batch_of(_BLOCK, [[of.intdigest() >> 1], ids, *([p] for p in packed), [len(x.words)], [len(x.codes)], [int(x.train.sum())], [size]])

        for b in sliced(batches, "text"):
            waiting.append(b)
            size += int(string_buffers(col_of(b, "text"))[1][-1])
            if size >= BLOCK_BYTES:
                yield block()
                size, done = 0, done + 1
        if waiting:
            yield block()
        give_back()

    return rows.mapInArrow(run, _BLOCK_DDL)


_LETTER = pa.schema([("q", pa.int32()), ("block", pa.int64()), ("data", pa.binary()), ("counts", pa.binary())])
_LETTER_DDL = "q int, block long, data binary, counts binary"


def _letters(frame: DataFrame, run: Callable, log_q: int) -> DataFrame:
    """What blocks send to the tasks 0 to 2 ** log_q - 1, dealt to them in order."""
    return frame.mapInArrow(run, _LETTER_DDL).repartition(1 << log_q, "q").sortWithinPartitions("q", "block")


def _word_letters(blocks: DataFrame, log_q: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, unpack = zstandard.ZstdCompressor(3).compress, zstandard.ZstdDecompressor().decompress
        for b in batches:
            for r in b.to_pylist():
                words = unpack(r["words"]).decode().split(" ")
                counts = _unpack(r["counts"], (np.int32, None))[0]
                cut = np.searchsorted(_hashes(words) >> _U(64 - log_q), np.arange((1 << log_q) + 1, dtype=_U))
                some = [(q, lo, hi) for q, (lo, hi) in enumerate(zip(cut[:-1], cut[1:])) if hi > lo]
                for at in range(0, len(some), 64):
                    mine = some[at : at + 64]
                    yield batch_of(_LETTER, [[q for q, _, _ in mine], [r["block"]] * len(mine), [pack(" ".join(words[lo:hi]).encode()) for _, lo, hi in mine], [_pack(counts[lo:hi]) for _, lo, hi in mine]])

    return _letters(blocks.select("block", "words", "counts"), run, log_q)


def classes(c: np.ndarray, least: float) -> np.ndarray:
    """Of counts; those of listed words come after all others, LISTED at most."""
    k = np.where(c < 2, OTHER, np.minimum(1 + np.floor(2 * np.log2(np.maximum(c, 1))), LISTED - 1)).astype(np.int64)
    return k + ((c >= 2) & (c >= least))


class Lexicon:
    """The different words of a task, how often training texts have them, and where letters have them."""

    def __init__(self, rows: list[dict]):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        lists = [pa.array(unpack(r["data"]).decode().split(" "), pa.string()) for r in rows]
        coded = pa.chunked_array(lists).combine_chunks().dictionary_encode()
        self.words = coded.dictionary.to_pylist()
        at = coded.indices.to_numpy()
        self.c = np.bincount(at, np.concatenate([_unpack(r["counts"], (np.int32, None))[0] for r in rows]), len(self.words)).astype(np.int64)
        ends = np.cumsum([len(x) for x in lists])
        self.letters = [(r["block"], at[lo:hi]) for r, lo, hi in zip(rows, [0, *ends[:-1]], ends)]

    def classes(self, least: float) -> np.ndarray:
        """Of each word its class; least: how often a listed word is seen."""
        k = classes(self.c, least)
        if END in self.words:
            k[self.words.index(END)] = ENDING
        return k


_STAT = pa.schema([("k", pa.int32()), ("word", pa.string()), ("n", pa.int64())])


def _stats(letters: DataFrame, least: float) -> tuple[int, np.ndarray, list[tuple[str, int]]]:
    """How many words training texts have; of each class, how many words a task has at most; the listed words, by counts, and their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "q"):
            x = Lexicon(rows)
            k = x.classes(least)
            n = np.bincount(k, minlength=ENDING + 1)
            listed = np.flatnonzero((x.c >= 2) & (x.c >= least) & (k != ENDING))
            yield batch_of(_STAT, [[*range(len(n)), -1, *k[listed]], [*[None] * (len(n) + 1), *(x.words[i] for i in listed)], [*n, int((x.c > 0).sum()), *x.c[listed]]])
        give_back()

    v, most, listed = 0, np.zeros(ENDING + 1, np.int64), []
    for r in letters.mapInArrow(run, "k int, word string, n long").groupBy("k", "word").agg(F.max("n").alias("most"), F.sum("n").alias("sum")).collect():
        if r["word"] is not None:
            listed.append((-r["sum"], r["word"], r["k"]))
        elif r["k"] < 0:
            v = r["sum"]
        else:
            most[r["k"]] = r["most"]
    return v, most, [(w, k) for _, w, k in sorted(listed)]


class Codes:
    """How many bits say which word of a class it is."""

    def __init__(self, most: np.ndarray, listed: list[tuple[str, int]], log_q: int):
        """listed: words and their classes, each word's number is its place among those of its class."""
        self.most, self.at, n = np.maximum(most, 1), {}, {}
        for w, k in listed:
            self.at[w] = n[k] = n.get(k, -1) + 1
        self.bits = np.array([min(INDEX, max(1, math.ceil(math.log2(m)) + log_q)) for m in self.most])
        for k, last in n.items():
            self.bits[k] = last.bit_length()
        self.listed = set(n)
        self.bits[[OTHER, ENDING]] = 0

    def of(self, q: int, x: Lexicon, k: np.ndarray) -> np.ndarray:
        """Class, and number within it, of each word; those of another word tell such words apart, but are not a code."""
        code = k << INDEX
        for c in np.unique(k):
            mine = np.flatnonzero(k == c)
            if c in self.listed:
                code[mine] |= np.array([self.at[x.words[i]] for i in mine], np.int64) << (INDEX - self.bits[c])
            elif c == OTHER:
                code[mine] |= (q << 24) + np.arange(len(mine))
            elif c != ENDING:
                code[mine] |= (q * self.most[c] + np.arange(len(mine))) << (INDEX - self.bits[c])
        return code


def _spell_tables(letters: DataFrame, n_tasks: int) -> list[tuple[int, bytes]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = Counter(sum(1 << b for b in SPELL_BITS))
        for _, rows in _groups(batches, "q"):
            x = Lexicon(rows)
            words = [w for w, c in zip(x.words, x.c) if c > 0 and w != END]
            for some, _, _ in _some(words, np.ones(len(words), bool)):
                for _, slots, bit in Spelled(some).parts():
                    for s in slots:
                        n.add(s, bit)
        for seg, data in n.segments():
            yield batch_of(_SEG, [[seg], [data]])
        del n
        give_back()

    return _merged(letters.coalesce(n_tasks).mapInArrow(run, _SEG_DDL))


def _spell_mixer(letters: DataFrame, tables, n_tasks: int) -> Mixer:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, mixer = tables.value.unpacked(), Mixer(SPELL_GATES, len(SPELL_BITS))
        for _, rows in _groups(batches, "q"):
            x = Lexicon(rows)
            words = [w for w, c in zip(x.words, x.c) if c > 0 and w != END]
            for some, own, _ in _some(words, np.ones(len(words), bool)):
                for _, inputs, gate in Spelled(some).inputs(t, own):
                    mixer.learn(inputs, gate)
        yield _sum_rows(mixer.sums())
        give_back()

    size = Mixer(SPELL_GATES, len(SPELL_BITS)).sums().size
    return Mixer(SPELL_GATES, len(SPELL_BITS), _summed(letters.coalesce(n_tasks).mapInArrow(run, "i int, v double"), size))


_ANSWER = pa.schema([("block", pa.int64()), ("q", pa.int32()), ("data", pa.binary())])
_ANSWER_DDL = "block long, q int, data binary"


def _word_answers(letters: DataFrame, codes: Codes, least: float, tables, mixer: Mixer) -> DataFrame:
    """To each block: counts, codes and prices of its words, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables.value.unpacked()
        for q, rows in _groups(batches, "q"):
            x = Lexicon(rows)
            k = x.classes(least)
            code, price = codes.of(q, x, k), np.zeros(len(k), np.float32)
            rare = np.flatnonzero(k == OTHER)
            for some, own, at in _some([x.words[i] for i in rare], x.c[rare] > 0):
                price[rare[at]] = Spelled(some).price(t, mixer, own)
            for block, at in x.letters:
                yield batch_of(_ANSWER, [[block], [q], [len(at).to_bytes(4, "little") + _pack(x.c[at], code[at], price[at])]])
        give_back()

    return letters.mapInArrow(run, _ANSWER_DDL)


# Texts as codes --------------------------------------------------------------------------------------------------


class Rules:
    """What tasks need to know of the whole corpus."""

    def __init__(self, n: int, v: int, bits: np.ndarray, context_bits: int):
        self.n, self.v, self.bits, self.context_bits = n, v, bits, context_bits


class Words:
    """Counts, codes and prices of a block's words, from the answers."""

    def __init__(self, answers: list[dict]):
        got = {}
        for r in answers:
            got.setdefault(r["q"], r["data"])
        raw = []
        for q in sorted(got):
            n = int.from_bytes(got[q][:4], "little")
            raw.append(_unpack(got[q][4:], (np.int64, n), (np.int64, n), (np.float32, n)))
        self.c, self.code, self.price = (np.concatenate(x) for x in zip(*raw))


def sorted_pairs(context: np.ndarray, code: np.ndarray) -> np.ndarray:
    """As np.lexsort((code, context)), but for the order of equal pairs."""
    order = np.argsort(context)
    c = context[order]
    same = c[1:] == c[:-1]
    at = np.flatnonzero(np.append(same, False) | np.append(False, same))
    mine = order[at]
    order[at] = mine[np.lexsort((code[mine], c[at]))]
    return order


class Texts:
    """Tokens of a block with codes and contexts."""

    def __init__(self, row: dict, words: Words, rules: Rules):
        self.words, self.rules = words, rules
        self.lens, self.held, self.tok = (_unpack(row[c], (kind, None))[0] for c, kind in (("lens", np.int32), ("held", np.uint8), ("codes", np.int32)))
        self.first = np.cumsum(self.lens, dtype=np.int64) - self.lens
        n, start = len(self.tok), len(words.c)
        ident = np.append(words.code, 1 << 60).astype(_U)
        kind = words.code >> INDEX
        self.target = np.where(kind == OTHER, 0, words.code)
        self.bits = (CLASS + rules.bits[kind]).astype(np.uint8)
        self.before = np.empty(n, np.int32)
        self.before[1:] = self.tok[:-1]
        self.before[self.first] = start
        second = np.empty(n, np.int32)
        second[1:] = self.before[:-1]
        second[self.first] = start
        common = np.append(words.c * COMMON >= max(rules.n, 1), True)
        self.keyed = ~(common[self.before] & common[second])
        two = _mixed(_mixed(ident)[second] * _U(0x9E3779B97F4A7C15) + ident[self.before])
        self.context = two >> _U(64 - rules.context_bits)
        del two, second
        often = words.c * OFTEN >= max(rules.n, 1)
        self.one = (_mixed(np.append(np.where(often & (words.c > 1), ident[:-1], kind.astype(_U) + _U(1)), ident[-1]) + _U(1 << 61)) >> _U(32)).astype(np.uint32)
        self.two = (self._common(common[:-1], _mixed(ident)) >> _U(32)).astype(np.uint32)
        self.top = (self.target >> (CLASS + INDEX - DENSE_DEPTH[0])).astype(np.uint32)

    def _common(self, common: np.ndarray, ident: np.ndarray) -> np.ndarray:
        """Of each token, a hash of the last two common words before it in its text."""
        n = len(self.tok)
        first = np.repeat(self.first, self.lens)
        last = np.maximum.accumulate(np.where(common[self.tok], np.arange(n), -1))
        last = np.concatenate([[-1], last[:-1]])
        last[last < first] = -1
        one = np.where(last >= 0, ident[self.tok[last]], ident[-1])
        far = np.where(last >= 0, last[last], -1)
        return _mixed(one * _U(3) + np.where(far >= 0, ident[self.tok[far]], ident[-1]))

    def pairs(self) -> None:
        """The different pairs of a context and a code, in order, and which pair each token of `keyed` is."""
        at = np.flatnonzero(self.keyed)
        code = self.target[self.tok[at]]
        context = self.context[at]
        order = sorted_pairs(context, code)
        context, code = context[order], code[order]
        new = np.ones(len(at), bool)
        new[1:] = (context[1:] != context[:-1]) | (code[1:] != code[:-1])
        number = np.cumsum(new) - 1
        self.pair = np.full(len(self.tok), -1, np.int32)
        self.pair[at[order]] = number
        learned = np.repeat(self.held == 0, self.lens)[at[order]]
        self.pair_context, self.pair_code = context[new], code[new]
        self.pair_count = np.bincount(number, learned, int(new.sum())).astype(np.int64)

    def slices(self, most: int) -> Iterator[slice]:
        for at in range(0, len(self.tok), most):
            yield slice(at, min(at + most, len(self.tok)))

    def longest_first(self, part: slice, some: np.ndarray | None = None) -> np.ndarray:
        """Tokens of a part (or some of them), counted from its start: those that have a place in their code come before those that don't."""
        bits = self.bits[self.tok[part]]
        at = np.arange(len(bits)) if some is None else np.flatnonzero(some)
        return at[np.argsort(bits[at], kind="stable")[::-1]]

    def places(self, at: np.ndarray, skip: int = 0) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray]]]:
        """Of each place in the codes of tokens (by longest_first): how many have it, their bits, and slots of the dense contexts that count it, but the first `skip`."""
        tok = self.tok[at]
        contexts, top, code = (None, self.one[self.before[at]], self.two[at]), self.top[tok], self.target[tok]
        has = len(at) - np.cumsum(np.bincount(self.bits[tok], minlength=CLASS + INDEX + 1))
        for j in range(int(np.count_nonzero(has)) + (len(at) > 0 and has[0] == 0)):
            n = int(has[j])
            if j >= DENSE_DEPTH[0]:
                yield j, n, code[:n] >> (CLASS + INDEX - 1 - j) & 1, []
                continue
            node = _nodes(top[:n], j)
            bit = (top[:n] >> np.uint32(DENSE_DEPTH[0] - 1 - j) & np.uint32(1)).astype(np.int64)
            yield j, n, bit, [dense_slots(k, np.uint32(0) if k == 0 else contexts[k][:n], node) for k, depth in enumerate(DENSE_DEPTH) if k >= skip and j < depth]


def _nodes(top: np.ndarray, j: int) -> np.ndarray:
    """Hashes of the first j bits of codes."""
    x = (top >> np.uint32(DENSE_DEPTH[0] - j)) << np.uint32(6) | np.uint32(j)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def _coded(batches: Iterator[pa.RecordBatch], rules: Rules) -> Iterator[tuple[int, Texts]]:
    for block, rows in _groups(batches, "block"):
        words = Words([r for r in rows if r["kind"] == 1])
        for r in rows:
            if r["kind"] == 0:  # blocks that share a number are equal
                yield block, Texts(r, words, rules)


def _dense_tables(coded: DataFrame, rules: Rules, n_tasks: int) -> list[tuple[int, bytes]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = Counter(sum(1 << b for b in DENSE_BITS))
        for _, x in _coded(batches, rules):
            learned = np.repeat(x.held == 0, x.lens)
            n.add_words(x, np.bincount(x.tok[learned], minlength=len(x.target)))
            for part in x.slices(16 * TOKENS):
                for _, _, bit, every in x.places(part.start + x.longest_first(part, learned[part]), 1):
                    for slots in every:
                        n.add(slots, bit[: len(slots)])
        for seg, data in n.segments():
            yield batch_of(_SEG, [[seg], [data]])
        del n
        give_back()

    return _merged(coded.coalesce(n_tasks).mapInArrow(run, _SEG_DDL))


# What follows two words ------------------------------------------------------------------------------------------


def _pair_letters(coded: DataFrame, rules: Rules, log_q: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, x in _coded(batches, rules):
            x.pairs()
            cut = np.searchsorted(x.pair_context >> _U(rules.context_bits - log_q), np.arange((1 << log_q) + 1, dtype=_U))
            some = [(q, slice(lo, hi)) for q, (lo, hi) in enumerate(zip(cut[:-1], cut[1:])) if hi > lo]
            for at in range(0, len(some), 64):
                mine = some[at : at + 64]
                yield batch_of(_LETTER, [[q for q, _ in mine], [block] * len(mine), [_pack(np.diff(x.pair_context[s], prepend=_U(0)), x.pair_code[s]) for _, s in mine], [_pack(x.pair_count[s]) for _, s in mine]])
            del x
        give_back()

    return _letters(coded, run, log_q)


def quantised(n: np.ndarray) -> np.ndarray:
    """Counts in a byte: exact up to 32, then four steps an octave."""
    return np.where(n <= 32, n, np.minimum(255, 32 + np.round(4 * np.log2(np.maximum(n, 1) / 32)))).astype(np.uint8)


#: What the bytes of quantised stand for.
COUNTS = np.where(np.arange(256) <= 32, np.arange(256), 32 * 2.0 ** ((np.arange(256) - 32) / 4)).astype(np.float32)
#: By whether the event is to be left out, the context's byte, and the byte with the bit that came: log-odds; by the first two: the gate's level.
FOLLOWED, _n = odds(COUNTS[None, :, None], COUNTS[None, None, :], np.array([0, 1], np.float32)[:, None, None])
FOLLOWED = np.where(_n == 0, np.float32(0), FOLLOWED).ravel()
LEVEL = np.searchsorted(np.array([1, 2, 4, 16], np.float32), _n.ravel(), "right").astype(np.uint8)


def followed(context: np.ndarray, code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair (sorted, different): how often the context was seen, with the code's first bit, its first two, ...

    Bytes (see quantised) of all pairs one after the other, and how many each has: up to where
    only this code is left, as the counts stay the same from there on.
    """
    lens, levels, live = np.ones(len(code), np.int64), [], np.arange(len(code))
    j = 0
    while len(live):
        c, top = context[live], code[live] >> (CLASS + INDEX - j)
        new = np.ones(len(live), bool)
        new[1:] = (c[1:] != c[:-1]) | (top[1:] != top[:-1])
        start, mine = np.flatnonzero(new), np.cumsum(new) - 1
        levels.append((live, quantised(np.add.reduceat(count[live], start))[mine]))
        more = np.diff(start, append=len(live))[mine] > 1
        live, j = live[more], j + 1
        lens[live] = j + 1
    flat, first = np.zeros(int(lens.sum()), np.uint8), np.cumsum(lens) - lens
    for j, (at, n) in enumerate(levels):
        flat[first[at] + j] = n
    return flat, lens


def _pair_answers(letters: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, rows in _groups(batches, "q"):
            counts = [_unpack(r["counts"], (np.int64, None))[0] for r in rows]
            pairs = [_unpack(r["data"], (_U, len(n)), (np.int64, len(n))) for r, n in zip(rows, counts)]
            context, code = np.concatenate([np.cumsum(c, dtype=_U) for c, _ in pairs]), np.concatenate([c for _, c in pairs])
            del pairs
            order = sorted_pairs(context, code)
            context, code = context[order], code[order]
            new = np.ones(len(order), bool)
            new[1:] = (context[1:] != context[:-1]) | (code[1:] != code[:-1])
            at = np.empty(len(order), np.int64)
            at[order] = np.cumsum(new) - 1
            total = np.bincount(at, np.concatenate(counts), int(new.sum())).astype(np.int64)
            flat, lens = followed(context[new], code[new], total)
            del order, context, code
            first = np.cumsum(lens) - lens
            lo = 0
            for r, n in zip(rows, counts):
                mine = at[lo : lo + len(n)]
                lo += len(n)
                yield batch_of(_ANSWER, [[r["block"]], [q], [len(n).to_bytes(4, "little") + _pack(lens[mine].astype(np.uint8), flat[ragged(first[mine], lens[mine])])]])
        give_back()

    return letters.mapInArrow(run, _ANSWER_DDL)


class Scored:
    """Texts with the answers on pairs: inputs and gates of all bits."""

    def __init__(self, x: Texts, answers: dict[int, bytes], table: Table):
        self.x, self.table = x, table
        x.pairs()
        raw = [_unpack(answers[q][4:], (np.uint8, int.from_bytes(answers[q][:4], "little")), (np.uint8, None)) for q in sorted(answers)]
        self.lens = np.concatenate([np.zeros(0, np.uint8), *(n for n, _ in raw)]).astype(np.int64)
        self.flat = np.concatenate([np.zeros(0, np.uint8), *(f for _, f in raw), np.zeros(1, np.uint8)])
        self.at = np.cumsum(self.lens) - self.lens
        self.own = np.repeat(x.held == 0, x.lens)
        self.run = self._run()

    def _run(self) -> np.ndarray:
        """For how many words (3 at most) the two words before have told the next one, up to each token."""
        x = self.x
        n = len(x.tok)
        pair = np.maximum(x.pair, 0)
        last = self.flat[self.at[pair] + self.lens[pair] - 1] if len(self.lens) else np.zeros(n, np.uint8)
        told = x.keyed & (last > self.own)
        place = np.maximum.accumulate(np.where(x.keyed, np.arange(n), -1))  # words after two common ones change nothing
        first = np.repeat(x.first, x.lens)
        told = np.where(place >= first, told[place], False)
        far = np.arange(n) - first
        run, still = np.zeros(n, np.int8), np.ones(n, bool)
        for back in (1, 2, 3):
            before = np.zeros(n, bool)
            before[back:] = told[:-back]
            still &= before & (far >= back)
            run += still
        return run

    def inputs(self, at: np.ndarray) -> Iterator[tuple[int, list[np.ndarray | None], np.ndarray]]:
        """Of each place in the codes of tokens (by longest_first): how many have it, log-odds of each predictor (None: it says nothing), and gates."""
        x, pair = self.x, self.x.pair[at]
        start, end = np.full(len(at), len(self.flat) - 1), np.zeros(len(at), np.int64)
        has = np.flatnonzero(pair >= 0)
        start[has], end[has] = self.at[pair[has]], self.lens[pair[has]] - 1
        own, run = self.own[at].astype(np.int64), self.run[at].astype(np.uint8) * np.uint8(10)
        seen = self.flat[start]
        for j, n, bit, every in x.places(at):
            mine = own[:n]
            kind = 2 * bit + mine
            out = [self.table.agree(slots, kind) for slots in every]
            out += [None] * (len(DENSE_BITS) - len(out))
            context = mine << 8 | seen[:n]
            seen = self.flat[start[:n] + np.minimum(j + 1, end[:n])]
            out.append(FOLLOWED[context << 8 | seen])
            yield n, out, run[:n] + LEVEL[context] * np.uint8(2) + np.uint8(j >= CLASS)

    def learn(self, mixer: Mixer) -> None:
        for part in self.x.slices(4 * TOKENS):
            for _, inputs, gate in self.inputs(part.start + self.x.longest_first(part, self.own[part])):
                mixer.gather(inputs, gate)
            mixer.learn()

    def price(self, mixer: Mixer) -> np.ndarray:
        """Of each token's code, log10 of its probability."""
        out = np.zeros(len(self.x.tok))
        for part in self.x.slices(4 * TOKENS):
            at = part.start + self.x.longest_first(part)
            sum_of = np.zeros(len(at))
            for n, inputs, gate in self.inputs(at):
                sum_of[:n] += mixer.log10(inputs, gate)
            out[at] = sum_of
        return out


_INPUTS = len(DENSE_BITS) + 1


def _answered(left: pa.Table, right: pa.Table, rules: Rules, table: Table) -> Iterator[tuple[dict, Scored]]:
    rows = left.to_pylist()
    words = Words([r for r in rows if r["kind"] == 1])
    answers = {}
    for q, data in zip(right["q"].to_pylist(), right["data"].to_pylist()):
        answers.setdefault(q, data)
    for r in rows:
        if r["kind"] == 0:
            yield r, Scored(Texts(r, words, rules), answers, table)


def held_out(id_col: str):
    """crc32 of the id as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


_OUT_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


class Sent:
    """A table as it is broadcast; a worker unpacks it once."""

    def __init__(self, bits: tuple[int, ...], segments: list[tuple[int, bytes]]):
        self.bits, self.segments, self.table = bits, segments, None

    def unpacked(self) -> Table:
        if self.table is None:
            self.table = Table(self.bits, self.segments)
        return self.table


def _mixer(coded: DataFrame, answers: DataFrame, rules: Rules, sent) -> Mixer:
    def learn(left: pa.Table, right: pa.Table) -> pa.Table:
        mixer = Mixer(GATES, _INPUTS)
        for _, s in _answered(left, right, rules, sent.value.unpacked()):
            s.learn(mixer)
        give_back()
        return pa.Table.from_batches([_sum_rows(mixer.sums())])

    sums = coded.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(learn, "i int, v double")
    return Mixer(GATES, _INPUTS, _summed(sums, Mixer(GATES, _INPUTS).sums().size))


def _scores(coded: DataFrame, answers: DataFrame, rules: Rules, sent, mixer: Mixer) -> DataFrame:
    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for r, s in _answered(left, right, rules, sent.value.unpacked()):
            x = s.x
            cost = x.words.price[x.tok] + s.price(mixer)
            c = x.words.c
            base = np.add.reduceat(np.log10(c + 1.0)[x.tok], x.first) - x.lens * math.log10(rules.n + rules.v + 1)
            known = np.add.reduceat((c > 0).astype(np.int64)[x.tok], x.first)
            tables.append(pa.table([pa.array(r["doc_id"], pa.int64()), pa.array(x.held > 0), x.lens.astype(np.int64), known, np.full(len(x.lens), rules.n), base, np.add.reduceat(cost, x.first)], schema=_OUT))
        give_back()
        return pa.concat_tables(tables) if tables else _OUT.empty_table()

    return coded.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add_up, _OUT_DDL)


def _log2(n: float, least: int) -> int:
    return max(least, math.ceil(math.log2(max(n, 1))))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held"), F.coalesce(text_col, F.lit("")).alias("text"))
    parts = max(2 * rows.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    blocks = kept(_blocks(rows))
    total = blocks.agg(*(F.sum(c).alias(c) for c in ("n_words", "n_tokens", "n_train", "n_bytes"))).first()
    if not total["n_tokens"]:
        return spark.createDataFrame([], _OUT_DDL)
    n, cores = total["n_train"], spark.sparkContext.defaultParallelism
    counting = max(cores, total["n_bytes"] // COUNTED_BYTES)
    log_q, log_pairs = _log2(total["n_words"] / WORDS_AT_ONCE, _log2(cores, 1)), _log2(total["n_tokens"] / PAIRS_AT_ONCE, _log2(cores, 1))

    letters, least = dealt(_word_letters(blocks, log_q)), n / OFTEN
    v, most, listed = _stats(letters, least)
    codes = Codes(most, listed, log_q)
    rules = Rules(n, v, codes.bits, min(62, _log2(total["n_tokens"], 1) + 10))
    spelling = spark.sparkContext.broadcast(Sent(SPELL_BITS, _spell_tables(letters, counting)))
    answers = _word_answers(letters, codes, least, spelling, _spell_mixer(letters, spelling, counting))
    static = blocks.select("block", F.lit(0).alias("kind"), F.lit(0).alias("q"), "doc_id", "held", "lens", "codes", F.lit(None).cast("binary").alias("data"))
    coded = static.unionByName(answers.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    coded = dealt(coded.repartition(parts, "block").sortWithinPartitions("block", "kind", "q"))
    blocks.unpersist()
    sent = spark.sparkContext.broadcast(Sent(DENSE_BITS, _dense_tables(coded, rules, counting)))

    told = dealt(_pair_answers(_pair_letters(coded, rules, log_pairs)).repartition(parts, "block"))
    mixer = _mixer(coded, told, rules, sent)
    return _scores(coded, told, rules, sent, mixer)
