"""The parts that need no Spark, against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twintongue.llm import chat, media, minhash, mixture, packing, store, suffix, tokens

WORDS = st.lists(st.sampled_from(["the", "The", "größe,", "don't", "a.b", "日本", "x" * 30, "é", "<|endoftext|>", "É", "H̱", "İ", "1234", "\x1e", "a b", "zz.;", "ﬁ"]), max_size=30)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(WORDS, st.sampled_from([" ", "\n", "  ", "\t"])), max_size=5))
def test_words_encode_as_whole_texts(parts):
    texts = [sep.join(words) for words, sep in parts]
    enc = tokens.shared_encoder(tokens.tokenizer_path())
    flat, offs = enc.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert list(flat[offs[i] : offs[i + 1]]) == enc.tok.encode(t, add_special_tokens=False).ids


def test_encoder_forgets_and_still_agrees():
    enc = tokens.WordEncoder(tokens.tokenizer_path(), 50)
    rng = random.Random(3)
    for _ in range(10):
        texts = [" ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 4))) for _ in range(60)) for _ in range(3)]
        flat, offs = enc.encode(pa.array([*texts, None]))
        for i, t in enumerate(texts):
            assert list(flat[offs[i] : offs[i + 1]]) == enc.tok.encode(t, add_special_tokens=False).ids
        assert offs[-1] == offs[-2]


@pytest.mark.parametrize("seed", range(25))
def test_suffix_array_against_brute_force(seed):
    rng = random.Random(seed)
    alphabet, length = rng.choice([b"ab", b"abcdefgh", b"a", bytes(range(256))]), rng.choice([40, 48, 63])
    base = bytes(rng.choice(alphabet) for _ in range(rng.randint(50, 300)))
    texts = []
    for _ in range(rng.randint(1, 8)):
        s = bytearray(base)
        for _ in range(rng.randint(0, 4)):
            s[rng.randrange(len(s))] = rng.choice(alphabet)
        texts.append(bytes(s[rng.randint(0, 40) :]))
    texts = [t for t in texts if len(t) >= length] or [base]
    counts = np.array([rng.choice([1, 1, 2]) for _ in texts])
    piece, lo, hi = suffix.repeated_windows(texts, counts, length)
    got = {(p, x) for p, a, b in zip(piece, lo, hi) for x in range(a, b)}
    seen = Counter(t[i : i + length] for t, n in zip(texts, counts) for i in range(len(t) - length + 1) for _ in range(n))
    assert got == {(k, i) for k, t in enumerate(texts) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1}
    data = np.frombuffer(b"".join(texts) + bytes(length + 8), np.uint8)
    wanted, at = np.zeros(len(data), bool), 0
    for t in texts:
        wanted[at : at + len(t) - length + 1] = True
        at += len(t)
    order = suffix.suffix_order(data, wanted, length)
    raw = data.tobytes()
    assert [raw[i : i + length] for i in order] == sorted(raw[i : i + length] for i in np.flatnonzero(wanted))
    prefixes = suffix.common_prefixes(data, order, length)
    for (a, b), n in zip(zip(order[:-1], order[1:]), prefixes):
        assert n == next((k for k in range(length) if raw[a + k] != raw[b + k]), length)


def test_anchors_are_equal_for_equal_windows():
    rng = np.random.default_rng(5)
    text = rng.integers(97, 105, 3000).astype(np.uint8)
    a = np.concatenate([rng.integers(97, 105, 700).astype(np.uint8), text, rng.integers(97, 105, 41).astype(np.uint8)])
    pick = lambda d, o: {(int(s - o), int(c), int(h)) for _, s, c, h in zip(*suffix.pieces(d, np.array([0, len(d)]), 200))}
    inner = {x for x in pick(text, 0) if 200 < x[0] < 2400}
    assert len(inner) > 5 and inner <= pick(a, 700)
    assert len(suffix.pieces(text[:199], np.array([0, 199]), 200)[0]) == 0


def test_probability_jaccard_and_its_estimate():
    texts = pa.array(["a b c d e f g h i j k l", "a b c d e f g h i j k z", "a b", "", None, "a b c d e a b c d e a b c d e"])
    text, h, w = minhash.shingles(texts)
    sets = [(h[text == i], w[text == i]) for i in range(6)]
    assert [len(s[0]) for s in sets] == [8, 8, 1, 0, 0, 5]
    assert minhash.probability_jaccard(*sets[0], *sets[1]) == pytest.approx(7 / 9)
    assert minhash.probability_jaccard(*sets[3], *sets[4]) == 1 and minhash.probability_jaccard(*sets[0], *sets[3]) == 0
    rng = np.random.default_rng(1)
    near = []
    for _ in range(40):
        a = np.sort(rng.choice(1 << 40, 60, replace=False)).astype(np.uint64)
        b = np.sort(np.concatenate([a[:48], rng.choice(1 << 40, 12, replace=False).astype(np.uint64)]))
        wa, wb = rng.integers(1, 5, 60), rng.integers(1, 5, 60)
        exact = sum(1 / sum(max(dict(zip(a, wa)).get(j, 0) / x, dict(zip(b, wb)).get(j, 0) / y) for j in set(a) | set(b)) for i, x in zip(a, wa) for k, y in zip(b, wb) if i == k)
        assert minhash.probability_jaccard(a, wa, b, wb) == pytest.approx(exact)
        sig = minhash.prob_min_hash(2, np.repeat([0, 1], 60), np.concatenate([a, b]), np.concatenate([wa, wb]), 512)
        near.append((sig[0] == sig[1]).mean() - exact)
    assert abs(np.mean(near)) < 0.02 and np.std(near) < 0.06


def test_signature_does_not_depend_on_the_batch():
    texts = ["one two three four five six seven", "x", "", "a b c d e f a b c d e f"]
    every = minhash.prob_min_hash(4, *minhash.shingles(pa.array(texts)), 96)
    for i, t in enumerate(texts):
        assert (minhash.prob_min_hash(1, *minhash.shingles(pa.array([t])), 96)[0] == every[i]).all()
    assert (every[2] == 0).all()


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="<|\\\n ab>é", max_size=40), st.text(alphabet="<|\\\n nab", max_size=12))
def test_chat_escapes_are_undone(text, role):
    made, lo, hi = chat.assemble(pa.array([role, "user"]), pa.array([text, text]))
    for i, r in enumerate((role, "user")):
        whole = made[i].as_py()
        found = chat._TURN.fullmatch(whole)
        assert chat.unescape_role(found[1]) == r and chat.unescape(found[2]) == text
        assert chat.unescape(whole.encode()[lo[i] : hi[i]].decode()) == text
        assert whole.count("<|") == 2


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 700), st.integers(0, 255))
def test_ogg_round_trip(units, byte):
    samples = bytes((byte + 7 * i) % 256 for i in range(192)) * units
    made = media.write_ogg(samples)
    got = media.read_ogg(made)
    assert got.samples == samples and got.rate == media.RATE
    assert got.times[-1][2] == len(samples) / media.RATE
    assert sorted(t[1] for t in got.times) == [t[1] for t in got.times]


def test_ogg_checks():
    made = media.write_ogg(bytes(range(192)) * 40)

    def crc(data):
        c = 0
        for x in data:
            c ^= x << 24
            for _ in range(8):
                c = (c << 1 ^ 0x04C11DB7 if c >> 31 else c << 1) & 0xFFFFFFFF
        return c

    assert media.ogg_crc(made[:300]) == crc(made[:300])
    for at in (5, 30, 200, len(made) - 1):
        broken = bytearray(made)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            media.read_ogg(bytes(broken))
    with pytest.raises(ValueError):
        media.read_ogg(made[:-10])


def test_packing_keeps_limits_and_ids():
    rng = np.random.default_rng(2)
    lim = packing.Limits(64, 6, 40)
    p = packing.Packer(lim, pool=50)
    docs = {i: rng.integers(0, 999, rng.integers(1, 200)).astype(np.uint32) for i in range(300)}
    for i, ids in docs.items():
        p.add(i, ids, int(rng.integers(0, len(ids) + 1)))
    p.pack(True)
    rows = p.out
    for i, ids in docs.items():
        mine = sorted((r for r in rows if r[0] == i), key=lambda r: r[1])
        assert np.concatenate([r[3] for r in mine]).tolist() == ids.tolist()
    sequences: list = []
    for r in rows:
        if r[5] == 0:
            sequences.append([])
        sequences[-1].append(r)
    for seq in sequences:
        assert [r[5] for r in seq] == list(range(len(seq)))
        assert sum(r[2] for r in seq) <= 64 and len(seq) <= 6 and sum(r[7] for r in seq) <= 40
        assert [r[6] for r in seq] == np.cumsum([0, *(r[2] for r in seq)])[:-1].tolist()


def test_dot_product_bins_fit():
    rng = np.random.default_rng(0)
    demand = np.stack([rng.integers(1, 100, 200), np.ones(200), rng.integers(0, 50, 200)], 1).astype(float)
    caps = np.array([100.0, 8, 60])
    bins = packing.dot_product_bins(demand, caps)
    assert sorted(i for b in bins for i in b) == list(range(200))
    assert all((demand[b].sum(0) <= caps).all() for b in bins)


def test_store_parts():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 60_000, 20_000).astype(np.uint32)
    flat = np.concatenate([text, text[100:], text[:5]])
    offs = np.array([0, 20_000, 39_900, 39_905])
    ends = store.cuts(flat, offs)
    assert set(offs[1:]) <= set(ends.tolist()) and np.diff(np.concatenate([[0], ends])).max() <= store.MOST
    chunks = [store.pack_ids(flat[i:j]) for i, j in zip(np.concatenate([[0], ends[:-1]]), ends)]
    assert len(set(chunks)) < 0.6 * len(chunks)
    assert np.concatenate([store.unpack_ids(c) for c in chunks]).tolist() == flat.tolist()
    assert store.unpack_ids(store.pack_ids(np.array([70_000], np.uint32))).tolist() == [70_000]
    tree = store.Merkle()
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(11)]
    for x in leaves:
        tree.add(x)
    other = store.Merkle()
    for x in leaves[::-1]:
        other.add(x)
    assert tree.root() != other.root() and len(tree.nodes) == 4 and zlib.crc32(tree.root())


def test_bit_predictors_sum_to_one():
    """Both bits of an event have probabilities that add up to one, whatever the counts, weights and refining table."""
    rng = np.random.default_rng(0)
    n = mixture.SEGMENT
    t = mixture.Table((16,), [(0, mixture._pack(rng.integers(0, 65536, n).astype(np.uint16), rng.integers(0, 60, n).astype(np.uint8)))])
    mixer = mixture.Mixer(3, 2)
    for _ in range(5):
        mixer.learn([rng.normal(0.5, 1, 1000).astype(np.float32) for _ in range(2)], rng.integers(0, 3, 1000))
    mixer = mixture.Mixer(3, 2, mixer.sums())
    slots, gate = rng.integers(0, n, 5000), rng.integers(0, 3, 5000)
    both = [[t.agree(slots[::k], np.full(5000, 2 * bit)) for k in (1, -1)] for bit in (0, 1)]
    assert 10 ** mixer.log10(both[0], gate) + 10 ** mixer.log10(both[1], gate) == pytest.approx(1, abs=1e-3)


def test_what_follows_two_words_is_counted_exactly():
    rng = np.random.default_rng(5)
    top = mixture.CLASS + mixture.INDEX
    pairs = sorted({(int(c), int(k) << (top - 9)) for c, k in zip(rng.integers(0, 40, 500), rng.integers(0, 512, 500))})
    context, code, count = (np.array(x) for x in zip(*[(c, k, int(rng.integers(0, 5))) for c, k in pairs]))
    flat, lens = mixture.followed(context, code, count)
    at = 0
    for c, k, m in zip(context, code, lens):
        mine = mixture.COUNTS[flat[at : at + m]].tolist()
        at += m
        want = [count[(context == c) & (code >> (top - j) == k >> (top - j))].sum() for j in range(top + 1)]
        full = [*mine, *[mine[-1]] * (top + 1 - m)]
        assert [int(x) for x in mixture.COUNTS[mixture.quantised(np.array(want))]] == [int(x) for x in full]
    assert at == len(flat)


def test_packed_arrays_come_back():
    a, b = np.arange(-5, 300, dtype=np.int64), np.array([1.5, -2], np.float32)
    got = mixture._unpack(mixture._pack(a, b), (np.int64, len(a)), (np.float32, None))
    assert got[0].tolist() == a.tolist() and got[1].tolist() == b.tolist()
    assert mixture._unpack(mixture._pack(a[:0]), (np.int64, None))[0].size == 0


def test_pairs_are_sorted_by_context_and_code():
    rng = np.random.default_rng(6)
    context, code = rng.integers(0, 300, 1000).astype(np.uint64), rng.integers(0, 5, 1000)
    order, want = mixture.sorted_pairs(context, code), np.lexsort((code, context))
    assert sorted(order) == list(range(1000))
    assert context[order].tolist() == context[want].tolist() and code[order].tolist() == code[want].tolist()
    assert mixture.sorted_pairs(context[:0], code[:0]).size == 0


def test_frequent_words_have_classes_of_their_own():
    c = np.array([0, 1, 2, 3, 99, 100, 101, 150, 1 << 33])
    k = mixture.classes(c, 100.0)
    assert k[:2].tolist() == [mixture.OTHER] * 2 and k.max() <= mixture.LISTED
    assert not set(k[c >= 100]) & set(k[c < 100])
    codes = mixture.Codes(np.bincount(k, minlength=64), [("a", int(k[8])), ("b", int(k[5])), ("c", int(k[6])), ("d", int(k[7]))], 4)
    assert codes.bits[k[8]] == 0 and codes.at["b"] == 0 and codes.at["c"] == 1 and codes.bits[k[5]] <= 2
