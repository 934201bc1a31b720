"""Wu-Manber, BagMinHash, packing, toxicity and resampling in plain Python against brute force."""

import random
import re

import numpy as np
import pytest

pytest.importorskip("weftline.llm")
from weftline.llm import bagminhash, decontaminate, itq, packing, resample, toxicity  # noqa: E402
from weftline.llm.words import words_of  # noqa: E402


def test_words_follow_the_pattern():
    rng = random.Random(1)
    letters = list("abzABZ09 \n\t.,!\x00\x7f[`{@/:é中ÀßİK\U0001f600\x85\xa0")
    for _ in range(500):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        want = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        assert [w.decode() for w in words_of(t.encode())] == want
    assert words_of(None) == words_of(b"") == []


def test_wu_manber_finds_all_occurrences():
    rng = random.Random(2)
    vocab = [b"a", b"b", b"c"]
    for _ in range(300):
        items = [(str(i), b" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 9)))) for i in range(rng.randint(0, 6))]
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
        window = rng.randint(1, 6)
        got = {(f, m, i) for f, m, ids in decontaminate.WuManber(items, window, rng.randint(1, 4)).search(words) for i in ids}
        want = set()
        for i, text in items:
            w = text.split()
            m = min(window, len(w))
            for k in range(len(w) - m + 1) if m else ():
                want |= {(f, m, i) for f in range(len(words) - m + 1) if words[f : f + m] == w[k : k + m]}
        assert got == want


def test_bagminhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(3)
    keys = rng.integers(1, 2**63, 300).astype(np.uint64)
    for low, high in ((1, 2), (1, 9), (1, 300)):
        a, b = rng.integers(low, high, 300), rng.integers(low, high, 300)
        b[:220] = a[:220]
        x, y = (keys, a), (keys[40:], b[40:])
        true = bagminhash.overlap(tuple(np.array(v) for v in sorted_bag(x)), tuple(np.array(v) for v in sorted_bag(y)))
        s = bagminhash.signatures([x, y], 4096)
        assert abs((s[0] == s[1]).mean() - true) < 0.04
    assert (bagminhash.signatures([x, x], 64)[0] == bagminhash.signatures([x], 64)[0]).all()


def sorted_bag(bag):
    order = np.argsort(bag[0])
    return bag[0][order], np.asarray(bag[1])[order]


def test_overlap_counts_repeats():
    bag = lambda t: np.unique(bagminhash.shingles(t), return_counts=True)
    assert bagminhash.overlap(bag(b"a b c d e f"), bag(b"A, b c d e f!")) == 1.0
    assert bagminhash.overlap(bag(b"x " * 14), bag(b"x " * 9)) == 0.5
    assert len(bagminhash.shingles(b"one two")) == 1 and len(bagminhash.shingles(b"...")) == 0


TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    t, w = Tokenizer.from_file(TOKENIZER), packing.WordIds(TOKENIZER, most=300)
    rng = random.Random(4)
    parts = list("abcABC'st 0129.,!?  \n\t\r\x0b\x0c\x1f\x85\xa0éÉß́Σς中\U0001f600&<>|-ſKİ") + ["'ll ", "<|endoftext|>", "<|ENDOFTEXT|>", "don't", "Word. ", "été, "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    got = w.of([x.encode() for x in texts], 1)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids + [1]
    assert np.frombuffer(w.of([None], 1)[0], "<u4").tolist() == [1]


def test_packer_places_each_id_once_and_fills_windows():
    rng = np.random.default_rng(5)
    docs = [(i, rng.integers(0, 50, n).astype("<u4")) for i, n in enumerate([1, 1, 5, 700, 3, 40, 40, 64, 64, 1, 9])]
    p = packing.Packer(64, 10)
    p.shard(docs)
    p.shard([(99, np.arange(5, dtype="<u4"))])
    used: dict = {}
    for doc, start, length, ids, total, seq, offset in p.rows:
        source = docs[doc][1] if doc < 99 else np.arange(5, dtype="<u4")
        assert ids == source[start : start + length].tobytes() and total == len(source)
        used.setdefault(seq, []).append((offset, length))
    for seq in used:
        spans = sorted(used[seq])
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert sum(n for _, n in spans) == 64 or seq == max(used)
    assert sum(r[2] for r in p.rows) == sum(len(x) for _, x in docs) + 5


def test_packer_puts_like_documents_together():
    docs = [(i, np.array([i % 3 * 100 + j for j in range(10)], dtype="<u4")) for i in range(30)]
    p = packing.Packer(40, 0)
    p.shard(docs)
    by: dict = {}
    for r in p.rows:
        by.setdefault(r[5], set()).add(r[0] % 3)
    assert sum(len(v) == 1 for v in by.values()) >= len(by) - 2


def test_bm25_scores():
    ids = [np.array(x, dtype="<u4") for x in ([1, 2, 2, 9], [2, 3, 3, 3], [4, 5, 6, 7], [1, 8, 8, 2])]
    index = packing.Index(ids)
    got = index.scores(0)
    n = len(ids)
    want = np.zeros(n)
    for term in (1, 2):  # all terms of the seed count, but 9 is in no other document
        df = sum(term in x for x in ids)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        for d, x in enumerate(ids):
            tf = (x == term).sum()
            want[d] += idf * tf * (packing.K1 + 1) / (tf + packing.K1) if tf else 0
    assert np.allclose(got, want)


def test_network_gradients_are_right():
    rng = np.random.default_rng(6)
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.normal(size=(7, toxicity.WORD_DIM + toxicity.CHAR_DIM))
    x[0] = 0
    at, y = rng.integers(1, 7, (5, 3)), np.array([1.0, 0.0, 1.0])
    at[3:, 1] = 0
    mask = (at > 0).astype(np.float64)
    toxic = lambda: float(np.mean(np.log1p(np.exp(-(2 * y - 1) * net.run(net.gates(x), at, mask)))))
    g, d_x = net.step(x, at, mask, y)
    for k in ("fw", "bu", "fb", "aw", "av", "ow", "ob"):
        flat = net.p[k].reshape(-1)
        for i in rng.integers(0, flat.size, 4):
            old, e = flat[i], 1e-3
            flat[i] = old + e
            up = toxic()
            flat[i] = old - e
            down = toxic()
            flat[i] = old
            assert abs((up - down) / (2 * e) - g[k].reshape(-1)[i]) < 2e-3, k
    i = (3, 2)
    old = x[i]
    x[i] = old + 1e-3
    up = toxic()
    x[i] = old - 1e-3
    down = toxic()
    x[i] = old
    assert abs((up - down) / 2e-3 - d_x[i]) < 2e-3


def test_toxicity_learns_words_roots_and_places():
    rng = random.Random(7)
    plain = ["".join(rng.choice("abcdeiou") for _ in range(rng.randint(2, 6))) for _ in range(200)]

    def text(n, bad):
        words = [rng.choice(plain) for _ in range(n)]
        for _ in range(bad):
            words[rng.randrange(n)] = rng.choice(["stupid", "zzgrub" + rng.choice(plain)])
        return " ".join(words).encode()

    make = lambda k: [(text(n, b), int(b > 0)) for n in (20, 90, 300) for b in (0, 4) for _ in range(k)]
    rows, held = make(90), make(25)
    net = toxicity.train([t for t, _ in rows], [y for _, y in rows], epochs=6)
    p = toxicity.Scorer(net).score([t for t, _ in held])
    assert np.mean((p >= 0.5) == np.array([y for _, y in held])) > 0.95
    small = toxicity.Scorer(net, most=50)  # forgets words all the time
    assert np.allclose(small.score([t for t, _ in held[:20]]), p[:20], atol=1e-5)
    assert toxicity.Scorer(net).score([None, b"", b"..."]).tolist() == [0, 0, 0]


def test_windows_cover_every_word():
    for n in (1, 63, 64, 65, 112, 113, 1000):
        s = list(toxicity.starts_of(n))
        covered = {i for a in s for i in range(a, min(n, a + toxicity.SPAN))}
        assert covered == set(range(n)) and all(b - a <= toxicity.STRIDE for a, b in zip(s, s[1:]))


def test_long_texts_score_as_their_windows():
    net = toxicity.train([b"bad bad bad", b"good fine", b"bad", b"fine"] * 3, [1, 0, 1, 0] * 3, epochs=2)
    scorer = toxicity.Scorer(net)
    words = [b"w%d" % (i % 977) for i in range(70_000)]
    whole = scorer.score([b" ".join(words)])[0]
    parts = max(scorer.score([b" ".join(words[a : a + toxicity.SPAN]) for a in range(0, 70_000 - toxicity.SPAN, 16)]))
    assert whole <= parts + 0.05


def test_kinds_of_junk_fall_in_other_buckets():
    assert len(resample.buckets_of(None)) == 0 and len(resample.buckets_of(b"one")) == 2
    ratio = resample.log_ratios(np.bincount(resample.buckets_of(b"a b. C d") , minlength=resample.BUCKETS), np.bincount(resample.buckets_of(b"A!! B!! a b. C d"), minlength=resample.BUCKETS))
    assert ratio[resample.buckets_of(b"X!! Y!!")].sum() < ratio[resample.buckets_of(b"a b.")].sum()


def test_itq_codes_are_balanced_and_near_for_near_vectors():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 64))
    centre, projection = itq.rotations(x / np.linalg.norm(x, axis=1, keepdims=True))
    codes = itq.encode(x, centre, projection)
    bits = np.unpackbits(codes.view(np.uint8).reshape(len(x), -1), axis=1)
    assert bits.shape[1] == 128 and abs(bits.mean(axis=0) - 0.5).max() < 0.1
    near = itq.encode(x + 0.1 * rng.normal(size=x.shape), centre, projection)
    gap = np.unpackbits((codes ^ near).view(np.uint8).reshape(len(x), -1), axis=1).sum(axis=1)
    assert gap.mean() < 12 and itq.rotations(x[:50, :5])[1].shape == (5, 128)
    assert itq.cosine(np.array([[1e200, 0.0]]), np.array([[1e-200, 0.0]]))[0] == 1.0
