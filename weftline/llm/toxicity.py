"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as its embedding (words of three labelled documents or more have
one, others share none) beside the mean of its hashed character n-gram
embeddings. Windows of 64 words, 32 apart, run through a
gated recurrent unit in both directions; attention pools the states of a
window to one probability, and a text scores as its most toxic window. Windows
start at every 32nd word of the whole text, and one ends with it, so any run of
33 words or fewer lies whole in a window.

Training is in numpy, from labels of documents only: each epoch takes the
windows that the network finds most toxic in each document (and random ones of
clean documents), which tells it apart what makes a document toxic. Embeddings
start from the log odds of words and n-grams in the labelled documents. It
fits on a bounded sample: ``TRAIN_TOXIC`` and ``TRAIN_CLEAN`` labelled rows of
at most ``TRAIN_CHARS`` characters, chosen by a hash of their id, in one task on
an executor; the driver gets the network alone.

Scoring is one pass with no shuffle. What a word adds to the gates is computed
once per distinct word and kept in a bounded table per worker, so a step costs
one gather and one small matrix product for thousands of windows.
"""

from __future__ import annotations

import pickle
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import utf8, words_of, worker_cache

SPAN, STRIDE = 64, 32
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS = 2000, 4000, 20_000
GRAMS = (3, 5)
WORDS, CHAR_ROWS, WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 60_000, 1 << 17, 6, 8, 10, 8
EPOCHS, BATCH, RATE, TABLE_RATE, DROP = 5, 256, 0.01, 0.05, 0.1
MIN_DOCS, MIN_WORDS, CALIBRATE = 3, 4, 100


def char_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the n-grams of "^word$", word after word, and how many each word has."""
    marked = [b"^" + w + b"$" for w in words]
    flat = np.frombuffer(b"".join(marked), dtype=np.uint8).astype(np.uint64)
    size = np.array([len(m) for m in marked])
    left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))  # bytes to the end of the word
    word = np.repeat(np.arange(len(words)), size)
    code, rows, of = flat, [], []
    for n in range(2, max(GRAMS) + 1):
        code = code[:-1] * np.uint64(257) + flat[n - 1 :]
        if n in GRAMS:
            at = np.flatnonzero(left[: len(code)] >= n)
            mixed = (code[at] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            rows.append(((mixed >> np.uint64(32)) % np.uint64(CHAR_ROWS)).astype(np.int32))
            of.append(word[at])
    rows, of = np.concatenate(rows), np.concatenate(of)
    return rows[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))


#: Words whose n-grams are looked up at a time, which bounds the memory for it.
PART = 20_000


def all_char_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [char_rows(words[i : i + PART]) for i in range(0, len(words), PART)]
    return np.concatenate([r for r, _ in parts]), np.concatenate([n for _, n in parts])


def mean_of(table: np.ndarray, rows: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Means of table rows over runs of ``count`` rows each."""
    return np.add.reduceat(table[rows], np.cumsum(count) - count, axis=0) / count[:, None]


def summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and the sums of their values."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    return rows[first], np.add.reduceat(values[order], first, axis=0)


def starts_of(n: int) -> range | list[int]:
    """First words of the windows over n words; the last window ends with the text."""
    if n <= SPAN:
        return [0]
    return [*range(0, n - SPAN, STRIDE), n - SPAN]


class Network:
    """Parameters, the forward pass over gathered gate inputs, and its gradient."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        d = WORD_DIM + CHAR_DIM
        self.words: dict[bytes, int] = {}  # row 0 is for all others
        self.p = {"words": np.zeros((1, WORD_DIM), np.float32), "chars": np.zeros((CHAR_ROWS, CHAR_DIM), np.float32)}
        for way in "fb":
            self.p |= {
                f"{way}w": normal(d, 3 * HIDDEN, scale=d**-0.5), f"{way}u": normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
                f"{way}b": np.zeros(3 * HIDDEN, np.float32),
            }
        self.p |= {
            "aw": normal(2 * HIDDEN, ATTEND, scale=0.3), "ab": np.zeros(ATTEND, np.float32), "av": normal(ATTEND, scale=0.5),
            "ow": normal(2 * HIDDEN, scale=0.3), "ob": np.zeros(1, np.float32),
        }

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """Input vectors of distinct words."""
        return self.vectors(self.word_rows(words), *char_rows(words))

    def word_rows(self, words: list[bytes]) -> np.ndarray:
        return np.array([self.words.get(w, 0) for w in words], dtype=np.int64)

    def vectors(self, words: np.ndarray, chars: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.concatenate([self.p["words"][words], mean_of(self.p["chars"], chars, count)], axis=1).astype(np.float32)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What words add to the gates of both directions."""
        return np.concatenate([x @ self.p["fw"] + self.p["fb"], x @ self.p["bw"] + self.p["bb"]], axis=1)

    def run(self, gates: np.ndarray, at: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """Logits of windows; ``at`` holds rows of ``gates`` by step and window."""
        steps, n = at.shape
        h_all = np.empty((steps, n, 2 * HIDDEN), np.float32)
        both = np.empty((n, 6 * HIDDEN), np.float32)
        for way, order, cols in (("f", range(steps), 0), ("b", range(steps - 1, -1, -1), 3 * HIDDEN)):
            u, h = self.p[f"{way}u"], np.zeros((n, HIDDEN), np.float32)
            for t in order:
                x = np.take(gates, at[t], axis=0, out=both, mode="clip")[:, cols : cols + 3 * HIDDEN]
                hu = h @ u
                zr = x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN]
                zr *= 0.5
                np.tanh(zr, out=zr)
                zr += 1
                zr *= 0.5
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
                new = c + z * (h - c)
                if mask is not None:
                    new *= mask[t][:, None]
                if keep is not None:
                    keep.append((way, t, h, hu, z, r, c))
                h = h_all[t, :, :HIDDEN] if way == "f" else h_all[t, :, HIDDEN:]
                h[:] = new
                h = new
        a = np.tanh(h_all.reshape(-1, 2 * HIDDEN) @ self.p["aw"] + self.p["ab"]).reshape(steps, n, ATTEND)
        e = a @ self.p["av"]
        if mask is not None:
            e = np.where(mask > 0, e, np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", e, h_all)
        if keep is not None:
            keep.append((h_all, a, e, pooled))
        return pooled @ self.p["ow"] + self.p["ob"][0]

    def step(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean log loss for the parameters and the input vectors."""
        keep: list = []
        gates = self.gates(x)
        logit = self.run(gates, at, mask, keep)
        h_all, a, e, pooled = keep.pop()
        steps, n = at.shape
        d_logit = ((1 / (1 + np.exp(-logit)) - label) / n).astype(np.float32)
        g = {"ow": pooled.T @ d_logit, "ob": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * self.p["ow"]
        d_h = e[:, :, None] * d_pooled
        d_e = np.einsum("nh,tnh->tn", d_pooled, h_all)
        d_e = e * (d_e - (e * d_e).sum(axis=0))
        g["av"] = np.einsum("tn,tnk->k", d_e, a)
        d_a = (d_e[:, :, None] * self.p["av"] * (1 - a * a)).reshape(-1, ATTEND)
        g["aw"], g["ab"] = h_all.reshape(-1, 2 * HIDDEN).T @ d_a, d_a.sum(axis=0)
        d_h = d_h + (d_a @ self.p["aw"].T).reshape(steps, n, 2 * HIDDEN)
        d_gates, d_steps = np.zeros_like(gates), np.empty((steps, n, 3 * HIDDEN), np.float32)
        for way, cols, mine in (("b", 3 * HIDDEN, slice(HIDDEN, None)), ("f", 0, slice(0, HIDDEN))):
            u, back = self.p[f"{way}u"], np.zeros((n, HIDDEN), np.float32)
            g[f"{way}u"] = np.zeros_like(u)
            while keep and keep[-1][0] == way:
                _, t, h, hu, z, r, c = keep.pop()
                d_new = (d_h[t][:, mine] + back) * mask[t][:, None]
                d_c = d_new * (1 - z) * (1 - c * c)
                d_z = d_new * (h - c) * z * (1 - z)
                d_r = d_c * hu[:, 2 * HIDDEN :] * r * (1 - r)
                d_x = np.concatenate([d_z, d_r, d_c], axis=1)
                d_hu = np.concatenate([d_z, d_r, d_c * r], axis=1)
                g[f"{way}u"] += h.T @ d_hu
                back = d_hu @ u.T + d_new * z
                d_steps[t] = d_x
            hit, total = summed(at.ravel(), d_steps.reshape(-1, 3 * HIDDEN))
            d_gates[hit, cols : cols + 3 * HIDDEN] = total
        for way, cols in (("f", 0), ("b", 3 * HIDDEN)):
            d = d_gates[:, cols : cols + 3 * HIDDEN]
            g[f"{way}w"], g[f"{way}b"] = x.T @ d, d.sum(axis=0)
        d_x = d_gates[:, : 3 * HIDDEN] @ self.p["fw"].T + d_gates[:, 3 * HIDDEN :] @ self.p["bw"].T
        return g, d_x


def _windows(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of texts given as rows from 1 on, padded with 0, and the text of each."""
    at, of = [], []
    for i, r in enumerate(rows):
        if len(r):
            first = np.array(starts_of(len(r)))
            at.append(np.pad(r, (0, max(0, SPAN - len(r))))[first[:, None] + np.arange(SPAN)])
            of.append(np.full(len(first), i))
    if not at:
        return np.zeros((0, SPAN), np.int32), np.zeros(0, np.int64)
    return np.concatenate(at), np.concatenate(of)


def _logits(net: Network, gates: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty(len(at), np.float32)
    short = at[:, -1] == 0
    for rows, padded in ((np.flatnonzero(~short), False), (np.flatnonzero(short), True)):
        for i in range(0, len(rows), 2048):
            part = np.ascontiguousarray(at[rows[i : i + 2048]].T)
            out[rows[i : i + 2048]] = net.run(gates, part, (part > 0).astype(np.float32) if padded else None)
    return out


def train(texts: list[bytes], labels: list[int], seed: int = 7, epochs: int = EPOCHS) -> Network:
    """Fit the network on whole texts that are toxic (1) or not (0).

    With ``CALIBRATE`` texts of each label or more, a seventh is kept back to
    set the bias so that a probability of 0.5 parts them with fewest errors.
    """
    pick = lambda last: [i for i in range(len(texts)) if (i % 7 == 6) == last]
    if min(sum(labels), len(labels) - sum(labels)) < CALIBRATE:
        return _fit(texts, labels, seed, epochs)
    net = _fit([texts[i] for i in pick(False)], [labels[i] for i in pick(False)], seed, epochs)
    kept = pick(True)
    p = np.clip(Scorer(net).score([texts[i] for i in kept]), 1e-12, 1 - 1e-12)
    logit, y = np.log(p / (1 - p)), np.array([labels[i] for i in kept])
    order = np.argsort(logit)
    logit, y = logit[order], y[order]
    cuts = (logit[1:] + logit[:-1]) / 2
    errors = np.cumsum(y)[:-1] + (y == 0).sum() - np.cumsum(y == 0)[:-1]
    best = cuts[errors == errors.min()]
    net.p["ob"] -= np.float32((best[0] + best[-1]) / 2)
    return net


def _fit(texts: list[bytes], labels: list[int], seed: int, epochs: int) -> Network:
    rng = np.random.default_rng(seed)
    net = Network(seed)
    y = np.array(labels, dtype=np.float32)
    split = [words_of(t) for t in texts]
    vocab = {w: i + 1 for i, w in enumerate(sorted({w for s in split for w in s}))}
    rows = [np.fromiter((vocab[w] for w in s), np.int32, len(s)) for s in split]
    del split
    at, of = _windows(rows)
    if not len(at) or y.min() == y.max():  # nothing to learn from: every text gets the only label
        net.p["ow"][:] = 0
        net.p["ob"][:] = 4.0 if len(y) and y.min() == 1 else -4.0
        return net
    words = list(vocab)
    cr, count = all_char_rows(words)
    begin = np.cumsum(count) - count
    live = _log_odds(net, rows, y, words, cr, count, rng)
    wr = net.word_rows(words)
    dense = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items() if k not in ("words", "chars")}
    tables = {k: np.full(len(net.p[k]), 1e-3, np.float32) for k in ("words", "chars")}
    t = 0
    for epoch in range(epochs):
        gates = np.zeros((len(words) + 1, 6 * HIDDEN), np.float32)
        odds = np.zeros(len(words) + 1, np.float32)
        for i in range(0, len(words), PART):
            j = min(i + PART, len(words))
            x = net.vectors(wr[i:j], cr[begin[i] : begin[j - 1] + count[j - 1]], count[i:j])
            gates[i + 1 : j + 1] = net.gates(x)
            odds[i + 1 : j + 1] = x[:, 0] + x[:, WORD_DIM]
        if epoch:
            found = _logits(net, gates, at)
        else:  # first by the odds alone
            found = np.concatenate([np.sort(odds[at[i : i + 4096]], axis=1)[:, -3:].sum(axis=1) for i in range(0, len(at), 4096)])
        del gates
        order = np.lexsort((-found, of))
        top = order[np.append(True, of[order][1:] != of[order][:-1])]
        wrong = np.flatnonzero((y[of] == 0) & (found > -1)) if epoch else top[:0]
        more = rng.choice(len(at), size=min(len(at), 2 * len(texts)), replace=False)
        use = np.unique(np.concatenate([top, wrong, more[y[of[more]] == 0]]))
        rng.shuffle(use)
        for i in range(0, len(use), BATCH):
            part = at[use[i : i + BATCH]]
            seen, inverse = np.unique(part, return_inverse=True)
            inverse = inverse.reshape(part.shape).T
            ids = seen[seen > 0] - 1
            n = count[ids]
            chars = cr[np.repeat(begin[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            words_now = np.where(rng.random(len(ids)) < DROP, 0, wr[ids])
            xb = net.vectors(words_now, chars, n)
            pad = int(seen[0] == 0)
            if pad:
                xb = np.vstack([np.zeros((1, xb.shape[1]), np.float32), xb])
            g, d_x = net.step(xb, inverse, (part.T > 0).astype(np.float32), y[of[use[i : i + BATCH]]])
            d_x = d_x[pad:]
            t += 1
            for k, (m, v) in dense.items():
                m += 0.1 * (g[k] - m)
                v += 0.01 * (g[k] ** 2 - v)
                net.p[k] -= (RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
            for k, rows_, d in (
                ("words", words_now, d_x[:, :WORD_DIM]),
                ("chars", chars, np.repeat(d_x[:, WORD_DIM:] / n[:, None], n, axis=0)),
            ):
                hit, total = summed(rows_, d)
                total = total * live[k][hit][:, None]
                tables[k][hit] += (total**2).mean(axis=1)
                net.p[k][hit] -= TABLE_RATE * total / np.sqrt(tables[k][hit])[:, None]
    return net


def _log_odds(net: Network, rows: list, y: np.ndarray, words: list[bytes], cr: np.ndarray, count: np.ndarray, rng) -> dict:
    """Give frequent words and n-grams embeddings that start at their log odds in toxic texts.

    Returns which rows of the tables may learn; the others stay zero, so that
    what is rare cannot stand for the texts that it is in.
    """
    df = np.zeros((2, len(words)))
    for r, label in zip(rows, y, strict=True):
        df[int(label)][np.unique(r) - 1] += 1
    ratio = (y.sum() + 1) / ((1 - y).sum() + 1)
    often = np.flatnonzero(df.sum(axis=0) >= MIN_DOCS)
    often = np.sort(often[np.argsort(-df.sum(axis=0)[often], kind="stable")][:WORDS])
    net.words = {words[j]: i + 1 for i, j in enumerate(often)}
    net.p["words"] = rng.normal(0, 0.05, (len(often) + 1, WORD_DIM)).astype(np.float32)
    live = {"words": np.arange(len(often) + 1) > 0, "chars": np.bincount(cr, minlength=CHAR_ROWS) >= MIN_WORDS}
    net.p["chars"][:] = rng.normal(0, 0.05, net.p["chars"].shape)
    for table, counts in (
        ("words", [np.append(0, d[often]) for d in df]),
        ("chars", [np.bincount(cr, np.repeat(d, count), minlength=CHAR_ROWS) for d in df]),
    ):
        odds = np.log((counts[1] + 3 * ratio) / (counts[0] + 3)) - np.log(ratio)
        net.p[table][:, 0] = np.clip(odds, -3, 3)
        net.p[table] *= live[table][:, None]
    return live


class Scorer:
    """Scores texts, with a bounded table of what known words add to the gates."""

    def __init__(self, net: Network, most: int = 250_000):
        self.net, self.most = net, most
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.gates = np.zeros((4096, 6 * HIDDEN), np.float32)

    def learn(self, words: set[bytes]) -> None:
        words = sorted(words)
        first = len(self.known) + 1
        while first + len(words) > len(self.gates):
            self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)])
        for i in range(0, len(words), PART):
            part = words[i : i + PART]
            self.gates[first + i : first + i + len(part)] = self.net.gates(self.net.inputs(part))
        self.known.update(zip(words, range(first, first + len(words)), strict=True))

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        """Probability of the most toxic window; 0 for a text without words."""
        out = np.zeros(len(texts))
        held, of, size = [], [], 0
        for i, text in enumerate(texts):
            words = words_of(text)
            if not words:
                continue
            for k in range(0, len(words), 1 << 16):  # long texts in parts that share their window overlap
                part = words[max(0, k - SPAN) : k + (1 << 16)]
                rows = list(map(self.known.get, part))
                if None in rows:
                    new = {w for w, row in zip(part, rows, strict=True) if row is None}
                    if len(self.known) + len(new) > self.most:
                        self.flush(held, of, out)
                        held, of, size = [], [], 0
                        self.forget()
                        new = set(part)
                    self.learn(new)
                    rows = list(map(self.known.__getitem__, part))
                held.append(np.array(rows, dtype=np.int32))
                of.append(i)
                size += len(rows)
                if size >= 1 << 17:
                    self.flush(held, of, out)
                    held, of, size = [], [], 0
        self.flush(held, of, out)
        return out

    def flush(self, held: list, of: list, out: np.ndarray) -> None:
        if held:
            at, which = _windows(held)
            p = 1 / (1 + np.exp(-_logits(self.net, self.gates, at).astype(np.float64)))
            np.maximum.at(out, np.array(of)[which], p)


def held_out(doc_id: Column) -> Column:
    """Kept from training: crc32 of the id as text is divisible by 5; a null id is not."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """Train on a bounded sample of the labelled rows that are not held out.

    Rows with a null id, label or text do not take part; of ids labelled more
    than once the larger label counts. Without both labels the network is constant.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    rows = rows.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = rows.where("toxic = 1").orderBy(*by_hash).limit(TRAIN_TOXIC).unionByName(
        rows.where("toxic = 0").orderBy(*by_hash).limit(TRAIN_CLEAN)
    )
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    text = text.where(F.col("text").isNotNull() & (F.length("text") <= TRAIN_CHARS))
    # at most TRAIN_TOXIC + TRAIN_CLEAN ids: a bounded broadcast
    got = text.join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id", "text")).limit(TRAIN_TOXIC + TRAIN_CLEAN)
    return _trained(got.select("doc_id", "text", "toxic"))


#: Bytes of a row of the network on its way to the driver.
ROW_BYTES = 1 << 20


def _trained(sample: DataFrame) -> Network:
    """Train in one task on the bounded sample (doc_id, text, toxic); only the network, some megabytes, comes to the driver."""
    import pyarrow as pa

    def run(batches):
        rows = [(d, t, y) for b in batches for d, t, y in zip(b.column("doc_id").to_pylist(), utf8(b.column("text")), b.column("toxic").to_pylist(), strict=True)]
        rows.sort(key=lambda r: r[:2])
        net = train([t for _, t, _ in rows], [y for _, _, y in rows])
        told = pickle.dumps((net.words, net.p))
        parts = [told[i : i + ROW_BYTES] for i in range(0, len(told), ROW_BYTES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["place", "part"])

    parts = sample.coalesce(1).mapInArrow(run, "place int, part binary").collect()
    if not parts:  # Spark runs no task over a table that it knows to be empty
        return train([], [])
    net = Network.__new__(Network)
    net.words, net.p = pickle.loads(b"".join(bytes(r.part) for r in sorted(parts, key=lambda r: r.place)))
    return net


def _scorer(name: str, shared) -> Scorer:
    cache = worker_cache().setdefault("toxicity", {})
    if name not in cache:
        cache.clear()
        net = Network.__new__(Network)
        net.words, net.p = shared.value
        cache[name] = Scorer(net)
    return cache[name]


def score_toxicity(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score of each row: the probability of its most toxic window.

    Whole texts of any length are scored; null texts and texts without words
    score 0. Repeated rows and null ids are scored like others; an empty table
    has no scores. Other columns are ignored.
    """
    import pyarrow as pa

    name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((net.words, net.p))

    def run(batches):
        scorer = _scorer(name, shared)
        for batch in batches:
            score = scorer.score(utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    rows = docs.selectExpr("cast(doc_id as bigint) AS doc_id", "text")
    return rows.mapInArrow(run, "doc_id bigint, score double")


def drop_toxic(docs: DataFrame, net: Network, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns as they were."""
    import pyarrow as pa

    name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((net.words, net.p))

    def run(batches):
        scorer = _scorer(name, shared)
        for batch in batches:
            yield batch.filter(pa.array(scorer.score(utf8(batch.column("text"))) < threshold))

    return docs.mapInArrow(run, docs.schema)
