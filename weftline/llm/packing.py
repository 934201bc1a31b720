"""Lexical retrieval packing into windows of tokens.

Documents are tokenised and packed where they lie, with no shuffle. The index
is sharded: each run of about ``shard_tokens`` tokens of an input partition is
a shard with a BM25 inverted index over token ids. The first document of a
window is its seed; while the window has room, the shard's unused document
that scores best against all the seed's terms follows, and where none
shares a term, the next unused one. A document that does not fit is cut, and
its rest seeds the next window. The open window passes from shard to shard, so
a partition has one padded window, its last.

Memory is bounded by a shard, or by one document where that is larger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .words import utf8, worker_cache

WINDOW = 2048
SHARD_TOKENS = 1 << 20
K1, B = 1.2, 0.75
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, `offset` bigint"
)
#: White space between words becomes a space, and A-Z become a-z.
_SPACES = bytes.maketrans(b"\n\t\r", b"   ")
_LOWER = bytes.maketrans(b"\n\t\rABCDEFGHIJKLMNOPQRSTUVWXYZ", b"   abcdefghijklmnopqrstuvwxyz")


class WordIds:
    """Ids of whole texts through ids of their words, which are remembered.

    Right for tokenizers that lower the case, drop white space, never join
    across it, take runs of letters apart from a full stop or comma that
    follows, and mark the last id of a run ("</w>").
    """

    def __init__(self, path: str, most: int = 1_200_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {b"": b""}
        self.runs = Tokenizer(self.tokenizer.model)  # the same model, for lower-case runs of letters
        self.runs.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocab = self.tokenizer.get_vocab()
        self.ends = bytearray(max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.marks = {m: self.ids([m])[0] for m in (b".", b",")}

    def ids(self, words: list[bytes]) -> list[bytes]:
        import numpy as np

        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def learn(self, words: set[bytes]) -> None:
        """Remember more words: runs of Latin letters together, others one by one."""
        import numpy as np

        if len(self.known) + len(words) > self.most:
            self.known = {b"": b""}
        known, marked, plain, others = self.known, [], {}, []
        for w in words:
            base = w[:-1] if w[-1:] in self.marks else w
            letters = base.decode()
            if letters.isalpha() and (letters.isascii() or max(letters) < "\u0250" and "\u0130" not in letters):
                if base is not w:
                    marked.append(w)
                if base not in known:
                    plain[base] = letters.lower()
            else:
                others.append(w)
        keys = list(plain)
        parts = [keys[i : i + 512] for i in range(0, len(keys), 512)]
        found = self.runs.encode_batch_fast([" ".join(map(plain.get, p)) for p in parts], add_special_tokens=False)
        for part, e in zip(parts, found, strict=True):
            raw, at = np.array(e.ids, dtype="<u4").tobytes(), 0
            ends = [4 * j + 4 for j, x in enumerate(e.ids) if self.ends[x]]
            for w, end in zip(part, ends, strict=True):
                known[w] = raw[at:end]
                at = end
        for i in range(0, len(others), 4096):
            part = others[i : i + 4096]
            known.update(zip(part, self.ids(part), strict=True))
        for w in marked:
            known[w] = known[w[:-1]] + self.marks[w[-1:]]

    def of(self, texts: list[bytes | None], end: int) -> list[bytes]:
        """Little-endian 32-bit ids of each text, then ``end``."""
        import struct

        last = struct.pack("<I", end)
        # a special token is found before letters are lowered
        split = [t.translate(_SPACES if b"<|" in t else _LOWER).split(b" ") if t else [] for t in texts]
        out = []
        for i in range(0, len(split), 128):
            part = split[i : i + 128]
            found = [list(map(self.known.get, s)) for s in part]
            gaps: dict[int, list[int]] = {}
            for j, ids in enumerate(found):
                try:
                    found[j] = b"".join(ids)
                except TypeError:  # a word is not known
                    gaps[j] = [k for k, x in enumerate(ids) if x is None]
            if gaps:
                self.learn({part[j][k] for j, at in gaps.items() for k in at})
                for j, at in gaps.items():
                    for k in at:
                        found[j][k] = self.known[part[j][k]]
                    found[j] = b"".join(found[j])
            out += [ids + last for ids in found]
        return out


class Index:
    """BM25 postings of one shard: by term for scoring, by document for queries."""

    def __init__(self, ids: list):
        import numpy as np

        n = self.n = len(ids)
        length = np.array([len(x) for x in ids], dtype=np.float64)
        key = np.concatenate(ids).astype(np.int64) * n + np.repeat(np.arange(n), [len(x) for x in ids])
        key, tf = np.unique(key, return_counts=True)
        term, doc = key // n, key % n
        new = np.concatenate([[True], term[1:] != term[:-1]])
        self.first = np.append(np.flatnonzero(new), len(term))
        of = np.cumsum(new) - 1
        df = np.diff(self.first)[of]
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length[doc] / length.mean())
        self.doc, self.weight = doc, idf * tf * (K1 + 1) / (tf + norm)
        use = np.flatnonzero(df > 1)  # terms of one document reach nobody
        use = use[np.argsort(doc[use], kind="stable")]
        self.query_term, self.query_at = of[use], np.searchsorted(doc[use], np.arange(n + 1))

    def scores(self, seed: int):
        import numpy as np

        terms = self.query_term[self.query_at[seed] : self.query_at[seed + 1]]
        if not len(terms):
            return np.zeros(self.n)
        first, many = self.first[terms], self.first[terms + 1] - self.first[terms]
        rows = np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)
        return np.bincount(self.doc[rows], self.weight[rows], minlength=self.n)


class Packer:
    """Fills windows; the open one lasts from shard to shard."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence, self.room = window, first_sequence, window
        self.rows: list[tuple] = []

    def put(self, doc_id, ids) -> bool:
        """Place a whole document; true if the window it ends in began with it."""
        at, seeds = 0, self.room == self.window
        while at < len(ids):
            take = min(self.room, len(ids) - at)
            self.rows.append((doc_id, at, take, ids[at : at + take].tobytes(), len(ids), self.sequence, self.window - self.room))
            at += take
            self.room -= take
            if not self.room:
                self.sequence, self.room, seeds = self.sequence + 1, self.window, at < len(ids)
        return seeds

    def shard(self, docs: list[tuple]) -> None:
        import numpy as np

        index = Index([ids for _, ids in docs]) if len(docs) > 1 else None
        unused, at, now, scores = np.ones(len(docs), dtype=bool), 0, 0, None
        for _ in range(len(docs)):
            unused[now] = False
            full = self.sequence
            seeds = self.put(*docs[now])
            if self.room == self.window:
                scores = None  # a new window: its seed is the next unused document
            elif seeds or scores is None or full != self.sequence:
                scores = index.scores(now) if index else None
            while at < len(docs) and not unused[at]:
                at += 1
            if at == len(docs):
                break
            now = at
            if scores is not None:
                best = int(np.argmax(np.where(unused, scores, -1.0)))
                now = best if scores[best] > 0 else at


def pack_documents(
    docs: DataFrame, tokenizer: str, end: int = 1, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """Cut documents into pieces that fill sequences of ``window`` tokens.

    One row per piece: doc_id, start (the document's ids before it), length,
    ids (little-endian unsigned 32-bit), doc_tokens, sequence_id and offset
    (gapless from 0 in a sequence). A document is the ids of its whole text and
    then ``end``; null and empty texts are ``end`` alone. Every row of ``docs``
    is packed once, repeated ones and those with a null id as well; an empty
    table gives no pieces. Other columns are ignored.
    """
    import pyarrow as pa

    names = [c.split()[0].strip("`") for c in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def table(rows):
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches):
        import numpy as np
        from pyspark import TaskContext

        cache = worker_cache()
        words = cache.get(("word_ids", tokenizer))
        if words is None:
            words = cache["word_ids", tokenizer] = WordIds(tokenizer)
        packer = Packer(window, TaskContext.get().partitionId() << 32)
        held, size = [], 0
        for batch in batches:
            ids_of_docs = batch.column("doc_id").to_pylist()
            texts = utf8(batch.column("text"))
            for i in range(0, len(texts), 512):
                found = words.of(texts[i : i + 512], end)
                for doc_id, ids in zip(ids_of_docs[i : i + 512], found, strict=True):
                    ids = np.frombuffer(ids, dtype="<u4")
                    held.append((doc_id, ids))
                    size += len(ids)
                    if size >= shard_tokens:
                        packer.shard(held)
                        yield table(packer.rows)
                        held, size, packer.rows = [], 0, []
        if held:
            packer.shard(held)
            yield table(packer.rows)

    return docs.selectExpr("cast(doc_id as bigint) AS doc_id", "text").mapInArrow(run, PIECES)
