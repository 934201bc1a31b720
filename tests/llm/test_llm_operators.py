"""The Spark operators against brute force, with nulls, repeats, empty tables and clashing columns."""

import random
import re
from collections import Counter
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("weftline.llm")
from weftline.llm import (  # noqa: E402
    bagminhash, chatformat, decontaminate, graph, hilbert, itq, linededup, packing, queries, resample, toxicity, urlrules,
)
from weftline.llm.words import words_of  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, `key` string, label int"


def own_words(text):
    """Words as the contract has them, apart from the operators' code."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def own_bag(text, size=5):
    w = own_words(text)
    return Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()


def own_overlap(a, b):
    least = sum((a & b).values())
    return least / (sum(a.values()) + sum(b.values()) - least) if a and b else 0.0


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", None, 1.0, "k", 3) for i, t in rows], DOCS)


def sample(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(8, 60))) for _ in range(n)]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((1000 + k, " ".join(words)))
    return rows + [(5000, None), (5001, ""), (5002, "..."), (None, base[0]), (7, base[7]), (6000, "one two"), (6001, "One, two!")]


# components


def test_components_match_union_find(spark):
    rng = random.Random(1)
    for n, m in ((40, 25), (200, 260), (2, 1)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n * 2, n * 2 + 30)]
        up: dict = {}

        def find(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in edges:
            a, b = sorted((find(a), find(b)))
            up[b] = a
        got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_buckets_lose_no_link_beside_the_leader(spark):
    """1 leads the bucket and is like nobody; 2, 3 and 4 form a chain; 5 stands alone."""
    buckets = spark.createDataFrame([(0, i) for i in (1, 2, 3, 4, 5)] + [(1, 4), (1, 9)], "bucket long, id long")
    like = {(2, 3), (3, 4), (4, 9)}
    seen = []

    def verify(pairs):
        rows = [tuple(r) for r in pairs.select("a", "b").collect()]
        seen.extend(rows)
        return pairs.sparkSession.createDataFrame([r for r in rows if r in like], "a long, b long")

    traits = lambda ids: ids.withColumn("oddness", F.col("id"))
    got = {r.id: r.component for r in graph.link_buckets(buckets, verify, lambda: F.lit(True), traits).collect()}
    assert got == {2: 2, 3: 2, 4: 2, 9: 2}
    assert len(seen) >= 8


# 1


def test_toxicity_scores_and_stage(spark):
    rows = [(i, ("you stupid clown " if i % 3 == 0 else "have a fine day ") + f"word{i % 13} other") for i in range(150)]
    docs = docs_of(spark, rows + [(900, None), (901, ""), (None, "you stupid clown"), (902, "fine " * 30_000)])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(150)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    net = toxicity.fit(docs, labels)
    out = toxicity.score_toxicity(docs, net).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.doc_id is not None and r.doc_id < 150 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all((r.score >= 0.5) == (r.doc_id % 3 == 0) for r in held)
    by = {r.doc_id: r.score for r in out}
    assert by[900] == by[901] == 0 and by[None] >= 0.5 and by[902] < 0.5
    left = toxicity.drop_toxic(docs, net)
    assert left.columns == docs.columns and left.count() == 103
    assert toxicity.score_toxicity(docs.limit(0), net).count() == 0
    empty = toxicity.fit(docs, labels.limit(0))
    assert max(r.score for r in toxicity.score_toxicity(docs, empty).collect()) < 0.5


def test_held_out_is_crc_of_the_text_form(spark):
    got = spark.range(-5, 200).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


# 2


def test_curve_visits_neighbours():
    for n, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        cells = [[c >> bits * (n - 1 - i) & side - 1 for i in range(n)] for c in range(side**n)]
        order = sorted(cells, key=lambda p: hilbert.curve_index(p, bits))
        assert sorted(hilbert.curve_index(p, bits) for p in cells) == list(range(side**n))
        assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(order, order[1:]))


@pytest.mark.parametrize("n", [0, 1, 39, 40, 41, 333])
def test_shards_are_even_runs_of_the_curve(spark, n):
    rows = [(i if i % 9 else None, "x" * (i % 50) if i % 7 else None, None if i % 5 == 0 else f"l{i % 4}", f"s{i % 11}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = hilbert.shard_rows(docs, 40).collect()
    assert len(out) == n
    size = [0] * 40
    for r in out:
        size[r.shard] += 1
    assert max(size) - min(size) <= 1
    for s in range(40):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(size[s]))
    seen = sorted(out, key=lambda r: (r.shard, r.slot))
    assert all(a.curve <= b.curve for a, b in zip(seen, seen[1:]))
    text = {r[0]: r[1] for r in rows if r[0] is not None}
    assert all(r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) and r["size"] == len(text[r.doc_id] or "") + 16 for r in out if r.doc_id is not None)


def test_shards_equal_a_sorted_list(spark):
    """Slot by slot: rows in order of the curve, of the hash that splits hot cells, and of the id."""
    rows = [(i, "x" * (i * 7 % 300), f"l{i % 4}", f"s{i % 11}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = sorted(hilbert.shard_rows(docs, 7).collect(), key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in out] == sorted(r.curve for r in out)
    at = {r.doc_id: r for r in out}
    for r in out:
        text = rows[r.doc_id][1]
        log = max(0, min(15, int(np.floor(np.log2(max(len(text) + 16, 16)))) - 4))
        assert r.cells[0] == log and r.curve == hilbert.curve_index(list(r.cells), hilbert.BITS)
    place = {r.doc_id: i for i, r in enumerate(out)}
    sizes = Counter(r.shard for r in out)
    base, more = divmod(500, 7)
    assert [sizes[k] for k in range(7)] == [base + (k < more) for k in range(7)]
    assert all(place[d] == sum(sizes[k] for k in range(at[d].shard)) + at[d].slot for d in place)


def test_filters_skip_shards(spark):
    rows = [(i, "x" * (2 ** (i % 12)), f"l{i % 4}", f"s{i % 6}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    sharded = hilbert.shard_rows(docs, 40).join(docs.select("doc_id", "lang", "source"), "doc_id").cache()
    spans = hilbert.manifest(sharded)
    wide = [r.high[0] - r.low[0] for r in spans.collect()]
    assert np.mean(wide) < 8
    web = hilbert.by_hash(F.lit("s3"))
    for wanted, rows_of in (({1: (web, web)}, "source = 's3'"), ({0: (6, 15)}, "size >= 1024"), ({0: (0, 1), 1: (web, web)}, "size < 64 and source = 's3'")):
        read = {r.shard for r in hilbert.shards_to_read(spans, wanted).collect()}
        hit = {r.shard for r in sharded.where(rows_of).select("shard").distinct().collect()}
        assert hit <= read and len(read) < 40, wanted


def test_shards_split_one_hot_cell(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    out = hilbert.shard_rows(docs, 40)
    assert {tuple(r) for r in hilbert.manifest(out).select("rows").collect()} == {(125,)}


# 3


def brute_hits(words, items):
    hit, found = set(), set()
    for item, text in items:
        w = words_of(text.encode()) if text else []
        m = min(13, len(w))
        for k in range(len(w) - m + 1) if m else ():
            for f in range(len(words) - m + 1):
                if words[f : f + m] == w[k : k + m]:
                    hit |= set(range(f, f + m))
                    if item is not None:
                        found.add(str(item))
    return len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 300])
def test_decontamination_matches_brute_force(spark, block_bytes):
    rng = random.Random(3)
    vocab = ["a", "b", "é", "7"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 20)))) for i in range(12)] + [(50, None), (51, ""), (None, "b b b b"), (3, "a a a")]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40)))) for i in range(40)] + [(100, None), (101, "!!"), (102, "x y " * 3000 + items[2][1])]
    docs = docs_of(spark, rows + [rows[0]])
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    out = decontaminate.find_benchmark(docs, bench, block_bytes).collect()
    assert len(out) == len(rows) + 1
    text = dict(rows)
    for r in out:
        words = words_of((text[r.doc_id] or "").encode())
        assert (r.n_words, (r.n_hit, r["items"])) == (len(words), brute_hits(words, items))
        assert sum(s.last - s.first for s in r.spans) == r.n_hit
    left = decontaminate.drop_contaminated(docs, bench, block_bytes)
    bad = {r.doc_id for r in out if r.n_hit and 20 * r.n_hit >= r.n_words}
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(text) - bad
    assert decontaminate.find_benchmark(docs.limit(0), bench, block_bytes).count() == 0
    assert {r.n_hit for r in decontaminate.find_benchmark(docs, bench.limit(0)).collect()} == {0}


# 4


def brute_components(rows, linked):
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(len(rows))]


def test_near_duplicates_match_brute_force(spark):
    rows = sample(4)
    bags = [own_bag(t) for _, t in rows]
    group = brute_components(rows, lambda i, j: own_overlap(bags[i], bags[j]) >= 0.8)
    least: dict = {}
    for (d, _), g in zip(rows, group):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    want = sorted((d if d is not None else -1, least.get(g, -1)) for (d, _), g in zip(rows, group))
    docs = docs_of(spark, rows)
    out = bagminhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.component_id if r.component_id is not None else -1) for r in out) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    left = bagminhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in out if r.kept)
    assert bagminhash.near_duplicates(docs.limit(0)).count() == 0


# 5


def test_urls_match_brute_force(spark):
    rng = random.Random(5)
    hosts = ["net", "a.net", "example.net", "x.example.net", "notexample.net", "Example.NET", "org", "a-b.org", "com", "example.com", "net.org", "", "a..net"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/de/1", "/fr/", "/fr/x?q=/en/", "?a", "#b", "/EN/"]
    urls = [rng.choice(["http://", "HTTPS://", "", "x://y://"]) + rng.choice(hosts) + rng.choice(paths) for _ in range(400)] + [None, "://"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(None, "http://a.net/"), (0, urls[0])], "page_id long, url string").withColumn("verdict", F.lit(1))
    many = [*queries.URL_RULES, ("example.net", "/", "block"), ("net", "/en/x", "allow"), ("", "/", "block"), ("org", "/fr/", "block"), ("a..net", "/", "allow")]
    for rules in (queries.URL_RULES, many, []):
        df = spark.createDataFrame([*rules, ("org", None, "block")], "host string, path string, verdict string")
        out = urlrules.judge_urls(pages, df, partitions=3).collect()
        assert len(out) == len(urls) + 2
        for r in out:
            url = urls[r.page_id] if r.page_id is not None else "http://a.net/"
            rest = (url or "").partition("://")[2]
            host = rest
            for c in "/?#":
                host = host.partition(c)[0]
            path = rest[len(host) :].partition("?")[0].partition("#")[0]
            host = host.lower()
            fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
            best = max(fits, default=None)
            assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best[3], best[4] if best else "allow"), url
    assert urlrules.judge_urls(pages.limit(0), df).count() == 0


# 6


def test_events_fold_to_final_messages(spark):
    e = [
        (1, 0, "m0", "message", "user", "hi"), (1, 1, "m1", "message", "assistant", ""), (1, 2, "m1", "delta", None, "he"), (1, 3, "m1", "delta", None, "llo"),
        (1, 4, "m1", "regenerate", None, None), (1, 5, "m1", "delta", None, "good "), (1, 6, "m1", "delta", None, "day"), (1, 7, "m0", "edit", None, "hello?"),
        (1, 8, "m2", "message", "user", "bye"), (1, 9, "m2", "delete", None, None), (2, 0, "m0", None, None, None), (None, 0, None, "odd", "user", "x"),
    ]
    random.Random(1).shuffle(e)
    out = chatformat.fold_events(spark.createDataFrame(e, "conv_id long, seq long, message string, kind string, role string, text string"))
    got = sorted(((r.conv_id or 0), r.seq, r.role, r.text) for r in out.collect())
    assert got == [(0, 0, "user", "x"), (1, 0, "user", "hello?"), (1, 1, "assistant", "good day"), (2, 0, "", "")]


def test_formatting_reads_back_exactly(spark):
    rng = random.Random(6)
    parts = ["<|im_start|>", "<|im_end|>\n", "</s>", "[INST]", "&amp;", "&lt;", "&", "<", "[", "\n", "é", "ok ", "&NewLine;", "&lsqb;", "\U0001f600", "\\"]
    msgs = [(c, t, rng.choice(["user", "assistant", "sy<stem\n", None]), None if rng.random() < 0.1 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))) for c in range(30) for t in range(rng.randint(1, 5))]
    df = spark.createDataFrame(msgs, "conv_id long, seq long, role string, text string").withColumn("turn", F.lit(1))
    rendered = chatformat.render(df)
    assert not any(x in r.formatted.replace("<|im_start|>", "").replace("<|im_end|>", "") for r in rendered.collect() for x in ("<", "["))
    for r in chatformat.read_back(rendered).collect():
        mine = [(role or "", text or "") for c, _, role, text in msgs if c == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == mine
        assert r.loss_text == "".join(t for role, t in mine if role == "assistant")
    assert chatformat.read_back(chatformat.render(df.limit(0))).count() == 0


# 7


def test_packing_places_every_id(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    rows = [*sample(7), (8000, "long words " * 5000)]
    docs = docs_of(spark, rows).repartition(3)
    out = packing.pack_documents(docs, path, window=128, shard_tokens=2000).collect()
    pieces: dict = {}
    sequences: dict = {}
    for r in out:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, bytes(r.ids)))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want: dict = {}
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        want.setdefault((d, len(ids)), []).append(np.array(ids, "<u4").tobytes())
    assert set(want) == set(pieces)
    for k, texts in want.items():
        assert sorted(n for _, n, _ in pieces[k]) and sum(n for _, n, _ in pieces[k]) == k[1] * len(texts)
        if len(texts) == 1:
            assert b"".join(x for _, _, x in sorted(pieces[k])) == texts[0]
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(n for _, n in s) <= 128
    assert sum(sum(n for _, n in s) < 128 for s in sequences.values()) <= 3
    assert packing.pack_documents(docs.limit(0), path).count() == 0


# 8


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def own_norm(line):
    return " ".join(line.lower().split())


def alike(a, b):
    return edits(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9


def stays_by_line(out, rows):
    """The text that stands for each line's group, by the operator's own account."""
    lines = {d: (t or "").split("\n") for d, t in rows}
    stays = {}
    for r in out:
        gone = {g.line: own_norm(lines[g.of_doc][g.of_line]) for g in r._weftline_gone or ()}
        for i, x in enumerate(lines[r.doc_id]):
            if x.strip():
                stays[r.doc_id, i] = gone.get(i, own_norm(x))
    return stays


def test_lines_match_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"{a}{b}" for a in "bcdfgklm" for b in ("alo", "erin", "ut", "ossa", "i", "ander")]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    pool = [line(rng.randint(8, 60)) for _ in range(25)]

    def vary():
        w = rng.choice(pool).split()
        if rng.random() < 0.6:
            w[rng.randrange(len(w))] += rng.choice("xy")
        return ("  " if rng.random() < 0.2 else "") + rng.choice([" ", "  "]).join(w).title()

    rows = [(i, "\n".join(rng.choice([vary(), vary(), vary(), line(9), ""]) for _ in range(rng.randint(0, 6)))) for i in range(40)]
    rows += [(900, None), (None, pool[0] + "\n" + pool[0]), (901, "\n\n"), (902, pool[1] + "\t" + "z")]
    docs = docs_of(spark, rows)
    texts = sorted({own_norm(x) for _, t in rows for x in (t or "").split("\n") if x.strip()})
    group = dict(zip(texts, brute_components(texts, lambda i, j: alike(texts[i], texts[j]))))
    assert len(set(group.values())) < len(texts)  # some lines are fuzzy copies
    first: dict = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for i, x in enumerate((t or "").split("\n")):
            if x.strip():
                first.setdefault(group[own_norm(x)], (d, i))
    out = linededup.drop_repeated_lines(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    where = lambda d, i: (d is None, d or 0, i)
    stay, missed, went = [], 0, 0
    for d, t in rows:
        lines, gone = (t or "").split("\n"), {g.line: g for g in got[d]._weftline_gone or ()}
        assert got[d].text == (None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)), d
        for i, x in enumerate(lines):
            if i in gone:
                g = gone[i]
                kept = own_norm(dict(rows)[g.of_doc].split("\n")[g.of_line])
                assert group[kept] == group[own_norm(x)] and where(g.of_doc, g.of_line) < where(d, i)
                assert g.of_line not in {h.line for h in got[g.of_doc]._weftline_gone or ()}
                went += 1
            elif x.strip():
                stay.append(own_norm(x))
                missed += first[group[own_norm(x)]] != (d, i)
    assert len(stay) == len(set(stay))  # every exact repeat goes
    assert went > 30 and missed <= 0.1 * (went + missed), (went, missed)
    assert linededup.drop_repeated_lines(docs.limit(0)).count() == 0


def test_lines_with_one_word_replaced_are_found(spark):
    """Recall by edit similarity alone, by length, on lines of different words with one word replaced."""
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    wanted = {(5, 10): 0.7, (10, 20): 0.9, (20, 40): 0.95, (40, 100): 0.98, (100, 400): 0.98}
    rows, pairs, of = [], Counter(), {}
    for size in wanted:
        for _ in range(150):
            w = [word() for _ in range(rng.randrange(*size))]
            v = list(w)
            v[rng.randrange(len(v))] = word()
            a, b = " ".join(w), " ".join(v)
            if a != b and (len(w) >= 20 or alike(a, b)):
                k = len(rows)
                rows += [(k, a), (k + 1, b)]
                of[k + 1] = size
                pairs[size] += 1
    out = linededup.drop_repeated_lines(docs_of(spark, rows)).collect()
    gone = Counter(of[r.doc_id] for r in out if r._weftline_gone)
    assert all(g.of_doc == r.doc_id - 1 for r in out for g in r._weftline_gone or ())
    assert all(gone[size] >= share * pairs[size] for size, share in wanted.items()), (gone, pairs)


def test_recall_on_the_test_documents(spark):
    """All pairs of lines of edit similarity 0.8 in the smallest table: nine of ten end in one group, and no group joins others."""
    import os

    import duckdb
    import pandas as pd

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    docs = spark.read.parquet(path)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    stays = stays_by_line(linededup.drop_repeated_lines(docs).collect(), rows)
    rep = {own_norm(x): stays[d, i] for d, t in rows for i, x in enumerate((t or "").split("\n")) if x.strip()}
    texts = sorted(rep)
    count = np.array([[t.count(c) for c in "abcdefghijklmnopqrstuvwxyz "] for t in texts])
    size = np.array([len(t) for t in texts])
    near = []
    for i in range(len(texts)):
        gap = count[i + 1 :] - count[i]
        most = 0.2 * np.maximum(size[i + 1 :], size[i]) + 1e-9
        ok = (np.abs(size[i + 1 :] - size[i]) <= most) & (np.maximum(gap, 0).sum(axis=1) <= most) & (np.maximum(-gap, 0).sum(axis=1) <= most)
        near += [(i, j + i + 1) for j in np.flatnonzero(ok)]
    pairs, names = pd.DataFrame(near, columns=["a", "b"]), pd.DataFrame({"i": range(len(texts)), "t": texts})
    links = duckdb.sql("""SELECT a, b FROM pairs JOIN names x ON x.i = a JOIN names y ON y.i = b
        WHERE levenshtein(x.t, y.t) <= 0.2 * greatest(length(x.t), length(y.t)) + 1e-9""").fetchall()
    assert pairs is not None and names is not None and len(links) > 20
    found = sum(rep[texts[a]] == rep[texts[b]] for a, b in links)
    assert found >= 0.9 * len(links), (found, len(links))
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    at = {t: i for i, t in enumerate(texts)}
    assert all(find(at[t]) == find(at[r]) for t, r in rep.items())


def test_block_hash_depends_on_its_words_alone(spark):
    """The order of words and other blocks do not matter; any word of a block does."""
    words = [f"word{i}" for i in range(14)]
    lines = [" ".join(words), " ".join(reversed(words)), " ".join(["new", *words[1:]]), " ".join(["new", "newer", *words[2:]])]
    df = spark.createDataFrame(list(enumerate(lines)), "id int, norm string").withColumn("id", F.col("id").cast("string").cast("binary"))
    rows = linededup.buckets_of(df).collect()
    of = lambda k: {r.bucket for r in rows if bytes(r.id) == str(k).encode()}
    assert len(of(0)) == 6 and of(0) == of(1)
    assert of(0) & of(2) and of(0) != of(2) and len(of(0) & of(3)) < 6


def test_edit_bounds_hold(spark):
    rng = random.Random(12)
    pairs = []
    for n in (0, 3, 300, 700, 2600):
        a = "".join(rng.choice("ab cdé") for _ in range(n))
        b = list(a)
        for _ in range(n // 12):
            k = rng.randrange(len(b))
            b[k : k + 1] = rng.choice([[], ["x"], [b[k], "é"]])
        pairs += [(a, "".join(b)), (a, a[::-1]), (a, a), (a * 2, a)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", F.levenshtein("a", "b").alias("is"), linededup._at_most(F.col("a"), F.col("b")).alias("most")).collect():
        assert r["is"] <= r.most and (r.a != r.b or r.most == 0)


def test_long_lines_and_words(spark):
    docs = docs_of(spark, [(1, "word " * 60_000), (2, "word " * 60_000 + "\nnew"), (3, "x" * 200_000)])
    got = {r.doc_id: r.text for r in linededup.drop_repeated_lines(docs).collect()}
    assert got[2] == "new" and len(got[3]) == 200_000


# 9


def test_resampling_matches_brute_force(spark):
    rows = [(i, ("plain words here " if i % 4 else "BUY!! NOW!! $$$ ") * (i % 5 + 1)) for i in range(200)] + [(300, None), (301, "")]
    docs = docs_of(spark, [*rows, rows[3]])
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 200, 2)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    out = resample.resample(docs, labels, share=0.7).collect()
    raw, target = np.zeros(resample.BUCKETS), np.zeros(resample.BUCKETS)
    for d, t in [*rows, rows[3]]:
        c = np.bincount(resample.buckets_of(t.encode() if t else None), minlength=resample.BUCKETS)
        raw += c
        if d < 200 and d % 2 == 0 and d % 4:
            target += c
    ratio = resample.log_ratios(target, raw)
    text = dict(rows)
    assert all(abs(r.log_weight - ratio[resample.buckets_of((text[r.doc_id] or "").encode())].sum()) < 1e-9 for r in out)
    keys = sorted((r.gumbel_key for r in out), reverse=True)
    k = round(0.7 * len(out))
    assert {r.selected for r in out if r.gumbel_key >= keys[k - 1]} == {True} and sum(r.selected for r in out) in (k, k + 1)
    assert all(r.selected for r in resample.resample(docs, labels.limit(0)).collect())
    assert resample.resample(docs.limit(0), labels).count() == 0


def test_kth_largest(spark):
    for values in ([1.0] * 50, [float(i % 7) for i in range(100)], [10.0**i for i in range(-9, 9)], [0.0], list(np.random.default_rng(1).normal(size=5000))):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        ordered = sorted(map(float, values), reverse=True)
        for k in {1, len(values) // 2 or 1, len(values)}:
            assert resample.kth_largest(df, "v", k) == ordered[k - 1]
        assert resample.kth_largest(df, "v", len(values) + 1) is None and resample.kth_largest(df, "v", 0) is None


# 10


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(10)
    base = rng.normal(size=(40, 64))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    for k in range(160):
        i = int(rng.integers(40))
        rows.append((100 + k, (base[i] * rng.uniform(0.1, 5) + 0.15 * rng.normal(size=64)).tolist(), i % 3))
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 1), (502, rows[0][1], None), (503, None, 0), (504, [0.0] * 64, 0), (505, [float("nan")] + [1.0] * 63, 0), (506, [None] + [1.0] * 63, 0), (507, [1.0, 2.0], 0), (508, [2.0, 4.1], 0), (509, [], 0), (510, [float("inf")] * 64, 0), (0, rows[0][1], 0), (None, rows[1][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("key", F.lit("x"))
    good = [r[2] is not None and bool(r[1]) and None not in r[1] and bool(np.isfinite(r[1]).all()) and any(r[1]) for r in rows]

    def linked(i, j):
        a, b = rows[i], rows[j]
        if not (good[i] and good[j] and a[2] == b[2] and len(a[1]) == len(b[1])):
            return False
        x, y = np.array(a[1]), np.array(b[1])
        return x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93

    n = [sum(linked(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    group = brute_components(rows, linked)
    least: dict = {}
    for r, g in zip(rows, group):
        if r[0] is not None:
            least[g] = min(r[0], least.get(g, r[0]))
    want = sorted((-1 if r[0] is None else r[0], k, least.get(g, -1)) for r, k, g in zip(rows, n, group))
    out = itq.similar_vectors(df).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id) for r in out) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    assert itq.similar_vectors(df.limit(0)).count() == 0 and itq.similar_vectors(df.where("label is null")).count() == 1


def test_recall_at_the_boundary(spark):
    """Pairs of cosine just above the threshold, the hardest to retrieve."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    z = 0.935 * x + np.sqrt(1 - 0.935**2) * y
    rows = [(2 * i, a.tolist(), 0) for i, a in enumerate(x)] + [(2 * i + 1, a.tolist(), 0) for i, a in enumerate(z)]
    out = itq.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    found = sum(r.n_links > 0 for r in out) / len(out)
    assert found >= 0.9, found


def test_planted_links_of_many_cosines_around_a_mean(spark):
    """Vectors that share a direction, wide ones too, against brute force: links above 0.93 only, nine of ten found."""
    rng = np.random.default_rng(12)
    for width, shift in ((384, 0.0), (48, 0.7)):
        x = rng.normal(size=(120, width)) / width**0.5 + shift * np.ones(width) / width**0.5
        rows = [(i, v, int(i % 2)) for i, v in enumerate(x)]
        for k, scale in enumerate(np.linspace(0.02, 0.6, 240)):
            rows.append((1000 + k, x[k % 120] + scale * rng.normal(size=width) / width**0.5, int(k % 120 % 2)))
        m = np.array([v / np.linalg.norm(v) for _, v, _ in rows])
        same = np.array([y for *_, y in rows])
        link = (m @ m.T >= 0.93) & (same[:, None] == same) & ~np.eye(len(rows), dtype=bool)
        out = itq.similar_vectors(spark.createDataFrame([(i, v.tolist(), y) for i, v, y in rows], "vec_id long, embedding array<double>, label int"))
        got = {r.vec_id: r.n_links for r in out.collect()}
        want = {i: int(n) for (i, *_), n in zip(rows, link.sum(axis=1))}
        assert sum(want.values()) > 150 and all(got[i] <= n for i, n in want.items())
        assert sum(got.values()) >= 0.9 * sum(want.values()), (width, sum(got.values()), sum(want.values()))


def test_tables_grow_with_vectors():
    for rows in (10, 10**5, 10**7, 10**9):
        part, tables, words = itq.plan(rows, 0.12)
        assert 2**part >= min(4 * rows, 2**32) and words * (64 // part) >= tables
        met = 0.88**part + part * 0.12 * 0.88 ** (part - 1)
        assert (1 - met) ** tables <= 0.011


# queries and pipeline


def test_queries_equal_their_oracles(spark):
    import glob
    import os

    import duckdb

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, sf)
        rel = con.sql(sql)
        at = [rel.columns.index(c) for c in df.columns]
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall()), name


def replayed_words(rows, bench):
    """Rows whose words are hit less than a twentieth, by comparing every run of words."""
    windows = {}
    for t in bench:
        w = own_words(t)
        m = min(13, len(w))
        for k in range(len(w) - m + 1) if m else ():
            windows.setdefault(m, set()).add(tuple(w[k : k + m]))
    left = {}
    for d, t in rows.items():
        w = own_words(t)
        hit = {i + k for m, runs in windows.items() for i in range(len(w) - m + 1) if tuple(w[i : i + m]) in runs for k in range(m)}
        if not (hit and 20 * len(hit) >= len(w)):
            left[d] = t
    return left


def test_pipeline_equals_a_replay(spark):
    """Every stage of the pipeline against plain Python on its own input, and run() against the stages."""
    import os

    from tokenizers import Tokenizer

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "MinHash near-dedup", "benchmark decontamination", "packing"]

    def step(name, docs):
        out = stages[name](spark, docs, sf)
        assert out.columns == docs.columns
        rows = out.collect()
        assert len({r.doc_id for r in rows}) == len(rows)
        return spark.createDataFrame(rows, docs.schema), {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in rows}

    docs_before = docs
    docs, before, after = step("toxicity", docs)
    # one text at a time by the same network; what it learns is held to held-out labels elsewhere
    scorer = toxicity.Scorer(toxicity.fit(docs_before, spark.read.parquet(f"{sf}/labels.parquet")))
    assert after == {d: t for d, t in before.items() if scorer.score([t.encode() if t else None])[0] < 0.5}
    assert sum(d not in after for d, k in toxic.items() if k == 0 and d in before) <= 0.05 * len(before)

    docs, before, after = step("line dedup", docs)
    assert set(before) == set(after)
    seen: list = []
    for d in sorted(before):
        left = Counter(x for x in (after[d] or "").split("\n") if x.strip())
        for x in (before[d] or "").split("\n"):
            if x.strip() and left[x]:
                left[x] -= 1
                seen.append(own_norm(x))
            elif x.strip():  # gone: an earlier line that stayed is near, or was near a line that went (groups are chains)
                assert any(abs(len(y) - len(own_norm(x))) <= 0.5 * len(own_norm(x)) for y in seen)
        assert not +left
    assert len(seen) == len(set(seen))

    docs, before, after = step("MinHash near-dedup", docs)
    ids = sorted(before)
    bags = [own_bag(before[d]) for d in ids]
    group = brute_components(ids, lambda i, j: own_overlap(bags[i], bags[j]) >= 0.8)
    assert sorted(after) == sorted({ids[g] for g in group}) and all(before[d] == t for d, t in after.items())

    docs, before, after = step("benchmark decontamination", docs)
    assert after == replayed_words(before, bench)

    tokens = Tokenizer.from_file(queries.tokenizer_path())
    want = {d: [*tokens.encode(t or "", add_special_tokens=False).ids, 1] for d, t in after.items()}
    pieces = stages["packing"](spark, docs, sf).collect()
    got: dict = {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and r.doc_tokens == len(want[r.doc_id])
        assert got.get(r.doc_id, 0) == r.start
        got[r.doc_id] = r.start + r.length
    assert got == {d: len(x) for d, x in want.items()}

    whole: dict = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        whole.setdefault(r.doc_id, 0)
        whole[r.doc_id] += r.length
    assert whole == got


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, "..."), (None, "one two three"), (4, "word " * 30_000), (5, "one two three"), (5, "one two three")]])
def test_pipeline_stages_on_odd_documents(spark, rows):
    """Nulls, empty and very long texts, repeats and clashing columns pass every stage; no table, no rows."""
    import os

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    docs = docs_of(spark, rows)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        if not rows:
            assert out.count() == 0
        elif name == "line dedup":
            assert out.count() == len(rows)
        elif name == "MinHash near-dedup":
            assert {r.doc_id for r in out.collect()} == {1, 2, 3, 4, 5}
        else:
            assert out.count() == len(rows)
    assert corpus_pipeline.pack(spark, docs, sf).select("doc_id").distinct().count() == len({d for d, _ in rows})


def test_every_block_of_a_long_line_is_a_bucket(spark):
    words = [f"word{i}" for i in range(300)]
    df = spark.createDataFrame([("0", " ".join(words))], "id string, norm string").withColumn("id", F.col("id").cast("binary"))
    hashes = [r.h & (2**64 - 1) for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w").alias("h")).collect()]
    assert len({(h >> 20) % 32 for h in hashes}) == 32 == linededup.buckets_of(df).count()


def test_blocks_of_few_words_are_buckets(spark):
    lines = [("1", " ".join(f"word{i}" for i in range(12))), ("2", "of the")]
    df = spark.createDataFrame(lines, "id string, norm string").withColumn("id", F.col("id").cast("binary"))
    found = Counter(bytes(r.id) for r in linededup.buckets_of(df).select("id", "bucket").collect())
    two = spark.createDataFrame([("of",), ("the",)], "w string").select(F.xxhash64("w").alias("h")).collect()
    at = {(r.h & (2**64 - 1)) >> 20 & 3 for r in two}
    assert found[b"1"] == 6 and found[b"2"] == (5 if len(at) == 2 else 3)
