"""Jaccard join, chats, fingerprints, Katz scores, suffix dedup, pipeline."""

import collections
import hashlib
import math
import random
import struct
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from graupel.llm import bpe, chat, fingerprint, graph, katz, neardup, suffix
from graupel.llm.common import written


def documents(sf):
    return duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' order by doc_id").fetchall()


# ---- n-gram Jaccard join ----


def brute_links(rows):
    words = {i: tuple((t or "").lower().split()) for i, t in rows}
    first = {}
    for i, _ in rows:
        first.setdefault(words[i], i)
    sets = {i: {w[k : k + 5] for k in range(max(1, len(w) - 4))} if w else set() for w, i in first.items()}
    links, up = collections.Counter(), {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    copies = collections.Counter(first[words[i]] for i, _ in rows)
    return {i: (first[words[i]], copies[first[words[i]]], links[first[words[i]]], top(first[words[i]])) for i, _ in rows}


def linked(df, **names):
    return {r["doc_id"]: (r["class_id"], r["n_copies"], r["n_links"], r["group_id"]) for r in neardup.link(df, **names).collect()}


def test_links_equal_brute_force(spark, sf):
    assert linked(spark.read.parquet(f"{sf}/documents.parquet")) == brute_links(documents(sf))


def near_copies(n, size=60):
    rng = random.Random(n)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(size)]
    rows = []
    for i in range(n):
        words = base[:]
        if i % 3:
            words[rng.randrange(size)] = f"x{i % 7}"
        rows.append((i, " ".join(words)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "One  TWO"), (n + 4, " ".join(base * 300))]


@pytest.mark.parametrize("block", [512, 16])
def test_large_groups_in_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = near_copies(120)
    df = spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id long, text string, cid long, key binary")
    assert linked(df) == brute_links(rows)
    kept = neardup.keep_one(df.unionByName(df)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({v[3] for v in brute_links(rows).values()})


def test_loose_components_by_buckets(spark, monkeypatch):
    """A chain of texts of which each shares 0.7 with the next, and some near
    copies on it, is dealt by buckets, with the same links."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(3)
    stream = [f"w{rng.randint(0, 10**7)}" for _ in range(60 + 10 * 150)]
    chain = [stream[10 * i : 10 * i + 60] for i in range(150)]
    near = [[*w[:-2], f"x{k}"] for w in chain[::40] for k in range(4)]
    rows = [(i, " ".join(w)) for i, w in enumerate(chain + near)] + [(1000 + i, t) for i, t in near_copies(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    units = neardup._units
    monkeypatch.setattr(neardup, "_units", lambda *a: seen.append(units(*a)) or seen[-1])
    assert linked(df) == brute_links(rows)
    by = {r["dealt"]: (r["n"], r["rows"]) for r in seen[0].groupBy(F.col("band").isNull().alias("dealt")).agg(F.countDistinct("cid").alias("n"), F.count("*").alias("rows")).collect()}
    assert by[False][0] > 100 and by[False][1] < 60 * by[False][0]
    assert by[True][0] > 0


def test_join_of_empty_and_unlinked_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string")
    assert neardup.link(df.where("false")).count() == 0
    assert linked(df) == {1: (1, 1, 0, 1), 2: (2, 1, 0, 2)}


def test_bands_and_pruning_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    for n in (9, 18, 90, 450):
        common = n * 8 // 9
        for _ in range(100):
            make = lambda k: rng.integers(0, 1 << 63, k, np.uint64)
            c = make(common)
            a, b = (neardup.signature(np.unique(np.concatenate((c, make(n - common))))) for _ in range(2))
            assert (neardup.band_keys(a) == neardup.band_keys(b)).any()
            assert len(neardup.survivors(np.stack([a, b]).astype(np.uint32), np.array([0]), np.array([1]))[0])


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 101), (7, 7)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 50, 50: 50, 101: 50}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_links_of_texts_without_ids(spark):
    said = " ".join(f"w{i}" for i in range(60))
    rows = [(None, said), (1, said + " more"), (None, said + " less"), (2, "other words here"), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_links"], r["group_id"] or 0) for r in neardup.link(df).collect())
    assert got == [(0, 0, 3), (0, 2, 1), (0, 2, 1), (1, 2, 1), (2, 0, 2), (3, 0, 3)]


# ---- chats ----


def test_chat_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    got = chat.op5_chat_format(spark, sf)
    want = con.execute(chat.OP5_SQL)
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_template_is_reversible(spark):
    rng = random.Random(3)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE x]", "[/ROLE]", "\\", "[", "<", "]", "s>", "INST]", "\n", "é", "<\\s>", "[\\\\INST]", "$1"]
    rows = [(i, i, rng.choice(["user", "assistant", "system", None, "a]b\\c"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, tree int, role string, text string").withColumn("said", chat.turn(F.col("role"), F.col("text")))
    for r in df.select("role", "text", chat.parse(F.col("said")).alias("back")).collect():
        assert [tuple(b) for b in r["back"]] == [(r["role"], r["text"])]


def brute_paths(nodes):
    out = {}
    by = {(t, n): (p, s) for t, n, p, s in nodes}
    parents = {(t, p) for t, _, p, _ in nodes if p is not None}
    for t, n, _, _ in nodes:
        if (t, n) in parents:
            continue
        path, at = [], n
        while at is not None and (t, at) in by and len(path) <= len(nodes):
            path.append(at)
            at = by[t, at][0]
        out[t, n] = path[::-1]
    return out


def test_paths_equal_a_walk(spark):
    rng = random.Random(8)
    nodes = [(t, n, None if n == 0 else rng.choice([n - 1, n - 1, n - 1, rng.randrange(n)]), float(rng.randint(0, 5))) for t in (1, None) for n in range(60)]
    nodes += [(2, 0, 1, 0.0), (2, 1, 0, 0.0), (3, 5, 99, 1.0)]
    got = collections.defaultdict(list)
    scores = {}
    for r in chat.paths(spark.createDataFrame(nodes, "tree int, node long, parent long, score double")).collect():
        got[r["tree"], r["leaf"]].append((r["depth"], r["node"]))
        scores[r["tree"], r["leaf"]] = (r["rank"], r["branch_score"])
    want = brute_paths(nodes)
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == want
    value = {(t, n): s for t, n, _, s in nodes}
    for tree in (1, None):
        leaves = sorted((k for k in want if k[0] == tree), key=lambda k: (-sum(value[tree, n] for n in want[k]), k[1]))
        assert [scores[k][0] for k in leaves] == [*range(1, len(leaves) + 1)]


def test_chat_with_circles_of_parents_ends(spark):
    nodes = [(1, 1, 2), (1, 2, 1), (1, 3, 1), (1, 4, 4), (1, 5, 4), (1, 6, None), (1, 7, 6), (2, 1, 3), (2, 2, 1), (2, 3, 2), (3, 1, None), (3, 2, 1), (3, 3, 1)]
    df = spark.createDataFrame([(t, n, p, "user", f"m{n}", 1.0) for t, n, p in nodes], "tree int, node long, parent long, role string, text string, score double")
    got = sorted((r["tree"], r["leaf"], r["formatted"]) for r in chat.format_trees(df).collect())
    assert got == [(1, 7, "[INST]m6[/INST][INST]m7[/INST]"), (3, 2, "[INST]m1[/INST][INST]m2[/INST]"), (3, 3, "[INST]m1[/INST][INST]m3[/INST]")]


def test_chat_with_very_long_roles(spark):
    rows = [(i, i, role * n, "text") for i, (role, n) in enumerate([("r", 100_000), ("]\\", 50_000), ("ab]", 40_000), ("\\", 100_000), ("\n", 3000)])]
    df = spark.createDataFrame(rows, "i int, tree int, role string, text string").withColumn("said", chat.turn(F.col("role"), F.col("text")))
    for r in df.select("role", "text", chat.parse(F.col("said")).alias("back")).collect():
        assert [tuple(b) for b in r["back"]] == [(r["role"], r["text"])]


def test_chat_of_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (None, 5, None, "x"), (2, None, "assistant", "y")]
    df = chat.chains(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["tree"]: r["formatted"] for r in chat.format_trees(df).collect()}
    assert got == {1: "[INST][/INST][INST][/INST]", None: "[ROLE]x[/ROLE]", 2: "<s>y</s>"}
    assert chat.format_trees(df.where("false")).count() == 0


# ---- fingerprints ----


def jaccard(x, y):
    p, q = (collections.Counter(t.lower().split()) for t in (x, y))
    return sum((p & q).values()) / max(1, sum((p | q).values()))


def test_fingerprints_estimate_generalised_jaccard(spark, sf):
    docs = dict(documents(sf))
    got = {r["doc_id"]: r for r in fingerprint.op6_weighted_fingerprint(spark, sf).collect()}
    ids, off = sorted(docs, reverse=True), []
    assert len(got) == len(ids)
    for k, i in enumerate(ids):
        text, following = docs[i], docs[ids[(k + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[i]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(text)
        off.append((r["near_edited"] - jaccard(text, edited), r["near_next"] - jaccard(text, following)))
        assert abs(off[-1][0]) < 0.45
    assert np.abs(np.mean(off, 0)).max() < 0.05
    same = collections.defaultdict(set)
    for i, t in docs.items():
        same[t].add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in same.values())


def drawn(text):
    """The signature by the formulas of consistent weighted sampling."""
    xx = lambda raw, seed: xxhash.xxh64_intdigest(raw, seed=seed)
    part = lambda h, shift, bits: (((h >> shift) & ((1 << bits) - 1)) + 0.5) * 2.0**-bits
    out = []
    for k in range(fingerprint.SAMPLES):
        best = None
        for word, n in collections.Counter(text.lower().split()).items():
            term = xx(struct.pack("<Q", xx(word.encode(), 42)), 42)
            h, g = xx(struct.pack("<i", 2 * k), term), xx(struct.pack("<i", 2 * k + 1), term)
            r, ln_c, b = -math.log(part(h, 32, 32) * part(h, 0, 32)), math.log(-math.log(part(g, 40, 24) * part(g, 16, 24))), part(g, 0, 16)
            t = math.floor(math.log(n) / r + b)
            rank, name = int((ln_c - r * (t - b + 1.0) + 512.0) * (1 << 24)), ((h & (1 << 28) - 1) + t * 2654435) & (1 << 28) - 1
            best = min(x for x in (best, rank << 28 | name) if x is not None)
        out.append(xx(struct.pack("<q", best), 42) % 65536)
    return out


def test_signatures_equal_the_formulas(spark, sf):
    texts = ["one", "a a a b", "the cat sat on the mat the end", *(t[:400] for t in list(dict(documents(sf)).values())[:6] if t and t.isascii())]
    df = spark.createDataFrame([*enumerate(texts)], "i int, t string")
    got = {r["i"]: r["signature"] for r in fingerprint.fingerprints(df, ["i"], "t").collect()}
    assert [got[i] for i in range(len(texts))] == [drawn(t) for t in texts] and len(texts) > 4


def test_shared_draws_equal_the_formulas(spark, sf):
    texts = ["the cat the cat sat", "the cat sat", "The CAT the", "a " * 300, "", *(t[:300] for t in list(dict(documents(sf)).values())[:20] if t and t.isascii())]
    df = spark.createDataFrame([(i % 3, i, t) for i, t in enumerate(texts)], "part int, i int, t string").repartition(2, "part")
    df = fingerprint.fingerprints(df, ["part", "i"], "t", ["part"])
    assert {r["i"]: r["signature"] for r in df.collect()} == {i: drawn(t) for i, t in enumerate(texts) if t}
    assert len(texts) > 10 and df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def test_blocks_of_shared_draws_change_nothing(spark, tmp_path, monkeypatch):
    rows = [(None if i % 2 else i, f"all of them say {i % 7} " * (1 + i % 3)) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda: collections.Counter(map(tuple, fingerprint.op6_weighted_fingerprint(spark, str(tmp_path)).collect()))
    whole = run()
    monkeypatch.setattr(fingerprint, "BLOCK_BITS", 3)
    assert run() == whole and sum(whole.values()) == 60


def test_documents_in_order_have_a_task_for_each_part(spark, sf):
    rows = fingerprint.in_order(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")
    tasks = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("part").alias("n")).collect()
    assert {r["n"] for r in tasks} == {1} and len(tasks) > 2


def test_likeness_is_fine_enough_to_tell_near_from_nearer(spark):
    word = lambda n: " ".join(f"w{i}" for i in range(n))
    rows = [(j, word(100 + j % 2 * 15) + f" own{j}") for j in range(40)]
    df = spark.createDataFrame([(j, side, t) for j, mine in rows for side, t in ((0, mine), (1, word(135)))], "j int, side int, t string")
    got = fingerprint.fingerprints(df.withColumn("t", F.regexp_replace("t", "w", F.concat(F.col("j"), F.lit("w")))), ["j", "side"], "t")
    pairs = got.groupBy("j").pivot("side", [0, 1]).agg(F.first("signature")).select("j", fingerprint.likeness(F.col("0"), F.col("1")).alias("near")).collect()
    off = [r["near"] - (100, 115)[r["j"] % 2] / 136 for r in pairs]
    assert len(off) == 40 and np.std(off) < 0.065 and min(len(r["signature"]) for r in got.collect()) >= 64


def test_fingerprints_of_odd_rows(spark, tmp_path):
    rows = [(5, "a b c", 1), (5, "a b c", 1), (3, None, 1), (2, "", 1), (1, "word " * 50000, 1), (None, "z", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, part int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(fingerprint.op6_weighted_fingerprint(spark, str(tmp_path)).collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0)))
    assert [r["n_chars"] for r in got] == [3 + 2, 5, 0, 0, 250000, 1]
    assert got[0]["fingerprint"] == got[1]["fingerprint"] != "" and got[0]["near_next"] == 1.0 and got[2]["fingerprint"] == "" and got[2]["near_next"] == 1.0
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert fingerprint.op6_weighted_fingerprint(spark, f"{tmp_path}/none").count() == 0


# ---- Katz ----


def brute_katz(rows):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    texts = [(i, [*split(t), None], learn) for i, t, learn in rows]
    one, two, heads = collections.Counter(), collections.Counter(), collections.Counter()
    for _, tokens, learn in texts:
        if learn:
            one.update(tokens)
            before = ["<s> ", *tokens[:-1]]
            two.update(zip(before, tokens))
            heads.update(before)
    k, n, v = katz.DISCOUNTED, sum(one.values()), len(one)
    counts = lambda c: [0] + [sum(x == r for x in c.values()) for r in range(1, k + 2)]
    d1, d2 = katz.discounts(counts(one)), katz.discounts(counts(two))
    lost = sum((1 - d1[c]) * c for c in one.values() if c <= k)
    unknown, scale = (lost / n, 1) if lost else (0.5 / (n + 0.5) if n else 1.0, n / (n + 0.5))
    word = lambda w: (d1[one[w]] if one[w] <= k else 1) * one[w] * scale / n if one[w] else unknown
    after = collections.defaultdict(dict)
    for (a, b), c in two.items():
        after[a][b] = c

    def weight(a):
        lost = sum((1 - d2[c]) * c for c in after[a].values() if c <= k) / heads[a]
        keep = 1 if lost else 1 - 0.5 / heads[a]
        return (lost or 0.5 / heads[a]) / (1 - sum(map(word, after[a]))), keep

    def pair(a, b):
        if not heads[a]:
            return word(b)
        alpha, keep = weight(a)
        c = two[a, b]
        return (d2[c] if c <= k else 1) * c / heads[a] * keep if c else alpha * word(b)

    for a in [*heads][:15]:
        assert abs(sum(pair(a, b) for b in [*one, "never "]) - 1) < 1e-9
    return {
        i: (len(t), sum(one[w] > 0 for w in t), n, sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(pair(a, b)) for a, b in zip(["<s> ", *t[:-1]], t)))
        for i, t, _ in texts
    }


def close(got, want):
    return tuple(got[:3]) == want[:3] and all(abs(a - b) <= 1e-6 * max(1, abs(b)) for a, b in zip(got[3:], want[3:]))


@pytest.mark.parametrize("chunk", [2_000_000, 3_000])
def test_scores_equal_brute_force(spark, sf, chunk, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK_TOKENS", chunk)
    rows = [(i, t, zlib.crc32(str(i).encode()) % 7 != 2) for i, t in documents(sf)[:80]]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    got = {r["doc_id"]: r for r in katz.score(df, F.col("learn")).collect()}
    want = brute_katz(rows)
    for i in want:
        r = got[i]
        assert close((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]), want[i])


def test_scores_of_odd_rows(spark):
    rows = [(1, None, True), (2, "", True), (3, "A a b", None), (3, "A a b", True), (4, "q " * 20000, False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    got = katz.score(df, F.col("learn")).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [1, 1, 4, 4, 20001] and got[0]["train_tokens"] == 6
    assert katz.score(df.where("false"), F.col("learn")).count() == 0
    none = katz.score(df, F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["score"] == 0 and r["base_score"] == 0 for r in none)


# ---- suffix dedup ----


def brute_repeats(texts):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[w : w + suffix.LENGTH] for r in raw for w in range(len(r) - suffix.LENGTH + 1))
    out = []
    for r in raw:
        spans = suffix.merged([(w, w + suffix.LENGTH) for w in range(len(r) - suffix.LENGTH + 1) if seen[r[w : w + suffix.LENGTH]] > 1])
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + r[at:a], b
        kept += r[at:]
        out.append((len(r), len(r) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


def test_deep_shallow_order():
    rng = random.Random(3)
    for _ in range(200):
        base = bytes(rng.choice(b"ab") for _ in range(150))
        strings = [*{base[: rng.randint(0, 150)] + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 3))) + base[: rng.randint(0, 60)] for _ in range(rng.randint(1, 40))}]
        assert [strings[i] for i in suffix.deep_shallow(strings)] == sorted(strings)


@pytest.mark.parametrize("group", [50_000, 15])
def test_removed_bytes_equal_brute_force(spark, group):
    rng = random.Random(6)
    letters = lambda n, of="abcdefghijklmnop ": "".join(rng.choice(of) for _ in range(n))
    a, b = letters(700), letters(450, "xyz ")
    texts = [letters(rng.randint(0, 300)) + rng.choice([a, b, a[:420], a[200:], a[100:520] + b, "ab" * rng.randint(100, 900), "é" * 500, ""]) + letters(rng.randint(0, 300)) for _ in range(150)]
    texts += ["", None, "x" * 399, "x" * 400, "y" * 401, "z" * 2000, a, a]
    df = spark.createDataFrame([(i, t, b"k", 1) for i, t in enumerate(texts)], "doc_id long, text string, key binary, anchor long")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.removed(suffix.repeats(df, group=group), "doc_id", "text").collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def test_many_members_of_one_anchor():
    rng = random.Random(1)
    core = bytes(rng.choice(b"abcdef") for _ in range(420))
    texts = [*{bytes(rng.choice(b"xyz") for _ in range(rng.randint(0, 40))) + core[rng.randint(0, 30) :] + bytes(rng.choice(b"xyz") for _ in range(rng.randint(0, 40))) for _ in range(300)}]
    at = [t.index(core[200:240]) for t in texts]
    few = {}
    for k in range(0, len(texts), 150):  # groups below the limit are compared pair by pair
        part = [*range(k, min(k + 150, len(texts)))]
        few.update(zip(part, suffix.covers([(at[i], texts[i]) for i in part])))
    both = suffix.covers([(p, t) for p, t in zip(at, texts)])
    for i, x in enumerate(both):
        y = few[i]
        assert (x is not None) >= (y is not None) and (y is None or x[0] >= y[0] and x[1] >= y[1])


def test_repeats_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.removed(suffix.repeats(df), "doc_id", "text").count() == 0


# ---- the pipeline ----


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), "test-stage")
        assert docs.columns == [*corpus_pipeline.COLUMNS]
        counts.append(docs.count())
    links = brute_links(documents(sf))
    assert counts[0] == len(links) and counts[1] == len({v[3] for v in links.values()}) and counts[2] < counts[1] and counts[3] == counts[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    ranks, _ = bpe.public_ranks()
    pieces = {v: k for k, v in ranks.items()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(last) == counts[3]
    for r in last:
        assert b"".join(pieces[i] for i in r["ids"]).decode() == texts[r["doc_id"]]
