"""Toxicity, divergence of sources, alignment of tokenizers."""

import collections
import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from graupel.llm import alignment, divergence, terms, toxicity

ODD = "doc_id long, text string, lang string, source string, id long, n long, pack long, term string"
TEXTS = [None, "", "a", " ", "Zwei WÖRTER, zwei", "x" * 5000, "1234 !!", "é É é"]


def odd(spark):
    """Nulls, empty and long texts, repeated rows, clashing extra columns."""
    rows = [(i, t, None if i % 3 else "en", "s" if i % 2 else None, 7, 7, 7, "k") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + rows[-1:], ODD)


# ---- terms ----


def test_terms_equal_the_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aZ é1-\n日") for _ in range(rng.randrange(40))) for _ in range(300)] + ["", "ab", "cd"]
    want = [(k, w) for k, t in enumerate(texts) for w in _words(t)]
    for column in (pa.array(texts), pa.concat_arrays([pa.array(["zz"]), pa.array(texts)]).slice(1), pa.array(texts, pa.large_string())):
        found = terms.Terms(column)
        assert [*zip(found.row.tolist(), found.strings(np.arange(len(found.row))).to_pylist())] == want


def _words(text):
    import re

    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def test_pieces_hold_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (0, 5, 50, 1, 1, 0, 9)])], ["t"])
    cut = [*terms.packed([batch], 0, 10)]
    assert [x for p in cut for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert all(len(p) == 1 or sum(map(len, p.column(0).to_pylist())) <= 10 for p in cut)


# ---- toxicity ----


def test_logits_equal_all_pairs():
    rng = np.random.default_rng(2)
    machine = toxicity.Machine(np.arange(6), 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    rows = [[], [2], [0, 3, 5], [0, 1, 2, 3, 4, 5]]
    want = [0.3 + sum(machine.weights[x]) + sum(machine.factors[i] @ machine.factors[j] for i, j in itertools.combinations(x, 2)) for x in rows]
    row = np.repeat(np.arange(4), [len(x) for x in rows])
    assert np.allclose(machine.logits(row, np.array([f for x in rows for f in x]), 4), want)


def test_pairs_are_learned_that_no_sum_of_weights_tells():
    rng = np.random.default_rng(3)
    x = (rng.random((1500, 12)) < 0.5).astype(np.float32)
    y = (x[:, 0] == x[:, 1]).astype(float)
    bias, w, v = toxicity.fitted(x, y, steps=1200, weight=1.0)
    at, feature = np.nonzero(x)
    logit = toxicity.Machine(np.arange(12), bias, w, v).logits(at, feature, len(x))
    assert ((logit > 0) == (y > 0)).mean() > 0.95


def test_texts_not_learned_from(spark):
    """Held-out texts are told apart by stems that insults share."""
    rng = random.Random(4)
    plain = ["".join(rng.choice("aeioubdgklmnprst") for _ in range(6)) for _ in range(400)]
    rows = []
    for k in range(600):
        words, toxic = [rng.choice(plain) for _ in range(80)], k % 4 == 0
        if toxic:
            words[rng.randrange(80)] = "grumbak" + rng.choice(plain)
        rows.append((k, " ".join(words), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), learn=df["doc_id"] % 5 != 0)
    got = {r["doc_id"]: r for r in toxicity.score(df, machine).collect()}
    held = [(got[k]["predicted"], toxic) for k, _, toxic in rows if k % 5 == 0]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    again = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), learn=df["doc_id"] % 5 != 0, per_class=40)
    assert sum(abs(r["score"] - got[r["doc_id"]]["score"]) < 0.5 for r in toxicity.score(df, again).collect()) > 500


def test_toxicity_query_and_odd_rows(spark, sf):
    got = toxicity.op11_toxicity(spark, sf).collect()
    assert len(got) == duckdb.sql(f"select count(*) from '{sf}/documents.parquet'").fetchall()[0][0]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    df = odd(spark)
    labels = spark.createDataFrame([(4, 1), (4, 1), (5, 0), (6, 0), (6, 1), (7, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    scores = {}
    for r in toxicity.score(df, toxicity.train(df, labels), keep=("doc_id", "id", "n")).collect():
        assert scores.setdefault(r["doc_id"], r["score"]) == r["score"] and r["id"] == 7
    assert scores[0] == scores[1] == scores[3] and len(scores) == len(TEXTS)
    none = toxicity.train(df, labels.where("toxic = 0"))
    assert all(r["predicted"] == 0 for r in toxicity.score(df, none).collect())
    assert toxicity.score(df.where("false"), none).count() == 0 and toxicity.train(df.where("false"), labels).bias is not None


# ---- divergence ----


def _against_sql(df, min_docs=1):
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text", "lang", "source").toPandas())
    sql = divergence.OP12_SQL.replace(">= 30", f">= {min_docs}")
    got = divergence.audit(df, min_docs=min_docs)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    cols = sorted(names)
    assert sorted(got.columns) == cols
    return sorted(tuple(r[c] for c in cols) for r in got.collect()), sorted(tuple(r[names.index(c)] for c in cols) for r in want.fetchall())


def test_divergence_of_odd_rows(spark):
    got, want = _against_sql(odd(spark))
    assert got == want and got
    assert divergence.audit(odd(spark).where("false")).count() == 0
    got, want = _against_sql(odd(spark), 30)  # no term is kept
    assert got == want and all(0 in r for r in got)


def test_divergence_in_many_blocks_and_pieces(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(40))), rng.choice(["de", "en"]), f"s{rng.randrange(5)}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(divergence, "CELLS", (100, 100))
    got, want = _against_sql(df, 3)
    assert got == want and {r[2] for r in got} == {"pair", "term"}


def test_terms_of_one_hash_stay_apart(monkeypatch):
    texts = ["aa bb aa longerthaneight", "bb aa longerthaneighu", "longerthaneight"]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 3), pa.array(["s", "s", "t"]), pa.array(texts)], ["lang", "source", "text"])
    want = sorted(map(tuple, divergence.count_terms(batch).to_pandas().values.tolist()))
    monkeypatch.setattr(terms.Terms, "hashes", lambda self: np.zeros(len(self.starts), np.uint64))
    assert sorted(map(tuple, divergence.count_terms(batch).to_pandas().values.tolist())) == want
    assert ("en", "s", "aa", 3, 2) in want and ("en", "t", "longerthaneight", 1, 1) in want


def test_probabilities_are_exact():
    rng = random.Random(6)
    for _ in range(300):
        total = rng.randrange(10 ** rng.randrange(1, 15) + 1)
        count, size = rng.randrange(total + 1), rng.randrange(1, 10**6)
        assert divergence.probability(np.array([count]), total, size)[0] == 1 + 10**9 * (count + 5) // (total + 5 * size)


# ---- alignment ----


@pytest.fixture(scope="module")
def files():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _brute(texts, files):
    """Whole texts, one after the other, link by link."""
    with open(files[0], encoding="utf-8") as f, open(files[1], "rb") as g:
        pair = alignment.Pair(f.read(), g.read())

    def spans(ids, pieces):
        ends = [*itertools.accumulate(len(pieces[i]) for i in ids)]
        return [(e - len(pieces[i]), e, i) for e, i in zip(ends, ids)]

    per, counts = [], collections.Counter()
    for t in texts:
        a = pair.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = pair.b.encode(t) if t else []
        raw = (" " + (t or "")).encode()
        if not t or b"".join(pair.a_bytes[i] for i in a) != raw or b"".join(pair.b_bytes[i] for i in b) != raw:
            per.append(None)
            continue
        a, b = spans(a, pair.a_bytes), spans(b, pair.b_bytes)
        links, j = [], 0
        for x, y, i in a:
            while b[j][1] <= x:
                j += 1
            links += [(i, c) for u, _, c in itertools.takewhile(lambda s: s[0] < y, b[j:])]
        ends = sorted({y for _, y, _ in a} & {y for _, y, _ in b})
        groups = ["|".join(",".join(str(i) for _, y, i in side if low < y <= high) for side in (a, b)) for low, high in zip([0, *ends], ends)]
        per.append((len(a), len(b), groups, links))
        counts.update(links)
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    for p in per:
        if p is None:
            yield 0, 0, 0, 0, 0, 0, ""
        else:
            na, nb, groups, links = p
            yield na, nb, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
STRANGE = [
    None, "", "a", " ", "  ", "\n", " \n x", "x\n\ny", "a\tb\r\nc;\r\n  d", "x▁y", "foo ▁ bar baz", "foo bar ▁", "<s> <|endoftext|> </s> <0x0A>", "日本語 テキスト　全角", "é é \xa0 z\x1c q", "a​ b",
    "x" * 5000, " " * 300 + "y" + " " * 200, "foo bar baz", "foo bar baz", "it's we'll  don't\n\n\n end ", "\x00 a\x00", "🙂 🙃🏽 x", "﻿bom", "tab\t\ttab \t x", "1234 5678.90\n- item\n\t* x", " x   y\x85z",
]


@pytest.mark.parametrize("sent", [alignment.SENT_PAIRS, 0])
def test_alignment_of_strange_texts(spark, files, sent):
    df = spark.createDataFrame([(None if i == 2 else i, t, 7, 7, "k", 7) for i, t in enumerate(STRANGE)], "doc_id long, text string, id long, pack long, segment string, n long")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align_documents(df, *files, sent_pairs=sent).collect()}
    assert [got[None if i == 2 else i] for i in range(len(STRANGE))] == [*_brute(STRANGE, files)]
    assert alignment.align_documents(df.where("false"), *files).count() == 0
    assert alignment.align_documents(df.where("text is null"), *files).count() == 1


def test_alignment_of_random_texts_in_many_packs(spark, files, monkeypatch):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a", "Be", " ", "  ", "\n", "\t", "é", "▁x" if rng.random() < 0.02 else "3", ";", "\r", "the ", "日"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    monkeypatch.setattr(alignment, "PACK", 500)
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align_documents(df, *files).collect()}
    assert [got[i] for i in range(len(texts))] == [*_brute(texts, files)]


def test_alignment_query(spark, sf, files):
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' order by doc_id").fetchall()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.op13_tokenizer_alignment(spark, sf).collect()}
    assert [got[d] for d, _ in rows] == [*_brute([t for _, t in rows], files)]


def test_nothing_is_cut_where_merges_could_cross(files):
    with open(files[0], encoding="utf-8") as f, open(files[1], "rb") as g:
        said, pieces = f.read(), g.read()
    pair = alignment.Pair(said, pieces)
    assert pair.starts == " \n\t"
    assert alignment.segmenter(pair.starts)(" a  b\r c\nd ") == [" a", "  b\r c", "\nd "]
    assert pair._starts({"normalizer": {"type": "NFC"}}, []) == "" == pair._starts({"pre_tokenizer": {"type": "ByteLevel", "use_regex": True}}, ["a▁b"])
    assert alignment.segmenter("")(" a b") == [" a b"]
