"""Katz back-off scoring with Good-Turing discounts and exact back-off weights.

The model is a bigram over words, backing off to words and from there to one
unknown word: a seen pair has its discounted relative frequency; an unseen one
the weight of its first word times the probability of the second; the weights
make each distribution sum to one over the vocabulary, the end and the unknown.

The text is kept once, as a table of chunks (some millions of tokens each: the
distinct words as hashes, the texts as numbers of words), bucketed by chunk.

1. Each chunk sends its distinct pairs with their training counts to the
   partition of the first word (very frequent first words are dealt over several
   partitions).  A partition sums the counts and answers each chunk with the
   counts of its pairs and first words: the partitioned tables of the model.
2. Counts of counts give the discounts.  A chunk then knows the probability of
   every word it holds.  For each first word that is followed by something
   unseen anywhere, chunks send the probability mass of the pairs they own (the
   first chunk with a pair owns it), and get back the sum: the weight's
   denominator.
3. Chunks score their texts, token by token, from pair to word to unknown.

Nothing that grows with the data is collected or broadcast; between the steps
only distinct keys travel.

Tokens: words without white space (U+0009 to U+000D, U+0020), A-Z in lower
case, then one end a text.  Cases: null texts count as empty and have the end
alone; a row whose training flag is null isn't learned from; repeated rows are
texts of their own; without training rows every token has the base
probability 1 of the only outcome, the unknown; texts of any length are scored whole; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import partitions, shared_dir, table, written
from .langid import fold_of
from .words import as_bytes, mixed, word_hashes

#: Tokens in a chunk, about; a longer text is a chunk of its own.
CHUNK_TOKENS = 1_000_000
#: Counts up to this one are discounted.
DISCOUNTED = 5
START, END = np.uint64(1), np.uint64(2)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def packed(a: np.ndarray) -> bytes:
    return pa.Codec("zstd", 3).compress(a.tobytes(), asbytes=True) if len(a) else b""


def unpacked(raw: bytes, kind, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, kind)
    return np.frombuffer(pa.Codec("zstd").decompress(raw, n * np.dtype(kind).itemsize, asbytes=True), kind)


def discounts(n: list[int]) -> np.ndarray:
    """Factors of the counts 0 to DISCOUNTED from counts of counts n[1..]:
    Good-Turing's, renormalised so that higher counts stay as they are.  Where
    the counts of counts are too few for a factor in (0, 1), it is (r - 1/2)/r."""
    out = np.ones(DISCOUNTED + 1)
    k = DISCOUNTED
    rest = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (n[r] * r) - rest) / (1 - rest) if n[r] and rest < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class Unigram:
    """Word probabilities from counts of counts: discounted where seen, the
    rest for the unknown word."""

    def __init__(self, n: list[int], total: int, kinds: int):
        self.total, self.kinds, self.d = total, kinds, discounts(n)
        lost = sum((1 - self.d[r]) * r * n[r] for r in range(1, DISCOUNTED + 1))
        # without rare words there is nothing to discount: the unknown counts as seen half a time
        self.scale = 1.0 if lost else total / (total + 0.5)
        self.unknown = lost / total if lost else 0.5 / (total + 0.5) if total else 1.0

    def probability(self, c: np.ndarray) -> np.ndarray:
        d = self.d[np.minimum(c, DISCOUNTED)]
        d[c > DISCOUNTED] = 1.0
        return np.where(c > 0, d * c * self.scale / max(1, self.total), self.unknown)


# ---- chunks ------------------------------------------------------------------


def _chunk_row(ids: list, train: list[bool], docs: list[np.ndarray]) -> tuple:
    lens = np.array([len(d) for d in docs], np.int32)
    flat = np.concatenate(docs)
    vocab, tokens = np.unique(flat, return_inverse=True)
    small = tokens.astype(np.uint32)
    # bytes of equal weight together compress better
    planes = small.view(np.uint8).reshape(-1, 4).T.copy().ravel()
    return ids, train, len(vocab), len(small), packed(lens), vocab.tobytes(), packed(planes)


def _chunks(kind):
    def run(batches):
        ids, train, docs, size = [], [], [], 0

        def row():
            cols = [[x] for x in _chunk_row(ids, train, docs)]
            name = int.from_bytes(uuid.uuid4().bytes[:8], "little", signed=True)
            kinds = [pa.list_(kind), pa.list_(pa.bool_()), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds))], CHUNK_NAMES)

        for batch in batches:
            for id_, text, learn in zip(*(batch.column(i).to_pylist() for i in range(3))):
                w = word_hashes(_LOWER[as_bytes(text or "")])
                w = np.where(w <= END, w + np.uint64(7), w)
                if docs and size + len(w) > CHUNK_TOKENS:
                    yield row()
                    ids, train, docs, size = [], [], [], 0
                ids.append(id_), train.append(bool(learn)), docs.append(np.append(w, END))
                size += len(w) + 1
        if docs:
            yield row()

    return run


CHUNK_NAMES = ["chunk", "ids", "train", "n_vocab", "n_tokens", "lens", "vocab", "tokens"]


class Tokens:
    """A chunk's texts: word numbers, the number before each, and its text."""

    def __init__(self, row: dict):
        self.ids, self.train = row["ids"], np.array(row["train"], bool)
        self.lens = unpacked(row["lens"], np.int32, len(self.train))
        n = row["n_tokens"]
        self.tokens = unpacked(row["tokens"], np.uint8, 4 * n).reshape(4, n).T.copy().view(np.int32).ravel()
        vocab = np.frombuffer(row["vocab"], np.uint64)
        self.vocab = np.append(vocab, START)  # the start is the last number
        self.end = int(np.searchsorted(vocab, END))
        self.first = np.concatenate((self.tokens[-1:], self.tokens[:-1]))
        self.first[np.cumsum(self.lens) - self.lens] = len(vocab)
        self.doc = np.repeat(np.arange(len(self.train), dtype=np.int32), self.lens)


class Chunk(Tokens):
    """A chunk's texts as pairs of word numbers, and its distinct pairs in the
    order in which they travel: by partition, first word, second word."""

    def __init__(self, row: dict, parts: int, hot: np.ndarray):
        super().__init__(row)
        pairs, of = np.unique((self.first.astype(np.int64) << 32) | self.tokens, return_inverse=True)
        counts = np.bincount(of[self.train[self.doc]], minlength=len(pairs))
        number_a, number_b = (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)
        a, b = self.vocab[number_a], self.vocab[number_b]
        route = mixed(a)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, a), len(hot) - 1)
            route = np.where(hot[at] == a, mixed(a ^ mixed(b)), route)
        part = (route % np.uint64(parts)).astype(np.int32)
        order = np.lexsort((b, a, part))
        self.part, self.a, self.b, self.counts = part[order], a[order], b[order], counts[order]
        self.pair_first, self.pair_second = number_a[order], number_b[order]
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.pair_of = place[of]
        new = np.concatenate(([True], (self.part[1:] != self.part[:-1]) | (self.a[1:] != self.a[:-1])))
        self.heads = np.flatnonzero(new)  # where a first word begins, by partition

    def parcels(self):
        """(part, first words, pairs a first word, second words, counts)."""
        if not len(self.heads):
            return
        sizes = np.diff(np.append(self.heads, len(self.a)))
        head_part = self.part[self.heads]
        cuts = np.flatnonzero(np.concatenate(([True], head_part[1:] != head_part[:-1])))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(self.heads))):
            s = self.heads[lo]
            e = self.heads[hi] if hi < len(self.heads) else len(self.a)
            yield int(head_part[lo]), self.a[self.heads[lo:hi]], sizes[lo:hi], self.b[s:e], self.counts[s:e]


def _rows(batches):
    for batch in batches:
        yield from batch.to_pylist()


def _frequent(parts: int):
    """(word, n): a chunk's first words with a large share of its tokens."""

    def run(batches):
        for row in _rows(batches):
            c = Tokens(row)
            n = np.bincount(c.first, minlength=len(c.vocab))
            top = np.flatnonzero(n * 8 * parts >= n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(c.vocab[top].view(np.int64)), pa.array(n[top].astype(np.int64))], ["word", "n"])

    return run


def _send_pairs(parts: int, hot: np.ndarray):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
    names = ["part", "chunk", "n_heads", "n_pairs", "heads", "sizes", "seconds", "counts"]

    def run(batches):
        for row in _rows(batches):
            out = [(p, row["chunk"], len(h), len(s), h.tobytes(), packed(z.astype(np.uint32)), s.tobytes(), packed(c.astype(np.uint32))) for p, h, z, s, c in Chunk(row, parts, hot).parcels()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


PAIRS = "part long, chunk long, n_heads long, n_pairs long, heads binary, sizes binary, seconds binary, counts binary"
ANSWERS = "part long, chunk long, n_heads long, n_pairs long, heads binary, pairs binary, stats array<long>, hot array<long>"


def _sum_pairs(hot: np.ndarray):
    """One partition of the model: sums, and answers to its chunks.

    heads: by first word of a chunk its count, its numbers of second words by
    count 1 to DISCOUNTED, and whether anything unseen follows it; pairs: by pair
    its count, doubled, plus 1 if the chunk owns it."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by("chunk").to_pylist()
        heads = [np.frombuffer(r["heads"], np.uint64) for r in rows]
        sizes = [unpacked(r["sizes"], np.uint32, r["n_heads"]) for r in rows]
        seconds = [np.frombuffer(r["seconds"], np.uint64) for r in rows]
        counts = np.concatenate([unpacked(r["counts"], np.uint32, r["n_pairs"]) for r in rows]).astype(np.int64)
        words, word_of_head = np.unique(np.concatenate(heads), return_inverse=True)
        word = np.repeat(word_of_head, np.concatenate(sizes))
        second = np.concatenate(seconds)
        order = np.lexsort((second, word))
        new = np.concatenate(([True], (word[order][1:] != word[order][:-1]) | (second[order][1:] != second[order][:-1])))
        pair = np.empty(len(order), np.int64)
        pair[order] = np.cumsum(new) - 1
        total = np.bincount(pair, counts, minlength=int(new.sum())).astype(np.int64)
        first = word[order][new]
        learned = np.flatnonzero(counts > 0)
        owner = np.zeros(len(counts), np.int64)
        owner[learned[np.unique(pair[learned], return_index=True)[1]]] = 1
        c1 = np.bincount(first, total, minlength=len(words)).astype(np.int64)
        by = [np.bincount(first[total == r], minlength=len(words)) for r in range(1, DISCOUNTED + 1)]
        unseen = np.bincount(first[total == 0], minlength=len(words)) > 0
        facts = np.stack([c1, *by, unseen]).astype(np.uint32)
        is_hot = np.isin(words, hot)
        is_word = ~is_hot & (words != START)
        n = [int((total == r).sum()) for r in range(1, DISCOUNTED + 2)] + [int((c1[is_word] == r).sum()) for r in range(1, DISCOUNTED + 2)]
        n += [int((c1[is_word] > 0).sum()), int(c1[is_word].sum()), int(c1[words == START].sum()) if not is_hot[words == START].any() else 0]
        extra = np.concatenate([words[is_hot].view(np.int64)[None], facts[:-1, is_hot].astype(np.int64)]).T.ravel().tolist()
        out, h, p = [], 0, 0
        for k, r in enumerate(rows):
            own = facts[:, word_of_head[h : h + r["n_heads"]]]
            got = (total[pair[p : p + r["n_pairs"]]] << 1) | owner[p : p + r["n_pairs"]]
            out.append((r["part"], r["chunk"], r["n_heads"], r["n_pairs"], packed(own.ravel()), packed(got.astype(np.uint32)), None if k else n, None if k else extra))
            h, p = h + r["n_heads"], p + r["n_pairs"]
        kinds = [pa.int64()] * 4 + [pa.binary()] * 2 + [pa.list_(pa.int64())] * 2
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["part", "chunk", "n_heads", "n_pairs", "heads", "pairs", "stats", "hot"])

    return run


class Scored(Chunk):
    """A chunk with the model's answers: all but the back-off weights."""

    def __init__(self, row: dict, parts: int, model: dict):
        hot = model["hot_words"]
        super().__init__(row, parts, hot)
        answers = sorted(row["answers"], key=lambda r: r["part"])
        facts = [unpacked(r["heads"], np.uint32, (DISCOUNTED + 2) * r["n_heads"]).reshape(DISCOUNTED + 2, -1) for r in answers]
        facts = np.concatenate(facts, 1).astype(np.int64) if facts else np.zeros((DISCOUNTED + 2, 0), np.int64)
        got = np.concatenate([unpacked(r["pairs"], np.uint32, r["n_pairs"]) for r in answers] or [np.empty(0, np.uint32)]).astype(np.int64)
        if facts.shape[1] != len(self.heads) or len(got) != len(self.a):
            raise RuntimeError("a chunk's answers are incomplete")
        self.c2, self.owned = got >> 1, (got & 1).astype(bool)
        number = self.pair_first[self.heads]  # a hot word has several heads, with the same facts
        self.facts = np.zeros((DISCOUNTED + 2, len(self.vocab)), np.int64)
        self.facts[:, number] = facts
        if len(hot):
            at = np.minimum(np.searchsorted(hot, self.vocab), len(hot) - 1)
            is_hot = hot[at] == self.vocab
            self.facts[:-1, is_hot] = model["hot_facts"][:, at[is_hot]]
            self.facts[-1, is_hot] = 1
        self.c1 = self.facts[0]
        self.cw = self.c1.copy()
        self.cw[self.end] = model["docs"]
        self.p = model["unigram"].probability(self.cw)
        # first words whose weight some text needs, and the mass that this chunk owns of each
        self.mass = np.bincount(self.pair_first[self.owned], self.p[self.pair_second[self.owned]], minlength=len(self.vocab))
        asked = np.zeros(len(self.vocab), bool)
        asked[self.pair_first[self.c2 == 0]] = True
        self.asked = asked & (self.c1 > 0)
        self.sent = np.flatnonzero(self.asked | ((self.mass > 0) & (self.facts[-1] > 0)))
        part = (mixed(self.vocab[self.sent]) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((self.vocab[self.sent], part))
        self.sent, self.sent_part = self.sent[order], part[order]

    def masses(self):
        for p in np.unique(self.sent_part):
            own = self.sent[self.sent_part == p]
            yield int(p), self.vocab[own], self.mass[own], self.asked[own]

    def result(self, model: dict, sums: list[dict]) -> list[np.ndarray]:
        """By text: tokens, known tokens, base score, score."""
        below = np.ones(len(self.vocab))
        got = [unpacked(r["sums"], np.float64, r["n"]) for r in sorted(sums, key=lambda r: r["part"])]
        got = np.concatenate(got) if got else np.empty(0)
        asked = self.sent[self.asked[self.sent]]
        if len(got) != len(asked):
            raise RuntimeError("a chunk's back-off sums are incomplete")
        below[asked] = 1.0 - got
        d = model["d"]
        lost = sum((1 - d[r]) * r * self.facts[r] for r in range(1, DISCOUNTED + 1)) / np.maximum(1, self.c1)
        # a context whose pairs are all frequent gives up nothing by Good-Turing: half a count is taken from it
        lost = np.where(lost > 0, lost, 0.5 / np.maximum(1, self.c1))
        whole = sum((1 - d[r]) * r * self.facts[r] for r in range(1, DISCOUNTED + 1)) > 0
        alpha = np.where(self.c1 > 0, lost / np.maximum(below, 1e-300), 1.0)
        c2, c1 = self.c2, self.c1[self.pair_first]
        dd = d[np.minimum(c2, DISCOUNTED)].copy()
        dd[c2 > DISCOUNTED] = 1.0
        keep = np.where(whole[self.pair_first], 1.0, 1.0 - lost[self.pair_first])
        seen = dd * c2 / np.maximum(1, c1) * keep
        with np.errstate(divide="ignore"):
            logp = np.where(c2 > 0, np.log10(seen), np.log10(alpha[self.pair_first] * self.p[self.pair_second]))
        u = model["unigram"]
        base = np.log10((self.cw + 1) / (u.total + 1 * (u.kinds + 1)))
        n = len(self.lens)
        return [
            self.lens.astype(np.int64), np.bincount(self.doc, self.cw[self.tokens] > 0, minlength=n).astype(np.int64),
            np.bincount(self.doc, base[self.tokens], minlength=n), np.bincount(self.doc, logp[self.pair_of], minlength=n),
        ]


def _send_masses(parts: int, model):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches):
        for row in _rows(batches):
            out = [(p, row["chunk"], len(w), w.tobytes(), m.tobytes(), packed(a)) for p, w, m, a in Scored(row, parts, model.value).masses()]
            cols = [*zip(*out)] or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["part", "chunk", "n", "words", "mass", "asked"])

    return run


def _sum_masses(group: pa.Table) -> pa.Table:
    rows = group.sort_by("chunk").to_pylist()
    words, of = np.unique(np.concatenate([np.frombuffer(r["words"], np.uint64) for r in rows]), return_inverse=True)
    total = np.bincount(of, np.concatenate([np.frombuffer(r["mass"], np.float64) for r in rows]), minlength=len(words))
    out, at = [], 0
    for r in rows:
        mine = total[of[at : at + r["n"]]][unpacked(r["asked"], bool, r["n"])]
        out.append((r["part"], r["chunk"], len(mine), packed(mine)))
        at += r["n"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["part", "chunk", "n", "sums"])


def _score(parts: int, model, kind):
    def run(batches):
        for row in _rows(batches):
            c = Scored(row, parts, model.value)
            got = c.result(model.value, row["sums"] or [])
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], kind), *(pa.array(g) for g in got)], ["id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all texts under the model of the rows where ``learn`` holds:
    id, n_tokens, n_known, train_tokens, base_score (add-one words) and score,
    both sums of log10 probabilities."""
    spark = df.sparkSession
    parts = partitions(spark)
    kind = df.schema[id_col].dataType.simpleString()
    arrow_kind = to_arrow_type(df.schema[id_col].dataType)
    cut = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    made = cut.mapInArrow(_chunks(arrow_kind), f"chunk long, ids array<{kind}>, train array<boolean>, n_vocab long, n_tokens long, lens binary, vocab binary, tokens binary")
    name = f"katz_chunks_{uuid.uuid4().hex}"
    made.write.option("path", f"{shared_dir(spark)}/{name}").bucketBy(parts, "chunk").format("parquet").saveAsTable(name)
    chunks = spark.table(name)

    often = chunks.mapInArrow(_frequent(parts), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    tokens = chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    hot = np.sort(np.array([r["word"] for r in often.where(F.col("n") * (4 * parts) >= tokens).collect()], np.int64).view(np.uint64)) if tokens else np.empty(0, np.uint64)
    sent = chunks.mapInArrow(_send_pairs(parts, hot), PAIRS)
    answers = written(sent.groupBy("part").applyInArrow(_sum_pairs(hot), ANSWERS), "katz-pairs")

    model = _model(answers, hot)
    shared = spark.sparkContext.broadcast(model)
    back = answers.groupBy(F.col("chunk").alias("c")).agg(F.collect_list(F.struct("part", "n_heads", "n_pairs", "heads", "pairs")).alias("answers"))
    known = chunks.join(back, F.col("chunk") == F.col("c")).drop("c")
    masses = known.mapInArrow(_send_masses(parts, shared), "part long, chunk long, n long, words binary, mass binary, asked binary")
    sums = written(masses.groupBy("part").applyInArrow(lambda t: _sum_masses(t), "part long, chunk long, n long, sums binary"), "katz-weights")
    sums = sums.groupBy(F.col("chunk").alias("c")).agg(F.collect_list(F.struct("part", "n", "sums")).alias("sums"))
    ready = known.join(sums, F.col("chunk") == F.col("c"), "left").drop("c")
    out = ready.mapInArrow(_score(parts, shared, arrow_kind), f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(model["unigram"].total).cast("long").alias("train_tokens"), "base_score", "score")


def _model(answers: DataFrame, hot: np.ndarray) -> dict:
    """What all chunks share, of fixed size: counts of counts, totals, and the
    facts of the few words that were dealt over several partitions."""
    size = 2 * (DISCOUNTED + 1) + 3
    stats = answers.where("stats is not null").agg(*(F.coalesce(F.sum(F.get("stats", F.lit(i))), F.lit(0)).alias(f"s{i}") for i in range(size))).first()
    step = DISCOUNTED + 2
    rows = answers.where("size(hot) > 0").select(F.posexplode("hot").alias("i", "x"), "part")
    rows = rows.groupBy("part", F.floor(F.col("i") / step).alias("k")).agg(*(F.max(F.when(F.col("i") % step == j, F.col("x"))).alias(f"f{j}") for j in range(step)))
    facts = {r["f0"]: [r[f"s{j}"] for j in range(1, step)] for r in rows.groupBy("f0").agg(*(F.sum(f"f{j}").alias(f"s{j}") for j in range(1, step))).collect()}
    hot_facts = np.array([facts.get(w, [0] * (step - 1)) for w in hot.view(np.int64).tolist()], np.int64).T.reshape(step - 1, len(hot))
    bi = [0, *(stats[f"s{i}"] for i in range(DISCOUNTED + 1))]
    uni = [0, *(stats[f"s{i}"] for i in range(DISCOUNTED + 1, 2 * (DISCOUNTED + 1)))]
    kinds, total, docs = (stats[f"s{i}"] for i in range(size - 3, size))
    start = hot == START
    if start.any():
        docs = int(hot_facts[0, start][0])
    word = hot_facts[0][~start] if len(hot) else np.empty(0, np.int64)
    kinds, total = kinds + int((word > 0).sum()), total + int(word.sum())
    for c in [*word.tolist(), docs]:  # the end is a token as well
        if 0 < c <= DISCOUNTED + 1:
            uni[c] += 1
    kinds, total = kinds + (docs > 0), total + docs
    return {"hot_words": hot, "hot_facts": hot_facts, "docs": docs, "d": discounts(bi), "unigram": Unigram(uni, int(total), int(kinds))}


def op7_katz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from those not in fold 2 of 7."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, F.coalesce(fold_of("doc_id", 7), F.lit(0)) != 2)
    return out.select("doc_id", F.coalesce(fold_of("doc_id", 7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
