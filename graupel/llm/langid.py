"""Language identification with interpolated Kneser-Ney character models.

Texts become sequences of letter symbols (case folded, every run of other
characters one blank).  For each language a model of order ``ORDER`` is
estimated from n-gram counts and kept, all languages together, in sorted
arrays of packed n-grams with one column of log-probabilities a language and
one of back-off weights.  A text gets the language of lowest cross-entropy,
normalised by its length; a text whose best model fits it no better than that
model fits labelled texts of other languages is rejected.

Training takes at most about ``per_lang`` texts a language, chosen by a hash of
their id (a documented bound: a classifier may be fitted on a sample); the
prediction covers all texts, whole.

Cases: a text that is null or has no letter gets ``und`` and score 0 and is
rejected; rows whose label is null are never learned from but are predicted;
equal texts get equal predictions; with no labelled row every text is ``und``;
an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import slices, table

ORDER = 5
BITS = 6
BLANK, OTHER, FIRST = 0, 1, 2
UNKNOWN = "und"


@lru_cache(2)
def _classes(letters: str) -> np.ndarray:
    """Code point to symbol: blank, other letter, or one of ``letters``."""
    of = np.zeros(0x110000, np.uint8)
    at = {c: i + FIRST for i, c in enumerate(letters)}
    for cp in range(0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        if c.isalpha():
            of[cp] = at.get(c.lower(), OTHER)
    return of


def symbols(text: str, classes: np.ndarray) -> np.ndarray:
    """The symbols of a text: one blank before, between and after its words."""
    got = classes[np.frombuffer(text.encode("utf-32-le"), "<u4")]
    got = np.concatenate(([0], got, [0]))
    return got[np.concatenate(([True], (got[1:] != 0) | (got[:-1] != 0)))]


def grams(seq: np.ndarray, order: int) -> np.ndarray:
    """Packed n-grams that end at each symbol but the first; before the text
    there are blanks."""
    wide = np.concatenate((np.zeros(order - 2, np.int64), seq.astype(np.int64)))
    n = len(seq) - 1
    code = np.zeros(n, np.int64)
    for i in range(order):
        code = (code << BITS) | wide[i : i + n]
    return code


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


class Model:
    """Sorted arrays by order: n-grams with log-probabilities, contexts with
    the logarithm of the weight of the lower order; a column a language."""

    def __init__(self, langs: list[str], letters: str, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        self.langs, self.letters, self.order = langs, letters, order
        self.n_symbols = len(letters) + FIRST
        self.scale, self.limits = 1.0, np.full((len(langs), 2), np.inf)
        tables = [self._counted(*counts[x]) for x in langs]
        self.keys, self.logp, self.ctx, self.weight = [None], [None], [None], [None]
        if not langs:
            return
        for m in range(1, order + 1):
            keys = np.unique(np.concatenate([t[m][0] for t in tables]))
            ctx = np.unique(keys >> BITS)
            logp = np.empty((len(keys), len(langs)), np.float32)
            weight = np.zeros((len(ctx), len(langs)), np.float32)
            for k, t in enumerate(tables):
                own, n = t[m]
                one, two = (n == 1).sum(), (n == 2).sum()
                d = one / (one + 2 * two) if one and two else 0.5
                heads, first = np.unique(own >> BITS, return_index=True)
                total = np.add.reduceat(n, first).astype(float)
                kinds = np.diff(np.append(first, len(own)))
                gamma = d * kinds / total
                at, ok = _find(heads, ctx)
                weight[ok, k] = np.log(gamma[at[ok]])
                lower = self._lower(keys, m, k)
                head, seen = _find(heads, keys >> BITS)
                p = np.where(seen, gamma[head], 1.0) * lower
                spot, there = _find(own, keys)
                p[there] += (n[spot[there]] - d) / total[head[there]]
                logp[:, k] = np.log(p)
            self.keys.append(keys), self.logp.append(logp), self.ctx.append(ctx), self.weight.append(weight)

    def _counted(self, codes: np.ndarray, n: np.ndarray) -> list:
        """By order: sorted n-grams with counts; below the highest order the
        counts are of distinct symbols before the n-gram."""
        by = np.argsort(codes)
        out = [None] * (self.order + 1)
        out[self.order] = codes[by], n[by].astype(np.int64)
        for m in range(self.order - 1, 0, -1):
            out[m] = np.unique(out[m + 1][0] & ((1 << BITS * m) - 1), return_counts=True)
        return out

    def _lower(self, keys: np.ndarray, m: int, k: int) -> np.ndarray:
        if m == 1:
            return np.full(len(keys), 1.0 / self.n_symbols)
        return np.exp(self.log_prob(keys & ((1 << BITS * (m - 1)) - 1), m - 1)[:, k].astype(float))

    def log_prob(self, codes: np.ndarray, m: int) -> np.ndarray:
        """Log-probability of the last symbol of each n-gram after the others,
        in every language."""
        if m == 0:
            return np.full((len(codes), len(self.langs)), -np.log(self.n_symbols), np.float32)
        at, ok = _find(self.keys[m], codes)
        out = self.logp[m][at]
        if not ok.all():
            miss = np.flatnonzero(~ok)
            less = codes[miss]
            back = self.log_prob(less & ((1 << BITS * (m - 1)) - 1), m - 1)
            head, seen = _find(self.ctx[m], less >> BITS)
            back[seen] += self.weight[m][head[seen]]
            out[miss] = back
        return out

    def entropy(self, text: str, classes: np.ndarray) -> tuple[np.ndarray, int] | None:
        """Cross-entropy a symbol in each language, and the number of symbols;
        None for a text without letters."""
        seq = symbols(text, classes)
        if not seq.any():
            return None
        total = np.zeros(len(self.langs))
        codes = grams(seq, self.order)
        for i in range(0, len(codes), 1 << 18):  # whole text, in pieces that fit the cache
            total -= self.log_prob(codes[i : i + (1 << 18)], self.order).sum(0, dtype=float)
        return total / len(codes), len(codes)

    def judge(self, found) -> tuple[str, float, bool]:
        """(language, score, accepted)."""
        if found is None or not self.langs:
            return UNKNOWN, 0.0, False
        h, n = found
        best = int(h.argmin())
        score = 1.0 / float(np.exp(-self.scale * (h - h[best])).sum())
        mean, spread = self.limits[best]
        return self.langs[best], score, bool(h[best] <= mean + spread * max(1.0, (300 / n) ** 0.5))


def labelled(learn: Column, lang: str) -> Column:
    return learn & F.col(lang).isNotNull()


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400, order: int = ORDER, tolerance: float = 4.0) -> Model:
    """A model of all languages of ``df`` from about ``per_lang`` hashed texts
    each.  A fifth of them (of languages with 20 texts or more) isn't counted but calibrates the score's scale and
    the cross-entropy beyond which a text is rejected: where the model fits it
    no better than it fits texts of other languages, with ``tolerance``
    standard deviations more for short texts."""
    spark = df.sparkSession
    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.lit(7)).alias("h")).where("lang is not null and text is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], "", {}, order)
    langs = sorted(sizes)
    share = F.create_map(*(F.lit(x) for k in langs for x in (k, min(1.0, per_lang / sizes[k]))))
    point = (F.col("h").bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)).alias("u")
    drawn = rows.select("text", "lang", point, (F.col("lang").isin([k for k in langs if sizes[k] >= 20]) & (F.shiftrightunsigned("h", 40) % 5 == 0)).alias("checks")).where(F.col("u") < share[F.col("lang")])

    def letters_of(batches):
        for batch in batches:
            seen: dict[str, int] = {}
            for text in batch.column(0).to_pylist():
                u, n = np.unique(np.frombuffer(text.encode("utf-32-le"), "<u4"), return_counts=True)
                for c, k in zip(u.tolist(), n.tolist()):
                    if chr(c).isalpha() and len(low := chr(c).lower()) == 1:
                        seen[low] = seen.get(low, 0) + k
            yield pa.RecordBatch.from_arrays([pa.array([*seen], pa.string()), pa.array([*seen.values()], pa.int64())], ["c", "n"])

    found = drawn.select("text").mapInArrow(letters_of, "c string, n long").groupBy("c").agg(F.sum("n").alias("n"))
    most = found.orderBy(F.desc("n"), "c").limit((1 << BITS) - FIRST).collect()
    letters = "".join(sorted(r["c"] for r in most))

    def counts_of(batches):
        classes = _classes(letters)
        for batch in batches:
            langs_, codes_, n_ = [], [], []
            of = np.array(batch.column(1).to_pylist(), object)
            texts = batch.column(0).to_pylist()
            for lang in sorted(set(of)):
                own = [grams(s, order) for t in np.flatnonzero(of == lang) if (s := symbols(texts[t], classes)).any()]
                if own:
                    codes, n = np.unique(np.concatenate(own), return_counts=True)
                    langs_ += [lang] * len(codes)
                    codes_.append(codes), n_.append(n)
            if codes_:
                yield pa.RecordBatch.from_arrays([pa.array(langs_, pa.string()), pa.array(np.concatenate(codes_)), pa.array(np.concatenate(n_))], ["lang", "code", "n"])

    counted = drawn.where("not checks").select("text", "lang").mapInArrow(counts_of, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    counts = {k: (g["code"].to_numpy(), g["n"].to_numpy()) for k, g in counted.groupby("lang")}
    model = Model([x for x in langs if x in counts], letters, counts, order)
    if not model.langs:
        return model
    shared = spark.sparkContext.broadcast(model)

    def entropies(batches):
        model = shared.value
        classes = _classes(model.letters)
        for batch in batches:
            got = [(lang, e[0].tolist()) for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (e := model.entropy(text, classes)) and e[1] >= 200]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.float64()))], ["lang", "h"])

    held = drawn.where("checks").select("text", "lang").mapInArrow(entropies, "lang string, h array<double>").toPandas()
    held = held[held["lang"].isin(model.langs)]
    if len(held):
        h = np.stack(held["h"].to_list())
        true = held["lang"].map(model.langs.index).to_numpy()
        own = h[np.arange(len(h)), true]
        scales = 2.0 ** np.arange(0, 9)
        loss = [np.log(np.exp(-s * (h - own[:, None])).sum(1)).mean() for s in scales]
        model.scale = float(scales[int(np.argmin(loss))])
        for k in range(len(model.langs)):
            mine = own[true == k] if (true == k).sum() >= 5 else own
            slack = tolerance * max(float(mine.std()), 0.05)
            foreign = h[true != k, k]
            far = float(np.median(foreign)) if len(foreign) >= 5 else float(np.median(mine)) + 5 * slack
            model.limits[k] = max(far, float(np.median(mine)) + slack) - slack, slack
    shared.unpersist()
    return model


def identify(df: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``lang_pred``, ``score`` and ``accepted``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        classes = _classes(model.letters)
        for batch in slices(batches):
            got = [model.judge(model.entropy(t, classes) if t and model.langs else None) for t in batch.column(at).to_pylist()]
            new = [pa.array([g[i] for g in got], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *new], [*batch.schema.names[: len(keep)], "lang_pred", "score", "accepted"])

    read = [*keep] if text_col in keep else [*keep, text_col]
    at = read.index(text_col)
    cut = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(read)))
    kinds = "".join(f"k{i} {df.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    out = cut.mapInArrow(run, f"{kinds}lang_pred string, score double, accepted boolean")
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score", "accepted")


def fold_of(id_col: str, n: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; learned from the labelled ones of folds 0 and 2 of 3."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(F.coalesce(fold_of("doc_id", 3), F.lit(0)) != 1))
    return identify(docs.withColumn("held_out", F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False))), model, keep=("doc_id", "held_out"))
