"""Audit of how the sources of a language differ in their words.

Every group (language, source) and every language gives each kept term of the
language a probability, in parts of 10^9 and with ``ADDED`` occurrences added;
the audit reports the distance of each two groups of a language and, for each
group, the terms that it uses more than its language does.

Terms are found and counted on whole Arrow buffers (``terms``): occurrences are
ordered by the xxhash of group and term, runs of one hash are compared byte by
byte, and each run gives a count and a number of documents.  Spark adds these
up, first by group and term, so that a frequent term is spread by its sources,
then by term, where each row is one source.  The kept cells are dealt to blocks
by term; a block becomes a sparse matrix of groups by terms, and distances are
sums over its rows (``add.reduceat``) that Spark adds up over the blocks.

Cases: null text, language and source count as empty text; a group without a
kept term gives all terms the same probability; a language without kept terms
has distances of 0 and no terms; repeated rows count as documents of their own;
an empty table gives an empty table; other columns are ignored.  Numbers are
exact while a language has fewer than 9 * 10^15 occurrences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import table, written
from .terms import Terms, packed

ADDED = 5
MIN_DOCS = 30
TOP = 50
#: Bytes of text whose terms are counted together in a task.
PIECE = 12 << 20
#: Cells of a block, at least and at most; between them the square of the number of sources.
CELLS = (50_000, 4_000_000)


def probability(count: np.ndarray, total, terms) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), by long division."""
    rest, whole = np.broadcast_arrays(np.asarray(count, np.int64) + ADDED, np.maximum(np.asarray(total, np.int64) + ADDED * np.asarray(terms, np.int64), 1))
    out = np.zeros(rest.shape, np.int64)
    for _ in range(3):
        out = out * 1000 + rest * 1000 // whole
        rest = rest * 1000 % whole
    return out + 1


def _group_numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row's (language, source), and a row of each number."""
    lang, source = (batch.column(i).dictionary_encode() for i in (0, 1))
    both = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    _, rows, numbers = np.unique(both, return_index=True, return_inverse=True)
    return numbers, rows


def count_terms(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of a batch of (lang, source, text), and a
    row of the empty term for each group."""
    group, of_group = _group_numbers(batch)
    found = Terms(batch.column(2))
    owner = group[found.row]
    h = found.hashes() ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(h, kind="stable")
    a, b = order[:-1], order[1:]
    alike = h[a] == h[b]
    exact = alike & (owner[a] == owner[b])
    exact[exact] = found.same(a[exact], b[exact])
    if (exact != alike).any():  # different terms of one hash: their bytes number them
        bad = np.flatnonzero(np.isin(h, h[a[exact != alike]]))
        said, numbers = found.data.tobytes(), {}
        for i in bad.tolist():
            numbers.setdefault((int(owner[i]), said[found.starts[i] : found.ends[i]]), []).append(i)
        order = np.concatenate([order[~np.isin(order, bad)], *(np.array(x) for x in numbers.values())]).astype(np.int64)
        a, b = order[:-1], order[1:]
        exact = (h[a] == h[b]) & (owner[a] == owner[b])
        exact[exact] = found.same(a[exact], b[exact])
    if len(order):
        first = np.flatnonzero(np.concatenate(([True], ~exact)))
        n = np.diff(np.append(first, len(order)))
        fresh = np.concatenate(([True], ~exact | (found.row[a] != found.row[b])))
        docs = np.add.reduceat(fresh.astype(np.int64), first)
        term = order[first]
    else:
        term, n, docs = (np.empty(0, np.int64) for _ in range(3))
    rows = pa.array(np.concatenate((of_group[owner[term]], of_group)))
    zeros = np.zeros(len(of_group), np.int64)
    words = pa.concat_arrays([found.strings(term), pa.array([""] * len(of_group), pa.string())])
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(rows), batch.column(1).take(rows), words, pa.array(np.concatenate((n, zeros))), pa.array(np.concatenate((docs, zeros)))], ["lang", "source", "term", "n", "docs"]
    )


def cells(df: DataFrame, text: Column, lang: Column, source: Column, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, of_lang) of the kept terms, with one row of the
    empty term for each group."""

    def run(batches):
        for piece in packed(batches, 2, PIECE):
            yield count_terms(piece)

    texts = df.select(*(F.coalesce(c.cast("string"), F.lit("")).alias(k) for c, k in ((lang, "lang"), (source, "source"), (text, "text"))))
    found = texts.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    counts = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    seen = counts.select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("of_lang"), F.sum("docs").over(of_term).alias("seen"))
    return seen.where((F.col("seen") >= min_docs) | (F.col("term") == "")).drop("seen")


def compare(block: pa.Table, top: int = TOP) -> pa.Table:
    """The share of one block of terms in the distances of all ordered pairs of
    groups, and each group's leading terms of the block.  Rows without a term
    are the groups with their totals."""
    heads = block.filter(pc.is_null(block["term"]))
    body = block.filter(pc.is_valid(block["term"]))
    names = heads["source"].combine_chunks()
    total, terms, whole = (heads[c].to_numpy() for c in ("total", "terms", "whole"))
    source = pc.index_in(body["source"].combine_chunks(), names).to_numpy(zero_copy_only=False).astype(np.int64)
    by = np.argsort(source, kind="stable")
    source = source[by]
    coded = body["term"].combine_chunks().dictionary_encode()
    column = coded.indices.to_numpy()[by].astype(np.int64)
    word = coded.dictionary
    p = probability(body["n"].to_numpy()[by], total[source], terms[0])
    q = probability(body["of_lang"].to_numpy()[by], whole[0], terms[0])
    none = probability(np.zeros(len(names), np.int64), total, terms)
    bounds = np.searchsorted(source, np.arange(len(names) + 1))
    filled = np.flatnonzero(np.diff(bounds))
    lang = block["lang"][0].as_py()
    pairs = []
    for k in range(len(names)):
        dense = np.full(len(word), none[k])
        dense[column[bounds[k] : bounds[k + 1]]] = p[bounds[k] : bounds[k + 1]]
        ordered = np.sort(dense)
        sums = np.concatenate(([0], np.cumsum(ordered)))
        below = np.searchsorted(ordered, none)
        value = none * (2 * below - len(word)) + sums[-1] - 2 * sums[below]  # as if the other group had no term
        if len(filled):
            there = dense[column]
            value[filled] += np.add.reduceat(np.abs(p - there) - np.abs(none[source] - there), bounds[filled])
        other = np.delete(np.arange(len(names)), k)
        pairs.append((np.full(len(other), k), other, value[other]))
    left, right, far = (np.concatenate(x).astype(np.int64) for x in zip(*pairs))
    rank = np.empty(len(word), np.int64)
    rank[pc.array_sort_indices(word.cast(pa.binary())).to_numpy()] = np.arange(len(word))
    over = np.flatnonzero(p > q)
    over = over[np.lexsort((rank[column[over]], q[over] - p[over], source[over]))]
    place = np.arange(len(over)) - np.searchsorted(source[over], source[over])
    over = over[place < top]
    owner = pa.array(np.concatenate((left, source[over])))
    return pa.table({
        "lang": pa.array([lang] * len(owner), pa.string()), "source": names.take(owner),
        "part": pa.array(["pair"] * len(left) + ["term"] * len(over), pa.string()),
        "item": pa.concat_arrays([names.take(pa.array(right)), word.take(pa.array(column[over]))]),
        "value": pa.array(np.concatenate((far, (p - q)[over]))),
    })


def audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group its distance to
    each other group of the language, and its ``top`` leading terms."""
    kept = written(cells(df, F.col(text_col), F.col(lang_col), F.col(source_col), min_docs), "divergence-cells")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = kept.groupBy("lang").agg(F.countDistinct(F.when(F.col("term") != "", F.col("term"))).alias("terms"), F.sum("n").alias("whole"), F.sum((F.col("term") == "").cast("long")).alias("groups"))
    groups = written(totals.join(of_lang, "lang"), "divergence-groups")
    n, most = kept.count(), groups.agg(F.max("groups")).first()[0] or 0
    blocks = max(1, -(-n // min(max(most * most, CELLS[0]), CELLS[1])))
    body = kept.where("term <> ''").select("lang", "source", "term", "n", "of_lang", *(F.lit(None).cast("long").alias(c) for c in ("total", "terms", "whole")), F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"))
    heads = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), *(F.lit(None).cast("long").alias(c) for c in ("n", "of_lang")), "total", "terms", "whole", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    shares = body.unionByName(heads).groupBy("lang", "block").applyInArrow(lambda t: compare(t, top), "lang string, source string, part string, item string, value long")
    found = shares.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return found.withColumn("rank", place).where((F.col("part") == "pair") | (F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: distances of the sources of each language, leading terms."""
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
t AS (SELECT lang, source, sum(c) AS n FROM n GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(n.c, 0) AS c, 1 + CAST(1000000000 * CAST(coalesce(n.c, 0) + 5 AS HUGEINT) // CAST(coalesce(t.n, 0) + 5 * v.v AS HUGEINT) AS BIGINT) AS p,
  1 + CAST(1000000000 * CAST(k.c + 5 AS HUGEINT) // CAST(v.n + 5 * v.v AS HUGEINT) AS BIGINT) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT lang, source, 'pair' AS part, item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM pairs LEFT JOIN far USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
