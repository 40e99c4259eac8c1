"""Document fingerprints by consistent weighted sampling, in DataFrame
operations only.

A document is a weighted set: its lower-case words (split at white space) with
their counts.  Each of ``SAMPLES`` samples draws for a word of weight S, from
hashes of the word and the sample's number, r and c of Gamma(2, 1) and b of
U(0, 1); with t = floor(ln S / r + b) it keeps the word of the least
ln c - r (t - b + 1), together with t.  Two documents keep the same (word, t)
with probability equal to the generalised Jaccard similarity of their weights.

Rows stay where they are between the shuffle that puts documents in order and
the result: words are exploded, counted and sampled within the partition, each
word and count once for all texts of a block.

Cases: null texts count as empty; a text without words has the empty
fingerprint, which is like itself (1) and unlike any other (0); repeated rows
are documents of their own, next to each other; equal texts have equal
fingerprints; texts of any length are used whole; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import partitions, table

#: Samples of a fingerprint: the likeness of two has a standard error of at most 0.5 / sqrt(SAMPLES).
SAMPLES = 64
NAME_BITS = 28
BLOCK_BITS = 16


def _uniform(h: Column, shift: int, bits: int) -> Column:
    """A number in (0, 1) from some bits of a hash."""
    part = F.shiftrightunsigned(h, shift) if shift + bits == 64 else F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1))
    return (part.cast("double") + 0.5) * 2.0**-bits


def _samples(term: Column, log_weight: Column) -> list[Column]:
    """For each sample the word's candidate: an order-preserving number of its
    value in the high bits, an identity of (word, t) in the low ones."""
    out = []
    for k in range(SAMPLES):
        h, g = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
        r = -F.ln(_uniform(h, 32, 32) * _uniform(h, 0, 32))
        ln_c = F.ln(-F.ln(_uniform(g, 40, 24) * _uniform(g, 16, 24)))
        b = _uniform(g, 0, 16)
        t = F.floor(log_weight / r + b)
        value = ln_c - r * (t - b + 1.0)
        rank = ((value + 512.0) * float(1 << 24)).cast("long")
        name = (h.bitwiseAND(F.lit((1 << NAME_BITS) - 1)) + t * 2654435).bitwiseAND(F.lit((1 << NAME_BITS) - 1))
        out.append(F.shiftleft(rank, NAME_BITS).bitwiseOR(name))
    return out


def fingerprints(df: DataFrame, keys: list[str], text_col: str, within: list[str] | None = None) -> DataFrame:
    """``keys`` and ``signature`` (array<int>) of each row that has a word;
    ``keys`` name a row.  Rows that are partitioned by some of the keys already
    aren't moved.  A draw depends on a word and its count alone: rows that are
    equal in ``within`` (some of the keys) share the draws of equal ones, whose
    rows are gathered in one array; so these keys should name thousands of rows,
    not millions."""
    words = df.select(*keys, F.explode(F.split(F.lower(F.col(text_col)), r"\s+")).alias("word")).where("word <> ''")
    terms = words.select(*keys, F.xxhash64("word").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))
    draws = [x.alias(f"s{k}") for k, x in enumerate(_samples(F.col("term"), F.ln(F.col("n").cast("double"))))]
    names = [f"s{k}" for k in range(SAMPLES)]
    if within is None:
        drawn = terms.select(*keys, *draws)
    else:
        # the draws are results of the grouping, made before its rows are dealt out
        # again; the term comes first, as sorting is by the leading key's bits
        drawn = terms.groupBy("term", "n", *within).agg(F.collect_list(F.struct(*(x for x in keys if x not in within))).alias("rows"), *draws)
        drawn = drawn.select(*within, F.explode("rows").alias("row"), *names).select(*within, "row.*", *names)
    mixed = [F.pmod(F.xxhash64(s), F.lit(65536)).cast("int") for s in names]
    return drawn.groupBy(*keys).agg(*(F.min(s).alias(s) for s in names)).select(*keys, F.array(*mixed).alias("signature"))


def said(signature: Column) -> Column:
    """The signature as hexadecimal text."""
    return F.lower(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples: an estimate of generalised Jaccard similarity."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)).cast("double") / float(SAMPLES)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(same)


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (part, at, id, text, own): the documents by descending id, cut into
    parts at quantiles of the id; ``at`` counts within a part.  The last row of
    each part, not its own, is a copy of the next part's first document (of the
    first part's, at the end), so every document meets its successor without
    one task seeing all."""
    spark = docs.sparkSession
    cut = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = max(1, 2 * partitions(spark))
    marks = cut.select(F.percentile_approx("id", [i / n for i in range(1, n)], 10000).alias("q")).first()["q"] if n > 1 else []
    marks = sorted(set(marks or []), reverse=True)
    # an id's part: how many marks lie at or above it, in flat expressions, as
    # there may be thousands of marks
    ids = F.array(*map(F.lit, marks)) if marks else None
    before = F.array_position(F.sort_array(F.array_append(ids, F.col("id"))), F.col("id")) - 1 if marks else F.lit(0)
    part = F.lit(len(marks)) - before
    cut = cut.withColumn("part", F.coalesce(part, F.lit(len(marks))).cast("int"))
    order = [F.col("id").desc_nulls_last(), F.col("text")]
    firsts = {r["part"]: r["id"] for r in cut.groupBy("part").agg(F.max("id").alias("id")).collect()}
    there = sorted(firsts)
    to = {p: there[i - 1] for i, p in enumerate(there)}  # the part before; of the first part, the last
    # candidates for a part's first document: rows with its highest id
    pairs = [x for p in there if firsts[p] is not None for x in (F.lit(firsts[p]), F.lit(to[p]))]
    also = F.element_at(F.create_map(*pairs), F.col("id")) if pairs else F.lit(None).cast("int")
    if None in firsts.values():  # a part of null ids alone is the last one
        also = F.when(F.col("id").isNull() & (F.col("part") == there[-1]), F.lit(to[there[-1]])).otherwise(also)
    where = F.when(also.isNull(), F.array(F.struct(F.col("part").alias("part"), F.lit(True).alias("own")))).otherwise(
        F.array(F.struct(F.col("part").alias("part"), F.lit(True).alias("own")), F.struct(also.alias("part"), F.lit(False).alias("own")))
    )
    rows = cut.select("id", "text", F.explode(where).alias("w")).select("id", "text", F.col("w.part").alias("part"), F.col("w.own").alias("own"))
    at = F.row_number().over(Window.partitionBy("part").orderBy(F.col("own").desc(), *order))
    # a task for each part, more than the session's number: a task's word counts stay in memory
    return rows.repartitionById(n, "part").withColumn("at", at)


def op6_weighted_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: fingerprints of each text and of its edited text."""
    rows = in_order(table(spark, sf_dir, "documents"), "doc_id", "text")
    w = Window.partitionBy("part").orderBy("at")
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.lead("text").over(w), F.lit(1), half)))
    # what goes with a document besides its two texts rides along as a third
    # text of one word, so the documents are shuffled once and joined to nothing
    about = F.struct(F.col("id").alias("doc_id"), "own", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    kind = rows.select(about.alias("about")).schema["about"].dataType
    nothing = F.lit(None).cast(kind)
    three = F.array(*(F.struct(F.lit(k).alias("which"), t.alias("t"), m.alias("about")) for k, (t, m) in enumerate(((F.col("text"), nothing), (F.col("edited"), nothing), (F.lit("-"), about)))))
    three = rows.select("part", "at", F.explode(three).alias("x")).select("part", (F.col("at") * 3 + F.col("x.which")).alias("row"), "x.about", "x.t")
    # draws are shared by the rows of a block, so that a part of very many equal ids gathers no endless arrays
    three = three.withColumn("block", F.shiftright("row", BLOCK_BITS))
    marks = fingerprints(three, ["part", "block", "row", "about"], "t", ["part", "block"])
    none = F.array().cast("array<int>")
    of = lambda k: F.coalesce(F.max(F.when(F.col("row") % 3 == k, F.col("signature"))), none)
    one = marks.groupBy("part", F.floor(F.col("row") / 3).cast("int").alias("at")).agg(of(0).alias("a"), of(1).alias("b"), F.max("about").alias("about"))
    one = one.select("part", "at", "a", "b", "about.*")
    one = one.withColumn("next", F.lead("a").over(w)).where("own")
    return one.select(
        "doc_id", "n_chars", "edited_sha256", said(F.col("a")).alias("fingerprint"), said(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("next")).alias("near_next"),
    )
