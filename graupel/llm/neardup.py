"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles (lower case); two are linked when the
Jaccard similarity of their sets is 0.8 or more.

1. Texts of equal word sequences form a class; only one of each goes on.
2. A one-permutation MinHash signature of 512 values (empty bins filled from a
   random non-empty one) gives 73 band keys of 7 values.  Classes that share a
   band key are candidates: a linked pair is missed with probability
   (1 - 0.8^7)^73 < 4e-8.  A bucket yields edges between neighbours in the
   order of its members, not pairs, so its cost grows with its members.
3. Within the components of these edges the pairs' signatures are compared 32
   values at a time; a pair is dropped as soon as the posterior probability
   (uniform prior) of reaching the threshold is below ``TOLERANCE``, and what is
   left is verified on the shingle sets themselves.  Work is dealt out as pairs
   of blocks; blocks return counts and spanning edges, not pairs.  A component
   of several blocks that its buckets hold together loosely, by chains of unlike
   texts, is dealt bucket by bucket instead where that copies fewer sets: a pair
   then counts in the first bucket that it shares, so it counts once.

Cases: null and empty texts form one class without links; texts of fewer than
five words are one shingle; equal texts, and repeated rows, share a class;
ids may repeat; very long texts are read whole; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import partitions, slices, table, written
from .graph import components
from .words import mixed, shingles

SHINGLE = 5
BIN_BITS = 9
BINS = 1 << BIN_BITS
ROWS, BANDS = 7, 73
STEP = 32
TOLERANCE = 1e-9
BLOCK = 512
#: Members whose ids are broadcast to the scan of their texts (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: The threshold as a fraction: links have NUM / DEN or more.
NUM, DEN = 4, 5


@lru_cache(1)
def _donors() -> np.ndarray:
    """For each bin an order in which it looks for a bin to borrow from."""
    rng = np.random.Generator(np.random.PCG64(7))
    return np.stack([rng.permutation(BINS) for _ in range(BINS)]).astype(np.int32)


def signature(sh: np.ndarray) -> np.ndarray:
    """BINS values of a non-empty sorted set of hashes."""
    bins = (sh >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    out = np.zeros(BINS, np.uint64)
    full = np.zeros(BINS, bool)
    full[bins[first]] = True
    out[bins[first]] = sh[first]
    empty = np.flatnonzero(~full)
    for width in (8, 64, BINS):
        if not len(empty):
            break
        order = _donors()[empty, :width]
        ok = full[order]
        got = ok.argmax(1)
        has = ok[np.arange(len(empty)), got]
        out[empty[has]] = out[order[np.arange(len(empty)), got][has]]
        empty = empty[~has]
    return mixed(out)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """BANDS 64-bit keys, different between bands."""
    rows = sig[: ROWS * BANDS].reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        h = mixed(h + rows[:, i])
    return h.view(np.int64)


@lru_cache(2 * BINS // STEP)
def least_matches(n: int, tolerance: float = TOLERANCE) -> int:
    """Fewest matches among ``n`` values with which the posterior probability
    of a similarity at the threshold or above isn't below ``tolerance``: it is
    the chance that a binomial (n + 1, threshold) gives no more matches."""
    t = NUM / DEN
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def _described(batches):
    for batch in slices(batches):
        key, cid, n, bands = [], [], [], []
        for text in batch.column(1).to_pylist():
            sh, w = shingles(text or "", SHINGLE)
            digest = hashlib.blake2b(w.tobytes(), digest_size=16).digest()
            key.append(digest)
            cid.append(int.from_bytes(digest[:8], "little", signed=True))
            n.append(len(sh))
            bands.append(band_keys(signature(sh)).tobytes() if len(sh) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(key, pa.binary()), pa.array(cid, pa.int64()), pa.array(n, pa.int64()), pa.array(bands, pa.binary())], ["id", "key", "cid", "n", "bands"]
        )


def _unpacked(batches):
    """A row for each band of each class, once a task however many copies it
    holds; the bands are the last column, the numbers before them are repeated."""
    seen: set[int] = set()
    for batch in slices(batches):
        cids = batch.column(0).to_pylist()
        new = [k for k, cid in enumerate(cids) if not (cid in seen or seen.add(cid))]
        if not new:
            continue
        batch = batch.take(pa.array(new))
        keys = np.frombuffer(b"".join(batch.column(batch.num_columns - 1).to_pylist()), np.int64)
        others = [pa.array(np.repeat(c.to_numpy(), BANDS)) for c in batch.columns[:-1]]
        yield pa.RecordBatch.from_arrays([*others, pa.array(keys)], [*batch.schema.names[:-1], "band"])


def _sets(batches):
    """(cid, shingles as bytes) of the texts that are their class's own, or of
    all where no class is named."""
    for batch in slices(batches):
        cids, sets = [], []
        for text, cid in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sh, w = shingles(text or "", SHINGLE)
            own = int.from_bytes(hashlib.blake2b(w.tobytes(), digest_size=16).digest()[:8], "little", signed=True)
            if cid is None or own == cid:
                cids.append(own), sets.append(sh.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(sets, pa.binary())], ["cid", "sh"])


def survivors(sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that the Bayesian test doesn't drop."""
    matches = np.zeros(len(i), np.int32)
    for at in range(0, BINS, STEP):
        part = sig[:, at : at + STEP]
        for k in range(0, len(i), 1 << 16):
            s = slice(k, k + (1 << 16))
            matches[s] += (part[i[s]] == part[j[s]]).sum(1, dtype=np.int32)
        ok = matches >= least_matches(at + STEP)
        if not ok.all():
            i, j, matches = i[ok], j[ok], matches[ok]
        if not len(i):
            break
    return i, j


def common_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the given pairs of sets."""
    if len(i) <= 2 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    values, of = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = np.flatnonzero(np.bincount(of) > 1)
    new = np.full(len(values), -1)
    new[shared] = np.arange(len(shared))
    of = new[of]
    owner, of = owner[of >= 0], of[of >= 0]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, len(shared), 8192):
        own = (of >= at) & (of < at + 8192)
        m = np.zeros((len(sets), min(8192, len(shared) - at)), np.float32)
        m[owner[own], of[own] - at] = 1
        total += m @ m.T
    return total[i, j].astype(np.int64)


def first_shared(keys: np.ndarray, band: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs share no band before the one with this key."""
    before = keys[:, : int(np.flatnonzero(keys[0] == band)[0])]
    ok = np.ones(len(i), bool)
    for k in range(0, len(i), 1 << 14):
        at = slice(k, k + (1 << 14))
        ok[at] = ~(before[i[at]] == before[j[at]]).any(1)
    return ok


def _verified(group: pa.Table) -> pa.Table:
    """Links of one pair of blocks (or of one whole component or bucket): per
    member its number of links and the least member it hangs together with."""
    order = np.argsort(group.column("cid").to_numpy())
    cid = group.column("cid").to_numpy()[order]
    block = group.column("block").to_numpy()[order]
    raw = group.column("sh").to_pylist()
    sets = [np.frombuffer(raw[k], np.uint64) for k in order]
    full = [signature(s) for s in sets]
    sig = np.stack([s.astype(np.uint32) for s in full])
    band = group.column("band")[0].as_py()
    i, j = np.triu_indices(len(cid), 1)
    if group.column("low")[0] != group.column("high")[0]:  # blocks' own pairs are another group's work
        cross = block[i] != block[j]
        i, j = i[cross], j[cross]
    i, j = survivors(sig, i.astype(np.int32), j.astype(np.int32))
    if band is not None and len(i):
        own = first_shared(np.stack([band_keys(s) for s in full]), band, i, j)
        i, j = i[own], j[own]
    n = np.array([len(s) for s in sets])
    if len(i):
        inter = common_counts(sets, i, j)
        ok = (NUM + DEN) * inter >= NUM * (n[i] + n[j])
        i, j = i[ok], j[ok]
    links = np.bincount(np.concatenate((i, j)), minlength=len(cid))
    root = np.arange(len(cid))
    while True:  # members are in order of cid, so the least index is the least cid
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            break
        root = new
    return pa.table({"cid": cid, "links": links.astype(np.int64), "root": cid[root]})


def _chained(batches):
    """Edges between neighbours of the same band in rows sorted by (band, cid);
    the first and last row of the partition go along with their band, to be
    linked with other partitions' rows."""
    last = None

    def row(u, v, band):
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(band, pa.int64())], ["u", "v", "band"])

    for batch in batches:
        if not len(batch):
            continue
        cid, band = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if last is None:
            yield row([cid[0]], [None], [band[0]])
        else:
            cid, band = np.append(last[0], cid), np.append(last[1], band)
        same = (band[1:] == band[:-1]) & (cid[1:] != cid[:-1])
        u, v = cid[1:][same], cid[:-1][same]
        yield row(u, v, [None] * len(u))
        last = cid[-1], band[-1]
    if last is not None:
        yield row([last[0]], [None], [last[1]])


def _bucket_edges(bands: DataFrame) -> DataFrame:
    """Edges (u, v) that hold each bucket's members together: rows are dealt by
    ranges of (band, cid), so a bucket of any size is split over partitions, and
    each member is tied to the one before it."""
    n = 2 * partitions(bands.sparkSession)
    found = written(bands.repartitionByRange(n, "band", "cid").sortWithinPartitions("band", "cid").mapInArrow(_chained, "u long, v long, band long"), "join-edges")
    seams = found.where("band is not null").select("u", "band")
    least = seams.groupBy("band").agg(F.min("u").alias("v"))
    return found.where("band is null").select("u", "v").unionByName(seams.join(least, "band").where("u <> v").select("u", "v"))


def _units(members: DataFrame, rows: DataFrame) -> DataFrame:
    """How members (cid, label, size, blocks) are dealt: (cid, label, band,
    blocks), one row for each component or bucket that a member is compared in;
    band is null for whole components."""
    whole = members.select("cid", "label", F.lit(None).cast("long").alias("band"), "blocks")
    large = members.where("blocks > 1").select("cid", "label", "size", "blocks")
    if large.isEmpty():
        return whole
    own = large.select("cid", "label")
    if own.count() <= BROADCAST_ROWS:  # else both sides are shuffled
        own = F.broadcast(own)
    held = rows.select("cid", "bands").join(own, "cid").select("cid", "label", "bands").dropDuplicates(["cid"])
    held = written(held.mapInArrow(_unpacked, "cid long, label long, band long"), "join-held")
    buckets = held.groupBy("label", "band").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    buckets = written(buckets, "join-buckets")
    copies = buckets.groupBy("label").agg(F.sum(F.col("n") * F.col("blocks")).alias("copies"))
    loose = large.select("label", "size", "blocks").distinct().join(copies, "label").where(F.col("copies") < F.col("size") * F.col("blocks")).select("label")
    loose = written(loose, "join-loose")
    dealt = held.join(buckets.join(loose, "label", "left_semi").select("label", "band", "blocks"), ["label", "band"])
    return whole.join(loose, "label", "left_anti").select("cid", "label", "band", "blocks").unionByName(dealt.select("cid", "label", "band", "blocks"))


def link(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, class_id (least id of the texts with the
    same words), n_copies (size of the class), n_links (other classes that are
    linked to it) and group_id (least id of the texts connected by links)."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    cut = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = cut.mapInArrow(_described, f"id {kind}, key binary, cid long, n long, bands binary")
    rows = written(rows, "join-rows")
    classes = rows.groupBy("key").agg(F.min("id").alias("class_id"), F.count("*").alias("n_copies"), F.first("cid").alias("cid"))
    classes = written(classes, "join-classes")

    bands = rows.where("bands is not null").select("cid", "bands").mapInArrow(_unpacked, "cid long, band long")
    parts = components(_bucket_edges(bands))
    sizes = parts.groupBy("label").agg(F.count("*").alias("size"))
    members = parts.join(sizes, "label").select(F.col("node").alias("cid"), "label", "size", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    members = written(members.join(classes.select("cid", "class_id"), "cid"), "join-members")

    own = members.select(F.col("class_id").alias("id"), "cid")
    if own.count() <= BROADCAST_ROWS:  # else both sides are shuffled
        own = F.broadcast(own)
    texts = cut.join(own, "id").select("text", "cid")
    # a class of null ids alone is found by its text
    texts = texts.unionByName(cut.where("id is null").select("text", F.lit(None).cast("long").alias("cid"))).mapInArrow(_sets, "cid long, sh binary")
    dealt = texts.dropDuplicates(["cid"]).join(_units(members, rows), "cid")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("cid", "sh", "label", "band", "block", "blocks", other).select(
        "cid", "sh", "label", "band", "block", "blocks", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )
    found = dealt.groupBy("label", "band", "low", "high").applyInArrow(lambda t: _verified(t), "cid long, links long, root long")
    found = written(found, "join-found")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    groups = components(found.where("root <> cid").select(F.col("cid").alias("u"), F.col("root").alias("v")))

    named = classes.join(links, "cid", "left").join(groups.select(F.col("node").alias("cid"), "label"), "cid", "left")
    named = written(named.select("key", "class_id", "n_copies", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("label", "cid").alias("label")), "join-named")
    heads = named.groupBy("label").agg(F.min("class_id").alias("group_id"))
    whole = named.join(heads, "label").drop("label")
    out = rows.select("id", "key").join(whole, "key")
    return out.select(F.col("id").alias(id_col), "class_id", "n_copies", "n_links", "group_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of linked texts, all columns: that of the least
    id (of the texts with that id, the least digest; of equal rows, one)."""
    named = df.withColumn("__row", F.struct(F.col(id_col).alias("id"), F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("")).alias("digest")))
    best = link(named, "__row", text_col).where(F.col("__row") == F.col("group_id")).select("__row").distinct()
    return named.join(best.withColumnRenamed("__row", "__best"), F.col("__row") == F.col("__best"), "left_semi").dropDuplicates(["__row"]).drop("__row")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: class, links and group of each."""
    return link(table(spark, sf_dir, "documents"))
