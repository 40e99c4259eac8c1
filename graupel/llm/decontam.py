"""Benchmark decontamination by q-gram counts in diagonal bands.

Benchmark items are cut into overlapping segments.  A document region can hold
a segment within its edit budget only if enough of the segment's q-grams occur
there on nearby diagonals (the q-gram lemma), so q-gram hits are counted by
segment and overlapping diagonal band, bands below the bound are dropped, and
what is left is verified by a banded alignment.  Texts are compared in lower
case with every run of other characters than letters and digits as one blank.

Cases: null and empty texts never match; items with fewer than ``q`` letters
and digits can't be told from chance and never match; documents of any length
are searched whole; repeated rows give repeated results and repeated items one
result each; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import slices, table, written

Q = 8
#: A passage of an item is always found from WINDOW + STRIDE - 1 characters on.
WINDOW = 64
STRIDE = 16
EDIT_RATE = 0.08
#: Characters of benchmark text in one broadcast index; more are searched in blocks.
BLOCK_CHARS = 2_000_000
MASK_BITS = 22
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point to its lower case where it is a letter or digit, else blank."""
    of = np.full(0x110000, 32, np.uint32)
    for cp in range(0x110000):
        if not 0xD800 <= cp < 0xE000 and (c := chr(cp)).isalnum():
            low = c.lower()
            of[cp] = ord(low) if len(low) == 1 else cp
    return of


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code points and the place of each in the text."""
    got = _letters()[np.frombuffer(text.encode("utf-32-le"), "<u4")]
    keep = got != 32
    keep[1:] |= got[:-1] != 32
    at = np.flatnonzero(keep)
    return got[at], at


def hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of every q-gram (q a power of two), by doubling."""
    h = codes.astype(np.uint64) * _MUL
    width, base = 1, int(_BASE)
    while width < q:
        if len(h) <= width:
            return np.empty(0, np.uint64)
        h = h[:-width] * np.uint64(base) + h[width:]
        width, base = 2 * width, base * base % (1 << 64)
    return h * _MUL


@dataclass
class Index:
    items: list
    n_segments: list[int]
    segments: list[np.ndarray]
    owners: list[list[int]]
    seg_len: np.ndarray
    edits: np.ndarray
    bound: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    seg: np.ndarray
    pos: np.ndarray
    mask: np.ndarray


def index(items: list[tuple], window: int = WINDOW, rate: float = EDIT_RATE, q: int = Q, stride: int = STRIDE) -> Index | None:
    """The q-gram index of (id, text) pairs, by segment."""
    ids, n_segments, segments, owners, at = [], [], [], [], {}
    for item_id, text in items:
        c = normal(text or "")[0]
        c = c[1:] if len(c) and c[0] == 32 else c
        c = c[:-1] if len(c) and c[-1] == 32 else c
        if len(c) < q:
            continue
        starts = [0] if len(c) <= window else sorted({*range(0, len(c) - window, stride), len(c) - window})
        for a in starts:
            part = c[a : a + window]
            k = at.setdefault(part.tobytes(), len(segments))  # equal segments are one, with several owners
            if k == len(segments):
                segments.append(part), owners.append([])
            owners[k].append(len(ids))
        ids.append(item_id), n_segments.append(len(starts))
    if not ids:
        return None
    n = np.array([len(x) for x in segments])
    edits = np.minimum((n * rate).astype(int), np.maximum(0, (n - q) // q))
    grams, segs, poss = [], [], []
    for k, part in enumerate(segments):
        h = hashes(part, q)
        grams.append(h), segs.append(np.full(len(h), k)), poss.append(np.arange(len(h)))
    g, s, p = map(np.concatenate, (grams, segs, poss))
    by = np.argsort(g, kind="stable")
    g, s, p = g[by], s[by], p[by]
    keys, first = np.unique(g, return_index=True)
    mask = np.zeros(1 << MASK_BITS, bool)
    mask[keys >> np.uint64(64 - MASK_BITS)] = True
    return Index(ids, n_segments, segments, owners, n, edits, n - q + 1 - q * edits, keys, np.append(first, len(g)), s, p, mask)


def reaches(segment: list[int], region: list[int], budget: int) -> bool:
    """Whether some part of the region is within the budget of the segment: a
    column of the alignment's table at a time, its steps kept as bits."""
    signs: dict[int, int] = {}
    for i, c in enumerate(segment):
        signs[c] = signs.get(c, 0) | 1 << i
    n = len(segment)
    every, top = (1 << n) - 1, 1 << (n - 1)
    up, down, edits, left = every, 0, n, len(region)
    for c in region:
        same = signs.get(c, 0)
        v = same | down
        h = (((same & up) + up) ^ up) | same
        rise, fall = down | ~(h | up) & every, up & h
        if rise & top:
            edits += 1
        elif fall & top:
            edits -= 1
            if edits <= budget:
                return True
        left -= 1
        if edits - left > budget:
            return False
        rise, fall = rise << 1, fall << 1
        up, down = (fall | ~(v | rise)) & every, rise & v & every
    return n <= budget


def aligned(segment: np.ndarray, region: np.ndarray, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best alignment of the whole segment with a
    part of the region, if within the budget.  The region spans the band, so
    each row of the table is as wide as the band."""
    n, m = len(segment), len(region)
    if n <= m:  # an exact copy needs no table
        whole, part = np.asarray(region, np.uint32).tobytes(), np.asarray(segment, np.uint32).tobytes()
        at = whole.find(part)
        while at >= 0 and at % 4:
            at = whole.find(part, at + 1)
        if at >= 0:
            return 0, at // 4, at // 4 + n
    if not reaches(segment.tolist(), region.tolist(), budget):
        return None
    if m < n - budget:  # cut short by an end of the text
        return None
    band = m - n + budget + 1
    cost = np.zeros(m + 1, np.int64)
    origin = np.arange(m + 1)
    steps = np.arange(m + 1)
    far = 1 << 30
    for i in range(1, n + 1):
        lo, hi = max(0, i - budget), min(m, i + band)
        new = np.full(m + 1, far)
        down = cost[lo : hi + 1] + 1
        diagonal = np.full(hi + 1 - lo, far)
        a = max(lo, 1)
        diagonal[a - lo :] = cost[a - 1 : hi] + (region[a - 1 : hi] != segment[i - 1])
        best = np.minimum(down, diagonal)
        src = np.where(diagonal <= down, np.concatenate((origin[:1], origin[:-1]))[lo : hi + 1], origin[lo : hi + 1])
        low = best - steps[lo : hi + 1]
        run = np.minimum.accumulate(low)
        came = np.maximum.accumulate(np.where(low == run, np.arange(len(low)), 0))
        new[lo : hi + 1] = run + steps[lo : hi + 1]
        origin = origin.copy()
        origin[lo : hi + 1] = src[came]
        cost = new
        if cost[lo : hi + 1].min() > budget:
            return None
    end = int(cost.argmin())
    return (int(cost[end]), int(origin[end]), end) if cost[end] <= budget else None


#: Hits that are expanded to their places in the segments at a time.
EXPANDED = 1 << 20


def _bands(ix: Index, live: np.ndarray, where: np.ndarray, reach: int):
    """(segment << 40 | band) of the bands whose q-gram hits reach the bound.

    Hits are taken in slices whose places in the segments fit into EXPANDED
    numbers.  A band's hits lie within ``reach`` of each other in the text, so
    the counts of a slice are final once the next hit is farther than that from
    the band; the others are carried on."""
    many = ix.first[where + 1] - ix.first[where]
    ends = np.cumsum(many)
    kept_keys, kept_n, done = np.empty(0, np.int64), np.empty(0, np.int64), 0
    while done < len(live):
        # one hit at least, however many places it has: they are bounded by the index's block
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + EXPANDED, "right")))
        m, w = many[done:upto], where[done:upto]
        place = np.repeat(ix.first[w], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        seg = ix.seg[place]
        diagonal = np.repeat(live[done:upto], m) - ix.pos[place] + WINDOW
        band = diagonal // (ix.edits[seg] + 1)  # a band holds this strip of diagonals and the next: they overlap
        found, n = np.unique(np.concatenate(((seg << 40) | band, (seg << 40) | np.maximum(band - 1, 0))), return_counts=True)
        keys, of = np.unique(np.concatenate((kept_keys, found)), return_inverse=True)
        n = np.bincount(of, np.concatenate((kept_n, n))).astype(np.int64)
        enough = n >= ix.bound[keys >> 40]
        yield from keys[enough].tolist()
        keys, n = keys[~enough], n[~enough]
        if upto < len(live):
            ahead = (keys & ((1 << 40) - 1)) * (ix.edits[keys >> 40] + 1) - WINDOW + reach >= live[upto]
            keys, n = keys[ahead], n[ahead]
        kept_keys, kept_n, done = keys, n, upto


def matches(text: str, ix: Index, q: int = Q) -> list[tuple]:
    """(item id, start, end, edits, segments found, segments) by item: the
    region of the text is from the first to the last matching segment."""
    codes, at = normal(text)
    h = hashes(codes, q)
    if not len(h):
        return []
    hit = np.flatnonzero(ix.mask[h >> np.uint64(64 - MASK_BITS)])
    least = int(ix.bound.min())
    if len(hit) < least:
        return []
    where = np.searchsorted(ix.keys, h[hit])
    where[where == len(ix.keys)] = 0
    ok = ix.keys[where] == h[hit]
    hit, where = hit[ok], where[ok]
    # a region must have `least` hits within the reach of the longest segment
    reach = int((ix.seg_len + 2 * ix.edits).max())
    near = np.searchsorted(hit, hit + reach) - np.arange(len(hit)) >= least
    if not near.any():
        return []
    begins = hit[near]
    b = np.searchsorted(begins, hit, "right")
    ok = b > 0
    ok[ok] = hit[ok] - begins[b[ok] - 1] < reach
    live, where = hit[ok], where[ok]
    best: dict[int, tuple] = {}
    for k in _bands(ix, live, where, reach):
        s, strip = k >> 40, k & ((1 << 40) - 1)
        if s in best and best[s][0] == 0:
            continue  # the least edits are known; a segment's first exact place is kept
        e, size = int(ix.edits[s]), int(ix.seg_len[s])
        lo = max(0, strip * (e + 1) - WINDOW - e)
        region = codes[lo : (strip + 2) * (e + 1) - WINDOW + size + e]
        if (got := aligned(ix.segments[s], region, e)) and (s not in best or got[0] < best[s][0]):
            best[s] = got[0], lo + got[1], lo + got[2]
    found: dict[int, list] = {}
    for s, (edits, a, b) in sorted(best.items()):
        for item in ix.owners[s]:
            found.setdefault(item, []).append((int(at[a]), int(at[b - 1]) + 1, edits))
    return [
        (ix.items[i], min(x[0] for x in v), max(x[1] for x in v), sum(x[2] for x in v), len(v), ix.n_segments[i])
        for i, v in sorted(found.items())
    ]


def blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int = BLOCK_CHARS):
    """The items' indexes, each over at most about ``block_chars`` characters."""
    cut = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    total = cut.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = -(-total // block_chars)
    for k in range(n):
        rows = cut.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()
        ix = index(sorted((r["id"], r["text"]) for r in rows))
        if ix is not None:
            yield ix


#: Bits of the filter that stands before an index of several blocks.
FILTER_BITS = 30


def _filter(found) -> tuple[np.ndarray, int, int] | None:
    """The hashes of all blocks' q-grams as one bit set, the fewest hits that a
    match has, and the reach within which they lie."""
    bits, least, reach = np.zeros(1 << (FILTER_BITS - 3), np.uint8), None, 0
    for ix in found:
        h = ix.keys >> np.uint64(64 - FILTER_BITS)
        np.bitwise_or.at(bits, h >> np.uint64(3), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8))
        low = int(ix.bound.min())
        least, reach = low if least is None else min(least, low), max(reach, int((ix.seg_len + 2 * ix.edits).max()))
    return None if least is None else (bits, least, reach)


def possible(text: str, bits: np.ndarray, least: int, reach: int) -> bool:
    """Whether some region of a text may hold a segment of any block."""
    h = hashes(normal(text)[0]) >> np.uint64(64 - FILTER_BITS)
    hit = np.flatnonzero((bits[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & 1)
    return len(hit) >= least and bool((np.searchsorted(hit, hit + reach) - np.arange(len(hit)) >= least).any())


def _candidates(docs: DataFrame, text_col: str, items: DataFrame, item_col: str, item_text_col: str, block_chars: int):
    """Whether the items take several blocks, and then the documents that may
    match any of them, as a written table found in one scan: the blocks search
    only these.  The filter has a fixed size, whatever the items' number."""
    chars = items.agg(F.coalesce(F.sum(F.length(item_text_col)), F.lit(0))).first()[0]
    if chars <= block_chars:
        return None
    made = _filter(blocks(items, item_col, item_text_col, block_chars))
    if made is None:
        return None
    shared = docs.sparkSession.sparkContext.broadcast(made)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array([bool(x) and possible(x, *shared.value) for x in batch.column(at).to_pylist()], pa.bool_()))

    return written(docs.mapInArrow(run, docs.schema), "decontam-candidates")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document row and item of which it holds a segment within
    the edit budget: ids, span in the document (code points), edits, segments
    found and segments of the item."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = items.schema[item_col].dataType
    arrow_kind = to_arrow_type(item_kind)
    cut = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    schema = f"id {kind}, item {item_kind.simpleString()}, start long, end long, edits long, segments long, of_segments long"
    out = spark.createDataFrame([], schema)
    likely = _candidates(cut, "text", items, item_col, item_text_col, block_chars)
    cut = cut if likely is None else likely
    for ix in blocks(items, item_col, item_text_col, block_chars):
        shared = spark.sparkContext.broadcast(ix)

        def run(batches, shared=shared):
            ix = shared.value
            for batch in slices(batches):
                took, found = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    got = matches(text, ix)
                    took += [i] * len(got)
                    found += got
                if found:
                    cols = [pa.array([f[j] for f in found], arrow_kind if j == 0 else pa.int64()) for j in range(6)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(took, pa.int64())), *cols], ["id", "item", "start", "end", "edits", "segments", "of_segments"])

        out = out.union(cut.mapInArrow(run, schema))
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no segment of any item."""
    at = docs.columns.index(text_col)
    likely = _candidates(docs.select(text_col), text_col, items, item_col, item_text_col, block_chars)
    if likely is not None:
        # several blocks: the texts to go are found among the candidates, then taken away by digest
        digest = F.unhex(F.sha2(F.col(text_col), 256))
        likely = likely.select(F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"), digest.alias("digest"))
        likely = written(likely.dropDuplicates(["digest"]), "decontam-texts")
        found = contaminated(likely.select("row", "text"), items, "row", "text", item_col, item_text_col, block_chars)
        bad = likely.join(found.select("row").distinct(), "row").select("digest")
        return docs.withColumn("__digest", digest).join(bad.withColumnRenamed("digest", "__bad"), F.col("__digest") == F.col("__bad"), "left_anti").drop("__digest")
    for ix in blocks(items, item_col, item_text_col, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(ix)

        def run(batches, shared=shared):
            ix = shared.value
            for batch in slices(batches):
                yield batch.filter(pa.array([not t or not matches(t, ix) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
