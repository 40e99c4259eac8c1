"""Deep-shallow suffix sorting, and removal of repeated byte strings with it.

``repeats`` finds every byte that is covered by a string of ``LENGTH`` bytes
which also starts anywhere else in the table, the same text included.

Every window of LENGTH bytes is represented by its anchor: the leftmost least
hash among its K-byte strings.  Equal windows have equal anchors at equal
offsets, so two repeats always meet at an anchor, and anchors are about one in
185 positions.  Anchors whose K-byte string occurs once in the table are
dropped; for the others the text around them goes to the anchor's group.  There
the parts right of the anchor, and the reversed parts left of it, are ordered
by deep-shallow sorting, whose common prefixes give the reach of every match:
a member is covered from its farthest match on the left to its farthest on the
right among partners that agree on LENGTH bytes together.

Groups of more than ``GROUP`` members (a passage in a large part of all texts)
aren't gathered in one task: their windows are counted by hash instead, which
gives the same result at a row a window.

Cases: null texts count as empty; texts below LENGTH bytes lose nothing; equal
texts of LENGTH bytes or more, and repeated rows, lose all their bytes; matches
never cross texts; texts of any length are read whole; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import partitions, slices, table, written
from .words import mixed

LENGTH = 400
K = 32
GROUP = 50_000
SALT = 64
SHALLOW = 64
CHUNK = 8
POS_BITS = 20


# ---- deep-shallow sorting -------------------------------------------------


def lcp(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    return n if a == b else n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


def _blind_trie(strings: list[bytes], group: list[int], depth: int) -> list[int]:
    """Orders distinct strings that agree on ``depth`` bytes.  Inner nodes hold
    the place where their strings part; an insertion walks down blindly,
    compares with one string at the end and goes up to where they part."""
    root: object = group[0]
    for new in group[1:]:
        s = strings[new]
        node = root
        while isinstance(node, tuple):
            at, kids = node
            c = s[at] if at < len(s) else -1
            node = kids[c] if c in kids else next(iter(kids.values()))
        split = lcp(s, strings[node])
        old = strings[node]
        a, b = (x[split] if split < len(x) else -1 for x in (s, old))
        parent, edge, node = None, None, root
        while isinstance(node, tuple) and node[0] < split:
            c = s[node[0]] if node[0] < len(s) else -1
            parent, edge, node = node, c, node[1][c]
        if isinstance(node, tuple) and node[0] == split:
            node[1][a] = new
        else:
            made = (split, {a: new, b: node})
            if parent is None:
                root = made
            else:
                parent[1][edge] = made
    out, work = [], [root]
    while work:
        node = work.pop()
        if isinstance(node, tuple):
            work += [node[1][c] for c in sorted(node[1], reverse=True)]
        else:
            out.append(node)
    return out


def deep_shallow(strings: list[bytes]) -> list[int]:
    """The order of distinct strings: multikey quicksort on chunks of bytes to
    the depth SHALLOW, blind tries for the groups that agree further."""
    out: list[int] = []
    work = [([*range(len(strings))], 0)]
    while work:
        group, depth = work.pop()
        if len(group) == 1:
            out.append(group[0])
        elif depth >= SHALLOW:
            out += _blind_trie(strings, group, depth)
        else:
            # a chunk with its true length orders an end before any byte
            keys = [(strings[i][depth : depth + CHUNK]) for i in group]
            pivot = keys[len(keys) // 2]
            less = [i for i, k in zip(group, keys) if k < pivot]
            same = [i for i, k in zip(group, keys) if k == pivot]
            more = [i for i, k in zip(group, keys) if k > pivot]
            if more:
                work.append((more, depth))
            # strings that end in this chunk can't be told apart below: there is one at most
            work.append((same, depth + CHUNK))
            if less:
                work.append((less, depth))
    return out


# ---- anchors --------------------------------------------------------------


def hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all K-byte strings (K a power of two), by doubling."""
    h = mixed(data.astype(np.uint64) + np.uint64(1))
    width, base = 1, 0xD6E8FEB86659FD93
    while width < K:
        h = h[:-width] * np.uint64(base) + h[width:]
        width, base = 2 * width, base * base % (1 << 64)
    return mixed(h)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, last window) of each anchor of a text, by
    place.  Windows are named by their starts."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 3
    span = LENGTH - K + 1
    parts = []
    step = (1 << POS_BITS) - span
    for at in range(0, n, step):
        m = min(step, n - at)
        h = hashes(data[at : at + m + LENGTH - 1])
        v = ((h >> np.uint64(POS_BITS)) << np.uint64(POS_BITS)) | np.arange(len(h), dtype=np.uint64)
        pad = -len(v) % span
        rows = np.concatenate((v, np.full(pad, ~np.uint64(0)))).reshape(-1, span)
        ahead = np.minimum.accumulate(rows, 1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(back[:m], ahead[span - 1 : span - 1 + m])
        place = (least & np.uint64((1 << POS_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.concatenate((first[1:], [m])) - 1
        parts.append((h[place[first]], place[first] + at, first + at, last + at))
    # an anchor at the seam of two pieces keeps two runs of windows, each whole in itself
    return tuple(np.concatenate(x) for x in zip(*parts))


def _anchored(batches):
    for batch in slices(batches):
        keys, out = [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            h, place, _, _ = anchors(np.frombuffer((text or "").encode(), np.uint8))
            keys += [key] * len(h)
            out.append((h.view(np.int64), place))
        h = np.concatenate([x[0] for x in out]) if out else np.empty(0, np.int64)
        p = np.concatenate([x[1] for x in out]) if out else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(h, pa.int64()), pa.array(p, pa.int64())], ["key", "anchor", "place"])


def _around(batches):
    """(anchor, key, place, first, last, around): the text of the windows of
    each wanted anchor.  Anchors that have the same text around them in one
    document are repeats at once: they give a covered range (``around`` null),
    and one of them goes to the group."""
    for batch in slices(batches):
        rows: list[tuple] = []
        for key, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3))):
            raw = text.encode()
            want = set(wanted)
            h, place, first, last = anchors(np.frombuffer(raw, np.uint8))
            seen: dict[tuple, list] = {}
            for a, p, w0, w1 in zip(h.view(np.int64).tolist(), place.tolist(), first.tolist(), last.tolist()):
                if a in want:
                    seen.setdefault((a, p - w0, raw[w0 : w1 + LENGTH]), []).append((p, w0, w1))
            covered = []
            for (a, _, around), at in seen.items():
                rows.append((a, key, *at[0], around))
                if len(at) > 1:
                    covered += [(w0, w1 + LENGTH) for _, w0, w1 in at]
            rows += [(None, key, None, a, b, None) for a, b in merged(covered)]
        cols = [*zip(*rows)] or [()] * 6
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["anchor", "key", "place", "first", "last", "around"])


AROUND = "anchor long, key binary, place long, first long, last long, around binary"


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs of overlapping or touching ranges."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


# ---- one anchor's group ----------------------------------------------------


def _neighbours(strings: list[bytes], order: list[int]) -> np.ndarray:
    return np.array([lcp(strings[a], strings[b]) for a, b in zip(order, order[1:])], np.int64)


def _reach(common: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    """The matrix of common prefixes from those of neighbours in the order."""
    out = np.zeros((n, n), np.int64)
    for i in range(n - 1):
        out[order[i], order[i + 1 :]] = np.minimum.accumulate(common[i:])
    return np.maximum(out, out.T)


def covers(members: list[tuple[int, bytes]]) -> list[tuple[int, int] | None]:
    """For each member (anchor's offset in its text, text around), distinct,
    how far it is covered to the left and right of the anchor."""
    n = len(members)
    right = [t[p:] for p, t in members]
    left = [t[:p][::-1] for p, t in members]
    if n == 2:
        r, l_ = lcp(*right), lcp(*left)
        return [(l_, r)] * 2 if r + l_ >= LENGTH else [None] * 2
    sides = []
    for strings in (right, left):
        distinct = {s: i for i, s in enumerate(dict.fromkeys(strings))}
        words = [*distinct]
        order = deep_shallow(words)
        sides.append((words, np.array([distinct[s] for s in strings]), np.array(order), _neighbours(words, order)))
    if n <= 200:
        both = []
        for words, of, order, common in sides:
            m = _reach(common, order, len(words))
            np.fill_diagonal(m, [len(w) for w in words])
            both.append(m[np.ix_(of, of)])
        r, l_ = both
        ok = r + l_ >= LENGTH
        np.fill_diagonal(ok, False)
        far_l, far_r = np.where(ok, l_, -1).max(1), np.where(ok, r, -1).max(1)
    else:
        far_l, far_r = np.full(n, -1), np.full(n, -1)
        size = [np.array([len(w) for w in words])[of] for words, of, _, _ in sides]
        for o in range(LENGTH - K + 1):
            live = np.flatnonzero((size[1] >= o) & (size[0] >= LENGTH - o))
            if len(live) < 2:
                continue
            label = []
            for (_, of, order, common), depth in zip(sides, (LENGTH - o, o)):
                rank = np.empty(len(order), np.int64)
                rank[order] = np.concatenate(([0], np.cumsum(common < depth)))
                label.append(rank[of[live]])
            _, inverse, count = np.unique(label[0] * (n + 1) + label[1], return_inverse=True, return_counts=True)
            hit = live[count[inverse] > 1]
            far_l[hit] = o
            far_r[hit] = np.maximum(far_r[hit], LENGTH - o)
    return [(int(a), int(b)) if b >= 0 else None for a, b in zip(far_l, far_r)]


def _grouped(rows: list[tuple]) -> list[tuple]:
    """Covered ranges of the members of one anchor's group."""
    same: dict[tuple[int, bytes], dict] = {}
    for _, key, place, first, last, around in rows:
        same.setdefault((place - first, around), {})[key, place] = None
    out = []
    reach = covers([*same]) if len(same) > 1 else [None]
    for ((offset, around), at), far in zip(same.items(), reach):
        if len(at) > 1:
            far = (offset, len(around) - offset)
        if far:
            out += [(key, place - far[0], place + far[1]) for key, place in at]
    return out


def _ranges(batches):
    """(key, start, end) from rows that are sorted by anchor."""
    def batch_of(found):
        cols = [*zip(*found)] or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int64(), pa.int64()))], ["key", "start", "end"])

    group: list[tuple] = []
    for batch in batches:
        found = []
        for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if row[0] is None:
                found.append((row[1], row[3], row[4]))
                continue
            if group and group[-1][0] != row[0]:
                found += _grouped(group)
                group = []
            group.append(row)
        yield batch_of(found)
    if group:
        yield batch_of(_grouped(group))


def window_hashes(data: np.ndarray) -> np.ndarray:
    """128-bit hashes (rows of two 64-bit numbers) of all LENGTH-byte strings,
    joined from those of the powers of two that LENGTH is made of."""
    sides = []
    for seed in (0xD6E8FEB86659FD93, 0x2545F4914F6CDD1D):
        h, width, base = mixed(data.astype(np.uint64) + np.uint64(seed & 0xFFFF)), 1, seed
        out, done = None, 0
        n = len(data) - LENGTH + 1
        while done < LENGTH:
            if LENGTH & width:
                part = h[done : done + n]
                out = part if out is None else out * np.uint64(base) + part
                done += width
            if done < LENGTH:
                h = h[:-width] * np.uint64(base) + h[width:]
                width, base = 2 * width, base * base % (1 << 64)
        sides.append(mixed(out))
    return np.stack(sides, 1)


def _windows(batches):
    """(window hash, key, start) for all windows of the wanted anchors, in
    batches of some 100,000 rows."""

    def rows(keys, hs, at):
        sizes = [len(x) for x in at]
        raw = np.concatenate(hs).astype("<u8").tobytes()
        window = pa.Array.from_buffers(pa.binary(16), sum(sizes), [None, pa.py_buffer(raw)]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([window, pa.array(keys, pa.binary()).take(pa.array(np.repeat(np.arange(len(keys)), sizes))), pa.array(np.concatenate(at), pa.int64())], ["window", "key", "start"])

    for batch in slices(batches):
        keys, hs, at, n = [], [], [], 0
        for key, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3))):
            data, want = np.frombuffer(text.encode(), np.uint8), set(wanted)
            h, _, first, last = anchors(data)
            for a, w0, w1 in zip(h.view(np.int64).tolist(), first.tolist(), last.tolist()):
                if a in want:
                    keys.append(key), at.append(np.arange(w0, w1 + 1)), hs.append(window_hashes(data[w0 : w1 + LENGTH]))
                    n += w1 - w0 + 1
                    if n > 100_000:
                        yield rows(keys, hs, at)
                        keys, hs, at, n = [], [], [], 0
        if keys:
            yield rows(keys, hs, at)


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """``df``'s rows as (id, text, covered): the covered byte ranges of each
    text, sorted and merged, as array<struct<start, end>>."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    long = docs.where(F.octet_length("text") >= LENGTH)
    counts = written(long.groupBy("key").agg(F.min("id").alias("own"), F.count("*").alias("n")), "suffix-texts")

    found = written(long.select("key", "text").mapInArrow(_anchored, "key binary, anchor long, place long"), "suffix-anchors")
    where = F.xxhash64("key", "place")
    kept = found.groupBy("anchor").agg(F.min(where).alias("low"), F.max(where).alias("high"), F.count("*").alias("n")).where("low < high").select(F.col("anchor").alias("a"), "n")
    kept = written(kept, "suffix-repeated")  # a join of two plain exchanges: a frequent anchor's rows can be split
    wanted = found.select("key", "anchor").join(kept, F.col("anchor") == F.col("a")).groupBy("key").agg(
        F.collect_set(F.when(F.col("n") <= group, F.col("anchor"))).alias("few"), F.collect_set(F.when(F.col("n") > group, F.col("anchor"))).alias("many")
    )
    wanted = written(wanted.join(counts.select("key", "own"), "key").withColumnsRenamed({"key": "k"}), "suffix-wanted")

    # the same exchange of the texts serves the search and the result
    placed = docs.repartition(2 * partitions(spark), "key")
    own = placed.join(wanted, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("own")))
    near = own.where(F.size("few") > 0).select("key", "text", "few").mapInArrow(_around, AROUND)
    spread = F.coalesce(F.col("anchor"), F.xxhash64("key"))
    near = near.repartition(2 * partitions(spark), spread).sortWithinPartitions("anchor")
    ranges = near.mapInArrow(_ranges, "key binary, start long, end long")
    if not wanted.where(F.size("many") > 0).isEmpty():
        windows = written(own.where(F.size("many") > 0).select("key", "text", "many").mapInArrow(_windows, "window binary, key binary, start long"), "suffix-windows")
        windows = windows.dropDuplicates(["key", "start"])
        # counted where they are before they are moved; a window of very many texts is then met in SALT parts
        twice = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select(F.col("window").alias("w"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("s"))
        salted = windows.withColumn("salt", F.pmod(F.xxhash64("key", "start"), F.lit(SALT)).cast("int"))
        hit = salted.join(twice, (F.col("window") == F.col("w")) & (F.col("salt") == F.col("s"))).select("key", "start", (F.col("start") + LENGTH).alias("end"))
        ranges = ranges.unionByName(written(hit, "suffix-hits"))
    copies = counts.where("n > 1").select("key", F.lit(0).cast("long").alias("start"), F.lit((1 << 62)).alias("end"))
    ranges = ranges.unionByName(copies).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    ranges = written(ranges.withColumnRenamed("key", "k2"), "suffix-ranges")
    return placed.join(ranges, F.col("key") == F.col("k2"), "left").select("id", "text", "ranges").withColumnsRenamed({"id": id_col, "text": text_col, "ranges": "covered"})


def removed(df: DataFrame, id_col: str, text_col: str, keep_bytes: bool = False) -> DataFrame:
    """From ``repeats``: id, n_bytes, n_removed, n_spans, kept_sha256, n_chars_kept
    (code points that begin in the remaining bytes) and, if asked for, these bytes."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(6)]
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = text.encode()
                spans = merged([(r["start"], min(r["end"], len(raw))) for r in ranges or ()])
                at, kept = 0, []
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                begun = len(kept) - int(((np.frombuffer(kept, np.uint8) & 0xC0) == 0x80).sum())
                for col, v in zip(out, (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), begun, kept if keep_bytes else None)):
                    col.append(v)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out, kinds))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_chars_kept", "kept"])

    cut = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), "covered")
    out = cut.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_chars_kept long, kept binary").withColumnRenamed("id", id_col)
    return out if keep_bytes else out.drop("kept")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 400-byte strings that repeat."""
    return removed(repeats(table(spark, sf_dir, "documents")), "doc_id", "text")
