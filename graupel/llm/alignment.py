"""Two tokenizers aligned on every text, each distinct segment once.

A text is cut before runs of white space at which neither vocabulary can merge:
the first splits words there itself, and of the second every piece is looked
through (``starts``).  A segment's tokens are so the text's own there.  The job:

1. texts are packed; a pack holds its documents as numbers of its distinct
   segments, frequent ones first, and those segments once with their
   occurrences (``packs``);
2. the distinct segments of all packs are gathered with their places, that is
   packs and numbers there, and are tokenised and aligned once (``aligned``):
   byte offsets where tokens of both end cut groups, and each byte range between
   two ends of either is one link of two tokens;
3. links of documents that both tokenizers give back byte by byte are counted
   by pair of ids, and each segment gets the sum of its links' counts;
4. alignments go back to the places, those of a task for one pack as one
   compressed row, and each pack composes its documents.

A segment's places are gathered for 4,096 input partitions at a time, so that
no row grows with the corpus; beyond these it is aligned once for each.

Cases: a null or empty text, or one whose tokens don't join to its bytes in
either tokenizer, has no tokens: zeros and an empty digest, and its links count
nowhere; a text of white space, or of one long run, is one segment; repeated
rows are documents of their own; null ids are kept; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table, written
from .terms import packed

BLANK = "▁"
#: Bytes of text of a pack.
PACK = 18 << 20
#: A place is the input partition, the pack there and the segment's number there, in 21, 13 and 29 bits.
PACK_BITS, AT_BITS = 13, 29
#: Places whose alignments are sorted and compressed together in a task.
POSTED = 150_000
#: Pairs of ids that are sent to every executor (17 bytes each); more are joined.
SENT_PAIRS = 4_000_000
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable
    Latin-1 characters stand for themselves, the other bytes for the characters
    from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """A byte-level tokenizer (JSON) and a piece model (bytes), loaded."""

    def __init__(self, byte_level: str, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        letter = _byte_letters()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for said, i in vocabulary.items():
            self.a_bytes[i] = bytes(letter[c] for c in said) if all(c in letter for c in said) else said.encode()
        n = self.b.get_piece_size()
        said = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(said)]
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.blank = self.b.piece_to_id(BLANK)
        self.starts = self._starts(json.loads(byte_level), [p for i, p in enumerate(said) if not self.b.is_byte(i)])

    def _starts(self, config: dict, pieces: list[str]) -> str:
        """The white space before which a text may be cut, after a character
        that is none: no piece holds a blank behind another character, or the
        white space in question at all."""
        words = config.get("pre_tokenizer") or {}
        if config.get("normalizer") or words.get("type") != "ByteLevel" or not words.get("use_regex") or words.get("add_prefix_space"):
            return ""
        if self.b.encode("  a") == self.b.encode(" a"):  # blanks are not kept
            return ""
        ok = " " if all(BLANK not in p.lstrip(BLANK) for p in pieces) else ""
        return ok + "".join(c for c in "\n\t" if ok and not any(c in p for p in pieces))

    def tokens(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for segments that begin with a blank or another start."""
        a = [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]
        b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)  # the model adds the blank
        return a, [[self.blank] if s == " " else ids if s[0] == " " else ids[1:] for s, ids in zip(segments, b)]


_LOADED: dict[str, Pair] = {}


@dataclass
class Shared:
    """Two tokenizers by broadcast of their files; a worker loads them once."""

    sent: object
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def pair(self) -> Pair:
        if self.key not in _LOADED:
            _LOADED.clear()
            _LOADED[self.key] = Pair(*self.sent.value)
        return _LOADED[self.key]


def segmenter(starts: str):
    """A function from a text to its segments; runs of white space at the end
    stay with the last one."""
    if not starts:
        return lambda text: [text]
    cut = re.compile(rf"\s*\S+(?:[^\S{re.escape(starts)}]\s*\S+)*(?:\s+\Z)?").findall
    return lambda text: cut(text) or [text]


def coded(numbers: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes; small ones are mostly zeros."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def decoded(said: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(said), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def packs(df: DataFrame, id_col: str, text_col: str, starts: str) -> DataFrame:
    """Rows of two kinds: (pack, id, codes) for a document, (place, segment, n)
    for a distinct segment of a pack."""

    def run(batches):
        split, k = segmenter(starts), TaskContext.get().partitionId() << PACK_BITS
        last = k + (1 << PACK_BITS)
        for piece in packed(batches, 1, PACK):
            numbers: dict[str, int] = {}
            found = [np.array([numbers.setdefault(s, len(numbers)) for s in split(" " + t)], np.int32) if t else np.empty(0, np.int32) for t in piece.column(1).to_pylist()]
            n, m = len(found), len(numbers)
            if m >> AT_BITS or k == last:
                raise ValueError("more segments or packs in a task than places can say")
            counts = np.bincount(np.concatenate(found), minlength=m)
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(m, np.int64)
            rank[order] = np.arange(m)
            codes = pa.array([coded(rank[x]) for x in found], pa.binary())
            none = lambda kind, size: pa.nulls(size, kind)
            names = ["pack", "id", "codes", "place", "segment", "n"]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k)), piece.column(0), codes, none(pa.int64(), n), none(pa.string(), n), none(pa.int64(), n)], names)
            words = pa.array([*numbers], pa.string()).take(pa.array(order))
            yield pa.RecordBatch.from_arrays([none(pa.int64(), m), none(piece.column(0).type, m), none(pa.binary(), m), pa.array((k << AT_BITS) + np.arange(m)), words, pa.array(counts[order].astype(np.int64))], names)
            k += 1

    cut = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return cut.mapInArrow(run, f"pack long, id {df.schema[id_col].dataType.simpleString()}, codes binary, place long, segment string, n long")


def gathered(words: DataFrame) -> DataFrame:
    """(segment, part, n, places): each distinct segment of 4,096 partitions."""
    part = F.shiftright("place", AT_BITS + PACK_BITS + 12).alias("part")
    return words.groupBy("segment", part).agg(F.sum("n").alias("n"), F.collect_list("place").alias("places"))


def align(pair: Pair, segments: list[str]) -> dict[str, pa.Array]:
    """For each segment: whether both tokenizers give back its bytes, the sizes
    of its alignment, its groups as text and its links as ``a << 32 | b``."""
    a, b = pair.tokens(segments)
    ok = np.zeros(len(segments), bool)
    for k, s in enumerate(segments):
        raw = s.encode()
        ok[k] = b"".join([pair.a_bytes[i] for i in a[k]]) == raw == b"".join([pair.b_bytes[i] for i in b[k]])
    sides = []
    for ids, size in ((a, pair.a_size), (b, pair.b_size)):
        n = np.array([len(x) if good else 0 for x, good in zip(ids, ok)], np.int64)
        flat = np.array([i for x, good in zip(ids, ok) if good for i in x], np.int64)
        sides.append((flat, np.cumsum(size[flat]), n))
    (fa, ea, na), (fb, eb, nb) = sides
    last_a, last_b = np.cumsum(na), np.cumsum(nb)
    ends = np.union1d(ea, eb)
    ia, ib = np.searchsorted(ea, ends), np.searchsorted(eb, ends)
    links = (fa[ia] << 32) | fb[ib]
    owner = np.searchsorted(last_a, ia, "right")
    common = np.intersect1d(ea, eb, assume_unique=True)
    ja, jb = np.searchsorted(ea, common) + 1, np.searchsorted(eb, common) + 1
    sa, sb = [*map(str, fa.tolist())], [*map(str, fb.tolist())]
    groups, pa_, pb_ = [], 0, 0
    for x, y in zip(ja.tolist(), jb.tolist()):
        groups.append((sa[pa_] if x == pa_ + 1 else ",".join(sa[pa_:x])) + "|" + (sb[pb_] if y == pb_ + 1 else ",".join(sb[pb_:y])))
        pa_, pb_ = x, y
    n_links = np.bincount(owner, minlength=len(segments))
    n_groups = np.bincount(np.searchsorted(last_a, ja - 1, "right"), minlength=len(segments))
    at = [0, *np.cumsum(n_groups).tolist()]
    return {
        "ok": pa.array(ok), **{k: pa.array(v.astype(np.int32)) for k, v in zip(COUNTS, (na, nb, n_groups, n_links))},
        "groups": pa.array([";".join(groups[x:y]) for x, y in zip(at, at[1:])], pa.string()),
        "links": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_links))), pa.int32()), pa.array(links)),
    }


_KINDS = "ok boolean, n_a int, n_b int, n_groups int, n_links int, groups string, links array<long>"


def aligned(segments: DataFrame, shared: Shared) -> DataFrame:
    """``segments`` (segment, part, n, places) with their alignments."""

    def run(batches):
        pair = shared.pair
        for piece in packed(batches, 0, 1 << 18):
            got = align(pair, piece.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*piece.columns, *got.values()], [*piece.schema.names, *got])

    return segments.select("segment", "part", "n", "places").mapInArrow(run, f"segment string, part long, n long, places array<long>, {_KINDS}")


def _only_whole(found: DataFrame, docs: DataFrame) -> DataFrame:
    """``found`` without the occurrences in documents that hold a segment which
    a tokenizer doesn't give back."""
    bad = found.where("not ok").select(F.explode("places").alias("place"))
    if bad.isEmpty():
        return found
    marks = bad.groupBy(F.shiftright("place", AT_BITS).alias("pack")).agg(F.collect_set(F.col("place").bitwiseAND(F.lit((1 << AT_BITS) - 1))).alias("bad"))

    def lost(batches):
        for batch in batches:
            for pack, codes, marked in zip(*(c.to_pylist() for c in batch.columns)):
                at = decoded(codes)
                if np.isin(at, marked).any():
                    at, n = np.unique(at, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array((pack << AT_BITS) + at), pa.array(n.astype(np.int64))], ["place", "less"])

    less = docs.select("pack", "codes").join(marks, "pack").mapInArrow(lost, "place long, less long").groupBy("place").agg(F.sum("less").alias("less"))
    less = found.select("segment", "part", F.explode("places").alias("place")).join(less, "place").groupBy("segment", "part").agg(F.sum("less").alias("less"))
    return written(found.join(less, ["segment", "part"], "left").withColumn("n", F.col("n") - F.coalesce("less", F.lit(0))).drop("less"), "alignment-whole")


def pair_counts(found: DataFrame) -> DataFrame:
    """(link, count, best): how many links hold each pair of ids, and whether no
    pair of its second id has more."""
    counts = found.where("n > 0").select("n", F.explode("links").alias("link")).groupBy("link").agg(F.sum("n").alias("count")).withColumn("b", F.col("link").bitwiseAND(F.lit(0xFFFFFFFF)))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("link", "count", (F.col("count") == F.col("most")).alias("best"))


def rated(found: DataFrame, counts: DataFrame, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """``found`` without links, with the sum of its links' counts and the
    number of those that are best for their second id."""
    kept = [c for c in found.columns if c != "links"]
    if counts.count() > sent_pairs:
        sums = found.select("segment", "part", F.explode("links").alias("link")).join(counts, "link").groupBy("segment", "part").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))
        return found.select(*kept).join(sums, ["segment", "part"], "left").fillna(0, ["n_best", "count_sum"])
    held = counts.orderBy("link").toArrow()
    sent = found.sparkSession.sparkContext.broadcast(tuple(held[c].to_numpy() for c in ("link", "count", "best")))

    def run(batches):
        link, count, best = sent.value
        for batch in batches:
            lists = batch.column(len(kept))
            bounds = lists.offsets.to_numpy()
            wanted = lists.flatten().to_numpy()
            at = np.minimum(np.searchsorted(link, wanted), max(len(link) - 1, 0))
            known = link[at] == wanted if len(link) else np.zeros(len(wanted), bool)
            totals = [np.concatenate(([0], np.cumsum(np.where(known, x[at].astype(np.int64) if len(link) else 0, 0)))) for x in (best, count)]
            sums = [t[bounds[1:] - bounds[0]] - t[bounds[:-1] - bounds[0]] for t in totals]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *map(pa.array, sums)], [*kept, "n_best", "count_sum"])

    kinds = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in kept)
    return found.select(*kept, "links").mapInArrow(run, f"{kinds}, n_best long, count_sum long")


SUMS = (*COUNTS, "n_best", "count_sum")


def posted(found: DataFrame) -> DataFrame:
    """(pack, size, said): the alignments of segments, dealt to their places;
    those that a task has for one pack are compressed together."""

    def packets(tables):
        rows = pa.Table.from_batches(tables).combine_chunks()
        places = rows["places"].combine_chunks()
        place = places.flatten().to_numpy()
        owner = np.repeat(np.arange(len(rows)), np.diff(places.offsets.to_numpy()))
        order = np.argsort(place)
        place, owner = place[order], owner[order]
        numbers = np.stack([rows[c].to_numpy().astype(np.int64) for c in SUMS])
        ok, groups = rows["ok"].to_numpy().astype(np.uint8), rows["groups"].to_pylist()
        pack = place >> AT_BITS
        first = np.flatnonzero(np.concatenate(([True], pack[1:] != pack[:-1]))) if len(pack) else np.empty(0, np.int64)
        bounds = [*first.tolist(), len(pack)]
        said = []
        for x, y in zip(bounds, bounds[1:]):
            mine = owner[x:y]
            at = np.diff(place[x:y] & ((1 << AT_BITS) - 1), prepend=0)
            planes = np.concatenate((at[None], numbers[:, mine])).astype("<i8").tobytes()
            said.append(zlib.compress(np.frombuffer(planes, np.uint8).reshape(-1, 8).T.tobytes() + ok[mine].tobytes() + "\n".join([groups[i] for i in mine.tolist()]).encode(), 1))
        return pa.RecordBatch.from_arrays([pa.array(pack[first]), pa.array(np.diff(bounds).astype(np.int64)), pa.array(said, pa.binary())], ["pack", "size", "said"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column(0).flatten())
            if size >= POSTED:
                yield packets(held)
                held, size = [], 0
        if held:
            yield packets(held)

    return found.select("places", "ok", "groups", *SUMS).mapInArrow(run, "pack long, size long, said binary")


def compose(docs: pa.Table, words: pa.Table) -> pa.Table:
    """The documents of one pack from the alignments of its segments."""
    size = sum(words["size"].to_pylist())
    numbers, bad, said = np.zeros((len(SUMS), size), np.int64), np.zeros(size, bool), [""] * size
    for n, packet in zip(words["size"].to_pylist(), words["said"].to_pylist()):
        raw = zlib.decompress(packet)
        k = 8 * n * (len(SUMS) + 1)
        planes = np.ascontiguousarray(np.frombuffer(raw, np.uint8, k).reshape(8, -1).T).view("<i8").reshape(-1, n)
        at = np.cumsum(planes[0])
        numbers[:, at] = planes[1:]
        bad[at] = np.frombuffer(raw, np.uint8, n, k) == 0
        for i, x in zip(at.tolist(), raw[k + n :].decode().split("\n")):
            said[i] = x
    codes = [decoded(x) for x in docs["codes"].to_pylist()]
    bounds = np.cumsum([0, *map(len, codes)])
    flat = np.concatenate(codes)
    lost = np.concatenate(([0], np.cumsum(bad[flat])))
    whole = (lost[bounds[1:]] == lost[bounds[:-1]]) & (bounds[1:] > bounds[:-1])
    out = {"id": docs["id"]}
    for c, v in zip(SUMS, numbers):
        total = np.concatenate(([0], np.cumsum(v[flat])))
        out[c] = pa.array(np.where(whole, total[bounds[1:]] - total[bounds[:-1]], 0))
    out["groups_sha256"] = pa.array([hashlib.sha256(";".join(map(said.__getitem__, x.tolist())).encode()).hexdigest() if good else "" for x, good in zip(codes, whole.tolist())], pa.string())
    return pa.table(out)


def align_documents(df: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """One row a document: the id, the sizes of its alignment, of its links how
    many are the corpus's first for their second id, the sum of their counts,
    and the digest of the groups.  ``byte_level`` and ``pieces`` are the paths
    of the two vocabularies on the driver."""
    with open(byte_level, encoding="utf-8") as f, open(pieces, "rb") as g:
        files = f.read(), g.read()
    shared = Shared(df.sparkSession.sparkContext.broadcast(files))
    rows = written(packs(df, id_col, text_col, shared.pair.starts), "alignment-packs")
    docs = rows.where("pack is not null").select("pack", "id", "codes")
    words = rows.where("place is not null").select("place", "segment", "n")
    found = written(aligned(gathered(words), shared), "alignment-segments")
    counts = written(pair_counts(_only_whole(found, docs)), "alignment-counts")
    kind = df.schema[id_col].dataType.simpleString()
    sums = ", ".join(f"{c} long" for c in SUMS)
    out = docs.groupBy("pack").cogroup(posted(rated(found.drop("n"), counts, sent_pairs)).groupBy("pack")).applyInArrow(compose, f"id {kind}, {sums}, groups_sha256 string")
    return out.withColumnRenamed("id", id_col)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, aligned between the public byte-level and piece vocabularies."""
    import public_tokenizers

    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
