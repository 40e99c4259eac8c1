"""Byte-level BPE encoding and decoding with a given rank table.

Every distinct word (a match of the split pattern) is folded once: its bytes
start as single pieces and the adjacent pair of lowest rank is merged until no
pair has a rank.  The encoding of a text is the concatenation of its words';
decoding concatenates the binary pieces of the ids.  Words of a task are kept
with their ids, so a word costs its merges once and a look-up after that.

A merge fold of Spark higher-order functions over a literal rank map was
measured; see the README for its figures and why Arrow batches stand here.

Cases: a null text counts as empty; an empty text has no ids and decodes to no
bytes; texts of any length are encoded whole; repeated rows give equal rows;
an empty table gives an empty table.  No special token is ever produced.
Columns other than the two named ones are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import slices, table

#: Words kept with their ids in one task; when there are more the oldest half goes.
KEPT_WORDS = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank table of a ``.tiktoken`` file: base64 piece, blank, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


# Fixed value: the split pattern of the public vocabularies.  On texts of ASCII
# and Latin letters alone, as most are, the two patterns below find the same
# words in half the time; the second is for texts without an apostrophe.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
_PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ſ]*").fullmatch
_WORDS_ONLY = f" ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+|\\s+(?!\\S)|\\s+"
_FAST = re.compile(_WORDS_ONLY).findall
_FAST_SHORT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|" + _WORDS_ONLY).findall


def splitter(pattern: str):
    """A function from a text to its words."""
    general = regex.compile(pattern).findall
    if pattern != PATTERN:
        return general
    return lambda text: (general if _PLAIN(text) is None else _FAST_SHORT if "'" in text else _FAST)(text)


class Merges:
    """The rank table by pairs of ids: ``pairs[left << 32 | right]`` is the rank
    (which is also the id) of the joined piece."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = [ranks[bytes([i])] for i in range(256)]
        self.pairs = {
            (a << 32) | b: rank
            for piece, rank in ranks.items()
            for i in range(1, len(piece))
            if (a := ranks.get(piece[:i])) is not None and (b := ranks.get(piece[i:])) is not None
        }

    def fold(self, word: bytes) -> list[int]:
        """The ids of one word: the word's own rank, or ranked merges of its bytes.

        Long words are merged with a linked list and a heap, so they cost
        n log n and not the square of their length."""
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        if len(word) > 200:
            return self._fold_long(word)
        pair, none = self.pairs.get, 1 << 62
        ids = [self.byte[x] for x in word]
        ranks = [pair((a << 32) | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != none:
            i = ranks.index(best)
            ids[i : i + 2] = [best]
            del ranks[i]
            if i:
                ranks[i - 1] = pair((ids[i - 1] << 32) | best, none)
            if i < len(ranks):
                ranks[i] = pair((best << 32) | ids[i + 1], none)
        return ids

    def _fold_long(self, word: bytes) -> list[int]:
        pair, n = self.pairs.get, len(word)
        ids = [self.byte[x] for x in word]
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair((ids[i] << 32) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != left or ids[j] != right:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) < n and (r := pair((ids[a] << 32) | ids[b])) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return [x for x in ids if x >= 0]


class Words(dict):
    """Word to its ids as decimal text, filled on demand."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.merges = Merges(ranks)

    def __missing__(self, word: str) -> str:
        ids = ",".join(map(str, self.merges.fold(word.encode())))
        if len(word) < 100:
            if len(self) >= KEPT_WORDS:
                for old in [*self][: KEPT_WORDS // 2]:
                    del self[old]
            self[word] = ids
        return ids


#: The words of this worker process, by broadcast: its tasks share them.
_WORDS: dict[int, Words] = {}


def _words(shared) -> Words:
    if shared.id not in _WORDS:
        _WORDS.clear()
        _WORDS[shared.id] = Words(shared.value)
    return _WORDS[shared.id]


class _Shared:
    """A broadcast with an id that survives the way to the worker."""

    def __init__(self, spark: SparkSession, value):
        self.id, self.sent = uuid.uuid4().int, spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self.sent.value


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id column and ``ids array<int>``."""
    shared = _Shared(df.sparkSession, ranks)

    def run(batches):
        split, words = splitter(pattern), _words(shared)
        for batch in slices(batches):
            out = [[int(x) for w in split(t or "") for x in words[w].split(",")] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    cut = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return cut.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the bytes of its ids as a binary column; null ids: no bytes."""
    shared = df.sparkSession.sparkContext.broadcast({v: k for k, v in ranks.items()})

    @F.pandas_udf("binary")
    def joined(ids):
        pieces = shared.value
        return ids.map(lambda x: b"" if x is None else b"".join(pieces[i] for i in x))

    return df.withColumn(into, joined(F.col(ids_col)))


def digests(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``encode`` and ``decode`` in one pass: n_tokens, the digest of the ids,
    the digest of the bytes that the ids decode to, and the ids if asked for."""
    shared = _Shared(df.sparkSession, ranks)

    def run(batches):
        split, words = splitter(pattern), _words(shared)
        pieces = {str(v): k for k, v in shared.value.items()}.__getitem__
        for batch in slices(batches):
            n, a, b, c = [], [], [], []
            for text in batch.column(1).to_pylist():
                said = ",".join(map(words.__getitem__, split(text or "")))
                ids = said.split(",") if said else []
                n.append(len(ids))
                a.append(hashlib.sha256(said.encode()).hexdigest())
                b.append(hashlib.sha256(b"".join(map(pieces, ids))).hexdigest())
                c.append((np.fromstring(said, np.int32, sep=",") if said else np.empty(0, np.int32)) if with_ids else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.list_(pa.int32()))], ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    cut = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = cut.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>").withColumnRenamed("id", id_col)
    return out if with_ids else out.drop("ids")


def public_ranks(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: token counts and digests of the ids and of the decoded bytes."""
    return digests(table(spark, sf_dir, "documents"), *public_ranks())
