"""Secret scans by a worklist of recursively decoded layers.

``scan`` looks for assigned credentials, access keys and long hex strings in
every text, then unwraps URL escapes, Unicode escapes, base64 tokens and
compressed payloads layer by layer until nothing new appears.  A layer that was
seen before (by digest) is not opened again, so self-reproducing payloads end.
Findings of inner layers are reported at the place of the outermost token that
carried them, and at every such place where the same layer stands repeatedly.

A base64 token may stand behind letters of its own alphabet (``path/``, ``id_``),
which shift its frame of four: all four frames are read, and compressed payloads
are looked for at every place of them; bare deflate, which nothing marks, up to
``NEAR`` characters in or behind one of ``/+_-``, where it lasts to the token's end.

Cases: a null text counts as empty; an empty text has no span; texts of any
length are scanned whole; equal rows give equal results, one per input row;
an empty table gives an empty table.  Columns other than the two named ones
are ignored, whatever they are called.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import re
import tempfile
import zlib
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator
from operator import itemgetter
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import slices, table

# The patterns of the base scan.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines of four characters or more, and escaped bytes that begin as a compressed payload does.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{4,}+\r?\n)+(?:[A-Za-z0-9+/_-]++={0,2}|={1,2})")
PACKED_URL = re.compile(r"(?:%1[fF]%8[bB]|(?:%78|x)(?:%01|%5[eE]|\^|%9[cC]|%[dD][aA])|(?:%42|B)(?:%5[aA]|Z)(?:%68|h))(?:%[0-9A-Fa-f]{2}|[!#-$&-~])*")
PACKED_ESCAPE = re.compile(r"(?:\\x1[fF]\\x8[bB]|(?:x|\\x78)(?:\\x01|\^|\\x5[eE]|\\x9[cC]|\\x[dD][aA])|BZh(?=[1-9]))(?:\\.|[^\\\n\"'])*")

LINED = re.compile(r"[\r\n=]")
#: How compressed payloads begin inside other bytes, and text of two or four bytes a character.
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|x[\x01\x5e\x9c\xda]")
WIDE = re.compile(rb"(?:[\x01-\x7f]\x00{1,3}){5}")
NARROWED = re.compile(rb"([\x01-\x7f])\x00{1,3}")
#: What a layer must hold for anything to be found in or below it.
WORTH = re.compile(r"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{24}|[A-Za-z0-9+/_-]{16}|(?:[A-Za-z0-9+/_-]{4,}+\r?\n)|%[0-9A-Fa-f]{2}|\\[uUx]|&#|BZh")
#: The shortest secret, and the fewest bytes and base64 characters that bare deflate needs for it.
SHORTEST, DEFLATED = len("token=abcdef"), 14
#: Bare deflate begins up to so many characters into a token, or behind one that may separate.
NEAR = 64

#: A layer is decompressed in chunks, which are gathered on disk where they are more bytes than this.
MAX_LAYER = 1 << 24
CHUNK = 1 << 20

COLUMNS = "n_assign long, n_access long, n_hex long, base_spans string, spans string, n_layers long"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, by start, then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


def _character(m: re.Match) -> str | None:
    code = int(m[6]) if m[6] else int(next(g for g in m.groups() if g), 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _unescaped(text: str, pattern: re.Pattern) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The text with its escapes decoded, and the decoded runs as
    (start in the result, length there, start in the text, end there)."""
    out, runs, at, size = [], [], 0, 0
    for m in pattern.finditer(text):
        if pattern is URL:
            new = bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace")
        elif (new := _character(m)) is None:
            continue
        out += [text[at : m.start()], new]
        size += m.start() - at
        runs.append((size, len(new), m.start(), m.end()))
        size += len(new)
        at = m.end()
    out.append(text[at:])
    return "".join(out), runs


def _outer(span: tuple[int, int], runs: list[tuple[int, int, int, int]]) -> tuple[int, int]:
    """A span of the decoded text in the places of the text before it."""
    start, end = span
    if at := bisect_right(runs, start, key=itemgetter(0)):
        to, n, a, b = runs[at - 1]
        start = a if start < to + n else start + b - (to + n)
    if at := bisect_left(runs, end, key=itemgetter(0)):
        to, n, _, b = runs[at - 1]
        end = b if end <= to + n else end + b - (to + n)
    return start, end


def _packed(raw: bytes) -> bool:
    return raw[:2] == b"\x1f\x8b" or raw[:1] == b"\x78" or raw[:3] == b"BZh"


def _inflated(raw: bytes, rest: list[bytes]) -> Iterator[bytes]:
    """The decompressed bytes of all members of ``raw`` in chunks; what stands
    behind the last whole member is put into ``rest``."""
    while _packed(raw):
        bz = raw[:3] == b"BZh"
        d = bz2.BZ2Decompressor() if bz else zlib.decompressobj(47)
        data = raw
        try:
            while not d.eof:
                new = d.decompress(data, CHUNK)
                data = b"" if bz else d.unconsumed_tail
                if new:
                    yield new
                elif not d.eof and not data and (not bz or d.needs_input):
                    return  # cut off: all that is there has been read
        except (zlib.error, OSError, EOFError, ValueError):
            break
        raw = d.unused_data
    rest.append(raw)


def _gathered(chunks: Iterator[bytes]) -> bytes:
    """All chunks as one; a large layer isn't held twice for that."""
    with tempfile.SpooledTemporaryFile(MAX_LAYER) as out:
        out.writelines(chunks)
        out.seek(0)
        return out.read()


def _from_base64(token: str) -> list[bytes]:
    """The token read in its four frames, the one of its first character first."""
    body = LINED.sub("", token).replace("-", "+").replace("_", "/")
    frames = []
    for at in range(4):
        frame = body[at:] if (len(body) - at) % 4 != 1 else body[at:-1]
        frames.append(base64.b64decode(frame + "=" * (-len(frame) % 4)))
    return frames


def _from_url(run: str) -> list[bytes]:
    return [unquote_to_bytes(run)] if "%" in run else []


def _from_escapes(run: str) -> list[bytes]:
    if "\\x" not in run:
        return []
    try:
        return [run.encode("ascii", "ignore").decode("unicode_escape").encode("latin-1")]
    except (UnicodeDecodeError, UnicodeEncodeError):
        return []


def _decompressed(raw: bytes, whole: list[bool]) -> Iterator[bytes]:
    """Bare deflate in chunks; ``whole`` is told where it ends as the bytes do."""
    d, at, step = zlib.decompressobj(-15), 0, 64  # most places end in an error at once
    try:
        while not d.eof and at < len(raw):
            data, at, step = raw[at : at + step], at + step, min(2 * step, CHUNK)
            while data and not d.eof:
                yield d.decompress(data, CHUNK)
                data = d.unconsumed_tail
        if d.eof and len(d.unused_data) + len(raw[at:]) < 3:  # it ends where the token does
            whole.append(True)
    except zlib.error:
        return


def _bare(token: str, frames: list[bytes]) -> Iterator[bytes]:
    """Where bare deflate stands in a base64 token: up to ``NEAR`` characters in
    or behind a character that may separate, as far as the token's end."""
    token = LINED.sub("", token)
    for at in range(len(token) - DEFLATED * 4 // 3 + 1):
        if at > NEAR and token[at - 1] not in "/+_-":
            continue
        raw = frames[at % 4][at // 4 * 3 :]
        kind = raw[0] >> 1 & 3
        if kind == 3 or kind == 0 and int.from_bytes(raw[1:3]) ^ int.from_bytes(raw[3:5]) != 0xFFFF:
            continue
        whole: list[bool] = []
        if sum(map(len, _decompressed(raw, whole))) >= SHORTEST and whole:
            yield raw


def _begins(raw: bytes, at: int) -> bool:
    """Whether what stands there begins as a compressed payload that can be read."""
    if raw[at : at + 3] == b"BZh":
        return True
    try:
        return bool(zlib.decompressobj(47).decompress(raw[at : at + 512], 64))
    except zlib.error:
        return False


def _opened(token: str, raws: list[bytes]) -> list[str]:
    """The layers below a token's bytes, whole, a character each byte (the
    patterns are ASCII, so it doesn't matter what the other bytes mean).  Of
    several readings the first is a layer in any case, the others where they
    hold anything."""
    if not raws:
        return []
    seen, texts = set(), []
    packed = [any(_begins(raw, m.start()) for m in MAGIC.finditer(raw)) for raw in raws]
    # bytes, whether bare deflate, whether kept in any case; other frames of a payload's text mean nothing
    work = [(raw, False, k == 0) for k, raw in enumerate(raws) if k == 0 or packed[k] or not any(packed)]
    if len(raws) > 1 and not any(packed):
        work += [(raw, True, False) for raw in _bare(token, raws)]
    while work:
        raw, bare, keep = work.pop()
        digest = hashlib.blake2b(raw, digest_size=16, key=b"bare" if bare else b"").digest()
        if not raw or digest in seen:
            continue
        seen.add(digest)
        if bare or _packed(raw):
            rest: list[bytes] = []
            inner = _gathered(_decompressed(raw, []) if bare else _inflated(raw, rest))
            work += [(x, False, keep) for x in (inner, *rest)]
            if bare or rest != [raw]:
                continue
        work += [(raw[m.start() :], False, True) for m in MAGIC.finditer(raw, 1) if _begins(raw, m.start())]
        if WIDE.search(raw):
            work.append((NARROWED.sub(rb"\1", raw), False, True))
        text = raw.decode("latin-1")
        if keep or WORTH.search(text):
            texts.append(text)
    return texts


#: Tokens that carry bytes: a sign that they may be there, their pattern, and how they are read.
TOKENS = ((None, BASE64, _from_base64), ("\n", WRAPPED, _from_base64), ("%", PACKED_URL, _from_url), ("\\", PACKED_ESCAPE, _from_escapes))


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def layer_spans(text: str, base: list[tuple[int, int, int]]) -> tuple[set[tuple[int, int, int]], int]:
    """Spans of all layers below ``text`` in the places of ``text``, and how
    many different layers were opened.

    Each different layer is opened once; every place that holds it is a link
    from the layer around it, and findings go outwards over all links until
    nothing is new, so repeats are found at each of their places and circles
    of layers end."""
    root = _digest(text)
    found: dict[bytes, set[tuple[int, int, int]]] = {root: set()}
    links: dict[bytes, list[tuple[bytes, object]]] = {root: []}  # of a layer: the layers that hold it, and where
    fresh = [(root, span) for span in base]
    work: deque = deque([(root, text)])
    held: dict[tuple, list[bytes]] = {}  # a token's layers
    while work:
        outer, layer = work.popleft()
        new: list[tuple[bytes, str | None, object]] = []
        for sign, pattern in (("%", URL), ("\\&", ESCAPE)):
            if any(c in layer for c in sign) and pattern.search(layer):
                inner, runs = _unescaped(layer, pattern)
                if runs:
                    new.append((_digest(inner), inner, runs))
        for sign, pattern, read in TOKENS:
            if sign is not None and sign not in layer:
                continue
            for m in pattern.finditer(layer):
                inners: list[str | None] = []
                if (m[0], read) not in held:
                    inners = _opened(m[0], read(m[0]))
                    held[m[0], read] = [_digest(x) for x in inners]
                digests = held[m[0], read]
                step = (m.start(), m.end())
                new += [(digest, inner, step) for digest, inner in zip(digests, inners or [None] * len(digests))]
        for digest, inner, step in new:
            if digest not in found:  # then its text came along
                found[digest], links[digest] = set(), []
                fresh += [(digest, span) for span in base_spans(inner)]
                work.append((digest, inner))
            links[digest].append((outer, step))
    while fresh:
        layer, span = fresh.pop()
        if span in found[layer]:
            continue
        found[layer].add(span)
        start, kind, end = span
        for outer, step in links[layer]:
            a, b = step if isinstance(step, tuple) else _outer((start, end), step)
            if (a, kind, b) not in found[outer]:
                fresh.append((outer, (a, kind, b)))
    return found[root], len(found) - 1


def _said(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, counts by kind of the base scan, its
    spans and all spans as ``kind:start:end,...`` (code points, end exclusive,
    by start, then kind, then end) and the number of layers opened."""

    def run(batches):
        for batch in slices(batches):
            n: list[list] = [[] for _ in range(6)]
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                spans, layers = layer_spans(text, base)
                for kind in range(3):
                    n[kind].append(sum(k == kind for _, k, _ in base))
                n[3].append(_said(base))
                n[4].append(_said(sorted(spans)))
                n[5].append(layers)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            names = ["id", "n_assign", "n_access", "n_hex", "base_spans", "spans", "n_layers"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(n, kinds))], names)

    kind = df.schema[id_col].dataType.simpleString()
    cut = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return cut.mapInArrow(run, f"id {kind}, {COLUMNS}").withColumnRenamed("id", id_col)


def redact(df: DataFrame, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """``df`` with every found span (of any layer) replaced by ``mark``;
    overlapping spans are replaced as one.  Null texts stay null."""

    @F.pandas_udf("string")
    def cleaned(texts):
        def clean(text):
            if text is None:
                return None
            spans, _ = layer_spans(text, base_spans(text))
            out, at = [], 0
            for a, _, b in sorted(spans):
                if a > at or not out and a >= at:
                    out += [text[at:a], mark]
                at = max(at, b)
            return "".join([*out, text[at:]])

        return texts.map(clean, na_action=None)

    return df.withColumn(text_col, cleaned(F.col(text_col)))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: base counts, a digest of the base spans, and all spans."""
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_layers"
    )
