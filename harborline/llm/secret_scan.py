"""Secret scan: patterns on every layer of a text, its encoded parts unwrapped until nothing is left."""

from __future__ import annotations

import binascii
import bz2
import itertools
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import pieces, subset

KINDS = ("assign", "access", "hex")
LEAST_VALUE = 6
REDACTED = "[SECRET]"

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(
    r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};"
)
#: Packed data with its bytes as percent or \\x escapes, printable ones as they are: what such data begin with, and the rest.
_PERCENT_PACKED = re.compile(
    r"(?:%1[fF]%8[bB]|x(?:%01|%5[eE]|\^|%9[cC]|%[dD][aA])|BZh[1-9]1AY|%[fF][dD]7zXZ%00|(?:%28|\()%[bB]5(?:%2[fF]|/)%[fF][dD])"
    r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~/!*'()+-])*"
)
_ESCAPE_PACKED = re.compile(
    r"(?:\\x1[fF]\\x8[bB]|x(?:\\x01|\\x5[eE]|\^|\\x9[cC]|\\x[dD][aA])|BZh[1-9]1AY|\\x[fF][dD]7zXZ\\x00|\(\\x[bB]5/\\x[fF][dD])"
    r"(?:\\x[0-9A-Fa-f]{2}|\\[nrt0\\'\"]|[\x20-\x21\x23-\x26\x28-\x5B\x5D-\x7E])*"
)
_ESCAPED_BYTES = re.compile(r"(?:\\x[0-9A-Fa-f]{2})+")
_ESCAPED_BYTE = re.compile(r"\\x([0-9A-Fa-f]{2})|\\([nrt0\\'\"])")
_NAMED_BYTE = {"n": "\n", "r": "\r", "t": "\t", "0": "\0"}
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_PART = re.compile(r"[A-Za-z0-9+]{16,}={0,2}")
#: Base64 broken over lines.
_WRAPPED = re.compile(
    r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[A-Za-z0-9+/_-]{16,}+)*+(?:\r?\n[A-Za-z0-9+/_-]++)?={0,2}"
)
_URL_SAFE = str.maketrans("-_", "+/")
#: Any text with a base finding meets the first, any other with something to unwrap the second. Arrow looks for
#: them in all texts of a batch at once; most texts have neither.
_MAY_FIND = r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=])|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""
_MAY_UNWRAP = r"%[0-9A-Fa-f]{2}|\\[uUx]|&#|[A-Za-z0-9+/_-]{16}"
_MAY = re.compile(f"{_MAY_FIND}|{_MAY_UNWRAP}", re.ASCII)
#: Unpacked bytes come in chunks of so many and are scanned in windows of at least so many, which end where no finding
#: and no run to unwrap can reach across; so a small packed text that unpacks without end doesn't fill memory.
CHUNK, WINDOW = 1 << 20, 8 << 20
#: Where a window may end: a blank away from colons and equals signs, or a line end that no base64 goes on over.
_SEAM = re.compile(rb"(?<![:=\x20])\x20(?=[^:=\x20])|(?<![A-Za-z0-9+/=_\r-])[\r\n](?=.)|[\r\n](?=[^A-Za-z0-9+/=_\r\n-])", re.DOTALL)
#: Memory that unpacking may ask for; data that want more are scanned as they are.
ZSTD_WINDOW, XZ_MEMORY = 128 << 20, 256 << 20

Span = tuple[int, int]
Found = tuple[str, int, int]


def base_spans(text: str) -> list[Found]:
    """What the patterns find in the text as it stands, in order of start and then of KINDS."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return in_order(found)


def in_order(found) -> list[Found]:
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


class Layer:
    """A text and the way its positions lead back to the layer it was unwrapped from."""

    def __init__(self, text: str, parent: Layer | None, place: Callable[[int, int], Span]):
        self.text, self.parent, self.place = text, parent, place

    def at_root(self, start: int, end: int) -> Span:
        layer: Layer | None = self
        while layer is not None:
            start, end = layer.place(start, end)
            layer = layer.parent
        return start, end

    def repeats(self) -> bool:
        """Whether an outer layer has the same text: unwrapping would go round in a circle."""
        outer = self.parent
        while outer is not None:
            if outer.text == self.text:
                return True
            outer = outer.parent
        return False


def _replaced(layer: Layer, pattern: re.Pattern, decode: Callable[[str], list[tuple[str, int]]]) -> Layer | None:
    """The layer with every match decoded; decode gives each character and how many of the match it takes."""
    out: list[str] = []
    at, size = 0, 0
    place, begin, end = [], [], []
    for m in pattern.finditer(layer.text):
        out.append(layer.text[at : m.start()])
        size += m.start() - at
        source = m.start()
        for char, taken in decode(m[0]):
            place.append(size)
            begin.append(source)
            end.append(source + taken)
            out.append(char)
            size += len(char)
            source += taken
        at = m.end()
    if not place:
        return None
    out.append(layer.text[at:])

    def first(i: int) -> Span:
        k = bisect_right(place, i) - 1
        if k < 0:
            return i, i + 1
        if place[k] == i:
            return begin[k], end[k]
        moved = end[k] + i - place[k] - 1
        return moved, moved + 1

    return Layer("".join(out), layer, lambda s, e: (first(s)[0], first(e - 1)[1]))


def _percent(run: str) -> list[tuple[str, int]]:
    return _characters(bytes.fromhex(run.replace("%", "")), 3)


def _characters(raw: bytes, width: int) -> list[tuple[str, int]]:
    """The characters of some bytes that take `width` places each; a byte that is part of none is one of Latin-1."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append((raw[i : i + n].decode("utf-8"), width * n))
            except UnicodeDecodeError:
                continue
            i += n
            break
        else:
            out.append((chr(raw[i]), width))
            i += 1
    return out


def _escape(run: str) -> list[tuple[str, int]]:
    if run.startswith("\\u") and run[2] != "{":
        units = [int(run[i + 2 : i + 6], 16) for i in range(0, len(run), 6)]
        out, i = [], 0
        while i < len(units):
            pair = 0xD800 <= units[i] < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000
            if pair:
                out.append((chr(0x10000 + ((units[i] - 0xD800) << 10) + units[i + 1] - 0xDC00), 12))
            else:
                out.append((_char(units[i]), 6))
            i += 1 + pair
        return out
    if run.startswith("\\x"):
        return _characters(bytes.fromhex(run.replace("\\x", "")), 4)
    digits = run.strip("&#;\\{}")
    value = int(digits.lstrip("uUxX{"), 16) if digits[0] in "uUxX" else int(digits)
    return [(_char(value), len(run))]


def _char(value: int) -> str:
    return "�" if value > 0x10FFFF or 0xD800 <= value < 0xE000 else chr(value)


def _opener(head: bytes):
    """A function that makes the decompressor for what the first bytes announce, or None."""
    if head[:2] == b"\x1f\x8b":
        return lambda: zlib.decompressobj(31)
    if len(head) > 2 and head[0] == 0x78 and (head[0] * 256 + head[1]) % 31 == 0:
        return zlib.decompressobj
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if head[:6] == b"\xfd7zXZ\x00":
        return lambda: lzma.LZMADecompressor(memlimit=XZ_MEMORY)
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return _ZstdFrame
    return None


class _ZstdFrame:
    """One zstd frame behind the interface of the other decompressors, its output bounded as theirs."""

    def __init__(self):
        import zstandard

        self.object = zstandard.ZstdDecompressor(max_window_size=ZSTD_WINDOW).decompressobj(write_size=CHUNK)
        self.eof, self.unused_data, self.needs_input = False, b"", True

    def decompress(self, data: bytes, limit: int) -> bytes:
        # A block unpacks to 128 KB at most, and takes 4 bytes at least.
        step = max(4, limit >> 15)
        self.pending = getattr(self, "pending", b"") + data
        part, self.pending = self.object.decompress(self.pending[:step]), self.pending[step:]
        self.eof = self.object.eof
        if self.eof:
            self.unused_data = self.object.unused_data + self.pending
        self.needs_input = not self.pending
        return part


def _is_damage(problem: Exception) -> bool:
    """Whether an error says that data are not what their first bytes announce; each library has its own."""
    return isinstance(problem, (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, MemoryError)) or "zstd" in type(problem).__name__.lower()


class _Source:
    """Chunks of bytes that can be looked into and put back."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = iter(chunks), b""

    def head(self, size: int) -> bytes:
        while len(self.held) < size and (chunk := next(self.chunks, b"")):
            self.held += chunk
        return self.held[:size]

    def take(self) -> bytes:
        """The next chunk, empty at the end."""
        chunk, self.held = self.held or next(self.chunks, b""), b""
        while not chunk and (more := next(self.chunks, None)) is not None:
            chunk = more
        return chunk


def _unpacked(source: _Source, make: Callable, kept: list[bytes], rest: list[_Source]) -> Iterator[bytes]:
    """What one packed member of the source unpacks to, chunk by chunk, as far as it is sound.

    Up to WINDOW bytes of what it was fed stand in `kept`, cleared once the member has ended well. What follows
    the member comes into `rest`.
    """
    unpack, size = make(), 0
    left = b""
    while not unpack.eof:
        if not left and getattr(unpack, "needs_input", True):
            left = source.take()
            if not left:
                return
            if size < WINDOW:
                kept.append(left)
                size += len(left)
        try:
            part = unpack.decompress(left, CHUNK)
        except Exception as problem:
            if not _is_damage(problem):
                raise
            return
        left = getattr(unpack, "unconsumed_tail", b"")
        if part:
            yield part
    kept.clear()
    rest.append(_Source(itertools.chain([unpack.unused_data], [source.held] if source.held else [], source.chunks)))


def _plain(source: _Source, outer: tuple[bytes, ...] = ()) -> Iterator[Iterator[bytes]]:
    """The unpacked streams in a source, through any number of packings and members.

    Bytes that only look packed, or whose packing breaks off, are a stream themselves, next to what came out.
    A short source that an outer one equals, as data that unpack to themselves, is not followed.
    """
    while head := source.head(8):
        make = _opener(head)
        if make is None:
            yield iter(source.take, b"")
            return
        start = source.head(WINDOW) if outer else source.head(CHUNK)
        if start in outer:
            return
        kept: list[bytes] = []
        rest: list[_Source] = []
        yield from _plain(_Source(_unpacked(source, make, kept, rest)), (*outer, start))
        if kept:
            yield iter(kept)
        if not rest:
            return
        source = rest[0]


def _windows(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """A stream in windows that end at seams; one without any is as long as it takes."""
    held = b""
    for chunk in chunks:
        looked = max(0, len(held) - 2)
        held += chunk
        if len(held) < WINDOW:
            continue
        seam = None
        for seam in _SEAM.finditer(held, looked):
            pass
        if seam is not None:
            yield held[: seam.end()]
            held = held[seam.end() :]
    if held:
        yield held


def _decoded(raw: bytes) -> str:
    """As UTF-8, or byte by byte as Latin-1."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _texts(raw: bytes) -> Iterator[tuple[str, bool]]:
    """The texts in some bytes, packed or not, and whether they are the bytes themselves."""
    if _opener(raw[:8]) is None:
        yield _decoded(raw), True
        return
    for stream in _plain(_Source(iter([raw]))):
        for window in _windows(stream):
            yield _decoded(window), window == raw


def _joined_base64(text: str) -> Iterator[tuple[str, Callable[[int], int], int, int]]:
    """Base64 runs: the run, where each of its characters stands in the text, and where it begins and ends."""
    for m in _BASE64.finditer(text):
        whole = m[0]
        runs = [(m.start(), whole)]
        if not whole.isalnum():  # the run may be a path or name that ends in the encoded part
            runs += [(m.start() + p.start(), p[0]) for p in _PART.finditer(whole) if p[0] != whole]
        for start, run in runs:
            yield run, lambda i, a=start: a + i, start, start + len(run)
    if "\n" not in text:
        return
    for m in _WRAPPED.finditer(text):
        lines = list(re.finditer(r"[^\r\n]+", m[0]))
        if len(lines) == 1:
            continue
        before = [0, *itertools.accumulate(len(line[0]) for line in lines)]
        starts = [m.start() + line.start() for line in lines]

        def at(i: int, before=before, starts=starts) -> int:
            line = min(bisect_right(before, i) - 1, len(starts) - 1)
            return starts[line] + i - before[line]

        yield "".join(line[0] for line in lines), at, m.start(), m.end()


def _packed_escapes(text: str) -> Iterator[tuple[bytes, int, int]]:
    """Packed data written as percent or \\x escapes: the bytes, and where the run begins and ends.

    Escaped throughout, or with printable bytes as they are. What printable text follows the last \\x escape may
    be of the data or not; it is unpacked with them and stays out of the place.
    """
    if "%" in text:
        for m in _PERCENT.finditer(text):
            yield bytes.fromhex(m[0].replace("%", "")), m.start(), m.end()
        for m in _PERCENT_PACKED.finditer(text):
            yield unquote_to_bytes(m[0]), m.start(), m.end()
    if "\\x" in text:
        for m in _ESCAPED_BYTES.finditer(text):
            yield bytes.fromhex(m[0].replace("\\x", "")), m.start(), m.end()
        for m in _ESCAPE_PACKED.finditer(text):
            last = m[0].rfind("\\x")
            if last >= 0:
                plain = _ESCAPED_BYTE.sub(lambda x: chr(int(x[1], 16)) if x[1] else _NAMED_BYTE.get(x[2], x[2]), m[0])
                yield plain.encode("latin-1"), m.start(), m.start() + last + 4


def _unwrapped(layer: Layer) -> Iterator[Layer]:
    text = layer.text
    for pattern, decode, sign in ((_PERCENT, _percent, "%"), (_ESCAPE, _escape, None)):
        if sign is None and "\\" not in text and "&#" not in text or sign and sign not in text:
            continue
        inner = _replaced(layer, pattern, decode)
        if inner is not None:
            yield inner
    for raw, start, end in _packed_escapes(text):
        if _opener(raw[:8]) is None:  # then the layer with its characters has it
            continue
        for inner, own in _texts(raw):
            if not own:
                yield Layer(inner, layer, lambda s, e, a=start, b=end: (a, b))
    for run, at, start, end in _joined_base64(text):
        body = run.rstrip("=").translate(_URL_SAFE)
        odd = len(body) % 4
        raw = binascii.a2b_base64(body[:-1] if odd == 1 else body + "=" * (-odd % 4))
        for inner, own in _texts(raw):
            if own:
                yield Layer(inner, layer, _base64_place(inner, len(inner) == len(raw), at))
            else:
                yield Layer(inner, layer, lambda s, e, a=start, b=end: (a, b))


def _base64_place(inner: str, single: bool, at: Callable[[int], int]) -> Callable[[int, int], Span]:
    """Places of a layer's characters, which are one byte each or as many as UTF-8 takes."""

    def place(s: int, e: int) -> Span:
        first, last = (s, e - 1) if single else (len(inner[:s].encode()), len(inner[:e].encode()) - 1)
        return at(first * 8 // 6), at((last * 8 + 7) // 6) + 1

    return place


def all_spans(text: str, base: list[Found] | None = None) -> list[Found]:
    """Base findings and those of every layer below, at the place in the text that they were unwrapped from.

    A worklist of layers: each is scanned, and its percent runs, character escapes and base64 runs (over several lines
    or not, packed inside or not), and packed data written as escapes, become further layers. Bytes that are
    no UTF-8 are read as Latin-1; those that only look packed, or break off, are read as they are, too; all members of
    packed data count. A layer whose text an outer one has, or that came up before at the same place, isn't
    followed, so the list runs empty.
    """
    found = set(base_spans(text) if base is None else base)
    seen: set[tuple[Span, str]] = set()
    work = [_unwrapped(Layer(text, None, lambda s, e: (s, e)))]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not _MAY.search(layer.text) or layer.repeats():
            continue
        mark = (layer.at_root(0, len(layer.text)), layer.text)
        if mark in seen:
            continue
        seen.add(mark)
        found.update((kind, *layer.at_root(s, e)) for kind, s, e in base_spans(layer.text))
        work.append(_unwrapped(layer))
    return in_order(found)


def redact(text: str, found: list[Found]) -> str:
    """The text with each span, overlapping ones together, replaced by a mark."""
    out, at = [], 0
    for _, start, end in in_order(found):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], REDACTED]
        at = end
    return "".join([*out, text[at:]])


def _findings(column: pa.Array) -> Iterator[tuple[list[Found], list[Found]]]:
    """Base findings and all findings of each text."""
    finds = pc.fill_null(pc.match_substring_regex(column, _MAY_FIND), False).to_pylist()
    unwraps = pc.fill_null(pc.match_substring_regex(column, _MAY_UNWRAP), False).to_pylist()
    for value, find, unwrap in zip(column, finds, unwraps):
        if not (find or unwrap):
            yield [], []
            continue
        text = value.as_py()
        base = base_spans(text) if find else []
        yield base, all_spans(text, base) if unwrap else base


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Findings of every whole text: key, base and found (arrays of kind, start, end in code points).

    base: the patterns on the text as it stands. found: base and what the decoded layers add. Null and empty
    texts have none; a text of any length is scanned whole, in memory bounded by the text, a few windows and, where
    unpacked data have no blank or line end for longer, that stretch. zstd data with a window over ZSTD_WINDOW and
    xz data that want more than XZ_MEMORY are read as they are. Rows are independent, so null or repeated keys and ties are as they come; an empty table gives
    none. Other columns play no part. No rows move between tasks.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                base, found = [], []
                for own, every in _findings(piece.column(1)):
                    base.append(as_rows(own))
                    found.append(as_rows(every))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(base, span), pa.array(found, span)], ["key", "base", "found"]
                )

    rows = subset(docs, key, text).select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return rows.mapInArrow(scan, f"key long, base {kind}, found {kind}").withColumnRenamed("key", key)


def as_rows(found: list[Found]) -> list[dict]:
    return [{"kind": k, "start": s, "end": e} for k, s, e in found]


def redact_secrets(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with every finding's span replaced; `length`, if there, is counted anew.

    Null texts stay null, empty ones empty; repeated rows, null keys and an empty table pass through as they are,
    as do all other columns, whatever their names.
    """

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for piece in pieces(batch, text):
                column = piece.column(at)
                every = [found for _, found in _findings(column)]
                if any(every):
                    values = [redact(v.as_py(), f) if f else v.as_py() for v, f in zip(column, every)]
                    column = pa.array(values, column.type)
                columns = [column if i == at else piece.column(i) for i in range(piece.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, schema=piece.schema)

    masked = docs.mapInArrow(mask, docs.schema)
    if length and length in docs.columns:
        masked = masked.withColumn(length, F.length(text).cast(docs.schema[length].dataType))
    return masked
