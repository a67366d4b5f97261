"""Encoding and decoding with merge-type SentencePiece vocabularies by a score-ordered agenda.

Tasks need sentencepiece only where the result is checked against it.
"""

from __future__ import annotations

import gc
import re
import struct
from collections.abc import Iterable, Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import chain, repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import Sent, pieces, subset

#: The mark that stands for a blank, what an unknown piece decodes to, and kinds of pieces.
BLANK, UNKNOWN_TEXT = "▁", " ⁇ "
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGE_MODEL = 2
#: A task keeps the ids of at most so many segments of at most so many characters, twice: those met since the
#: store was last full, and those of the time before.
HELD_SEGMENTS, HELD_LENGTH = 200_000, 64
#: Characters from which on a text's segments are not listed at once.
LONG_TEXT = 1 << 20
#: Characters up to which a segment's agenda is a list, and the place of a pair that is no piece.
SHORT_SEGMENT, NO_PIECE = 40, 1 << 62
#: The same in an agenda over many segments, whose entries hold the place above so many bits for the symbol.
NO_PLACE, PLACE_SHIFT = 1 << 30, 32
#: Bits that number the symbols of a segment within an entry of the agenda.
SYMBOL_BITS = 40
SYMBOL_MASK = (1 << SYMBOL_BITS) - 1


class Pieces:
    """A merge-type vocabulary as encoding and decoding need it.

    Supported: byte fallback, one blank before the text, no other normalisation, and pieces of the kinds normal,
    unknown, control and byte. Anything else is an error, as its texts would be cut otherwise.
    """

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != MERGE_MODEL or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError("only merge-type vocabularies with byte fallback and blanks as prefixes are supported")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("only vocabularies without normalisation, but with a blank before the text, are supported")
        kinds = [p.type for p in proto.pieces]
        if set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        names = [p.piece for p in proto.pieces]
        self.model = model
        self.begin, self.end = trainer.bos_id, trainer.eos_id
        self.kinds = np.array(kinds, np.int8)
        self.id_of = {name: i for i, (name, kind) in enumerate(zip(names, kinds)) if kind == NORMAL}
        self.byte_id = {int(name[3:5], 16): i for i, (name, kind) in enumerate(zip(names, kinds)) if kind == BYTE}
        # Equal scores are one place in the order: of their pairs the leftmost merges first.
        place = {score: at for at, score in enumerate(sorted({p.score for p in proto.pieces}, reverse=True))}
        self.place = {name: place[proto.pieces[i].score] for name, i in self.id_of.items() if len(name) > 1}
        shown = {NORMAL: lambda x: x.replace(BLANK, " ").encode(), UNKNOWN: lambda x: UNKNOWN_TEXT.encode(), CONTROL: lambda x: b"",
                 BYTE: lambda x: bytes([int(x[3:5], 16)])}
        self.shown = [shown[kind](name) for name, kind in zip(names, kinds)]
        # Two symbols merge only if some piece holds the characters on both sides of the seam next to each other. So a
        # text may be cut around characters that no longer piece holds, and before a blank where none holds one inside.
        joining = {c for name in self.place for c in name}
        inside = any(BLANK in name.lstrip(BLANK) for name in self.place)
        solid = re.escape("".join(sorted(joining - (set() if inside else {BLANK}))))
        every = re.escape("".join(sorted(joining)))
        lead = "" if inside else f"{BLANK}*"
        branches = ([f"{lead}[{solid}]+"] if solid else []) + ([] if inside else [f"{BLANK}+"]) + [f"[^{every}]+" if every else "(?s:.)+"]
        self.segment = "|".join(branches)
        # A character that stands alone wherever it stands: what follows it is cut as if the text began there.
        self.alone = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in joining)
        self.pairs = PairTable(sorted(joining), self.place, self.id_of)


class PairTable:
    """All pairs of symbols that are pieces, by number: what an agenda over many segments at once looks up.

    A symbol is a character of some piece or a piece, so the pairs are the ways to cut a piece into two such: as
    many as the vocabulary has letters, at most.
    """

    def __init__(self, letters: Sequence[str], place: dict[str, int], id_of: dict[str, int]):
        names = [*letters, *place]
        number = {name: i for i, name in enumerate(names)}
        self.names = len(names)
        self.letter = np.full(0x110000, -1, np.int32)
        self.letter[[ord(x) for x in letters]] = np.arange(len(letters))
        self.id = np.array([id_of.get(name, -1) for name in names], np.int64)
        cuts = ((name[:i], name[i:], name) for name in place for i in range(1, len(name)))
        found = sorted((number[a] * self.names + number[b], place[whole], number[whole]) for a, b, whole in cuts if a in number and b in number)
        self.key, self.place, self.whole = (np.array([x[i] for x in found], np.int64) for i in range(3))

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each pair, NO_PLACE for those that are no piece, and the symbol it becomes."""
        if not len(self.key):
            return np.full(len(left), NO_PLACE), np.zeros(len(left), np.int64)
        wanted = left * np.int64(self.names) + right
        at = np.minimum(self.key.searchsorted(wanted), len(self.key) - 1)
        return np.where(self.key[at] == wanted, self.place[at], NO_PLACE), self.whole[at]

    def merged(self, segments: Sequence[str]) -> list[bytes | None]:
        """The packed ids of each segment, None where a character is no piece and has to be spelt in bytes.

        Each segment has its own agenda, the places of its adjacent pairs in a row; all are worked off side by side. A
        round merges the best pair of each, of equal ones the leftmost, and looks its new neighbours up; segments
        without any pair left drop out.
        """
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        symbol = self.letter[np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)].astype(np.int64)
        begin = np.cumsum(size) - size  # where a segment's symbols lie at first, and its last ones in the end
        last, left = np.full(len(symbol), -1, np.int64), np.zeros(len(segments), np.int64)
        known = np.ones(len(segments), bool)
        known[np.repeat(np.arange(len(segments)), size)[symbol < 0]] = False
        which = np.flatnonzero(known)
        symbol = symbol[np.repeat(known, size)]
        start = np.cumsum(size[which]) - size[which]
        place, whole = self.look(symbol, np.append(symbol[1:], 0))
        place[start[1:] - 1] = NO_PLACE
        place[-1:] = NO_PLACE
        while len(which):
            best = np.minimum.reduceat(place << PLACE_SHIFT | np.arange(len(place)), start)
            length = np.diff(start, append=len(symbol))
            live = best < NO_PLACE << PLACE_SHIFT
            keep = np.repeat(live, length)
            if not live.all():
                done = which[~live]
                left[done] = length[~live]
                to = np.repeat(begin[done] - (np.cumsum(left[done]) - left[done]), left[done]) + np.arange(left[done].sum())
                last[to] = symbol[~keep]
            at = best[live] & (1 << PLACE_SHIFT) - 1
            symbol[at] = whole[at]
            place[at] = np.where(at + 1 == (start + length)[live] - 1, NO_PLACE, place[at])
            keep[at + 1] = False
            at = np.cumsum(keep)[at] - 1
            symbol, place, whole, which = symbol[keep], place[keep], whole[keep], which[live]
            length = length[live] - 1
            start = np.cumsum(length) - length
            for near in (at[at + 1 < start + length], at[at > start] - 1):
                place[near], whole[near] = self.look(symbol[near], symbol[near + 1])
        ids = np.where(last >= 0, self.id[last], 0)
        known[np.repeat(np.arange(len(segments)), size)[ids < 0]] = False
        packed = ids.astype("<u4").tobytes()
        ends = begin + left
        return [packed[4 * a : 4 * b] if k else None for a, b, k in zip(begin.tolist(), ends.tolist(), known.tolist())]


class Coder:
    """Encodes and decodes single texts; holds the ids of segments met before, and lists those newly encoded."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.pattern = re.compile(pieces.segment)
        self.fresh: list[tuple[str, bytes]] = []
        self.held: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def cut(self, text: str) -> Iterable[str]:
        """The segments of a text, of a long one as they are asked for."""
        if not text:
            return ()
        marked = BLANK + text.replace(" ", BLANK)
        return self.pattern.findall(marked) if len(text) <= LONG_TEXT else (m[0] for m in self.pattern.finditer(marked))

    def merged(self, segment: str) -> list[str]:
        """The symbols left when no adjacent pair is a piece any more.

        The agenda holds adjacent pairs that are pieces, the best score first, then the leftmost; a pair taken from it becomes one
        symbol, and its new pairs with both neighbours enter. A short segment's agenda is a list with the score
        of each pair, which its best is looked up in; a longer one's is a heap, where pairs whose symbols
        have changed since are passed over.
        """
        if len(segment) > SHORT_SEGMENT:
            return self._merged_by_heap(segment)
        symbols, look = list(segment), self.pieces.place.get
        agenda = list(map(look, map(add, segment, segment[1:]), repeat(NO_PIECE)))
        while agenda and (best := min(agenda)) < NO_PIECE:
            at = agenda.index(best)
            symbol = symbols[at] = symbols[at] + symbols.pop(at + 1)
            del agenda[at]
            if at < len(agenda):
                agenda[at] = look(symbol + symbols[at + 1], NO_PIECE)
            if at:
                agenda[at - 1] = look(symbols[at - 1] + symbol, NO_PIECE)
        return symbols

    def _merged_by_heap(self, segment: str) -> list[str]:
        symbols, look = list(segment), self.pieces.place.get
        count = len(symbols)
        # The place of the pair that begins at each symbol, as it stands now; an entry of the agenda is
        # place and symbol in one number.
        now = list(map(look, map(str.__add__, symbols, symbols[1:])))
        agenda = [at << SYMBOL_BITS | left for left, at in enumerate(now) if at is not None]
        if not agenda:
            return symbols
        now.append(None)
        heapify(agenda)
        before, after = list(range(-1, count - 1)), list(range(1, count + 1))
        while agenda:
            entry = heappop(agenda)
            left = entry & SYMBOL_MASK
            if now[left] != entry >> SYMBOL_BITS:
                continue
            right = after[left]
            symbol = symbols[left] = symbols[left] + symbols[right]
            symbols[right] = ""
            now[right] = None
            after[left] = following = after[right]
            if following < count:
                before[following] = left
                at = now[left] = look(symbol + symbols[following])
                if at is not None:
                    heappush(agenda, at << SYMBOL_BITS | left)
            else:
                now[left] = None
            previous = before[left]
            if previous >= 0:
                at = now[previous] = look(symbols[previous] + symbol)
                if at is not None:
                    heappush(agenda, at << SYMBOL_BITS | previous)
        return [s for s in symbols if s]

    def _ids(self, segment: str) -> bytes:
        out: list[int] = []
        for symbol in self.merged(segment):
            known = self.pieces.id_of.get(symbol)
            if known is not None:
                out.append(known)
            else:
                out += [self.pieces.byte_id[b] for b in symbol.encode()]
        return struct.pack(f"<{len(out)}I", *out)

    def encode(self, text: str, begin: bool = True, end: bool = True) -> bytes:
        """The ids, packed as little-endian unsigned 32-bit integers."""
        parts = [struct.pack("<I", self.pieces.begin)] if begin else []
        held = self.held
        for segment in self.cut(text):
            ids = held.get(segment)
            if ids is None:
                ids = self.older.get(segment)
                if ids is None:
                    ids = self._ids(segment)
                    self.fresh.append((segment, ids))
                if len(segment) <= HELD_LENGTH:
                    if len(held) >= HELD_SEGMENTS:
                        self.older, self.held = held, {}
                        held = self.held
                    held[segment] = ids
            parts.append(ids)
        if end:
            parts.append(struct.pack("<I", self.pieces.end))
        return b"".join(parts)

    def encode_all(self, texts: Sequence[str], begin: bool = True, end: bool = True) -> list[bytes]:
        """The packed ids of each text; what none of them met before is encoded side by side."""
        if len(self.held) >= HELD_SEGMENTS:
            self.older, self.held = self.held, {}
        held, older = self.held, self.older
        cuts = [self.cut(x) if len(x) <= LONG_TEXT else None for x in texts]
        missing = set(chain.from_iterable(x for x in cuts if x)).difference(held)
        held |= {x: older[x] for x in missing if x in older}
        new = [x for x in missing if x not in held]
        short = [x for x in new if len(x) <= SHORT_SEGMENT]
        ids = dict(zip(short, self.pieces.pairs.merged(short))) if short else {}
        ids |= {x: self._ids(x) for x in new if ids.get(x) is None}
        held |= ids
        self.fresh += ids.items()
        lead = struct.pack("<I", self.pieces.begin) if begin else b""
        tail = struct.pack("<I", self.pieces.end) if end else b""
        out = [None if x is None else lead + b"".join(map(held.__getitem__, x)) + tail for x in cuts]
        for x in ids:
            if len(x) > HELD_LENGTH:
                del held[x]
        return [self.encode(x, begin, end) if y is None else y for x, y in zip(texts, out)]

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that form no character become replacement characters, one each."""
        numbers = np.frombuffer(ids, "<u4")
        kinds = self.pieces.kinds[numbers]
        shown = self.pieces.shown
        visible = np.flatnonzero(kinds != CONTROL)
        if not len(visible):
            return ""
        inner = slice(visible[0], visible[-1] + 1)
        numbers, kinds = numbers[inner], kinds[inner]
        # The blank before the text goes, unless bytes or an unknown piece open it.
        opens = int(kinds[0] == NORMAL and shown[numbers[0]].startswith(b" "))
        if not (kinds == CONTROL).any():
            try:
                return b"".join([shown[i] for i in numbers.tolist()])[opens:].decode()
            except UnicodeDecodeError:
                pass
        out: list[str] = []
        turns = np.flatnonzero(np.r_[True, (kinds[1:] == BYTE) != (kinds[:-1] == BYTE), True])
        for start, stop in zip(turns[:-1].tolist(), turns[1:].tolist()):
            if kinds[start] == BYTE:
                out.append(_characters(b"".join(shown[i] for i in numbers[start:stop].tolist())))
            else:
                out += [shown[i].decode() for i in numbers[start:stop].tolist()]
        return "".join(out)[opens:]


def _characters(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        for size in range(1, 5):
            try:
                out.append(data[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def read_pieces(path: str) -> Pieces:
    with open(path, "rb") as file:
        return Pieces(file.read())


def encode_texts(
    docs: DataFrame,
    vocabulary: Pieces,
    key: str = "doc_id",
    text: str = "text",
    begin: bool = True,
    end: bool = True,
    check: bool = True,
) -> DataFrame:
    """Key, ids, n_tokens, decoded and agrees of each whole text.

    ids (binary) are packed as little-endian unsigned 32-bit integers, with the begin and end ids where asked;
    n_tokens (long) counts all of them; decoded (string) is their text, which differs from the input only in that
    a mark for a blank becomes a blank. With `check`, each slice of an Arrow batch also goes through the
    sentencepiece library: every segment that the agenda encoded anew, for its ids and for what they decode to. agrees
    (boolean) says whether all segments of a text came out the same there, and its ids decoded to the text they stand
    for; without `check` it is null.

    Rows don't move; the vocabulary goes to the tasks as a broadcast of its own size. A text is cut where no
    piece can reach across, so memory follows the text and not its pairs; a stretch without any such place
    takes time in proportion to its length times its logarithm. Null texts count as empty: the begin and
    end ids alone. Null and repeated keys come out as they are; an empty table gives no rows; other columns play no part.
    """
    held = Sent(docs.sparkSession, vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(held.value)
        library = Library(coder) if check else None
        gc.disable()  # nothing here refers back to itself, and the stores of segments are large to walk
        for batch in batches:
            for piece in pieces(batch):
                texts = [x or "" for x in piece.column(1).to_pylist()]
                ids = coder.encode_all(texts, begin, end)
                decoded = [coder.decode(x) for x in ids]
                agrees = library.agrees(texts, decoded) if check else [None] * len(texts)
                coder.fresh = []
                columns = [
                    piece.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "ids", "n_tokens", "decoded", "agrees"])

    rows = subset(docs, key, text).select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    coded = rows.mapInArrow(encode, "key long, ids binary, n_tokens long, decoded string, agrees boolean")
    return coded.withColumnRenamed("key", key)


def decode_ids(frame: DataFrame, vocabulary: Pieces, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """Key and decoded of packed ids, as encode_texts gives them; null ids decode to null."""
    held = Sent(frame.sparkSession, vocabulary)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(held.value)
        for batch in batches:
            for piece in pieces(batch, "ids"):
                texts = [None if x is None else coder.decode(x) for x in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(texts, pa.string())], ["key", "decoded"])

    rows = subset(frame, key, ids).select(F.col(key).cast("long").alias("key"), F.col(ids).cast("binary").alias("ids"))
    return rows.mapInArrow(decode, "key long, decoded string").withColumnRenamed("key", key)


class Library:
    """The sentencepiece library beside a coder."""

    def __init__(self, coder: Coder):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=coder.pieces.model)
        self.coder = coder
        self.alone = coder.pieces.alone
        self.lead = len(self.processor.encode(self.alone))
        self.differing: set[str] = set()

    def agrees(self, texts: Sequence[str], decoded: Sequence[str]) -> list[bool]:
        """Whether all segments of each text have the library's ids, and its ids and the coder's the same text back."""
        fresh, alone = self.coder.fresh, self.alone
        own = self.processor.encode([alone + segment for segment, _ in fresh], num_threads=1)
        back = self.processor.decode(own, num_threads=1)
        self.differing |= {
            segment
            for (segment, packed), x, text in zip(fresh, own, back)
            if struct.pack(f"<{len(x) - self.lead}I", *x[self.lead :]) != packed or text != alone + segment.replace(BLANK, " ")
        }
        return [
            text == whole.replace(BLANK, " ") and not (self.differing and not self.differing.isdisjoint(self.coder.cut(whole)))
            for text, whole in zip(decoded, texts)
        ]
