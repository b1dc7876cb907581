"""SentencePiece BPE encoding and decoding by backtracking over longest matches.

Merging by rank gives exactly one sequence of pieces in which each two neighbours, taken alone, merge back
into themselves.  So no merging of whole texts is needed: an Aho-Corasick automaton finds the longest piece
that begins at each place; going left to right, a piece is accepted when it is compatible with the piece
before it, that is when merging the text of both from characters gives just these two.  If it isn't, its
longest proper prefix among the pieces is tried next; if none is left, the piece before is taken back, and
the place where it ended is marked in a bit field of failed positions, never to be entered again.  So the
work is linear in the text, whatever its length.

Equal scores merge leftmost first, in the re-merging as in the whole.  A character without a piece is a
piece by itself and becomes the ids of its bytes.  Where no piece of the model continues across the
beginning of a space, texts fall apart there, and a worker keeps the results of short parts, up to a bound.

Models other than BPE with byte fallback, escaped white space and identity normalization are refused.
Defined cases: null reads as an empty text, which has no ids; white space, control characters and the
names of special ids are ordinary text.  Only the given column is read.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F

SPACE = "▁"
#: parts and pairs that a worker keeps, the longest part that it keeps, texts looked at together
KEPT, LONG, ROWS = 400_000, 48, 1000

# fixed values of the model format: kinds of pieces, the number of the BPE algorithm
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2


@dataclass
class Model:
    """pieces: piece -> (id, score); bytes: id of each byte; text: what each id decodes to."""

    pieces: dict[str, tuple[int, float]]
    bytes: list[int]
    text: list[bytes]
    prefix: bool  # whether a space is put before every text


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message; lengths, varints and 4-byte values only."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    at = 0
    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
            yield number, data[at : at + size]
            at += size


def read_model(content: bytes) -> Model:
    """The model of a SentencePiece file."""
    pieces, by_byte, text = {}, {}, []
    trainer, normalizer = {}, {}
    for number, value in _fields(content):
        if number == 1:
            f = dict(_fields(value))
            piece, kind = f[1].decode(), f.get(3, NORMAL)
            if kind == NORMAL:
                pieces[piece] = (len(text), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0])
            elif kind == BYTE:
                by_byte[int(piece[3:5], 16)] = len(text)
            elif kind in (USER_DEFINED, UNUSED):
                raise ValueError(f"piece {piece!r}: user-defined and unused pieces are not supported")
            text.append(piece.replace(SPACE, " ").encode() if kind == NORMAL else bytes([int(piece[3:5], 16)]) if kind == BYTE else b"")
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    # trainer: 3 algorithm, 24 space as suffix, 35 byte fallback; normalizer: 2 character map, 3 space before, 4 squeezed spaces, 5 escaped spaces
    if trainer.get(3) != BPE or trainer.get(24) or len(by_byte) != 256 or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
        raise ValueError("only BPE models with byte fallback, escaped white space and identity normalization are supported")
    return Model(pieces, [by_byte[b] for b in range(256)], text, bool(normalizer.get(3, 1)))


class Encoder:
    """Encodes texts piece by piece; one per worker and model."""

    _own: dict[int, Encoder] = {}

    @classmethod
    def of(cls, content: bytes) -> Encoder:
        key = hash(content)
        if key not in cls._own:
            cls._own.clear()
            cls._own[key] = cls(read_model(content))
        return cls._own[key]

    def __init__(self, model: Model):
        self.model = model
        self.score = {p: s for p, (_, s) in model.pieces.items()}
        self.matches = ahocorasick.Automaton()
        for p in model.pieces:
            self.matches.add_word(p, p)
        self.matches.make_automaton()
        #: the longest proper prefix of a piece that is a piece, where there is one
        self.shorter = {p: q for p in model.pieces if (q := next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.score), ""))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[str, int, bytes]] = {}
        whole = any(SPACE in p.lstrip(SPACE) for p in model.pieces)
        self.parts = re.compile(r"(?s).+" if whole else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def merged(self, text: str) -> list[str]:
        """A short text merged from its characters: best score first, leftmost of equal ones."""
        parts, score = list(text), self.score
        while True:
            found = [(-score[x], i) for i, x in enumerate(map(str.__add__, parts, parts[1:])) if x in score]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def compatible(self, before: str, piece: str) -> bool:
        """Whether merging both gives both; `before` is empty at the beginning."""
        if len(self.pairs) > KEPT:
            self.pairs.clear()
        hit = self.pairs[before, piece] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return hit

    def split(self, text: str) -> list[str]:
        """The pieces of a text that already has its spaces escaped."""
        n = len(text)
        longest: list[str | None] = [None] * n
        for end, p in self.matches.iter(text):  # by ascending end: the longest comes last
            longest[end - len(p) + 1] = p
        failed = bytearray(n // 8 + 1)
        known, shorter, compatible = self.pairs.get, self.shorter.get, self.compatible
        out: list[str] = []
        before, at, piece = "", 0, longest[0] or text[0]
        while at < n:
            while piece:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1:
                    fits = known((before, piece))
                    if fits or fits is None and compatible(before, piece):
                        break
                piece = shorter(piece)
            if piece:
                out.append(piece)
                before, at = piece, end
                if at < n:
                    piece = longest[at] or text[at]
            else:  # nothing leads on from here: take back the piece before, and try its prefixes
                failed[at >> 3] |= 1 << (at & 7)
                piece = shorter(out.pop())
                at -= len(before)
                before = out[-1] if out else ""
        return out

    def ids(self, pieces: list[str]) -> list[int]:
        known, byte = self.model.pieces.get, self.model.bytes
        out = []
        for p in pieces:
            if hit := known(p):
                out.append(hit[0])
            else:
                out.extend([byte[b] for b in p.encode()])
        return out

    def escaped(self, text: str) -> str:
        return (SPACE if self.model.prefix and text else "") + text.replace(" ", SPACE)

    def encode(self, text: str) -> list[int]:
        return [i for part in self.parts.findall(self.escaped(text)) for i in self.ids(self.split(part))]

    def coded(self, texts: list[str]) -> Iterator[tuple[str, int, bytes]]:
        """(ids joined by commas, number of ids, decoded bytes) of each text."""
        parts = [self.parts.findall(self.escaped(t)) for t in texts]
        known = self.known if len(self.known) <= KEPT else {}
        new = {}
        for p in {x for row in parts for x in row}.difference(known):
            ids = self.ids(self.split(p))
            new[p] = (",".join(map(str, ids)), len(ids), b"".join([self.model.text[i] for i in ids]))
        view = known | new if new else known
        for row in parts:
            found = [view[p] for p in row]
            data = b"".join([f[2] for f in found])
            yield ",".join([f[0] for f in found]), sum([f[1] for f in found]), data[1:] if self.model.prefix and data[:1] == b" " else data
        known.update((p, x) for p, x in new.items() if len(p) <= LONG)
        self.known = known

    def decode(self, ids: list[int]) -> str:
        """The text of any ids; a byte that is part of no character becomes U+FFFD."""
        data = b"".join([self.model.text[i] for i in ids])
        first = next((i for i in ids if self.model.text[i]), None)
        if self.model.prefix and data[:1] == b" " and first not in self.model.bytes:  # the space put before the text
            data = data[1:]
        return data.decode("utf-8", "each-byte")


codecs.register_error("each-byte", lambda e: ("�", e.start + 1))


def _broadcast(spark: SparkSession, model: str):
    with open(model, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def coded(spark: SparkSession, text: Column, model: str, ids: bool = True) -> Column:
    """struct(n_tokens, ids, ids_sha256, decoded_sha256) of whole texts, without begin or end ids.

    `model` is a file the driver can read; its content, a fixed file of about half a MB, is broadcast.
    Without `ids` that field is null.
    """
    content = _broadcast(spark, model)

    @F.arrow_udf("n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")
    def code(texts: pa.Array) -> pa.Array:
        encoder = Encoder.of(content.value)
        n, listed, id_hash, text_hash = [], [], [], []
        for at in range(0, len(texts), ROWS):
            for comma, size, data in encoder.coded(texts.slice(at, ROWS).fill_null("").to_pylist()):
                n.append(size)
                id_hash.append(hashlib.sha256(comma.encode()).hexdigest())
                text_hash.append(hashlib.sha256(data).hexdigest())
                listed.append([int(i) for i in comma.split(",")] if ids and size else [] if ids else None)
        fields = [pa.array(n, pa.int64()), pa.array(listed, pa.list_(pa.int32())), pa.array(id_hash, pa.string()), pa.array(text_hash, pa.string())]
        return pa.StructArray.from_arrays(fields, ["n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return code.asNondeterministic()(text)


def decoded(spark: SparkSession, ids: Column, model: str) -> Column:
    """The texts of id lists; a null list reads as an empty one."""
    content = _broadcast(spark, model)

    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        encoder = Encoder.of(content.value)
        return pa.array([encoder.decode(x or []) for x in lists.to_pylist()], pa.string())

    return text(ids)
