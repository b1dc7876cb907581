"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside each task.

The JVM cuts texts into pieces by the tokenizer's pattern.  A task takes the distinct pieces of a
batch; a piece that is a token is done, the others become token-position rows (piece, position, token)
of an in-process DuckDB.  A recursive query joins neighbouring rows with the merge table and contracts
each piece's leftmost pair of minimum rank, until no piece has a pair left; ordered aggregation gives
the ids of each piece, and, joined with the vocabulary, its decoded bytes.  Pieces are cut into blocks
by bytes, so the working set of a query is bounded, and finished pieces are kept for the worker's next
batches up to a bound.  DuckDB runs in the task's own process, with one thread and no files.

Special tokens don't exist here: their strings are ordinary text.  Null reads as an empty text, which
has no tokens; an empty column gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F

from gridloom.llm.words import give_back

#: bytes of pieces in one recursive query, pieces in a generation of those a worker keeps, texts looked at together
BLOCK, KEPT, ROWS = 1 << 18, 150_000, 1500

#: token-position rows join the merge table once; from then on a piece carries its tokens and the ranks of
#: their pairs (NONE: no pair), and each turn joins only the two pairs that a contraction makes
CONTRACT = """
WITH RECURSIVE t(w, ids, ranks) {key} AS (
    SELECT w, [-1] || list(id ORDER BY pos) || [-1], [9999999] || list(rank ORDER BY pos)
    FROM (SELECT w, pos, n.id, coalesce(m.rank, 9999999) AS rank
          FROM (SELECT *, lead(id) OVER (PARTITION BY w ORDER BY pos) AS nxt FROM start) n LEFT JOIN merges m ON m.l = n.id AND m.r = n.nxt)
    GROUP BY w
    UNION {all}
    SELECT w, ids[1:p - 1] || [best] || ids[p + 2:], ranks[1:p - 2] || [coalesce(a.rank, 9999999), coalesce(b.rank, 9999999)] || ranks[p + 2:]
    FROM (SELECT *, ids[p - 1] AS before, ids[p + 2] AS after
          FROM (SELECT *, list_position(ranks, best) AS p FROM (SELECT *, list_min(ranks) AS best FROM t) WHERE best < 9999999))
    LEFT JOIN merges a ON a.l = before AND a.r = best LEFT JOIN merges b ON b.l = best AND b.r = after
)
SELECT w, ids[2:len(ids) - 1] AS ids FROM t WHERE list_min(ranks) = 9999999
"""
#: short pieces keep all turns until the end; of long ones only the latest state is kept
SHORT = CONTRACT.format(key="", all="ALL")
LONG = CONTRACT.format(key="USING KEY (w)", all="")
LONG_BYTES = 64
DECODE = """
SELECT c.w, array_to_string(c.ids, ',') AS comma, len(c.ids) AS n, d.bytes
FROM coded c JOIN (SELECT w, unhex(string_agg(hex(token), '' ORDER BY pos)) AS bytes
                   FROM (SELECT w, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM coded) JOIN vocabulary USING (id) GROUP BY w) d USING (w)
"""


def read_ranks(content: bytes) -> dict[bytes, int]:
    """token -> rank from a rank file: a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


class Coder:
    """Encodes distinct pieces; one per worker and vocabulary."""

    _own: dict[int, "Coder"] = {}

    @classmethod
    def of(cls, content: bytes) -> "Coder":
        key = hash(content)
        if key not in cls._own:
            cls._own.clear()
            cls._own[key] = cls(content)
        return cls._own[key]

    def __init__(self, content: bytes):
        import duckdb

        self.ranks = read_ranks(content)
        tokens = list(self.ranks)
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        vocabulary = pa.table({"token": pa.array(tokens, pa.binary()), "id": pa.array([self.ranks[t] for t in tokens], pa.int64())})
        left, right, rank = (pa.array(x, pa.int32()) for x in zip(*pairs, strict=True)) if pairs else (pa.array([], pa.int32()),) * 3
        merges = pa.table({"l": left, "r": right, "rank": rank})
        for name, table in (("vocabulary", vocabulary), ("merges", merges)):
            self.con.register("given", table)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.con.unregister("given")
        self.token = {r: t for t, r in self.ranks.items()}
        self.known: dict[str, tuple[str, int, bytes]] = {}  # the latest generation, and the one before
        self.older: dict[str, tuple[str, int, bytes]] = {}

    def pieces(self, texts: list[str]) -> list[tuple[str, int, bytes]]:
        """(ids joined by commas, number of ids, decoded bytes) of each of some distinct pieces."""
        out, todo = {}, []
        known, older = self.known, self.older
        for p in texts:
            hit = known.get(p) or older.get(p)
            if hit is None:
                todo.append(p)
            else:
                out[p] = known[p] = hit
        block, size = [], 0
        for p in todo:
            block.append(p)
            size += len(p) + 1
            if size > BLOCK:
                out.update(self._block(block))
                block, size = [], 0
        out.update(self._block(block))
        known.update((p, out[p]) for p in todo if len(p) <= LONG_BYTES)
        if len(known) > KEPT:
            self.known, self.older = {}, known if len(known) <= 3 * KEPT else {}
        return [out[p] for p in texts]

    def _block(self, block: list[str]) -> dict[str, tuple[str, int, bytes]]:
        raw = [p.encode() for p in block]
        out = {}
        for i, (p, b) in enumerate(zip(block, raw, strict=True)):
            if (r := self.ranks.get(b)) is not None:
                out[p] = (str(r), 1, self.token[r])
            elif not b:
                out[p] = ("", 0, b"")
        rest = [i for i, p in enumerate(block) if p not in out]
        for sql, some in ((SHORT, [i for i in rest if len(raw[i]) <= LONG_BYTES]), (LONG, [i for i in rest if len(raw[i]) > LONG_BYTES])):
            if not some:
                continue
            sizes = np.array([len(raw[i]) for i in some])
            first = np.repeat(np.cumsum(sizes) - sizes, sizes)
            data = np.frombuffer(b"".join(raw[i] for i in some), np.uint8)
            start = pa.table({"w": np.repeat(np.array(some, np.int32), sizes), "pos": (np.arange(len(data)) - first).astype(np.int32), "id": self.byte[data]})
            self.con.register("start", start)
            self.con.execute(f"CREATE OR REPLACE TEMP TABLE coded AS {sql}")
            self.con.unregister("start")
            got = self.con.sql(DECODE).to_arrow_table()
            self.con.execute("DROP TABLE coded")
            for w, *x in zip(*(got.column(c).to_pylist() for c in ("w", "comma", "n", "bytes")), strict=True):
                out[block[w]] = tuple(x)
        return out


def coded(spark: SparkSession, text: Column, vocabulary: str, pattern: str, ids: bool = True, keep: bool = True) -> Column:
    """struct(n_tokens, ids, ids_sha256, decoded_sha256) of whole texts.

    `vocabulary` is a rank file the driver can read; its content, a fixed file of about a MB, is
    broadcast.  Java's classes stand for the pattern's; a text with a character that Java doesn't know
    is cut by the `regex` library instead.  Without `ids` that field is null.  Without `keep` a worker
    keeps nothing between batches, which costs time and frees its memory for other stages.
    """
    with open(vocabulary, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf("n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")
    def code(pieces: pa.Array, odd: pa.Array) -> pa.Array:
        coder = Coder.of(content.value)
        n, listed, id_hash, text_hash = [], [], [], []
        for at in range(0, len(pieces), ROWS):
            part, other = pieces.slice(at, ROWS), odd.slice(at, ROWS)
            if other.null_count < len(other):
                import regex

                find = regex.compile(pattern).findall
                part = pa.array([x if o is None else find(o) for x, o in zip(part.to_pylist(), other.to_pylist(), strict=True)], part.type)
            flat = part.flatten().dictionary_encode()
            known = coder.pieces(flat.dictionary.to_pylist())
            comma, size, data = ([k[i] for k in known] for i in range(3))
            which = flat.indices.to_pylist()
            size = np.array(size, np.int64)
            stop = 0
            for m in (part.value_lengths().fill_null(0)).to_pylist():
                row = which[stop : stop + m]
                stop += m
                joined = ",".join([comma[i] for i in row])
                n.append(int(size[row].sum()) if row else 0)
                id_hash.append(hashlib.sha256(joined.encode()).hexdigest())
                text_hash.append(hashlib.sha256(b"".join([data[i] for i in row])).hexdigest())
                listed.append(np.array(joined.split(","), np.int32) if ids and row else [] if ids else None)
        if not keep:
            del coder
            Coder._own.clear()
        give_back()
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(listed, pa.list_(pa.int32())), pa.array(id_hash, pa.string()), pa.array(text_hash, pa.string())], ["n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    text = F.coalesce(text, F.lit(""))
    odd = text.rlike(r"\p{Cn}")
    cut = F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))
    return code.asNondeterministic()(F.when(odd, F.lit(None)).otherwise(cut), F.when(odd, text))
