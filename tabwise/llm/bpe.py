"""Byte-level BPE encoding and decoding by prefix dynamic programming (operator 4).

BPE gives every byte prefix of a piece exactly one encoding, and a token sequence is an encoding
if and only if each two neighbours stay apart when merged by rank. So it is enough to store, for
each prefix, its last token: the one token that ends there and stays apart from the stored last
token of the prefix before it. The encoding is read off backwards. Appending bytes only extends
the table; after an edit the table is recomputed from the edit until it agrees again with the old
one for as many positions as the longest token has bytes.

A text is first cut into pieces by a pattern; each piece is encoded by itself. Special tokens are
not recognised: their strings are ordinary text.

Defined cases: null and empty texts have no tokens; repeated rows are encoded alike; a text of any
length is worked through in sections that end at a piece boundary; an empty table gives an
empty result; the given ``keep`` columns are returned, all others are ignored.
"""

from __future__ import annotations

import base64
import math
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SECTION = 1 << 20  # characters worked on at once
CACHED = 300_000  # pieces remembered by a worker; a full memory is begun anew
HEAD = 6  # bytes of a piece's beginning whose table is shared


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}


def white_space_as_unicode(pattern: str) -> str:
    """The pattern with ``\\s`` and ``\\S`` spelled as the Unicode property (the library's own set also has U+001C to U+001F)."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class _Pieces(dict):
    """Packed ids of pieces, encoded when first asked for."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece):
        got = self.encode(piece)
        if len(piece) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = got
        return got


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pattern = regex.compile(white_space_as_unicode(pattern))
        self._joint = regex.compile(r"\P{White_Space}(?= \P{White_Space})")
        self.halves = self._halves()
        self.endings = dict.fromkeys((b[i:] for b in ranks for i in range(1, len(b))), -1) | ranks
        self._right = {}
        self._left = {}
        self._apart = {}
        self._heads = {}
        self.packed_id = {r: struct.pack("<I", r) for r in self.bytes_of}
        self.packed = _Pieces(self._encode_piece)

    def _halves(self) -> dict[int, tuple[int, int]]:
        """The two tokens that BPE merges last into each token of two bytes or more."""
        out, ranks = {}, self.ranks
        for b, r in ranks.items():
            if len(b) < 2:
                continue
            parts = [b[i:i + 1] for i in range(len(b))]
            while len(parts) > 2:
                best, at = min((ranks.get(parts[i] + parts[i + 1], math.inf), i) for i in range(len(parts) - 1))
                if best >= r:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) != 2:
                raise ValueError(f"token {r} is not reached by merges of lower ranks")
            out[r] = ranks[parts[0]], ranks[parts[1]]
        return out

    def _edge(self, token: int, side: int) -> list:
        """Tokens that stand at one end of ``token`` as it is merged: ``(bytes, rank that takes it in)``, oldest first."""
        known = self._left if side == 0 else self._right
        got = known.get(token)
        if got is None:
            got, taken, t = [], math.inf, token
            while True:
                got.append((self.bytes_of[t], taken))
                if t not in self.halves:
                    break
                taken, t = t, self.halves[t][side]
            known[token] = got
        return got

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` and ``b`` together are encoded as these two tokens.

        They are not if a token at the end of ``a`` and one at the beginning of ``b`` merge before
        both are taken in by their own sides; of equal ranks, BPE merges the left one first.
        """
        get = self.ranks.get
        for x, x_taken in self._edge(a, 1):
            for y, y_taken in self._edge(b, 0):
                r = get(x + y)
                if r is not None and r < x_taken and r <= y_taken:
                    return False
        return True

    def prefix_tokens(self, data: bytes, last: list | None = None, end: int | None = None) -> list:
        """Last token of every prefix (entry 0 is for the empty one). Given the table of a shorter prefix, extends it."""
        last = [None] if last is None else last
        endings, apart = self.endings.get, self._apart
        for i in range(len(last), (len(data) if end is None else end) + 1):
            found = None
            for start in range(i - 1, -1, -1):
                t = endings(data[start:i])
                if t is None:  # no token ends with these bytes
                    break
                if t < 0:
                    continue
                if start == 0:
                    found = t
                    break
                key = last[start] << 32 | t
                known = apart.get(key)
                if known is None:
                    if len(apart) >= 4 * CACHED:
                        apart.clear()
                    known = apart[key] = self.stay_apart(last[start], t)
                if known:
                    found = t
                    break
            if found is None:
                raise ValueError(f"no token for the byte {data[i - 1]}")
            last.append(found)
        return last

    def edited(self, data: bytes, last: list, start: int, end: int, new: bytes) -> tuple[bytes, list]:
        """Bytes and table after ``data[start:end]`` became ``new``; most of the old table is reused."""
        out = data[:start] + new + data[end:]
        table, same, shift = last[:start + 1], 0, len(new) - (end - start)
        for i in range(start + 1, len(out) + 1):
            self.prefix_tokens(out, table, i)
            same = same + 1 if i - shift > end and last[i - shift] == table[i] else 0
            if same > self.longest:
                table.extend(last[i - shift + 1:])
                break
        return out, table

    def tokens(self, last: list) -> list[int]:
        out, i = [], len(last) - 1
        while i > 0:
            out.append(last[i])
            i -= len(self.bytes_of[last[i]])
        out.reverse()
        return out

    def _encode_piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return self.packed_id[whole]
        if len(data) <= HEAD:
            last = self.prefix_tokens(data)
        else:  # pieces that begin alike share the table of their beginning
            head = self._heads.get(data[:HEAD])
            if head is None:
                if len(self._heads) >= CACHED:
                    self._heads.clear()
                head = self._heads[data[:HEAD]] = self.prefix_tokens(data[:HEAD])
            last = self.prefix_tokens(data, head.copy())
        return b"".join(map(self.packed_id.__getitem__, self.tokens(last)))

    def sections(self, text: str):
        at = 0
        while len(text) - at > SECTION:
            m = self._joint.search(text, at + SECTION)
            if m is None:
                break
            yield text[at:m.end()]
            at = m.end()
        yield text[at:]

    def encode(self, text: str) -> bytes:
        """Ids of a text, packed as little-endian unsigned 32-bit integers."""
        return b"".join(b"".join(map(self.packed.__getitem__, self.pattern.findall(s))) for s in self.sections(text))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS = {}


def worker_encoder(ranks: dict, pattern: str) -> Encoder:
    """One encoder a worker process and vocabulary, with its memory of pieces."""
    key = len(ranks), hash(frozenset(ranks.items())), pattern
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(ranks, pattern)
    return _ENCODERS[key]


def encode_documents(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep=("doc_id",),
                     decode: bool = False, ids: str = "ids", count: str = "n_tokens", decoded: str = "decoded") -> DataFrame:
    """Encode ``text`` of every row: the ``keep`` columns, the token count, the ids packed as little-endian uint32.

    With ``decode`` the ids are also decoded again, into a binary column. The vocabulary file is read
    on the driver and sent to the workers (a vocabulary has a fixed size).
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    keep = list(keep)
    fields = [df.schema[c] for c in keep] + [T.StructField(count, T.LongType()), T.StructField(ids, T.BinaryType())]
    if decode:
        fields.append(T.StructField(decoded, T.BinaryType()))

    def run(batches):
        encoder = worker_encoder(ranks.value, pattern)
        for b in batches:
            texts = b.column(len(keep))
            first = 0
            while first < len(texts):
                packed, size, end = [], 0, first
                while end < len(texts) and size < 4 << 20:
                    packed.append(encoder.encode(texts[end].as_py() or ""))
                    size += len(packed[-1])
                    end += 1
                part = b.slice(first, end - first)
                columns = [part.column(i) for i in range(len(keep))]
                columns += [pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary())]
                if decode:
                    columns.append(pa.array([encoder.decode(x) for x in packed], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])
                first = end

    name = "__text"
    while name in (c.lower() for c in keep):  # the columns given to mapInArrow are looked up by name
        name += "_"
    rows = df.select(*(df[c] for c in keep), df[text].alias(name))
    return rows.mapInArrow(run, T.StructType(fields))


def packed_to_list(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()
