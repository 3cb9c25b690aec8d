"""Byte-level BPE encoding and decoding by a segment tree over byte positions.

Every leaf of the tree holds the rank of the pair that begins at a live position (none: a value above all
ranks); inner nodes hold the minimum, together with the position, so the root names the leftmost pair of least
rank. A merge kills one position and updates the leaves of the merged node and of its live left neighbour, each
in O(log n). Short pieces go through many trees at once, as rows of one matrix; long pieces have a tree each.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidelog.llm.common import map_text, table

#: Pieces that one worker remembers at most, and their bytes, about; the table is emptied when it is full. Pieces of more
#: than CACHE_LONGEST characters aren't remembered. Results don't depend on it.
CACHE_PIECES, CACHE_BYTES, CACHE_LONGEST = 150_000, 24_000_000, 64
#: Pieces of up to so many bytes are encoded as rows of a matrix.
SHORT = 32
_NONE = np.int64(1) << 62


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: base64 of a token's bytes, a space, its rank; one token per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


# ---------------------------------------------------------------- splitting


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    r"""Class of each code point: 0 other, 1 \p{L}, 2 \p{N}, 3 \s."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            lo, hi = m.span()
            shift = [x + (0x800 if x >= 0xD800 else 0) for x in (lo, hi - 1)]
            assert shift == [a, b]
            out[a : min(b, 0xD7FF) + 1 if a < 0xD800 else b + 1] = kind
            if a < 0xD800 <= b:
                out[0xE000 : b + 1] = kind
    return out


def boundaries(points: np.ndarray) -> np.ndarray:
    """Starts of the pieces of one text (code points), as the public byte-level pattern splits it.

    The pattern, read as rules: a run of letters, of digits or of other signs is a piece, with one blank (U+0020)
    directly before it; of longer white space before a piece, all but the last character is a piece of its own;
    an apostrophe that begins a run of signs takes s, t, m, d, re, ve or ll with it.
    """
    n = len(points)
    kind = _classes()[points]
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    space = kind == 3
    # the last of a white-space run begins a piece if anything follows
    last = space.copy()
    last[:-1] &= ~space[1:]
    last[-1] = False
    start |= last
    # a blank at the end of such a run takes the next run with it
    glued = last & (points == 0x20)
    start[1:] &= ~glued[:-1]
    quotes = np.flatnonzero(start & (points == 0x27))
    if len(quotes):
        low = points
        for i in quotes.tolist():
            a = low[i + 1] if i + 1 < n else 0
            b = low[i + 2] if i + 2 < n else 0
            long = 0
            if a in (0x73, 0x74, 0x6D, 0x64):
                long = 1
            elif (a == 0x72 and b == 0x65) or (a == 0x76 and b == 0x65) or (a == 0x6C and b == 0x6C):
                long = 2
            if long:
                start[i + 1 : i + 1 + long] = False
                if i + 1 + long < n:
                    start[i + 1 + long] = True if kind[i + 1 + long] == 1 else start[i + 1 + long]
    return np.flatnonzero(start)


def split(text: str) -> list[str]:
    """The pieces of a text, in order."""
    if not text:
        return []
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = boundaries(points).tolist()
    return [text[a:b] for a, b in zip(at, [*at[1:], len(text)])]


# ---------------------------------------------------------------- merging


class Merger:
    """Ranks with the table of mergeable pairs: (left id, right id) -> id of the joined token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.base = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        width = len(self.tokens)
        pairs = {}
        for token, i in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a * width + b] = i
        self.width, self.pairs = width, pairs
        # open addressing with linear probing, for lookups of many pairs at once
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        size = 1 << bits
        self.slot_key = np.full(size + 64, -1, np.int64)
        self.slot_value = np.full(size + 64, _NONE, np.int64)
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int64, len(pairs))
        self.probes = 0
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            self.probes += 1
            assert self.probes < 64
            free = self.slot_key[slot[todo]] == -1
            first = todo[free]
            _, one = np.unique(slot[first], return_index=True)
            put = first[one]
            self.slot_key[slot[put]] = keys[put]
            self.slot_value[slot[put]] = values[put]
            left = np.ones(len(keys), bool)
            left[:] = False
            left[todo] = True
            left[put] = False
            todo = np.flatnonzero(left)
            slot[todo] += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the joined token for each pair, or a value above all ids."""
        shape = left.shape
        keys = (left * self.width + right).ravel()
        slot = self._slot(keys)
        out = np.where(self.slot_key[slot] == keys, self.slot_value[slot], _NONE)
        open_ = np.flatnonzero((out == _NONE) & (self.slot_key[slot] != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] += 1
            at = slot[open_]
            hit = self.slot_key[at] == keys[open_]
            out[open_[hit]] = self.slot_value[at[hit]]
            open_ = open_[~hit & (self.slot_key[at] != -1)]
        return out.reshape(shape)

    def encode_long(self, piece: bytes) -> list[int]:
        """One piece through one tree: O(log n) for each update."""
        ids = self.base[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        if n < 2:
            return ids
        size = 1 << (n - 1).bit_length()
        pairs, width, none = self.pairs, self.width, (1 << 62)
        scale = size
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = pairs.get(ids[i] * width + ids[i + 1])
            if r is not None:
                tree[size + i] = r * scale + i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\1") * n

        def update(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        while tree[1] < none:
            rank, i = divmod(tree[1], scale)
            j = after[i]
            ids[i] = rank
            alive[j] = 0
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
            update(j, none)
            r = pairs.get(rank * width + ids[k]) if k < n else None
            update(i, none if r is None else r * scale + i)
            h = before[i]
            if h >= 0:
                r = pairs.get(ids[h] * width + rank)
                update(h, none if r is None else r * scale + h)
        return [ids[i] for i in range(n) if alive[i]]

    def encode_short(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Pieces of 2 to ``size`` bytes (a power of two), a tree per row; all rows merge once per step."""
        m = len(pieces)
        count = np.fromiter(map(len, pieces), np.int64, m)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(m, size)
        ids = self.base[raw]
        spot = np.arange(size)
        alive = spot < count[:, None]
        after = np.broadcast_to(spot + 1, (m, size)).copy()
        before = np.broadcast_to(spot - 1, (m, size)).copy()
        kind = np.int32 if self.width * size < 1 << 30 else np.int64
        none = kind(np.iinfo(kind).max)
        tree = np.full((m, 2 * size), none, kind)
        valid = (spot[:-1] + 1) < count[:, None]
        rank = self.rank_of(ids[:, :-1], ids[:, 1:])
        tree[:, size : 2 * size - 1] = np.where(valid & (rank < _NONE), rank * size + spot[:-1], none)
        at = size
        while at > 1:
            level = tree[:, at : 2 * at]
            tree[:, at // 2 : at] = np.minimum(level[:, ::2], level[:, 1::2])
            at //= 2

        def update(rows, pos, value):
            k = size + pos
            tree[rows, k] = value
            k = k >> 1
            while k[0]:
                tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])
                k = k >> 1

        rows = np.flatnonzero(tree[:, 1] < none)
        while len(rows):
            top = tree[rows, 1].astype(np.int64)
            token, i = top // size, top % size
            j = after[rows, i]
            ids[rows, i] = token
            alive[rows, j] = False
            k = after[rows, j]
            after[rows, i] = k
            inside = k < count[rows]
            before[rows[inside], k[inside]] = i[inside]
            update(rows, j, none)
            right = self.rank_of(token, ids[rows, np.where(inside, k, 0)])
            update(rows, i, np.where(inside & (right < _NONE), right * size + i, none))
            h = before[rows, i]
            some = h >= 0
            r2, h2 = rows[some], h[some]
            if len(r2):
                left = self.rank_of(ids[r2, h2], token[some])
                update(r2, h2, np.where(left < _NONE, left * size + h2, none))
            rows = rows[tree[rows, 1] < none]
        flat, per = ids[alive].astype("<u4").tobytes(), 4 * alive.sum(1)
        ends = np.cumsum(per)
        return [flat[a:b] for a, b in zip((ends - per).tolist(), ends.tolist())]

    def encode_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as little-endian unsigned 32-bit integers. A piece that is a token is that token, as the public library has it."""
        pack = lambda ids: np.array(ids, "<u4").tobytes()
        out: list = [None] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for x, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[x] = whole.to_bytes(4, "little")
            elif len(piece) <= SHORT:
                by_size.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(x)
            else:
                out[x] = pack(self.encode_long(piece))
        for size, where in by_size.items():
            if len(where) < 8:
                for x in where:
                    out[x] = pack(self.encode_long(pieces[x]))
                continue
            for a in range(0, len(where), 2048):
                some = where[a : a + 2048]
                for x, ids in zip(some, self.encode_short([pieces[x] for x in some], size)):
                    out[x] = ids
        return out


class Codec:
    """Encoding to and decoding from ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]):
        self.merger = Merger(ranks)
        self.known: dict[str, bytes] = {}
        self.held = 0
        tokens = self.merger.tokens
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        split_up = [split(t) for t in texts]
        known = self.known
        new = set().union(*split_up).difference(known) if split_up else set()
        more = 150 * len(new) + 3 * sum(map(len, new))
        if len(known) + len(new) > CACHE_PIECES or self.held + more > CACHE_BYTES:
            known.clear()
            self.held = 0
            new = set().union(*split_up)
        todo = list(new)
        for a in range(0, len(todo), 50_000):
            some = todo[a : a + 50_000]
            known.update(zip(some, self.merger.encode_all([p.encode("utf-8", "surrogatepass") for p in some])))
        get = known.__getitem__
        out = [b"".join(map(get, pieces)) for pieces in split_up]
        if len(known) > CACHE_PIECES or more > CACHE_BYTES:
            known.clear()
        else:
            for piece in [p for p in todo if len(p) > CACHE_LONGEST]:
                del known[piece]
        self.held = self.held + more if known else 0
        return out

    def decode_many(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each id sequence: one gather over the vocabulary's bytes for all of them."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        if not len(flat):
            return [b""] * len(ids)
        size = self.sizes[flat]
        ends = np.cumsum(size)
        where = np.repeat(self.begin[flat] - (ends - size), size)
        where += np.arange(len(where), dtype=where.dtype)
        out = self.bytes[where].tobytes()
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *(len(x) // 4 for x in ids)])].tolist()
        return [out[a:b] for a, b in zip(cuts, cuts[1:])]


_codecs: dict[str, Codec] = {}


def codec(key: str, ranks: dict[bytes, int]) -> Codec:
    """One codec per process and vocabulary."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks)
    return _codecs[key]


def bpe(df: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False, with_bytes: bool = False) -> DataFrame:
    """Encode whole texts by the ranks of ``vocabulary`` and decode the ids again, without a shuffle.

    Adds n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256; with ``with_ids``
    the ids themselves as that binary, with ``with_bytes`` the decoded bytes. Null and empty texts have no tokens. Very long
    pieces take O(n log n). Repeated rows have repeated results; an empty table gives an empty result; a kept column that
    is called like a result gives way to it, others may have any name. The vocabulary (its size is fixed by the file) is
    read once on the driver and broadcast.
    """
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    fields += [("ids", T.BinaryType())] * with_ids + [("decoded", T.BinaryType())] * with_bytes

    def make():
        c = codec(vocabulary, ranks.value)

        def apply(texts):
            ids = c.encode_many([t or "" for t in texts])
            back = c.decode_many(ids)
            sha = lambda xs: [hashlib.sha256(x).hexdigest() for x in xs]
            return [[len(x) // 4 for x in ids], sha(ids), sha(back)] + [ids] * with_ids + [back] * with_bytes

        return apply

    return map_text(df, text, keep, fields, make)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, encoded and decoded."""
    import public_tokenizers

    return bpe(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
