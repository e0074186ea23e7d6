"""Token ids of many texts by the tokenizers library, with each distinct pre-token encoded once per worker.

The byte-level vocabulary splits a text by a fixed pattern and merges inside each part alone, so equal parts have equal
ids. The split is done over whole batches with numpy; parts of up to 16 bytes are looked up in sorted arrays that the worker
keeps, and only unseen ones go to the library. A part found by its hash is compared byte for byte; longer parts, and parts
whose hash another one has, are told apart by their bytes alone and encoded once per batch.
"""

from __future__ import annotations

import os
import sys
import unicodedata

import numpy as np
import pyarrow as pa

from quaymark.llm.textkernel import U64, buffer_of, leading_bytes, mix

#: Distinct pre-tokens that a worker keeps (about 50 bytes each); beyond it starts afresh, which costs time alone.
MOST_KEPT = 3_000_000
#: Unseen parts that are handed to the library as one text, a line each.
TOGETHER = 64

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
# The white space of the split pattern.
_SPACES = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
_NOT_PATTERN_SPACES = [28, 29, 30, 31]


def class_table() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER for every code point."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for c in range(0x110000):
        out[c] = kinds.get(unicodedata.category(chr(c))[0], OTHER)
    out[_SPACES] = SPACE
    out[_NOT_PATTERN_SPACES] = OTHER
    return out


_TABLE: list[np.ndarray] = []


def classes() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(class_table())
    return _TABLE[0]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, byte position of each) of a UTF-8 buffer."""
    if not (data & 0x80).any():
        return data, np.arange(len(data))
    first = np.flatnonzero((data & 0xC0) != 0x80)
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32), first


def splits(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte starts of all parts, bounds by text). The parts of a text cover it.

    The pattern, alternatives in order: a contraction (s t re ve m ll d after an apostrophe); letters, numbers or other
    signs, each with an optional space before; white space that no other sign follows; white space.
    """
    n_bytes = len(data)
    if not n_bytes:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cp, at = code_points(data)
    kind = classes()[cp]
    n = len(cp)
    text_first = np.zeros(n + 1, dtype=bool)
    text_first[np.searchsorted(at, offsets)] = True
    text_first[n] = True
    head = text_first[:n]
    change = np.ones(n, dtype=bool)
    change[1:] = (kind[1:] != kind[:-1])
    change |= head
    space = kind == SPACE
    # The last space of a run, where another class follows in the same text: a part of its own start.
    ends_run = np.zeros(n, dtype=bool)
    ends_run[:-1] = space[:-1] & ~space[1:] & ~head[1:]
    cut = change | ends_run
    joined = np.zeros(n, dtype=bool)  # a class change right after a plain space: the space belongs to what follows
    joined[1:] = ends_run[:-1] & (cp[:-1] == 32)
    cut &= ~joined
    # Contractions: an apostrophe that begins a part.
    quote = np.flatnonzero(cut & (cp == 39))
    if len(quote):
        follow = [np.where(quote + j < n, cp[np.minimum(quote + j, n - 1)], 0) for j in (1, 2)]
        for j in (1, 2):  # not across the end of the text
            gone = text_first[np.minimum(quote + j, n)] | (text_first[np.minimum(quote + 1, n)])
            follow[j - 1] = np.where(gone, 0, follow[j - 1])
        a, b = follow
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for hit, size in ((one, 2), (two & ~one, 3)):
            q = quote[hit]
            cut[q + 1] = False
            inner = q + size
            inner = inner[inner < n]
            cut[inner] |= ~joined[inner]
    starts = at[np.flatnonzero(cut)]
    return starts, np.searchsorted(starts, offsets)


class Known:
    """Columns (the hash, the second eight bytes, number of bytes, first id, number of ids) by ascending hash.

    Two tables, as a small one is cheap to insert to and is merged to the large one now and then.
    """

    KINDS = (U64, U64, np.int8, np.int64, np.int32)

    def __init__(self) -> None:
        self.tables = [self._none(), self._none()]

    def _none(self) -> tuple[np.ndarray, ...]:
        return tuple(np.zeros(0, k) for k in self.KINDS)

    def __len__(self) -> int:
        return sum(len(t[0]) for t in self.tables)

    def add(self, columns: tuple[np.ndarray, ...]) -> None:
        large, small = self.tables
        small = self._merged(small, columns)
        if 4 * len(small[0]) > len(large[0]) + 100_000:
            large, small = self._merged(large, small), self._none()
        self.tables = [large, small]

    @staticmethod
    def _merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        at = np.searchsorted(a[0], b[0])
        return tuple(np.insert(x, at, y) for x, y in zip(a, b, strict=True))

    def find(self, keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """(the columns but the hash, whether it is there) of hashes."""
        out, known = [np.zeros(len(keys), k) for k in self.KINDS[1:]], np.zeros(len(keys), bool)
        for own, *columns in self.tables:
            if len(own):
                at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                hit = own[at] == keys
                if hit.all():
                    return [c[at] for c in columns], hit
                for x, c in zip(out, columns, strict=True):
                    x[hit] = c[at[hit]]
                known |= hit
        return out, known


class Encoder:
    """Encodes batches of texts; not for more than one thread."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self._clear()

    def _clear(self) -> None:
        self.known, self.pool, self.used = Known(), np.zeros(1 << 16, np.uint32), 0

    def _ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all ids, where each part's begin, how many it has).

        A newline between two parts is a part of its own unless one of them is white space, and its id stands for nothing else.
        """
        encode = lambda texts: [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.zeros(len(parts), np.int32)
        plain = [i for i, p in enumerate(parts) if not p.isspace()]
        joined = ["\n".join([parts[i] for i in plain[k : k + TOGETHER]]) + "\n" for k in range(0, len(plain), TOGETHER)]
        pool = np.array([i for ids in encode(joined) for i in ids], np.uint32)
        ends = np.flatnonzero(pool == self.newline)
        if len(ends) != len(plain):  # another vocabulary, which does not part lines
            plain, pool, ends = [], pool[:0], ends[:0]
        size[plain] = np.diff(ends, prepend=-1) - 1
        whole = np.zeros(len(parts), bool)
        whole[plain] = True
        rest = np.flatnonzero(~whole)
        others = encode([parts[i] for i in rest.tolist()])
        size[rest] = [len(x) for x in others]
        order = np.concatenate([np.array(plain, np.int64), rest])
        first = np.empty(len(parts), np.int64)
        first[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate([pool[pool != self.newline] if len(plain) else pool, np.array([i for x in others for i in x], np.uint32)]), first, size

    def _learn(self, keys: np.ndarray, back: np.ndarray, n_bytes: np.ndarray, parts: list[str]) -> list[np.ndarray]:
        """The columns of new parts, which are kept."""
        pool, first, size = self._ids(parts)
        first += self.used
        while self.used + len(pool) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(pool)] = pool
        self.used += len(pool)
        columns = [back, n_bytes.astype(np.int8), first, size]
        self.known.add((keys, *columns))
        return columns

    def encode(self, column: pa.Array, end: int | None = 0) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a string column; ``end`` follows each text's ids unless it is None. A null is an empty text."""
        data, offsets = buffer_of(column)
        starts, bounds = splits(data, offsets)
        ends = np.append(starts[1:], len(data))
        n_bytes = ends - starts
        size, first = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        alone = n_bytes > 16
        front, later = leading_bytes(data, starts, n_bytes)
        keys = mix(mix(front ^ mix(n_bytes.astype(U64))) ^ later)
        raw = memoryview(data)
        part = lambda i: str(raw[starts[i] : ends[i]], "utf-8")
        short = np.flatnonzero(~alone)
        if len(short):
            distinct, example, which = np.unique(keys[short], return_index=True, return_inverse=True)
            example = short[example]
            back, count = later[example], n_bytes[example]
            columns, known = self.known.find(distinct)
            if not known.all():
                if len(self.known) + int((~known).sum()) > MOST_KEPT:
                    self._clear()
                    known[:] = False
                new = self._learn(distinct[~known], back[~known], count[~known], [part(i) for i in example[~known].tolist()])
                for x, y in zip(columns, new, strict=True):
                    x[~known] = y
            # Equal hashes with the same number of bytes and the same second half have the same first half, as ``mix`` is a
            # bijection. Each part is compared with the one it was found by, and that one with the table's.
            same = ((columns[0] == back) & (columns[1] == count))[which]
            same &= n_bytes[short] == count[which]
            two = np.flatnonzero(n_bytes[short] > 8)
            same[two] &= later[short[two]] == back[which[two]]
            size[short], first[short] = columns[3][which], columns[2][which]
            alone[short[~same]] = True
        mine = np.zeros(0, np.uint32)
        if alone.any():
            seen: dict[bytes, int] = {}
            own = np.flatnonzero(alone)
            nth = np.array([seen.setdefault(bytes(raw[starts[i] : ends[i]]), len(seen)) for i in own.tolist()], dtype=np.int64)
            mine, begin, many = self._ids([x.decode("utf-8") for x in seen])
            size[own], first[own] = many[nth], begin[nth]
        put = np.cumsum(size)
        total = int(put[-1]) if len(put) else 0
        place = np.arange(total) + np.repeat(first - (put - size), size)
        if len(mine):
            from_mine = np.repeat(alone, size)
            ids = np.empty(total, np.uint32)
            ids[from_mine], ids[~from_mine] = mine[place[from_mine]], self.pool[place[~from_mine]]
        else:
            ids = self.pool[place]
        at = np.concatenate([[0], put])[bounds]
        if end is not None:
            ids = np.insert(ids, at[1:], np.uint32(end))
            at = at + np.arange(len(at))
        return ids, at


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; it lives as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
