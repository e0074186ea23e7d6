"""Simple-8b word-aligned coding of ids in blocks, for vectorised coding and decoding.

A 64-bit word has a 4-bit selector on top and 60 bits of ids. Selectors 2 to 15 pack 60 to 1 ids of 1 to 60 bits.
Selector 0 is the escape: the next word is one id of more than 60 bits, as it is. Selector 1 is a run of 120 zeros.
Ids are coded in blocks of a fixed count; a block's last word is filled up with zeros, which its count cuts off again.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BLOCK = 2048
# Ids and bits for each selector.
COUNT = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    out = np.zeros(ids.shape, dtype=np.uint8)
    rest = ids.copy()
    for s in (32, 16, 8, 4, 2, 1):
        big = rest >= (U64(1) << U64(s))
        out[big] += np.uint8(s)
        rest[big] >>= U64(s)
    out[rest > 0] += np.uint8(1)
    return out


def _selectors(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each place of each block (a row), the selector that packs the most ids from there on."""
    rows, width = ids.shape
    need = bit_lengths(ids)
    most = int(need.max(initial=0))
    best = np.zeros((rows, width), dtype=np.uint8)
    column = np.arange(width)
    done = np.zeros((rows, width), dtype=bool)
    for s in range(1, 16):
        wide = need > BITS[s]
        if BITS[s] >= most:
            fits = ~done
        else:
            # next place that does not fit, from each place on; past a block's end everything fits
            stop = np.where(wide, column, width + 200).astype(np.int32)
            stop = np.minimum.accumulate(stop[:, ::-1], axis=1)[:, ::-1]
            fits = (stop - column >= COUNT[s]) & ~done
        best[fits] = s
        done |= fits
        if done.all():
            break
    return best


def encode_blocks(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, words by block) of blocks given as rows, zero beyond their sizes. All blocks advance together, a word at a time."""
    rows, width = ids.shape
    best = _selectors(ids, sizes)
    flat = best.ravel()
    place = np.zeros(rows, dtype=np.int64)
    base = np.arange(rows) * width
    live = np.flatnonzero(place < sizes)
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(live):
        p = place[live]
        s = flat[base[live] + p]
        steps.append((live, p, s))
        place[live] = p + COUNT[s]
        live = live[place[live] < sizes[live]]
    if not steps:
        return np.zeros(0, U64), np.zeros(rows, np.int64)
    row, at, sel = (np.concatenate(x) for x in zip(*steps, strict=True))
    order = np.argsort(row, kind="stable")
    row, at, sel = row[order], at[order], sel[order]
    padded = np.zeros((rows, width + 120), dtype=U64)
    padded[:, :width] = ids
    source = padded.ravel()
    first = row * (width + 120) + at
    words = sel.astype(U64) << U64(60)
    for s in range(2, 16):
        of = np.flatnonzero(sel == s)
        if len(of):
            acc = words[of]
            for j in range(COUNT[s]):
                acc |= source[first[of] + j] << U64(j * BITS[s])
            words[of] = acc
    escaped = np.flatnonzero(sel == 0)
    counts = np.bincount(row, minlength=rows)
    if len(escaped):
        counts += np.bincount(row[escaped], minlength=rows)
        words = np.insert(words, escaped + 1, source[first[escaped]])
    return words, counts


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, words by block, ids by block) of a flat array."""
    ids = ids.astype(U64, copy=False)
    rows = -(-len(ids) // block)
    held = np.zeros(rows * block, dtype=U64)
    held[: len(ids)] = ids
    sizes = np.full(rows, block, dtype=np.int64)
    if rows:
        sizes[-1] = len(ids) - (rows - 1) * block
    words, counts = encode_blocks(held.reshape(rows, block), sizes)
    return words, counts, sizes


def decode(words: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks."""
    words = words.astype(U64, copy=False)
    sel = (words >> U64(60)).astype(np.int64)
    block = np.repeat(np.arange(len(counts)), counts)
    raw = np.zeros(len(words), dtype=bool)
    for i in np.flatnonzero(sel == 0).tolist():  # escapes are rare; the word after one is no word of its own
        if not raw[i]:
            raw[i + 1] = True
    keep = np.flatnonzero(~raw)
    sel, block = sel[keep], block[keep]
    n = COUNT[sel]
    put = np.cumsum(n)
    out = np.zeros(int(put[-1]) if len(put) else 0, dtype=U64)
    put = put - n
    for s in range(2, 16):
        of = np.flatnonzero(sel == s)
        if len(of):
            mask = U64((1 << int(BITS[s])) - 1)
            value = words[keep[of]]
            for j in range(COUNT[s]):
                out[put[of] + j] = (value >> U64(j * BITS[s])) & mask
    of = np.flatnonzero(sel == 0)
    if len(of):
        out[put[of]] = words[keep[of] + 1]
    made = np.bincount(block, weights=n, minlength=len(counts)).astype(np.int64)
    if (made == sizes).all():
        return out
    first = np.cumsum(made) - made
    return out[np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)]
