"""Operators 1 to 3 against the tokenizers library and brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quaymark.llm import bpe, packing, simple8b, token_counts, token_files
from quaymark.llm.shared import fresh

# A text and its complement, which hashes made of sums and powers take for each other.
_A = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
ALTERNATING = [_A, _A.translate(str.maketrans("ab", "ba"))]
TEXTS = ["don't we'll 's ''s", "", None, "a  b\n \n c", "l'été 123abc,,, 'd ", "x" * 5000, "word " * 3000, "é 漢字 ½²\x1c 　", "a\n\nb", "a\n\nb", *ALTERNATING]


def plain(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "junk", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "junk", 1), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, length int").repartition(3)


def test_encoder_equals_library():
    r = random.Random(3)
    texts = [t or "" for t in TEXTS] + ["".join(r.choice("ab 'stlrevmd\n\té1!  '<|endoftext|>") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    e = bpe.Encoder(bpe.default_path())
    for _ in range(2):
        ids, at = e.encode(pa.array(texts), end=None)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == plain(texts)


def test_encoder_compares_bytes(monkeypatch):
    """With a hash that is the same for parts with their halves exchanged, and for parts of other sizes, ids are still the library's."""
    monkeypatch.setattr(bpe, "mix", lambda x: x)
    e = bpe.Encoder(bpe.default_path())
    halves = [("%08d" % (i * 12345)).replace("0", "x").translate(str.maketrans("123456789", "abcdefghi")) for i in range(40)]
    texts = [*(t or "" for t in TEXTS), " ".join(f"word{i} {i * i}" for i in range(500)), " ".join(a + b for a in halves for b in halves), "\n".join(a + b for a in halves for b in halves)]
    for _ in range(2):
        ids, at = e.encode(pa.array(texts), end=None)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == plain(texts)


def test_encoder_starts_afresh_when_full(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_KEPT", 20)
    e = bpe.Encoder(bpe.default_path())
    for texts in (["one two three four five"] * 2, ["six seven one two " * 2], [" ".join(f"w{i}" for i in range(50))], ["one six"]):
        ids, at = e.encode(pa.array(texts), end=None)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == plain(texts)


@pytest.mark.parametrize("top", [1, 2, 300, 50257, 1 << 40, 1 << 63])
def test_simple8b_round_trip(top):
    r = np.random.default_rng(top % 1000)
    for n in (0, 1, 59, 2048, 2049, 9000):
        ids = r.integers(0, top, n, dtype=np.uint64, endpoint=True)
        ids[r.random(n) < 0.3] = 0
        words, counts, sizes = simple8b.encode(ids)
        assert counts.sum() == len(words) and (simple8b.decode(words, counts, sizes) == ids).all()
    zeros = np.zeros(5000, np.uint64)
    words, counts, sizes = simple8b.encode(zeros)
    assert len(words) < 60 and (simple8b.decode(words, counts, sizes) == zeros).all()


def test_token_files(spark, docs):
    got = token_files.round_trip(docs).orderBy("start").collect()
    order = sorted(docs.collect(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [r[0] for r in order]
    start = 0
    for r, ids in zip(got, plain([r[1] for r in order]), strict=True):
        raw = np.array([*ids, 0], "<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids) + 1, zlib.crc32(raw))
        start += len(ids) + 1


def test_patterns_use_every_length():
    r = np.random.default_rng(1)
    for size in (0, 3, 400, 40000):
        h = np.bincount(r.integers(1, 65, size), minlength=65)
        found = packing.patterns(h, 64)
        used = np.zeros(65, int)
        for n, lengths in found:
            assert n > 0 and sum(lengths) <= 64
            for v in lengths:
                used[v] += n
        assert (used == h).all()
        if size > 1000:
            n_seq, ids = sum(n for n, _ in found), (h * np.arange(65)).sum()
            assert n_seq * 64 <= ids * 1.01 + 64


def test_packing(spark, docs):
    got = packing.pack(docs, window=256).collect()
    rows = docs.collect()
    whole = [np.array([*ids, 0], "<u4") for ids in plain([r[1] for r in rows])]
    want = sorted((-1 if r[0] is None else r[0], s, min(256, len(w) - s), zlib.crc32(w[s : s + 256].tobytes()), len(w)) for r, w in zip(rows, whole, strict=True) for s in range(0, len(w), 256))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for x in by.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 256


def test_counts(spark, docs):
    got = token_counts.document_tokens(docs).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    want = sorted(((r[0], len(ids)) for r, ids in zip(docs.collect(), plain([r[1] for r in docs.collect()]), strict=True)), key=key)
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=key) == want and all(r.closed for r in got)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_scan_of_foreign_files(spark, block):
    from quaymark.llm import files

    r = np.random.default_rng(block)
    folder, want, uris = fresh(spark, "foreign"), [], []
    for k in range(4):
        ids = np.where(r.random(40 * k) < 0.3, 7, 1).astype("<u4")
        uri = f"{folder}/{k}.bin"
        files.write_whole(uri, [ids.tobytes()])
        uris.append((uri,))
        begin, nth = 0, 0
        for i, v in enumerate(ids.tolist()):
            if v == 7:
                want.append((uri, nth, begin, i - begin, True))
                begin, nth = i + 1, nth + 1
        if begin < len(ids):
            want.append((uri, nth, begin, len(ids) - begin, False))
    got = token_counts.count_tokens(spark, spark.createDataFrame(uris, "file string"), end=7, dtype="<u4", block=block)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none).count() == token_files.round_trip(none).count() == token_counts.document_tokens(none).count() == 0
