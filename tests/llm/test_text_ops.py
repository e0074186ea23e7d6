"""Operators 6 to 10 against brute force on small tables with nulls, ties, repeats, long texts and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quaymark.llm import language_id, line_dedup, mixing, quartile_digest, robust_quality
from quaymark.llm import textkernel as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = ["a", "bé", "漢字", "word", "x#", "$5", "<b>", "of", "the", " ", "q" * 30]
    out = [None, "", " \n\t", "\n", "a", "a\n\na", "one two three", "word " * 4000, "é" * 3000]
    while len(out) < n:
        lines = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 8))]
        out.append("\n".join(lines + lines[: r.randint(0, 3)]))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(2)
    rows = [(i, t, r.choice(["en", "fr", None]), r.choice(["s1", "s2", "s3", None]), "x", 1.5) for i, t in enumerate(texts())]
    rows += [rows[20], rows[20], (None, "no id here", None, None, None, None), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, line string, `odd name.x` double").repartition(3)


def none_of(docs):
    return docs.limit(0)


def test_statistics(docs):
    got = sorted((tuple(r) for r in robust_quality.rate(docs).drop("distance").collect()), key=repr)
    want = []
    for r in docs.collect():
        t = r.text or ""
        w = WORD.findall(t)
        windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            dup += bool(WORD.search(line)) and line in seen
            seen.add(line)
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        want.append((r.doc_id, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit), failed, not failed))
    assert [x[:-1] for x in got] == [x[:-1] for x in sorted(want, key=repr)]
    assert all(not (g[-1] and g[-2]) for g in got)


def brute_judged(rows, prior=robust_quality.PRIOR, share=robust_quality.SHARE):
    """The same estimates by numpy: means, covariances and quantiles in full, no bins of distances but for their ties."""
    n = np.array([r[3] for r in rows], float)
    x = np.stack([np.log1p(n), np.log(np.maximum([r[4] for r in rows], 1) / n), *(np.log1p(100 * np.array([r[k] for r in rows]) / n) for k in (5, 7, 6))], axis=1)
    language, key = np.array([repr(r[1]) for r in rows]), np.array([repr(r[1:3]) for r in rows])
    floors, scale = np.square(robust_quality.FLOORS), robust_quality.consistency(share)
    half = lambda v: (np.floor(np.sort(v, axis=0)[(len(v) - 1) // 2] / 0.02) + 0.5) * 0.02
    estimate = {}
    for k in set(key):
        own = x[language == language[key == k][0]]
        estimate[k] = half(own), np.diag(1 / np.maximum(np.square(1.4826 * half(np.abs(own - half(own)))), floors))

    def distances():
        return np.array([(x[i] - estimate[key[i]][0]) @ estimate[key[i]][1] @ (x[i] - estimate[key[i]][0]) for i in range(len(rows))])

    moments = lambda v: np.concatenate([[len(v)], v.sum(axis=0), (v.T @ v).ravel()])
    for _ in range(robust_quality.STEPS):
        bins = np.floor(np.log(distances() + 1e-9) / robust_quality.BIN)
        close = np.array([(bins[language == language[i]] < bins[i]).sum() < np.ceil(share * (language == language[i]).sum()) for i in range(len(rows))])
        new, corpus = {}, moments(x[close])
        for k in estimate:
            own = moments(x[close & (language == language[key == k][0])])
            m = moments(x[close & (key == k)]) + prior * (own + prior * corpus / corpus[0]) / (own[0] + prior)
            mean, cov = m[1:6] / m[0], m[6:].reshape(5, 5) / m[0]
            cov = scale * (cov - np.outer(mean, mean))
            new[k] = mean, np.linalg.inv(cov + np.diag(np.maximum(floors - np.diag(cov), 0)))
        moved = max(np.abs((new[k][0] - estimate[k][0]) / robust_quality.FLOORS).max() for k in estimate)
        estimate = new
        if moved <= robust_quality.REST:
            break
    return distances()


def judged(spark, rows):
    stats = spark.createDataFrame(rows, robust_quality.STATS + ", base_failed boolean")
    out = {x.doc_id: (x.kept, x.distance) for x in robust_quality.judge(stats).collect()}
    again = {x.doc_id: (x.kept, x.distance) for x in robust_quality.judge(stats.repartition(7)).collect()}
    assert out == again and len(out) == len(rows)
    assert np.allclose([out[i][1] for i in range(len(rows))], brute_judged(rows), rtol=1e-3, atol=1e-3)
    return out


def test_outliers(spark):
    """Two sources, a group without names and a language of one document; ties and all."""
    r = np.random.default_rng(1)
    rows = []
    for i in range(700):
        lang, source = ("en", "a") if i < 300 else ("en", "b") if i < 600 else (None, None)
        n = int(np.exp(r.normal(5, 0.5))) + 20
        odd = i % 100 == 7
        rows.append((i, lang, source, n, n * (12 if odd else 5), int(n * 3) if odd else 0, 0, 0, False))
    rows += [(700, "xx", "tiny", 30, 3000, 90, 0, 0, False), (701, "yy", "tiny", 100, 500, 0, 0, 0, False)]
    got = judged(spark, rows)
    assert {i for i, (k, _) in got.items() if not k} == {i for i in range(700) if i % 100 == 7} | {700}


def test_small_groups_are_tested(spark):
    """Small sources lean on their language, small languages on the corpus; a large source has an estimate of its own."""
    r = np.random.default_rng(2)
    groups = [("en", "hot", 400, 5), ("en", "rare", 10, 5), ("xx", "tiny", 3, 5), (None, None, 20, 5), ("en", "long", 300, 8)]
    rows = []
    for lang, source, size, mean in groups:
        for k in range(size):
            n = int(np.exp(r.normal(mean, 0.3))) + 20
            odd = k == 1
            rows.append((len(rows), lang, source, n, n * (40 if odd else 5), n * 3 if odd else 0, 0, 0, False))
    got = judged(spark, rows)
    assert {i for i, (kept, _) in got.items() if not kept} == {1, 401, 411, 414, 434}
    moved = [(*x[:2], "hot", *x[3:]) if x[2] == "long" and x[0] == 440 else x for x in rows]  # a long text among short ones
    assert judged(spark, moved)[440][1] > 4 * got[440][1]


def test_verdict_does_not_jump_with_size(spark):
    """The same odd document in groups that grow by one: its distance changes little from each to the next."""
    r = np.random.default_rng(4)
    base = [(i, "en", "big", int(np.exp(r.normal(5, 0.5))) + 20) for i in range(300)]
    last = None
    for size in (48, 49, 50, 51):
        group = [(300 + k, "en", "small", 200 + 3 * k) for k in range(size)] + [(300 + size, "en", "small", 150)]
        rows = [(i, a, b, n, n * 5, n * 2 if i == 300 + size else 0, 0, 0, False) for i, a, b, n in base + group]
        stats = spark.createDataFrame(rows, robust_quality.STATS + ", base_failed boolean")
        d = {x.doc_id: x.distance for x in robust_quality.judge(stats).collect()}[300 + size]
        assert last is None or abs(d - last) < 0.1 * last
        last = d


def test_equal_rows(spark):
    """Rows that are all equal lie in one bin and stay; one that differs goes."""
    rows = [(i, "en", "a", 100, 500, 0, 0, 0, False) for i in range(60)] + [(60, "en", "a", 100, 500, 90, 0, 0, False)]
    assert {i for i, (kept, _) in judged(spark, rows).items() if not kept} == {60}


def test_real_outliers_go(spark):
    """30 symbols per 100 words in a group without any are rejected; floors do not widen a spread that is real."""
    r = np.random.default_rng(3)
    rows = []
    for i in range(400):
        n = int(np.exp(r.normal(6, 1.0))) + 20
        rows.append((i, "en", "a", n, n * 5, int(n * 0.3) if i % 100 == 7 else 0, 0, 0, False))
    got = judged(spark, rows)
    assert {i for i, (kept, _) in got.items() if not kept} == {7, 107, 207, 307}


def test_chi_square():
    assert abs(robust_quality.chi_square_quantile(0.95, 5) - 11.0705) < 1e-3
    assert abs(robust_quality.chi_square_quantile(0.5, 2) - 1.386294) < 1e-5


def alternating(n):
    """Two texts that hashes made of sums and powers take for each other."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 1024, 2048, 4096])
def test_hashes_of_structured_texts(n):
    a, b = alternating(n)
    data, offsets = K.buffer_of(pa.array([a, b]))
    assert len(set(K.segment_hashes(data, offsets[:-1], offsets[1:]).tolist())) == 2
    words, bounds = K.shingles(*K.buffer_of(pa.array([" ".join(a), " ".join(b)])), 5)
    whole, at = K.gram_hashes(K.segment_hashes(*K.buffer_of(pa.array(list(a + b)))[:1], np.arange(2 * n), np.arange(1, 2 * n + 1)), np.array([0, n, 2 * n]), n)
    assert len(set(whole.tolist())) == 2
    stats = robust_quality.base_statistics(pa.array([a + "\n" + b, a + "\n" + a]))
    assert stats["n_dup_lines"].tolist() == [0, 1]


def test_structured_lines_stay(spark):
    """Either line is on three sites, so neither is on four."""
    a, b = alternating(1024)
    rows = [(i, x, f"s{i}") for i, x in enumerate([a, a, a, b, b, b])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for most in (10, 0):
        got = line_dedup.stripped(docs, min_sites=4, most_sent=most).select("row_.doc_id", "text", "n_removed").collect()
        assert sorted(map(tuple, got)) == [(i, x, 0) for i, x, _ in rows]


def test_lines_of_any_digest(spark):
    """Digests with zero bytes, first, last or between, are lines like others."""
    digest_of = lambda x: hashlib.blake2b(x.encode(), digest_size=16).digest()
    chosen = [next(x for x in (f"line {i}" for i in range(10**5)) if digest_of(x)[k] == 0) for k in (0, 1, 7, 14, 15)]
    rows = [(10 * s + k, f"{x}\nown {k} {s}", f"site{s}") for k, x in enumerate(chosen) for s in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert digest_lengths(docs) == {16}
    for most in (100, 0):
        got = line_dedup.stripped(docs, min_sites=4, most_sent=most).select("row_.doc_id", "n_removed").collect()
        assert sorted(map(tuple, got)) == sorted((i, int(i >= 10)) for i, _, _ in rows)


def digest_lengths(docs):
    return {len(r.line) for r in line_dedup.occurrences(docs, "source").select("line").collect()}


def test_windows_of_hashes():
    v = K.mix(np.arange(100, dtype=np.uint64))
    for k in (1, 2, 3, 5, 8, 50):
        w = K.windows(v, k)
        assert len(w) == 101 - k == len(set(w.tolist())) and all(w[i] == K.windows(v[i : i + k], k)[0] for i in range(101 - k))


def brute_lines(rows, least):
    sites, keep = collections.defaultdict(set), {}
    own = lambda t: int(line_dedup.text_hashes(*K.buffer_of(pa.array([t])))[0])
    order = lambda r: (r.doc_id is None, r.doc_id or 0, own(r.text))
    for r in rows:
        for x in (r.text or "").split("\n") if r.text is not None else []:
            if WORD.search(x):
                sites[x] |= {r.source} - {None}
                keep[x] = min(keep.get(x, order(r)), order(r))
    out = []
    for r in rows:
        if r.text is None:
            out.append((r.doc_id, None, 0, 0))
            continue
        seen, stay, gone = set(), [], 0
        for x in r.text.split("\n"):
            if WORD.search(x) and len(sites[x]) >= least and not (order(r) == keep[x] and x not in seen):
                gone += 1
            else:
                stay.append(x)
            seen.add(x)
        out.append((r.doc_id, "\n".join(stay), len(r.text.split("\n")), gone))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [10**6, 0])
@pytest.mark.parametrize("least", [2, 3])
def test_lines(docs, most, least):
    got = line_dedup.stripped(docs, min_sites=least, most_sent=most).select("row_.doc_id", "text", "n_lines", "n_removed").collect()
    want = brute_lines(docs.collect(), least)
    assert sorted(map(tuple, got), key=repr) == want and sum(w[3] for w in want) > 0
    cleaned = line_dedup.dedup_lines(docs, min_sites=least)
    assert cleaned.schema == docs.schema and sorted(((r.doc_id, r.text) for r in cleaned.collect()), key=repr) == [w[:2] for w in want]
    assert line_dedup.dedup_lines(none_of(docs)).count() == 0


def test_lines_by_sketch_and_exact(spark):
    rows = [(k, f"line {m}", f"site{k}") for m in (3, 8, 9, 10, 11, 12, 40) for k in range(m)]
    docs = spark.createDataFrame([(i, t, s) for i, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string")
    got = collections.Counter(r.text for r in line_dedup.dedup_lines(docs, min_sites=10).collect() if r.text)
    assert got == {"line 3": 3, "line 8": 8, "line 9": 9, "line 10": 1, "line 11": 1, "line 12": 1, "line 40": 1}


def letters_of(text):
    """Code points of letters, 0 for the rest, without a 0 behind a 0."""
    seq = [ord(c) if bpe_letter(c) else 0 for c in text.lower()]
    return [c for j, c in enumerate(seq) if c or j == 0 or seq[j - 1]]


def test_trigrams_brute():
    cases = [t for t in texts(5, 200) if t is not None] + ["Ab, c", "a", "É1é", "  x  ", "漢字仮名 ﬁ"]
    grams, bounds, some = language_id.trigrams(pa.array(cases))
    for i, t in enumerate(cases):
        seq = letters_of(t)
        assert grams[bounds[i] : bounds[i + 1]].tolist() == [(a << 42) + (b << 21) + c for a, b, c in zip(seq, seq[1:], seq[2:])]
        assert some[i] == any(seq)


def test_languages(spark, docs):
    got = language_id.identify(docs).collect()
    assert len(got) == docs.count()
    by = collections.defaultdict(set)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0 if r.doc_id is not None else True) and 0 <= r.score <= 1
        by[r.doc_id].add(r.lang_pred)
    letters = {r.doc_id: any(bpe_letter(c) for c in r.text or "") for r in docs.collect() if r.doc_id is not None}
    assert all((by[i] == {"und"}) == (not x) for i, x in letters.items())
    assert {r.lang_pred for r in language_id.identify(docs.where("lang is null")).collect()} == {"und"}
    assert language_id.identify(none_of(docs)).count() == 0
    kept = language_id.with_language(docs)
    assert kept.schema == docs.schema


def test_equal_languages(spark):
    """Of languages with equal prototypes the lower one by code point is told."""
    rows = [(i, "one two three four five", x) for i, x in enumerate(["b", "a", "b", "a", "é", "é"] * 5)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in got} == {"a"} and len(got) == len(rows)


def bpe_letter(c):
    import unicodedata

    return unicodedata.category(c)[0] == "L"


def test_prototype_is_bundle_of_bound_vectors():
    text = "hello wörld hello"
    grams, _, _ = language_id.trigrams(pa.array([text]))
    seq = letters_of(text)
    base = {c: language_id.letter_vectors(np.array([c]), 256)[0].astype(int) for c in set(seq)}
    want = sum(np.roll(base[a], 2) * np.roll(base[b], 1) * base[c] for a, b, c in zip(seq, seq[1:], seq[2:]))
    distinct, n = np.unique(grams, return_counts=True)
    assert (language_id.bundled(distinct, n, 256) == want).all()
    vectors = language_id.letter_vectors(np.arange(97, 20_000))
    assert abs(vectors.mean()) < 0.01 and np.abs(vectors[:200].astype(int) @ vectors[:200].T.astype(int) - 1024 * np.eye(200)).max() < 200


def test_learning_in_parts(spark, monkeypatch):
    """Prototypes are the same however often a task bundles, and however rows are dealt out; the driver gets languages x dimensions numbers."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names, want = language_id.learn(docs, 128)
    one = language_id.trigrams(pa.array([r.text for r in docs.collect() if r.lang == names[0]]))[0]
    assert (language_id.bundled(*np.unique(one, return_counts=True), 128) == want[0]).all()
    monkeypatch.setattr(language_id, "MOST_HELD", 1000)
    again, got = language_id.learn(docs.repartition(3), 128)
    assert names == again and (want == got).all()


def test_what_is_no_language_goes(spark):
    """Lettered junk and a language that was not learned are rejected; texts of learned languages stay, short ones too."""
    r = random.Random(8)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    junk = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(2000)) for _ in range(5)]
    junk += [" ".join("".join(r.choice("αβγδεζηθικλμνξοπρστυφχψω") for _ in range(r.randint(2, 9))) for _ in range(200)) for _ in range(5)]
    junk += ["zqx " * 300, "12 34", None]
    both = docs.unionByName(spark.createDataFrame([(-1 - i, t, "en") for i, t in enumerate(junk)], docs.schema))
    kept = {x.doc_id for x in language_id.with_language(both).select("doc_id").collect()}
    assert not {i for i in kept if i < 0}
    good = {x.doc_id for x in docs.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1"), "doc_id").select("doc_id").collect()}
    assert len(good - kept) == 0 and len(kept) >= 0.97 * docs.count()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def shares(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = [s for s in order if s not in stopped]
        if not left:
            break
        level = (total - sum(cap * sizes[s] for s in stopped)) / sum(w[s] for s in left)
        more = {s for s in left if w[s] * level > cap * sizes[s]}
        if not more:
            break
        stopped |= more
    return {s: cap * sizes[s] if s in stopped else w[s] * level for s in order}


def test_mixing(docs):
    rows = docs.collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want = shares(dict(sizes))
    got = mixing.mix(docs).collect()
    assert sorted((map(tuple, got)), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=repr)
    by_id = {r.doc_id: r.source for r in rows}
    for r in got:
        if r.doc_id is not None:
            assert r.source_size == sizes[by_id[r.doc_id]] and abs(r.target - want[by_id[r.doc_id]]) < 1e-6
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    assert sorted(r.size for r in got) == sorted(len(WORD.findall(r.text or "")) for r in rows)
    out = mixing.mixed(docs)
    assert out.schema == docs.schema
    assert sum(len(WORD.findall(r.text or "")) for r in out.collect()) == sum(r.taken for r in got)
    assert mixing.mix(none_of(docs)).count() == mixing.mixed(none_of(docs)).count() == 0


def brute_taken(rows, target):
    """What the thresholds take, by walking all documents of each source in order of their hashes. rows: source, size, hash."""
    taken = collections.Counter()
    for s in {x[0] for x in rows}:
        own = sorted((h, n) for x, n, h in rows if x == s)
        total = sum(n for _, n in own)
        if not total:
            continue
        times = int(target[s] // total)
        rest, begin, inside, edge = target[s] - times * total, -1, set(), None
        for k in range(mixing.ROUNDS):
            most = rest
            able = [(h, n) for h, n in own if h > begin and (k == 0 or n <= most)]
            found = None
            for h, n in able:
                if n > rest:
                    found = (h, n)
                    break
                rest -= n
                inside.add(h)
            if found is None:
                break
            edge, begin = found, found[0]
            if rest <= mixing.MISSING * target[s]:
                break
        if edge is not None:
            over, out = edge[1] - rest, set()
            plain = min(rest, over)
            error, left = None, over
            if plain > mixing.MISSING * target[s]:
                for h, n in own:
                    if h in inside and n <= over:
                        if n > left:
                            error = min(left, n - left)
                            if 2 * left >= n:
                                out.add(h)
                            break
                        left -= n
                        out.add(h)
                else:
                    error = left
            if error is not None and error < plain:
                inside = (inside - out) | {edge[0]}
            elif 2 * rest >= edge[1]:
                inside.add(edge[0])
        for h, n in own:
            taken[s] += n * (times + (h in inside))
    return taken


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_mixing_comes_near(spark, seed):
    """Heavy-tailed sizes, few documents, and targets near all of a source, against brute force."""
    r = random.Random(seed)
    size = {"a": 300, "b": 20, "c": 900, "d": 400, None: 2, "e": 3, "f": 40, "g": 7}
    heavy = lambda: min(20_000, int(r.paretovariate(0.8) * 5))
    rows = [(i, "w " * (300 if s == "e" else heavy() if seed > 5 else r.randint(1, 60)), s) for i, s in enumerate(x for x, n in size.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hashes = {x.doc_id: x.h for x in docs.select("doc_id", mixing.hash_of(docs.doc_id, docs.text).alias("h")).collect()}
    taken, target = collections.Counter(), {}
    for x, row in zip(mixing.mix(docs).orderBy("doc_id").collect(), rows, strict=True):
        taken[row[2]] += x.taken
        target[row[2]] = x.target
    assert taken == brute_taken([(s, len(t) // 2, hashes[i]) for i, t, s in rows], target)
    for s in size:
        least = sorted(len(t) // 2 for _, t, x in rows if x == s)
        assert abs(taken[s] - target[s]) <= max(0.02 * target[s], least[-1] / 2)


def test_mixing_takes_the_edge_if_nearer(spark):
    """Three documents of 300 words and a target of 857: all three are nearer than two."""
    rows = [(i, "w " * 300, "b") for i in range(3)] + [(10, "w " * 3000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    goals = spark.createDataFrame([("b", 900, 857.0), ("a", 3000, 2000.0)], "source string, source_size long, target double")
    found = mixing.thresholds(mixing._measured(docs), goals)
    slim = mixing._measured(docs).withColumnRenamed("source", "s_")
    taken = collections.Counter()
    for x in slim.join(found, slim["s_"] == found["source"]).select("source", (slim["size"] * mixing.times_taken(slim["hash"], slim["size"])).alias("n")).collect():
        taken[x.source] += x.n
    assert taken == {"b": 900, "a": 3000}


def digest(t):
    held = [0] * 128
    b = t.encode()
    for k, p in enumerate(quartile_digest.TRIPLETS):
        for i in range(len(b) - p[2]):
            x = (sum(b[i + p[j]] * int(quartile_digest._FACTORS[j]) for j in range(3)) + 0x27D4EB2F * k) & 0xFFFFFFFF
            x ^= x >> 15
            held[(x * 0x2C1B3C6D & 0xFFFFFFFF) >> 25] += 1
    q = sorted(held)[31], sorted(held)[63], sorted(held)[95]
    code = [sum(c > v for v in q) for c in held]
    body = bytes(code[i] << 6 | code[i + 1] << 4 | code[i + 2] << 2 | code[i + 3] for i in range(0, 128, 4))
    top = max(q[2], 1)
    return bytes([min(255, int(np.floor(np.log1p(len(b)) / np.log(1.2)))), (15 * q[0] // top) << 4 | (15 * q[1] // top)]) + body


def liking(a, b):
    """1 less the bounded difference's share: steps of quartiles (three count six), of the length (four each) and of both ratios (two each)."""
    steps = 4 * min(16, abs(a[0] - b[0])) + 2 * (abs((a[1] >> 4) - (b[1] >> 4)) + abs((a[1] & 15) - (b[1] & 15)))
    for x, y in zip(a[2:], b[2:], strict=True):
        steps += sum((0, 1, 2, 6)[abs((x >> k & 3) - (y >> k & 3))] for k in (0, 2, 4, 6))
    return 1 - min(steps, 400) / 400


def test_digests_of_ties(spark):
    """Null and equal doc_ids: an order that reruns keep, each row followed by the next one in it."""
    rows = [(None, "b"), (None, "a"), (None, None), (3, "x y"), (3, "x y"), (3, "other text"), (1, "é" * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    runs = [quartile_digest.fingerprint(docs.repartition(k)).collect() for k in (1, 4)]
    assert sorted(runs[0], key=repr) == sorted(runs[1], key=repr)
    got = runs[0]
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == sorted((i or 0, len(t or "")) for i, t in rows)
    # A walk along near_next = 1 for the equal rows: one of the two is followed by the other.
    assert sum(r.near_next == 1.0 for r in got if r.doc_id == 3 and r.n_chars == 3) == 1


def test_digests(docs):
    rows = [r for r in docs.dropDuplicates(["doc_id"]).collect() if r.doc_id is not None]
    rows.sort(key=lambda r: r.doc_id)
    some = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in quartile_digest.fingerprint(some).collect()}
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        t, nxt = r.text or "", rows[(i + 1) % len(rows)].text or ""
        half = len(t) // 2
        new = t[: len(t) - half] + nxt[:half]
        g = got[r.doc_id]
        assert (g.n_chars, g.edited_sha256, g.fingerprint, g.edited_fingerprint) == (len(t), hashlib.sha256(new.encode()).hexdigest(), digest(t).hex(), digest(new).hex())
        assert (g.near_edited, g.near_next) == (liking(digest(t), digest(new)), liking(digest(t), digest(nxt)))
    assert quartile_digest.fingerprint(docs).count() == docs.count()
    assert quartile_digest.fingerprint(none_of(docs)).count() == 0
    one = quartile_digest.fingerprint(docs.where("doc_id = 30")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
