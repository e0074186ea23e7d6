"""Operator 4 against all pairs by brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quaymark.llm import jaccard_join as J
from quaymark.llm.components import connected

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall(t or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def corpus(n_groups=12, seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = [None, "", " \n", "a b", "a  b", "a b c", "one two three four five", "long " * 3000]
    for _ in range(n_groups):
        base = [r.choice(vocabulary) for _ in range(r.randint(30, 300))]
        out.append(" ".join(base))
        for _ in range(r.randint(0, 8)):
            new = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 60))):
                new[r.randrange(len(new))] = r.choice(vocabulary)
            out.append(r.choice([" ", "\n"]).join(new))
    out += [" ".join(r.choice(vocabulary) for _ in range(80)) for _ in range(40)]
    return out


def brute(rows, t=0.8):
    sets = [shingles(x[1]) for x in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if union and len(sets[i] & sets[j]) >= t * union:
                links[i] += 1
                links[j] += 1
                parent[top(i)] = top(j)
    ids = {}
    for i, x in enumerate(rows):
        if x[0] is not None:
            ids[top(i)] = min(ids.get(top(i), x[0]), x[0])
    return [(x[0], ids.get(top(i)), links[i]) for i, x in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "junk") for i, t in enumerate(corpus())]
    return out + [out[12], out[12], (None, out[15][1], None), (None, None, None)]


@pytest.mark.parametrize("block", [256, 4])
def test_join(spark, rows, block, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", block)
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(5)
    got = sorted((tuple(r) for r in J.join(docs).collect()), key=repr)
    want = sorted(brute(rows), key=repr)
    assert got == want and sum(w[2] for w in want) > 50


def test_chained_component(spark, monkeypatch):
    """A chain of texts, each near to its neighbours alone: links are right, and sets go only where a neighbour is."""
    monkeypatch.setattr(J, "BLOCK", 4)
    words = [f"w{i}" for i in range(500)]
    rows = [(i, " ".join(words[5 * i : 5 * i + 100])) for i in range(60)]
    sent, meetings = [], J.meetings

    def counted(*args):
        out = meetings(*args)
        sent.append(out.count())
        return out

    monkeypatch.setattr(J, "meetings", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.join(docs).collect())) == sorted(brute(rows))
    assert {r.class_id for r in J.join(docs).collect()} == {0}
    blocks = 15
    assert sent[0] < 60 * blocks / 2  # not every set to every block


def test_large_buckets_do_not_chain(spark, monkeypatch):
    """Texts that share a bucket without being near are no candidates: the least node's star has its neighbours alone, and the others are compared with all."""
    monkeypatch.setattr(J, "BLOCK", 3)
    monkeypatch.setattr(J, "bands", lambda reps: reps.select(J.F.lit(1).cast("long").alias("key"), "node"))
    r = random.Random(3)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(6):
        base = words(100)
        rows += [(10 * k + j, " ".join([*base[:50], f"x{j}", *base[51:]])) for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    reps = J.representatives(J.described(docs))
    of = {x.node: x.first.doc_id // 10 for x in reps.collect()}
    edges = J.candidates(reps, 0.8, 1e-6).collect()
    assert edges and all(of[x.a] == of[x.b] for x in edges)
    assert sorted(map(tuple, J.join(docs).collect())) == sorted(brute(rows))


def test_one_batch():
    chunks = pa.table({"a": pa.chunked_array([[1], [2, 3]]), "b": pa.chunked_array([[b"x"], [b"yy", None]], pa.binary())})
    got = J.one_batch(chunks)
    assert got.num_rows == 3 and got.column("b").to_pylist() == [b"x", b"yy", None] and got.column("b").type == pa.large_binary()


@pytest.mark.parametrize("most", [10**6, 0])
def test_one_of_each(spark, rows, most, monkeypatch):
    monkeypatch.setattr(J, "MOST_SENT", most)
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(5)
    out = J.one_of_each(docs)
    assert out.schema == docs.schema
    want = {c for _, c, _ in brute(rows) if c is not None}
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted(want)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, node string")
    assert J.join(none).count() == J.one_of_each(none).count() == 0


def test_posterior():
    """The bound equals the tail of the Beta posterior, integrated."""
    x = np.linspace(0, 1, 200001)
    for n, m in zip(J.STEPS[:4], J.least_matches(0.8, 1e-3)):
        for k, reaches in ((m, True), (m - 1, False)):
            density = x**k * (1 - x) ** (n - k)
            assert (density[x >= 0.8].sum() / density.sum() >= 1e-3) == reaches


def test_sketch_estimates():
    a, b = " ".join(f"w{i}" for i in range(500)), " ".join(f"w{i}" for i in range(100, 600))
    s = J.sketches(*J.distinct_shingles(pa.array([a, b])))
    assert abs((s[0] == s[1]).mean() - 396 / 596) < 0.12


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(r.randint(200, 300), r.randint(200, 300)) for _ in range(60)]
    got = {x.node: x.label for x in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: i for e in edges for i in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want
