"""Operator 5 against brute force."""

import random
import re

import numpy as np
import pytest

from quaymark.llm import compact_windows as C
from quaymark.llm import textkernel as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("width", [1, 2, 5, 7])
def test_compact_windows(width):
    r = np.random.default_rng(width)
    sizes = [0, 1, 3, 7, 8, 40, 100]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    values = K.mix(r.integers(0, 30, bounds[-1]).astype(np.uint64))
    got = set(zip(*(x.tolist() for x in C.compact_windows(values, bounds, width)), strict=True))
    want = set()

    def divide(a, b):
        if b - a >= width:
            c = a + int(np.argmin(values[a:b] >> np.uint64(C.PLACE_BITS)))
            want.add((a, c, b - 1))
            divide(a, c)
            divide(c + 1, b)

    for a, b in zip(bounds, bounds[1:]):
        divide(int(a), int(b))
    assert got == want


def brute_windows(values, bounds):
    """Starts by text and minimum, from every passage."""
    out = {}
    for d, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
        for i in range(a, b - C.SPAN + 1):
            out.setdefault((d, i), int(np.argmin(values[i : i + C.SPAN] >> np.uint64(C.PLACE_BITS))) + i)
    return out


def test_windows_partition_the_starts():
    grams = K.mix(np.arange(700, dtype=np.uint64) // np.uint64(2))
    bounds = np.array([0, 200, 210, 210, 500, 700])
    for f in range(C.HASHES):
        values = K.mix(grams ^ C._KEYS[f])
        window = C.compact_windows(values, bounds, C.SPAN)
        lo, hi = C.starts_of(*window, C.SPAN)
        got = {i: c for a, b, c in zip(lo.tolist(), hi.tolist(), window[1].tolist(), strict=True) for i in range(a, b + 1)}
        assert got == {i: c for (_, i), c in brute_windows(values, bounds).items()}


def test_common():
    r = np.random.default_rng(5)
    for _ in range(50):
        lists = []
        for _ in range(2):
            at = np.sort(r.choice(60, 2 * int(r.integers(0, 10)), replace=False))
            lists.append((at[::2], at[1::2]))
        inside = [{x for a, b in zip(*l, strict=True) for x in range(a, b + 1)} for l in lists]  # noqa: E741
        lo, hi, i, j = C.common(*lists)
        got = [x for a, b in zip(lo.tolist(), hi.tolist(), strict=True) for x in range(a, b + 1)]
        assert got == sorted(inside[0] & inside[1])
        assert all(lists[0][0][x] <= a <= lists[0][1][x] and lists[1][0][y] <= a <= lists[1][1][y] for a, x, y in zip(lo, i, j, strict=True))


def corpus():
    r = random.Random(7)
    fresh = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    shared = [fresh(n) for n in (50, 51, 60, 120, 49, 30)]
    out = [(0, None), (1, ""), (2, "a b c"), (3, "z " * 400)]
    for _ in range(40):
        text = fresh(r.randint(0, 90))
        for p in r.sample(shared, r.randint(0, 2)):
            text += p + fresh(r.randint(1, 60))
        out.append((len(out), r.choice([" ", "\n"]).join(text)))
    out += [(len(out), out[20][1]), (20, out[20][1]), (None, out[21][1]), (None, None)]
    return out


def test_exact_spans(spark):
    rows = corpus()
    where = {}
    for _, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - 49):
            where.setdefault(tuple(w[i : i + 50]), set()).add(t)
    copies = {t for _, t in rows if t and sum(t == u for _, u in rows) > 1}
    want = set()
    for d, t in rows:
        w = WORD.findall(t or "")
        if t in copies and len(w) >= 50:
            want.add((d, 0, len(w)))
            continue
        spans = []
        for i in range(len(w) - 49):
            if len(where[tuple(w[i : i + 50])]) > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + 50
                else:
                    spans.append([i, i + 50])
        want |= {(d, a, b) for a, b in spans}
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, passage string, id int").repartition(4)
    got = C.repeated(docs).collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in got if r.exact} == want and len(want) > 20
    texts = dict(rows)
    for r in got:  # what is near but not the same still has most 5-grams of another document's passage
        if not r.exact:
            w = WORD.findall(texts[r.doc_id])[r.start_word : r.end_word]
            mine = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
            others = [set(zip(*(v[i:] for i in range(5)))) for d, t in rows if d != r.doc_id and t for v in [WORD.findall(t)]]
            assert len(mine & set().union(*others)) >= 0.6 * len(mine)


def test_near_passages(spark):
    r = random.Random(9)
    fresh = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows, near = [], set()
    for k in range(30):
        base = fresh(160)
        changed = list(base)
        for at in (40, 80, 120):  # no 50 words in a row stay the same
            changed[at] = "x"
        near |= {2 * k, 2 * k + 1}
        rows += [(2 * k, " ".join(fresh(40) + base + fresh(20))), (2 * k + 1, " ".join(fresh(9) + changed + fresh(30)))]
    rows += [(100 + k, " ".join(fresh(200))) for k in range(20)]
    got = {x.doc_id for x in C.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= near and len(got) >= 0.9 * len(near)


def test_empty(spark):
    assert C.repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("sent", ["-1", "10MB"])
def test_texts_move_once(spark, monkeypatch, sent):
    """At any size one shuffle deals the texts, and none follows; their table and its name go afterwards."""
    plans = []

    def kept(write):
        def run(df, *args):
            plans.append(df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
            return write(df, *args)

        return run

    for name in ("written", "dealt"):
        if hasattr(C, name):
            monkeypatch.setattr(C, name, kept(getattr(C, name)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", sent)
    try:
        docs = spark.createDataFrame([(d, t) for d, t in corpus()], "doc_id long, text string")
        assert C.repeated(docs).count() > 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [re.findall(r"\) Exchange\nInput \[\d+\]: \[[^]]*\btext#", p) for p in plans]
    assert sum(map(len, moved)) == 1
    assert not [t.name for t in spark.catalog.listTables() if "passages" in t.name]


@pytest.mark.parametrize("rows", [512, 7])
def test_alike_is_brute_force(monkeypatch, rows):
    monkeypatch.setattr(C, "ROWS", rows)
    r = np.random.default_rng(4)
    for _ in range(30):
        base, ids, sizes, runs = r.integers(0, 10**6, 64), [], [], []
        for i in range(int(r.integers(2, 7))):
            n = int(r.integers(1, 20))
            run = base[: n + C.SPAN - 1].copy()
            run[r.integers(0, len(run), int(r.integers(0, 12)))] = r.integers(0, 40, 1)
            ids, sizes, runs = [*ids, i // 2], [*sizes, n], [*runs, run]
        free = r.random(sum(sizes)) < 0.7
        sets = [(i, set(run[a : a + C.SPAN].tolist())) for i, n, run in zip(ids, sizes, runs, strict=True) for a in range(n)]
        want = [f and any(i != j and len(s & t) >= C.NEAR * len(s | t) for j, t in sets) for f, (i, s) in zip(free.tolist(), sets, strict=True)]
        assert C.alike(np.array(ids), np.array(ids), np.array(sizes), free, np.concatenate(runs)).tolist() == want


@pytest.mark.parametrize("signs", [4_000_000, 50])
def test_alike_in_few_is_alike(monkeypatch, signs):
    """Many keys at once give what each gives alone, with cells that stand for several texts and 5-grams that repeat."""
    monkeypatch.setattr(C, "SIGNS", signs)
    r = np.random.default_rng(6)
    for _ in range(20):
        parts = []
        for _ in range(int(r.integers(1, 12))):
            base, cells = r.integers(0, 1 << 40, 64, dtype=np.uint64), []
            for i in range(int(r.integers(1, 6))):
                n = int(r.integers(1, 20))
                run = base[: n + C.SPAN - 1].copy()
                run[r.integers(0, len(run), int(r.integers(0, 12)))] = r.integers(0, 40, 1, dtype=np.uint64)
                one = r.random() < 0.7
                cells.append((i // 2, i // 2 if one else i // 2 + 3, n, (r.random(n) < 0.7) & one, run))
            parts.append(cells)
        flat = [c for cells in parts for c in cells]
        key = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        low, high, sizes = (np.array([c[i] for c in flat]) for i in range(3))
        got = C.alike_in_few(key, low, high, sizes, np.concatenate([c[3] for c in flat]), np.concatenate([c[4] for c in flat]))
        want = [C.alike(*(np.array([c[i] for c in p]) for i in range(3)), np.concatenate([c[3] for c in p]), np.concatenate([c[4] for c in p])) for p in parts]
        assert got.tolist() == np.concatenate(want).tolist()


@pytest.mark.parametrize("block", [256, 2])
def test_near_to_any_text_of_a_cell(spark, monkeypatch, block):
    """Texts A, B, C share minima; only two of them are near, whichever ids they have. And short near passages."""
    monkeypatch.setattr(C, "BLOCK", block)
    r = random.Random(11)
    fresh = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows, near = [], set()
    for k in range(40):
        base = fresh(r.randint(50, 70))
        other = list(base)
        other[r.choice([2, len(base) - 3])] = "x"
        loose = [[w if i % 12 else f"v{k}.{j}" for i, w in enumerate(base)] for j in range(6)]
        near |= {(k, 0), (k, 1)}
        rows += [(10 * k + j, " ".join(fresh(30) + p + fresh(30))) for j, p in enumerate([base, other, *loose])]
    got = {(x.doc_id // 10, x.doc_id % 10) for x in C.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect() if not x.exact}
    assert len(got & near) >= 0.9 * len(near)


def test_near_beside_exact(spark):
    """Two texts share 100 words but for word 76: what reaches beyond the exact span of words 0 to 75 is near."""
    r = random.Random(12)
    fresh = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(20):
        base = fresh(100)
        rows += [(2 * k, " ".join(base + fresh(40))), (2 * k + 1, " ".join(base[:76] + ["x"] + base[77:] + fresh(40)))]
    rows += [(100, " ".join(["z"] * 300)), (101, " ".join(["z"] * 290 + ["y"]))]
    got = C.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.start_word, x.end_word) for x in got if x.exact and x.doc_id < 100) == [(d, 0, 76) for d in range(40)]
    assert len({x.doc_id for x in got if not x.exact and x.doc_id < 100 and x.end_word >= 100}) >= 36


def shared_passages(texts):
    """(exact, near): the starts of 50-word passages that another text has, or has with 41 of 46 5-grams in place (a similarity of 0.8), by all alignments of any two texts."""
    where = {}
    for d, w in texts.items():
        for i in range(len(w) - 4):
            where.setdefault(tuple(w[i : i + 5]), []).append((d, i))
    lines = {}
    for found in where.values():
        if len(found) <= 60:
            for d, i in found:
                for e, j in found:
                    if d != e:
                        lines.setdefault((d, e, i - j), []).append(i)
    exact, near = {}, {}
    for (d, _, _), places in lines.items():
        if len(places) >= 41:
            mark = np.zeros(len(texts[d]) - 4, int)
            mark[places] = 1
            count = np.convolve(mark, np.ones(46, int), "valid") if len(mark) >= 46 else np.zeros(0, int)
            exact.setdefault(d, set()).update(np.flatnonzero(count == 46).tolist())
            near.setdefault(d, set()).update(np.flatnonzero((count >= 41) & (count < 46)).tolist())
    return exact, {d: s - exact[d] for d, s in near.items()}


def test_recall_of_passages(spark):
    """Passages, not documents: all exact ones, and nine of ten near ones, lie wholly inside a span."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    first = {}
    for r in docs.orderBy("doc_id").collect():
        first.setdefault(r.text, r.doc_id)
    exact, near = shared_passages({d: WORD.findall(t) for t, d in first.items()})
    spans = {}
    for r in C.repeated(docs).collect():
        spans.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    inside = lambda found: [any(a <= i and i + 50 <= b for a, b in spans.get(d, [])) for d, s in found.items() for i in s]
    assert all(inside(exact)) and len(inside(exact)) > 5000
    hit = inside(near)
    assert len(hit) > 5000 and sum(hit) >= 0.9 * len(hit)
