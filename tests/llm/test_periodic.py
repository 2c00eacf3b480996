"""Periodic runs against a slow search over all places and periods, on the table and on awkward rows."""

import hashlib
import os
import random
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import SF  # noqa: E402

from ledgerline.llm import periodic  # noqa: E402
from ledgerline.llm import queries as L  # noqa: E402
from ledgerline.llm.periodic import find_runs, periodic_runs  # noqa: E402


def slow_runs(words, min_length=12):
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            s, size = i - q, j - i + q
            if j > i and size >= max(min_length, 2 * q):
                stretch = words[s:j]
                if not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                    out.append((s, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_of(docs, min_length=12):
    sizes = np.array([len(d) for d in docs])
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(docs)), sizes)
    symbols = np.array([w for d in docs for w in d], np.int64) * len(docs) + doc
    found = find_runs(symbols, ends[doc] - np.arange(len(symbols)), min_length)
    return list(zip(*[x.tolist() for x in found])), (ends - sizes).tolist()


@pytest.mark.parametrize("size", [1 << 20, 7])
def test_find_runs(monkeypatch, size):
    """Short slices leave diagonals open from slice to slice."""
    monkeypatch.setattr(periodic, "SLICE", size)
    r = random.Random(5)
    for _ in range(500):
        docs = []
        for _ in range(r.randint(1, 4)):
            kinds, n = r.choice([1, 2, 2, 3, 5]), r.choice([0, 1, 5, 12, 13, 40, 150])
            w = [r.randrange(kinds) for _ in range(n)]
            if n and r.random() < 0.6:
                a = r.randrange(n)
                p = 1 + (n - a) // r.randint(1, 9)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        least = r.choice([12, 12, 2, 3, 7, 20])
        got, begins = runs_of(docs, least)
        assert got == [(b + s, n, q) for b, d in zip(begins, docs) for s, n, q in slow_runs(d, least)]


def test_one_word_a_million_times():
    n = 300_000
    assert [x.tolist() for x in find_runs(np.zeros(n, np.int64), n - np.arange(n), 12)] == [[0], [n], [1]]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(words)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_slow_search(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = L.QUERIES["op12_periodic_runs"](spark, SF)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == sorted(expected(d, t) for d, t in docs)


def test_awkward_rows(spark, tmp_path):
    cycle = " ".join(["a b c"] * 30_000)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "x " * 12), (4, "x " * 12), (5, "x " * 11), (None, "y\ty\n" * 9), (None, None),
            (6, cycle + " z " + cycle), (7, "é  ü\r\n" * 7), (8, "a b " * 12)]
    planted = [d for d in range(9, 60) if zlib.crc32(str(d).encode()) % 10 == 0]
    rows += [(d, " ".join(f"w{i}" for i in range(40 + d))) for d in planted] + [(planted[0], None), (planted[1], "")]
    df = spark.createDataFrame([(*r, None, "s", [1]) for r in rows], "doc_id long, text string, runs string, words string, n array<int>").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in L.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()}
    assert got - {r for r in got if r[0] == 6} == {expected(d, t) for d, t in rows if d != 6}
    six = [r for r in periodic_runs(df).collect() if r.doc_id == 6][0]
    assert [tuple(r) for r in six.runs] == [(0, 90_000, 3), (90_001, 90_000, 3)] and six.n_words == 180_001
    assert six.collapsed == "a b c z a b c"
    assert periodic_runs(df.limit(0)).count() == 0
