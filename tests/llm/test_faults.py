"""Columns that clash, long texts full of phrases, medians among many values."""

import os
import sys
import time

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerline.llm import sharding  # noqa: E402
from ledgerline.llm.licenses import Scanner  # noqa: E402
from ledgerline.llm.mixing import mix_sources  # noqa: E402


def test_mixing_with_clashing_columns(spark):
    names = ["mean", "bucket", "copies", "row", "__n", "__bucket", "mix_mean", "bytes", "weight"]
    rows = [(i, "x" * (i % 7), f"s{i % 3}", *[f"{n}{i}" for n in names]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    got = mix_sources(df, {"s0": 0.5, "s1": 0.5}, 0.5, 4.0)
    plain = mix_sources(df.select("doc_id", "text", "source"), {"s0": 0.5, "s1": 0.5}, 0.5, 4.0)
    assert got.columns == [c for c in df.columns if c != "mix_mean"] + ["mix_mean", "mix_copy", "mix_key"]
    key = lambda r: (r.doc_id, r.mix_copy, r.mix_key, r.mix_mean)
    assert sorted(map(key, got.collect())) == sorted(map(key, plain.collect())) and got.count() > 60
    assert all(r[n] == f"{n}{r.doc_id}" for r in got.collect() for n in names if n != "mix_mean")


def test_license_scan_of_a_long_text_takes_linear_time():
    scan, unit = Scanner().scan, b"under the mit license released undr the mit licence "
    took = []
    for n in (2_000, 20_000):
        start = time.process_time()
        got = scan(unit * n)
        took.append(time.process_time() - start)
        assert (got["n_base"], got["first_word"], got["last_word"], got["n_words"]) == (n, 0, 9 * (n - 1), 9 * n)
    assert took[1] < 40 * max(took[0], 0.02)


def test_median_among_many_values(spark, monkeypatch):
    """With two slices a pass, only narrowing to one value gives the weighted median of a slow k-d tree."""
    monkeypatch.setattr(sharding, "SLICES", 2)
    rng = np.random.default_rng(3)
    rows = [(int(i), int(s), 0, float(a), float(b), 0.0, 0.0, float(t)) for i, (s, a, b, t) in enumerate(
        zip(rng.integers(1, 90, 300), rng.random(300), rng.choice([0.1, 0.5, 0.9], 300), rng.random(300)))]
    schema = "doc_id long, size long, text_crc32 long, d_size double, d_source double, d_lang double, d_place double, tie double"
    got = {r.doc_id: r.shard for r in sharding.kd_tree(spark.createDataFrame(rows, schema), 4).collect()}

    def slow(rows, shard, leaves):
        if leaves == 1:
            return {r[0]: shard for r in rows}
        dim = max(range(3, 7), key=lambda d: (max(r[d] for r in rows) - min(r[d] for r in rows), d))
        half, goal = (leaves + 1) // 2, sum(r[1] for r in rows) * ((leaves + 1) // 2) / leaves
        total, median = 0, None
        for value in sorted({r[dim] for r in rows}):
            total += sum(r[1] for r in rows if r[dim] == value)
            if total >= goal:
                median = value
                break
        left = [r for r in rows if got[r[0]] < shard + half]
        assert all(r[dim] <= median for r in left) and all(r[dim] >= median for r in rows if r not in left)
        return slow(left, shard, half) | slow([r for r in rows if r not in left], shard + half, leaves - half)

    assert slow(rows, 0, 4) == got and set(got.values()) == {0, 1, 2, 3}


def test_words_move_from_generation_to_generation(monkeypatch):
    from ledgerline.llm import bpe
    from ledgerline.llm.settings import VOCABULARY

    plain = bpe.WordBpe(VOCABULARY)
    texts = [f"the word{i % 50} and other{i} things".encode() for i in range(200)]
    want = plain.encode(texts)
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    small = bpe.WordBpe(VOCABULARY)
    assert [small.encode([t])[0] for t in texts] == want
    assert len(small.known) <= 16 and len(small.older) <= 16 and b"the" in small.known.keys() | small.older.keys()
