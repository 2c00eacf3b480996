"""Best-fit packing: tokens against the tokenizers library, placements against the texts, plans against bounds."""

import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tokenizers

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import SF  # noqa: E402

from ledgerline.llm import queries as L  # noqa: E402
from ledgerline.llm.packing import Stock, byte_level, pack, plan, sequences, slots  # noqa: E402
from ledgerline.llm.settings import BYTE_VOCABULARY  # noqa: E402


def library():
    tokenizer = tokenizers.Tokenizer.from_file(BYTE_VOCABULARY)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def odd_texts(r, n):
    letters = ["a", "B", "'s", "'LL", " ", "  ", "\n", "\t", "\r\n", "1", "９", "é", "é", "ß", "日本", "🙂", " ", " ", "‍", "_", "...", "<|endoftext|>",
               "<|", "\x00", "\x85", "　", "İ", "١", "﻿", "ﬁ", "%", "Ⅷ", "the", "ing"]
    return ["".join(r.choices(letters, k=r.randint(0, 30))) for _ in range(n)]


def test_tokens_equal_the_library():
    encode, encoding = library(), byte_level(BYTE_VOCABULARY)
    for text in [*odd_texts(random.Random(3), 4000), "x" * 20_000, " " * 20_000, "日本" * 5000, "\n " * 9000 + "a"]:
        assert encoding.encode(text, allowed_special="all") == encode(text)


def slow_exact(counts, gap):
    own = [x for x in range(1, gap + 1) if counts[x]]
    if counts[gap]:
        return 1
    if any(0 < gap - a and counts[gap - a] > (a == gap - a) for a in own):
        return 2
    for a in own:
        for b in own:
            c = gap - a - b
            if c > 0 and counts[c] and all(counts[x] >= n for x, n in Counter([a, b, c]).items()):
                return 3
    return 0


def test_exact_complements():
    r = random.Random(1)
    for _ in range(300):
        size = r.randint(3, 40)
        counts = np.array([0] + [r.choice([0, 0, 0, 1, 2, 5]) for _ in range(size)])
        stock = Stock(counts)
        for _ in range(10):
            gap = r.randint(1, size)
            got = stock.exact(gap)
            assert (len(got) if got else 0) == slow_exact(stock.left, gap)
            if got:
                assert sum(got) == gap and all(stock.left[x] >= n for x, n in Counter(got).items())
                for x in got:
                    stock.take(x)


def best_fit_decreasing(counts):
    room = Counter()
    bins, size = 0, len(counts) - 1
    for length in range(size, 0, -1):
        for _ in range(int(counts[length])):
            fit = min((g for g in room if g >= length and room[g]), default=None)
            if fit is None:
                bins, fit = bins + 1, size
            else:
                room[fit] -= 1
            room[fit - length] += 1
    return bins


@pytest.mark.parametrize("size", [10, 60, 200])
def test_plan(size):
    r = random.Random(size)
    for _ in range(40):
        counts = np.array([0] + [r.choice([0, 0, 1, 2, 7, 40]) for _ in range(size)])
        if r.random() < 0.3:
            counts[1 + size // 3 :] = 0
        patterns = plan(counts)
        used = Counter()
        for items, times in patterns:
            assert sum(items) <= size and times > 0
            for x in items:
                used[x] += times
        assert used == Counter({x: int(n) for x, n in enumerate(counts) if n})
        bins, least = sum(t for _, t in patterns), -(-int((counts * np.arange(size + 1)).sum()) // size)
        assert least <= bins <= best_fit_decreasing(counts) + 1
        assert len(slots(patterns, size)) <= sum(len(set(i)) for i, _ in patterns)


def test_many_pieces_take_few_steps():
    counts = np.append(0, np.random.default_rng(0).integers(0, 10**9, 1024))
    patterns = plan(counts)
    total = int((counts * np.arange(1025)).sum())
    assert len(patterns) < 20_000 and sum(t for _, t in patterns) <= 1.005 * total / 1024 + 1000
    assert sum(t for _, t in plan(np.array([0, 10**12, *[0] * 1023]))) == -(-(10**12) // 1024)


def check_placements(rows, texts, capacity):
    encode, by_doc, by_sequence = library(), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    wanted = Counter()
    for d, t in texts:
        ids = [*encode(t), 2]
        first = len(ids) - (-(-len(ids) // capacity) - 1) * capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        wanted.update((d, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_query(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = L.QUERIES["op11_packing"](spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = got.collect()
    assert check_placements(rows, texts, 1024) <= -(-sum(r.length for r in rows) // 1024) + 2


def test_awkward_rows_and_sequences(spark):
    texts = [(1, None), (2, ""), (2, ""), (None, "a b"), (None, None), (3, "x y " * 20_000), (4, "<|endoftext|>"), *[(10 + i, "same text here") for i in range(500)],
             *[(1000 + i, "w " * i) for i in range(200)], (5, "v " * 31), (6, "v " * 63)]
    df = spark.createDataFrame([(*t, 1, "p", 2) for t in texts], "doc_id long, text string, part int, length string, rank int").repartition(5)
    rows = pack(df, BYTE_VOCABULARY, capacity=64, ids=True).collect()
    check_placements(rows, texts, 64)
    packed = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, token_ids binary, sequence_id long, offset long")
    parts = defaultdict(dict)
    for r in rows:
        parts[r.sequence_id][r.offset] = bytes(r.token_ids)
    for s in sequences(packed).collect():
        assert bytes(s.token_ids) == b"".join(parts[s.sequence_id][o] for o in sorted(parts[s.sequence_id])) and s.n_tokens * 4 == len(s.token_ids)
        assert len(s.doc_ids) == len(parts[s.sequence_id])
    assert pack(df.limit(0), BYTE_VOCABULARY).count() == 0
