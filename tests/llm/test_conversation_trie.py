"""The conversation trie against a plain one built in memory, with short blocks, common keys and awkward rows."""

import hashlib
import os
import random
import sys
import zlib
from collections import defaultdict

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import SF  # noqa: E402

from ledgerline.llm import conversation_trie as C  # noqa: E402
from ledgerline.llm import queries as L  # noqa: E402

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0, role.encode(), digest), (role, text)))
    own = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        base = c - int(c / 100) * 100
        built[c] = own.get(c - base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, below = defaultdict(int), defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]] += 1
        for d in range(len(path) + 1):
            below[path[:d]].append(path)
    saved = {p: (len(m) - 1) * len(p[-1][1]) if p else 0 for p, m in members.items()}
    out = set()
    for path, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(path))
        out.add((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), children[path], sum(not children[q] for q in below[path]),
                 sum(saved[q] for q in below[path]), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rows_like(r, n, turns):
    """Few different turns, so that prefixes are shared; some turns null, repeated or without a number."""
    out = []
    for c in r.sample(range(-150, 700), n):
        for t in range(r.randint(1, turns)):
            out.append((c, t if r.random() < 0.95 else None, r.choice(["user", "assistant", None]), r.choice(["a", "ü b", "", None, "日本"])))
    return out


SCHEMA = "conv_id long, turn long, role string, text string, key string, depth string, n_convs int"


@pytest.mark.parametrize("least,block,ends", [(10_000, 4096, 8192), (3, 2, 2), (3, 1, 3)])
def test_query_equals_plain_trie(spark, monkeypatch, tmp_path, least, block, ends):
    monkeypatch.setattr(C, "LEAST", least)
    monkeypatch.setattr(C, "SHARE", 1 / 20)
    monkeypatch.setattr(C, "ENDS", ends)
    monkeypatch.setattr(C.trie_of, "__defaults__", (block,))
    r = random.Random(least + block)
    rows = rows_like(r, 80, 7) + [(1000 + i, t, "user", f"same {t}") for i in range(30) for t in range(6)] + [(5, t, "user", "long") for t in range(300)]
    rows += [(None, 1, "user", "nobody"), (5, 3, "user", "long"), (5, 3, "user", "long")]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, "k", "d", 1) for x in rows], SCHEMA).repartition(3)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = L.QUERIES["op13_conversation_trie"](spark, str(tmp_path))
    assert got.columns == COLUMNS
    got = [tuple(x) for x in got.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows)


def test_turns_below_a_task(spark):
    """One conversation over all tasks: places go on from task to task."""
    rows = [(7, t, "user", f"t{t}") for t in range(2000)]
    got = C.numbered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))
    digest = lambda t: hashlib.sha256(f"4:usert{t}".encode()).digest()
    assert sorted((x.place, bytes(x.digest), x.chars) for x in got.collect()) == [(t + 1, digest(t), len(f"t{t}")) for t in range(2000)]


def test_real_outputs(spark):
    df = spark.createDataFrame([(1, 0, "u", "hi"), (1, 1, "a", "yo"), (2, 0, "u", "hi"), (3, 0, "u", "hi"), (3, 1, "a", "yo")],
                               "conv_id long, turn long, role string, text string")
    trie = C.conversation_trie(df, rebuild=False)
    assert {(x.depth, x.role, x.text, x.n_convs, x.saved) for x in C.with_texts(trie.nodes, df).collect()} == {
        (0, None, None, 3, 6), (1, "u", "hi", 3, 6), (2, "a", "yo", 2, 2)}
    assert {(x.conv_id, x.weight, x.depth, x.leaf) for x in trie.sequences.collect()} == {(1, 2, 2, True), (2, 1, 1, False)}
    ends = defaultdict(list)
    for x in sorted(trie.ends.collect(), key=lambda x: x.part):
        ends[bytes(x.key)] += x.conv_ids
    assert sorted(ends.values()) == [[1, 3], [2]]


def test_empty_table_and_turnless_conversations(spark):
    none = C.conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert none.nodes.count() == none.sequences.count() == none.ends.count() == 0
    lone = [c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 5][:2]
    df = spark.createDataFrame([(c, 0, "user", "x") for c in lone], "conv_id long, turn long, role string, text string")
    (root,) = C.conversation_trie(df).nodes.collect()
    assert (root.conv_id, root.depth, root.n_convs, root.n_children, root.n_leaves, root.saved) == (lone[0], 0, 2, 0, 1, 0)


def test_whole_table(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(x) for x in L.QUERIES["op13_conversation_trie"](spark, SF).collect()} == plain_trie(rows)
