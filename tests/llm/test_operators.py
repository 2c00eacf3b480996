"""The training-data operators against brute force, round trips and held-out labels, and on awkward rows."""

import base64
import hashlib
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

import corpus_pipeline  # noqa: E402
from ledgerline.llm import queries as L  # noqa: E402
from ledgerline.llm.bpe import WordBpe, decode_tokens, encode_texts  # noqa: E402
from ledgerline.llm.exact_dedup import drop_copies, exact_dedup  # noqa: E402
from ledgerline.llm.licenses import Scanner, scan_licenses  # noqa: E402
from ledgerline.llm.mixing import mix_sources  # noqa: E402
from ledgerline.llm.ngram_join import drop_near_copies, ngram_components  # noqa: E402
from ledgerline.llm.repetition import measures, repetition_rules  # noqa: E402
from ledgerline.llm.settings import EPOCHS, REST, SEED, VOCABULARY, WEIGHTS  # noqa: E402
from ledgerline.llm.sharding import kd_shards  # noqa: E402
from ledgerline.llm.token_files import crc32c, frames, read_tokens, unframed, write_tokens  # noqa: E402
from ledgerline.llm.toxicity import drop_toxic, score_toxicity, train  # noqa: E402
from ledgerline.llm.warc import SKIPPABLE, archive, frames_of, parse, read_warc, record, write_warc  # noqa: E402

LONG = " ".join(f"word{i % 7919}" for i in range(60_000))
#: Nulls, empty and blank texts, a very long one, ties, a repeated row, other scripts.
TEXTS = [
    (1, "a b c d e f g"), (2, "a  b c d e f\tg"), (3, None), (4, ""), (5, " \n\t"), (6, LONG), (7, LONG + " x"), (8, "a b c d e f g"),
    (8, "a b c d e f g"), (None, "no id"), (None, None), (11, "É é ΣΣ İ 日本　x'll"), (12, "<|endoftext|> Under the MIT License"),
    (13, "x\nx\nx y z x y z\n\n"), (-5, "zz"),
]
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, shard string, label string, grams binary"


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(d, t, None if k % 3 else "en", None if k % 4 == 0 else f"src{k % 3}", None, 0.5, True, "s", "l", b"g") for k, (d, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, EXTRA).repartition(3)


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


@pytest.mark.parametrize("key", sorted(k for k in L.ORACLES if L.ORACLES[k]))
def test_query_equals_sql(spark, duck, key):
    df = L.QUERIES[key](spark, SF)
    cursor = duck.execute(L.ORACLES[key])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df, *names) == sorted(cursor.fetchall(), key=repr)


# 1 WARC

def test_warc_round_trip(spark):
    pages = [(1, "http://a/ü\n", "<p>x</p>"), (2, None, "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (None, "n", "<p>x</p>"),
             (5, "u", "é" * 300_000), (None, None, None)]
    df = spark.createDataFrame([(*p, "z", 1) for p in pages], "page_id long, url string, html string, payload string, bytes int").repartition(3)
    folder, files = write_warc(df)
    got = read_warc(spark, folder, files).collect()
    assert len(got) == len(pages)
    best, nulls_first = {}, lambda i: (i is not None, i or 0)
    for i, _, h in pages:
        best[h or ""] = max(best.get(h or "", None), i, key=nulls_first)
    want = Counter()
    for h, members in {h: [i for i, _, x in pages if (x or "") == h] for h in best}.items():
        members.remove(best[h])
        code = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        want.update([(best[h], len(h.encode()), code, "response", None)] + [(i, len(h.encode()), code, "revisit", best[h]) for i in members])
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == set(best)
    big = write_warc(df, min_bytes=100)
    assert Counter(r.record_type for r in read_warc(spark, *big, payload=False).collect()) == {"response": len(pages)}
    none = write_warc(df.limit(0))
    assert read_warc(spark, *none).count() == 0


def test_warc_dictionary_and_damage():
    page = lambda i: {"page_id": i, "url": f"http://h/{i}", "html": f"<html><body class='main page'>{i} and {i * i}</body></html>", "kind": "response",
                      "bytes": len(f"<html><body class='main page'>{i} and {i * i}</body></html>"), "copy": 0, "sha": None, "keep_id": None}
    records = [record(page(i), "2024-01-01T00:00:00Z") for i in range(500)]
    data, _ = archive(records)
    assert data[:4] == SKIPPABLE and data[8:12] == bytes.fromhex("37a430ec") and len(data) < sum(map(len, records)) / 3
    assert [raw for _, raw in frames_of(data)] == records
    with pytest.raises(ValueError):
        parse(records[0].replace(b"0 and 0", b"0 and 1"))


# 2 licenses

def test_license_scan(spark, awkward, empty):
    scan = lambda t: Scanner().scan(t.encode())
    r = scan("CC BY NC cc-by-nc, Apache License, Version 2.0 under the MIT license")
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (4, 0, 11, "apache-2,cc-by-nc,mit")
    r = scan("Released undr the MIT licence today")
    assert (r["n_base"], r["first_word"], r["labels"], r["base_labels"]) == (0, None, "mit", "") and 0 < r["score"] < 1
    assert r["spans"][0]["first_word"] == 1 and r["spans"][0]["text"] == "undr the mit licence" and r["spans"][0]["edits"] == 2
    assert scan("under the gpl license, under the mitt licenses")["labels"] == ""
    assert scan("GNU Genral Public License version 3")["labels"] == ""  # a key word must stand unchanged
    assert scan("GNU General Publc License version 3")["labels"] == "gpl-3"
    got = {(r.doc_id, r.n_words, r.labels) for r in scan_licenses(awkward).collect()}
    assert {(3, 0, ""), (4, 0, ""), (12, 5, "mit"), (6, 60_000, "")} <= got and scan_licenses(empty).count() == 0


def test_license_candidates_equal_full_search(spark):
    """Every notice that a slow search over the whole text finds is found from its seeds."""
    import regex
    rng, scanner = random.Random(4), Scanner()
    for notice, pattern in zip(scanner.notices, scanner.patterns):
        for _ in range(15):
            text = list(notice.text)
            for _ in range(rng.randint(0, notice.errors)):
                k = rng.randrange(len(text))
                text[k] = rng.choice(["", "x", text[k] + "q", " "])
            padded = f" some words {' '.join(''.join(text).split())} and more "
            whole = regex.search(pattern, padded)
            words = padded.split()
            if whole and all(k in words for k in notice.keys):
                assert notice.label in {f[0] for f in scanner.fuzzy(padded)}, padded


# 3 exact dedup

def test_exact_dedup(awkward, empty):
    groups = defaultdict(list)
    for d, t in TEXTS:
        groups["".join((t or "").split())].append((len(t or ""), d))
    want = Counter()
    for key, members in groups.items():
        members.sort(key=lambda m: (-m[0], m[1] is None, m[1] or 0))
        sha = hashlib.sha256(key.encode()).hexdigest()
        want.update((d, members[0][1], len(members), i == 0, sha) for i, (_, d) in enumerate(members))
    # U+3000 is no blank here, but str.split takes it
    special = "É é ΣΣ İ 日本　x'll".replace(" ", "")
    sha, old = (hashlib.sha256(x.encode()).hexdigest() for x in (special, special.replace("　", "")))
    want = Counter({(*k[:4], sha if k[4] == old else k[4]): n for k, n in want.items()})
    got = exact_dedup(awkward, runs=5, fan_in=2)
    assert Counter(tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == want
    assert exact_dedup(empty).count() == 0
    kept = drop_copies(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(groups) and drop_copies(empty).count() == 0


# 4 mixing

def poisson(u, mean):
    term = total = np.exp(-mean)
    n = 0
    while u >= total and n < 80:
        n += 1
        term = term * mean / n
        total += term
    return n


def test_mixing_equals_brute_force(awkward, empty):
    weights, rest, epochs = {"src0": 3.0, "src1": 1.0}, 2.0, 30.0
    rows = awkward.collect()
    size = Counter()
    for r in rows:
        size[r.source if r.source in weights else ""] += len((r.text or "").encode()) + 1
    total = sum(size.values())
    goal = {**weights, "": rest}
    mean = {b: goal[b] / sum(goal[x] for x in size) * epochs * total / size[b] for b in size}
    want = Counter()
    for r in rows:
        m = mean[r.source if r.source in weights else ""]
        pieces, name = max(1, int(np.ceil(m / 16))), "" if r.doc_id is None else r.doc_id
        u = lambda k: int(hashlib.md5(f"5|{name}|{k}".encode()).hexdigest()[:13], 16) / 2**52
        want[r.doc_id, r.text] += sum(poisson(u(k), m / pieces) for k in range(1, pieces + 1))
    out = mix_sources(awkward, weights, rest, epochs, seed=5)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == +want and out.columns[: len(awkward.columns)] == awkward.columns
    assert max(mean.values()) > 16 and mix_sources(empty, weights, rest).count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()


def test_mixing_reaches_the_target_shares(spark):
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    got = mix_sources(docs, {"src0": 0.5}, rest=0.5, epochs=4.0).selectExpr("sum(if(source = 'src0', octet_length(text) + 1, 0)) / sum(octet_length(text) + 1) as s")
    assert abs(got.first().s - 0.5) < 0.05


# 5 toxicity

def test_toxicity_on_held_out_labels(spark, awkward, empty):
    folder = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(folder + "/documents.parquet"), spark.read.parquet(folder + "/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    model = train(docs, labels)
    rows = [r for r in score_toxicity(docs, model).collect() if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = sum(r.predicted == truth[r.doc_id] for r in rows)
    assert right / len(rows) > 0.92 and sum(r.predicted for r in rows if truth[r.doc_id]) / sum(truth[r.doc_id] for r in rows) > 0.6
    for r in rows:  # the offending sentences stand where the spans say
        assert all(r.text[s.start : s.start + s.length] == s.text and s.score >= 0.5 for s in r.offending)
    got = score_toxicity(awkward, model)
    assert {r.score for r in got.filter("trim(coalesce(text, '')) = ''").collect()} == {0.0} and got.count() == len(TEXTS)
    assert score_toxicity(empty, model).count() == 0
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (1, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    nothing = train(awkward, odd)
    assert nothing.features == () and drop_toxic(awkward, odd).count() == len(TEXTS)


# 6 token files

def test_crc32c_known_values_and_damage():
    assert crc32c([b"123456789", b"\0" * 32, b"", bytes(range(32))]).tolist() == [0xE3069283, 0x8A9136AA, 0, 0x46DD794E]
    payloads = [os.urandom(n) for n in (1, 2, 3, 4, 5, 100, 4097)]
    data = b"".join(frames(payloads))
    places = np.cumsum([0] + [len(p) + 16 for p in payloads])[:-1].tolist()
    assert unframed(data, places) == payloads
    for at in (places[3] + 2, places[5] + 40):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            unframed(bytes(broken), places)


def test_token_files(spark, awkward, empty):
    folder, files = write_tokens(awkward, VOCABULARY)
    rows = read_tokens(spark, folder, files).orderBy("start").collect()
    library = tokenizers.Tokenizer.from_file(VOCABULARY)
    want = Counter((d, tuple([*library.encode(t or "", add_special_tokens=False).ids, 1])) for d, t in TEXTS)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.token_ids, "<u4").tolist())) for r in rows) == want
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    for r in random.Random(1).sample(rows, 5):  # one record at a time, by its place in the index
        with open(f"{folder.removeprefix('file:')}/{r.file}.tokens", "rb") as file:
            payload = unframed(file.read(), [r.offset])[0]
        assert np.frombuffer(payload, f"<u{payload[0]}", offset=1).tolist() == np.frombuffer(r.token_ids, "<u4").tolist()
    none = write_tokens(empty, VOCABULARY)
    assert read_tokens(spark, *none).count() == 0


# 7 sharding

@pytest.mark.parametrize("shards", [1, 5, 16])
def test_shards_are_even(spark, shards):
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    rows = kd_shards(docs, shards).collect()
    total, largest = Counter(), max(r.size for r in rows)
    for r in rows:
        total[r.shard] += r.size
    assert len(rows) == docs.count() and set(total) == set(range(shards))
    assert max(abs(t - sum(total.values()) / shards) for t in total.values()) <= 1.5 * largest
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.size == len(texts[r.doc_id]) + 1 and r.law == "bytes" for r in rows)


def test_shards_of_awkward_rows(spark, awkward, empty):
    rows = kd_shards(awkward, 4).collect()
    assert len(rows) == len(TEXTS) and {r.size for r in rows if r.doc_id in (3, 4)} == {1} and kd_shards(empty, 4).count() == 0
    hot = spark.range(600).selectExpr("id as doc_id", "'same text' as text", "'s' as source", "cast(null as string) as lang")
    assert {n for n in Counter(r.shard for r in kd_shards(hot, 4).collect()).values() if abs(n - 150) > 6} == set()
    assert len({r.shard for r in kd_shards(hot, target_bytes=1000).collect()}) == 6


# 8 BPE

def nasty_texts(n):
    rng = random.Random(3)
    parts = ["a", "b", "A", "é", "é", "Σ", "σ", "İ", "ß", "'s", "'S", "'re", "'", "!!!", ".", ",", "x.", " ", "\n", " ", "　", "\x1c", "\x85", "1", "23",
             "½", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "日本", "😀", "‍", "the", "ing", "́", "aaa", "aaaaaaa", "ﬁ", "\x00", "٣"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(n)]


def test_bpe_equals_library():
    bpe, library = WordBpe(VOCABULARY), tokenizers.Tokenizer.from_file(VOCABULARY)
    texts = [*nasty_texts(3000), LONG[:50_000], "x" * 30_000]
    for text, ids, want in zip(texts, bpe.encode([t.encode() for t in texts]), library.encode_batch(texts, add_special_tokens=False)):
        got = np.frombuffer(ids, "<u4").tolist()
        assert got == want.ids and bpe.decode(ids) == library.decode(got, skip_special_tokens=False)


def test_bpe_of_awkward_rows(awkward, empty):
    library = tokenizers.Tokenizer.from_file(VOCABULARY)
    rows = decode_tokens(encode_texts(awkward, VOCABULARY), VOCABULARY).collect()
    want = Counter((d, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for d, t in TEXTS)
    assert Counter((r.doc_id, r.decoded) for r in rows) == want
    assert decode_tokens(encode_texts(empty, VOCABULARY), VOCABULARY).count() == 0


# 9 repetition

def slow_measures(text, least):
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.encode().split()]
    n, marks = len(words), set()
    windows = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    for i in range(n - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            marks |= {i, i + 1, i + 2}
    best, covered = [0] * n, set()
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            best[i] = max(best[i], k)
        if best[i] >= least:
            covered |= set(range(i, i + best[i]))
    return (n, sum(len(w.decode()) for w in words), sum(text.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(marks), len(covered), max(best, default=0))


def test_repetition_equals_brute_force():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab \n#é\t"), rng.integers(0, 60))) for _ in range(200)] + ["", " ", "a", "a a a a a a", "\n\n", "x y z\nx y z"]
    for sub in (texts, texts[:1], [""], [""] * 3, texts[::-1]):
        m = measures([t.encode() for t in sub], 2)
        for i, text in enumerate(sub):
            assert tuple(int(v[i]) for v in m.values()) == slow_measures(text, 2)


def test_repetition_rules(spark, awkward, empty):
    got = {r.doc_id: r for r in repetition_rules(awkward).collect()}
    assert got[3].n_words == 0 and got[3].base_failed and got[6].n_words == 60_000 and not got[6].kept and repetition_rules(empty).count() == 0
    folder = SF.replace("0.001", "0.01")
    good = spark.read.parquet(folder + "/labels.parquet").filter("quality = 1 and toxic = 0").select("doc_id")
    rows = repetition_rules(spark.read.parquet(folder + "/documents.parquet").join(good, "doc_id", "left_semi")).collect()
    assert sum(r.kept for r in rows) / sum(not r.base_failed for r in rows) > 0.97


# 10 n-gram join

def slow_components(rows):
    sets = []
    for _, text in rows:
        w = bytes(text or "", "utf-8").lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    places = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in places[g])
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                up[find(i)] = find(j)
        for g in s:
            places[g].append(i)
    low = {}
    order = lambda d: (d is None, d or 0)
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d, key=order)
    return Counter((d, len(sets[i]), low[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def test_components_equal_brute_force(spark, awkward, empty):
    rng, rows = random.Random(2), []
    vocabulary = [f"w{i}" for i in range(60)]
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([1, 3, 5, 6, 9, 20, 60, 120]))
        for _ in range(rng.randint(1, 9)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(text) + 1)
                text[k : k + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 1)) if len(text) > 1 else []
            rows.append((len(rows), " ".join(text).upper() if rng.random() < 0.2 else "\n ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(tuple(r) for r in ngram_components(df).collect()) == slow_components(rows)
    got = Counter(tuple(r) for r in ngram_components(awkward).collect())
    assert got == slow_components(TEXTS) and ngram_components(empty).count() == 0


def test_components_of_documents(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    got = Counter(tuple(r) for r in L.QUERIES["op10_ngram_join"](spark, SF).collect())
    assert got == slow_components([(r.doc_id, r.text) for r in docs.collect()])


def test_components_are_contracted(spark, monkeypatch):
    """Labels of a shuffled chain, and few rows in all the tables that are written on the way."""
    from ledgerline.llm import ngram_join
    from ledgerline.operators import components

    rows, stored = [], ngram_join.stored

    def counted(df, name="step"):
        df = stored(df, name)
        rows.append(df.count())
        return df

    for module in (ngram_join, components):
        monkeypatch.setattr(module, "stored", counted)
    names = [hashlib.md5(bytes(f"{i}", "ascii")).digest() for i in range(2_000)]
    chains = [list(zip(part, part[1:])) for part in (names[:1_500], names[1_500:])]
    got = ngram_join.components(spark.createDataFrame(chains[0] + chains[1], "a binary, b binary").repartition(3)).collect()
    assert {bytes(r.id): bytes(r.label) for r in got} == {n: min(part) for part in (names[:1_500], names[1_500:]) for n in part}
    assert sum(rows) <= 9 * len(names)  # labels for every node in each round: over 13 of them


def test_components_of_divided_groups(spark, monkeypatch):
    """Groups of sets just above and below the threshold, divided into many blocks."""
    from ledgerline.llm import ngram_join

    rng, rows = random.Random(5), []
    for base in range(3):
        words = [f"b{base}w{i}" for i in range(120)]
        for _ in range(60):
            text = list(words)
            for k in rng.sample(range(120), rng.choice([1, 2, 3, 4, 5])):
                text[k] = f"x{rng.randrange(40)}"
            rows.append((len(rows), " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(ngram_join, "BLOCK", 12_000)
    monkeypatch.setattr(ngram_join, "PILOTS", 2)
    assert Counter(tuple(r) for r in ngram_components(df).collect()) == slow_components(rows)


def test_tree_joins_what_links():
    from ledgerline.llm.ngram_join import joining

    rng = random.Random(8)
    for many in (2, 3, 40, 150):
        pool = [rng.randrange(1 << 40) for _ in range(60)]
        sets = {frozenset(rng.sample(pool, rng.randint(40, 60))) for _ in range(many)} | {frozenset([k]) for k in pool[:3]}
        sets = [np.array(sorted(s), "<u8").tobytes() for s in sets]
        rows = [(b"%d" % i, b"%d" % i, 2, g) for i, g in enumerate(sets)]
        up = {r[0]: r[0] for r in rows}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        edges = joining(rows)
        for a, b in edges:
            assert find(a) != find(b)  # joining edges only
            up[find(a)] = find(b)
        held = [set(np.frombuffer(g, "<u8").tolist()) for g in sets]
        for i, a in enumerate(held):
            for j, b in enumerate(held[:i]):
                if 100 * len(a & b) >= 75 * len(a | b):
                    assert find(rows[i][0]) == find(rows[j][0])
        for a, b in edges:
            x, y = held[int(a)], held[int(b)]
            assert 100 * len(x & y) >= 75 * len(x | y)


# pipeline

def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    library = tokenizers.Tokenizer.from_file(VOCABULARY)
    kept = {n: None for n, _ in corpus_pipeline.STAGES}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "mixing", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "test-stage")
        after = docs.collect()
        kept[name] = len(after)
        if name == "toxicity":
            model = train(spark.read.parquet(SF + "/documents.parquet"), spark.read.parquet(SF + "/labels.parquet"))
            bad = {r.doc_id for r in score_toxicity(spark.read.parquet(SF + "/documents.parquet"), model).collect() if r.predicted}
            assert {r.doc_id for r in after} == {r.doc_id for r in before} - bad and set(after) <= set(before)
        elif name == "exact_dedup":
            best = {}
            for r in sorted(before, key=lambda r: (-len(r.text), r.doc_id)):
                best.setdefault(b"".join(r.text.encode().split()), r)
            assert set(after) == set(best.values()) and len(after) == len(best)
        elif name == "ngram_join":
            heads = {d for d, _, c in slow_components([(r.doc_id, r.text) for r in before]) if d == c}
            assert set(after) == {r for r in before if r.doc_id in heads}
        elif name == "mixing":
            size = Counter()
            for r in before:
                size[r.source if r.source in WEIGHTS else ""] += len(r.text.encode()) + 1
            goal = {**WEIGHTS, "": REST}
            mean = {b: goal[b] / sum(goal[x] for x in size) * EPOCHS * sum(size.values()) / size[b] for b in size}
            want = Counter()
            for r in before:
                u = int(hashlib.md5(f"{SEED}|{r.doc_id}|1".encode()).hexdigest()[:13], 16) / 2**52
                want[r] += poisson(u, mean[r.source if r.source in WEIGHTS else ""])
            assert Counter(after) == +want
        else:
            ids = {r: library.encode(r.text, add_special_tokens=False).ids for r in set(before)}
            text = {r: library.decode(ids[r], skip_special_tokens=False) for r in ids}
            assert Counter((r.doc_id, tuple(np.frombuffer(r.token_ids, "<u4").tolist()), r.decoded_sha256) for r in after) == Counter(
                (r.doc_id, tuple(ids[r]), hashlib.sha256(text[r].encode()).hexdigest()) for r in before)


def test_pipeline_of_awkward_rows(spark, awkward, empty):
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = corpus_pipeline.stored(stage(spark, frame, SF), "test-stage")
        assert frame.columns == ["doc_id", "n_tokens", "token_ids", "decoded_sha256"]
    assert frame.count() == 0


def test_registry():
    assert {int(k[2:].split("_")[0]) for k in L.QUERIES if k.startswith("op")} == set(range(1, 14)) and "pipeline" in L.QUERIES
    assert set(L.ORACLES) <= set(L.QUERIES)


def test_shared_postings_do_not_grow_with_the_tasks(spark):
    """Runs of sizes, gaps between them, copies from other tasks and batches of a few rows, against plain Python."""
    from ledgerline.llm.ngram_join import PERCENT, SHARE, rich, shared

    rng = random.Random(11)
    sets = [(hashlib.md5(b"%d" % i).digest(), rng.choice([4, 5, 6, 7, 20, 24, 26, 40])) for i in range(120)]
    found = sorted({(rng.randrange(30), n, name) for name, n in sets for _ in range(6)})
    keep = set()
    for t in range(30):
        rows = [r for r in found if r[0] == t]
        for a, b in zip(rows, rows[1:]):
            if a[1] * 100 >= b[1] * PERCENT:
                keep |= {a, b}
    many = Counter(r[2] for r in keep)
    few = {r for r in keep if many[r[2]] >= 1 + -(-r[1] * PERCENT // 100) * SHARE // 100}
    assert 0 < len(few) < len(keep) < len(found)
    df = spark.createDataFrame(found + found[::3], "token long, n int, id binary").repartition(5)
    sizes = [spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")]
    try:
        for tasks, batch in (("2", "3"), ("16", "3"), ("1", "1"), ("3", "10000")):
            spark.conf.set("spark.sql.shuffle.partitions", tasks)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            for df_, want in ((shared(df), keep), (rich(shared(df)), few)):
                got = [(r.token, r.n, bytes(r.id)) for r in df_.select("token", "n", "id").collect()]
                assert len(got) == len(want) and set(got) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", sizes[0])
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", sizes[1])
