"""Similarity join of word n-gram sets: a prefix filter deals all sets to groups, prefix trees join the sets of a group.

Two sets link when their Jaccard similarity is `PERCENT` / 100 or more.  The steps, each over all documents:

1. `frequent`: how common n-grams are, counted in 2^28 hash slots; the commonest slots give the global order
   (rare n-grams first).  The order only steers the work: any order finds the same links.  The same pass lists the set of
   each document, so that `catalog` later takes apart only the texts of sets that may link.
2. `postings`: of each distinct set the first n - ceil(0.75 n) + k n-grams in the global order, k a tenth of n.  Linked
   sets share as many of them as the smaller k.  So `shared` and `rich` leave out sets with too few n-grams that any
   other set has.
3. `bridges`: per n-gram, an edge from the smallest set of each run of compatible sizes to every other set of the run.
   Linked sets are in one component of these edges, a group.  The edges are as many as the postings at most.
4. `joined`: a task holds the sets of a group in one prefix tree and walks it with many of them at a time.  It keeps
   what is joined already and returns joining edges only, fewer than it has sets.
5. A group too large for one task is dealt to blocks, each with the same few pilots of the group; `across` then compares
   block with block, but for what is already in the largest component of its group.
6. `components` of the edges, by contraction, and the smallest identifier in each.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.components import components as contracted
from ..session import stored
from .common import U, WordHashes, chunks, coded, mapped, mix, texts

#: Words in an n-gram, and the least Jaccard similarity of a link in percent.
WORDS, PERCENT = 5, 75
#: Bits of the slots in which n-grams are counted, and of their upper part that deals them to tasks.
SLOT_BITS, PART_BITS = 28, 12
#: A slot is called frequent from this count on; so many of the most frequent ones go to all tasks (12 bytes each).
FREQUENT, MOST = 16, 1 << 18
#: N-grams that one task counts before it sends them on, and sets or edges that it remembers in order not to repeat them.
FLUSH, REMEMBERED = 4_000_000, 500_000
#: N-grams of its prefix that a set shares with a partner, at least: one and this percentage of its size.  More of them
#: make longer prefixes and leave out more sets; rounds in which sets are left out.  A second round leaves out about 1 % more and
#: moves all postings twice.
SHARE, ROUNDS = 10, 1
#: Bytes of the sets in one prefix tree (8 for an n-gram and OWN for a set), and about how many pilots a divided group has.
BLOCK, OWN, PILOTS = 4 << 20, 512, 32
#: Trees' worth of sets in each of two blocks that are compared: a set moves once for every block, so few large ones move less.
WIDE = 2
#: N-grams of a tree's edges that are compared in one step, and pairs of probe and path that are walked together.
PIECE, PAIRS = 16, 200_000

#: The 24 bits that stand for a set and for a document in the filters of fixed size.
SET_BIT = "cast(conv(hex(substring(id, 1, 3)), 16, 10) as int)"
DOC_BIT = "cast(pmod(xxhash64(doc_id), 16777216) as int)"

_FACTORS = mix(np.arange(1, WORDS + 2, dtype=U) * U(0xD1342543DE82EF95)) | U(1)


def ngram_sets(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit n-gram hashes of each text in ascending order, and where each text's end."""
    lists = [v.lower().split() for v in values]  # A-Z only: the bytes of other letters stay
    words, counts = coded(lists, WordHashes(), U), np.array([len(w) for w in lists], np.int64)
    n, total = len(words), np.cumsum(counts)
    left = np.repeat(total, counts) - np.arange(n)
    grams = np.minimum(left, WORDS).astype(U) * _FACTORS[WORDS]
    for k in range(WORDS):
        shifted = np.zeros(n, U)
        shifted[: max(0, n - k)] = words[k:]
        grams += np.where(left > k, shifted, U(0)) * _FACTORS[k]
    grams = mix(grams)
    whole = left >= WORDS  # a window of full length, or all of a shorter text
    first = total - counts
    whole[first[(counts > 0) & (counts < WORDS)]] = True
    taken = np.zeros(len(values) + 1, np.int64)
    taken[1:] = np.cumsum(whole)[total - 1] * (total > 0) if n else 0
    grams = grams[whole]
    out = [np.unique(grams[a:b]) for a, b in zip(taken[:-1].tolist(), taken[1:].tolist())]
    sizes = np.cumsum([len(o) for o in out])
    return (np.concatenate(out) if out else np.zeros(0, U)), sizes


def signatures(grams: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """128 bits that stand for each set; none for an empty set."""
    out, at = [], 0
    for end in sizes.tolist():
        out.append(xxhash.xxh3_128_digest(grams[at:end].tobytes()) if end > at else None)
        at = end
    return out


class Remembered(set):
    """Keys seen lately: `new` tells whether a key is not among them.  Bounded, so an old key may count as new again."""

    def new(self, key) -> bool:
        if key in self:
            return False
        if len(self) >= REMEMBERED:
            self.clear()
        self.add(key)
        return True


def frequent(docs: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame]:
    """The most frequent slots in ascending order and their counts over all documents, at most MOST of them; and doc_id,
    n_shingles and id (of the set) of every document, which pass through the same shuffle as rows without slots."""
    low = SLOT_BITS - PART_BITS
    counts_of, rows_of = "part int, slots binary, counts binary", "doc_id long, n_shingles long, id binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send():
            slots, counts = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(slots >> low, np.arange((1 << PART_BITS) + 1))
            parts = np.flatnonzero(np.diff(cuts))
            lows, tops = (slots & ((1 << low) - 1)).astype("<u2"), np.minimum(counts, 65535).astype("<u2")
            return pa.RecordBatch.from_pydict({
                "part": pa.array(parts, pa.int32()), "slots": pa.array([lows[cuts[p] : cuts[p + 1]].tobytes() for p in parts], pa.binary()),
                "counts": pa.array([tops[cuts[p] : cuts[p + 1]].tobytes() for p in parts], pa.binary()),
                **{name: pa.nulls(len(parts), kind) for name, kind in (("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("id", pa.binary()))}})

        seen, turn = Remembered(), 0
        for batch in chunks(batches):
            grams, sizes = ngram_sets(texts(batch))
            ids, n = signatures(grams, sizes), batch.num_rows
            yield pa.RecordBatch.from_pydict({
                "part": pa.array((np.arange(n) + turn) % (1 << PART_BITS), pa.int32()), "slots": pa.nulls(n, pa.binary()), "counts": pa.nulls(n, pa.binary()),
                "doc_id": batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()),
                "n_shingles": pa.array(np.diff(sizes, prepend=0), pa.int64()), "id": pa.array(ids, pa.binary())})
            turn += n
            fresh = np.array([s is not None and seen.new(s) for s in ids], bool)  # of equal sets one counts
            held.append((grams[np.repeat(fresh, np.diff(sizes, prepend=0))] >> U(64 - SLOT_BITS)).astype(np.uint32))
            size += len(held[-1])
            if size >= FLUSH:
                yield send()
                held, size = [], 0
        if size:
            yield send()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums = None, np.zeros(1 << low, np.int64)

        def result():
            at = np.flatnonzero(sums >= FREQUENT)
            return pa.RecordBatch.from_pydict({
                "slot": pa.array(at + (part << low), pa.int64()), "count": pa.array(sums[at], pa.int64()), "doc_id": pa.nulls(len(at), pa.int64()),
                "n_shingles": pa.nulls(len(at), pa.int64()), "id": pa.nulls(len(at), pa.binary())})

        for batch in batches:
            rows = batch.filter(batch.column(1).is_null())
            if rows.num_rows:
                none = pa.nulls(rows.num_rows, pa.int64())
                yield pa.RecordBatch.from_pydict({
                    "slot": none, "count": none, "doc_id": rows.column(3), "n_shingles": rows.column(4), "id": rows.column(5).cast(pa.binary())})
            batch = batch.filter(batch.column(1).is_valid())
            for p, s, c in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if p != part:
                    if part is not None:
                        yield result()
                    part, sums = p, np.zeros(1 << low, np.int64)
                sums[np.frombuffer(s, "<u2")] += np.frombuffer(c, "<u2")
        if part is not None:
            yield result()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = mapped(docs.select("doc_id", "text"), count, f"{counts_of}, {rows_of}")
    sums = stored(mapped(counted.repartition(n, "part").sortWithinPartitions("part"), add, f"slot long, count long, {rows_of}"), "slots")
    top = sums.filter("slot is not null").select("slot", "count").orderBy(F.desc("count"), "slot").limit(MOST).toPandas().sort_values("slot")
    order = top["slot"].to_numpy(np.int64), top["count"].to_numpy(np.int64)
    return order, sums.filter("n_shingles is not null").select("doc_id", "n_shingles", "id")


def in_order(grams: np.ndarray, sizes: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
    """Each set in the global order: by count of a frequent slot, then by hash."""
    own = (grams >> U(64 - SLOT_BITS)).astype(np.int64)
    rank = np.zeros(len(grams), np.int64)
    if len(slots):
        at = np.minimum(np.searchsorted(slots, own), len(slots) - 1)
        rank = np.where(slots[at] == own, counts[at], 0)
    begin = 0
    for end in sizes.tolist():
        r = rank[begin:end]
        yield grams[begin:end][np.argsort(r, kind="stable")] if r.any() else grams[begin:end]
        begin = end


def postings(docs: DataFrame, order) -> DataFrame:
    """token, n, id for the prefix of every distinct set of a task; a set that comes back much later is sent again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (slots, counts), seen = order.value, Remembered()
        for batch in chunks(batches):
            grams, sizes = ngram_sets(texts(batch))
            tokens, ids, ns, places = [], [], [], []
            for s, own in zip(signatures(grams, sizes), in_order(grams, sizes, slots, counts)):
                if s is not None and seen.new(s):
                    n = len(own)
                    tokens.append(own[: n - -(-n * PERCENT // 100) + 1 + n * SHARE // 100])
                    ids.append(s)
                    ns.append(n)
                    places.append(len(tokens[-1]))
            if ids:
                at = np.repeat(np.arange(len(ids)), places)
                yield pa.RecordBatch.from_pydict({
                    "token": pa.array(np.concatenate(tokens).view(np.int64)), "n": pa.array(np.array(ns, np.int32)[at]),
                    "id": pa.array(ids, pa.binary()).take(pa.array(at))})

    return mapped(docs.select("text"), run, "token long, n int, id binary")


def by_token(found: DataFrame) -> DataFrame:
    """The postings of an n-gram in one task, in order of size."""
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(n, "token").sortWithinPartitions("token", "n", "id")


def numbers(ids: pa.Array) -> np.ndarray:
    """Identifiers of 128 bits as two numbers each."""
    ids = ids.cast(pa.binary())
    first = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset]
    return np.frombuffer(ids.buffers()[2], np.uint8)[first : first + 16 * len(ids)].view(U).reshape(-1, 2)


def together(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def shared(found: DataFrame) -> DataFrame:
    """The postings whose n-gram another set of the same run has.

    The sets of an n-gram stream by in order of size.  Where the next size is too large for a link with the one before, a
    new run begins: no link crosses the gap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, linked = [], False  # the last posting, and whether it is in a run with the one before it
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = together([*held, batch])
            token, ids = batch.column(0).to_numpy(), numbers(batch.column(2))
            fresh = np.ones(len(token), bool)  # not a copy from another task
            fresh[1:] = (token[1:] != token[:-1]) | (ids[1:] != ids[:-1]).any(axis=1)
            at = np.flatnonzero(fresh)
            n, token = batch.column(1).to_numpy()[at].astype(np.int64), token[at]
            near = np.zeros(len(at) + 1, bool)  # of each with the one before it
            near[0] = linked
            near[1:-1] = (token[1:] == token[:-1]) & (n[:-1] * 100 >= n[1:] * PERCENT)
            last = int(at[-1])
            held, linked = [batch.slice(last, 1)], bool(near[len(at) - 1])
            out = at[:-1][near[: len(at) - 1] | near[1 : len(at)]]
            if len(out):
                yield batch.take(pa.array(out))
        if linked:
            yield held[0]

    return mapped(by_token(found), run, "token long, n int, id binary")


def rich(found: DataFrame) -> DataFrame:
    """Those of the postings whose sets share enough n-grams with others for a link.

    A set's postings come together in one task, at most its prefix."""

    def chosen(rows: pa.RecordBatch) -> pa.RecordBatch:
        ids, n = numbers(rows.column(2)), rows.column(1).to_numpy().astype(np.int64)
        first = np.ones(len(n), bool)
        first[1:] = (ids[1:] != ids[:-1]).any(axis=1)
        many = np.diff(np.append(np.flatnonzero(first), len(n)))
        enough = 1 + -(-n[first] * PERCENT // 100) * SHARE // 100  # a partner may have 0.75 n
        return rows.take(pa.array(np.flatnonzero(np.repeat(many >= enough, many))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None  # the postings of the last set, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = numbers(batch.column(2))
            if key is not None and (ids[-1] != key).any():
                whole = together([*held, batch])
                ids = numbers(whole.column(2))
                begin = len(ids) - int(np.argmax((ids != ids[-1]).any(axis=1)[::-1]))
                yield chosen(whole.slice(0, begin))
                held = [whole.slice(begin)]
            else:
                held.append(batch)
                if (ids[0] != ids[-1]).any():  # the first batch
                    begin = len(ids) - int(np.argmax((ids != ids[-1]).any(axis=1)[::-1]))
                    yield chosen(batch.slice(0, begin))
                    held = [batch.slice(begin)]
            key = ids[-1].copy()
        if held:
            yield chosen(together(held))

    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mapped(found.repartition(n, "id").sortWithinPartitions("id"), run, "token long, n int, id binary")


def bridges(found: DataFrame) -> DataFrame:
    """Edges a, b between sets that have an n-gram of their prefixes in common.

    The first set of a run (see `shared`) is joined with each of the others, and linked sets of one n-gram are always in
    one run.  Nothing but the first and the last row of the run is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, size, first, last, sent = None, 0, None, None, Remembered()
        for batch in batches:
            a, b = [], []
            for t, n, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if t != token or size * 100 < n * PERCENT:
                    token, first = t, s
                elif s != last and s != first and sent.new((first, s)):
                    a.append(first)
                    b.append(s)
                size, last = n, s
            if a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return mapped(by_token(found), run, "a binary, b binary").distinct()


def catalog(docs: DataFrame, picked, wanted, order) -> DataFrame:
    """id, n and grams (binary, in the global order) of the documents whose bit is set in `picked`, for sets whose bit is set in
    `wanted`; about one document per task and set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (slots, counts), bits, some, sent = order.value, wanted.value, picked.value, Remembered()
        for whole in batches:
            at = whole.column(0).to_numpy()
            for batch in chunks(iter([whole.filter(pa.array(some[at >> 3] >> (at & 7) & 1 > 0))])):
                grams, sizes = ngram_sets(texts(batch))
                names, sets = [], []
                for s, own in zip(signatures(grams, sizes), in_order(grams, sizes, slots, counts)):
                    at = int.from_bytes(s[:3], "big") if s is not None else 0
                    if s is not None and bits[at >> 3] >> (at & 7) & 1 and sent.new(s):
                        names.append(s)
                        sets.append(own.tobytes())
                if names:
                    yield pa.RecordBatch.from_pydict({
                        "id": pa.array(names, pa.binary()), "n": pa.array([len(g) // 8 for g in sets], pa.int64()), "grams": pa.array(sets, pa.binary())})

    return mapped(docs.selectExpr(f"{DOC_BIT} as at", "text"), run, "id binary, n long, grams binary")


def bitmap(rows: DataFrame, at: str) -> np.ndarray:
    """A filter of fixed size (2 MB) for the rows' numbers `at` of 24 bits; it may let others pass, never the reverse."""
    rows = rows.selectExpr(f"{at} as at").selectExpr("at >> 3 as byte", "cast(1 << (at & 7) as int) as bit")
    got = rows.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most 2^21 rows
    out = np.zeros(1 << 21, np.uint8)
    out[got["byte"].to_numpy(np.int64)] = got["bits"].to_numpy(np.uint8)
    return out


class PrefixTree:
    """Sets in the global order as paths of a tree; an edge holds up to PIECE n-grams.

    Paths are sorted, so a node is a range of paths; at each level `starts` gives the first path of every path's node."""

    def __init__(self, paths: list[bytes]):
        grams = [np.frombuffer(p, "<u8") for p in paths]
        self.sizes = np.array([len(g) for g in grams], np.int64)
        self.common = np.zeros(len(paths), np.int64)  # with the path before
        for i in range(1, len(paths)):
            m = min(len(grams[i]), len(grams[i - 1]))
            other = grams[i][:m] != grams[i - 1][:m]
            first = int(other.argmax())
            self.common[i] = first if other[first] else m
        known, codes = np.unique(np.concatenate(grams), return_inverse=True)
        self.codes, self.none = codes.astype(np.int32), len(known)
        self.begin = np.cumsum(self.sizes) - self.sizes
        pieces = -(-self.sizes // PIECE)
        self.first = np.cumsum(pieces) - pieces
        self.edges = np.full((int(pieces.sum()), PIECE), self.none, np.int32)
        path = np.repeat(np.arange(len(paths)), self.sizes)
        place = np.arange(len(codes)) - self.begin[path]
        self.edges[self.first[path] + place // PIECE, place % PIECE] = self.codes

    def starts(self, level: int) -> np.ndarray:
        return np.maximum.accumulate(np.where(self.common < PIECE * (level + 1), np.arange(len(self.sizes)), 0))

    def linked(self, probes: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the probes (numbers of paths) link with which paths, of those that `open_` (probes x paths) asks for.

        All probes go down together.  An edge is compared once for all paths below it; a path is left, and a subtree with
        the last of its paths, as soon as more n-grams are missing than its size and the probe's allow."""
        has = np.zeros((len(probes), self.none + 1), bool)
        for k, p in enumerate(probes.tolist()):
            has[k, self.codes[self.begin[p] : self.begin[p] + self.sizes[p]]] = True
        mine = self.sizes[probes][:, None]
        fit = open_ & (np.minimum(mine, self.sizes) * 100 >= np.maximum(mine, self.sizes) * PERCENT)
        probe, path = np.nonzero(fit)
        spare = self.sizes[path] - -(-(self.sizes[path] + mine[probe, 0]) * PERCENT // (100 + PERCENT))
        found, level = [], 0
        while len(probe):
            node = self.starts(level)[path]
            fresh = np.ones(len(probe), bool)
            fresh[1:] = (probe[1:] != probe[:-1]) | (node[1:] != node[:-1])
            asked = np.flatnonzero(fresh)
            hits = has[probe[asked][:, None], self.edges[self.first[path[asked]] + level]].sum(axis=1)
            left = self.sizes[path] - level * PIECE
            spare = spare - np.minimum(left, PIECE) + hits[np.cumsum(fresh) - 1]
            alive = spare >= 0
            ended = alive & (left <= PIECE)
            found.append(np.stack([probes[probe[ended]], path[ended]]))
            alive &= ~ended
            probe, path, spare, level = probe[alive], path[alive], spare[alive], level + 1
        out = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return out[0], out[1]


def joining(rows: list[tuple[bytes, bytes, int, bytes]]) -> list[tuple[bytes, bytes]]:
    """Edges that join the sets (id, sure, side, grams) which link, as far as they are not joined already.

    Sets with equal `sure` are joined.  Side 2 is compared with all, sides 0 and 1 with each other."""
    rows = sorted(rows, key=lambda r: r[3])
    if len(rows) < 2:
        return []
    ids = [r[0] for r in rows]
    number: dict[bytes, int] = {}
    group = np.array([number.setdefault(r[1], len(number)) for r in rows], np.int64)
    side, all_paths = np.array([r[2] for r in rows]), np.arange(len(rows))
    if (group == group[0]).all():
        return []
    tree, edges, at, many = PrefixTree([r[3] for r in rows]), [], 0, 1
    most = max(1, min(256, PAIRS // len(rows), (32 << 20) // (tree.none + 1)))
    if len(rows) <= 16:
        many = len(rows)
    while at < len(rows) - 1:
        probes = all_paths[at : at + min(many, most)]
        ask = (all_paths > probes[:, None]) & (group != group[probes][:, None])
        ask &= (side != side[probes][:, None]) | (side == 2)
        for a, b in zip(*(x.tolist() for x in tree.linked(probes, ask))):
            if group[a] != group[b]:
                edges.append((ids[a], ids[b]))
                group[group == group[b]] = group[a]
        if (group == group[0]).all():
            break
        at, many = at + len(probes), many * 4
    return edges


def joined(rows: DataFrame) -> DataFrame:
    """Joining edges a, b of the rows (label, block, id, sure, side, grams) of each label and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, edges = None, [], []

        def send():
            return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in edges], pa.binary()), "b": pa.array([b for _, b in edges], pa.binary())})

        for batch in batches:
            columns = [batch.column(i) for i in range(6)]
            for k in range(batch.num_rows):
                label, block, name, sure, side, grams = (c[k].as_py() for c in columns)
                if (label, block) != key:
                    edges += joining(held)
                    key, held = (label, block), []
                held.append((name, sure, side, grams))
            if edges:
                yield send()
                edges = []
        edges += joining(held)
        if edges:
            yield send()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("label", "block", "id", "sure", "side", "grams").repartition(n, "label", "block")
    return mapped(dealt.sortWithinPartitions("label", "block", "id"), run, "a binary, b binary")


def blocks(weight: str, trees: int = 1):
    """How many blocks of so many trees sets of this weight fill."""
    return F.ceil(F.col(weight) / (BLOCK * trees)).cast("int")


def across(held: DataFrame, large: DataFrame, edges: DataFrame) -> DataFrame:
    """Joining edges between the blocks of the groups in `large`: sets outside the largest component of their group
    against one another and against that component, block by block."""
    sure = components(edges).select(F.col("id").alias("x"), F.col("label").alias("sure"))
    rows = stored(held.join(F.broadcast(large.select("label")), "label").join(sure, F.col("id") == F.col("x"), "left").select(
        "label", "id", F.coalesce("sure", "id").alias("sure"), "weight", "grams"), "divided")
    parts = rows.groupBy("label", "sure").agg(F.sum("weight").alias("weight"))
    main = parts.groupBy("label").agg(F.max_by("sure", F.struct("weight", "sure")).alias("main"), F.max("weight").alias("d"), F.sum("weight").alias("all"))
    main = main.withColumn("rest", F.col("all") - F.col("d")).filter("rest > 0").select(
        "label", "main", blocks("d", WIDE).alias("kd"), blocks("rest", WIDE).alias("km"))
    own = rows.join(F.broadcast(main), "label").withColumn("minor", F.expr("sure != main")).withColumn(
        "b", F.expr("if(minor, pmod(xxhash64(id), km), km + pmod(xxhash64(id), kd))"))
    # a small block meets every block, a block of the largest component the small ones
    met = own.withColumn("c", F.explode(F.expr("sequence(0, if(minor, km + kd, km) - 1)")))
    return joined(met.selectExpr(
        "label", "cast(least(b, c) as long) * (km + kd) + greatest(b, c) as block", "id", "sure",
        "case when b = c then 2 when b < c then 0 else 1 end as side", "grams"))


def components(edges: DataFrame) -> DataFrame:
    """id, label: the smallest identifier reachable over the edges (a, b).

    The graph is contracted, so a round joins only the edges that the one before it left."""
    return contracted(edges, []).select(F.col("node").alias("id"), "label")


def ngram_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Reads `doc_id` and `text`; other columns are ignored.  n_shingles is the number of distinct n-grams of five words (of
    a text with fewer words one: all of them); texts that are null, empty or blank have none and link with
    nothing.  component_id is the smallest doc_id reachable over links, the document itself included; a null doc_id is
    larger than any other.  Rows that repeat a doc_id are documents of their own with the same result where their texts agree.
    An empty table gives an empty result.  N-grams are compared by 64-bit hashes and sets by 128 bits.
    """
    spark: SparkSession = docs.sparkSession
    context = spark.sparkContext
    slots, listed = frequent(docs)
    order = context.broadcast(slots)
    found = postings(docs, order)
    for _ in range(ROUNDS):
        found = rich(shared(found))
    groups = components(stored(bridges(found), "bridges"))

    # of the documents with a wanted set, the one with the smallest doc_id is read again
    picked = listed.join(groups.select("id"), "id", "left_semi").groupBy("id").agg(F.min("doc_id").alias("doc_id"))
    again = catalog(docs, context.broadcast(bitmap(picked, DOC_BIT)), context.broadcast(bitmap(groups, SET_BIT)), order)
    sets = again.groupBy("id").agg(F.max("grams").alias("grams"), F.max("n").alias("n"))
    held = stored(sets.join(groups, "id").select("label", "id", (F.col("n") * 8 + OWN).alias("weight"), "grams"), "held")
    large = held.groupBy("label").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("many")).filter(f"weight > {BLOCK}")
    large = stored(large.select("label", blocks("weight").alias("k"), F.expr(f"greatest(1, many div {PILOTS})").alias("every")), "large")
    pilot, own = F.expr("pmod(xxhash64(id, 1), every) = 0"), F.array(F.expr("cast(pmod(xxhash64(id), k) as int)"))
    # one row per BLOCK of sets at most; a join by label would bring a whole group to one task
    dealt = held.join(F.broadcast(large), "label", "left").withColumn(
        "block", F.explode(F.when(F.col("k").isNull(), F.array(F.lit(0))).when(pilot, F.expr("sequence(0, k - 1)")).otherwise(own)))
    edges = stored(joined(dealt.select("label", F.col("block").cast("long").alias("block"), "id", F.col("id").alias("sure"), F.lit(2).alias("side"), "grams")), "joins")
    if large.limit(1).count():
        edges = edges.unionByName(stored(across(held, large, edges), "joins"))

    links = components(edges)
    heads = listed.filter("id is not null").groupBy("id").agg(F.min("doc_id").alias("low"))
    heads = stored(heads.join(links, "id", "left").select("id", "low", F.coalesce("label", "id").alias("label")), "heads")
    lowest = heads.groupBy("label").agg(F.min("low").alias("component_id"))
    heads = heads.join(lowest, "label").select("id", "component_id")
    return listed.select("doc_id", "n_shingles", "id").join(heads, "id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each component, with all columns.

    A document without words is a group of its own.  Rows that repeat this doc_id stay together; exact
    deduplication before this step leaves one of them."""
    names = docs.columns
    heads = ngram_components(docs).filter("doc_id <=> component_id").select(F.col("doc_id").alias("__head")).distinct()
    return docs.join(heads, F.col("doc_id").eqNullSafe(F.col("__head")), "left_semi").select(*names)
