"""Best-fit packing of token sequences by exact complements.

All that packing needs to know of the documents is how many pieces there are of each length: at most `capacity` numbers,
however large the table is.  `plan` turns them into patterns (lengths of one sequence, and how often the pattern is
used).  Spark encodes, counts, ranks the pieces of each length, and gives each rank its place in a pattern.
"""

import json
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..session import stored
from .bpe import byte_letters
from .common import chunks, mapped

#: Fixed value: the splitter of byte-level vocabularies of this kind.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bits for the rank of a piece among those of its length.
RANK_BITS = 44

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def byte_level(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers file, where ids follow the order of merges."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec["pre_tokenizer"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    plain = split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and spec["normalizer"] is None
    if model["type"] != "BPE" or not plain or made != sorted(made):
        raise ValueError("the file must hold a byte-level BPE whose ids follow its merges")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    code = {letter: byte for byte, letter in enumerate(byte_letters())}
    ranks = {bytes([code[c] for c in token]): i for token, i in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


class Stock:
    """How many pieces of each length are left, with an index of the sums of two lengths."""

    def __init__(self, counts: np.ndarray):
        self.left = np.asarray(counts, np.int64).copy()
        self.capacity = len(self.left) - 1
        self.left[0] = 0
        self.singles = np.zeros(len(self.left), bool)
        self.pairs = np.zeros(len(self.left), np.int64)  # of each sum: number of {a, b} that are there
        self.doubles = np.zeros(len(self.left), bool)
        for length in np.flatnonzero(self.left):
            self._note(int(length))

    def _note(self, length: int) -> None:
        """Keep the index in step with `left[length]`."""
        there, twice = self.left[length] > 0, self.left[length] > 1
        if there != self.singles[length]:
            self.singles[length] = False
            others = np.flatnonzero(self.singles[: max(0, self.capacity - length + 1)])
            self.pairs[others + length] += 1 if there else -1
            self.singles[length] = there
        if twice != self.doubles[length]:
            self.doubles[length] = twice
            if 2 * length <= self.capacity:
                self.pairs[2 * length] += 1 if twice else -1

    def take(self, length: int, times: int = 1) -> None:
        self.left[length] -= times
        self._note(length)

    def pair(self, total: int) -> tuple[int, int] | None:
        """The pair of this sum with the greatest length."""
        if total < 2 or not self.pairs[total]:
            return None
        more = np.arange(total - 1, (total - 1) // 2, -1)
        fits = self.singles[more] & self.singles[total - more] & ((2 * more != total) | self.doubles[more])
        a = int(more[fits.argmax()])
        return a, total - a

    def exact(self, gap: int, most: int = 3) -> tuple[int, ...] | None:
        """Up to `most` (three) lengths of this sum that are there, the fewest and then the greatest first."""
        if self.singles[gap]:
            return (gap,)
        if most > 1 and (pair := self.pair(gap)):
            return pair
        if most < 3:
            return None
        firsts = np.arange(gap - 2, 0, -1)
        for a in firsts[self.singles[firsts] & (self.pairs[gap - firsts] > 0)].tolist():
            self.take(a)
            pair = self.pair(gap - a)
            self.take(a, -1)
            if pair:
                return a, *pair
        return None

    def largest(self, limit: int) -> int:
        """The greatest length up to the limit, 0 if there is none."""
        there = np.flatnonzero(self.singles[: limit + 1])
        return int(there[-1]) if len(there) else 0


def plan(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """(lengths, times): sequences of at most len(counts) - 1 tokens that use counts[l] pieces of each length l.

    The plan with the fewest sequences of three: closing gaps with up to three, two or one pieces.  The more pieces a
    complement may have, the more gaps close, but the sooner the short pieces are used up; in small tables that can matter."""
    return min((closed(counts, most) for most in (3, 2, 1)), key=lambda patterns: sum(times for _, times in patterns))


def closed(counts: np.ndarray, most: int) -> list[tuple[list[int], int]]:
    """The longest piece that is left opens a sequence.  Its gap is closed exactly by up to `most` pieces if it can be; else
    the piece that fits best goes in and the rest of the gap is looked up again.  A pattern is used as often as its pieces
    last, so the number of steps depends on the number of lengths, not of pieces."""
    stock, out = Stock(counts), []
    while opening := stock.largest(stock.capacity):
        items, gap = [opening], stock.capacity - opening
        stock.take(opening)
        while gap:
            more = stock.exact(gap, most)
            if more is None:
                best = stock.largest(gap)
                if not best:
                    break
                more = (best,)
            for length in more:
                stock.take(length)
                gap -= length
            items += more
        need = Counter(items)
        again = min(int(stock.left[length]) // n for length, n in need.items())
        if again:
            for length, n in need.items():
                stock.take(length, n * again)
        out.append((items, 1 + again))
    return out


def slots(patterns: list[tuple[list[int], int]], capacity: int) -> np.ndarray:
    """Rows (length, first rank, pieces per sequence, first sequence, first offset), by length and rank."""
    used, sequence, rows = [0] * (capacity + 1), 0, []
    for items, times in patterns:
        offset = 0
        for length, n in Counter(items).items():
            rows.append((length, used[length], n, sequence, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def encoded_pieces(docs: DataFrame, path: str, end_id: int, capacity: int, ids: bool) -> DataFrame:
    """PIECES of every document, the task that made them and the place of each among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, part, seen = byte_level(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4")
        for batch in chunks(batches):
            values = batch.column(1).to_pylist()
            tokens = [np.append(encoding.encode_to_numpy(v or "", allowed_special="all"), end).astype("<u4") for v in values]
            sizes = np.array([len(t) for t in tokens], np.int64)
            many = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            first = sizes - (many - 1) * capacity  # the first piece may be shorter
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[row], capacity)
            raw = [tokens[r][a : a + n].tobytes() for r, a, n in zip(row.tolist(), start.tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            heads = np.append(True, length[order][1:] != length[order][:-1])[: len(order)]
            nth = np.empty(len(order), np.int64)
            nth[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(heads, np.arange(len(order)), 0))
            nth += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            out = {"doc_id": batch.column(0).cast(pa.int64()).take(pa.array(row)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start),
                   "length": pa.array(length), "ids_crc32": pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                   "part": pa.array(np.full(len(row), part, np.int32)), "nth": pa.array(nth)}
            yield pa.RecordBatch.from_pydict(out | ({"token_ids": pa.array(raw, pa.binary())} if ids else {}))

    return mapped(docs.select("doc_id", "text"), run, f"{PIECES}, part int, nth long" + (", token_ids binary" if ids else ""))


def pack(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 1024, ids: bool = False) -> DataFrame:
    """Every whole document as pieces in sequences of at most `capacity` tokens: PIECES, sequence_id, offset, and token_ids
    (little-endian unsigned 32-bit integers) with `ids`.

    Reads `doc_id` and `text`; other columns are ignored.  `path` is a byte-level vocabulary file that every executor has.  A
    document is its tokens and `end_id`; null and empty texts are `end_id` alone.  Only documents of more than `capacity`
    tokens are cut, and only their first piece may be shorter.  Offsets of a sequence have no gaps.  Repeated rows and
    null doc_ids are documents of their own; an empty table gives an empty result.  The driver sees the number of pieces of
    each length and the patterns, both bounded by `capacity`.
    """
    pieces = stored(encoded_pieces(docs, path, end_id, capacity, ids), "pieces")
    counts = stored(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("many")), "lengths")
    totals = np.zeros(capacity + 1, np.int64)
    for length, many in counts.groupBy("length").agg(F.sum("many")).collect():  # at most `capacity` rows
        totals[length] = many
    places = slots(plan(totals), capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, per, sequence, offset = table.value.T
        keys = (length << RANK_BITS) + first
        for batch in batches:
            size, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "rank"))
            at = np.searchsorted(keys, (size << RANK_BITS) + rank, "right") - 1
            beyond = rank - first[at]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence[at] + beyond // per[at]), pa.array(offset[at] + beyond % per[at] * size)], names=names)

    table = docs.sparkSession.sparkContext.broadcast(places)
    # pieces of a length are ranked task by task; a length has as many rows here as tasks that made pieces
    before = F.sum("many").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ahead = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("ahead"))
    own = [*[c.split()[0] for c in PIECES.split(", ")], *(["token_ids"] if ids else [])]
    ranked = pieces.join(ahead, ["part", "length"]).select(*own, (F.col("nth") + F.col("ahead")).alias("rank"))
    names = [*own, "sequence_id", "offset"]
    return mapped(ranked, run, PIECES + (", token_ids binary" if ids else "") + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, token_ids and the doc_ids of each sequence, from pieces with token_ids; a sequence has at most
    as many pieces as tokens."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "token_ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.expr("aggregate(parts.length, 0L, (a, b) -> a + b)").alias("n_tokens"),
        F.expr("aggregate(parts.token_ids, cast('' as binary), (a, b) -> concat(a, b))").alias("token_ids"), F.col("parts.doc_id").alias("doc_ids"))
