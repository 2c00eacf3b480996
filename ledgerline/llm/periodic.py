"""Periodic runs of words: stretches that repeat with a smallest period, found on the diagonals of earlier occurrences.

A word inside a run of period q equals the word q places before, so the run is a row of matches on the diagonal of lag
q.  Anchors are read in order.  Each anchor's earlier occurrences raise the match lengths of their lags; a lag that the
next anchor does not raise has ended, and its run is settled at once.  Only diagonals that are open are held.

Lags are taken in ranges [2^k, 2^(k+1)).  A run with a lag of a range has a known least row of matches, so an anchor is a
window of several words instead of one, and anchors may stand some words apart: an ordinary text has hardly any earlier
occurrence to look at, and a text of one repeated word has about 4n per range instead of n^2 / 2.
"""

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Numbers, chunks, coded, mapped, texts
from .repetition import suffix_order

#: Earlier occurrences that are expanded at a time.
SLICE = 1 << 20

RUN = "struct<start:bigint,length:bigint,period:bigint>"
SCHEMA = f"doc_id bigint, n_words bigint, runs array<{RUN}>, collapsed string"
RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def diagonals(ranks: np.ndarray, low: int, high: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, lag) of every maximal row of anchors, `step` words apart, whose window (equal `ranks`) also stands
    `lag` words before, low <= lag < high.  Yields diagonals as they end."""
    n = len(ranks)
    size = np.bincount(ranks, minlength=n)
    places = np.flatnonzero(size[ranks] > 1)
    keys = np.sort(ranks[places] * n + places)
    nth = np.flatnonzero(size[ranks[::step]] > 1)  # anchors whose window stands somewhere else too
    base = ranks[nth * step] * n
    begin = np.searchsorted(keys, base + np.maximum(nth * step - high + 1, 0))
    many = np.maximum(np.searchsorted(keys, base + nth * step - low, "right") - begin, 0)
    nth, begin, many = nth[many > 0], begin[many > 0], many[many > 0]
    upto, at = np.cumsum(many), 0
    lags, firsts = np.zeros(0, np.int64), np.zeros(0, np.int64)  # open diagonals after the anchor `before`
    before = -2
    while at < len(nth):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE, "right")))
        m = many[at:end]
        t = np.repeat(nth[at:end], m)
        inside = np.arange(len(t)) - np.repeat(np.cumsum(m) - m, m)
        lag = t * step - keys[np.repeat(begin[at:end], m) + inside] % n
        t, lag, first = np.append(np.full(len(lags), before), t), np.append(lags, lag), np.append(firsts, t * step)
        order = np.lexsort((t, lag))
        t, lag, first = t[order], lag[order], first[order]
        fresh = np.append(True, (lag[1:] != lag[:-1]) | (t[1:] != t[:-1] + 1))
        heads, tails = np.flatnonzero(fresh), np.flatnonzero(np.append(fresh[1:], True))
        before = int(nth[end - 1])
        still = t[tails] == before
        yield first[heads][~still], t[tails][~still] * step, lag[heads][~still]
        lags, firsts = lag[heads][still], first[heads][still]
        at = end
    yield firsts, np.full(len(firsts), before * step), lags


def common_after(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal words from places a and b on."""
    n, same = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + same, b + same
        inside = (x < n) & (y < n)
        same += np.where(inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)]), 1 << k, 0)
    return same


def common_before(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal words in front of places a and b."""
    same = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a - same - (1 << k), b - same - (1 << k)
        inside = (x >= 0) & (y >= 0)
        same += np.where(inside & (levels[k][np.maximum(x, 0)] == levels[k][np.maximum(y, 0)]), 1 << k, 0)
    return same


def least_matches(low: int, high: int, min_length: int) -> int:
    """The fewest matches on a diagonal of a run whose lag is in the range."""
    middle = min(max(-(-min_length // 2), low), high - 1)
    return min(max(q, min_length - q) for q in (low, middle, high - 1))


def find_runs(symbols: np.ndarray, left: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start, then period.  `symbols`: a number per word, different in different
    documents; `left`: words to the end of the document, this one included."""
    if not len(symbols):
        return (np.zeros(0, np.int64),) * 3
    levels = suffix_order(symbols, left)[1]
    found, low, longest = [], 1, int(left.max())
    while 2 * low <= longest:
        high = 2 * low
        least = least_matches(low, high, min_length)
        k = max(0, (2 * least // 3).bit_length() - 1)
        if k >= len(levels):
            break  # no window of this length stands twice, nor a longer one
        step = min(1 << k, least - (1 << k) + 1)
        for first, last, lag in diagonals(levels[k], low, high, step):
            ahead = common_before(levels, first, first - lag)
            matches = ahead + last - first + common_after(levels, last, last - lag)
            whole = (matches >= lag) & (matches + lag >= min_length)
            found.append(np.stack([first - ahead - lag, matches + lag, lag])[:, whole])
        low = high
    start, length, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    # a multiple of the smallest period gives the same stretch
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    own = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(start)]
    start, length, period = start[own], length[own], period[own]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def periodic_runs(docs: DataFrame, min_length: int = 12) -> DataFrame:
    """doc_id, n_words, runs and the collapsed text of every whole text.

    Reads `doc_id` and `text`; other columns are ignored.  Words are runs of characters other than ASCII blanks.  `runs`
    lists (start, length, period), by start, then period: all stretches with smallest period q and at least
    max(min_length, 2q) words that no neighbouring word extends.  `collapsed` has the words, joined by one blank, without
    those that a run contains after its first q words.  Null, empty and blank texts have no words, no runs and an empty
    collapsed text; repeated rows give repeated results; an empty table gives an empty result.  Memory: some arrays over
    the words of 2 MB of text or of one longer text, one per doubling of its longest repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            lists = [t.split() for t in texts(batch)]
            sizes = np.array([len(w) for w in lists], np.int64)
            ends = np.cumsum(sizes)
            begins, total = ends - sizes, int(ends[-1])
            symbols = coded(lists, Numbers())
            doc = np.repeat(np.arange(len(lists)), sizes)
            start, length, period = find_runs(symbols * len(lists) + doc, ends[doc] - np.arange(total), min_length)
            steps = np.zeros(total + 1, np.int64)
            np.add.at(steps, start + period, 1)
            np.add.at(steps, start + length, -1)
            keep = np.cumsum(steps[:total]) == 0
            kept = np.append(0, np.cumsum(keep))
            whole = (kept[ends] - kept[begins] == sizes).tolist()
            collapsed = [b" ".join(w if all_kept else compress(w, keep[b : b + len(w)].tolist()))
                         for w, b, all_kept in zip(lists, begins.tolist(), whole)]
            own = doc[start]
            offsets = np.append(0, np.cumsum(np.bincount(own, minlength=len(lists)))).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(start - begins[own]), pa.array(length), pa.array(period)], fields=list(RUN_TYPE))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), "n_words": pa.array(sizes),
                "runs": pa.ListArray.from_arrays(pa.array(offsets), values), "collapsed": pa.array(collapsed, pa.binary()).view(pa.string())})

    return mapped(docs.select("doc_id", "text"), run, SCHEMA)


def longest_run(runs: Column) -> Column:
    """The run with the greatest length, of equal ones that with the smallest start, then period; null without runs."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))


def run_lines(runs: Column) -> Column:
    """`start,length,period` and a line feed for every run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts (by checksum of doc_id) end in a repetition of their own words: with
    h = crc32(doc_id), g = h div 10 and n words, word i >= a = g % n becomes word a + (i - a) % p for
    p = 1 + (n - a) div (3 + g % 8) where h % 10 = 0.  A null doc_id has no checksum; its text stays."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).alias("words"))
    placed = words.withColumn("n", F.size("words")).withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("cast(g % greatest(n, 1) as int)")).withColumn(
        "p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    tail = "slice(flatten(array_repeat(slice(words, a + 1, p), cast((n - a) div p + 1 as int))), 1, n - a)"
    return placed.select("doc_id", F.expr(f"case when n > 0 then array_join(concat(slice(words, 1, a), {tail}), ' ') else text end").alias("text"))
