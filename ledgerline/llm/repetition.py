"""Quality rules on repetition, from suffix arrays of whole documents."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BLANK, Numbers, chunks, coded, joined, mapped, texts, words_of

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT, WINDOW = 50, 50, 3

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, covered_words long, longest_repeat long, covered_fraction double")


def suffix_order(symbols: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by prefix doubling, and the ranks after each doubling.

    `symbols`: one number per word, different in different documents; `left`: words to the end of the document,
    this one included.  Rank arrays hold equal numbers where the next 2^k words are equal.  Only suffixes that
    still share their rank are sorted again.
    """
    n = len(symbols)
    order = np.argsort(symbols)
    ranks = np.empty(n, np.int64)
    ordered = symbols[order]
    first = np.ones(n, bool)
    first[1:] = ordered[1:] != ordered[:-1]
    ranks[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, length = [ranks], 1
    tied = ~(first & np.append(first[1:], True))
    place = np.flatnonzero(tied)  # places in the order that are not settled; those of a group are neighbours
    while len(place):
        who = order[place]
        nexts = np.where(left[who] > length, ranks[np.minimum(who + length, n - 1)], -1)
        again = np.lexsort((nexts, ranks[who]))
        who, nexts = who[again], nexts[again]
        group = ranks[who]
        first = np.ones(len(who), bool)
        first[1:] = (group[1:] != group[:-1]) | (nexts[1:] != nexts[:-1]) | (nexts[1:] < 0)
        order[place] = who
        ranks = ranks.copy()
        ranks[who] = place[np.maximum.accumulate(np.where(first, np.arange(len(who)), 0))]
        levels.append(ranks)
        length *= 2
        place = place[~(first & np.append(first[1:], True))]
    return order, levels


def neighbour_prefixes(order: np.ndarray, levels: list[np.ndarray], left: np.ndarray) -> np.ndarray:
    """Longest common prefix, in words, of each suffix in the order and the one after it."""
    if len(order) < 2:
        return np.zeros(0, np.int64)
    a, b, n = order[:-1], order[1:], len(order)
    shared = np.zeros(len(a), np.int64)
    room = np.minimum(left[a], left[b])
    for k in range(len(levels) - 1, -1, -1):
        fits = shared + (1 << k) <= room
        same = levels[k][np.minimum(a + shared, n - 1)] == levels[k][np.minimum(b + shared, n - 1)]
        shared += np.where(fits & same, 1 << k, 0)
    return shared


def longest_repeats(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For every word the length of the longest repeated substring of its document that starts there.

    An interval of the suffix order with common prefix l is a substring of l words that occurs at all its
    suffixes; the deepest interval around a suffix is given by the larger of its two neighbours' prefixes."""
    order, levels = suffix_order(symbols, left)
    shared = neighbour_prefixes(order, levels, left)
    best = np.zeros(len(symbols), np.int64)
    if len(shared):
        best[order[:-1]] = shared
        best[order[1:]] = np.maximum(best[order[1:]], shared)
    return best


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def measures(values: list[bytes], min_repeat: int) -> dict[str, np.ndarray]:
    """The counts of each text."""
    data, offsets = joined(values)
    starts, _, n_words = words_of(data, offsets)
    word_at = np.zeros(len(values) + 1, np.int64)
    np.cumsum(n_words, out=word_at[1:])
    text_of = np.repeat(np.arange(len(values)), n_words)
    # equal for equal words of one text only; no hash stands for a word, a line or a window
    words = np.unique(coded([v.split() for v in values], Numbers()) * len(values) + text_of, return_inverse=True)[1]

    # lines with a word that equal an earlier line of the text
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    breaks = np.flatnonzero(data == 10)
    line_from = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    line_from = line_from[line_from < len(data)]
    line_to = np.minimum.reduce([np.append(breaks, len(data))[np.searchsorted(breaks, line_from)],
                                 offsets[np.searchsorted(offsets, line_from, "right").clip(max=len(offsets) - 1)]])
    used = np.searchsorted(starts, line_to) > np.searchsorted(starts, line_from)
    line_from, line_to = line_from[used], line_to[used]
    line_text = np.searchsorted(offsets, line_from, "right") - 1
    lines = Numbers()
    at = offsets[line_text]
    keys = np.array([lines[i, values[i][x:y]] for i, x, y in zip(line_text.tolist(), (line_from - at).tolist(), (line_to - at).tolist())], np.int64)
    distinct = np.unique(keys, return_index=True)[1]
    dup_lines = np.bincount(line_text, minlength=len(values)) - np.bincount(line_text[distinct], minlength=len(values))

    # words in windows that occur again
    n, left = len(words), word_at[1:][text_of] - np.arange(len(words)) if len(words) else np.zeros(0, np.int64)
    marks = np.zeros(n, bool)
    at = np.flatnonzero(left >= WINDOW)
    if len(at):
        key = words[at]
        for k in range(1, WINDOW):
            key = np.unique(key * n + words[at + k], return_inverse=True)[1]
        at = at[repeated(key)]
        for k in range(WINDOW):
            marks[at + k] = True

    best = longest_repeats(words, left)
    spans_from = np.flatnonzero(best >= min_repeat)
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, spans_from, 1)
    np.add.at(steps, spans_from + best[spans_from], -1)
    longest = np.zeros(len(values), np.int64)
    np.maximum.at(longest, text_of, best)
    chars = per_text((data & 0xC0) != 0x80, offsets) - per_text(BLANK[data], offsets)
    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": per_text(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)), offsets),
        "n_dup_lines": dup_lines, "n_repeat_words": per_text(marks, word_at),
        "covered_words": per_text(np.cumsum(steps[:n]) > 0, word_at), "longest_repeat": longest,
    }


def repetition_rules(docs: DataFrame, min_repeat: int = 8, max_covered: float = 0.3, max_repeat: int = 100) -> DataFrame:
    """Word, symbol, line and repetition counts of every whole text, and whether it is kept.

    Reads `doc_id` and `text`; other columns are ignored.  A text fails the base rules with fewer than 50 words
    or with more than half of its words in three-word windows that occur again.  Beyond them the union of all
    repeated substrings of `min_repeat` words or more may cover `max_covered` of the words and the longest
    repeat may have `max_repeat` words.  Returns the columns of SCHEMA; covered_words and longest_repeat are
    in words.  Null and empty texts have no words and fail; repeated rows give repeated results; an empty
    table gives an empty result.  Memory: a few arrays over the words of 2 MB of text or of one longer text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            m = measures(texts(batch), min_repeat)
            words = m["n_words"]
            failed = (words < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * words)
            covered = m["covered_words"] / np.maximum(words, 1)
            kept = ~failed & (covered <= max_covered) & (m["longest_repeat"] <= max_repeat)
            columns = {"doc_id": batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())}
            columns |= {k: pa.array(m[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
            columns |= {"base_failed": pa.array(failed), "kept": pa.array(kept)}
            columns |= {k: pa.array(m[k], pa.int64()) for k in ("covered_words", "longest_repeat")}
            yield pa.RecordBatch.from_pydict(columns | {"covered_fraction": pa.array(covered)})

    return mapped(docs.select("doc_id", "text"), run, SCHEMA)
