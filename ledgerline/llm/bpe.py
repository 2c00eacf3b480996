"""Byte-pair encoding and decoding with merge rounds over many words at once."""

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import chunks, mapped, texts

#: Words whose tokens a worker remembers in each of two generations, and the bytes of new words that one set of merge
#: rounds takes.
REMEMBERED, ROUND_BYTES = 80_000, 1 << 20

#: Fixed values of the vocabulary file's normaliser and splitter, with the Unicode blanks written out.
BLANKS = r"\t-\r \x85\xa0  -     　"
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{BLANKS}\p{{L}}\p{{N}}]+")

CUT = re.compile(rb"(?<=[a-z])(?=[.,])")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A BPE vocabulary with word ends, as merge tables in sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") is None or spec["decoder"] is not None:
            raise ValueError("the file must hold a BPE model with word ends and no decoder")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + end] for c in letters], np.int64)
        self.size = len(vocab)
        pairs = [(vocab[a], vocab[b]) for a, b in model["merges"]]
        made = [vocab[a + b] for a, b in model["merges"]]
        born = {x: rank for rank, x in reversed(list(enumerate(made)))}
        # A round merges every place of a word's lowest pair; that needs parts to be made before they are used.
        if any(born.get(x, -1) >= rank for rank, pair in enumerate(pairs) for x in pair):
            raise ValueError("a merge uses a token that a later merge makes")
        keys = np.array([a * self.size + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), np.array(made, np.int64)[order]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        if not all(s.startswith("<|") for s in self.special):
            raise ValueError("special tokens must start with <|")
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def pieces(self, word: str) -> list[bytes | int]:
        """The units of a stretch of text without ASCII blanks: UTF-8 bytes of ordinary ones, ids of special ones."""
        if word.isascii() and word.isalpha():
            return [word.lower().encode()]
        out: list[bytes | int] = []
        for part in self.special_split.split(word) if "<|" in word else [word]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                part = unicodedata.normalize("NFC", part)
                # lower case letter by letter: the end of a word plays no part
                part = "".join(map(str.lower, part)) if "Σ" in part else part.lower()
                out += [p.encode() for p in SPLIT.findall(part)]
        return out

    def merged(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all units and where each unit's end, by merge rounds over one flat array of symbols."""
        sizes = np.array([len(u) for u in units], np.int64)
        data = np.frombuffer(b"".join(units), np.uint8)
        symbols, ends = self.inner[data], np.cumsum(sizes)
        symbols[ends - 1] = self.final[data[ends - 1]]
        unit = np.repeat(np.arange(len(units)), sizes)
        done_symbols, done_units = [], []
        while len(symbols):
            together = unit[:-1] == unit[1:]
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(together & (self.keys[at] == key), self.ranks[at], len(self.keys))
            rank = np.append(rank, len(self.keys))
            start = np.flatnonzero(np.append(True, ~together))
            lowest = np.minimum.reduceat(rank, start)
            lengths = np.diff(np.append(start, len(symbols)))
            open_units = lowest < len(self.keys)
            alive = np.repeat(open_units, lengths)
            done_symbols.append(symbols[~alive])
            done_units.append(unit[~alive])
            hit = alive & (rank == np.repeat(lowest, lengths))
            # a run of equal symbols merges from the left: first, third, fifth place
            place = np.flatnonzero(hit)
            if len(place):
                fresh = np.append(True, np.diff(place) > 1)
                hit[place] = (np.arange(len(place)) - np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))) % 2 == 0
            place = np.flatnonzero(hit)
            symbols[place] = self.made[at[place]]
            alive[place + 1] = False
            symbols, unit = symbols[alive], unit[alive]
        symbols, unit = np.concatenate(done_symbols), np.concatenate(done_units)
        order = np.argsort(unit, kind="stable")
        return symbols[order].astype("<u4"), np.cumsum(np.bincount(unit, minlength=len(units)))

    def learn(self, words: set[bytes]) -> None:
        """Tokens of new words into the memory of this worker."""
        plain = [w for w in words if w.isalpha() and w.islower()]  # ASCII letters: one unit
        plans = {w: self.pieces(w.decode()) for w in words.difference(plain)}
        units = [*plain, *{p for plan in plans.values() for p in plan if isinstance(p, bytes)}.difference(plain)]
        ids: dict[bytes, bytes] = {}
        at = 0
        while at < len(units):
            end, size = at, 0
            while end < len(units) and (end == at or size + len(units[end]) <= ROUND_BYTES):
                size += len(units[end])
                end += 1
            tokens, ends = self.merged(units[at:end])
            data, starts = tokens.tobytes(), [0, *(4 * ends).tolist()]
            ids.update(zip(units[at:end], [data[a:b] for a, b in zip(starts, starts[1:])]))
            at = end
        for word in plain:
            self.known[word] = ids[word]
        for word, plan in plans.items():
            self.known[word] = b"".join([ids[p] if isinstance(p, bytes) else p.to_bytes(4, "little") for p in plan])

    def encode(self, values: list[bytes]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers."""
        # Lower-casing A-Z first changes no token and halves the words to learn, but for names of special tokens.
        # A blank before a full stop or comma that follows a letter stands where the splitter cuts anyway.
        lists = [(v if b"<|" in v else CUT.sub(b" ", v.lower())).split() for v in values]
        # A full memory becomes the older one; words that come again move over, so frequent words are never forgotten.
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        new = set()
        for words in lists:
            new.update(words)
        new.difference_update(self.known)
        again = {w: self.older[w] for w in new if w in self.older}
        self.known.update(again)
        new.difference_update(again)
        if new:
            self.learn(new)
        known = self.known
        return [b"".join([known[w] for w in words]) for words in lists]

    def decode(self, ids: bytes) -> str:
        """The names of the tokens with a blank between them: what a file without a decoder asks for."""
        names = self.names
        return b" ".join([names[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBpe:
    return WordBpe(path)


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens (long) and token_ids (binary: little-endian unsigned 32-bit integers) of every whole text.

    Reads `doc_id` and `text`; other columns are ignored.  `path` is a vocabulary file that every executor
    has, with word ends and without a decoder.  Null and empty texts have no tokens; repeated rows give repeated
    results; an empty table gives an empty result.  A very long text is encoded whole: memory grows with the
    words of the longest text, and the memory of known words is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in chunks(batches):
            ids = bpe.encode(texts(batch))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()),
                "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()), "token_ids": pa.array(ids, pa.binary())})

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, token_ids binary")


def decode_tokens(encoded: DataFrame, path: str) -> DataFrame:
    """All columns of `encoded` and `decoded` (replaced if there): the text of token_ids.  Null counts as no tokens."""
    names = [c for c in encoded.columns if c != "decoded"]
    schema = T.StructType([encoded.schema[c] for c in names] + [T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in chunks(batches, "token_ids"):
            decoded = pa.array([bpe.decode(v or b"") for v in batch.column(names.index("token_ids")).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*names, "decoded"])

    return mapped(encoded.select(*names), run, schema)
