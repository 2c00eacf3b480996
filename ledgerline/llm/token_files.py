"""Token ids in length-delimited binary record files with an offset index."""

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from ..session import new_folder, stored
from .bpe import CUT
from .common import chunks, mapped, texts

#: Fixed values of the record framing: CRC-32C (reflected polynomial) and the constant of its mask.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
#: Pieces of text whose tokens a worker remembers.
REMEMBERED = 800_000
#: Bytes of a file that are read and checked at a time; one longer record is read alone.
BLOCK = 4 << 20

FILES = "file string, first_doc long, n_docs long, n_tokens long, data_bytes long"
TOKENS = "doc_id long, start long, n_tokens long, token_ids binary, offset long, file string"


def _tables(count: int) -> np.ndarray:
    """tables[d][b]: checksum of byte b followed by d zero bytes, without start value or final inversion."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1)
    out = [one]
    for _ in range(count - 1):
        out.append(one[out[-1] & 255] ^ (out[-1] >> 8))
    return np.array(out)


_BYTES = _tables(8)


@lru_cache(maxsize=64)
def _shift(level: int) -> np.ndarray:
    """For each byte of a checksum: what it becomes after 8 * 2^level more zero bytes."""
    unit = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None])
    if level == 0:
        for _ in range(8):
            unit = _BYTES[0][unit & 255] ^ (unit >> 8)
        return unit
    return _moved(_moved(unit, level - 1), level - 1)


def _moved(checksums: np.ndarray, level: int) -> np.ndarray:
    t = _shift(level)
    return t[0][checksums & 255] ^ t[1][(checksums >> 8) & 255] ^ t[2][(checksums >> 16) & 255] ^ t[3][checksums >> 24]


def crc32c(values: list[bytes]) -> np.ndarray:
    """CRC-32C (Castagnoli) of each value: eight-byte words are looked up at once, then joined in pairs.

    Zero bytes in front change nothing, so a value is filled up in front to whole words and a level with an odd
    number of words gets a zero; the start value of all ones amounts to inverting the first four bytes of a value;
    values of fewer bytes are looked up byte by byte."""
    if not values:
        return np.zeros(0, np.uint32)
    sizes = np.array([len(v) for v in values], np.int64)
    short = np.maximum(0, 4 - sizes)
    count = -(-np.maximum(sizes, 4) // 8)
    stop = np.cumsum(count)
    data = np.zeros(int(stop[-1]) * 8, np.uint8)
    ends = stop * 8
    starts = ends - sizes
    whole = np.frombuffer(b"".join(values), np.uint8)
    data[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(whole))] = whole
    for k in range(4):
        at = starts + k
        data[at[k < sizes]] ^= 255
    sums = np.zeros(int(stop[-1]), np.uint32)
    for i in range(8):
        sums ^= _BYTES[7 - i][data[i::8]]
    level = 0
    while len(sums) > len(values):
        odd, begin = count % 2, np.cumsum(count) - count
        half = (count + 1) // 2
        nth = np.arange(int(half.sum())) - np.repeat(np.cumsum(half) - half, half)
        right = np.repeat(begin - odd, half) + 2 * nth + 1
        left = np.where((nth == 0) & np.repeat(odd == 1, half), np.uint32(0), sums[right - 1])
        sums, count, level = _moved(left, level) ^ sums[right], half, level + 1
    for i in np.flatnonzero(short):  # at most three bytes
        crc = 0xFFFFFFFF
        for b in values[i]:
            crc = int(_BYTES[0][(crc ^ b) & 255]) ^ (crc >> 8)
        sums[i] = crc
    return sums ^ np.uint32(0xFFFFFFFF)


def masked(values: list[bytes]) -> list[int]:
    crc = crc32c(values).astype(np.uint64)
    return (((crc >> np.uint64(15)) | (crc << np.uint64(17))) + np.uint64(MASK) & np.uint64(0xFFFFFFFF)).tolist()


def frames(payloads: list[bytes]) -> list[bytes]:
    """Of each payload: length (8 bytes), its masked checksum (4), payload, its masked checksum (4); little-endian."""
    sizes = [len(p).to_bytes(8, "little") for p in payloads]
    return [b"".join((size, a.to_bytes(4, "little"), payload, b.to_bytes(4, "little")))
            for size, a, payload, b in zip(sizes, masked(sizes), payloads, masked(payloads))]


def unframed(data: bytes, places: list[int]) -> list[bytes]:
    """The payloads of the records that start at `places`; an error where a checksum does not fit."""
    heads = [data[p : p + 8] for p in places]
    if masked(heads) != [int.from_bytes(data[p + 8 : p + 12], "little") for p in places]:
        raise ValueError("the length of a record is damaged")
    sizes = [int.from_bytes(h, "little") for h in heads]
    payloads = [data[p + 12 : p + 12 + n] for p, n in zip(places, sizes)]
    checks = [int.from_bytes(data[p + 12 + n : p + 16 + n], "little") for p, n in zip(places, sizes)]
    if [len(p) for p in payloads] != sizes or masked(payloads) != checks:
        raise ValueError("a record is damaged")
    return payloads


class LibraryEncoder:
    """Tokens of whole texts by the tokenizers library, which sees every distinct piece between ASCII blanks once.

    A blank always ends a token of this vocabulary, and so does the place between a letter a-z and a
    following full stop or comma; a text with '<|' goes to the library as it is."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size()
        self.known: dict[bytes, bytes] = {}

    def encode(self, values: list[bytes]) -> list[bytes]:
        odd = [i for i, v in enumerate(values) if b"<|" in v]
        lists = [[] if b"<|" in v else CUT.sub(b" ", v.lower()).split() for v in values]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new: set[bytes] = set()
        for words in lists:
            new.update(words)
        new.difference_update(self.known)
        fresh = list(new)
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            # one call for many pieces: the blanks between them keep them apart, their places tell them apart
            whole = self.tokenizer.encode(" ".join([w.decode() for w in part]), add_special_tokens=False)
            ends = np.cumsum([len(w.decode()) + 1 for w in part])
            starts = np.array([a for a, _ in whole.offsets], np.int64)
            cuts = np.searchsorted(starts, ends[:-1]).tolist()
            data = np.array(whole.ids, "<u4").tobytes()
            self.known.update(zip(part, [data[4 * a : 4 * b] for a, b in zip([0, *cuts], [*cuts, len(whole.ids)])]))
        known = self.known
        out = [b"".join([known[w] for w in words]) for words in lists]
        for i, e in zip(odd, self.tokenizer.encode_batch([values[i].decode() for i in odd], add_special_tokens=False)):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write_tokens(docs: DataFrame, path: str, end_id: int = 1, folder: str | None = None) -> tuple[str, DataFrame]:
    """Encode every whole text, append `end_id`, and write the documents in ascending doc_id order.

    Reads `doc_id` and `text`; other columns are ignored.  Returns the folder and the list of its files (FILES).
    Each task writes one range of doc_id: `<name>.tokens` holds the framed records and `<name>.index` the
    offset index, one 32-byte entry per record (doc_id, token place within the file, token count, byte offset;
    little-endian signed 64-bit integers; a null doc_id is the smallest one).  A payload is one byte with the
    width of an id (2 or 4) and the ids.  A task that is run again writes under a new name and only the names
    that succeeded are listed, so a lost executor leaves no doubtful file.  Null texts count as empty, null
    doc_ids come first, equal doc_ids are ordered by a hash of the text; an empty table gives no records.
    """
    folder = folder or new_folder(docs.sparkSession, "tokens")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, name = encoder(path), uuid.uuid4().hex
        width = 2 if max(encode.size - 1, end_id) < 1 << 16 else 4
        end = end_id.to_bytes(4, "little")
        store, data, index, place, tokens, first = None, None, [], 0, 0, None
        for batch in chunks(batches, limit=4 << 20):
            if store is None:
                store, root = pa.fs.FileSystem.from_uri(folder)
                store.create_dir(root, recursive=True)
                data = store.open_output_stream(f"{root}/{name}.tokens", compression=None)
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            sequences = [np.frombuffer(raw + end, "<u4") for raw in encode.encode(texts(batch))]
            head = bytes([width])
            for doc, sequence, record in zip(ids, sequences, frames([head + q.astype(f"<u{width}").tobytes() for q in sequences])):
                data.write(record)
                index.append((-(1 << 63) if doc is None else doc, tokens, len(sequence), place))
                place, tokens, first = place + len(record), tokens + len(sequence), index[0][0]
        if store is not None:
            data.close()
            with store.open_output_stream(f"{root}/{name}.index", compression=None) as file:
                file.write(np.array(index, "<i8").tobytes())
            yield pa.RecordBatch.from_pydict({
                "file": pa.array([name]), "first_doc": pa.array([first], pa.int64()), "n_docs": pa.array([len(index)], pa.int64()),
                "n_tokens": pa.array([tokens], pa.int64()), "data_bytes": pa.array([place], pa.int64())})

    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange(n, "doc_id", "tie")
    # the order of the files is the order of the ranges
    files = mapped(dealt.sortWithinPartitions("doc_id", "tie").drop("tie"), run, FILES).withColumn("part", F.spark_partition_id())
    return folder, stored(files, "token-files")


def read_tokens(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """The records (TOKENS) of the listed files: token_ids as little-endian unsigned 32-bit integers, `start` as the
    number of ids before the record in all files.  Every length and payload is checked against its checksum.
    The offset index gives each record's place, so records can be read in any order; here it is the file's."""
    # one row per file: at most as many as the tasks that wrote
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    listed = files.withColumn("before", F.coalesce(before, F.lit(0))).select("file", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = None
        for batch in batches:
            for name, ahead in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if store is None:
                    store, root = pa.fs.FileSystem.from_uri(folder)
                with store.open_input_stream(f"{root}/{name}.index", compression=None) as file:
                    index = np.frombuffer(file.read(), "<i8").reshape(-1, 4)
                with store.open_input_file(f"{root}/{name}.tokens") as file:
                    place = np.append(index[:, 3], file.size())
                    at = 0
                    while at < len(index):
                        end = max(at + 1, int(np.searchsorted(place, place[at] + BLOCK, "right")) - 1)
                        data = file.read(int(place[end] - place[at]))
                        payloads = unframed(data, (place[at:end] - place[at]).tolist())
                        part = index[at:end]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(part[:, 0], pa.int64(), mask=part[:, 0] == -(1 << 63)),
                            "start": pa.array(part[:, 1] + ahead, pa.int64()), "n_tokens": pa.array(part[:, 2], pa.int64()),
                            "token_ids": pa.array([np.frombuffer(p, f"<u{p[0]}", offset=1).astype("<u4").tobytes() for p in payloads], pa.binary()),
                            "offset": pa.array(part[:, 3], pa.int64()), "file": pa.array([name] * len(part))})
                        at = end

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mapped(listed.repartition(n, "file"), run, TOKENS)
