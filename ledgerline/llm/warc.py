"""WARC archives with dictionary compression: records compressed one by one, the dictionary in front."""

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import new_folder, stored
from .common import mapped

#: Magic number of the skippable frame that holds the dictionary, and of a Zstandard dictionary.
SKIPPABLE, DICTIONARY = bytes.fromhex("5d2a4d18"), bytes.fromhex("37a430ec")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records in one archive (a longer record has one of its own), bytes to learn a dictionary from, its size.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 32 << 20, 2 << 20, 64 << 10

FILES = "file string, records long, bytes long"
RECORDS = ("page_id long, record_type string, url string, payload binary, payload_bytes long, payload_digest string, "
           "refers_to long, file string, offset long")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plan_records(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, html, kind, keep_id, bytes, copy: what to write for each page.

    Of pages with equal payloads of `min_bytes` or more the one with the largest page_id carries the payload.
    Only that page's html is shuffled, once per payload and task: partial aggregation keeps the best page before
    the shuffle, so copies of one page never meet in one task.  The revisits need no payload."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).cast("long").alias("bytes"))
    same = rows.filter(F.col("bytes") >= min_bytes)
    heads = same.groupBy("sha", "bytes").agg(F.max(F.struct("page_id", "url", "html")).alias("head"))
    response = heads.select("head.*", F.lit("response").alias("kind"), F.lit(None).cast("long").alias("keep_id"), "bytes", F.lit(0).cast("long").alias("copy"))
    keep = same.groupBy("sha", "bytes").agg(F.max(F.struct("page_id", "url")).alias("keep"))
    others = same.groupBy("sha", "bytes", "page_id", "url").agg(F.count(F.lit(1)).alias("n")).join(keep, ["sha", "bytes"])
    is_head = F.col("page_id").eqNullSafe(F.col("keep.page_id")) & F.col("url").eqNullSafe(F.col("keep.url"))
    left = (F.col("n") - is_head.cast("int")).cast("int")
    revisit = others.filter(left > 0).select(
        "page_id", "url", F.lit(None).cast("string").alias("html"), F.lit("revisit").alias("kind"), F.col("keep.page_id").alias("keep_id"), "bytes",
        F.explode(F.sequence(F.lit(1).cast("long"), left.cast("long"))).alias("copy"), "sha")
    out = response.withColumn("sha", F.lit(None).cast("string")).unionByName(revisit)
    if min_bytes > 0:
        small = rows.filter(F.col("bytes") < min_bytes).select(
            "page_id", "url", "html", F.lit("response").alias("kind"), F.lit(None).cast("long").alias("keep_id"), "bytes",
            F.monotonically_increasing_id().alias("copy"), F.lit(None).cast("string").alias("sha"))
        out = out.unionByName(small)
    return out


def record(page: dict, date: str) -> bytes:
    """One WARC 1.1 record with an HTTP response as its block; a revisit has the headers only."""
    payload = (page["html"] or "").encode() if page["kind"] == "response" else b""
    code = digest(payload) if page["kind"] == "response" else base64.b32encode(bytes.fromhex(page["sha"])).decode()
    number = "" if page["page_id"] is None else page["page_id"]
    name = lambda n, c: uuid.uuid5(uuid.NAMESPACE_OID, f"{n}|{code}|{c}")
    url = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in page["url"] or f"urn:page:{number}")
    fields = [("WARC-Type", page["kind"]), ("WARC-Record-ID", f"<urn:uuid:{name(number, page['copy'])}>"), ("WARC-Date", date),
              ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{code}"), ("X-Page-ID", number)]
    if page["kind"] == "revisit":
        keep = "" if page["keep_id"] is None else page["keep_id"]
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{name(keep, 0)}>"), ("X-Refers-To-Page-ID", keep)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {page['bytes']}\r\n\r\n".encode()
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(http) + len(payload))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return b"".join((head.encode(), http, payload, b"\r\n\r\n"))


def build_dictionary(records: list[bytes]) -> bytes:
    """A Zstandard dictionary learned from records spread evenly over the archive; empty if they are too few to learn from."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    samples = [r[: 64 << 10] for r in records[::step]]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    if len(samples) < 8 or size < 1024:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8, level=3).as_bytes()
    except zstandard.ZstdError:  # the samples have too little in common
        return b""


def archive(records: list[bytes]) -> tuple[bytes, int]:
    """Bytes of an archive: the dictionary in a skippable frame, then one frame per record."""
    learned = build_dictionary(records)
    known = zstandard.ZstdCompressionDict(learned) if learned else None
    packer = zstandard.ZstdCompressor(level=6, dict_data=known, write_content_size=True, write_checksum=True)
    frames = [packer.compress(r) for r in records]
    if learned:
        frames.insert(0, SKIPPABLE + len(learned).to_bytes(4, "little") + learned)
    return b"".join(frames), len(records)


def write_warc(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> tuple[str, DataFrame]:
    """Write one record per row of `pages` and return the folder and the list of archives (FILES).

    Reads page_id, url, html; other columns are ignored.  Null html counts as empty, a null url gets a name made
    from page_id, a null page_id is the smallest one; of rows that repeat page_id and html one is the response.
    A task that is run again writes new names and only names of tasks that succeeded are listed.  An empty table
    gives no archive.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, store = [], 0, None

        def close():
            data, count = archive(held)
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as file:
                file.write(data)
            return pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([count], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

        for batch in batches:
            for k in range(batch.num_rows):
                held.append(record({c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)}, date))
                size += len(held[-1])
                if store is None:
                    store, root = pa.fs.FileSystem.from_uri(folder)
                    store.create_dir(root, recursive=True)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return folder, stored(mapped(plan_records(pages, min_bytes), run, FILES), "warc-files")


def frames_of(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each record frame of an archive."""
    place, known = 0, None
    if data[:4] == SKIPPABLE:
        place = 8 + int.from_bytes(data[4:8], "little")
        known = zstandard.ZstdCompressionDict(data[8:place])
    reader, view = zstandard.ZstdDecompressor(dict_data=known), memoryview(data)
    while place < len(data):
        frame, start, parts = reader.decompressobj(), place, []
        while not frame.eof:
            part = view[place : place + (8 << 10)]
            if not len(part):
                raise ValueError("the archive ends within a record")
            parts.append(frame.decompress(part))
            place += len(part) - len(frame.unused_data)
        yield start, b"".join(parts)


def parse(raw: bytes) -> dict:
    """Fields of one record; the payload of a response is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    field = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(field["Content-Length"])]
    if len(block) != int(field["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record has another length than its header says")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b": ")[1]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))
    code = field["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda v: int(v) if v else None
    if field["WARC-Type"] == "response" and (len(payload), digest(payload)) != (size, code):
        raise ValueError("a payload does not fit its digest")
    return {"page_id": number(field["X-Page-ID"]), "record_type": field["WARC-Type"], "url": field["WARC-Target-URI"],
            "payload": payload if field["WARC-Type"] == "response" else None, "payload_bytes": size, "payload_digest": code,
            "refers_to": number(field.get("X-Refers-To-Page-ID"))}


def read_warc(spark: SparkSession, folder: str, files: DataFrame, payload: bool = True) -> DataFrame:
    """The records (RECORDS) of the listed archives; without `payload` that column is null.

    Each response's payload is read and checked; a revisit has the size and digest of the payload it refers to."""
    kinds = {"page_id": pa.int64(), "record_type": pa.string(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(),
             "payload_digest": pa.string(), "refers_to": pa.int64(), "file": pa.string(), "offset": pa.int64()}

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], kind) for c, kind in kinds.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = None
        for names in batches:
            for name in names.column(0).to_pylist():
                if store is None:
                    store, root = pa.fs.FileSystem.from_uri(folder)
                with store.open_input_file(f"{root}/{name}") as file:
                    data = file.read()
                rows, size = [], 0
                for offset, raw in frames_of(data):
                    rows.append(parse(raw) | {"file": name, "offset": offset} | ({} if payload else {"payload": None}))
                    size += len(raw)
                    if size > 8 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mapped(files.select("file").repartition(n, "file"), run, RECORDS)
