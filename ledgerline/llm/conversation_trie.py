"""Prefix trie of conversations by collapsing whole sequences.

Turns are replaced by digests first; no text is moved after that.  A prefix is named by a chain of digests, so equal
prefixes have equal keys without comparing them.  The steps, each a table in the shared folder:

1. `numbered`: the place of each turn in its conversation; `paths`: key and length of every prefix of every conversation.
2. Identical conversations become one weighted sequence with a list of its ends; only the member with the smallest
   conv_id goes on with the sequence's weight.
3. Leaves are the sequences whose key is not among the keys of proper prefixes (an anti join).
4. The prefixes of the weighted sequences are grouped into nodes, which sum the weights.

A long conversation is read by many tasks: places come from counts per task, chains run in blocks of BLOCK turns.  A key
that holds much of a table is joined by `looked_up`, which broadcasts the few keys of that kind.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..session import stored
from .common import mapped

#: Turns in a block of a chain, bytes of a key, and ends in one row of the end lists.
BLOCK, KEY, ENDS = 4096, 16, 8192
#: A key is common if it holds more than this share of the rows, and at least so many; fewer than 1 / SHARE keys can.
SHARE, LEAST = 1 / 1000, 10_000
#: Key of the root.
ROOT = b""


@dataclass
class Trie:
    """nodes: key, parent, depth, digest, chars, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved;
    sequences: key, conv_id, weight, depth, leaf; ends: key, part, conv_ids (ascending within and over the parts)."""

    nodes: DataFrame
    sequences: DataFrame
    ends: DataFrame


def partitions(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def looked_up(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """`rows` (a stored table) with the other columns of `facts` (one row per key).

    Keys with more than SHARE of the rows, fewer than 1000 of them, are joined by broadcast and so stay where they are."""
    least = max(LEAST, rows.count() * SHARE)
    common = [r[0] for r in rows.groupBy(key).count().filter(F.col("count") > least).select(key).collect()]
    if not common:
        return rows.join(facts, key, how)
    keys = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in common], rows.select(key).schema))
    few = facts.join(keys, key, "left_semi")
    # a null key finds nothing and is never common
    return rows.join(keys, key, "left_semi").join(F.broadcast(few), key, how).unionByName(
        rows.join(keys, key, "left_anti").join(facts, key, how))


def turn_digest() -> F.Column:
    """SHA-256 of a turn's role and text, with the role's length in front."""
    return F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))


def filled(conversations: DataFrame) -> DataFrame:
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest, chars of every turn; equal turn numbers are ordered by role, then digest."""
    rows = filled(conversations).select("conv_id", "turn", "role", turn_digest().alias("digest"), F.char_length("text").cast("long").alias("chars"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            heads = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            nth = np.arange(len(ids)) - np.repeat(heads, np.diff(np.append(heads, len(ids)))) + 1
            if last == ids[0]:
                nth[: heads[1] if len(heads) > 1 else len(ids)] += seen
            last, seen = ids[-1], nth[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), batch.column(0), pa.array(nth), *batch.columns[1:]],
                                             names=["part", "conv_id", "nth", "digest", "chars"])

    dealt = rows.repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order).select("conv_id", "digest", "chars")
    local = stored(mapped(dealt, run, "part int, conv_id long, nth long, digest binary, chars long"), "turns")
    # One row per task: a conversation that goes on from the task before starts at that task's last place.
    edges = local.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "nth")).alias("last"), F.max("conv_id").alias("top"))
    whole = Window.partitionBy("top").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    edges = edges.withColumn("upto", F.sum("last.nth").over(whole))
    back = Window.orderBy("part")
    ahead = edges.select("part", F.col("first").alias("conv_id"), F.lag("top").over(back).alias("top"), F.lag("upto").over(back).alias("ahead")).filter("top = conv_id")
    return stored(local.join(F.broadcast(ahead.drop("top")), ["part", "conv_id"], "left").select(
        "conv_id", (F.col("nth") + F.coalesce("ahead", F.lit(0))).alias("place"), "digest", "chars"), "numbered")


def rebuilt(places: DataFrame, span: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their hundred: conv_id of every conversation, and conv_id, place,
    digest, chars of the rebuilt turns.

    With h = crc32(conv_id in decimal) % `heads`, conversation c has the first h turns of c - c % `span` (as many as there
    are), then its own turns after its first h."""
    ids = stored(places.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")), "conversations")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = F.col("conv_id") - F.col("conv_id") % span
    wanted = ids.select("conv_id", head.alias("h"), base.alias("base"))
    sources = ids.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    missing = wanted.join(sources, "base", "left").select("conv_id", F.greatest(F.col("h") - F.coalesce("there", F.lit(0)), F.lit(0)).alias("missing")).filter("missing > 0")
    first = places.filter(F.col("place") < heads).select(F.col("conv_id").alias("base"), "place", "digest", "chars")
    # at most `span` conversations times `heads` turns for one base
    taken = wanted.join(first, "base").filter("place <= h").select("conv_id", "place", "digest", "chars")
    own = looked_up(places, missing, "conv_id", "left").filter(F.col("place") > head).select(
        "conv_id", (F.col("place") - F.coalesce("missing", F.lit(0))).alias("place"), "digest", "chars")
    return ids.select("conv_id"), taken.unionByName(own)


def paths(turns: DataFrame, block: int) -> DataFrame:
    """conv_id, depth, key, parent, digest, chars and `before` (characters of earlier turns) of every prefix."""

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chain, before = None, ROOT, 0
        for batch in batches:
            keys, parents, sums = [], [], []
            ids, numbers, _, digests, chars = (batch.column(i).to_pylist() for i in range(5))
            for here, digest, size in zip(zip(ids, numbers), digests, chars):
                if here != at:
                    at, chain, before = here, ROOT, 0
                parents.append(chain)
                chain = hashlib.sha256(chain + digest).digest()[:KEY]
                keys.append(chain)
                sums.append(before)
                before += size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary()), pa.array(parents, pa.binary()), pa.array(sums, pa.int64())],
                                             names=["conv_id", "block", "depth", "digest", "chars", "key", "parent", "before"])

    n = partitions(turns)
    dealt = turns.select("conv_id", F.expr(f"(place - 1) div {block}").alias("block"), F.col("place").alias("depth"), "digest", "chars")
    dealt = dealt.repartition(n, "conv_id", "block").sortWithinPartitions("conv_id", "block", "depth")
    local = stored(mapped(dealt, chained, "conv_id long, block long, depth long, digest binary, chars long, key binary, parent binary, before long"), "paths")

    # later blocks: key and characters of all blocks before, from one row per full block
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chain, before = None, ROOT, 0
        for batch in batches:
            out = []
            for conv, number, key, size in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if conv != at:
                    at, chain, before = conv, ROOT, 0
                chain, before = hashlib.sha256(chain + key).digest()[:KEY], before + size
                out.append({"conv_id": conv, "block": number + 1, "chain": chain, "ahead": before, "tail": key})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("chain", pa.binary()), ("ahead", pa.int64()), ("tail", pa.binary())]))

    full = local.filter(F.col("depth") % block == 0).select("conv_id", "block", "key", (F.col("before") + F.col("chars")).alias("size"))
    heads = mapped(full.repartition(n, "conv_id").sortWithinPartitions("conv_id", "block"), joined, "conv_id long, block long, chain binary, ahead long, tail binary")
    heads = stored(heads, "blocks")
    names = ["conv_id", "depth", "key", "parent", "digest", "chars", "before"]
    within = lambda key: F.substring(F.unhex(F.sha2(F.concat("chain", key), 256)), 1, KEY)
    # the parent of a block's first turn is the end of the block before: in the second block a plain key
    back = heads.select("conv_id", (F.col("block") + 1).alias("block"), F.col("chain").alias("back"))
    heads = heads.join(back, ["conv_id", "block"], "left").withColumn("up", F.when(F.col("back").isNull(), F.col("tail")).otherwise(
        F.substring(F.unhex(F.sha2(F.concat("back", "tail"), 256)), 1, KEY)))
    later = local.filter("block > 0").join(heads, ["conv_id", "block"]).select(
        "conv_id", "depth", within("key").alias("key"), F.when((F.col("depth") - 1) % block == 0, F.col("up")).otherwise(within("parent")).alias("parent"),
        "digest", "chars", (F.col("before") + F.col("ahead")).alias("before"))
    return local.filter("block = 0").select(*names).unionByName(later)


def end_lists(members: DataFrame) -> DataFrame:
    """key, part, conv_ids of the members (key, conv_id): ascending, in rows of at most ENDS numbers that many tasks make."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        schema = pa.schema([("key", pa.binary()), ("part", pa.int64()), ("conv_ids", pa.list_(pa.int64()))])
        for batch in batches:
            out = []
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (k != key or len(held) == ENDS):
                    out.append({"key": key, "part": held[0], "conv_ids": held})
                    held = []
                key = k
                held.append(c)
            yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist([{"key": key, "part": held[0], "conv_ids": held}], schema)

    dealt = members.select("key", "conv_id").repartitionByRange(partitions(members), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    return stored(mapped(dealt, run, "key binary, part long, conv_ids array<bigint>"), "ends")


def trie_of(ids: DataFrame, turns: DataFrame, block: int = BLOCK) -> Trie:
    """The trie of the conversations `ids` with the turns (conv_id, place from 1 without gaps, digest, chars)."""
    steps = stored(paths(turns, block), "prefixes")
    ends = steps.groupBy("conv_id").agg(F.max(F.struct("depth", "key", (F.col("before") + F.col("chars")).alias("total"))).alias("end"))
    members = stored(ids.join(ends, "conv_id", "left").select(
        "conv_id", F.coalesce("end.key", F.lit(ROOT)).alias("key"), F.coalesce("end.depth", F.lit(0)).alias("depth"),
        F.coalesce("end.total", F.lit(0)).alias("total")), "members")
    collapsed = members.groupBy("key", "depth", "total").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"))
    collapsed = stored(collapsed, "collapsed")
    proper = stored(steps.select(F.col("parent").alias("key")).distinct(), "proper")
    leaves = collapsed.join(proper, "key", "left_anti").select("key", F.lit(True).alias("leaf"))
    sequences = stored(collapsed.join(leaves, "key", "left").withColumn("leaf", F.coalesce("leaf", F.lit(False))), "sequences")

    facts = sequences.select("conv_id", "weight", "total", "leaf")
    roots = facts.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"),
                         F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("before"), "weight", "total", "leaf")
    weighted = stored(looked_up(steps, facts, "conv_id").unionByName(roots), "weighted")
    # Every turn below a node counts once per conversation (`moved`) ...
    grouped = stored(weighted.groupBy("key", "parent", "depth", "digest", "chars", "before").agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
        F.sum(F.expr("weight * (total - before)")).alias("moved")), "grouped")
    # ... less once per node: a sequence accounts for the nodes of which it is the smallest, the last ones on its path.
    own = grouped.groupBy("conv_id").agg(F.min("before").alias("own_from"))
    once = looked_up(weighted.select("conv_id", "key", "total", "before"), own, "conv_id").groupBy("key").agg(
        F.sum(F.expr("total - greatest(before, own_from)")).alias("once"))
    children = grouped.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(grouped.join(once, "key", "left").join(children, "key", "left").select(
        "key", "parent", "depth", "digest", "chars", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
        (F.col("moved") - F.coalesce("once", F.lit(0))).alias("saved")), "nodes")
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return Trie(looked_up(nodes, above, "parent", "left"), sequences.drop("total"), end_lists(members))


def conversation_trie(conversations: DataFrame, rebuild: bool = True) -> Trie:
    """The prefix trie of all conversations (conv_id, turn, role, text), rebuilt by `rebuilt` or as they are.

    Turns are ordered by number, null first, then by role and digest.  Null roles and texts count as empty; rows without
    conv_id belong to no conversation; repeated rows are turns of their own; other columns are ignored; an empty table gives
    an empty trie.  A conversation without turns ends at the root.  `saved` of a node sums (n_convs - 1) * chars over its
    subtree.  Prefixes are told apart by 128 bits of SHA-256.
    """
    places = numbered(conversations)
    return trie_of(*(rebuilt(places) if rebuild else (places.select("conv_id").distinct(), places)))


def with_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes with role and text of their last turn (null for the root)."""
    turns = filled(conversations).select(turn_digest().alias("digest"), "role", "text").groupBy("digest").agg(F.max("role").alias("role"), F.max("text").alias("text"))
    return looked_up(stored(nodes, "nodes"), turns, "digest", "left")


def ends_digest(ends: DataFrame) -> DataFrame:
    """key and ends_sha256: SHA-256 of all conv_ids of a key in decimal, ascending, joined by commas.

    A checksum has to read its bytes in order, so the rows of one key stream through one task; they hold ENDS sorted numbers
    each, and nothing but the checksum's state is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
        for batch in batches:
            out = []
            for k, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key or state is None:
                    if state is not None:
                        out.append({"key": key, "ends_sha256": state.hexdigest()})
                    key, state = k, hashlib.sha256(line)
                else:
                    state.update(b"," + line)
            yield pa.RecordBatch.from_pylist(out, schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"key": key, "ends_sha256": state.hexdigest()}], schema)

    lines = ends.select("key", "part", F.array_join(F.col("conv_ids").cast("array<string>"), ",").cast("binary").alias("line"))
    return mapped(lines.repartition(partitions(ends), "key").sortWithinPartitions("key", "part").select("key", "line"), run, "key binary, ends_sha256 string")
