"""Prefix tries of conversations: a node for each distinct beginning, subtree totals by messages from the leaves up."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.llm.common import discard, materialize, partitions

#: Places of a conversation or path that one window takes; longer ones are carried on from block to block.
BLOCK = 1_024

#: Ids that one row of an end list holds at most.
END_IDS = 256

KEY = ["depth", "a", "b"]


def running(rows: DataFrame, group: list[str], place: str, totals: dict[str, str]) -> DataFrame:
    """``rows`` with the columns of ``totals`` (column: ``bit_xor`` or ``sum``) run up over ``place`` within ``group``.

    A window takes a block of :data:`BLOCK` places, however many a group has;
    the totals of the blocks before are joined on.
    """
    call = lambda c: getattr(F, totals[c])(c)
    rows = rows.withColumn("block", F.floor(F.col(place) / BLOCK))
    inner = Window.partitionBy(*group, "block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group, "block").agg(*(call(c).alias(c) for c in totals))
    carried = sums.select(*group, "block", *(call(c).over(before).alias(f"{c}_before") for c in totals)).filter(F.col(f"{next(iter(totals))}_before").isNotNull())
    both = rows.withColumns({c: call(c).over(inner) for c in totals}).join(carried, [*group, "block"], "left")
    add = {"bit_xor": lambda x, y: x.bitwiseXOR(y), "sum": lambda x, y: x + y}
    return both.withColumns({c: add[how](F.col(c), F.coalesce(f"{c}_before", F.lit(0))) for c, how in totals.items()}).drop("block", *(f"{c}_before" for c in totals))


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1, digest, n_bytes) of each row of ``conversations`` (conv_id, turn, role, text).

    Turns come in the order of ``turn``, null first; ties in that of the
    SHA-256 of role and text, and rows that repeat stay as many turns. Null
    roles and texts are empty; rows without a conv_id belong to none and go.
    Only digests and lengths travel, texts stay at the scan. Rows are sorted
    by range, so that a conversation of any length spans as many tasks as it
    needs; a place is the row's rank less that of its conversation's first.
    """
    spark = conversations.sparkSession
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "digest"]
    placed = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed = materialize(placed.drop("turn").withColumn("at", F.monotonically_increasing_id()), "turns")
    part = F.shiftright("at", 33).alias("part")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # a row a partition
    ranked = placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1))
    first = ranked.groupBy("conv_id").agg(F.min("rank").alias("first"))
    return ranked.join(first, "conv_id").select("conv_id", (F.col("rank") - F.col("first") + 1).alias("place"), "digest", "n_bytes")


def grafted(turns: DataFrame, base: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """``turns`` of :func:`numbered` rebuilt: the first ``heads`` turns of conversation ``base``, then the own turns after as many; and (conv_id, length).

    ``base`` and ``heads`` are expressions of conv_id; heads are at most
    ``most``, so that a conversation lends no more than that to each other.
    One with fewer turns than ``heads`` lends all, an absent one none.
    """
    turns = materialize(turns, "numbered")
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    told = lengths.select("conv_id", "n", base.cast("long").alias("base"), heads.cast("long").alias("heads"))
    lent = F.least("heads", F.coalesce("base_n", F.lit(0)))
    convs = told.join(lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left").select(
        "conv_id", "base", "heads", lent.alias("lent"), (lent + F.greatest(F.col("n") - F.col("heads"), F.lit(0))).alias("length")
    )
    convs = materialize(convs, "conversations")
    own = turns.join(convs, "conv_id").filter("place > heads").select("conv_id", (F.col("place") - F.col("heads") + F.col("lent")).alias("place"), "digest", "n_bytes", "length")
    lenders = turns.filter(F.col("place") <= most).withColumnRenamed("conv_id", "base")
    head = lenders.join(convs, "base").filter("place <= heads").select("conv_id", "place", "digest", "n_bytes", "length")
    return own.unionByName(head), convs.select("conv_id", "length")


def nodes_of(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie's nodes, and (depth, a, b, conv_id) of the node where each conversation ends.

    A node's key is its depth and the exclusive or of two 64-bit hashes of
    (place, digest) over its turns, run up along each conversation: equal
    beginnings have equal keys, others differ but by a chance below 1e-16 for
    1e11 nodes. ``path`` is the member of the smallest hashed id.
    """
    turns = turns.withColumns({"own_a": F.xxhash64(F.lit(1), "place", "digest"), "own_b": F.xxhash64(F.lit(2), "place", "digest")}).drop("digest")
    turns = running(turns.withColumns({"a": F.col("own_a"), "b": F.col("own_b")}), ["conv_id"], "place", {"a": "bit_xor", "b": "bit_xor"})
    turns = materialize(turns.withColumnRenamed("place", "depth"), "beginnings")
    chosen = F.min(F.struct(F.xxhash64("conv_id"), "conv_id"))["conv_id"].alias("path")
    members = [F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), chosen]
    nodes = turns.groupBy(*KEY).agg(*members, F.min("n_bytes").alias("n_bytes"), F.min("own_a").alias("own_a"), F.min("own_b").alias("own_b"))
    nodes = nodes.select(*KEY, "n_convs", "conv_id", "path", "n_bytes", F.col("a").bitwiseXOR(F.col("own_a")).alias("pa"), F.col("b").bitwiseXOR(F.col("own_b")).alias("pb"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = lengths.agg(*members).filter("n_convs > 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "n_convs", "conv_id", "path", zero.alias("n_bytes"), none.alias("pa"), none.alias("pb"))
    ends = turns.filter("depth = length").select(*KEY, "conv_id").unionByName(lengths.filter("length = 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id"))
    return materialize(nodes.unionByName(root), "nodes"), ends


def end_digests(ends: DataFrame) -> DataFrame:
    """``ends_sha256`` by node: of its ids in order, comma-joined.

    Ids are joined by ranges of :data:`END_IDS` first, so that a node where a
    third of all conversations end is a stream of short rows to one hash,
    never one row or group in memory.
    """
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    told = ends.groupBy(*KEY, F.floor(F.col("conv_id") / END_IDS).alias("stretch")).agg(ids.alias("ids"))
    stream = told.repartition(partitions(ends.sparkSession), *KEY).sortWithinPartitions(*KEY, "stretch")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running_hash = None, None
        for batch in batches:
            out = []
            for d, a, b, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
                if (d, a, b) == key:
                    running_hash.update(b",")
                else:
                    if key:
                        out.append((*key, running_hash.hexdigest()))
                    key, running_hash = (d, a, b), hashlib.sha256()
                running_hash.update(ids.encode())
            yield _ended(out)
        if key:
            yield _ended([(*key, running_hash.hexdigest())])

    return stream.mapInArrow(digests, "depth long, a long, b long, ends_sha256 string")


def _ended(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [*KEY, "ends_sha256"])


def peeled(paths: DataFrame) -> DataFrame:
    """(path, parent, top, leaves, saved) with whole subtrees, from (path, parent, top, leaves, saved) of the paths alone.

    Leaf peeling: each path holds a counter of the child paths that it still
    waits for. Those at zero are complete, send their totals to their parents
    and leave the table; a round pre-aggregates the messages by parent, adds
    them and takes as much off the counters, until the root alone has been
    complete. The table of each round is written; earlier ones hold only what
    was complete.
    """
    spark = paths.sparkSession
    waiting = paths.filter("parent is not null").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("waits"))
    state = materialize(paths.join(waiting, "path", "left").withColumn("waits", F.coalesce("waits", F.lit(0))), "peel")
    complete = []
    while not state.isEmpty():
        done = state.filter("waits = 0")
        complete.append(done.drop("waits"))
        sent = done.filter("parent is not null").groupBy(F.col("parent").alias("path")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count("*").alias("heard"))
        state = state.filter("waits > 0").join(sent, "path", "left").select(
            "path", "parent", "top", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")), (F.col("waits") - F.coalesce("heard", F.lit(0))).alias("waits")
        )
        state = materialize(state, "peel")
    if not complete:
        return paths
    out = complete[0]
    for more in complete[1:]:
        out = out.unionByName(more)
    out, old = materialize(out, "subtrees"), out
    discard(spark, *{f.rpartition("/")[0] for f in old.inputFiles()})
    return out


def build(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row for each node of the trie of ``turns`` (conv_id, place, digest, n_bytes, length) and ``lengths`` (conv_id, length) of all conversations.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (sum over the subtree of (n_convs - 1) * n_bytes)
    and ends_sha256. An empty table has no node, conversations without turns
    are members of the root alone.

    A node of depth d goes to the path of the member of the smallest hashed
    id, so paths are stretches of conversations: unary chains take no round
    each, and as the choice is random, one meets about ln(conversations)
    paths from any leaf to the root, whatever the trie's shape. Messages run
    between paths (:func:`peeled`), running sums from the far end of each
    path share the totals out to its nodes.
    """
    nodes, ends = nodes_of(turns, lengths)
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("parent_path"))
    linked = nodes.join(children, KEY, "left").join(parents, ["depth", "pa", "pb"], "left").join(end_digests(ends), KEY, "left").select(
        *KEY, "conv_id", "path", "n_convs", "parent_conv_id", "parent_path", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        F.when(F.coalesce("n_children", F.lit(0)) == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
    )
    linked = materialize(linked, "linked")
    parent = F.min(F.when(F.col("parent_path") != F.col("path"), F.col("parent_path"))).alias("parent")
    totals = peeled(linked.groupBy("path").agg(parent, F.min("depth").alias("top"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    heard = totals.filter("parent is not null").groupBy(F.col("parent").alias("path"), (F.col("top") - 1).alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    valued = linked.join(heard, ["path", "depth"], "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")}).drop("more_leaves", "more_saved")
    summed = running(valued.withColumn("up", -F.col("depth")), ["path"], "up", {"leaves": "sum", "saved": "sum"})
    return summed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256")
