"""The prefix trie of conversations, by union-find over sorted neighbours.

Distinct turn sequences are sorted and cut into ranges. In a range, neighbours are joined by edges as deep as their
longest common prefix; edges are taken in descending depth, and every merge of components makes a branching node
(or adds a child to one of that depth). Nodes between two merges have one child each and are written along the way.
Only the prefixes that a range shares with the ranges beside it are unfinished there: a range gives these few
nodes, its contracted forest, with partial sums, and they are merged across the boundaries by their prefix.

Every node is owned by the first range that holds it, so sums over distinct nodes (children, leaves, text lengths)
add up over ranges without counting any node twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandlake.llm.shared import read_table, stage

#: turns of distinct sequences in a range, about
RANGE_TURNS = 200_000
#: ids written out in one piece for the hash of a node's ends
ENDS_TOGETHER = 1 << 15
BASE_EVERY, MAX_BASE_TURNS = 100, 6
NODES = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
         "saved_tokens bigint, sequence string, node string, parent string")
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


# -- sequences ---------------------------------------------------------------------

def turn_sequences(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """(conv_id, turns) for every id that is not null: turns are structs (id, size) in the order of ``turn_col``
    (null first; equal turns by role, then by a hash). ``id`` is the MD5 value of role and text, ``size`` the text's
    code points; null roles and texts are empty. One conversation is one row of 40 bytes a turn, without texts."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), role.alias("role"),
                 F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("id"),
                 F.length(text).cast("bigint").alias("size")).alias("t"))
    turns = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t["id"], t["size"])).alias("turns"))


def rebuild(sequences: DataFrame) -> DataFrame:
    """``sequences`` with the first h turns of every conversation c replaced by the first h of conversation
    c - c % 100 (all if fewer, none if absent); h is the CRC-32 of c as text, modulo 6."""
    c = F.col("conv_id")
    bases = sequences.filter(c % BASE_EVERY == 0).select(
        c.alias("base"), F.slice("turns", 1, MAX_BASE_TURNS - 1).alias("first"))
    h = (F.crc32(c.cast("string").cast("binary")) % MAX_BASE_TURNS).cast("int")
    rows = sequences.withColumn("base", c - c % BASE_EVERY).join(bases, "base", "left")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return rows.select("conv_id", F.concat(F.coalesce(F.slice("first", F.lit(1), h), F.array()), own).alias("turns"))


# -- forest of one range -----------------------------------------------------------

class Component:
    """Neighbouring sequences ``first .. last`` and the node at ``depth`` that is being built from them."""

    __slots__ = ("first", "last", "depth", "n", "low", "children", "leaves", "saved", "end", "waiting")

    def __init__(self, i: int, depth: int, n: int, low: int, leaf: bool):
        self.first = self.last = self.end = i
        self.depth, self.n, self.low = depth, n, low
        self.children, self.leaves, self.saved = 0, int(leaf), 0
        self.waiting: list[list] = []  # nodes whose parent this node will be

    def take(self, other: Component) -> None:
        self.first, self.last = min(self.first, other.first), max(self.last, other.last)
        self.n += other.n
        self.low = min(self.low, other.low)
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.end = other.end if self.end is None else self.end
        if len(other.waiting) > len(self.waiting):
            self.waiting, other.waiting = other.waiting, self.waiting
        self.waiting += other.waiting


def common_prefix(a: list[str], b: list[str]) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def _prefix_names(ids: list[str], depth: int) -> list[str]:
    """Names of the prefixes of 0 .. ``depth`` turns."""
    h, out = hashlib.sha256(), []
    for k in range(depth + 1):
        out.append(h.hexdigest())
        if k < depth:
            h.update(ids[k].encode())
    return out


def forest(ids: list[list[str]], sizes: list[list[int]], n: list[int], low: list[int], names: list[str],
           left: int, right: int) -> list[list]:
    """The nodes (``NODES``) over sorted distinct sequences of a range, each with its copies ``n`` and smallest id
    ``low``. ``left`` and ``right`` are the turns shared with the sequence before and after the range (-1: none).
    Nodes that reach over an edge of the range have a ``node`` name and hold only the range's share."""
    k = len(ids)
    shared = [-1] + [common_prefix(a, b) for a, b in zip(ids, ids[1:], strict=False)] + [right]
    at_left, at_right = _prefix_names(ids[0], max(left, 0)), _prefix_names(ids[-1], max(right, 0))
    root = list(range(k))
    parts = [Component(i, len(ids[i]), n[i], low[i], shared[i + 1] < len(ids[i])) for i in range(k)]
    nodes: list[list] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def rise(c: Component, depth: int) -> None:
        """Writes the nodes of ``c`` deeper than ``depth``; it then builds the node at ``depth``."""
        while c.depth > depth:
            d = c.depth
            foreign = c.first == 0 and d <= left
            name = at_left[d] if foreign else at_right[d] if c.last == k - 1 and d <= right else None
            c.saved += (sizes[c.first][d - 1] if d else 0) * (c.n if foreign else c.n - 1)
            node = [c.low, d, None, c.n, c.children, c.leaves, c.saved, None if c.end is None else names[c.end],
                    name, None]
            for child in c.waiting:
                child[2], child[9] = (c.low, None) if name is None else (None, name)
            nodes.append(node)
            c.waiting, c.depth, c.children, c.end = [node], d - 1, int(not foreign), None

    for i in sorted(range(1, k), key=lambda i: -shared[i]):
        a, b = find(i - 1), find(i)
        rise(parts[a], shared[i])
        rise(parts[b], shared[i])
        parts[a].take(parts[b])
        root[b] = a
    rise(parts[find(0)], -1)
    return nodes


# -- ranges ------------------------------------------------------------------------

def _shared_turns(a: str, b: str) -> Column:
    """Length of the common prefix of two arrays of distinct sequences; -1 where one is null."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.coalesce(F.when(differs == 0, F.size(a)).otherwise(differs - 1), F.lit(-1)).cast("bigint")


def range_forests(distinct: DataFrame) -> DataFrame:
    """``NODES`` of each range of the distinct sequences (sequence, ids, sizes, n, low)."""
    turns = distinct.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    rows = distinct.repartitionByRange(max(1, -(-turns // RANGE_TURNS)), "ids").withColumn("part", F.spark_partition_id())
    rows = stage(rows, "ranges")
    edges = rows.groupBy("part").agg(F.min("ids").alias("first"), F.max("ids").alias("last"))
    by = Window.orderBy("part")  # a row for each range
    edges = edges.withColumn("before", F.lag("last").over(by)).withColumn("after", F.lead("first").over(by)).select(
        "part", _shared_turns("before", "first").alias("left"), _shared_turns("last", "after").alias("right"))

    def run(t: pa.Table) -> pa.Table:
        cols = {c: t.column(c).to_pylist() for c in t.column_names}
        order = sorted(range(len(t)), key=cols["ids"].__getitem__)
        pick = [[cols[c][i] for i in order] for c in ("ids", "sizes", "n", "low", "sequence")]
        nodes = forest(*pick, cols["left"][0], cols["right"][0])
        names = [c.split()[0] for c in NODES.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.string()] * 3
        return pa.table([pa.array([x[j] for x in nodes], kind) for j, kind in enumerate(kinds)], names)

    return rows.join(edges, "part").groupBy("part").applyInArrow(run, NODES)


def merge_forests(nodes: DataFrame) -> DataFrame:
    """The nodes of all ranges as one trie (``NODES`` without the names): nodes named alike are one."""
    nodes = stage(nodes, "forests")
    total = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    joined = nodes.filter("node is not null").groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), *total, F.max("sequence").alias("sequence"),
        F.max("parent").alias("parent"))
    joined = stage(joined, "joined")
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "sequence"]
    heads = joined.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.filter("node is null and parent is not null").select(*columns, "parent").union(
        joined.select(*columns, "parent"))
    inside = nodes.filter("node is null and parent is null").select(*columns, "parent_conv_id")
    return inside.union(below.join(heads, "parent", "left").select(*columns, "parent_conv_id"))


def ends_hashes(rows: DataFrame) -> DataFrame:
    """(sequence, ends_sha256): SHA-256 of the ascending comma-joined conv_ids of each sequence. Ids are sorted over
    all tasks and written out in pieces, so the ids of many copies are never held together."""

    def by_sequence(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator]]:
        pairs = (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(),
                                                 b.column(b.num_columns - 1).to_pylist(), strict=True))
        return groupby(pairs, key=lambda x: x[0])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few in _pieces(by_sequence(batches)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in few]), pa.array([ids[0] for _, ids in few], pa.int64()),
                 pa.array([",".join(map(str, ids)) for _, ids in few])], ["sequence", "first", "text"])

    def _pieces(groups) -> Iterator[list]:
        few, size = [], 0
        for sequence, rows in groups:
            ids: list[int] = []
            for _, conv_id, _ in rows:
                ids.append(conv_id)
                size += 1
                if size >= ENDS_TOGETHER:
                    yield [*few, (sequence, ids)]
                    few, ids, size = [], [], 0
            if ids:
                few.append((sequence, ids))
        if few:
            yield few

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, str]] = []
        for sequence, rows in by_sequence(batches):
            h, sep = hashlib.sha256(), ""
            for _, _, text in rows:
                h.update((sep + text).encode())
                sep = ","
            out.append((sequence, h.hexdigest()))
            if len(out) >= ENDS_TOGETHER:
                yield pa.RecordBatch.from_pylist([dict(zip(("sequence", "ends_sha256"), x, strict=True)) for x in out])
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(("sequence", "ends_sha256"), x, strict=True)) for x in out])

    rows = rows.select("sequence", "conv_id").repartitionByRange("sequence", "conv_id").sortWithinPartitions(
        "sequence", "conv_id")
    pieces = rows.mapInArrow(write, "sequence string, first bigint, text string")
    pieces = pieces.repartition("sequence").sortWithinPartitions("sequence", "first")
    return pieces.mapInArrow(digest, "sequence string, ends_sha256 string")


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row per node (``COLUMNS``) of the trie of ``sequences`` (conv_id, turns: array of (id, size)), from the root
    of no turns: smallest member, depth, the parent's smallest member (root: null), members, children, childless
    nodes below or at it, the sum over its subtree of (members - 1) * size, and the hash of the ids that end there.

    Equal sequences are counted before they are sorted, so copies cost one row. Sequences without turns end at the
    root. Very long sequences are one row each. No sequences: no nodes. Extra columns are ignored."""
    rows = sequences.select("conv_id", F.col("turns")["id"].alias("ids"), F.col("turns")["size"].alias("sizes"))
    rows = stage(rows.withColumn("sequence", F.sha2(F.array_join("ids", ""), 256)), "sequences")
    distinct = rows.groupBy("sequence").agg(F.count("*").alias("n"), F.min("conv_id").alias("low"),
                                            F.min(F.struct("ids", "sizes")).alias("s"))
    distinct = stage(distinct.select("sequence", "s.ids", "s.sizes", "n", "low"), "distinct")
    nodes = merge_forests(range_forests(distinct))
    ends = ends_hashes(rows)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = nodes.join(ends, "sequence", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    return out.select(*COLUMNS)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """``prefix_trie`` of the rebuilt conversations. Rows of null conv_id belong to no conversation and are left out;
    null roles and texts are empty; repeated rows are turns of their own, ordered by role and a hash; an empty
    table gives no rows; extra columns, whatever their names, are ignored."""
    return prefix_trie(rebuild(turn_sequences(conversations)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(read_table(spark, sf_dir, "conversations"))
