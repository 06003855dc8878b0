"""Conversation prefix trie (operator 13): which turns conversations share from their start, and what a prefix cache saves.

A conversation is a path of turn digests; equal prefixes are one node. Paths are sorted over the cluster, so a shard holds
neighbours in that order and encodes its part of the trie as balanced parentheses: findclose over range min-max blocks
delimits every subtree, and sums over a subtree (members, leaves, savings) are differences of cumulative arrays.

Only the nodes on the first and the last path of a shard, its spines, can go on in another shard. They are kept back with
what their finished descendants add up to, and merged by the same function: spines of FAN neighbouring shards are the paths
of one shard of the next level, until one is left. So no task holds more than a bounded part of a shard or FAN spines, and
a prefix that all conversations share is a node in each shard. A conversation's turns (as digests) are in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlore.llm.common import scratch, session_setup, written
from runlore.llm.parens import BalancedParens

#: Shards whose spines are merged at once.
FAN = 256
#: Turns of paths in one encoding; a task encodes one after the other.
NODES = 200_000
#: Ids that are joined to one text before they are hashed by end node.
CHUNK = 4096
#: Bytes of a turn's digest.
WIDTH = 16
#: Salts of the join that gives children of spines the name of their parent.
SALTS = 16

PART = "struct<depth:int,convs:long,leaves:long,saved:long,children:long,least:long,ends:string>"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: A finished node, or a spine where path is set. name and parent name nodes: a digest of the path to them.
ROWS = f"{NODE}, name binary, parent binary, shard int, path binary, sizes array<long>, parts array<{PART}>"
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def common_depth(a: bytes, b: bytes) -> int:
    """Turns that two paths share from their start."""
    n, i = min(len(a), len(b)), 0
    while i < n and a[i : i + WIDTH] == b[i : i + WIDTH]:
        i += WIDTH
    return min(i, n) // WIDTH


class Shard:
    """Paths in order, each with the bytes of its turns and parts: what is known to belong to nodes on it."""

    def __init__(self):
        self.paths: list[tuple[bytes, list[int]]] = []
        self.turns = 0
        self.bits, self.depth, self.size, self.parent, self.name = bytearray(), [], [], [], []
        self.convs, self.leaves, self.saved, self.children, self.least, self.ends = [], [], [], [], [], []
        self.stack: list[int] = []

    def add(self, path: bytes, sizes: list[int], parts: list[dict]) -> None:
        depth = len(path) // WIDTH
        shared = common_depth(self.paths[-1][0], path) if self.paths else -1
        self.bits += b"\0" * (len(self.stack) - 1 - shared) + b"\1" * (depth - shared)
        del self.stack[shared + 1 :]
        for d in range(shared + 1, depth + 1):
            # A node is named by a digest of the path to it, made from its parent's.
            above = self.name[self.stack[-1]] + path[WIDTH * (d - 1) : WIDTH * d] if d else b""
            self.name.append(xxhash.xxh3_128_digest(above))
            self.parent.append(self.stack[-1] if d else 0)
            self.stack.append(len(self.depth))
            self.depth.append(d)
            self.size.append(sizes[d - 1] if d else 0)
            for column in (self.convs, self.leaves, self.saved, self.children):
                column.append(0)
            self.least.append(None)
            self.ends.append(None)
        for x in parts:
            node = self.stack[x["depth"]]
            self.convs[node] += x["convs"]
            self.leaves[node] += x["leaves"]
            self.saved[node] += x["saved"]
            self.children[node] += x["children"]
            if x["least"] is not None and (self.least[node] is None or x["least"] < self.least[node]):
                self.least[node] = x["least"]
            self.ends[node] = x["ends"] or self.ends[node]
        if not self.paths:
            self.first_nodes = list(self.stack)
        self.paths[1:] = [(path, sizes)]  # the first and the last
        self.turns += depth + 1

    def rows(self, shard: int, top: bool, named: bool) -> Iterator[tuple]:
        """The nodes that are finished, named if they were spines before, and unless it is the top the spines."""
        if not self.paths:
            return
        last_nodes = self.stack
        bits = np.frombuffer(bytes(self.bits + b"\0" * len(self.stack)), np.uint8).astype(bool)
        trie = BalancedParens(bits)
        end = trie.subtree_ends()
        own = np.arange(len(end))
        spine = np.zeros(len(end), bool)
        if not top:
            spine[self.first_nodes] = True
            spine[last_nodes] = True
        depth, parent, sizes = (np.array(x, np.int64) for x in (self.depth, self.parent, self.size))
        kept_children = np.array(self.children, np.int64)

        def below(values: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values)])
            return total[end] - total[own]

        convs = below(np.array(self.convs, np.int64))
        leaf = trie.childless() & (kept_children == 0) & ~spine
        leaves = below(np.array(self.leaves, np.int64) + leaf)
        saved = below(np.array(self.saved, np.int64) + np.where(spine, 0, (convs - 1) * sizes))
        finished_children = kept_children.copy()
        np.add.at(finished_children, parent[1:], ~spine[1:])
        least = self.least
        for i in range(len(least) - 1, 0, -1):
            up = self.parent[i]
            if least[i] is not None and (least[up] is None or least[i] < least[up]):
                least[up] = least[i]

        for i in own[~spine].tolist():
            up = self.parent[i]
            known = not spine[up]
            above = least[up] if i and known else None
            counts = int(convs[i]), int(finished_children[i]), int(leaves[i]), int(saved[i])
            yield (least[i], self.depth[i], above, *counts, self.ends[i] or _NO_ENDS, self.name[i] if named else None, None if known else self.name[up], shard, None, None, None)
        if top:
            return
        # What a spine node has without its children on spines.
        alone = {k: v.copy() for k, v in (("convs", convs), ("leaves", leaves), ("saved", saved))}
        inner = own[spine & (own > 0)]
        for k, v in (("convs", convs), ("leaves", leaves), ("saved", saved)):
            np.subtract.at(alone[k], parent[inner], v[inner])
        done = -1
        for (path, sizes_), nodes in zip(self.paths, (self.first_nodes, last_nodes), strict=False):
            parts = [
                {"depth": int(depth[i]), **{k: int(v[i]) for k, v in alone.items()}, "children": int(finished_children[i]), "least": least[i], "ends": self.ends[i]}
                for i in nodes[done + 1 :]
            ]
            yield (*[None] * 10, shard, path, sizes_, parts)
            done = common_depth(self.paths[0][0], self.paths[-1][0])


def _encoded(rows: Iterable[tuple[bytes, list[int], list[dict]]], shard: int, top: bool, named: bool, bound: int) -> Iterator[tuple]:
    """Rows of sorted paths. At the bound an encoding ends and another begins; the spines of all are merged at the end."""
    now, spines = Shard(), []
    for row in rows:
        if now.turns >= bound:
            for x in now.rows(shard, False, named):
                spines.append(x[11:]) if x[11] is not None else (yield x)
            now = Shard()
        now.add(*row)
    if not spines:
        yield from now.rows(shard, top, named)
        return
    for x in now.rows(shard, False, named):
        spines.append(x[11:]) if x[11] is not None else (yield x)
    whole = Shard()
    for x in spines:
        whole.add(*x)
    yield from whole.rows(shard, top, True)


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: of every conversation the digest and the text's bytes of each turn, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct("turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    own = conversations.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id"))
    return own.agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def rebuilt(turns: DataFrame, block: int = 5, most: int = 9) -> DataFrame:
    """Of every conversation c of conversation_turns: the first h turns of conversation c - c % block (none if there is
    none), then its own after its first h; h is the crc32 of its decimal id modulo most."""
    lead = turns.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("lead"))
    own = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % most).cast("int"))
    after = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    before = F.when(F.col("lead").isNull(), F.slice("turns", 1, F.lit(0))).otherwise(F.slice("lead", F.lit(1), F.col("h")))
    return own.join(lead, "base", "left").select("conv_id", F.concat(before, after).alias("turns"))


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by path and conv_id: path, sizes, first, ids: up to CHUNK ids of a path, comma-joined."""
    path, sizes, ids, out = None, None, [], []

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()), strict=True)], ["path", "sizes", "first", "n", "ids"])

    for b in batches:
        for conv_id, p, s in zip(*(b.column(i) for i in range(3)), strict=True):
            conv_id, p = conv_id.as_py(), p.as_py()
            if ids and (p != path or len(ids) == CHUNK):
                out.append((path, sizes, ids[0], len(ids), ",".join(map(str, ids))))
                ids = []
            if not ids:
                path, sizes = p, s.as_py()
            ids.append(conv_id)
        if len(out) >= 256:
            yield batch(out)
            out = []
    if ids:
        out.append((path, sizes, ids[0], len(ids), ",".join(map(str, ids))))
    if out:
        yield batch(out)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[int], list[dict]]]:
    """Of rows of _joined_ids sorted by path and first: each path once, with the digest of all ids that end there."""
    path = None
    for b in batches:
        for p, s, first, n, ids in zip(*(b.column(i) for i in range(5)), strict=True):
            p = p.as_py()
            if p != path:
                if path is not None:
                    yield path, sizes, [part | {"ends": sha.hexdigest()}]
                path, sizes, sha = p, s.as_py(), hashlib.sha256()
                part = {"depth": len(p) // WIDTH, "convs": 0, "leaves": 0, "saved": 0, "children": 0, "least": first.as_py()}
            else:
                sha.update(b",")
            sha.update(ids.as_py().encode())
            part["convs"] += n.as_py()
    if path is not None:
        yield path, sizes, [part | {"ends": sha.hexdigest()}]


_PART_TYPE = pa.struct([(x.split(":")[0], pa.string() if x.endswith("string") else pa.int32() if x.endswith("int") else pa.int64()) for x in PART[7:-1].split(",")])
_TYPES = [*[pa.int64()] * 7, pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(_PART_TYPE)]
_NAMES = [x.split()[0] for x in ROWS.split(", ")]


def _batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    out = []
    for x in rows:
        out.append(x)
        if len(out) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _NAMES)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _NAMES)


def prefix_trie(conversations: DataFrame, change: Callable[[DataFrame], DataFrame] | None = None, nodes: int = NODES) -> DataFrame:
    """A row for each distinct sequence of first turns of conversations (conv_id, turn, role, text): conv_id (least
    member), depth, parent_conv_id (null for the root, which has no turn), n_convs, n_children, n_leaves (childless nodes
    of its subtree, itself included), saved_tokens (over its subtree, members but one times the bytes of the last text) and
    ends_sha256 (of the decimal ids of the conversations that end there, ascending, comma-joined).

    Turns go by turn, null first; ties by digest. A null role or text is empty. Rows without a conv_id are in no
    conversation; repeated rows are turns of their own; other columns are ignored. Conversations without turns end at the
    root. A table without conversations gives no row, not even a root. Turns are compared by 128-bit digests of role and
    text. change: what is done to conversation_turns first. nodes bounds an encoding; the result does not depend on it.
    """
    spark = conversations.sparkSession
    session_setup(spark)
    path = F.unhex(F.array_join(F.transform("turns", lambda x: x["digest"]), ""))

    def first_level(batches):
        yield from _batches(_encoded(_ends(batches), TaskContext.get().partitionId(), False, False, nodes))

    def level(top):
        def run(table: pa.Table) -> pa.Table:
            shard = table.column("group")[0].as_py()
            rows = zip(*(table.column(c).to_pylist() for c in ("path", "sizes", "shard", "parts")), strict=True)
            # Parts of one path from two shards add up, so the order of equal paths does not matter.
            merged = [(p, s, parts) for p, s, _, parts in sorted(rows, key=lambda x: (x[0], x[2]))]
            out = list(_batches(_encoded(merged, shard, top, True, nodes)))
            return pa.Table.from_batches(out) if out else pa.table([pa.array([], t) for t in _TYPES], _NAMES)

        return run

    with scratch(spark):
        turns = written(conversation_turns(conversations), "turns")
        turns = change(turns) if change else turns
        paths = written(turns.select("conv_id", path.alias("path"), F.transform("turns", lambda x: x["bytes"]).alias("sizes")), "paths")
        # Ids of a path that many conversations have are joined up in many tasks before they meet in one.
        ids = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
        ids = written(ids.mapInArrow(_joined_ids, "path binary, sizes array<long>, first long, n long, ids string"), "ids")
        ids = ids.repartitionByRange("path").sortWithinPartitions("path", "first").select("path", "sizes", "first", "n", "ids")
        rows = written(ids.mapInArrow(first_level, ROWS), "level0")
        done = [rows.where("path is null")]
        spines = rows.where("path is not null")
        last = spines.agg(F.max("shard")).first()[0]
        while last is not None:
            top = last < FAN
            grouped = spines.select(F.expr(f"shard div {FAN}").cast("int").alias("group"), "path", "sizes", "shard", "parts").groupBy("group")
            rows = written(grouped.applyInArrow(level(top), ROWS), f"level{len(done)}")
            done.append(rows.where("path is null"))
            spines, last = rows.where("path is not null"), None if top else last // FAN
        found = done[0]
        for more in done[1:]:
            found = found.unionByName(more)
        # Children that were finished before their parent take its name's conv_id. A parent can have very many: its row goes
        # to SALTS places and its children are dealt over them. Parents are spines, a few for each shard.
        above = found.where("name is not null").select(F.col("name").alias("parent"), F.col("conv_id").alias("above"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        open_ = found.where("parent is not null").withColumn("salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)).cast("int"))
        columns = [x.split()[0] for x in NODE.split(", ")]
        open_ = open_.join(above, ["parent", "salt"]).withColumn("parent_conv_id", F.col("above")).select(columns)
        return written(found.where("parent is null").select(columns).unionByName(open_), "trie", keep=True)
