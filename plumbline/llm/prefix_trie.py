"""Trie of conversation prefixes, built as a Patricia tree over sorted conversations."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import store

#: Bytes of a turn's digest: a conversation's path is the digests of its turns, one after another.
DIGEST = 16
#: Ids of one end that are joined to a piece of text before they are hashed.
PIECE_IDS = 10_000
NO_ENDS = hashlib.sha256(b"").hexdigest()

#: A point of the tree; a sorted row (a path with its points); an edge from its lowest node up.
POINT = [("depth", pa.int64()), ("n", pa.int64()), ("leaves", pa.int64()), ("children", pa.int64()), ("saved", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.string())]
ROW = [("path", pa.binary()), ("sizes", pa.list_(pa.int64())), ("points", pa.list_(pa.struct(POINT)))]
EDGE = [("bottom", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64())]
EDGE += [("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.list_(pa.int64())), ("ends", pa.string())]
WALKED = (
    "edge struct<bottom: binary, parent: binary, depth: long, conv_id: long, n_convs: long, n_children: long, n_leaves: long, saved: array<long>, ends: string>, "
    "open struct<path: binary, sizes: array<long>, points: array<struct<depth: long, n: long, leaves: long, children: long, saved: long, conv_id: long, ends: string>>>"
)


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """conv_id, path (digests of its turns), sizes (UTF-8 bytes of their texts) of every conversation after regrafting.

    Conversation c begins with the first h turns of conversation c - c % family, all if it has fewer and none if it is
    absent, and goes on with its own turns after its first h; h is the crc32 of c in decimal, modulo ``most``.
    Turns are taken by number, null first; equal numbers by the digest of role and text. Null roles and texts are
    empty. Rows without a conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turn = F.struct(F.col("turn").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    own = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("own"))
    heads = own.select(F.col("conv_id").alias("head"), F.slice("own", 1, most - 1).alias("first"))
    told = own.withColumns({"head": F.col("conv_id") - F.col("conv_id") % family, "h": F.crc32(F.col("conv_id").cast("string")) % most})
    h = F.col("h").cast("int")
    both = F.concat(F.slice(F.coalesce("first", F.slice("own", 1, 0)), F.lit(1), h), F.slice("own", h + 1, F.size("own")))
    made = told.join(heads, "head", "left").select("conv_id", both.alias("all"))
    return made.select("conv_id", F.expr("unhex(array_join(transform(all, x -> hex(x.digest)), ''))").alias("path"), F.expr("transform(all, x -> x.bytes)").alias("sizes"))


def _ends(convs: DataFrame) -> DataFrame:
    """path, ends: hash of the ascending ids of the conversations that are equal to the path.

    Ids are dealt by ranges of (path, id), so that a frequent conversation is spread out, and joined to pieces of text there; one
    task then hashes the pieces of a path as they come.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path, ids in batch.groupby("path", sort=False)["conv_id"]:
                numbers = ids.tolist()
                found += [(path, part[0], ",".join(map(str, part))) for part in (numbers[i : i + PIECE_IDS] for i in range(0, len(numbers), PIECE_IDS))]
            yield pd.DataFrame(found, columns=["path", "first", "ids"])

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, hashed = None, None
        for batch in batches:
            out = []
            for path, ids in zip(batch["path"], batch["ids"], strict=True):
                if path == now:
                    hashed.update(b"," + ids.encode())
                    continue
                if hashed:
                    out.append((now, hashed.hexdigest()))
                now, hashed = path, hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=["path", "ends"])
        if hashed:
            yield pd.DataFrame([(now, hashed.hexdigest())], columns=["path", "ends"])

    names = convs.select(F.unhex(F.sha2("path", 256)).alias("path"), "conv_id")
    parts = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = names.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    cut = dealt.mapInPandas(pieces, "path binary, first long, ids string")
    return cut.repartition("path").sortWithinPartitions("path", "first").mapInPandas(digests, "path binary, ends string")


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with together."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * DIGEST] == b[: mid * DIGEST] else (low, mid - 1)
    return low


class Patricia:
    """Closes the points (branches, ends and leaves) of a Patricia tree while paths come in ascending order.

    The stack holds the points on the last path, each with what is below it so far. When the next path leaves it at some depth,
    deeper points are complete: each gives one edge, from below the next point above to itself, and is added to that.
    ``edge`` says what happens to a complete point. With ``open_ends`` the points on the first and the last path are kept aside as
    rows, since paths in other partitions may also pass through them.
    """

    def __init__(self, open_ends: bool):
        self.open_ends, self.stack, self.edges = open_ends, [], []
        self.path, self.sizes, self.names = b"", [], [b""]
        self.first: tuple[bytes, list, list] | None = None

    def add(self, path: bytes, sizes: list[int], points: list[tuple]) -> None:
        """The next path with its points (depth, n, leaves, children, saved, conv_id, ends)."""
        if not self.stack:
            self.stack = [[0, 0, 0, 0, 0, None, None, self.open_ends]]
            self.first = (path, sizes, [])
        same = _shared(self.path, path)
        self._close(same)
        del self.names[same + 1 :]
        for d in range(same, len(sizes)):
            self.names.append(hashlib.md5(self.names[d] + path[d * DIGEST : (d + 1) * DIGEST]).digest())
        on_first = self.open_ends and path == self.first[0]
        self.path, self.sizes = path, sizes
        for depth, *sums in points:
            at = bisect_left(self.stack, depth, key=lambda p: p[0])
            if at < len(self.stack) and self.stack[at][0] == depth:
                _merge(self.stack[at], sums)
            else:
                self.stack.insert(at, [depth, *sums, on_first])

    def _close(self, depth: int) -> None:
        """Complete the points below depth; a point stands at depth then."""
        while self.stack[-1][0] > depth:
            done = self.stack.pop()
            if self.stack[-1][0] < depth:
                self.stack.append([depth, 0, 0, 0, 0, None, None, done[7]])
            if done[7]:
                self.first[2].append(tuple(done[:7]))
                continue
            above = self.stack[-1]
            saved, leaves = self._edge(done, above[0] + 1)
            _merge(above, [done[1], leaves, 1, saved, done[5], None])

    def _edge(self, point: list, top: int) -> tuple[int, int]:
        """Write the edge that goes down to a complete point; what it and all below it have saved, and its leaves."""
        depth, n, leaves, children, saved, conv_id, ends, _ = point
        sums = []
        for d in range(depth, top - 1, -1):  # a node saves what the edge below it saves and its own text
            saved += (n - 1) * (self.sizes[d - 1] if d else 0)
            sums.append(saved)
        leaves = leaves if children else 1
        parent = self.names[top - 1] if top else None
        self.edges.append((self.names[depth], parent, depth, conv_id, n, children, leaves, sums, ends))
        return saved, leaves

    def close(self) -> list[tuple[bytes, list, list]]:
        """Complete all that can be; rows (path, sizes, points) of what other partitions may share."""
        if not self.stack:
            return []
        if not self.open_ends:
            self._close(0)
            self._edge(self.stack.pop(), 0)
            return []
        rows = [self.first, (self.path, self.sizes, [tuple(p[:7]) for p in self.stack])]
        return [(path[: d * DIGEST], sizes[:d], points) for path, sizes, points in rows for d in [max((p[0] for p in points), default=0)] if points]


def _merge(point: list, sums: list) -> None:
    for i, x in enumerate(sums[:4], 1):
        point[i] += x
    if sums[4] is not None and (point[5] is None or sums[4] < point[5]):
        point[5] = sums[4]
    point[6] = point[6] or sums[5]


def _climb(open_ends: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow over sorted rows: edges of complete points, and rows that other partitions may share."""
    made = pa.schema([("edge", pa.struct(EDGE)), ("open", pa.struct(ROW))])
    named = lambda fields, values: dict(zip([f for f, _ in fields], values, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Patricia(open_ends)
        for batch in batches:
            for row in batch.to_pylist():
                tree.add(row["path"], row["sizes"], [tuple(p[f] for f, _ in POINT) for p in row["points"]])
            yield pa.RecordBatch.from_pylist([{"edge": named(EDGE, e), "open": None} for e in tree.edges], made)
            tree.edges = []
        rows = [named(ROW, (p, s, [named(POINT, x) for x in points])) for p, s, points in tree.close()]
        yield pa.RecordBatch.from_pylist([{"edge": named(EDGE, e), "open": None} for e in tree.edges] + [{"edge": None, "open": r} for r in rows], made)

    return run


def compressed(convs: DataFrame) -> DataFrame:
    """The edges of the Patricia tree over conversations (conv_id, path, sizes), as a table.

    An edge stands for its lowest node, ``bottom``, and the unary ones above it: depth, conv_id (smallest member), n_convs,
    n_children and n_leaves of that node, ends, ``saved`` of its nodes from the lowest up, and ``parent``, the node above the highest.

    Equal conversations become one row. Distinct ones are sorted by ranges of their paths, so no range is larger for a frequent
    beginning. A task closes the points inside its range and keeps aside those on its first and last path; these two paths
    of each range, with sums of what hangs on them, are merged by the same walk in one task.
    """
    convs = store(convs, "rebuilt")
    ends = _ends(convs)
    each = convs.groupBy("path").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("sizes").alias("sizes"))
    each = each.withColumn("name", F.unhex(F.sha2("path", 256))).join(ends.withColumnRenamed("path", "name"), "name")
    zero = F.lit(0).cast("long")
    point = F.struct(F.size("sizes").cast("long").alias("depth"), "n", zero.alias("leaves"), zero.alias("children"), zero.alias("saved"), "conv_id", "ends")
    rows = each.select("path", "sizes", F.array(point).alias("points"))
    parts = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lower = store(rows.repartitionByRange(parts, "path").sortWithinPartitions("path").mapInArrow(_climb(True), WALKED), "lower")
    shared = lower.where("open IS NOT NULL").select("open.*")
    upper = shared.repartition(1).sortWithinPartitions("path").mapInArrow(_climb(False), WALKED)
    return store(lower.where("edge IS NOT NULL").select("edge.*").unionByName(upper.where("edge IS NOT NULL").select("edge.*")), "edges")


def _long(c: Column, name: str) -> Column:
    return c.cast("long").alias(name)


def expand(edges: DataFrame) -> DataFrame:
    """One row per node from the edges: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    above = edges.select(F.col("bottom").alias("parent"), F.col("conv_id").alias("above"))
    nodes = edges.join(above, "parent", "left").select("*", F.posexplode("saved").alias("up", "saved_tokens"))
    lowest, highest = F.col("up") == 0, F.col("up") == F.size("saved") - 1
    return nodes.select(
        "conv_id",
        _long(F.col("depth") - F.col("up"), "depth"),
        F.when(highest, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(lowest, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.when(lowest & F.col("ends").isNotNull(), F.col("ends")).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (see rebuilt): a node is a distinct sequence of first turns.

    A null turn number comes first, equal ones by the digest of role and text; null roles and texts are empty; repeated
    rows stay; rows without a conv_id are left out. Other columns are ignored. An empty table has no nodes. Turns are told apart by
    their md5. A rebuilt conversation is one value of 16 bytes and a size for each turn, so one task must hold it.
    """
    return expand(compressed(rebuilt(turns, family, most)))
