"""Embedding near-dedup: epsilon grid order join on leading principal dimensions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import store
from plumbline.llm.components import components

SIMILARITY = 0.98
#: Leading principal dimensions that order vectors and prove blocks distant; vectors in a block;
#: vectors below which a pair of intervals is compared instead of divided.
DIMS, BLOCK, LEAF = 8, 1024, 64
#: Leading dimensions in whose cells block boxes meet; longest vectors, and most lengths of them, whose axes are computed.
BOX_DIMS, MOST_LENGTH, MOST_LENGTHS = 3, 4096, 16


def _usable(vector) -> bool:
    if vector is None:
        return False
    v = np.array([np.nan if x is None else x for x in vector], dtype=np.float64)
    return v.size > 0 and bool(np.isfinite(v).all()) and bool((v != 0).any())


def _unit(vectors: list) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that squares neither overflow nor vanish."""
    v = np.array([np.asarray(x, dtype=np.float64) for x in vectors])
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, dims: int = DIMS) -> dict[int, np.ndarray]:
    """For each vector length its leading principal axes, from second moments over all rows.

    Tasks send sums of outer products, whose size depends on the length of vectors only. Vectors of more than MOST_LENGTH
    components, and those of other than the MOST_LENGTHS most frequent lengths, keep their first components as axes;
    any orthonormal axes prove distances, the principal ones prove more.
    """
    kinds = vectors.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), "n")
    kinds = kinds.where(F.col("n") <= MOST_LENGTH).limit(MOST_LENGTHS).collect()
    vectors = vectors.where(F.size("embedding").isin([r["n"] for r in kinds]))

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for batch in batches:
            for n, rows in batch.groupby(batch["embedding"].map(len)):
                u = _unit(list(rows["embedding"]))
                s = sums.setdefault(int(n), [0, np.zeros(n), np.zeros((n, n))])
                s[0] += len(u)
                s[1] += u.sum(axis=0)
                s[2] += u.T @ u
        yield pd.DataFrame(
            [(n, i, j, v) for n, (m, a, b) in sums.items() for i, j, v in [(-1, -1, float(m)), *((k, -1, x) for k, x in enumerate(a)), *((k, o, b[k, o]) for k in range(n) for o in range(k, n))]],
            columns=["n", "i", "j", "v"],
        )

    parts = vectors.select("embedding").mapInPandas(moments, "n int, i int, j int, v double")
    total = parts.groupBy("n", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    axes = {}
    for n, t in total.groupby("n"):
        n = int(n)
        m = t.loc[t.i == -1, "v"].iloc[0]
        mean, second = np.zeros(n), np.zeros((n, n))
        one, two = t[(t.i >= 0) & (t.j < 0)], t[t.j >= 0]
        mean[one.i] = one.v / m
        second[two.i, two.j] = second[two.j, two.i] = two.v / m
        _, vecs = np.linalg.eigh(second - np.outer(mean, mean))
        axes[n] = np.ascontiguousarray(vecs[:, ::-1][:, :dims])
    return axes


def project(unit: np.ndarray, axes: dict[int, np.ndarray], dims: int) -> np.ndarray:
    """Coordinates on the axes of the vectors' length."""
    own = axes.get(unit.shape[1])
    return np.ascontiguousarray(unit[:, :dims]) if own is None else unit @ own


def _join(u: np.ndarray, p: np.ndarray, v: np.ndarray, q: np.ndarray, eps: float, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two intervals with cosine >= least; halves that are provably distant are skipped."""
    todo = [(0, len(u), 0, len(v))]
    while todo:
        a, b, c, d = todo.pop()
        if same and d <= a:  # the mirror image is joined elsewhere
            continue
        gap = np.maximum(0, np.maximum(p[a:b].min(axis=0) - q[c:d].max(axis=0), q[c:d].min(axis=0) - p[a:b].max(axis=0)))
        if (gap * gap).sum() > eps * eps:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            # One product per pair in double precision: equal inputs give equal results in any block.
            i, j = np.nonzero(u[a:b] @ v[c:d].T >= least - 1e-9)
            i, j = i + a, j + c
            sure = np.einsum("ij,ij->i", u[i], v[j]) >= least
            if same:
                sure &= i < j
            yield i[sure], j[sure]
            continue
        m, n = (a + b) // 2, (c + d) // 2
        if b - a >= d - c:
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            todo += [(a, b, c, n), (a, b, n, d)]


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (node, least node of its component) of a link list: as few links as keep nodes together."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in root if find(x) != x]


def near_duplicates(vectors: DataFrame, similarity: float = SIMILARITY, dims: int = DIMS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label).

    Two rows are linked if their labels are equal and not null and the cosine of their vectors is
    at least ``similarity``. Equal vectors of a label are folded into one and counted, so a
    vector that is copied a million times is compared once. The rest are sorted by label and grid
    cell (width epsilon, the distance of unit vectors at that cosine) on the leading principal
    axes and cut into blocks. Blocks whose bounding boxes touch within epsilon meet; a pair of
    blocks is divided into shorter intervals, and provably distant ones are skipped. A task sends
    link counts and a spanning forest, not the pairs, so large groups stay linear in output.

    A vector that is null, empty, zero or has a null or non-finite component links with nothing, and so
    does one with a null label or with a length of its own. Rows may repeat, they are links of each
    other; a null vec_id takes part and is left out as a component's name unless alone. An
    empty table gives no rows; other columns are ignored. Where many vectors of a label lie within epsilon on all leading
    axes their blocks must all meet, and the work there grows with the square of the blocks.
    """
    spark = vectors.sparkSession
    eps = math.sqrt(max(0.0, 2 - 2 * similarity)) + 1e-9

    @F.pandas_udf("boolean")
    def usable(batch: pd.Series) -> pd.Series:
        return batch.map(_usable).astype(bool)

    rows = store(vectors.select("vec_id", "label", "embedding").withColumn("ok", F.col("label").isNotNull() & usable("embedding")), "ego-rows")
    # One row per distinct vector, with its copies; a byte string is the key, doubles as they are.
    key = F.sha2(F.concat_ws(",", F.transform("embedding", lambda x: (x + F.lit(0.0)).cast("string"))), 256)
    keyed = rows.where("ok").withColumn("key", key)
    folded = keyed.groupBy("label", "key").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.any_value("embedding").alias("embedding"))
    folded = store(folded.withColumn("id", F.xxhash64("label", "key")), "ego-distinct")
    axes = spark.sparkContext.broadcast(principal_axes(folded, dims))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, part in batch.groupby(batch["embedding"].map(len)):
                p = project(_unit(list(part["embedding"])), axes.value, dims)
                yield part.assign(n=int(n), cell=list(np.floor(p / eps).astype(np.int32)))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def cut(part: pd.DataFrame) -> pd.DataFrame:
            u = _unit(list(part["embedding"]))
            n = u.shape[1]
            p = project(u, axes.value, dims)
            return pd.DataFrame(
                {
                    "label": [part["label"].iloc[0]], "n": [n], "first": [int(part["id"].iloc[0])], "size": [len(part)],
                    "low": [p.min(axis=0)], "high": [p.max(axis=0)], "ids": [part["id"].to_numpy(dtype="<i8").tobytes()],
                    "copies": [part["copies"].to_numpy(dtype="<i8").tobytes()], "data": [np.array([np.asarray(x, "<f8") for x in part["embedding"]]).tobytes()],
                }
            )

        def flush(part: pd.DataFrame, last: bool) -> Iterator[pd.DataFrame]:
            for _, g in part.groupby(["label", "n"], sort=False):
                whole = len(g) if last or g.index[-1] != part.index[-1] else len(g) // block * block
                for i in range(0, whole, block):
                    yield cut(g.iloc[i : i + block])
                if whole < len(g):
                    held.append(g.iloc[whole:])

        for batch in batches:
            part = pd.concat([*held, batch], ignore_index=True)
            held.clear()
            yield from flush(part, False)
        if held:
            part = pd.concat(held, ignore_index=True)
            held.clear()
            yield from flush(part, True)

    shape = folded.select("label", "id", "copies", "embedding").schema
    kind = dict(folded.dtypes)
    base = f"label {kind['label']}, id long, copies long, embedding {kind['embedding']}"
    ordered = folded.select(*shape.names).mapInPandas(cells, f"{base}, n int, cell array<int>")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = ordered.repartitionByRange(parts, "label", "n", "cell", "id").sortWithinPartitions("label", "n", "cell", "id").drop("cell")
    cut_rows = ordered.mapInPandas(
        blocks,
        f"label {kind['label']}, n int, first long, size long, low array<double>, high array<double>, ids binary, copies binary, data binary",
    )
    made = store(cut_rows, "ego-blocks")

    # Boxes alone meet first, by the cells of the leading axes that they cover; data follow for the pairs that are left.
    # In grid order a box is thin on the first axes, and the later ones are divided the more the fuller a cell is.
    box = made.select("label", "n", "first", "low", "high")
    width = min(BOX_DIMS, dims)

    def covered(rows: DataFrame, more: int) -> DataFrame:
        for k in range(width):
            cell = lambda x, k=k: F.floor(F.coalesce(F.get(F.col(x), k), F.lit(0.0)) / eps)
            rows = rows.withColumn(f"cell{k}", F.explode(F.sequence(cell("low") - more, cell("high") + more)))
        return rows.select("label", "n", "first", "low", "high", F.array(*[f"cell{k}" for k in range(width)]).alias("slab"))

    a, b = covered(box, 0).alias("a"), covered(box, 1).alias("b")
    gap = F.aggregate(
        F.zip_with(
            F.zip_with("a.low", "b.high", lambda x, y: x - y), F.zip_with("b.low", "a.high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))
        ),
        F.lit(0.0),
        lambda s, x: s + x * x,
    )
    meets = (F.col("a.label") == F.col("b.label")) & (F.col("a.n") == F.col("b.n")) & (F.col("a.slab") == F.col("b.slab"))
    pairs = a.join(b, meets & (F.col("a.first") <= F.col("b.first"))).where(gap <= eps * eps)
    pairs = store(pairs.select(F.col("a.label").alias("label"), F.col("a.n").alias("n"), F.col("a.first").alias("f"), F.col("b.first").alias("g")).distinct(), "ego-pairs")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                sides = []
                for ids, copies, data in ((r.ids, r.copies, r.data), (r.ids2, r.copies2, r.data2)):
                    raw = np.frombuffer(data, "<f8").reshape(-1, r.n)
                    u = _unit(list(raw))
                    sides.append((np.frombuffer(ids, "<i8"), np.frombuffer(copies, "<i8"), u, project(u, axes.value, dims)))
                (ia, ca, ua, pa), (ib, cb, ub, pb) = sides
                same = r.f == r.g
                found = list(_join(ua, pa, ub, pb, eps, similarity, same))
                i = np.concatenate([x for x, _ in found]) if found else np.zeros(0, dtype=int)
                j = np.concatenate([y for _, y in found]) if found else np.zeros(0, dtype=int)
                links_a = np.bincount(i, cb[j], len(ia)).astype(np.int64)
                links_b = np.bincount(j, ca[i], len(ib)).astype(np.int64)
                tree = _forest(ia[i], ib[j])
                out = [(int(x), int(n), None) for x, n in [*zip(ia, links_a), *zip(ib, links_b)] if n] + [(x, 0, y) for x, y in tree]
                yield pd.DataFrame(out, columns=["id", "n", "to"], dtype=object).astype({"id": "int64", "n": "int64", "to": "Int64"})

    left = made.select("label", "n", F.col("first").alias("f"), "ids", "copies", "data")
    right = made.select("label", "n", F.col("first").alias("g"), F.col("ids").alias("ids2"), F.col("copies").alias("copies2"), F.col("data").alias("data2"))
    joined = pairs.join(left, ["label", "n", "f"]).join(right, ["label", "n", "g"]).select("n", "f", "g", "ids", "copies", "data", "ids2", "copies2", "data2")
    found = store(joined.mapInPandas(compare, "id long, n long, to long"), "ego-links")

    counts = found.where("to IS NULL").groupBy("id").agg(F.sum("n").alias("more"))
    groups = components(found.where("to IS NOT NULL").select(F.col("id").alias("a"), F.col("to").alias("b")))
    known = folded.select("label", "key", "id", "copies", "least").join(counts, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
    known = known.withColumn("component", F.coalesce("component", "id"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select("label", "key", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    out = rows.withColumn("key", F.when(F.col("ok"), key)).drop("embedding").join(known, ["label", "key"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
