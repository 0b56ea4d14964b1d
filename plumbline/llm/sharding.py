"""Sharding by balanced label propagation: linked documents gather, shard counts stay even."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import store

ROUNDS = 8
#: A round that moves a smaller share of the linked rows is the last.
SETTLED = 0.001
#: Rows of a shard that one task ranks at a time.
RANK_ROWS = 200_000
HUB = ["hub", "text_crc32", "size"]


def _case(index: Column, values: list[float] | list[int]) -> Column:
    """values[index]; their number depends on the number of shards only."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _rank(df: DataFrame, order: list[str], buckets: int, name: str) -> DataFrame:
    """df with the place of each row in its shard, from 0, by ``order``, a hash bucket, then doc_id and hub.

    Buckets are ranked apart and offset by running counts, so no task sorts a whole shard.
    """
    df = df.withColumn("__b", F.pmod(F.xxhash64("doc_id", "hub", F.lit(name)), F.lit(buckets)))
    keys = ["shard", *order, "__b"]
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy(*order, "__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id", "hub", "size")) - 1
    ranked = df.withColumn("__in", inside).join(counts, keys)
    return ranked.withColumn(name, (F.col("__before") + F.col("__in")).cast("long")).drop("__b", "__before", "__in")


def _quotas(now: list[int], flow: dict[tuple[int, int], int], most: int) -> list[float]:
    """Share of each (from, to) stream that may move so that no shard exceeds ``most`` rows."""
    n = len(now)
    share = {k: 1.0 for k in flow}
    for _ in range(50):
        load = [float(x) for x in now]
        into = [0.0] * n
        for (a, b), x in flow.items():
            load[a] -= x * share[a, b]
            load[b] += x * share[a, b]
            into[b] += x * share[a, b]
        over = [max(0.0, load[s] - most) for s in range(n)]
        if not any(over):
            break
        for a, b in flow:
            if over[b] and into[b]:
                share[a, b] *= max(0.0, 1 - over[b] / into[b])
    return [share.get((a, b), 0.0) for a in range(n) for b in range(n)]


def shard_documents(docs: DataFrame, n_shards: int, rounds: int = ROUNDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row of docs with size, text_crc32, shard and slot; rows per shard differ by one at most.

    Documents with equal texts are linked. Labels start from a hash of the document. In each
    round a join tells every linked document which shard most of its neighbours are in, and it
    moves there within the shard's quota. At the end shards above their exact count hand
    over documents, unlinked ones first, to those below. The n x n flows between shards are all
    that reaches the driver. Slots number the rows of a shard without gaps from 0. ``cut`` says whether a row is linked with
    one in another shard, so that the cut can be counted. Rounds end when hardly a linked row moves, or after ``rounds``.

    size is the UTF-8 length of the text plus 8; a null text has size 8 and checksum 0, and
    null texts are linked with each other, not with empty ones. A null doc_id is a value like
    any other; repeated rows are kept and stay together. An empty table gives no rows. Columns named
    in ``keep`` pass through; others are dropped, so clashing names do no harm.
    """
    # 64 bits of hash, 32 of checksum and the length stand for the text.
    state = docs.select(
        F.col("doc_id"),
        *keep,
        F.xxhash64("text").alias("hub"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    ).withColumn("shard", F.pmod(F.xxhash64("doc_id", "hub"), F.lit(n_shards)).cast("int"))
    state = store(state, "shard-start")
    total = state.count()
    most = -(-total // n_shards)
    for turn in range(rounds):
        seats = state.groupBy(*HUB, "shard").agg(F.count("*").alias("n"))
        best = F.max_by("shard", F.struct("n", F.xxhash64("hub", "shard")))
        hubs = seats.groupBy(*HUB).agg(F.sum("n").alias("members"), best.alias("want")).where("members > 1")
        state = store(state.drop("want", "members").join(hubs, HUB, "left"), f"shard-round{turn}")
        # Unlinked documents leave wherever there is no room, so quotas count linked ones only.
        now = {r.shard: r.n for r in state.where("members > 1").groupBy("shard").agg(F.count("*").alias("n")).collect()}
        flow = state.where("want != shard").groupBy("shard", "want").agg(F.count("*").alias("n")).collect()
        if sum(r.n for r in flow) <= SETTLED * sum(now.values()):
            break
        quota = _quotas([now.get(s, 0) for s in range(n_shards)], {(r.shard, r.want): r.n for r in flow}, most)
        draw = F.pmod(F.xxhash64("doc_id", "hub", F.lit(turn)), F.lit(1 << 20)) / (1 << 20)
        moves = F.col("want").isNotNull() & (draw < _case(F.col("shard") * n_shards + F.coalesce("want", F.lit(0)), quota))
        state = state.withColumn("shard", F.when(moves, F.col("want")).otherwise(F.col("shard")))
    state = state.withColumn("linked", F.col("want").isNotNull()) if rounds else state.withColumn("linked", F.lit(False))
    state = _even(state.drop("want", "members"), n_shards, total)
    state = store(state, "shard-even")
    apart = state.where("linked").groupBy(*HUB).agg((F.min("shard") != F.max("shard")).alias("cut"))
    ranked = _rank(state, [], max(1, total // RANK_ROWS), "slot").join(apart.where("cut"), HUB, "left")
    return ranked.select("doc_id", *keep, "size", "text_crc32", "shard", "slot", F.coalesce("cut", F.lit(False)).alias("cut"))


def _even(state: DataFrame, n_shards: int, total: int) -> DataFrame:
    """Hand rows from shards above their exact count to those below, unlinked rows first."""
    now = {r.shard: r.n for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    excess = [now.get(s, 0) - (total // n_shards + (s < total % n_shards)) for s in range(n_shards)]
    give = [max(0, x) for x in excess]
    ranked = _rank(state, ["linked"], max(1, total // RANK_ROWS), "place")
    index = F.col("place") + _case(F.col("shard"), [sum(give[:s]) for s in range(n_shards)])
    goes = F.col("place") < _case(F.col("shard"), give)
    shard, at = F.col("shard"), 0
    for s, x in enumerate(excess):
        if x < 0:
            shard = F.when(goes & (index >= at) & (index < at - x), F.lit(s)).otherwise(shard)
            at -= x
    return ranked.withColumn("shard", shard.cast("int")).drop("place")
