"""Benchmark decontamination: token windows of benchmark items looked up in training texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ascii_lower, drop, small_enough, store

# Fixed value: words are runs of ASCII letters and digits and of all characters beyond ASCII.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Hashes of benchmark windows (8 bytes each) that are broadcast; with more, positions meet them in a shuffle.
MOST_HASHES = 2_000_000
#: Hits that are broadcast to the documents they are in; with more, documents are shuffled.
MOST_HITS = 1_000_000


def words(text: Column) -> Column:
    """Normalised words of a whole text; null and wordless texts have none."""
    plain = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), GAP, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _hash(w: Column, at: Column, n: int) -> Column:
    """Hash of the n words of w from place at (from 1)."""
    return F.xxhash64(*[F.get(w, at + (j - 1)) for j in range(n)])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows with the items that hold them: h (hash), n (words), win, items (sorted as strings).

    Every run of ``window`` words of an item is a window; an item of fewer words, but not none,
    is one. Items may repeat; a null item_id is left out of ``items`` but its windows count.
    """
    w = benchmark.select("item_id", F.explode(F.array(words(F.col("text")))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    w = w.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.slice("w", F.col("i"), F.lit(window)).alias("w"))
    by_size = F.xxhash64("w")  # replaced below: the hash of the words one by one, as documents have it
    for n in range(1, window + 1):
        by_size = F.when(F.size("w") == n, _hash(F.col("w"), F.lit(1), n)).otherwise(by_size)
    return w.groupBy(by_size.alias("h"), F.size("w").alias("n"), F.array_join("w", " ").alias("win")).agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")
    )


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_hashes: int = MOST_HASHES) -> DataFrame:
    """docs without text but with n_words, and a row for each benchmark window that begins in a text: at, n, items.

    ``docs`` has text and columns that name its rows. Each row of docs also gives one row with a null ``at``.

    The hashes of all benchmark windows are a broadcast hash set; each position of a text probes it where the text
    lies. Positions that are in the set are compared with the windows' words. With more than
    ``most_hashes`` windows, positions meet the set in a shuffle instead; the results are equal.
    """
    wins = store(benchmark_windows(benchmark, window), "leak-windows")
    lengths = sorted(r.n for r in wins.select("n").distinct().collect())  # at most `window` rows
    names = [c for c in docs.columns if c != "text"]
    # A generator's output is computed once for a row: no filter is pushed below it, and no later expression holds a copy of it.
    split = docs.select(*names, F.explode(F.array(words(F.col("text")))).alias("__w"))
    w = F.col("__w")
    size = F.size(w)
    # Places of all lengths in one run of numbers: 0 for the row itself, then the starts of each length.
    at, n, h, top = F.lit(0), F.lit(0), F.lit(None).cast("long"), F.lit(0)
    for k in lengths:
        start = F.col("__p") - top
        inside = F.col("__p") > top
        at, n, h = F.when(inside, start).otherwise(at), F.when(inside, F.lit(k)).otherwise(n), F.when(inside, _hash(w, start, k)).otherwise(h)
        top = top + F.greatest(size - (k - 1), F.lit(0))
    placed = split.select(*names, "__w", size.alias("__size"), F.explode(F.sequence(F.lit(0), top)).alias("__p"))
    placed = placed.select(*names, "__w", "__size", at.alias("__at"), n.alias("__n"), h.alias("__h"))
    if small_enough(wins, most_hashes):
        known = F.broadcast(wins.select(F.col("h").alias("__known")).distinct())
        near = placed.join(known, F.col("__h") == F.col("__known"), "left").where("__known IS NOT NULL OR __at = 0").drop("__known")
        near = near.withColumn("__win", F.when(F.col("__at") > 0, F.array_join(F.slice("__w", F.greatest("__at", F.lit(1)), F.col("__n")), " "))).drop("__w")
    else:
        near = placed.withColumn("__win", F.when(F.col("__at") > 0, F.array_join(F.slice("__w", F.greatest("__at", F.lit(1)), F.col("__n")), " "))).drop("__w")
    sure = near.join(wins.select(F.col("h").alias("__h"), F.col("win").alias("__win"), F.col("items").alias("__items")), ["__h", "__win"], "left")
    sure = sure.where("__at = 0 OR __items IS NOT NULL")
    return sure.select(
        *names, F.col("__size").cast("long").alias("__n_words"), F.when(F.col("__at") > 0, F.col("__at")).alias("__at"), F.when(F.col("__at") > 0, F.col("__n")).alias("__n"), "__items"
    )


def places(spots: Column) -> Column:
    """Distinct positions (from 1) of words inside any of the spots (at, n)."""
    return F.array_distinct(F.flatten(F.transform(spots, lambda r: F.sequence(r.at, r.at + r.n - 1))))


def _key() -> list[Column]:
    """Names of a row: doc_id and two hashes of its text, so that rows of one name hold equal texts."""
    return [F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__t"), F.hash(F.lit(7), "text").alias("__u")]


def _found(docs: DataFrame, benchmark: DataFrame, window: int, most_hashes: int) -> DataFrame:
    """Table of __id, __t, __u, spots (array of at, n) for rows with hits."""
    rows = hits(docs.select(*_key(), "text"), benchmark, window, most_hashes).where("__at IS NOT NULL")
    return store(rows.groupBy("__id", "__t", "__u").agg(F.collect_set(F.struct(F.col("__at").alias("at"), F.col("__n").alias("n"))).alias("__spots")), "leak-rows")


def _meet(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """docs joined with its rows of found; a bounded number of hits is broadcast."""
    total = found.agg(F.sum(F.size("__spots") + 1)).first()[0] or 0
    side = F.broadcast(found) if total <= MOST_HITS else found
    here = F.struct(*_key())
    return docs.join(side, here.getField("__id").eqNullSafe(side["__id"]) & (here.getField("__t") == side["__t"]) & (here.getField("__u") == side["__u"]), how)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_hashes: int = MOST_HASHES) -> DataFrame:
    """docs with ``clean``: the normalised words outside all hits, joined by spaces; a column of docs named clean is replaced.

    Null and wordless texts give an empty ``clean``, repeated rows a row each, an empty benchmark removes nothing.
    """
    found = _found(docs, benchmark, window, most_hashes)
    split = _meet(docs, found, "left").withColumn("__w", F.explode(F.array(words(F.col("text")))))
    # array_except keeps distinct values in order, and looks them up in a hash set.
    left = F.array_except(F.when(F.size("__w") > 0, F.sequence(F.lit(1), F.size("__w"))).otherwise(F.array().cast("array<int>")), places(F.col("__spots")))
    clean = F.when(F.col("__spots").isNull(), F.array_join("__w", " ")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("__w"), i - 1)), " "))
    return split.select(*[c for c in docs.columns if c != "clean"], clean.alias("clean"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_hashes: int = MOST_HASHES) -> DataFrame:
    """The rows of docs without any hit, with all their columns as they were, whatever their names.

    Null and wordless texts stay, and so do all rows if the benchmark is empty. Repeated rows share their fate.
    """
    return _meet(docs, _found(docs, benchmark, window, most_hashes), "left_anti")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_hashes: int = MOST_HASHES) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Repeated rows each give a row. Null and wordless texts have no words, an empty benchmark gives no hits, an
    empty table no rows; other columns are ignored.
    """
    rows = docs.select("doc_id", "text").select(F.struct(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i")).alias("row"), "doc_id", "text")
    spot = F.when(F.col("__at").isNotNull(), F.struct(F.col("__at").alias("at"), F.col("__n").alias("n")))
    per = hits(rows, benchmark, window, most_hashes).groupBy("row", "doc_id", "__n_words").agg(F.collect_set(spot).alias("spots"), F.collect_set("__items").alias("items"))
    items = F.array_sort(F.array_distinct(F.flatten("items")))
    per = per.select("doc_id", "__n_words", F.size(places(F.col("spots"))).cast("long").alias("n_hit"), F.explode(F.array(items)).alias("items"))
    return per.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
