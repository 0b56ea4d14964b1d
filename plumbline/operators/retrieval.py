"""Ranking: exact cosine, BM25, rank fusion, progressive metadata filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.rules import DIMENSION_ALIASES, DIMENSIONS
from plumbline.functions.text import tokenize
from plumbline.operators import impacts
from plumbline.operators.lookup import inside
from plumbline.sources.scratch import scratch

# Fixed value: the fusion constant.
RRF = 60.0
#: Query vectors and vectors of a block; queries whose blocks are broadcast.
QUERY_BLOCK, VECTOR_BLOCK, MOST_QUERIES = 512, 16_384, 50_000
#: Queries of a block that are scored at a time.
QUERY_SLICE = 64
DIGITS = 6


def top_k(scored: DataFrame, query: str, item: str, score: Column, k: int) -> DataFrame:
    """The k best rows of each query with their rank: higher scores first, then corpus order."""
    order = Window.partitionBy(query).orderBy(score.desc(), F.col(item).asc())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def depth(n: int, k: int) -> int:
    """How many rows of each ranking are fused."""
    return min(n, max(4 * k, 20))


def _pack(rows: DataFrame, most: int) -> DataFrame:
    """ids, vectors, groups: blocks of up to ``most`` rows (vec_id, embedding, group) of one length, ids in ascending order."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush() -> Iterator[pd.DataFrame]:
            whole = pd.concat(held).sort_values("vec_id", kind="stable")
            held.clear()
            for _, part in whole.groupby(whole["embedding"].map(len)):
                for i in range(0, len(part), most):
                    some = part.iloc[i : i + most]
                    matrix = np.array([np.asarray(x, dtype="<f8") for x in some["embedding"]])
                    yield pd.DataFrame({"ids": [some["vec_id"].to_numpy(dtype="<i8").tobytes()], "vectors": [matrix.tobytes()], "groups": [some["group"].to_numpy(dtype="<i8").tobytes()]})

        for batch in batches:
            if len(batch):
                held.append(batch)
            if sum(map(len, held)) >= most:
                yield from flush()
        if held:
            yield from flush()

    return rows.mapInPandas(pack, "ids binary, vectors binary, groups binary")


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, id and rounded score of the k best of each row of scores; ids ascend, and of equal scores the first wins."""
    n = scores.shape[1]
    whole = np.where(np.isfinite(scores), np.rint(scores * 10.0**DIGITS), -(2.0**40)).astype(np.int64)
    order = whole * n + (n - 1 - np.arange(n))  # one number for score and place, so that nothing ties
    top = np.argpartition(-order, min(k, n) - 1, axis=1)[:, : min(k, n)]
    picked = np.take_along_axis(whole, top, axis=1)
    row, col = np.nonzero(picked > -(2**40))
    return row, ids[top[row, col]], picked[row, col] / 10.0**DIGITS


def _block_best(ids: np.ndarray, v: np.ndarray, q_ids: np.ndarray, q: np.ndarray, groups: tuple[np.ndarray, np.ndarray] | None, k: int, skip_self: bool) -> Iterator[pd.DataFrame]:
    """query_id, vec_id, score: the k best vectors of a block for each query of a block; ``groups`` of queries and vectors must be equal."""
    for i in range(0, len(q_ids), QUERY_SLICE):  # scores and their order are held several times over
        part = slice(i, i + QUERY_SLICE)
        scores = q[part] @ v.T
        if groups:
            scores[groups[0][part, None] != groups[1][None, :]] = -np.inf
        if skip_self:
            scores[q_ids[part, None] == ids[None, :]] = -np.inf
        row, found, score = _best(ids, scores, k)
        yield pd.DataFrame({"query_id": q_ids[part][row], "vec_id": found, "score": score})


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, skip_self: bool = False, within: str | None = None) -> DataFrame:
    """query_id, vec_id, score, rank: exact cosine of unit vectors in double precision.

    Queries and vectors are packed into blocks, and each block of queries meets each block of vectors as one matrix
    product that keeps k rows of each query; the corpus is read once. Query blocks are broadcast while they are small.
    Scores are rounded before ranking, since summation order moves the last digits. With ``within``, a column of
    both, a query ranks only vectors that have its value; null equals nothing. Null vectors and those of another length
    than the query's rank nowhere.
    """
    group = F.xxhash64(within) if within else F.lit(0).cast("long")
    side = lambda d: (d.where(F.col(within).isNotNull()) if within else d).where("embedding IS NOT NULL AND size(embedding) > 0").select("vec_id", "embedding", group.alias("group"))
    asked = _pack(side(queries), QUERY_BLOCK).select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q"), F.col("groups").alias("q_groups"))
    if queries.limit(MOST_QUERIES + 1).count() <= MOST_QUERIES:
        asked = F.broadcast(asked)

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids, q_ids = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.q_ids, "<i8")
                v, q = np.frombuffer(r.vectors, "<f8").reshape(len(ids), -1), np.frombuffer(r.q, "<f8").reshape(len(q_ids), -1)
                if v.shape[1] != q.shape[1]:
                    continue
                groups = (np.frombuffer(r.q_groups, "<i8"), np.frombuffer(r.groups, "<i8")) if within else None
                yield from _block_best(ids, v, q_ids, q, groups, k, skip_self)

    met = _pack(side(vectors), VECTOR_BLOCK).join(asked)  # blocks against blocks of the stated queries
    return top_k(met.mapInPandas(rank, "query_id long, vec_id long, score double"), "query_id", "vec_id", F.col("score"), k)


def term_statistics(docs: DataFrame) -> DataFrame:
    """term, df, idf over the whole corpus."""
    df = docs.select(F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    return df.join(F.broadcast(n)).select("term", "df", F.round(F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), DIGITS).alias("idf"))


def _with_empty(scored: DataFrame, queries: DataFrame, docs: DataFrame, k: int, doc: str) -> DataFrame:
    """scored and, for each query, the corpus's first k documents with score 0.

    Every document is a candidate, also at score 0. Of those, only the first in corpus order can reach the
    top k, so the corpus is never crossed with the queries.
    """
    first = docs.select(F.col(doc).alias("doc")).orderBy("doc").limit(k)
    empty = queries.select("query_id").join(F.broadcast(first)).select("*", F.lit(0.0).alias("score"), F.lit(0.0).alias("shared"), F.array().cast("array<string>").alias("terms"))
    return scored.unionByName(empty).groupBy("query_id", "doc").agg(F.max("score").alias("score"), F.max("shared").alias("shared"), F.max_by("terms", F.size("terms")).alias("terms"))


def lexical_scores(queries: DataFrame, docs: DataFrame, k: int, candidates: DataFrame | None = None, doc: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """query_id, doc, score (BM25), shared (distinct common terms), terms (the common ones, in the query's order).

    Distinct query terms count. The corpus is tokenised once: postings of terms that occur in a query, and each
    document's length, are written as a table that statistics and scores read. ``candidates`` (query_id, doc) restricts
    what is ranked, not the statistics. Without it, documents that share no term have their rows where they can reach
    the top k.
    """
    asked = queries.select("query_id", F.array_distinct(tokenize(F.col("text"))).alias("t"))
    terms = asked.select("query_id", F.posexplode("t").alias("place", "term"))
    weighted = impacts.weights(*impacts.postings(docs, terms, doc, text))
    common = F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x.term)
    scored = terms.join(weighted, "term").groupBy("query_id", "doc").agg(F.round(F.sum("w"), DIGITS).alias("score"), F.count("*").cast("double").alias("shared"), common.alias("terms"))
    if candidates is None:
        return _with_empty(scored, queries, docs, k, doc)
    rows = candidates.select("query_id", "doc").join(scored, ["query_id", "doc"], "left").fillna(0.0, ["score", "shared"])
    return rows.withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


def bm25_top_k(queries: DataFrame, docs: DataFrame, k: int, candidates: DataFrame | None = None, doc: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """query_id, doc, score, rank over rows (query_id, text) and documents.

    All documents are ranked by an impact-ordered index of the queries' terms (see impacts), those of ``candidates`` by
    lexical_scores().
    """
    if candidates is not None:
        scored = lexical_scores(queries, docs, k, candidates, doc, text).select("query_id", "doc", "score")
        return top_k(scored, "query_id", "doc", F.col("score"), k)
    asked = _asked(queries)
    return _ranked(impacts.build(docs, asked.select(F.explode("terms").alias("term")), doc, text), asked, docs, k, doc)


def _asked(queries: DataFrame) -> DataFrame:
    """query_id, terms: the distinct tokens of each query, as a table."""
    return scratch(queries.select("query_id", F.array_distinct(tokenize(F.col("text"))).alias("terms")), "queries")


def _ranked(index: DataFrame, asked: DataFrame, docs: DataFrame, k: int, doc: str, ones: bool = False) -> DataFrame:
    """The k best of all documents for each query; those that share no term have score 0 and come in corpus order."""
    first = docs.select(F.col(doc).alias("doc")).orderBy("doc").limit(k)
    empty = asked.select("query_id").join(F.broadcast(first)).select("*", F.lit(0.0).alias("score"))  # k rows
    scored = impacts.search(index, asked, k, ones).unionByName(empty)
    return top_k(scored.groupBy("query_id", "doc").agg(F.max("score").alias("score")), "query_id", "doc", F.col("score"), k)


def search_report(queries: DataFrame, docs: DataFrame, k: int, candidates: DataFrame | None = None, doc: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """query_id, doc, score, rank, matched_terms (in the query's order), query_tokens (repeats counted), candidates (how many were ranked).

    All documents are ranked by the index, and the matched terms are looked up for the k best of each query only.
    """
    if candidates is None:
        ranked = _ranked_with_terms(queries, docs, k, doc, text)
    else:
        ranked = top_k(lexical_scores(queries, docs, k, candidates, doc, text), "query_id", "doc", F.col("score"), k)
    asked = queries.select("query_id", F.size(tokenize(F.col("text"))).cast("long").alias("query_tokens"))
    if candidates is None:
        asked = asked.join(F.broadcast(docs.agg(F.count("*").alias("candidates"))))
    else:
        asked = asked.join(candidates.groupBy("query_id").agg(F.count("*").alias("candidates")), "query_id")
    return ranked.join(asked, "query_id").select("query_id", "doc", "score", "rank", F.col("terms").alias("matched_terms"), "query_tokens", "candidates")


def _ranked_with_terms(queries: DataFrame, docs: DataFrame, k: int, doc: str, text: str | Column) -> DataFrame:
    """query_id, doc, score, rank, terms (the common ones, in the query's order) of the k best of all documents."""
    asked = _asked(queries)
    terms = asked.select("query_id", F.posexplode("terms").alias("place", "term"))
    found, size = impacts.postings(docs, terms, doc, text)
    best = scratch(_ranked(impacts.index(found, size), asked, docs, k, doc), "best")
    there = found.select("doc", "term").join(best.select("doc").distinct(), "doc", "left_semi")
    common = F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x.term)
    told = best.join(terms, "query_id").join(there.distinct(), ["doc", "term"]).groupBy("query_id", "doc").agg(common.alias("terms"))
    return best.join(told, ["query_id", "doc"], "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


def overlap_top_k(queries: DataFrame, docs: DataFrame, k: int, doc: str = "doc_id") -> DataFrame:
    """query_id, doc, score, rank by the number of distinct shared terms."""
    return lexical_rankings(queries, docs, k, doc)[1]


def lexical_rankings(queries: DataFrame, docs: DataFrame, k: int, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The rankings of bm25_top_k() and overlap_top_k() from one index, made in one pass over the corpus."""
    asked = _asked(queries)
    index = impacts.build(docs, asked.select(F.explode("terms").alias("term")), doc)
    return _ranked(index, asked, docs, k, doc), _ranked(index, asked, docs, k, doc, ones=True)


def fuse(first: DataFrame, second: DataFrame, k: int, constant: float = RRF, first_weight: float = 1.0, second_weight: float = 1.0) -> DataFrame:
    """query_id, doc, score, first_rank, second_rank, rank: weighted reciprocal ranks of two rankings.

    Scores of the rankings play no part. Ties go to the better rank, then to the smaller id.
    """
    a = first.select("query_id", "doc", F.col("rank").alias("first_rank"))
    b = second.select("query_id", "doc", F.col("rank").alias("second_rank"))
    both = a.join(b, ["query_id", "doc"], "full")
    part = lambda w, r: F.coalesce(w / (constant + F.col(r)), F.lit(0.0))
    both = both.withColumn("score", F.round(part(first_weight, "first_rank") + part(second_weight, "second_rank"), 12))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.least("first_rank", "second_rank"), "doc")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fact_dimensions(dimension: Column, dimensions: Column) -> Column:
    """Sorted dimensions of a fact: the listed ones that exist, and those that its dimension or reason for checking names or holds."""
    names = (*DIMENSIONS, "time")
    said = F.coalesce(dimension, F.lit(""))
    listed = F.filter(F.coalesce(dimensions, F.array().cast("array<string>")), lambda d: d.isin(*names))
    told = [F.when(F.contains(said, F.lit(n)), F.lit(n)) for n in names] + [F.when(F.contains(said, F.lit(a)), F.lit(n)) for a, n in DIMENSION_ALIASES.items()]
    return F.array_sort(F.array_distinct(F.concat(listed, F.array_compact(F.array(*told)))))


def filter_hints(facts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """facts with ``entities``: names equal to the subject or an actor, else all names inside the text.

    ``vocabulary`` has one column, name; facts have fact_id, subject, actors, text. Texts of facts without an exact match
    are searched for all names at once.
    """
    own = F.array_compact(F.array_append(F.coalesce("actors", F.array().cast("array<string>")), F.col("subject")))
    exact = facts.select("fact_id", F.explode(own).alias("name")).join(vocabulary, "name", "left_semi").groupBy("fact_id").agg(F.array_sort(F.collect_set("name")).alias("exact"))
    rest = facts.join(exact, "fact_id", "left_anti").select("fact_id", "text")
    found = inside(rest, "fact_id", "text", vocabulary).groupBy("fact_id").agg(F.array_sort(F.collect_set("name")).alias("inside"))
    out = facts.join(exact, "fact_id", "left").join(found, "fact_id", "left")
    return out.withColumn("entities", F.coalesce("exact", "inside", F.array().cast("array<string>"))).drop("exact", "inside")


def filter_levels(facts: DataFrame) -> DataFrame:
    """fact_id, level_no, level, by, any: the filters to try, strictest first, from entities, dimensions and times.

    All hints together; then without time; then either of entity and dimension; at last no filter. Levels
    that repeat an earlier one fall out.
    """
    has = {n: F.size(c) > 0 for n, c in (("entity", "entities"), ("dimension", "dimensions"), ("time", "times"))}
    pick = lambda *names: F.array_compact(F.array(*[F.when(has[n], n) for n in names]))
    timeless = pick("entity", "dimension")
    level = lambda by, any_, sep: F.struct(F.array_join(by, sep).alias("level"), by.alias("by"), F.lit(any_).alias("any"))
    none = F.array().cast("array<string>")
    tries = F.array(
        F.when(F.size(pick("entity", "dimension", "time")) > 0, level(pick("entity", "dimension", "time"), False, "+")),
        F.when(F.size(timeless) > 0, level(timeless, False, "+")),
        F.when(F.size(timeless) == 2, level(timeless, True, "|")),
        F.struct(F.lit("all").alias("level"), none.alias("by"), F.lit(False).alias("any")),
    )
    kept = facts.select("fact_id", F.posexplode(F.array_distinct(F.array_compact(tries))).alias("level_no", "l"))
    return kept.select("fact_id", "level_no", "l.*")


def _chosen(facts: DataFrame, items: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts by hints, the chosen level of each kind of hints, and which kinds of items fit which level of them.

    Facts with equal hints and items with equal tags are folded first. Matching is an equi-join on the hint
    values; the last level, which takes all, is answered by a count.
    """
    hints_of, tags_of = ("entities", "dimensions", "times"), ("entities", "dimension_tags", "time_markers")
    every = facts.select(F.col("fact_id").alias("fact"), F.xxhash64(*hints_of).alias("fact_id"))
    facts = facts.select(F.xxhash64(*hints_of).alias("fact_id"), *hints_of).dropDuplicates(["fact_id"])
    items = items.groupBy(F.xxhash64(*tags_of).alias("item_kind")).agg(*[F.first(c).alias(c) for c in tags_of], F.count("*").alias("m"))
    levels = filter_levels(facts)
    kinds = (("entity", "entities", "entities"), ("dimension", "dimensions", "dimension_tags"), ("time", "times", "time_markers"))
    hit = None
    for kind, hints, marks in kinds:
        a = facts.select("fact_id", F.explode(hints).alias("v")).distinct()
        b = items.select("item_kind", F.explode(marks).alias("v")).distinct()
        m = a.join(b, "v").select("fact_id", "item_kind", F.lit(kind).alias("kind")).distinct()
        hit = m if hit is None else hit.unionByName(m)
    hit = hit.groupBy("fact_id", "item_kind").agg(F.collect_set("kind").alias("kinds"))
    fits = F.when(F.col("any"), F.arrays_overlap("by", "kinds")).otherwise(F.size(F.array_except("by", "kinds")) == 0)
    some = levels.where("level <> 'all'").join(hit, "fact_id").where(fits).select("fact_id", "level_no", "item_kind")
    counts = some.join(items.select("item_kind", "m"), "item_kind").groupBy("fact_id", "level_no").agg(F.sum("m").alias("candidates"))
    n = items.agg(F.sum("m").alias("n"))
    full = levels.join(counts, ["fact_id", "level_no"], "left").join(F.broadcast(n))
    full = full.withColumn("candidates", F.when(F.col("level") == "all", F.col("n")).otherwise(F.coalesce("candidates", F.lit(0))))
    enough = full.where(F.col("candidates") >= F.least("n", F.lit(least)))
    chosen = enough.groupBy("fact_id").agg(F.min(F.struct("level_no", "level", "candidates")).alias("c"))
    trace = full.groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("level_no", "level", "candidates"))).alias("tried"))
    chosen = chosen.join(trace, "fact_id").select("fact_id", "c.*", F.filter("tried", lambda t: t.level_no <= F.col("c.level_no")).alias("trace"))
    return every, chosen, some


def select_candidates(facts: DataFrame, items: DataFrame, least: int) -> DataFrame:
    """fact_id, level, fallback, candidates: the first level that leaves at least min(n, least) items.

    facts: fact_id, entities, dimensions, times; items: item_id, entities, dimension_tags, time_markers.
    """
    every, chosen, _ = _chosen(facts, items, least)
    out = every.join(chosen, "fact_id").select(F.col("fact").alias("fact_id"), "level", "level_no", "candidates")
    return out.select("fact_id", "level", (F.col("level_no") > 0).alias("fallback"), "candidates")


def candidate_items(facts: DataFrame, items: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """select_candidates() with the trace of levels tried, and fact_id, item_id of the items of each fact's level.

    Facts that no filter leaves enough for have all items as candidates and no rows in the second frame; they are ranked
    without candidates.
    """
    picked, every, kinds, tagged = _candidate_kinds(facts, items, least)
    return picked, every.join(kinds, "kind").join(tagged, "item_kind").select("fact_id", "item_id")


def _candidate_kinds(facts: DataFrame, items: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """select_candidates() with the trace, then the kind of each fact, kind and item_kind of what is a candidate of what, and the kind of each item."""
    every, chosen, some = _chosen(facts, items, least)
    picked = every.join(chosen, "fact_id").select(F.col("fact").alias("fact_id"), "level", (F.col("level_no") > 0).alias("fallback"), "candidates", "trace")
    kinds = chosen.where("level <> 'all'").select("fact_id", "level_no").join(some, ["fact_id", "level_no"]).select(F.col("fact_id").alias("kind"), "item_kind")
    tagged = items.select("item_id", item_kind(F.col("entities"), F.col("dimension_tags"), F.col("time_markers")).alias("item_kind"))
    return picked, every.select(F.col("fact").alias("fact_id"), F.col("fact_id").alias("kind")), kinds, tagged


def expected_candidates(facts: DataFrame, items: DataFrame, expected: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """candidate_items(), of whose second frame only the rows of ``expected`` (fact_id, item_id) are made: as many as these at most."""
    picked, every, kinds, tagged = _candidate_kinds(facts, items, least)
    asked = expected.distinct().join(every.distinct(), "fact_id").join(tagged.distinct(), "item_id")
    return picked, asked.join(kinds, ["kind", "item_kind"], "left_semi").select("fact_id", "item_id")


def filter_audit(picked: DataFrame, candidates: DataFrame, expected: DataFrame) -> DataFrame:
    """level, facts, kept (facts of which all expected items are candidates), least, most, mean (candidates): by level and, as null, overall.

    picked, candidates: from candidate_items() or, where facts have many candidates, expected_candidates(); expected: fact_id, item_id.
    """
    there = candidates.distinct().withColumn("there", F.lit(True))
    lost = expected.distinct().join(there, ["fact_id", "item_id"], "left").groupBy("fact_id").agg(F.count_if(F.col("there").isNull()).alias("lost"))
    rows = picked.join(lost, "fact_id", "left").withColumn("kept", (F.col("level") == "all") | (F.coalesce("lost", F.lit(0)) == 0))
    measures = [F.count("*").alias("facts"), F.count_if("kept").alias("kept"), F.min("candidates").alias("least"), F.max("candidates").alias("most"), F.round(F.avg("candidates"), DIGITS).alias("mean")]
    return rows.groupingSets([[], [F.col("level")]], F.col("level")).agg(*measures)


def item_kind(entities: Column, dimension_tags: Column, time_markers: Column) -> Column:
    """What candidate_kinds() calls the kind of an item with these tags."""
    return F.xxhash64(entities, dimension_tags, time_markers)


def candidate_kinds(facts: DataFrame, items: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """candidate_items(), whose second frame is fact_id, kind here: a fact's candidates are the items of its kinds (item_kind())."""
    picked, every, kinds, _ = _candidate_kinds(facts, items, least)
    return picked, every.join(kinds, "kind").select("fact_id", F.col("item_kind").alias("kind"))


def ranked_within(queries: DataFrame, docs: DataFrame, picked: DataFrame, kinds: DataFrame, kind: Column, k: int, doc: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """query_id, doc, score, rank by BM25: the k best of each query among the documents of its kinds, or of all where no filter leaves enough.

    queries: query_id, text; picked, kinds: from candidate_kinds(), with query ids as facts; ``kind``: item_kind() over docs. The
    statistics are the corpus's own. One index serves all queries, its blocks of one kind each; a query meets
    the blocks of its kinds and keeps k documents, so that candidates are never listed.
    """
    asked = _asked(queries)
    index = impacts.build(docs, asked.select(F.explode("terms").alias("term")), doc, text, kind=kind)
    within = scratch(asked.join(kinds.select(F.col("fact_id").alias("query_id"), "kind"), "query_id"), "within")
    open_ = asked.join(picked.where("level = 'all'").select(F.col("fact_id").alias("query_id")), "query_id", "left_semi")
    # Of a kind's documents without a match, the first k can be among the best.
    first = top_k(docs.select(F.col(doc).alias("doc"), kind.alias("kind")), "kind", "doc", F.lit(0), k).select("kind", "doc")
    empty = within.select("query_id", "kind").join(first, "kind").select("query_id", "doc", F.lit(0.0).alias("score"))
    scored = impacts.search(index, within, k).unionByName(empty)
    ranked = top_k(scored.groupBy("query_id", "doc").agg(F.max("score").alias("score")), "query_id", "doc", F.col("score"), k)
    return ranked.unionByName(_ranked(index, open_, docs, k, doc))


def retrieval_scores(results: DataFrame, k: int, pool: Column | None = None, count: Column | None = None) -> list[Column]:
    """Aggregates over rows with expected, retrieved (in rank order) and candidates: arrays of ids.

    Instead of candidates, ``pool`` can say whether all expected ones are among them and ``count`` how many they are.
    """
    pool = F.size(F.array_except("expected", "candidates")) == 0 if pool is None else pool
    count = F.size("candidates") if count is None else count
    top = F.slice("retrieved", 1, k)
    hits = F.size(F.array_intersect("expected", top))
    first = F.array_min(F.filter(F.transform("expected", lambda e: F.array_position(top, e)), lambda p: p > 0))
    return [
        F.round(F.avg((hits == F.size("expected")).cast("int")), DIGITS).alias("complete_recall"),
        F.round(F.try_divide(F.sum(hits), F.sum(F.size("expected"))), DIGITS).alias("micro_recall"),
        F.round(F.avg(pool.cast("int")), DIGITS).alias("pool_recall"),
        F.round(F.avg(F.coalesce(1 / first, F.lit(0.0))), DIGITS).alias("mrr"),
        F.round(F.avg(count), DIGITS).alias("mean_candidates"),
    ]
