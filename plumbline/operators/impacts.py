"""BM25 by an impact-ordered index: postings in blocks of documents, a bound for each block, and a top k that skips blocks.

A row of the index is a term in a block of documents: the documents that hold it, highest impact first, their impacts, and
the highest one. An impact is what the term adds to a document's score, so a query's score is a sum of impacts and a block's
bound the sum of its terms' highest ones. The index does not depend on queries; it may be kept and published.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.shapes import let
from plumbline.functions.text import tokenize
from plumbline.sources.scratch import scratch

# BM25's saturation and length weight.
K1, B = 1.5, 0.75
#: Documents of a block, queries of a pack; queries whose packs are broadcast.
BLOCK, PACK, MOST_QUERIES = 4_096, 512, 50_000
#: Terms that are broadcast, with the numbers of their documents; with more, postings meet them in a shuffle.
MOST_TERMS = 1_000_000
DIGITS = 6


def counted(tokens: Column) -> Column:
    """array of struct(term, tf): the distinct tokens of an array and how often they stand in it, from its sorted form."""

    def runs(s: Column) -> Column:
        stops = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
        term = lambda at, i, stops: F.struct(F.get(s, at - 1).alias("term"), (at - F.coalesce(F.get(stops, i - 1), F.lit(0))).alias("tf"))
        return let(stops, lambda ends: F.transform(ends, lambda at, i: term(at, i, ends)))

    return F.when(F.size(tokens) > 0, let(F.sort_array(tokens), runs)).otherwise(F.array().cast("array<struct<term: string, tf: int>>"))


def postings(docs: DataFrame, terms: DataFrame | None = None, doc: str = "doc_id", text: str | Column = "text", kind: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """A table of doc, dl, term, tf, and a row with n and avgdl of the corpus, from one pass over the texts.

    A document is one row. With ``terms`` (term), only postings of these are kept; lengths and the corpus's statistics still count all tokens. ``kind``, an
    expression over docs, is kept beside each posting.
    """
    kinds = [] if kind is None else ["kind"]
    t = docs.select(F.col(doc).alias("doc"), *[kind.alias(c) for c in kinds], tokenize(F.col(text) if isinstance(text, str) else text).alias("t"))
    # A row's terms are counted in the row: rows of a task need not be held together. The null term stands for the document itself.
    whole = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).alias("tf")))
    each = t.select("doc", *kinds, F.size("t").alias("dl"), F.explode(F.concat(whole, counted(F.col("t")))).alias("x"))
    each = each.select("doc", *kinds, "dl", F.col("x.term").alias("term"), F.col("x.tf").cast("long").alias("tf"))
    if terms is not None:
        known = scratch(terms.select(F.col("term").alias("__known")).distinct(), "terms")
        known = F.broadcast(known) if known.count() <= MOST_TERMS else known
        each = each.join(known, F.col("term") == F.col("__known"), "left").where("term IS NULL OR __known IS NOT NULL").drop("__known")
    found = scratch(each, "postings")
    size = found.where("term IS NULL").agg(F.sum("tf").alias("n"), (F.sum(F.col("dl") * F.col("tf")) / F.sum("tf")).alias("avgdl"))
    return found.where("term IS NOT NULL"), size


def weights(found: DataFrame, size: DataFrame) -> DataFrame:
    """term, doc, w (what the term adds to the document's BM25 score), n from postings(), and the document's kind if they have it."""
    # Few terms may have nearly all postings, which a shuffle by term would send to few tasks.
    df = scratch(found.groupBy("term").agg(F.count("*").alias("df")), "counts")
    df = F.broadcast(df) if df.count() <= MOST_TERMS else df
    weighted = found.join(df, "term").join(F.broadcast(size))  # one row
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    return weighted.select("term", "doc", *[c for c in found.columns if c == "kind"], (idf * F.col("tf") * (K1 + 1) / norm).alias("w"), "n")


def build(docs: DataFrame, terms: DataFrame | None = None, doc: str = "doc_id", text: str | Column = "text", block: int = BLOCK, kind: Column | None = None) -> DataFrame:
    """The index as a table: block, term, top, docs, impacts; of all terms, or of those in ``terms``.

    Documents are dealt to blocks by the hash of their id, so that a block has about ``block`` of them and a frequent term is
    in many rows, none of them large. With ``kind``, an expression over docs, a block holds documents of one kind, which is a column
    of the index: queries can then be asked of some kinds only.
    """
    return index(*postings(docs, terms, doc, text, kind), block)


def index(found: DataFrame, size: DataFrame, block: int = BLOCK) -> DataFrame:
    """build() from postings()."""
    found = weights(found, size)
    place = ["kind", "block"] if "kind" in found.columns else ["block"]
    found = found.withColumn("block", F.pmod(F.xxhash64("doc"), F.ceil(F.col("n") / block)))
    ordered = F.sort_array(F.collect_list(F.struct("w", "doc")), asc=False)
    rows = found.groupBy(*place, "term").agg(ordered.alias("x"))
    return scratch(rows.select(*place, "term", F.col("x")[0].w.alias("top"), F.col("x.doc").alias("docs"), F.col("x.w").alias("impacts")), "impacts")


def floors(index: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """query_id, floor: a score that at least k documents reach, the highest k-th impact of the query's terms; 0 if no term has k documents.

    Where terms have a kind, only documents of this kind count, and the floor is the query's among them.
    """
    by = ["kind"] if "kind" in terms.columns else []
    # Of a block, the first k impacts are enough; the rank's limit is applied before rows are shuffled.
    wanted = index.join(terms.select(*by, "term").distinct(), [*by, "term"], "left_semi")
    heads = wanted.select(*by, "term", F.explode(F.slice("impacts", 1, k)).alias("w"))
    ranked = heads.withColumn("r", F.row_number().over(Window.partitionBy(*by, "term").orderBy(F.desc("w")))).where(F.col("r") <= k)
    kth = ranked.where(F.col("r") == k).select(*by, "term", "w")
    return terms.join(kth, [*by, "term"], "left").groupBy("query_id", *by).agg(F.coalesce(F.max("w"), F.lit(0.0)).alias("floor"))


class Best:
    """The k best documents of each query so far, and which blocks cannot change them."""

    def __init__(self, k: int, ones: bool):
        self.k, self.ones, self.held, self.skipped, self.walked = k, ones, {}, 0, 0

    def block(self, names: list[str], tops: np.ndarray, starts: np.ndarray, docs: np.ndarray, impacts: np.ndarray, queries: list[dict]) -> None:
        """Score a block's postings (``starts`` cuts docs and impacts by term) for each query that its bound can matter to."""
        place = {t: i for i, t in enumerate(names)}
        known = at = None
        for q in queries:
            found = [place[t] for t in q["terms"] if t in place]
            if not found:
                continue
            held = self.held.get(q["query_id"])
            least = max(q["floor"], held[0][-1] if held and len(held[0]) == self.k else 0.0)
            bound = float(len(found)) if self.ones else float(tops[found].sum())
            if bound + 10.0**-DIGITS < least:  # scores are rounded before they are compared
                self.skipped += 1
                continue
            self.walked += 1
            if known is None:
                known, at = np.unique(docs, return_inverse=True)
            scores = np.zeros(len(known))
            for i in found:
                part = slice(starts[i], starts[i + 1])
                scores[at[part]] += 1.0 if self.ones else impacts[part]
            scores = np.rint(scores * 10.0**DIGITS) / 10.0**DIGITS
            hit = np.flatnonzero(scores)
            if held:
                all_scores, all_docs = np.concatenate([held[0], scores[hit]]), np.concatenate([held[1], known[hit]])
            else:
                all_scores, all_docs = scores[hit], known[hit]
            if len(all_scores) > 4 * self.k:  # what is below the k-th score goes; ties stay and are told apart by document
                cut = np.partition(all_scores, -self.k)[-self.k]
                all_scores, all_docs = all_scores[all_scores >= cut], all_docs[all_scores >= cut]
            order = np.lexsort((all_docs, -all_scores))[: self.k]
            self.held[q["query_id"]] = (all_scores[order], all_docs[order])


def search(index: DataFrame, queries: DataFrame, k: int, ones: bool = False) -> DataFrame:
    """query_id, doc, score: for each query (query_id, terms) at least the k best documents that hold a term; ties by document.

    Blocks meet packs of queries, which are broadcast while there are at most MOST_QUERIES. A task keeps k documents of each query over
    all its blocks and gives these, so at most k rows of a query leave a partition. With ``ones`` the score is the number
    of the query's terms in the document. Where queries have a ``kind``, a row says that the query is asked of the blocks of this
    kind, and a query has a row for each of its kinds; else it is asked of all.
    """
    by = ["kind"] if "kind" in queries.columns else []
    terms = queries.select("query_id", *by, F.explode("terms").alias("term"))
    asked = queries.select("query_id", *by, "terms")
    asked = asked.withColumn("floor", F.lit(0.0)) if ones else asked.join(floors(index, terms, k), ["query_id", *by], "left").fillna(0.0, ["floor"])
    asked = scratch(asked, "asked")
    n = asked.count()
    packs = asked.groupBy(*by, F.pmod(F.xxhash64("query_id"), F.lit(-(-n // PACK) or 1)).alias("pack")).agg(F.collect_list(F.struct("query_id", "terms", "floor")).alias("queries")).drop("pack")
    packs = F.broadcast(packs) if n <= MOST_QUERIES else packs
    used = index.join(terms.select(*by, "term").distinct(), [*by, "term"], "left_semi")
    place = [c for c in ("kind", "block") if c in index.columns]
    blocks = used.groupBy(*place).agg(F.collect_list(F.struct("term", "top", "docs", "impacts")).alias("rows"))
    met = blocks.join(packs, by) if by else blocks.join(packs)  # blocks against packs of the stated queries
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema} | {"doc": index.schema["docs"].dataType.elementType.simpleString()}
    return met.select("rows", "queries").mapInArrow(_rank(k, ones), f"query_id {kinds['query_id']}, doc {kinds['doc']}, score double")


def _rank(k: int, ones: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, types = Best(k, ones), None
        for batch in batches:
            rows, packs = batch.column("rows"), batch.column("queries")
            for i in range(batch.num_rows):
                block = rows[i].values
                lists = block.field("docs")
                first, last = lists.offsets[0].as_py(), lists.offsets[-1].as_py()
                docs, impacts = (block.field(c).values.slice(first, last - first).to_numpy(zero_copy_only=False) for c in ("docs", "impacts"))
                types = types or (packs.type.value_type.field("query_id").type, lists.type.value_type)
                best.block(block.field("term").to_pylist(), block.field("top").to_numpy(), lists.offsets.to_numpy() - first, docs, impacts, packs[i].as_py())
        if types:
            names = [q for q, (s, _) in best.held.items() for _ in s]
            columns = [np.concatenate(x) if x else [] for x in zip(*best.held.values(), strict=True)] or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(names, types[0]), pa.array(columns[1], types[1]), pa.array(columns[0], pa.float64())], ["query_id", "doc", "score"])

    return run
