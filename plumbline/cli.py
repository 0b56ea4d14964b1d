"""Commands over a published index: index, search, inspect."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from plumbline.functions.text import searchable
from plumbline.operators import lore, retrieval
from plumbline.session import build_session, ship
from plumbline.sources import corpus, tables


def make_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="plumbline")
    parser.add_argument("--master", default="local[4]")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="cut a collection into chunks and publish them")
    index.add_argument("lore")
    index.add_argument("folder")
    index.add_argument("--most", type=int, default=corpus.MOST_TOKENS, help="characters of a chunk")
    search = commands.add_parser("search", help="the best chunks for a query by BM25")
    search.add_argument("folder")
    search.add_argument("query")
    search.add_argument("-k", type=int, default=5)
    inspect = commands.add_parser("inspect", help="domains, dimensions and coverage of a published collection")
    inspect.add_argument("folder")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = make_parser().parse_args(argv)
    spark = build_session(args.master, 4)
    ship(spark)
    if args.command == "index":
        made = corpus.chunks(corpus.read_files(spark, args.lore), len, args.most)
        print(tables.publish(made, args.folder, "chunk_id", {"most": str(args.most)}))
        return 0
    chunks = tables.load(spark, args.folder)
    if args.command == "search":
        q = spark.createDataFrame([(1, args.query)], "query_id long, text string")
        found = retrieval.search_report(q, chunks, args.k, doc="chunk_id", text=searchable(F.col("headings"), F.col("text")))
        for r in found.join(chunks.select(F.col("chunk_id").alias("doc"), "file", "start_line", "text"), "doc").orderBy("rank").collect():
            print(f"{r['rank']}. {r['score']:.4f} {r['file']}:{r['start_line']} {r['text'][:80]!r}")
        return 0
    items = lore.metadata(chunks.select("chunk_id", "file", "start_line", F.col("stop_line").alias("end_line"), F.col("headings").alias("heading_path"), "text"))
    for r in lore.metadata_summary(items).orderBy("section", "name").collect():
        print(f"{r['section']} {r['name']}: {r['n']} ({r['rate']})")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
