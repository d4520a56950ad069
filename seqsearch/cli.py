"""``python -m seqsearch.cli build-db FASTA OUT`` and ``python -m seqsearch.cli search -q FASTA -d DB... -o OUT``."""

from __future__ import annotations

import argparse

from pyspark.sql import Observation, SparkSession

from .config import SearchConfig
from .plans.search import search
from .sources.fasta import read_fasta, with_ids
from .sources.sinks import write
from .sources.store import build_db, of_part, open_db, open_meta, volume_size


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seqsearch", description="Many-against-many sequence similarity search.")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build-db", help="turn FASTA into a sequence store")
    b.add_argument("fasta")
    b.add_argument("out")
    b.add_argument("--max-residues", type=int, help="residues of a volume; else from the input's size and the executors' memory")
    b.add_argument("--batch-gb", type=float, help="of a part of 16 volumes, in units of 2 ** 30")
    s = sub.add_parser("search", help="search queries against one or more stores", add_help=False)
    s.add_argument("--help", action="help", help="show this message")
    s.add_argument("-q", "--query", required=True)
    s.add_argument("-d", "--db", nargs="+", required=True)
    s.add_argument("-o", "--out", required=True)
    s.add_argument("--outfmt", type=int, default=0, choices=range(6), help="0 tabular, 1 pairwise, 2 tabular and FASTA, 3 extended, 4 A3M, 5 reduced")
    s.add_argument("-k", "--seed-length", type=int, default=5)
    s.add_argument("-p", "--filter-level", type=int, default=1)
    s.add_argument("-e", "--max-evalue", type=float, default=10.0)
    s.add_argument("--min-score", type=int, default=0)
    s.add_argument("--max-output-align", type=int, default=0, help="0: all")
    s.add_argument("--band-width", type=int, default=8)
    s.add_argument("--must-include", nargs="+", default=[], metavar="EXPRESSION COUNT", help="pairs of an expression and a count")
    for flags in (["--num-threads"], ["-w", "--qit-width"], ["-h", "--hash-size"], ["--gpu"]):
        s.add_argument(*flags, help="taken and ignored: the cluster decides")
    return p


def config(args: argparse.Namespace) -> SearchConfig:
    pairs = args.must_include
    if len(pairs) % 2:
        raise SystemExit("--must-include takes pairs of an expression and a count")
    return SearchConfig(k=args.seed_length, filter_level=args.filter_level, min_score=args.min_score, max_evalue=args.max_evalue, max_align=args.max_output_align, band=args.band_width, must_include=tuple((pairs[i], int(pairs[i + 1])) for i in range(0, len(pairs), 2)))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("seqsearch").getOrCreate()
    if args.command == "build-db":
        found = with_ids(read_fasta(spark, args.fasta, "db"), "s")
        size = int(str(spark.read.text(args.fasta)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        most = of_part(int(args.batch_gb * 2**30)) if args.batch_gb else args.max_residues or volume_size(spark, size)
        build_db(found, args.out, most)
        return
    cfg = config(args)
    queries = with_ids(read_fasta(spark, args.query, "query"), "q")
    counts: list[Observation] = []
    hits = search(queries, open_db(spark, *args.db), cfg, open_meta(spark, *args.db), counts)
    write(hits, queries, args.outfmt, args.out)
    for i, seen in enumerate(counts, 1):
        print(f"group {i} of {len(counts)}: {seen.get['candidates']} candidates")


if __name__ == "__main__":
    main()
