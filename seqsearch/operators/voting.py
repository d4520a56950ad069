"""Seeds vote for diagonals; bins of diagonals with enough votes become candidates.

Queries up to ``INDEXED`` letters are indexed by seeds, in groups of about ``GROUP`` letters, and the subjects are held
against each group where they are read: a subject's votes are counted and filtered in the task that has the subject, so no
seed, hit or vote is shuffled. Larger query sets are joined on the k-mer by shuffle, with frequent k-mers salted; both ways
give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..config import SearchConfig
from ..functions.scoring import diagonal_bin, threshold
from .common import cut, pieces, small, spread
from .seedindex import SeedIndex
from .seeds import seeds

#: Letters of queries that are indexed at all: they pass through the driver, and each group reads the subjects once.
INDEXED = 64_000_000
#: Letters of a group of queries: an index of about 16 bytes each, and a table of at most 60 MB, in each worker.
GROUP = 2_000_000
#: Places of one k-mer in the queries that meet the subjects in one task, and k-mers with more that are broadcast at most.
HOT, BROADCAST_HOT = 10_000, 1_000_000
#: Letters of subjects, and subjects, that are looked at together: about 10 bytes a letter.
TOGETHER, SUBJECTS = 1 << 22, 1024


def origin(cfg: SearchConfig) -> Column:
    """Where a subject's positions count from."""
    return F.col("s_offset").cast("long") if cfg.bin_origin == "volume" else F.lit(0).cast("long")


def _least(cfg: SearchConfig) -> Column:
    return F.greatest(threshold("q_len", cfg.k, cfg.filter_level) + 1, F.lit(cfg.min_votes).cast("long"))


def _groups(queries: DataFrame, cfg: SearchConfig, most: int) -> Iterator[list]:
    """The queries with a seed, ``most`` letters at a time."""
    group, size = [], 0
    for row in queries.where(F.length("q_seq") >= cfg.k).select("q_id", "q_len", "q_seq", _least(cfg).alias("least")).toLocalIterator():
        if group and size + len(row["q_seq"]) > most:
            yield group
            group, size = [], 0
        group.append(row)
        size += len(row["q_seq"])
    if group:
        yield group


def indexed(queries: DataFrame, most: int = INDEXED) -> bool:
    return (queries.agg(F.sum(F.length("q_seq").cast("long"))).first()[0] or 0) <= most


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths) of sequences, a byte for each letter; nulls are empty."""
    plain = column.fill_null("")
    lengths = pa.compute.binary_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(x.encode("ascii", "replace") for x in plain.to_pylist()), np.uint8)
    if int(lengths.sum()) != len(data):  # other characters than ASCII
        lengths = pa.compute.utf8_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
    return data, lengths


def _observed(found: DataFrame, counts: list[Observation] | None) -> DataFrame:
    """Adds an observation of ``candidates``, the number of rows, to ``counts``: it is filled by the first run that reads them."""
    if counts is None:
        return found
    counts.append(Observation(f"candidates-{len(counts)}"))
    return found.observe(counts[-1], F.count(F.lit(1)).alias("candidates"))


def _scan(queries: DataFrame, subjects: DataFrame, cfg: SearchConfig, what: str, group: int = GROUP, counts: list[Observation] | None = None, keep: tuple[str, ...] = (), made: str = "", make: Callable | None = None) -> DataFrame:
    """``what``: "hits", "votes" or "candidates" of the subjects, with their columns ``keep``, against each group of queries. With
    ``make`` "candidates" have the columns ``made`` instead of the window: ``make(queries, letters)`` gives a function of (query, begin of
    the subject among the letters, its length, diagonal) for many candidates at a time, that yields rows and columns."""
    source = spread(subjects.select("s_id", "s_seq", origin(cfg).alias("origin"), *keep))
    q_type, s_type = queries.schema["q_id"].dataType.simpleString(), subjects.schema["s_id"].dataType.simpleString()
    head = f"q_id {q_type}, q_len int"
    columns = {"hits": f"{head}, q_pos int, s_id {s_type}, s_pos long", "votes": f"{head}, s_id {s_type}, bin long, votes long", "candidates": f"{head}, s_id {s_type}, bin long, votes long, s_len int, {made or 'begin int, window string'}"}[what]
    columns += "".join(f", {x} {subjects.schema[x].dataType.simpleString()}" for x in keep)
    names = [x.split()[0] for x in columns.split(", ")]

    def scan(rows: list):
        ids = pa.array([r["q_id"] for r in rows], to_arrow_type(queries.schema["q_id"].dataType))
        lengths = np.array([r["q_len"] for r in rows], np.int32)
        sequences, least = [r["q_seq"] for r in rows], [r["least"] for r in rows]
        k, illegal, blank, band = cfg.k, cfg.keep_illegal_seeds, cfg.blank_tail_a, cfg.band

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = SeedIndex(sequences, k, illegal, blank, least if what == "candidates" else None)
            for whole in batches:
                for at, end in pieces(pa.compute.binary_length(whole.column(1)).fill_null(0).to_numpy(), TOGETHER, SUBJECTS):
                    batch = whole.slice(at, end - at)
                    data, n = _letters(batch.column(1))
                    start = batch.column(2).to_numpy(zero_copy_only=False)
                    first = np.cumsum(n) - n
                    if what == "hits":
                        for q, q_pos, s, s_pos in index.hits(data, n):
                            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), pa.array(lengths[q]), pa.array(q_pos), batch.column(0).take(pa.array(s)), pa.array(s_pos + start[s])], names=names)
                        continue
                    aligned = make(sequences, data) if make else None
                    for q, s, place, votes in index.votes(data, n, start):
                        if aligned:
                            for some, columns in aligned(q, first[s], n[s], place * 8 + 3 - start[s]):
                                q_of, s_of = q[some], pa.array(s[some])
                                head = [ids.take(pa.array(q_of)), pa.array(lengths[q_of]), batch.column(0).take(s_of), pa.array(place[some]), pa.array(votes[some]), pa.array(n[s[some]].astype(np.int32))]
                                yield pa.RecordBatch.from_arrays([*head, *columns, *(batch.column(i).take(s_of) for i in range(3, 3 + len(keep)))], names=names)
                            continue
                        found = [ids.take(pa.array(q)), pa.array(lengths[q]), batch.column(0).take(pa.array(s)), pa.array(place), pa.array(votes)]
                        if what == "candidates":
                            # the part of the subject that the band, or the pre-filter's window, can reach
                            diagonal = place * 8 + 3 - start[s]
                            begin = np.clip(diagonal - band - lengths[q], 0, n[s])
                            end = np.clip(diagonal + band, begin, n[s])
                            windows = [data[a:b].tobytes() for a, b in zip((first[s] + begin).tolist(), (first[s] + end).tolist(), strict=True)]
                            found += [pa.array(n[s].astype(np.int32)), pa.array(begin.astype(np.int32)), pa.array(windows, pa.binary()).cast(pa.string())]
                        found += [batch.column(i).take(pa.array(s)) for i in range(3, 3 + len(keep))]
                        yield pa.RecordBatch.from_arrays(found, names=names)

        return source.mapInArrow(run, columns)

    scanned = [_observed(scan(rows), counts) for rows in _groups(queries, cfg, group)]
    if not scanned:
        return queries.sparkSession.createDataFrame([], T._parse_datatype_string(columns))
    return reduce(DataFrame.unionByName, scanned)


def salted(postings: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Adds ``salt`` to ``kmer, ...``: a k-mer with more than ``most`` places is dealt out to so many salts that each has about
    ``most``. And ``kmer, salts`` of these k-mers, of which there are at most one for each ``most`` places."""
    hot = postings.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("kmer", F.ceil(F.col("n") / most).cast("int").alias("salts"))
    hot = cut(hot, "hot-kmers")
    salts = F.coalesce("salts", F.lit(1))
    return postings.join(small(hot, BROADCAST_HOT), "kmer", "left").withColumn("salt", F.pmod(F.xxhash64("q_id", "q_pos"), salts).cast("int")).drop("salts"), hot


def joined_hits(queries: DataFrame, subjects: DataFrame, cfg: SearchConfig, most: int = HOT) -> DataFrame:
    """``seed_hits`` as an inner equi-join on the k-mer, for query sets of any size.

    A k-mer that very many queries share would bring all its places into one task; its places are dealt out to salts, and
    only the subjects' places of such k-mers are repeated, once for each. A k-mer that is frequent among the subjects
    is split by Spark as a skewed partition.
    """
    of_q = seeds(queries, "q_id", "q_seq", cfg.k, ("q_len",), cfg.keep_illegal_seeds, cfg.blank_tail_a).withColumnRenamed("pos", "q_pos")
    of_s = seeds(spread(subjects.select("s_id", "s_seq", origin(cfg).alias("origin"))), "s_id", "s_seq", cfg.k, ("origin",), cfg.keep_illegal_seeds, False)
    of_s = of_s.select("s_id", "kmer", (F.col("pos") + F.col("origin")).alias("s_pos"))
    of_q, hot = salted(of_q, most)
    of_s = of_s.join(small(hot, BROADCAST_HOT), "kmer", "left").select("s_id", "kmer", "s_pos", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    return of_s.join(of_q, ["kmer", "salt"]).select("q_id", "q_len", "q_pos", "s_id", "s_pos")


def joined_votes(queries: DataFrame, subjects: DataFrame, cfg: SearchConfig) -> DataFrame:
    hits = joined_hits(queries, subjects, cfg).select("q_id", "q_len", "s_id", diagonal_bin("q_len", "s_pos", "q_pos").alias("bin"))
    return hits.groupBy("q_id", "q_len", "s_id", "bin").agg(F.count(F.lit(1)).alias("votes"))


def seed_hits(queries: DataFrame, subjects: DataFrame, cfg: SearchConfig) -> DataFrame:
    """``q_id, q_len, q_pos, s_id, s_pos`` of every exact match of a seed."""
    return _scan(queries, subjects, cfg, "hits") if indexed(queries) else joined_hits(queries, subjects, cfg)


def votes(queries: DataFrame, subjects: DataFrame, cfg: SearchConfig) -> DataFrame:
    """``q_id, q_len, s_id, bin, votes``: hits counted by query, subject and bin of eight diagonals."""
    return _scan(queries, subjects, cfg, "votes") if indexed(queries) else joined_votes(queries, subjects, cfg)


def candidates(queries: DataFrame, subjects: DataFrame, cfg: SearchConfig, counts: list[Observation] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Votes above the threshold of the query's length; with ``s_len`` and, where the index is used, the ``window`` of the
    subject from ``begin`` on that the candidate's band can reach and the subject's columns ``keep``, so that subjects need not be joined again. Then
    candidates of a query come in the order in which a task reads the subjects, and by bins.

    ``counts`` gets an observation for each group of queries, with the number of its candidates before all filters."""
    if indexed(queries):
        return _scan(queries, subjects, cfg, "candidates", counts=counts, keep=keep)
    return _observed(joined_votes(queries, subjects, cfg).where(F.col("votes") >= _least(cfg)), counts)


def with_candidates(queries: DataFrame, subjects: DataFrame, cfg: SearchConfig, made: str, make: Callable, keep: tuple[str, ...] = ()) -> DataFrame:
    """What ``make`` finds of the candidates, in the columns ``made`` and in the task that has the subject, so that neither
    windows nor queries go anywhere. Only where ``indexed``."""
    return _scan(queries, subjects, cfg, "candidates", keep=keep, made=made, make=make)
