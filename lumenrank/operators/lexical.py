"""BM25 over document-partitioned index blocks.

The index is a table of blocks.  A block holds some documents of like length: their ids
and lengths, the postings of their terms (block-local document numbers with term
frequencies) and, per term, the largest frequency and the shortest document.  From those
two follows an upper bound of what the term can add to any score in the block.

A search sends the query terms' weights to the blocks (the stated query set; the corpus
never moves).  A task keeps a running top-k per query and skips every (query, block) whose
bound cannot reach that query's k-th score; the others are scored by adding up postings.
Only k rows per task and query leave a task, so nothing is exchanged per (query, document).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lumenrank.functions.text import tokens
from lumenrank.operators import topk
from lumenrank.session import bounded_broadcast, stored

# BM25 parameters (Robertson and Zaragoza 2009 defaults).
K1 = 1.2
B = 0.75
SCORE_DECIMALS = topk.DECIMALS

BLOCK_DOCS = 32             # documents of a block, at most
BLOCK_WORDS = 50_000        # words of a block of more than one document
ROW_GROUP = 16 << 20        # bytes of blocks that a task holds before it writes them
SORTED_DOCS = 4096          # documents that are put in order of length together
QUERY_WEIGHTS = 2_000_000   # (query, term) weights that are sent to the tasks at once
CELLS = 2_000_000           # (query, document) scores that a task computes at once

POSTINGS = ("ids array<string>, lens array<int>, terms array<string>, ends array<int>, docs array<int>, "
            "tfs array<int>, max_tf array<int>, min_len array<int>")


@dataclass
class LexicalIndex:
    """Blocks in the shared folder, with the corpus statistics that scores need."""

    blocks: DataFrame
    n_docs: int
    avgdl: float
    k1: float = K1
    b: float = B

    @property
    def terms(self) -> DataFrame:
        """``(term, df, idf)`` of the whole vocabulary."""
        return self._with_idf(self._block_terms())

    def idf_of(self, wanted: DataFrame) -> DataFrame:
        """``(term, df, idf)`` of the terms in ``wanted``, counted in the blocks that have them."""
        return self._with_idf(self._block_terms().join(bounded_broadcast(wanted.select("term").distinct()),
                                                       "term", "left_semi"))

    def _block_terms(self) -> DataFrame:
        sizes = F.transform("ends", lambda e, i: e - F.when(i == 0, 0).otherwise(F.element_at("ends", F.greatest(i, F.lit(1)))))
        return self.blocks.select(F.explode(F.arrays_zip("terms", sizes.alias("n"))).alias("x")).select(
            F.col("x.terms").alias("term"), F.col("x.n").alias("n"))

    def _with_idf(self, rows: DataFrame) -> DataFrame:
        n = F.lit(float(self.n_docs))
        return rows.groupBy("term").agg(F.sum("n").alias("df")).withColumn(
            "idf", F.log(F.lit(1.0) + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def _runs(values: np.ndarray) -> np.ndarray:
    """Starts of runs of equal neighbours."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _blocks_of(ids: list, texts: pa.ListArray, vectors: pa.Array | None) -> Iterator[dict]:
    """Blocks of the documents of a batch, the longest documents first (they raise thresholds soonest)."""
    words = texts.flatten().dictionary_encode()
    codes, names = words.indices.to_numpy(zero_copy_only=False), words.dictionary
    lens = np.array([0 if n is None else n for n in texts.value_lengths().to_pylist()], np.int64)
    starts = np.cumsum(lens) - lens
    order = np.argsort(-lens, kind="stable")
    end = 0
    while end < len(order):
        i, room = end, BLOCK_WORDS
        while end < len(order) and end - i < BLOCK_DOCS and (end == i or lens[order[end]] <= room):
            room -= lens[order[end]]
            end += 1
        members = order[i:end]
        size = lens[members]
        place = np.repeat(starts[members] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        # one number per occurrence, (term, document): runs of equal numbers are term frequencies
        pair = np.sort(codes[place].astype(np.int64) * len(members) + np.repeat(np.arange(len(members)), size))
        at = _runs(pair)
        tf = np.diff(np.append(at, len(pair)))
        term, doc = np.divmod(pair[at], max(len(members), 1))
        first = _runs(term)
        block = {"ids": [ids[m] for m in members], "lens": size.astype(np.int32),
                 "terms": names.take(pa.array(term[first])),
                 "ends": np.append(first[1:], len(term)).astype(np.int32)[:len(first)],
                 "docs": doc.astype(np.int32), "tfs": tf.astype(np.int32),
                 "max_tf": (np.maximum.reduceat(tf, first) if len(first) else tf).astype(np.int32),
                 "min_len": (np.minimum.reduceat(size[doc], first) if len(first) else tf).astype(np.int32)}
        if vectors is not None:
            block["vectors"] = vectors.take(pa.array(members))
        yield block


def build_blocks(corpus: DataFrame, id_col: str = "id", text_col: str = "text",
                 vectors: DataFrame | None = None, vector_col: str = "vector") -> DataFrame:
    """Blocks of a corpus; with ``vectors`` (doc_id, vector) each block also holds its documents' vectors.

    Without vectors, or if ``vectors`` is the corpus itself (its rows have them), a map over the
    corpus; else one exchange by document id, after which a document's text and vector stay together.
    """
    schema, with_vectors = POSTINGS, vectors is not None
    own = [F.col(vector_col).alias("_v")] if vectors is corpus else []
    src = corpus.select(F.col(id_col).cast("string").alias("_id"), F.coalesce(tokens(text_col), F.array()).alias("_t"), *own)
    if with_vectors:
        kind = vectors.schema[vector_col].dataType.simpleString()
        schema += f", vectors array<{kind}>"
    if with_vectors and not own:
        src = src.join(vectors.select(F.col("doc_id").alias("_id"), F.col(vector_col).alias("_v")), "_id", "left")
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), SORTED_DOCS):
                part = batch.slice(i, SORTED_DOCS)
                made = list(_blocks_of(part.column("_id").to_pylist(), part.column("_t"),
                                       part.column("_v") if with_vectors else None))
                columns = []
                for name in names:
                    if name in ("terms", "vectors"):
                        inner = pa.concat_arrays([b[name] for b in made])
                        ends = np.cumsum([0, *(len(b[name]) for b in made)]).astype(np.int32)
                        columns.append(pa.ListArray.from_arrays(pa.array(ends), inner))
                    else:
                        columns.append(pa.array([b[name] for b in made], pa.list_(pa.string() if name == "ids" else pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return src.mapInArrow(build, schema)


def check_complete(documents: int, indexed: int) -> None:
    """Every document is in the index, once."""
    if documents != indexed:
        raise ValueError(f"{indexed} of {documents} documents are in the index")


def build_index(corpus: DataFrame, id_col: str = "id", text_col: str = "text", k1: float = K1, b: float = B,
                vectors: DataFrame | None = None, vector_col: str = "vector") -> LexicalIndex:
    """Blocks written to the shared folder, and N and the average length read from them.

    V13: documents read and documents written are counted by the write itself; a failed
    row ends the job, and a wrong count is an error.
    """
    came, went = Observation(), Observation()
    seen = corpus.observe(came, F.count(F.lit(1)).alias("n"))
    blocks = build_blocks(seen, id_col, text_col, seen if vectors is corpus else vectors, vector_col)
    blocks = stored(blocks.observe(went, F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n")), "blocks", ROW_GROUP)
    check_complete(came.get["n"], went.get["n"])
    length = F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)
    n, total = blocks.agg(F.sum(F.size("ids")), F.sum(length)).first()
    return LexicalIndex(blocks, n or 0, float(total or 0) / n if n else 0.0, k1, b)


def query_terms(queries: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(query_id, term, qtf)``: repeated query terms count once per occurrence."""
    return (queries.select(F.col(id_col).cast("string").alias("query_id"),
                           F.explode(tokens(text_col)).alias("term"))
            .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))


def query_weights(index: LexicalIndex, queries: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(query_id, term, w)`` of the query terms that the corpus has."""
    qt = stored(query_terms(queries, id_col, text_col), "query-terms")
    return stored(qt.join(index.idf_of(qt), "term")
                  .select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w")), "query-weights")


class TermWeights:
    """Query weights by term, for a bounded set of queries (sent to the tasks)."""

    def __init__(self, table: pa.Table, number: dict[str, int]):
        table = table.sort_by([("term", "ascending"), ("query_id", "ascending")])
        terms = table.column("term").to_pylist()
        self.query = np.array([number[q] for q in table.column("query_id").to_pylist()], np.int64)
        self.weight = table.column("w").to_numpy().astype(np.float64)
        first = _runs(np.array(terms, object))
        self.terms = pa.array([terms[i] for i in first], pa.string())
        self.lo, self.hi = first, np.append(first[1:], len(terms)).astype(np.int64)[:len(first)]

    def places(self, terms: pa.Array) -> np.ndarray:
        """The number of each term among the queries' terms, or -1."""
        return pc.fill_null(pc.index_in(terms, self.terms), -1).to_numpy(zero_copy_only=False)


class BlockPostings:
    """The postings of a block that concern the queries, with bounds and scores."""

    def __init__(self, row: dict, weights: TermWeights, n_queries: int, k1: float, b: float, avgdl: float):
        self.ids = np.array(row["ids"], object)
        self.n_queries = n_queries
        lens = np.asarray(row["lens"], np.float64)
        norm = (lambda dl: k1 * (1.0 - b + b * dl / avgdl)) if avgdl > 0 else (lambda dl: np.full(len(dl), k1 * (1.0 - b)))
        j = np.flatnonzero(row["places"] >= 0)
        lo, hi = weights.lo[row["places"][j]], weights.hi[row["places"][j]]
        ends = np.asarray(row["ends"], np.int64)
        self.start = np.concatenate([[0], ends])[j]
        self.size = ends[j] - self.start
        docs, tf = np.asarray(row["docs"], np.int64), np.asarray(row["tfs"], np.float64)
        self.docs = docs
        self.value = tf * (k1 + 1.0) / (tf + norm(lens[docs])) if len(docs) else tf
        best = np.asarray(row["max_tf"], np.float64)[j]
        bound = best * (k1 + 1.0) / (best + norm(np.asarray(row["min_len"], np.float64)[j])) if len(j) else best
        # pairs (query, term of the block)
        count = hi - lo
        self.term = np.repeat(np.arange(len(j)), count)
        at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
        self.query, self.weight = weights.query[at], weights.weight[at]
        self.bound = np.bincount(self.query, self.weight * bound[self.term], minlength=n_queries)

    def scores(self, wanted: np.ndarray) -> np.ndarray:
        """Raw BM25 of the wanted queries (sorted numbers) and all documents; 0 without a common term."""
        row = np.full(self.n_queries, -1, np.int64)
        row[wanted] = np.arange(len(wanted))
        pair = np.flatnonzero(row[self.query] >= 0)
        size = self.size[self.term[pair]]
        ends = np.cumsum(size)
        posting = np.repeat(self.start[self.term[pair]] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        cell = np.repeat(row[self.query[pair]], size) * len(self.ids) + self.docs[posting]
        added = np.repeat(self.weight[pair], size) * self.value[posting]
        return np.bincount(cell, added, minlength=len(wanted) * len(self.ids)).reshape(len(wanted), len(self.ids))


class GroupPostings:
    """The postings of several blocks as those of one."""

    def __init__(self, blocks: list[BlockPostings]):
        self.blocks, self.ends = blocks, np.cumsum([len(x.ids) for x in blocks])
        self.bound = np.max([x.bound for x in blocks], axis=0)

    def scores(self, wanted: np.ndarray) -> np.ndarray:
        out = np.zeros((len(wanted), int(self.ends[-1])))
        for block, end in zip(self.blocks, self.ends.tolist()):
            some = np.flatnonzero(block.bound[wanted] > 0)
            if len(some):
                out[some, end - len(block.ids):end] = block.scores(wanted[some])
        return out
