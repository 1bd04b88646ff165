"""Pluggable encoders run as Arrow batches.

An encoder is any callable ``list[str] -> np.ndarray`` (one row per text) for
single vectors, or ``list[str] -> list[np.ndarray]`` for multi-vectors.  It is
built once per task from a picklable factory, called in batches of
``batch_size`` texts, and its wall time per batch is recorded so the
embedding cost (M7) is an aggregation over the output.

The default encoders are deterministic feature-hashing models (no network,
no model files) so that results can be checked against SQL.
"""

from __future__ import annotations

import hashlib
import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank.functions.text import with_prefix
from lumenrank.operators import vector_search

_TOKEN_SPLIT = regex.compile(r"[^\p{L}\p{N}]+")

# Default hashing encoder layout.
HASH_DIM = 64          # buckets of the single-vector encoder
TOKEN_DIM = 16         # width of a per-token vector of the multi-vector encoder


_ASCII_SPLIT = bytes(i if i > 127 or chr(i).isalnum() else 32 for i in range(256))


def _tokens(text: str) -> list[str]:
    """Runs of letters and digits: cut at other ASCII characters first, so that the expression sees only what is left of others."""
    pieces = text.lower().encode("utf-8", "surrogatepass").translate(_ASCII_SPLIT).decode("utf-8", "surrogatepass").split()
    if all(map(str.isascii, pieces)):
        return pieces
    out = []
    for piece in pieces:
        if piece.isascii():
            out.append(piece)
        else:
            out += [t for t in _TOKEN_SPLIT.split(piece) if t]
    return out


class _TokenMemory(dict):
    """What a token hashes to, computed once; forgotten as a whole when it has too many."""

    LIMIT = 500_000

    def __init__(self, of: Callable[[str], int]):
        super().__init__()
        self.of = of

    def __missing__(self, token: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[token] = self.of(token)
        return value


def hashing_encoder(dim: int = HASH_DIM) -> Callable[[list[str]], np.ndarray]:
    """Signed feature hashing of lexical tokens, L2-normalised, float32.

    bucket = first 8 hex digits of md5(token) mod dim; sign = + when the 9th
    hex digit is below 8.  A text without tokens maps to the zero vector.
    """
    def cell(token: str) -> int:
        h = hashlib.md5(token.encode("utf-8")).hexdigest()
        return int(h[:8], 16) % dim * 2 + (int(h[8], 16) >= 8)

    memory = _TokenMemory(cell)

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float64)
        for i, t in enumerate(texts):
            cells = np.fromiter(map(memory.__getitem__, _tokens(t or "")), np.int64)
            counts = np.bincount(cells, minlength=2 * dim)
            out[i] = counts[::2] - counts[1::2]
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        out = np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)
        return out.astype(np.float32)
    return encode


def token_hashing_encoder(dim: int = TOKEN_DIM, distinct: bool = False) -> Callable[[list[str]], list[np.ndarray]]:
    """Multi-vector default: one +-1/sqrt(dim) vector per token occurrence,
    signs from the bits of md5(token).  ``distinct`` keeps one of equal tokens
    (first occurrence), which leaves every maximum over a document as it is."""
    scale = np.float32(1.0 / np.sqrt(dim))
    low, values = (1 << dim) - 1, np.array([-scale, scale], np.float32)
    memory = _TokenMemory(lambda t: int.from_bytes(hashlib.md5(t.encode("utf-8")).digest()[-8:]) & low)
    if dim > 63:
        raise ValueError("at most 63 signs per token")

    def encode(texts: list[str]) -> list[np.ndarray]:
        out = []
        for x in texts:
            found = _tokens(x or "")
            bits = np.fromiter(map(memory.__getitem__, dict.fromkeys(found) if distinct else found), "<i8")
            out.append(values[np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, count=dim, bitorder="little")])
        return out
    return encode


def distinct_token_encoder() -> Callable[[list[str]], list[np.ndarray]]:
    """The multi-vector default for documents: equal tokens once."""
    return token_hashing_encoder(distinct=True)


def _lists(values: list[np.ndarray], multi: bool) -> pa.Array:
    """Vectors (or lists of vectors) as nested Arrow lists of floats."""
    def nested(inner: pa.Array, sizes: list[int]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), inner)

    arrays = [np.asarray(v, np.float32) for v in values]
    flat = pa.array(np.concatenate([a.reshape(-1) for a in arrays]) if arrays else np.zeros(0, np.float32))
    if not multi:
        return nested(flat, [a.size for a in arrays])
    rows = [a.shape[1] if a.ndim == 2 else 0 for a in arrays for _ in range(len(a))]
    return nested(nested(flat, rows), [len(a) for a in arrays])


def _source(df: DataFrame, id_col: str, text_col: str, prefix: str | None, carry: Sequence[str] = ()) -> DataFrame:
    return df.select(F.col(id_col).cast("string").alias("_id"), with_prefix(F.col(text_col), prefix).alias("_text"), *carry)


def embed(df: DataFrame, encoder_factory: Callable[[], Callable] = hashing_encoder,
          id_col: str = "id", text_col: str = "text", prefix: str | None = None,
          batch_size: int = 32, multi: bool = False,
          out_id: str = "doc_id", packed: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """U1 (U3 when ``multi``): ``(out_id, vector|vectors, embed_ms)``.

    X5: ``prefix`` is prepended for embedding only.  ``embed_ms`` is this row's
    share of its batch's wall time, so ``sum(embed_ms)`` is the total cost.
    ``packed`` gives a document's vectors as one binary value (``vector_search.pack``);
    columns named by ``carry`` stay in the row, so that no join brings them back.
    """
    if packed and not multi:
        raise ValueError("only lists of vectors are packed")
    vcol = "vectors" if multi else "vector"
    kind = "binary" if packed else "array<array<float>>" if multi else "array<float>"
    schema = ", ".join([f"{out_id} string, {vcol} {kind}, embed_ms double",
                        *(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_factory()
        for batch in batches:
            for s in range(0, len(batch), batch_size):
                part = batch.slice(s, batch_size)
                texts = part.column("_text").to_pylist()
                t0 = time.perf_counter()
                vecs = encode(texts)
                ms = (time.perf_counter() - t0) * 1000.0
                if len(vecs) != len(texts):
                    raise ValueError("encoder returned a wrong number of vectors")
                values = pa.array([vector_search.pack(v) for v in vecs], pa.binary()) if packed else _lists(list(vecs), multi)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), values, pa.array([ms / len(texts)] * len(texts), pa.float64()),
                     *(part.column(c) for c in carry)], names=[out_id, vcol, "embed_ms", *carry])

    return _source(df, id_col, text_col, prefix, carry).mapInArrow(run, schema)


def embed_remote(df: DataFrame, transport_factory: Callable[[], Callable[[list[str]], list]],
                 id_col: str = "id", text_col: str = "text", prefix: str | None = None, batch_size: int = 100,
                 retries: int = 3, workers: int = 4, out_id: str = "doc_id",
                 sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``(out_id, vector, embed_ms, attempts, error)`` from a remote encoder.

    A task sends batches of ``batch_size`` texts, at most ``workers`` at a time.  A call
    that fails, or answers with a wrong number of vectors, is repeated up to ``retries``
    times with doubling pauses; after that its rows come out with a null vector and the
    last error, so no text is lost and the rest of the job goes on.
    """
    schema = f"{out_id} string, vector array<float>, embed_ms double, attempts int, error string"

    def call(transport: Callable, texts: list[str]) -> tuple[list | None, float, int, str | None]:
        error, t0 = None, time.perf_counter()
        for attempt in range(1, retries + 2):
            try:
                vectors = transport(texts)
                if len(vectors) != len(texts):
                    raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
                return list(vectors), (time.perf_counter() - t0) * 1000.0, attempt, None
            except Exception as e:  # noqa: BLE001  (what a transport raises is its own)
                error = f"{type(e).__name__}: {e}"
                if attempt <= retries:
                    sleep(2.0 ** (attempt - 1))
        return None, (time.perf_counter() - t0) * 1000.0, retries + 1, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transport = transport_factory()

        def answer(part: pa.RecordBatch, result) -> pa.RecordBatch:
            vectors, ms, attempts, error = result
            n = len(part)
            values = (_lists(vectors, False) if vectors is not None else pa.nulls(n, pa.list_(pa.float32())))
            return pa.RecordBatch.from_arrays(
                [part.column("_id"), values, pa.array([ms / n] * n, pa.float64()), pa.array([attempts] * n, pa.int32()),
                 pa.array([error] * n, pa.string())], names=[out_id, "vector", "embed_ms", "attempts", "error"])

        parts = (b.slice(s, batch_size) for b in batches for s in range(0, len(b), batch_size))
        with ThreadPoolExecutor(workers) as pool:
            waiting: deque = deque()
            for part in parts:
                waiting.append((part, pool.submit(call, transport, part.column("_text").to_pylist())))
                if len(waiting) >= workers:
                    first, result = waiting.popleft()
                    yield answer(first, result.result())
            for first, result in waiting:
                yield answer(first, result.result())

    return _source(df, id_col, text_col, prefix).mapInArrow(run, schema)


def embedding_cost(vectors: DataFrame) -> DataFrame:
    """M7: total and per-document embedding time."""
    return vectors.agg(F.count(F.lit(1)).alias("num_documents"),
                       F.sum("embed_ms").alias("total_embed_time_ms"),
                       (F.sum("embed_ms") / F.count(F.lit(1))).alias("avg_embed_time_ms"))


def check_vector_count(corpus: DataFrame, vectors: DataFrame, id_col: str = "id",
                       vec_id: str = "doc_id") -> None:
    """Every document has exactly one vector and every vector a document."""
    c = corpus.select(F.col(id_col).cast("string").alias("k"))
    v = vectors.select(F.col(vec_id).alias("k"))
    missing = c.join(v, "k", "left_anti").limit(1).count()
    extra = v.join(c, "k", "left_anti").limit(1).count()
    dup = v.groupBy("k").count().where("count > 1").limit(1).count()
    if missing or extra or dup:
        raise ValueError("vector count does not match document count")
