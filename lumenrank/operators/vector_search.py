"""R4/R6 vector scores: dense dot product and late-interaction MaxSim, on blocks of documents.

Scores come in two kinds.  ``approximate`` is a matrix product of a tile of queries with
a block (fast, last bits free); ``exact`` adds one dimension after the other for chosen
(query, document) pairs, in the order a plain loop would, so a pair has the same score
whatever block, tile or plan it is in.  Searches use the first to find what can matter
and the second for every value that leaves a task.

Lists of vectors may come packed, one binary value a document (``pack``).  Vectors whose
components all have one magnitude (those of a hashing encoder) are kept as their signs: the
product of two follows from the number of unlike signs, so maxima are taken over bytes.
"""

from __future__ import annotations

import struct
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

TILE_BYTES = 32 << 20       # products held at once
ERROR = 1e-12               # relative gap between the two kinds, with room to spare
SIGN_TILE = 2048            # query vectors whose signs are compared at once
SIGN_RUN = 128              # documents whose signs are compared at once
FEW = 8                     # so few documents of a run are gone through one by one
PAIR_VECTORS = 2_000_000    # query vectors of the pairs that are scored exactly at once


def _sequential(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows of ``a`` and ``b`` (broadcast), dimension after dimension."""
    total = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for i in range(a.shape[-1]):
        total += a[..., i] * b[..., i]
    return total


def _flat(vectors: pa.Array) -> np.ndarray:
    """The values of nested lists, in double precision; a null or non-finite value is an error of the input."""
    while pa.types.is_list(vectors.type) or pa.types.is_large_list(vectors.type):
        vectors = vectors.flatten()
    return vectors.to_numpy(zero_copy_only=False).astype(np.float64)


class Dense:
    """One vector per document or query.  A missing or empty vector counts as zeros."""

    def __init__(self, vectors: pa.Array):
        size = np.array([n or 0 for n in vectors.value_lengths().to_pylist()], np.int64)
        width = int(size.max(initial=0))
        if ((size != width) & (size > 0)).any():
            raise ValueError("vectors have different lengths")
        self.rows = np.zeros((len(size), width))
        if width:
            self.rows[size > 0] = _flat(vectors).reshape(-1, width)
        self.missing = size == 0

    def __len__(self) -> int:
        return len(self.rows)

    def tile(self, documents: Dense) -> int:
        return max(1, TILE_BYTES // (8 * max(len(documents), 1)))

    def approximate(self, lo: int, hi: int, documents: Dense) -> np.ndarray:
        return self._fit(self.rows[lo:hi], documents) @ documents.rows.T

    def exact(self, queries: np.ndarray, places: np.ndarray, documents: Dense) -> np.ndarray:
        return _sequential(self._fit(self.rows[queries], documents), documents.rows[places])

    @staticmethod
    def _fit(rows: np.ndarray, documents: Dense) -> np.ndarray:
        """Queries against documents without any vector score zero."""
        return rows if documents.rows.shape[1] else rows[:, :0]


_HEADER = struct.Struct("<iif")     # vectors, components, and the magnitude of all components (0: floats follow, else signs)


def _magnitude(rows: np.ndarray) -> float:
    """What all components have as magnitude, if it is one and a vector's signs fit 64 bits; else 0."""
    if not rows.size or rows.shape[1] > 64:
        return 0.0
    one = float(abs(rows[0, 0]))
    return one if 0.0 < one < np.inf and (np.abs(rows) == one).all() else 0.0


def _code_type(width: int) -> np.dtype:
    return np.dtype(next(f"<u{n}" for n in (1, 2, 4, 8) if width <= 8 * n))


def _codes(rows: np.ndarray) -> np.ndarray:
    """A number per vector, with a bit for each positive component."""
    kind = _code_type(rows.shape[1])
    held = np.zeros((len(rows), kind.itemsize), np.uint8)
    bits = np.packbits(rows > 0, axis=1, bitorder="little")
    held[:, :bits.shape[1]] = bits
    return held.view(kind)[:, 0]


def _decoded(codes: np.ndarray, width: int, magnitude: float) -> np.ndarray:
    bits = codes[..., None] >> np.arange(width, dtype=codes.dtype) & codes.dtype.type(1)
    return np.where(bits == 1, magnitude, -magnitude)


def pack(rows: np.ndarray) -> bytes:
    """The float vectors of a document as one value."""
    rows = np.ascontiguousarray(rows, "<f4")
    one = _magnitude(rows)
    head = _HEADER.pack(len(rows), rows.shape[1] if rows.ndim == 2 else 0, one)
    return head + (_codes(rows) if one else rows).tobytes()


def is_packed(lists: pa.Array) -> bool:
    return pa.types.is_binary(lists.type) or pa.types.is_large_binary(lists.type)


def count(lists: pa.Array) -> int:
    """How many vectors some lists have."""
    if is_packed(lists):
        return sum(_HEADER.unpack_from(v)[0] for v in lists.to_pylist() if v is not None)
    return len(lists.flatten())


_UNLIKE_BYTES = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))


def _unlike(tables: list[np.ndarray], part: np.ndarray, total: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Unlike signs of vectors (their bytes) with the codes of ``tables``; the last two are room for sums."""
    tables[0].take(part[0], axis=0, out=total, mode="clip")
    for table, number in zip(tables[1:], part[1:]):
        np.add(total, table.take(number, axis=0, out=more, mode="clip"), out=total)
    return total


def _rounded_up(n: np.ndarray) -> np.ndarray:
    """Lengths made greater by less than a quarter, so that few different ones are left."""
    step = 1 << np.maximum(np.floor(np.log2(np.maximum(n, 1))).astype(np.int64) - 2, 0)
    return -(-n // step) * step


class Multi:
    """A list of vectors per document or query; MaxSim is the sum over query vectors of the best product.

    An empty list scores 0; a null one is missing.  Vectors of one magnitude are kept as ``signs``,
    others as distinct ones (equal vectors are multiplied once) and the place of each among them.
    """

    def __init__(self, vectors: pa.Array):
        self.missing = vectors.is_null().to_numpy(zero_copy_only=False)
        self.signs, self.magnitude, self.width, rows = None, 0.0, 0, np.zeros((0, 0))
        if is_packed(vectors):
            values = vectors.to_pylist()
            heads = [(0, 0, 0.0) if v is None else _HEADER.unpack_from(v) for v in values]
            self.size = np.array([n for n, _, _ in heads], np.int64)
            kinds = {(width, one) for n, width, one in heads if n}
            if len(kinds) == 1 and min(kinds)[1]:
                self.width, self.magnitude = min(kinds)
                self.signs = np.frombuffer(b"".join(v[_HEADER.size:] for v, h in zip(values, heads) if h[0]), _code_type(self.width))
            elif kinds:
                rows = np.concatenate([self._rows(v, *h) for v, h in zip(values, heads) if h[0]])
        else:
            self.size = np.array([n or 0 for n in vectors.value_lengths().to_pylist()], np.int64)
            if self.size.any():
                rows = _flat(vectors).reshape(int(self.size.sum()), -1)
                self.width, self.magnitude = rows.shape[1], _magnitude(rows)
                self.signs = _codes(rows) if self.magnitude else None
        if self.signs is None:
            self.width = rows.shape[1]
            self._distinct = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
        self.start = np.cumsum(self.size) - self.size
        order = np.argsort(-self.size, kind="stable")[:np.count_nonzero(self.size)]
        self.by_size = order, self.size[order]     # those with a vector, the longest first

    @staticmethod
    def _rows(value: bytes, n: int, width: int, one: float) -> np.ndarray:
        if one:
            return _decoded(np.frombuffer(value, _code_type(width), offset=_HEADER.size), width, one)
        return np.frombuffer(value, "<f4", offset=_HEADER.size).reshape(n, width).astype(np.float64)

    @cached_property
    def _distinct(self) -> tuple[np.ndarray, np.ndarray]:
        codes, back = np.unique(self.signs, return_inverse=True)
        return _decoded(codes, self.width, self.magnitude), back

    @property
    def distinct(self) -> np.ndarray:
        return self._distinct[0]

    @property
    def of(self) -> np.ndarray:
        return self._distinct[1].reshape(-1)

    def at(self, places: np.ndarray) -> np.ndarray:
        """Vectors by their place in the lists."""
        if self.signs is not None:
            return _decoded(self.signs[places], self.width, self.magnitude)
        return self.distinct[self.of[places]]

    def __len__(self) -> int:
        return len(self.size)

    @cached_property
    def values(self) -> int:
        """Distinct vectors: so many maxima a document has with all lists."""
        return len(self.distinct)

    def _both_signs(self, documents: Multi) -> bool:
        return self.signs is not None and documents.signs is not None and self.width == documents.width

    def tile(self, documents: Multi) -> int:
        mean = -(-int(self.size.sum()) // max(len(self), 1))
        of_pair = max(mean, 8) if self._both_signs(documents) else 8 * max(mean, 1)      # a byte or a double a query vector
        return max(1, TILE_BYTES // (of_pair * max(len(documents), 1)))

    def approximate(self, lo: int, hi: int, documents: Multi) -> np.ndarray:
        out = np.zeros((hi - lo, len(documents)))
        mine = slice(self.start[lo], self.start[hi - 1] + self.size[hi - 1]) if hi > lo else slice(0, 0)
        if mine.start == mine.stop or not documents.size.any():
            return out
        if self._both_signs(documents):
            used, place = np.unique(self.signs[mine], return_inverse=True)
            # unlike signs per query: the least of a document's vectors for each of the query's
            unlike = self._by_position(lo, hi, place, documents.least_unlike(used), np.int32)
            size = self.size[lo:hi, None]
            out = self.magnitude * documents.magnitude * (self.width * size - 2.0 * unlike)
            out[:, documents.size == 0] = 0.0
            return out
        used, place = np.unique(self.of[mine], return_inverse=True)
        step = max(1, TILE_BYTES // (8 * (len(documents.distinct) + len(documents))))
        best = np.zeros((len(documents), len(used)))
        for i in range(0, len(used), step):
            products = documents.distinct @ self.distinct[used[i:i + step]].T
            self._maxima(products, documents, best[:, i:i + step])
        return self._by_position(lo, hi, place, best, np.float64)

    def _by_position(self, lo: int, hi: int, place: np.ndarray, best: np.ndarray, kind: type) -> np.ndarray:
        """Sums of queries' columns of ``best``: all first vectors of queries, then all second ones."""
        out = np.zeros((hi - lo, len(best)), kind)
        order = np.argsort(-self.size[lo:hi], kind="stable")
        first, size = (self.start[lo:hi] - self.start[lo])[order], self.size[lo:hi][order]
        some = np.searchsorted(-size, -np.arange(size[0]))
        for i in range(0, len(best), SIGN_RUN):
            columns = best[i:i + SIGN_RUN].T.astype(kind, order="C")
            total = np.zeros((len(order), columns.shape[1]), kind)
            for p, n in enumerate(some.tolist()):
                total[:n] += columns[place[first[:n] + p]]
            out[order, i:i + SIGN_RUN] = total
        return out

    @cached_property
    def _runs(self) -> list[tuple]:
        """Documents with a vector in runs, the longest first: their numbers, the bytes of all first vectors, of all
        second ones and so on, and what is left of a run's few longest documents."""
        order, size = self.by_size
        parts, runs = self._bytes, []
        for i in range(0, len(order), SIGN_RUN):
            documents, n = order[i:i + SIGN_RUN], size[i:i + SIGN_RUN]
            start = self.start[documents]
            some = np.searchsorted(-n, -np.arange(n[0]))
            some = some[some > FEW]
            columns = [parts[:, start[:m] + p] for p, m in enumerate(some.tolist())]
            rest = [(j, parts[:, start[j] + len(some):start[j] + n[j]]) for j in np.flatnonzero(n > len(some)).tolist()]
            runs.append((documents, columns, rest))
        return runs

    @cached_property
    def _bytes(self) -> np.ndarray:
        """The signs of all vectors byte by byte, as row numbers of tables."""
        held = self.signs.view(np.uint8).reshape(-1, self.signs.dtype.itemsize)
        return held[:, :-(-self.width // 8)].T.astype(np.intp)

    def _tables(self, codes: np.ndarray) -> list[np.ndarray]:
        """Unlike signs of every byte with each byte of ``codes``: their sum over the bytes is that of two vectors."""
        theirs = codes.view(np.uint8).reshape(len(codes), -1)
        return [_UNLIKE_BYTES.take(theirs[:, b], axis=1) for b in range(-(-self.width // 8))]

    def least_unlike(self, codes: np.ndarray) -> np.ndarray:
        """Per document and code of ``codes`` the least number of unlike signs among the document's vectors."""
        out = np.zeros((len(self), len(codes)), np.uint8)
        for i in range(0, len(codes), SIGN_TILE):
            tables = self._tables(codes[i:i + SIGN_TILE])
            width = tables[0].shape[1]
            total, more = (np.empty((SIGN_RUN, width), np.uint8) for _ in range(2))
            for documents, columns, rest in self._runs:
                least = np.full((len(documents), width), 255, np.uint8)
                for part in columns:
                    n = part.shape[1]
                    np.minimum(least[:n], _unlike(tables, part, total[:n], more[:n]), out=least[:n])
                for j, part in rest:
                    for k in range(0, part.shape[1], SIGN_RUN):
                        n = part[:, k:k + SIGN_RUN].shape[1]
                        found = _unlike(tables, part[:, k:k + SIGN_RUN], total[:n], more[:n])
                        np.minimum(least[j], found.min(axis=0), out=least[j])
                out[documents, i:i + SIGN_TILE] = least
        return out

    @staticmethod
    def _maxima(products: np.ndarray, documents: Multi, out: np.ndarray) -> None:
        """Per document the greatest row of ``products`` among its vectors, position by position, longest documents first."""
        order, size = documents.by_size
        if not len(order):
            return
        held = products[documents.of[documents.start[order]]]
        for p in range(1, int(size[0])):
            some = int(np.searchsorted(-size, -p))
            np.maximum(held[:some], products[documents.of[documents.start[order[:some]] + p]], out=held[:some])
        out[order] = held

    def exact(self, queries: np.ndarray, places: np.ndarray, documents: Multi) -> np.ndarray:
        if self._both_signs(documents):
            return self._exact_by_signs(queries, places, documents)
        out = np.zeros(len(queries))
        m, n = self.size[queries], documents.size[places]
        # pairs of like shapes go through the same additions together: a repeated last vector of the
        # document changes no maximum, and one of the query is not added
        shape = _rounded_up(m), _rounded_up(n)
        order = np.lexsort(shape)
        cuts = np.flatnonzero((np.diff(shape[0][order]) != 0) | (np.diff(shape[1][order]) != 0)) + 1
        for same in np.split(order, cuts) if len(order) else []:
            rows, columns = int(shape[0][same[0]]), int(shape[1][same[0]])
            if not rows or not columns:
                continue
            width = max(rows * columns, (rows + columns) * self.width)
            step = max(1, TILE_BYTES // (32 * width))
            for i in range(0, len(same), step):
                part = same[i:i + step]
                mine = self.start[queries[part], None] + np.minimum(np.arange(rows), m[part, None] - 1)
                theirs = documents.start[places[part], None] + np.minimum(np.arange(columns), n[part, None] - 1)
                best = self._largest(mine, theirs, documents)
                total = np.zeros(len(part))
                for j in range(rows):
                    total += np.where(j < m[part], best[:, j], 0.0)
                out[part] = total
        return out

    def _largest(self, mine: np.ndarray, theirs: np.ndarray, documents: Multi) -> np.ndarray:
        """Per pair (first axis) and query vector the greatest sequential product with a vector of the document.

        A matrix product tells which vectors can have it; only those go through the sequential sum.
        """
        a, b = self.at(mine), documents.at(theirs)
        products = np.matmul(a, b.transpose(0, 2, 1))
        norm = np.sqrt((a * a).sum(axis=2).max() * (b * b).sum(axis=2).max())
        near = products >= products.max(axis=2, keepdims=True) - 2 * ERROR * max(1.0, norm)
        row, k = np.divmod(np.flatnonzero(near), near.shape[2])
        values = _sequential(self.at(mine.reshape(-1)[row]), documents.at(theirs[row // mine.shape[1], k]))
        return np.maximum.reduceat(values, np.flatnonzero(np.diff(row, prepend=-1))).reshape(mine.shape)

    def _exact_by_signs(self, queries: np.ndarray, places: np.ndarray, documents: Multi) -> np.ndarray:
        """Document by document, with all vectors of the queries asked of it."""
        out = np.zeros(len(queries))
        asked = np.flatnonzero((self.size[queries] > 0) & (documents.size[places] > 0))
        asked = asked[np.argsort(places[asked], kind="stable")]
        parts = np.cumsum(self.size[queries[asked]]) // PAIR_VECTORS
        for part in np.split(asked, np.flatnonzero(np.diff(parts)) + 1) if len(asked) else []:
            size = self.size[queries[part]]
            ends = np.cumsum(size)
            first = ends - size
            codes = self.signs[np.repeat(self.start[queries[part]] - first, size) + np.arange(ends[-1])]
            best = np.empty(len(codes))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(places[part])) + 1, [len(part)]])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                these = slice(first[lo], ends[hi - 1])
                distinct, back = np.unique(codes[these], return_inverse=True)
                best[these] = documents._greatest(int(places[part[lo]]), distinct, self.magnitude)[back]
            order = np.argsort(-size, kind="stable")
            total = np.zeros(len(part))
            for p, n in enumerate(np.searchsorted(-size[order], -np.arange(size.max())).tolist()):
                total[:n] += best[first[order[:n]] + p]
            out[part[order]] = total
        return out

    def _greatest(self, place: int, codes: np.ndarray, magnitude: float) -> np.ndarray:
        """Per code the greatest sequential product with a vector of a document: only those with the fewest unlike signs are summed."""
        start, n = int(self.start[place]), int(self.size[place])
        best, step = np.full(len(codes), -np.inf), max(1, TILE_BYTES // (2 * n))
        for i in range(0, len(codes), step):
            some = codes[i:i + step]
            unlike = _unlike(self._tables(some), self._bytes[:, start:start + n], *(np.empty((n, len(some)), np.uint8) for _ in range(2)))
            v, j = np.divmod(np.flatnonzero(unlike == unlike.min(axis=0)), len(some))
            np.maximum.at(best, i + j, _sequential(_decoded(some[j], self.width, magnitude), self.at(start + v)))
        return best


KINDS = {"dense": Dense, "maxsim": Multi}
COLUMN = {"dense": "vector", "maxsim": "vectors"}


def dot(a: str, b: str):
    """JVM-side dot product of two ``array<float|double>`` columns (double precision)."""
    return F.aggregate(
        F.zip_with(F.col(a), F.col(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda acc, x: acc + x)
