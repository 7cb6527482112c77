"""Inverted-file cells over unit vectors: packed vectors, fitted centres, exact angle bounds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.session import partitions

DIM = 64
#: Rows that centres are fitted on, at most: those of smallest hash.
FIT_ROWS = 65_536
#: Centres, at most; every row is compared with all of them once.
MAX_CELLS = 8_192
#: A row within this angle of its nearest centre belongs to that cell's core; others are far rows, held in blocks.
CORE = np.deg2rad(40.0)
#: Slack on angles for float32 arithmetic.
SLACK = 2e-3


def usable_rows(col: pa.ChunkedArray, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, float32 rows) of the usable embeddings of a list column: dim values, none null, NaN or infinite, not all
    zero."""
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if not len(a):
        return np.empty(0, np.int64), np.zeros((0, dim), np.float32)
    offsets = a.offsets.to_numpy()
    values = a.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    whole = np.flatnonzero((np.diff(offsets) == dim) & a.is_valid().to_numpy(zero_copy_only=False))
    x = values[offsets[whole][:, None] + np.arange(dim)]
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return whole[ok], x[ok]


def vectors(df: DataFrame, ids: list[str], emb: str = "emb") -> DataFrame:
    """ids and `vec`, the packed embedding; null where the embedding is not usable."""
    fields = {c: df.schema[c].dataType.simpleString() for c in ids}

    def f(t: pa.Table) -> pa.Table:
        at, x = usable_rows(t[emb])
        vec = packed(x).take(_positions(at, t.num_rows))
        return t.select(ids).append_column("vec", vec)

    return map_arrow(df.select(*ids, emb), f, ", ".join(f"{c} {k}" for c, k in fields.items()) + ", vec binary")


def _positions(at: np.ndarray, n: int) -> pa.Array:
    """For each of n rows its place in `at`, null where it has none."""
    place = np.full(n, -1, np.int64)
    place[at] = np.arange(len(at))
    return pa.array(place, mask=place < 0)


def matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """float32 rows of a packed column without nulls."""
    chunks = col.chunks if isinstance(col, pa.ChunkedArray) else [col]
    parts = []
    for a in chunks:
        if len(a):
            width = np.int64 if pa.types.is_large_binary(a.type) else np.int32
            start = int(np.frombuffer(a.buffers()[1], width)[a.offset])
            parts.append(np.frombuffer(a.buffers()[2], np.uint8, len(a) * DIM * 4, start).view(np.float32).reshape(-1, DIM))
    return np.concatenate(parts) if parts else np.zeros((0, DIM), np.float32)


def packed(x: np.ndarray) -> pa.Array:
    """Rows as a binary column."""
    x = np.ascontiguousarray(x, np.float32)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(x.tobytes())])


def unit(x: np.ndarray) -> np.ndarray:
    """Unit rows, computed in double precision: tiny and huge vectors keep their direction."""
    out = np.empty(x.shape, np.float32)
    for s in range(0, len(x), 4096):
        y = x[s : s + 4096].astype(np.float64)
        y /= np.abs(y).max(axis=1, keepdims=True)
        out[s : s + 4096] = y / np.linalg.norm(y, axis=1, keepdims=True)
    return out


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))


def marked(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a matrix that is nearly all False, which takes numpy longer than the product that it comes from; looked for
    flat, it takes a tenth of that."""
    at = np.flatnonzero(mask)
    i = at // mask.shape[1]
    return i, at - i * mask.shape[1]


def pairs_at_least(a: np.ndarray, b: np.ndarray, tau: float, raw_a: np.ndarray | None = None, raw_b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) with cosine(a[i], b[j]) >= tau; a and b are unit rows. Blocks keep the products small; pairs within
    float32 error of tau are decided in double precision on the raw rows."""
    left, right = [], []
    for s in range(0, len(a), 1024):
        for r in range(0, len(b), 4096):
            c = a[s : s + 1024] @ b[r : r + 4096].T
            i, j = marked(c >= tau - 1e-5)
            if len(i):
                near = c[i, j] < tau + 1e-5
                if near.any():
                    ra, rb = (raw_a if raw_a is not None else a), (raw_b if raw_b is not None else b)
                    ok = np.ones(len(i), bool)
                    ok[near] = exact_cosine(ra[s + i[near]], rb[r + j[near]]) >= tau
                    i, j = i[ok], j[ok]
                left.append(s + i)
                right.append(r + j)
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


@dataclass
class Cells:
    """Fitted centres (unit rows) and, once known, the angle of the farthest core member of each."""

    centres: np.ndarray
    radius: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, max_cells: int = MAX_CELLS, near: float = np.cos(np.deg2rad(32.0)), passes: int = 2, seed: int = 0) -> Cells:
        """Centres from a bounded sample: leaders at least 32 degrees apart that a second row of the sample supports, each
        moved to the mean of its rows. Vectors that resemble nothing else get no centre; bounds do not depend on the fit."""
        x = unit(sample) if len(sample) else np.zeros((0, DIM), np.float32)
        leaders = np.zeros((0, DIM), np.float32)
        for s in range(0, len(x), 1024):
            part = x[s : s + 1024]
            if len(leaders):
                part = part[_best(part, leaders)[1] < near]
            while len(part):  # the first row leads all rows near it
                c = part @ part[: min(len(part), 256)].T >= near
                taken = np.zeros(len(part), bool)
                new = []
                for k in range(c.shape[1]):
                    if not taken[k]:
                        new.append(k)
                        taken |= c[:, k]
                leaders = np.concatenate([leaders, part[new]])
                part = part[~taken]
        for _ in range(passes):
            if not len(leaders):
                break
            who, cos = _best(x, leaders)
            who = np.where(cos >= near - 0.1, who, -1)
            n = np.bincount(who[who >= 0], minlength=len(leaders))
            keep = np.flatnonzero(n >= 2)
            keep = np.sort(keep[np.argsort(-n[keep], kind="stable")[:max_cells]])
            sums = np.zeros((len(leaders), DIM))
            for s in range(0, len(x), 8192):
                w = who[s : s + 8192]
                np.add.at(sums, w[w >= 0], x[s : s + 8192][w >= 0])
            leaders = unit(sums[keep]) if len(keep) else np.zeros((0, DIM), np.float32)
        return Cells(leaders, np.full(len(leaders), CORE, np.float32))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest centre, or -1 for a far row; angle to the nearest centre) of unit rows."""
        if not len(self.centres):
            return np.full(len(x), -1, np.int32), np.full(len(x), np.pi, np.float32)
        who, cos = _best(x, self.centres)
        angle = np.arccos(np.clip(cos, -1, 1))
        return np.where(angle <= CORE, who, -1).astype(np.int32), angle.astype(np.float32)

    def visits(self, x: np.ndarray, home: np.ndarray, alpha: float, above_home: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every other cell whose core may hold a vector within alpha of the row: by the triangle inequality on
        the sphere, the row's angle to the centre is then at most radius + alpha. With above_home, a core row only visits cells
        numbered above its own: of two core rows within alpha one visits the other."""
        if not len(self.centres):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        reach = np.cos(np.minimum(np.pi, self.radius + alpha + SLACK)).astype(np.float32)
        rows, cells = [], []
        for s in range(0, len(x), 2048):
            i, c = marked(x[s : s + 2048] @ self.centres.T >= reach)
            h = home[s + i]
            ok = (c != h) & ((h < 0) | (c > h) if above_home else True)
            rows.append(s + i[ok])
            cells.append(c[ok])
        return np.concatenate(rows), np.concatenate(cells)


def _best(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    who, cos = np.empty(len(x), np.int64), np.empty(len(x), np.float32)
    for s in range(0, len(x), 256):
        c = x[s : s + 256] @ centres.T
        k = c.argmax(axis=1)
        who[s : s + 256], cos[s : s + 256] = k, c[np.arange(len(k)), k]
    return who, cos


def sample_rows(df: DataFrame, vector: str, by: str, rows: int = FIT_ROWS) -> np.ndarray:
    """At most `rows` vectors for fitting: a hash threshold, set from the count, thins the table before anything is gathered;
    a bounded limit takes the rest. The sample does not depend on how the table is laid out."""
    n = df.count()
    usable = df.where(F.col(vector).isNotNull())
    h = F.pmod(F.xxhash64(by), F.lit(1 << 30))
    if n > rows:
        usable = usable.where(h < int((1 << 30) * rows / n))
    got = usable.select(vector).limit(rows + rows // 8).toArrow()
    return matrix(got[vector]) if got.num_rows else np.zeros((0, DIM), np.float32)


def map_arrow(df: DataFrame, f, schema: str, rows: int = 8192) -> DataFrame:
    """mapInArrow with batches joined to about `rows` rows, so that matrix products stay large; no empty batch reaches f."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= rows:
                yield from f(pa.Table.from_batches(held)).to_batches()
                held, n = [], 0
        if held:
            yield from f(pa.Table.from_batches(held)).to_batches()

    return df.mapInArrow(run, schema)


def column(t: pa.Table, name: str) -> np.ndarray:
    """A column without nulls as an array."""
    return t[name].combine_chunks().to_numpy(zero_copy_only=False)


@dataclass
class Layout:
    """How rows are spread over tasks: parts of each cell and groups of far rows, from the fitting sample."""

    cells: Cells
    parts: np.ndarray  # parts that each cell's rows are split into
    far_groups: int

    @staticmethod
    def plan(sample: np.ndarray, rows: int, part_rows: int, block_rows: int) -> Layout:
        cells = Cells.fit(sample)
        x = unit(sample) if len(sample) else sample
        home, angle = cells.assign(x)
        n = max(1, len(x))
        share = np.bincount(home[home >= 0], minlength=len(cells.centres)) / n
        far = (home < 0).sum() / n
        return Layout(cells, np.maximum(1, np.ceil(share * rows / part_rows)).astype(np.int64), int(max(1, np.ceil(far * rows / block_rows))))


def spread(ids: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """A number below n for each id, by a multiplicative hash."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(33)).astype(np.int64) % n


def block_id(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of the task that meets far groups i and j, below zero and the same for (j, i)."""
    lo, hi = np.minimum(i, j).astype(np.int64), np.maximum(i, j).astype(np.int64)
    return -(hi * (hi + 1) // 2 + lo) - 1


def buckets(spark, rows: int) -> int:
    """Groups that cell tasks are hashed into: several for each shuffle partition, so that hashing them evens out, and of about
    10,000 rows, whatever the table's size."""
    return max(8 * partitions(spark), -(-rows // 10_000))
