"""Most similar vectors: additive quantisation in inverted-file cells, lookup-table scores, exact reranking; then every cell that
the bounds leave open is compared exactly."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.llm.cells import CORE, DIM, SLACK, Cells, _best, buckets, column, exact_cosine, map_arrow, matrix, packed, sample_rows, unit, vectors
from lumenfold.session import scratch_path, small, stage

#: Codebooks, codewords of each, and partial codes kept while encoding.
BOOKS, WORDS, BEAM = 8, 64, 4
#: Sample rows that codebooks are fitted on, at most (of the cells' own sample).
BOOK_ROWS = 16_384
#: Candidates of a query that are reranked exactly, per wanted neighbour.
RERANK = 40
#: A query visits cells until they hold so many rows per reranked candidate, MIN_CELLS at least and MAX_VISITS at most.
ROWS_PER_CANDIDATE, MIN_CELLS, MAX_VISITS = 2, 4, 64
#: Rows of a cell handled by one task; larger cells are split by hash.
CELL_ROWS = 50_000


@dataclass
class AdditiveIndex:
    """Cells and full-dimensional codebooks; a vector is approximated by its cell's centre and one codeword of each book."""

    cells: Cells
    books: np.ndarray  # float32 [BOOKS, WORDS, DIM]
    share: np.ndarray  # share of the rows in each cell, from the sample

    @staticmethod
    def fit(sample: np.ndarray, passes: int = 2, seed: int = 0) -> AdditiveIndex:
        """Residual k-means for a start, then least-squares codebooks and beam-search codes in turn."""
        cells = Cells.fit(sample)
        x = unit(sample) if len(sample) else sample
        if not len(cells.centres):
            cells = Cells(x[:1] if len(x) else np.eye(1, DIM, dtype=np.float32), np.full(1, np.pi, np.float32))
        who, cos = _best(x, cells.centres)
        share = np.bincount(who, minlength=len(cells.centres)) / max(1, len(x))
        rng = np.random.default_rng(seed)
        # books are fitted on rows near their centre, where fine distinctions matter; on all rows if those are too few
        core = np.flatnonzero(cos >= np.cos(CORE))
        core = core if len(core) >= 10 * WORDS else np.arange(len(x))
        core = core[rng.permutation(len(core))[:BOOK_ROWS]]
        x = x[core] - cells.centres[who[core]]
        books = np.zeros((BOOKS, WORDS, DIM), np.float32)
        rest = x.copy()
        for m in range(BOOKS if len(x) else 0):
            c = rest[rng.integers(0, len(rest), WORDS)]
            for _ in range(5):
                k = ((rest @ c.T) * 2 - (c * c).sum(1)).argmax(1)
                n = np.bincount(k, minlength=WORDS)
                sums = np.zeros((WORDS, DIM))
                np.add.at(sums, k, rest)
                c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c).astype(np.float32)
            books[m] = c
            rest = rest - c[((rest @ c.T) * 2 - (c * c).sum(1)).argmax(1)]
        index = AdditiveIndex(cells, books, share)
        for _ in range(passes if len(x) else 0):
            codes = index.encode(x)[0]
            gram, right = 1e-3 * np.eye(BOOKS * WORDS), np.zeros((BOOKS * WORDS, DIM))
            for s in range(0, len(x), 4096):
                hot = np.zeros((len(x[s : s + 4096]), BOOKS * WORDS), np.float32)
                hot[np.arange(len(hot))[:, None], codes[s : s + 4096] + np.arange(BOOKS) * WORDS] = 1.0
                gram += hot.T @ hot
                right += hot.T @ x[s : s + 4096]
            index.books = np.linalg.solve(gram, right).astype(np.float32).reshape(BOOKS, WORDS, DIM)
        return index

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes uint8 [n, BOOKS], sums of their codewords) of residuals by beam search: at every book the BEAM partial sums
        of least error go on."""
        codes = np.zeros((len(x), BOOKS), np.uint8)
        sums = np.zeros((len(x), DIM), np.float32)
        for s in range(0, len(x), 512):
            codes[s : s + 512], sums[s : s + 512] = self._encode(x[s : s + 512])
        return codes, sums

    def _encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(x)
        sums = np.zeros((n, 1, DIM), np.float32)
        err = np.zeros((n, 1), np.float32)
        codes = np.zeros((n, 1, 0), np.uint8)
        row = np.arange(n)[:, None]
        for c in self.books:
            width = sums.shape[1]
            cost = (c * c).sum(1)[None, None, :] - 2 * (x[:, None, :] - sums).reshape(-1, DIM).__matmul__(c.T).reshape(n, width, WORDS)
            cost += err[:, :, None]
            cost = cost.reshape(n, -1)
            best = np.argpartition(cost, BEAM - 1, axis=1)[:, :BEAM]
            beam, word = best // WORDS, best % WORDS
            err = cost[row, best]
            sums = sums[row, beam] + c[word]
            codes = np.concatenate([codes[row, beam], word[:, :, None].astype(np.uint8)], axis=2)
        k = err.argmin(axis=1)
        return codes[np.arange(n), k], sums[np.arange(n), k]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of every codeword with every query: [BOOKS, WORDS, queries]."""
        return np.ascontiguousarray((self.books.reshape(-1, DIM) @ q.T).reshape(BOOKS, WORDS, len(q)))

    @staticmethod
    def score(centre: np.ndarray, tables: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Approximate cosines [rows, queries]: the centre's product with each query and one table row looked up per book,
        divided by the stored norm."""
        out = np.repeat(centre[None, :], len(codes), axis=0)
        for m in range(BOOKS):
            out += tables[m][codes[:, m]]
        out /= norms[:, None]
        return out

    def probes(self, q: np.ndarray, rows: float, want: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell): for each query its cells by lower bound of the angle, until they hold `want` rows."""
        i, c = [], []
        for s in range(0, len(q), 2048):
            bound = np.arccos(np.clip(q[s : s + 2048] @ self.cells.centres.T, -1, 1))
            order = np.argsort(bound, axis=1)[:, :MAX_VISITS]
            held = np.cumsum(self.share[order] * rows, axis=1)
            take = np.concatenate([np.ones((len(order), 1), bool), held[:, :-1] < want], axis=1)
            take[:, :MIN_CELLS] = True
            r, k = np.nonzero(take)
            i.append(s + r)
            c.append(order[r, k])
        return (np.concatenate(i), np.concatenate(c)) if i else (np.empty(0, np.int64), np.empty(0, np.int64))

    def open_cells(self, q: np.ndarray, angle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell): every cell that may hold a row within `angle` of its query. Such a row is at most nearest + angle from
        the query's nearest centre, so its own nearest centre is no farther from it, and at most nearest + 2 angle from the query."""
        away = np.arccos(np.clip(q @ self.cells.centres.T, -1, 1))
        return np.nonzero(away <= (away.min(axis=1) + 2 * angle + SLACK)[:, None])

    def salts(self, rows: float) -> np.ndarray:
        """Parts that each cell is split into."""
        return np.maximum(1, np.ceil(self.share * rows / CELL_ROWS)).astype(np.int64)


_CODED = "rec_id long, key long, cell int, part int, code binary, norm float, vec binary"
_ASKED = "q_id long, q_key long, cell int, part int, vec binary"


def encode(vecs: DataFrame, index, rows: float) -> DataFrame:
    """Every usable row with its cell, codes and norm, and its vector for reranking; a scan for scores reads only the first."""

    def f(t: pa.Table) -> pa.Table:
        ix: AdditiveIndex = index.value
        x = unit(matrix(t["vec"]))
        cell, _ = _best(x, ix.cells.centres)
        codes, sums = ix.encode(x - ix.cells.centres[cell])
        norms = np.maximum(np.linalg.norm(ix.cells.centres[cell] + sums, axis=1), 1e-6).astype(np.float32)
        ids = column(t, "rec_id")
        part = _mix(ids) % ix.salts(rows)[cell]
        raw = np.ascontiguousarray(codes)
        offsets = np.arange(len(raw) + 1, dtype=np.int32) * BOOKS
        code = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])
        return pa.table({"rec_id": ids, "key": column(t, "key"), "cell": cell.astype(np.int32), "part": part.astype(np.int32), "code": code, "norm": norms, "vec": t["vec"]})

    return map_arrow(vecs.select("rec_id", "key", "vec"), f, _CODED)


def _mix(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)).astype(np.int64))


class Index:
    """A persisted index: model and encoded rows in a shared folder. Built once, searched any number of times."""

    def __init__(self, spark: SparkSession, path: str):
        """Opens the index at path."""
        self.path = path
        self.model, self.rows = pickle.loads(bytes(spark.read.parquet(f"{path}/model").first()[0]))
        self.store = spark.read.schema(_CODED).parquet(f"{path}/rows")

    @staticmethod
    def build(vecs: DataFrame, path: str | None = None) -> Index:
        """Fits the model on a bounded sample of vecs (rec_id, key, vec), encodes all rows and writes both to path."""
        spark = vecs.sparkSession
        path = path or scratch_path(spark, "index")
        rows = vecs.count()
        model = AdditiveIndex.fit(sample_rows(vecs, "vec", "rec_id"))
        coded = encode(vecs, spark.sparkContext.broadcast(model), rows)
        coded.sortWithinPartitions("cell").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/rows")
        one = spark.createDataFrame([(bytearray(pickle.dumps((model, rows))),)], "model binary")
        one.coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
        return Index(spark, path)

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """See `nearest`."""
        return _search(self, queries, k)


def nearest(vecs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(q_id, rec_id, cosine, rank): for every query the k rows of highest cosine with another key.

    vecs: (rec_id, key, vec), staged; queries: the same columns. key is a hash of the picture's identity; rows of the query's
    own key, and the query itself, are left out. Codes are scored by tables in the visited cells and RERANK * k candidates a
    query are reranked in double precision; the k-th cosine found bounds the cells that may hold better rows (all of them for
    most queries that resemble no centre), and these are compared exactly. Ties go to the smaller rec_id.
    """
    return Index.build(vecs).search(queries, k)


def _search(built: Index, queries: DataFrame, k: int) -> DataFrame:
    spark = queries.sparkSession
    rows, keep = built.rows, RERANK * k
    index = spark.sparkContext.broadcast(built.model)

    def ask(t: pa.Table) -> pa.Table:
        ix: AdditiveIndex = index.value
        x = unit(matrix(t["vec"]))
        i, c = ix.probes(x, rows, ROWS_PER_CANDIDATE * keep)
        n = ix.salts(rows)[c]
        at = np.repeat(np.arange(len(i)), n)
        part = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        i, c = i[at], c[at]
        return pa.table({"q_id": column(t, "rec_id")[i], "q_key": column(t, "key")[i], "cell": c.astype(np.int32), "part": part.astype(np.int32), "vec": packed(x[i])})

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        ix: AdditiveIndex = index.value
        out_q, out_r, out_s = [], [], []
        if left.num_rows and right.num_rows:
            where, asked = [column(t, "cell").astype(np.int64) * (1 << 20) + column(t, "part") for t in (left, right)]
            lo, ro = np.argsort(where, kind="stable"), np.argsort(asked, kind="stable")
            lw, rw = where[lo], asked[ro]
            code = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(-1, BOOKS)[lo]
            norm, rec, key = column(left, "norm")[lo], column(left, "rec_id")[lo], column(left, "key")[lo]
            q, qid, qkey = unit(matrix(right["vec"]))[ro], column(right, "q_id")[ro], column(right, "q_key")[ro]
            for v in np.unique(rw):
                a, b = np.searchsorted(lw, [v, v + 1])
                c, d = np.searchsorted(rw, [v, v + 1])
                for e in range(c, d if b > a else c, 256):
                    g = slice(e, min(e + 256, d))
                    s = ix.score(q[g] @ ix.cells.centres[v >> 20], ix.tables(q[g]), code[a:b], norm[a:b]).T
                    s[(qkey[g, None] == key[None, a:b]) | (qid[g, None] == rec[None, a:b])] = -np.inf
                    top = np.argpartition(-s, keep - 1, axis=1)[:, :keep] if s.shape[1] > keep else np.broadcast_to(np.arange(s.shape[1]), s.shape)
                    got = np.take_along_axis(s, top, axis=1)
                    i, j = np.nonzero(got > -np.inf)
                    out_q.append(qid[g][i])
                    out_r.append(rec[a:b][top[i, j]])
                    out_s.append(got[i, j])
        cat = lambda p, kind: np.concatenate(p) if p else np.empty(0, kind)
        return pa.table({"q_id": cat(out_q, np.int64), "rec_id": cat(out_r, np.int64), "score": cat(out_s, np.float32)})

    bucket = F.pmod(F.xxhash64("cell", "part"), F.lit(buckets(spark, rows))).alias("bucket")
    store = built.store.select("rec_id", "key", "cell", "part", "code", "norm", bucket)
    asked = map_arrow(queries.select("rec_id", "key", "vec"), ask, _ASKED).withColumn("bucket", bucket)
    scanned = store.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(scan, "q_id long, rec_id long, score float")
    best = Window.partitionBy("q_id").orderBy(F.desc("score"), "rec_id")
    candidates = stage(scanned.withColumn("n", F.row_number().over(best)).where(F.col("n") <= keep).select("q_id", "rec_id"), "candidates")

    def rerank(t: pa.Table) -> pa.Table:
        return t.select(["q_id", "rec_id"]).append_column("cosine", pa.array(exact_cosine(matrix(t["q_vec"]), matrix(t["vec"]))))

    theirs = small(queries.select(F.col("rec_id").alias("q_id"), F.col("vec").alias("q_vec")), 20_000)
    pairs = built.store.select("rec_id", "vec").join(small(candidates, 1_000_000), "rec_id").join(theirs, "q_id")
    exact = map_arrow(pairs, rerank, "q_id long, rec_id long, cosine double")
    final = Window.partitionBy("q_id").orderBy(F.desc("cosine"), "rec_id")
    first = stage(exact.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).drop("rank"), "first")

    def ask_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: AdditiveIndex = index.value
        for b in batches:
            for s in range(0, b.num_rows, 32):  # a query may ask for all cells
                t = pa.Table.from_batches([b.slice(s, 32)])
                raw, kth = matrix(t["vec"]), column(t, "kth")
                i, c = ix.open_cells(unit(raw), np.arccos(np.clip(kth, -1, 1)))
                n = ix.salts(rows)[c]
                at = np.repeat(np.arange(len(i)), n)
                part = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                i, c = i[at], c[at]
                cols = {"q_id": column(t, "rec_id")[i], "q_key": column(t, "key")[i], "kth": kth[i], "cell": c.astype(np.int32), "part": part.astype(np.int32), "vec": packed(raw[i])}
                yield from pa.table(cols).to_batches()

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_r, out_c = [], [], []
        if left.num_rows and right.num_rows:
            where, asked = [column(t, "cell").astype(np.int64) * (1 << 20) + column(t, "part") for t in (left, right)]
            lo, ro = np.argsort(where, kind="stable"), np.argsort(asked, kind="stable")
            lw, rw = where[lo], asked[ro]
            raw, rec, key = matrix(left["vec"])[lo], column(left, "rec_id")[lo], column(left, "key")[lo]
            q, qid, qkey, kth = matrix(right["vec"])[ro], column(right, "q_id")[ro], column(right, "q_key")[ro], column(right, "kth")[ro]
            x, y = unit(raw), unit(q)
            for v in np.unique(rw):
                a, b = np.searchsorted(lw, [v, v + 1])
                c, d = np.searchsorted(rw, [v, v + 1])
                for e in range(c, d if b > a else c, 256):
                    g = slice(e, min(e + 256, d))
                    near = y[g] @ x[a:b].T >= (kth[g] - 1e-5)[:, None]
                    near &= (qkey[g, None] != key[None, a:b]) & (qid[g, None] != rec[None, a:b])
                    i, j = np.nonzero(near)
                    i, j = i + e, j + a
                    cos = np.concatenate([exact_cosine(q[i[h : h + 65536]], raw[j[h : h + 65536]]) for h in range(0, len(i), 65536)] or [np.empty(0)])
                    o = np.lexsort((rec[j], -cos, i))
                    o = o[np.arange(len(o)) - np.searchsorted(i[o], i[o]) < k]  # the best k of a query
                    out_q.append(qid[i[o]])
                    out_r.append(rec[j[o]])
                    out_c.append(cos[o])
        cat = lambda p, kind: np.concatenate(p) if p else np.empty(0, kind)
        return pa.table({"q_id": cat(out_q, np.int64), "rec_id": cat(out_r, np.int64), "cosine": cat(out_c, float)})

    kth = first.groupBy(F.col("q_id").alias("rec_id")).agg(F.when(F.count("*") >= k, F.min("cosine")).alias("kth"))
    bounded = queries.select("rec_id", "key", "vec").join(small(kth), "rec_id", "left").withColumn("kth", F.coalesce("kth", F.lit(-1.0)))
    still = bounded.mapInArrow(ask_open, "q_id long, q_key long, kth double, cell int, part int, vec binary").withColumn("bucket", bucket)
    placed = built.store.select("rec_id", "key", "cell", "part", "vec", bucket)
    rest = placed.groupBy("bucket").cogroup(still.groupBy("bucket")).applyInArrow(compare, "q_id long, rec_id long, cosine double")
    both = first.unionByName(rest).groupBy("q_id", "rec_id").agg(F.max("cosine").alias("cosine"))
    return both.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)


def image_vectors(images: DataFrame) -> DataFrame:
    """(rec_id, key, vec) of the usable records, staged. key hashes the trimmed, lower-cased image_id; a record without one
    has a key of its own. Records without rec_id cannot be named and are left out; a record delivered twice is one row."""
    key = F.coalesce(F.xxhash64(F.lower(F.trim("image_id"))), F.xxhash64(F.lit("no image id"), "rec_id"))
    rows = vectors(images.where("rec_id IS NOT NULL").select("rec_id", key.alias("key"), "emb"), ["rec_id", "key"])
    return stage(rows.where("vec IS NOT NULL"), "vectors")


def every_twentieth(images: DataFrame, k: int = 5) -> DataFrame:
    """Neighbours of every record whose rec_id is divisible by 20, among all records."""
    vecs = image_vectors(images)
    return nearest(vecs, stage(vecs.where("rec_id % 20 = 0"), "queries"), k)


def probe_neighbours(images: DataFrame, probes: DataFrame, k: int = 5) -> DataFrame:
    """Neighbours of the records named by probes. Probes without a usable record have none."""
    vecs = image_vectors(images)
    asked = small(probes.select("rec_id").where("rec_id IS NOT NULL").distinct())
    return nearest(vecs, stage(vecs.join(asked, "rec_id", "left_semi"), "queries"), k)
