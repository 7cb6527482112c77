"""Similarity clusters: cluster-feature trees per part, tree-reduced leaves, Ward agglomeration, full assignment, exact check."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.cells import buckets, column, map_arrow, marked, matrix, packed, pairs_at_least, unit, vectors
from lumenfold.session import partitions, small, stage

TAU = 0.73
ALPHA = float(np.arccos(TAU))
#: Root-mean-square distance of a leaf's rows from their mean, at most; grows where a tree would hold over MAX_LEAVES leaves.
LEAF_RADIUS = 0.35
#: Entries of a tree node, and leaves of a tree.
BRANCH, MAX_LEAVES = 48, 32_768
#: A row farther from every centre is a stray. No member of a group with mean cosine TAU lies farther from the group's centre.
STRAY = float(np.arccos(np.sqrt(TAU))) + 1e-3
#: Strays that one task compares with as many others.
STRAY_ROWS = 65_536
#: Rows of one part, which one tree is built on; a data set of more rows has several parts.
PART_ROWS = 8_192
#: Rows that one task of the exact check holds for a data set of several parts.
CHECK_ROWS = 16_384
#: Trees whose leaves are merged by one task of the reduction.
FAN_IN = 8
#: Slack on angles for float32 arithmetic.
SLACK = 2e-3


class Features:
    """Cluster features of some vectors: n, linear sums, squared sums."""

    def __init__(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray):
        self.n, self.ls, self.ss = n, ls, ss

    @staticmethod
    def of_rows(x: np.ndarray, weight: np.ndarray) -> Features:
        x = x.astype(np.float64)
        return Features(weight.astype(float), x * weight[:, None], (x * x).sum(1) * weight)

    @staticmethod
    def join(parts: list[Features]) -> Features:
        return Features(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("n", "ls", "ss")))

    def __len__(self) -> int:
        return len(self.n)

    def take(self, at) -> Features:
        return Features(self.n[at], self.ls[at], self.ss[at])

    def total(self) -> Features:
        return Features(self.n.sum(keepdims=True), self.ls.sum(0, keepdims=True), self.ss.sum(keepdims=True))

    def mean(self) -> np.ndarray:
        return self.ls / self.n[:, None]


class _Node:
    def __init__(self, entries: Features, children: list[_Node] | None = None):
        self.entries, self.children = entries, children


class CFTree:
    """A cluster-feature tree. Features go down to the nearest entry, many at once: at each node one matrix product deals them
    to the entries. In a leaf, an entry absorbs the features that leave its radius within bounds and whose mean cosine to it
    stays over the bound; the others open entries. Nodes of more than BRANCH entries split at their two farthest entries. A
    tree of more than MAX_LEAVES leaves is built again from its leaves with a wider radius, or, with shed, from the heaviest
    half of them: rows of the others then have no centre near them and are strays."""

    def __init__(self, radius: float = LEAF_RADIUS, max_leaves: int = MAX_LEAVES, shed: bool = False):
        self.radius, self.max_leaves, self.shed = radius, max_leaves, shed
        self.root: _Node | None = None

    def insert(self, f: Features, block: int = 1024) -> None:
        for s in range(0, len(f), block):
            part = f.take(slice(s, s + block))
            nodes = self._leaf(None, part) if self.root is None else self._down(self.root, part)
            while len(nodes) > 1:
                nodes = self._split(_Node(Features.join([n.entries.total() for n in nodes]), nodes))
            self.root = nodes[0]
            while self.size() > self.max_leaves:
                leaves = self.leaves()
                order = np.argsort(-leaves.n, kind="stable")
                if self.shed:
                    order = order[: max(1, self.max_leaves // 2)]
                self.radius, self.root = self.radius * (1 if self.shed else 1.25), None
                self.insert(leaves.take(order), block)

    def size(self) -> int:
        todo, n = [self.root], 0
        while todo:
            x = todo.pop()
            n += len(x.entries) if x.children is None else 0
            todo += x.children or []
        return n

    def leaves(self) -> Features:
        todo, found = [self.root], []
        while todo:
            x = todo.pop()
            if x.children is None:
                found.append(x.entries)
            todo += x.children or []
        return Features.join(found)

    def _down(self, node: _Node, f: Features) -> list[_Node]:
        """Inserts f below node; returns the nodes that take its place."""
        if node.children is None:
            return self._leaf(node.entries, f)
        to = _nearest(f, node.entries)
        children = []
        for k, child in enumerate(node.children):
            mine = np.flatnonzero(to == k)
            children += self._down(child, f.take(mine)) if len(mine) else [child]
        return self._split(_Node(Features.join([c.entries.total() for c in children]), children))

    def _leaf(self, entries: Features | None, f: Features) -> list[_Node]:
        e = entries
        while len(f):
            done, fresh = np.zeros(len(f), bool), np.arange(len(f))
            if e is not None:
                to = _nearest(f, e)
                fits = self._fits(e.take(to), f)
                fresh = np.flatnonzero(~fits)
                if len(fresh) < len(f):
                    e, o = self._absorb(e, f, to, np.flatnonzero(fits))
                    done[o] = True
            if len(fresh):
                opened = fresh[self._leaders(f.take(fresh))]
                e = f.take(opened) if e is None else Features.join([e, f.take(opened)])
                done[opened] = True
            f = f.take(np.flatnonzero(~done))  # those that an entry had no room for look again
        return self._split(_Node(e))

    def _absorb(self, e: Features, f: Features, to: np.ndarray, ok: np.ndarray) -> tuple[Features, np.ndarray]:
        """(entries after, features absorbed): of the features that fit one entry each, nearest first, as many as its radius
        allows together."""
        gap = ((f.ls[ok] / f.n[ok, None] - e.ls[to[ok]] / e.n[to[ok], None]) ** 2).sum(1)
        o = ok[np.lexsort((gap, to[ok]))]
        first = np.searchsorted(to[o], to[o])
        run = lambda a: (c := np.cumsum(a, axis=0)) - c[first] + a[first]
        base = e.take(to[o])
        n, ls, ss = base.n + run(f.n[o]), base.ls + run(f.ls[o]), base.ss + run(f.ss[o])
        outside = ss / n - (ls * ls).sum(1) / n**2 > self.radius**2
        if outside.any():
            o = o[(run(outside.astype(np.int64)) == 0) | (np.arange(len(o)) == first)]
        n, ls, ss = e.n.copy(), e.ls.copy(), e.ss.copy()
        np.add.at(n, to[o], f.n[o])
        np.add.at(ls, to[o], f.ls[o])
        np.add.at(ss, to[o], f.ss[o])
        return Features(n, ls, ss), o

    def _leaders(self, f: Features) -> np.ndarray:
        """Features none of which would absorb another; in order, each that no earlier one absorbs."""
        out, open_ = [], np.ones(len(f), bool)
        for s in range(0, len(f), 512):
            part = f.take(slice(s, s + 512))
            n = part.n[:, None] + part.n[None, :]
            dot = part.ls @ part.ls.T
            sq = np.diagonal(dot)
            r2 = (part.ss[:, None] + part.ss[None, :]) / n - (sq[:, None] + sq[None, :] + 2 * dot) / n**2
            near = (r2 <= self.radius**2) & (dot >= self._cosine() * part.n[:, None] * part.n[None, :])
            free = open_[s : s + 512].copy()
            for i in range(len(part)):
                if free[i]:
                    out.append(s + i)
                    free &= ~near[i]
            if len(f) > 512:  # later blocks meet these entries when they look again
                break
        return np.array(out, np.int64)

    def _cosine(self) -> float:
        return max(-1.0, 1.0 - (1.0 - TAU) * (self.radius / LEAF_RADIUS) ** 2)

    def _fits(self, e: Features, f: Features) -> np.ndarray:
        n, ls = e.n + f.n, e.ls + f.ls
        r2 = (e.ss + f.ss) / n - (ls * ls).sum(1) / n**2
        return (r2 <= self.radius**2) & ((e.ls * f.ls).sum(1) >= self._cosine() * e.n * f.n)

    def _split(self, node: _Node) -> list[_Node]:
        """The node, or the nodes that it splits into."""
        done, todo = [], [node]
        while todo:
            x = todo.pop()
            if len(x.entries) <= BRANCH:
                done.append(x)
                continue
            m = x.entries.mean()
            far = int(((m - m.mean(0)) ** 2).sum(1).argmax())
            d = ((m - m[far]) ** 2).sum(1)
            other = int(d.argmax())
            near = d <= ((m - m[other]) ** 2).sum(1)
            near[far], near[other] = True, False
            for mask in (near, ~near):
                at = np.flatnonzero(mask)
                todo.append(_Node(x.entries.take(at), None if x.children is None else [x.children[i] for i in at]))
        return done


def _nearest(f: Features, e: Features) -> np.ndarray:
    m = e.mean()
    return ((m * m).sum(1)[None, :] - 2 * (f.mean() @ m.T)).argmin(1)


def leaf_summaries(x: np.ndarray, weight: np.ndarray) -> Features:
    """Leaves of one tree over the rows."""
    tree = CFTree()
    tree.insert(Features.of_rows(x, weight))
    return tree.leaves()


def ward(n: np.ndarray, ls: np.ndarray, tau: float = TAU) -> np.ndarray:
    """Cluster number of each leaf: Ward's merges in order of least increase, among the pairs of clusters whose vectors have a
    mean cosine of at least tau across (unit vectors: LS_i . LS_j / (n_i n_j)). A stray vector never joins a large cluster."""
    k = len(n)
    label = np.arange(k)
    if k < 2:
        return label
    n, ls = n.astype(float).copy(), ls.astype(float).copy()
    alive, version = np.ones(k, bool), np.zeros(k, np.int64)
    sq = (ls * ls).sum(1)
    heap: list[tuple] = []

    def cost(i, j, prod):
        d2 = sq[i] / n[i] ** 2 + sq[j] / n[j] ** 2 - 2 * prod / (n[i] * n[j])
        return n[i] * n[j] / (n[i] + n[j]) * d2

    for s in range(0, k, 1024):
        prod = ls[s : s + 1024] @ ls.T
        i, j = marked(prod >= tau * n[s : s + 1024, None] * n[None, :])
        i, j, prod = i[s + i < j] + s, j[s + i < j], prod[i[s + i < j], j[s + i < j]]
        heap += zip(cost(i, j, prod).tolist(), i.tolist(), j.tolist(), [0] * len(i), [0] * len(i))
    heapq.heapify(heap)
    into = np.arange(k)
    while heap:
        _, i, j, vi, vj = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or version[i] != vi or version[j] != vj:
            continue
        alive[j] = False
        into[j] = i
        n[i] += n[j]
        ls[i] += ls[j]
        sq[i] = ls[i] @ ls[i]
        version[i] += 1
        prod = ls @ ls[i]
        near = alive & (prod >= tau * n[i] * n)
        near[i] = False
        js = np.flatnonzero(near)
        prod = prod[js]
        for c, e in zip(cost(i, js, prod).tolist(), js.tolist()):
            a, b = min(i, e), max(i, e)
            heapq.heappush(heap, (c, a, b, int(version[a]), int(version[b])))
    while (into != into[into]).any():
        into = into[into]
    return into


def centres(leaves: Features) -> np.ndarray:
    """Unit centres of the clusters that Ward makes of the leaves."""
    _, label = np.unique(ward(leaves.n, leaves.ls), return_inverse=True)
    sums = np.zeros((label.max() + 1, leaves.ls.shape[1]))
    np.add.at(sums, label, leaves.ls)
    return (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def assign(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The full assignment pass: (nearest centre, angle to it, never too small) of unit rows."""
    who, cos = np.empty(len(x), np.int64), np.empty(len(x), np.float32)
    for s in range(0, len(x), 2048):
        d = x[s : s + 2048] @ c.T
        who[s : s + 2048] = d.argmax(1)
        cos[s : s + 2048] = d[np.arange(len(d)), who[s : s + 2048]]
    return who, (np.arccos(np.clip(cos, -1, 1)) + 1e-3).astype(np.float32)


#: Kinds of rows of a check: at home, the rim of a cluster whose home rows lie in several tasks, visitors of other clusters.
HOME, RIM, VISITOR = 0, 1, 2


def check(x: np.ndarray, raw: np.ndarray, weight: np.ndarray, cluster: np.ndarray, angle: np.ndarray, kind: np.ndarray, names: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of neighbours met here, number of the local component) of each row, exactly; inner pairs are not counted.

    names, c: numbers (ascending) and centres of the clusters whose home rows are here. Home rows within ALPHA / 2 of their
    centre are inner: any two of one cluster are neighbours, whatever the task, and need no comparison. The others of the
    cluster, its rim, are compared with its home rows. A row meets the clusters numbered above its own unless its angle to
    their centre exceeds ALPHA and their radius, so that each pair of rows is counted once.
    """
    n = len(x)
    degree = np.zeros(n)
    at = np.searchsorted(names, cluster)
    here = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == cluster)
    home = np.flatnonzero(kind == HOME)
    home = home[np.argsort(at[home], kind="stable")]
    starts = np.searchsorted(at[home], np.arange(len(names) + 1))
    inner = (kind == HOME) & (angle <= ALPHA / 2)
    reach = np.full(len(names), -np.pi, np.float32)
    np.maximum.at(reach, at[home], angle[home])
    limit = np.cos(np.clip(ALPHA + reach + SLACK, 0, np.pi)).astype(np.float32)
    ask_q, ask_c = [], []
    movers = np.flatnonzero(kind != RIM)
    for s in range(0, len(movers), 2048):
        m = movers[s : s + 2048]
        i, k = marked(x[m] @ c.T >= limit)
        ok = names[k] > cluster[m[i]]
        ask_q.append(m[i[ok]])
        ask_c.append(k[ok])
    rim = np.flatnonzero(here & ~inner & (kind != VISITOR) & (cluster >= 0))  # strays meet strays elsewhere
    ask_q.append(rim)
    ask_c.append(at[rim])
    q, k = np.concatenate(ask_q), np.concatenate(ask_c)
    o = np.argsort(k, kind="stable")
    q, k = q[o], k[o]
    left, right = [], []
    for g in np.split(np.arange(len(k)), np.flatnonzero(np.diff(k)) + 1) if len(k) else ():
        t = home[starts[k[g[0]]] : starts[k[g[0]] + 1]]
        if len(t):
            a = q[g]
            i, j = pairs_at_least(x[a], x[t], TAU, raw[a], raw[t])
            i, j = a[i], t[j]
            m = i != j
            left.append(i[m])
            right.append(j[m])
    none = np.empty(0, np.int64)
    i, j = (np.concatenate(left), np.concatenate(right)) if left else (none, none)
    np.add.at(degree, i, weight[j])
    # a rim row asks for itself, in every task of its cluster; all others that are asked are told
    told = inner[j] | (cluster[i] != cluster[j])
    np.add.at(degree, j[told], weight[i[told]])
    ends = np.flatnonzero(inner)
    first = np.full(len(names), n)
    np.minimum.at(first, at[ends], ends)
    return degree, components(n, np.concatenate([i, ends]), np.concatenate([j, first[at[ends]]]))


def components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least row number of each row's component under the links (i, j)."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, before, label.copy())
        label = label[label]
        if (label == before).all():
            break
    return label


def set_groups(x: np.ndarray, raw: np.ndarray, rec: np.ndarray, least: int = 3, labels=None) -> list[tuple[np.ndarray, bool]]:
    """Groups of one whole data set, as (row numbers, whether one cluster as it stands): trees, Ward, assignment and check.

    Copies count as one row with a weight. A group is a component of which every row has size - 1 neighbours. labels replaces
    the clusters in tests: given the distinct rows, (cluster, angle, centres).
    """
    bytes_, width, seen = raw.tobytes(), raw.shape[1] * 4, {}
    inverse = np.array([seen.setdefault(bytes_[k : k + width], len(seen)) for k in range(0, len(bytes_), width)], np.int64)
    first = np.unique(inverse, return_index=True)[1]
    u, r = x[first], raw[first]
    weight = np.bincount(inverse, minlength=len(first)).astype(float)
    if labels is None:
        c = centres(leaf_summaries(u, weight))
        who, angle = assign(u, c)
    else:
        who, angle, c = labels(u)
    degree, comp = check(u, r, weight, who, angle, np.zeros(len(u), np.int64), np.arange(len(c)), c)
    inner = angle <= ALPHA / 2
    held = np.bincount(who, weights=weight * inner, minlength=len(c))
    degree += weight - 1 + np.where(inner, held[who] - weight, 0)
    size = np.bincount(comp, weights=weight, minlength=len(u))
    wrong = np.bincount(comp, weights=degree != size[comp] - 1, minlength=len(u))
    rows = np.bincount(who, minlength=len(c))
    good = (size >= least) & (wrong == 0)
    out = []
    mine = np.flatnonzero(good[comp[inverse]])
    mine = mine[np.argsort(comp[inverse][mine], kind="stable")]
    for g in np.split(mine, np.flatnonzero(np.diff(comp[inverse][mine])) + 1) if len(mine) else ():
        own = np.unique(inverse[g])
        out.append((g, bool((who[own] == who[own[0]]).all() and rows[who[own[0]]] == len(own))))
    return out


_GROUPS = "ds long, head_rec_id long, rec_id long, size long"


def _sets(rows: DataFrame, total: int, least: int) -> DataFrame:
    """Members of the groups of data sets of one part each."""

    def f(t: pa.Table) -> pa.Table:
        ds, rec = column(t, "ds"), column(t, "rec_id")
        raw = matrix(t["vec"])
        x = unit(raw)
        out: list[tuple] = []
        order = np.lexsort((rec, ds))
        for g in np.split(order, np.flatnonzero(np.diff(ds[order])) + 1):
            if len(g) >= least:
                for m, _ in set_groups(x[g], raw[g], rec[g], least):
                    ids = rec[g[m]]
                    out.append((np.full(len(ids), ds[g[0]]), np.full(len(ids), ids.min()), ids, np.full(len(ids), len(ids))))
        cols = [np.concatenate(c).astype(np.int64) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 4
        return pa.table(dict(zip(("ds", "head_rec_id", "rec_id", "size"), cols)))

    bucket = F.pmod(F.xxhash64("ds"), F.lit(buckets(rows.sparkSession, total)))
    return rows.select("ds", "rec_id", "vec", bucket.alias("bucket")).groupBy("bucket").applyInArrow(f, _GROUPS)


_LEAVES = "ds long, part int, n double, ls binary, ss double"


def _leaf_table(ds: int, part: int, f: Features) -> pa.Table:
    return pa.table(
        {"ds": np.full(len(f), ds, np.int64), "part": np.full(len(f), part, np.int32), "n": f.n, "ls": pa.array([v.tobytes() for v in f.ls], pa.binary()), "ss": f.ss}
    )


def _merged(t: pa.Table) -> CFTree:
    """One tree of the leaves of several."""
    a = t["ls"].combine_chunks()
    start, end = np.frombuffer(a.buffers()[1], np.int32)[[a.offset, a.offset + len(a)]]
    ls = np.frombuffer(a.buffers()[2], np.float64, (end - start) // 8, start).reshape(t.num_rows, -1)
    f = Features(column(t, "n"), ls, column(t, "ss"))
    tree = CFTree(shed=True)
    tree.insert(f.take(np.argsort(-f.n, kind="stable")))
    return tree


def set_centres(reps: DataFrame, sizes: DataFrame, parts: int) -> DataFrame:
    """(ds, cluster, centre) of data sets of several parts: a tree a part, leaves reduced FAN_IN trees at a time until one tree
    a data set is left, and Ward on its leaves. At most MAX_LEAVES clusters a data set; cluster -1, without centre, takes its strays."""

    def build(key: tuple, t: pa.Table) -> pa.Table:
        x = unit(matrix(t["vec"]))
        return _leaf_table(key[0].as_py(), key[1].as_py(), leaf_summaries(x, column(t, "w").astype(float)))

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        return _leaf_table(key[0].as_py(), key[1].as_py(), _merged(t).leaves())

    def agglomerate(key: tuple, t: pa.Table) -> pa.Table:
        c = centres(_merged(t).leaves())
        c = np.concatenate([np.zeros((1, c.shape[1]), c.dtype), c])
        return pa.table({"ds": np.full(len(c), key[0].as_py(), np.int64), "cluster": np.arange(-1, len(c) - 1, dtype=np.int32), "centre": packed(c)})

    leaves = reps.groupBy("ds", "part").applyInArrow(build, _LEAVES)
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        leaves = leaves.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("ds", "part").applyInArrow(merge, _LEAVES)
    found = leaves.groupBy("ds").applyInArrow(agglomerate, "ds long, cluster int, centre binary")
    return stage(found, "centres")


def _to_parts(model: DataFrame, sizes: DataFrame) -> DataFrame:
    """A data set's clusters, for each of its parts."""
    return model.join(small(sizes), "ds").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))


def _assigned(reps: DataFrame, model: DataFrame, sizes: DataFrame) -> DataFrame:
    """The full assignment pass: each row with its nearest centre."""

    def f(t: pa.Table, m: pa.Table) -> pa.Table:
        t, m = t.select(["ds", "part", "rec_id", "w", "vec"]), m.filter(pa.array(column(m, "cluster") >= 0)) if m.num_rows else m
        cluster, angle = assign(unit(matrix(t["vec"])), matrix(m["centre"])) if t.num_rows and m.num_rows else (np.empty(0), np.empty(0))
        number = column(m, "cluster")[cluster.astype(np.int64)] if len(cluster) else np.empty(0, np.int32)
        number, angle = np.where(angle > STRAY, -1, number).astype(np.int32), np.where(angle > STRAY, np.pi, angle).astype(np.float32)
        return t.slice(0, len(cluster)).append_column("cluster", pa.array(number, pa.int32())).append_column("angle", pa.array(angle, pa.float32()))

    schema = "ds long, part int, rec_id long, w long, vec binary, cluster int, angle float"
    return stage(reps.groupBy("ds", "part").cogroup(_to_parts(model, sizes).groupBy("ds", "part")).applyInArrow(f, schema), "assigned")


def _packed_clusters(rows: DataFrame, model: DataFrame, check_rows: int) -> DataFrame:
    """(ds, cluster, centre, radius, inner, first, tasks): clusters with their radius, the weight of their inner rows, and the
    tasks that hold their home rows: small clusters share one, large ones have several."""
    stats = rows.groupBy("ds", "cluster").agg(F.max("angle").alias("radius"), F.count("*").alias("n"), F.sum(F.when(F.col("angle") <= ALPHA / 2, F.col("w")).otherwise(0)).alias("inner"))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("cluster")
        n = column(t, "n")
        tasks = -(-n // check_rows)
        first, free, room = np.zeros(len(n), np.int32), 0, 0
        for i, (k, many) in enumerate(zip(n.tolist(), tasks.tolist())):
            if many > 1:
                first[i], free, room = free, free + many, 0
            else:
                if room < k:
                    free, room = free + 1, check_rows
                first[i], room = free - 1, room - k
        return t.drop_columns(["n"]).append_column("first", pa.array(first)).append_column("tasks", pa.array(tasks, pa.int32()))

    joined = model.join(stats, ["ds", "cluster"]).select("ds", "cluster", "centre", "radius", "inner", "n")
    return stage(joined.groupBy("ds").applyInArrow(pack, "ds long, cluster int, centre binary, radius float, inner long, first int, tasks int"), "packed")


_MET = "ds long, task int, kind int, rec_id long, w long, cluster int, angle float, plus long, vec binary"
_FOUND = "ds long, rec_id long, comp string, degree double, w long"


def _met(rows: DataFrame, model: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each row once in every task that it takes part in, and each cluster's centre (rec_id null) in the tasks of its rows."""

    def f(t: pa.Table, m: pa.Table) -> pa.Table:
        if not t.num_rows or not m.num_rows:
            return pa.table({k: pa.array([], v) for k, v in _MET_TYPES.items()})
        m = m.sort_by("cluster")
        names, c, radius = column(m, "cluster"), matrix(m["centre"]), column(m, "radius")
        first, tasks, held = column(m, "first"), column(m, "tasks"), column(m, "inner")
        raw, rec, w, angle = matrix(t["vec"]), column(t, "rec_id"), column(t, "w"), column(t, "angle")
        x = unit(raw)
        at = np.searchsorted(names, column(t, "cluster"))
        inner = angle <= ALPHA / 2
        h = rec.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        own = first[at] + (h >> np.uint64(33)).astype(np.int64) % tasks[at]
        row, task, kind = [np.arange(len(rec))], [own], [np.zeros(len(rec), np.int64)]
        # the rim of a cluster in several tasks asks in all of them
        many = np.flatnonzero(~inner & (tasks[at] > 1) & (names[at] >= 0))
        rep = np.repeat(many, tasks[at[many]])
        to = np.repeat(first[at[many]], tasks[at[many]]) + np.arange(len(rep)) - np.repeat(np.cumsum(tasks[at[many]]) - tasks[at[many]], tasks[at[many]])
        other = to != own[rep]
        row.append(rep[other])
        task.append(to[other])
        kind.append(np.full(int(other.sum()), RIM))
        limit = np.cos(np.clip(ALPHA + radius + SLACK, 0, np.pi)).astype(np.float32)
        for s in range(0, len(x), 2048):
            i, k = marked(x[s : s + 2048] @ c.T >= limit)
            i = i + s
            i, k = i[k > at[i]], k[k > at[i]]
            rep = np.repeat(np.arange(len(i)), tasks[k])
            to = first[k[rep]] + np.arange(len(rep)) - np.repeat(np.cumsum(tasks[k]) - tasks[k], tasks[k])
            # home rows meet the other clusters of their task anyway
            pair = np.unique(np.stack([i[rep], to], axis=1)[to != own[i[rep]]], axis=0)
            row.append(pair[:, 0])
            task.append(pair[:, 1])
            kind.append(np.full(len(pair), VISITOR))
        row, task, kind = (np.concatenate(a).astype(np.int64) for a in (row, task, kind))
        plus = np.where((kind == HOME) & inner[row], held[at[row]] - w[row], 0)
        ds = t["ds"][0].as_py()
        cols = [np.full(len(row), ds), task.astype(np.int32), kind.astype(np.int32), rec[row], w[row], names[at[row]], angle[row], plus]
        return pa.table([*map(pa.array, cols), packed(raw[row])], names=list(_MET_TYPES)).cast(_MET_SCHEMA)

    met = rows.groupBy("ds", "part").cogroup(_to_parts(model, sizes).groupBy("ds", "part")).applyInArrow(f, _MET)
    task = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("tasks") - 1)).alias("task")
    none = {"kind": "0", "rec_id": "CAST(NULL AS long)", "w": "0L", "angle": "CAST(0 AS float)", "plus": "0L"}
    there = model.select("ds", task, "cluster", F.col("centre").alias("vec")).withColumns({c: F.expr(e) for c, e in none.items()})
    return met.unionByName(there)


_MET_TYPES = {"ds": pa.int64(), "task": pa.int32(), "kind": pa.int32(), "rec_id": pa.int64(), "w": pa.int64(), "cluster": pa.int32(), "angle": pa.float32(), "plus": pa.int64(), "vec": pa.binary()}
_MET_SCHEMA = pa.schema(list(_MET_TYPES.items()))


def _checked(key: tuple, t: pa.Table) -> pa.Table:
    """The exact check of one task's clusters: rows with neighbours, their number and local component."""
    empty = pa.table({"ds": pa.array([], pa.int64()), "rec_id": pa.array([], pa.int64()), "comp": pa.array([], pa.string()), "degree": pa.array([], pa.float64()), "w": pa.array([], pa.int64())})
    mark = t["rec_id"].is_null().to_numpy()
    m = t.filter(pa.array(mark)).sort_by("cluster")
    t = t.filter(pa.array(~mark)).sort_by("rec_id")
    if not t.num_rows or not m.num_rows:
        return empty
    raw, rec, w, cluster, kind = matrix(t["vec"]), column(t, "rec_id"), column(t, "w"), column(t, "cluster"), column(t, "kind")
    angle, plus = column(t, "angle"), column(t, "plus")
    degree, comp = check(unit(raw), raw, w.astype(float), cluster, angle, kind, column(m, "cluster"), matrix(m["vec"]))
    # a row counts its own copies and, if inner, the other inner rows of its cluster, once: at home
    degree = degree + plus + np.where(kind == HOME, w - 1, 0)
    inner = (kind == HOME) & (angle <= ALPHA / 2)
    hit = np.flatnonzero(degree > 0)
    if not len(hit):
        return empty
    # inner rows of a cluster are one component whatever the task
    name = np.full(len(rec), -1, np.int64)
    np.maximum.at(name, comp[inner], cluster[inner])
    ds, task = key[0].as_py(), key[1].as_py()
    names = [f"c{name[k]}" if name[k] >= 0 else f"{task}/{k}" for k in comp[hit].tolist()]
    also = np.flatnonzero(inner & (name[comp] != cluster))  # another cluster's inner rows in the same component
    names += [f"c{k}" for k in cluster[also].tolist()]
    at = np.concatenate([hit, also])
    return pa.table({"ds": np.full(len(at), ds), "rec_id": rec[at], "comp": pa.array(names, pa.string()), "degree": np.concatenate([degree[hit], np.zeros(len(also))]), "w": w[at]})


def _strays(assigned: DataFrame) -> DataFrame:
    """The strays of a data set with one another: dealt into blocks, each pair of blocks is one task's. Rows with neighbours."""
    strays = assigned.where("cluster = -1").select("ds", "rec_id", "w", "vec")
    blocks = strays.groupBy("ds").agg(F.ceil(F.count("*") / STRAY_ROWS).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("rec_id", F.lit("stray")), "blocks").cast("int").alias("block")
    dealt = strays.join(small(blocks), "ds").select("ds", "rec_id", "w", "vec", "blocks", block)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = dealt.select("ds", "rec_id", "w", "vec", "block", other).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})

    def meet(key: tuple, t: pa.Table) -> pa.Table:
        lo, hi = key[1].as_py(), key[2].as_py()
        t = t.sort_by("rec_id")
        raw, w, rec, first = matrix(t["vec"]), column(t, "w").astype(float), column(t, "rec_id"), column(t, "block") == lo
        x = unit(raw)
        a, b = np.flatnonzero(first), np.flatnonzero(~first if lo != hi else first)
        i, j = pairs_at_least(x[a], x[b], TAU, raw[a], raw[b])
        i, j = a[i], b[j]
        i, j = (i[i != j], j[i != j]) if lo == hi else (np.concatenate([i, j]), np.concatenate([j, i]))
        degree = np.zeros(len(rec))
        np.add.at(degree, i, w[j])
        comp, hit = components(len(rec), i, j), np.flatnonzero(degree)
        names = pa.array([f"s{lo}/{hi}/{k}" for k in comp[hit].tolist()], pa.string())
        return pa.table({"ds": np.full(len(hit), key[0].as_py(), np.int64), "rec_id": rec[hit], "comp": names, "degree": degree[hit], "w": column(t, "w")[hit]})

    return pairs.select("ds", "rec_id", "w", "vec", "block", "lo", "hi").groupBy("ds", "lo", "hi").applyInArrow(meet, _FOUND)


def _divided(rows: DataFrame, sizes: DataFrame, parts: int, least: int, check_rows: int) -> DataFrame:
    """Members of the groups of data sets of several parts. rows: (ds, rec_id, vec).

    Copies are first one row with a weight, so that no task holds them all. Clusters come from trees a part, the tree reduction,
    Ward and the assignment; each is then checked exactly. A component that stays in one cluster is that cluster's; components
    that meet in a record (groups cut by the assignment) are joined. A group stands if each member has size - 1 neighbours.
    """
    copies = rows.groupBy("ds", "vec").agg(F.min("rec_id").alias("rec_id"), F.count("*").alias("w")).join(small(sizes), "ds")
    reps = stage(copies.select("ds", F.pmod(F.xxhash64("vec"), "parts").cast("int").alias("part"), "rec_id", "w", "vec"), "distinct-vectors")
    model = set_centres(reps, sizes, parts)
    assigned = _assigned(reps, model, sizes)
    model = _packed_clusters(assigned, model, check_rows)
    found = stage(_met(assigned, model, sizes).groupBy("ds", "task").applyInArrow(_checked, _FOUND).unionByName(_strays(assigned)), "checked")
    label = _components(found)
    mine = found.groupBy("ds", "rec_id").agg(F.sum("degree").alias("degree"), F.max("w").alias("w"))
    labelled = mine.join(label, ["ds", "rec_id"])
    stats = labelled.groupBy("ds", "label").agg(F.sum("w").alias("size"), F.min("degree").alias("lo"), F.max("degree").alias("hi"), F.min("rec_id").alias("head_rec_id"))
    good = stats.where((F.col("size") >= least) & (F.col("lo") == F.col("size") - 1) & (F.col("hi") == F.col("size") - 1))
    grouped = labelled.join(good.select("ds", "label", "size", "head_rec_id"), ["ds", "label"]).select("ds", "rec_id", "head_rec_id", "size")
    same = ["ds", "h1", "h2"]
    hashes = [F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit("vec"), "vec").alias("h2")]
    keyed = reps.select("ds", "rec_id", *hashes).join(grouped, ["ds", "rec_id"]).drop("rec_id")
    return rows.select("ds", "rec_id", *hashes).join(keyed, same).select("ds", "head_rec_id", "rec_id", "size")


def members(images: DataFrame, least: int = 3, part_rows: int = PART_ROWS, check_rows: int = CHECK_ROWS) -> DataFrame:
    """(ds, head_rec_id, rec_id, size): members of every group of at least `least` records of one data set of which any two have
    cosine >= TAU while every other record of the data set stays below TAU to all of them.

    A null data set is one of its own; records without rec_id or usable embedding belong to no group; a record delivered twice
    under one rec_id is one. Every data set is clustered the same way: cluster-feature trees, Ward on the leaves, assignment to
    the nearest centre, exact check of the clusters with bounds from their centres. A data set of one part has one tree, built,
    clustered and checked by one task; those of several parts go through the tree reduction (see _divided).
    """
    spark = images.sparkSession
    of = F.coalesce(F.xxhash64("dataset"), F.lit(0).cast("long")).alias("ds")
    rows = stage(vectors(images.where("rec_id IS NOT NULL").select(of, "rec_id", "emb"), ["ds", "rec_id"]).where("vec IS NOT NULL"), "vectors")
    twice = rows.groupBy("rec_id").agg(F.count("*").alias("k")).where("k > 1")
    if not twice.isEmpty():
        rows = stage(rows.dropDuplicates(["ds", "rec_id"]), "vectors")
    counts = stage(rows.groupBy("ds").agg(F.count("*").alias("n")).where(F.col("n") >= least), "set-sizes")
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    sizes = counts.where(F.col("n") > part_rows).select("ds", F.ceil(F.col("n") / part_rows).cast("int").alias("parts"))
    one = rows.join(small(counts.where(F.col("n") <= part_rows).select("ds")), "ds", "left_semi")
    out = _sets(one, total or 0, least)
    if (most or 0) > part_rows:
        divided = rows.join(small(sizes.select("ds")), "ds", "left_semi")
        out = out.unionByName(_divided(divided, sizes, -(-most // part_rows), least, check_rows))
    return out


def groups(images: DataFrame, least: int = 3, part_rows: int = PART_ROWS, check_rows: int = CHECK_ROWS) -> DataFrame:
    """`members` with cos, each one's cosine to its group's centre, the sum of the unit vectors of all members."""
    of = F.coalesce(F.xxhash64("dataset"), F.lit(0).cast("long")).alias("ds")
    vecs = vectors(images.where("rec_id IS NOT NULL").select(of, "rec_id", "emb"), ["ds", "rec_id"]).where("vec IS NOT NULL")
    rows = stage(vecs.join(members(images, least, part_rows, check_rows), ["ds", "rec_id"]).dropDuplicates(["ds", "rec_id"]), "group-vectors")

    def unit_rows(t: pa.Table) -> np.ndarray:
        raw = matrix(t["vec"]).astype(np.float64)
        raw /= np.abs(raw).max(axis=1, keepdims=True)
        return raw / np.linalg.norm(raw, axis=1, keepdims=True)

    def add(ds: np.ndarray, head: np.ndarray, x: np.ndarray) -> pa.Table:
        keys, at = np.unique(np.stack([ds, head], axis=1), axis=0, return_inverse=True)
        total = np.zeros((len(keys), x.shape[1]))
        np.add.at(total, at.ravel(), x)
        return pa.table({"ds": keys[:, 0], "head_rec_id": keys[:, 1], "total": pa.array([r.tobytes() for r in total], pa.binary())})

    def doubles(t: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(t["total"].to_pylist()), np.float64).reshape(t.num_rows, -1)

    def cosines(t: pa.Table) -> pa.Table:
        centre = doubles(t)
        cos = (unit_rows(t) * centre).sum(1) / np.linalg.norm(centre, axis=1)
        return t.select(["head_rec_id", "rec_id", "size"]).append_column("cos", pa.array(np.round(cos, 12)))  # scaled copies tie

    sums = "ds long, head_rec_id long, total binary"
    some = map_arrow(rows.select("ds", "head_rec_id", "vec"), lambda t: add(column(t, "ds"), column(t, "head_rec_id"), unit_rows(t)), sums)
    bucket = F.pmod(F.xxhash64("ds", "head_rec_id"), F.lit(8 * partitions(images.sparkSession)))
    centres = some.groupBy(bucket.alias("bucket")).applyInArrow(lambda t: add(column(t, "ds"), column(t, "head_rec_id"), doubles(t)), sums)
    return map_arrow(rows.join(centres, ["ds", "head_rec_id"]), cosines, "head_rec_id long, rec_id long, size long, cos double")


def _components(found: DataFrame) -> DataFrame:
    """(ds, rec_id, label): components of records that share a local component, by exchanging least labels; only local
    components with a record that stands in several of them take part in the exchange."""
    where = ["ds", "comp"]
    several = found.groupBy("ds", "rec_id").agg(F.count("*").alias("k")).where("k > 1").select("ds", "rec_id")
    several = stage(several, "several")
    if several.isEmpty():
        return found.select("ds", "rec_id", F.col("comp").alias("label"))
    shared = stage(found.join(small(several), ["ds", "rec_id"], "left_semi").select("ds", "rec_id", "comp"), "shared")
    labels = shared.select(*where).distinct().withColumn("label", F.col("comp"))
    while True:
        by_rec = shared.join(labels, where).groupBy("ds", "rec_id").agg(F.min("label").alias("label"))
        new = shared.join(by_rec, ["ds", "rec_id"]).groupBy(*where).agg(F.min("label").alias("label"))
        new = stage(new, "labels")
        changed = new.join(labels.withColumnRenamed("label", "was"), where).where("label <> was")
        labels = new
        if changed.isEmpty():
            break
    return found.join(labels, where, "left").select("ds", "rec_id", F.coalesce("label", "comp").alias("label")).distinct()


def describe(members: DataFrame, typical: int = 3) -> DataFrame:
    """One row a group: head, size and its `typical` members nearest to the group's centre, best first."""
    order = Window.partitionBy("head_rec_id").orderBy(F.desc("cos"), "rec_id")
    ranked = members.withColumn("k", F.row_number().over(order)).where(F.col("k") <= typical)
    return ranked.groupBy("head_rec_id", "size").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "rec_id"))), lambda s: s.rec_id).alias("typical"))
