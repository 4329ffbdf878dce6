"""Exact top-k by integer inner product: dual-tree search with cover trees over blocks.

Vectors are sorted by the nearest of a few pivots and cut into blocks of neighbours, queries and candidates alike. Every block
gets a cover tree once, and is known to the others by its tree's root: a centre and a covering radius.

1. Every query block is searched in its most promising candidate blocks, ``ROWS`` rows of them, which gives each query a first kth score.
2. A pair of blocks goes on only if for some query ``q.c + |q| r``, the most that the candidate root's radius allows, reaches that score.
   All other pairs end here, before any vector is shuffled.
3. Query tree and candidate trees of the pairs that are left are descended together. A pair of nodes is pruned where even
   ``q.c + |q| rc + |c| rq + rq rc`` lies below the worst kth score of the query group; leaves are compared as dense products.
4. The top-k lists of a query are merged by a window of ``k`` rows for each group of blocks.

No vector meets a driver but the ``PIVOTS`` pivots, a sample that decides locality only, and the centres of at most ``MAX_BLOCKS`` blocks.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytequarry.llm._common import materialise, tidy

K, SCALE, EVERY = 20, 64, 20
QUERIES, ROWS = 1024, 4096
#: Blocks of candidates, beyond which they grow, and pivots.
MAX_BLOCKS, PIVOTS = 4096, 128
#: Candidate blocks in a group.
GROUP = 4
LEAF = 128
#: Levels of a tree.
DEPTH = 48
#: Below this largest product of absolute sums, float64 arithmetic on integers is exact.
_EXACT = 2.0**52
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


class _Tree:
    """A cover tree: every node has a point as its centre and the radius that covers its points; children's radii halve at each level."""

    __slots__ = ("center", "kids", "norm", "points", "radius", "worst")

    def __init__(self, x: np.ndarray, points: np.ndarray, center: int, dist: np.ndarray, depth: int = 0):
        self.center, self.points, self.kids, self.worst = center, points, [], -np.inf
        self.radius = float(dist.max()) * (1 + 1e-9) + 1e-9
        self.norm = _length(x[center])
        if len(points) <= LEAF or self.radius <= 1e-6:
            return
        if depth == DEPTH:
            self.kids = _leaves(x, points)
            return
        reach, left, d = self.radius / 2, points, dist
        own = center
        while len(left):
            near = d <= reach
            if len(left) == len(points) and near.all():
                return
            self.kids.append(_Tree(x, left[near], own, d[near], depth + 1))
            left = left[~near]
            if len(left):
                if len(self.kids) >= 64 or len(left) <= LEAF:  # what is scattered too widely becomes one node of its own radius
                    rest = _leaf(x, left)
                    rest.kids = _leaves(x, left) if len(left) > LEAF else []
                    self.kids.append(rest)
                    return
                own = int(left[0])
                d = _gaps(x, left, own)


def _length(v: np.ndarray) -> float:
    return float(np.sqrt((v * v).sum()))


def _gaps(x: np.ndarray, points: np.ndarray, center: int) -> np.ndarray:
    return np.sqrt(((x[points] - x[center]) ** 2).sum(1))


def _leaf(x: np.ndarray, points: np.ndarray) -> _Tree:
    node = _Tree.__new__(_Tree)
    node.center, node.points, node.kids, node.worst = int(points[0]), points, [], -np.inf
    node.radius, node.norm = float(_gaps(x, points, node.center).max()) * (1 + 1e-9) + 1e-9, _length(x[points[0]])
    return node


def _leaves(x: np.ndarray, points: np.ndarray) -> list[_Tree]:
    return [_leaf(x, points[i : i + LEAF]) for i in range(0, len(points), LEAF)]


def cover_tree(x: np.ndarray) -> _Tree:
    points = np.arange(len(x))
    return _Tree(x, points, 0, _gaps(x, points, 0))


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    """Rows with zeros for missing components."""
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


class Search:
    """Top k of a block of queries over candidate blocks that come one after the other; the bounds carry over.

    ids and rows name the queries; a candidate with a query's own row isn't compared with it. floor: score and id of the kth
    that each query is known to have elsewhere, so that only candidates which come before it are looked for.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray, k: int, tree: _Tree | None = None, floor: np.ndarray | None = None):
        self.ids, self.rows, self.x, self.k = ids, rows, x, k
        shape = (len(ids), k)
        self.score, self.found, self.found_row = np.full(shape, _LOW), np.full(shape, _HIGH), np.full(shape, _HIGH)
        self.kth, self.kth_id = np.array([[_LOW], [_HIGH]]).repeat(len(ids), 1) if floor is None else floor
        self.floor = np.where(self.kth_id < _HIGH, self.kth.astype(float), -np.inf)
        self.top = float(np.abs(x).max())
        self.tree = tree or cover_tree(x)
        self._reset(self.tree)

    def _reset(self, node: _Tree) -> None:
        node.worst = float(self.worst(node.points).min())
        for kid in node.kids:
            self._reset(kid)

    def worst(self, points: np.ndarray) -> np.ndarray:
        """The score that a candidate of each query has to reach."""
        return np.maximum(self.floor[points], np.where(self.found_row[points, -1] < _HIGH, self.score[points, -1].astype(float), -np.inf))

    def add(self, ids: np.ndarray, rows: np.ndarray, y: np.ndarray, tree: _Tree | None = None) -> None:
        width = max(self.x.shape[1], y.shape[1])
        self.x, y = _wide(self.x, width), _wide(y, width)
        self.cand = ids, rows, y
        self.large = self.top * float(np.abs(y).max()) * width >= _EXACT
        self._descend(self.tree, [tree or cover_tree(y)])

    def _bound(self, q: _Tree, c: _Tree) -> float:
        top = float(self.x[q.center] @ self.cand[2][c.center]) + q.norm * c.radius + c.norm * q.radius + q.radius * c.radius
        top += 1e-9 * (q.norm + q.radius) * (c.norm + c.radius) + 1e-6
        return top if top == top else np.inf

    def _descend(self, q: _Tree, cands: list[_Tree]) -> None:
        if q.kids:
            spread = []
            for c in cands:  # the wider of two nodes is opened
                if self._bound(q, c) >= q.worst:
                    spread += c.kids if c.kids and c.radius > q.radius else [c]
            for kid in q.kids:
                self._descend(kid, [c for c in spread if self._bound(kid, c) >= kid.worst])
            q.worst = min(kid.worst for kid in q.kids)
            return
        heap = [(-self._bound(q, c), n, c) for n, c in enumerate(cands)]
        heapq.heapify(heap)
        n = len(heap)
        while heap:
            bound, _, c = heapq.heappop(heap)
            if -bound < q.worst:
                break
            for kid in c.kids:
                b = self._bound(q, kid)
                if b >= q.worst:
                    heapq.heappush(heap, (-b, n, kid))
                    n += 1
            if not c.kids:
                self._compare(q, c)

    def _compare(self, q: _Tree, c: _Tree) -> None:
        ids, rows, y = self.cand
        s = self.x[q.points] @ y[c.points].T
        slack = 1e-9 * (q.norm + q.radius) * (c.norm + c.radius) if self.large else 0.0
        reach = ~(s + slack < self.worst(q.points)[:, None])
        cols = np.flatnonzero(reach.any(0))
        if len(cols):
            at = c.points[cols]
            if self.large:  # float64 has chosen the columns, whole numbers of any size give the scores, within a long
                a, b = ([[int(v) for v in row] for row in m] for m in (self.x[q.points].tolist(), y[at].tolist()))
                exact = [[max(_LOW, min(_HIGH, sum(u * v for u, v in zip(p, r, strict=True)))) for r in b] for p in a]
                new = np.array(exact, np.int64)
            else:
                new = s[:, cols].astype(np.int64)
            shape = (len(q.points), len(cols))
            own = self.rows[q.points][:, None] == rows[at][None, :]
            kth, kth_id = self.kth[q.points][:, None], self.kth_id[q.points][:, None]
            own |= (new < kth) | (new == kth) & (ids[at] > kth_id)
            score = np.concatenate([self.score[q.points], np.where(own, _LOW, new)], 1)
            found = np.concatenate([self.found[q.points], np.where(own, _HIGH, np.broadcast_to(ids[at], shape))], 1)
            found_row = np.concatenate([self.found_row[q.points], np.where(own, _HIGH, np.broadcast_to(rows[at], shape))], 1)
            order = np.lexsort((found_row, found, ~score), axis=1)[:, : self.k]
            for held, new in ((self.score, score), (self.found, found), (self.found_row, found_row)):
                held[q.points] = np.take_along_axis(new, order, 1)
        q.worst = float(self.worst(q.points).min())

    def result(self) -> list[np.ndarray]:
        """query row, query id, candidate id, candidate row, score of all that was found."""
        ok = self.found_row < _HIGH
        who = np.repeat(np.arange(len(self.ids)), self.k).reshape(ok.shape)[ok]
        return [self.rows[who], self.ids[who], self.found[ok], self.found_row[ok], self.score[ok]]


_BLOCK = "block long, ids binary, rows binary, data binary, width long, tree binary, center binary, radius double, n long"


def _matrix(vectors: list[list[float]]) -> np.ndarray:
    x = np.zeros((len(vectors), max(map(len, vectors))))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    return x


def _tour(pivots: np.ndarray) -> np.ndarray:
    """The pivots in an order where each is followed by the nearest of those left, so that neighbours share blocks."""
    left, out = list(range(1, len(pivots))), [0]
    with np.errstate(all="ignore"):
        while left:
            gap = np.nan_to_num(((pivots[left] - pivots[out[-1]]) ** 2).sum(1), nan=np.inf)
            out.append(left.pop(int(gap.argmin())))
    return pivots[out]


def _blocks(df: DataFrame, pivots: np.ndarray, size: int, n_rows: int) -> DataFrame:
    """Rows (vec_id, row, v) sorted by nearest pivot and distance, and packed with a cover tree for each block. The sort has so few partitions
    that each holds about two blocks, whatever the session's setting: many small blocks would each be searched for k rows."""

    def assign(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                piece = batch.slice(k, 4096)
                x = _matrix(piece.column(2).to_pylist())
                width = max(x.shape[1], pivots.shape[1])
                with np.errstate(all="ignore"):
                    gap = np.nan_to_num((x**2).sum(1)[:, None] - 2 * _wide(x, width) @ _wide(pivots, width).T + (pivots**2).sum(1), nan=np.inf)
                near = gap.argmin(1)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(near.astype(np.int32)), pa.array(gap[np.arange(len(x)), near])], names=["vec_id", "row", "v", "pivot", "gap"])

    def cut(batches):
        from pyspark import TaskContext

        number, parts, n = TaskContext.get().partitionId() << 24, [], 0

        def block(rows: pa.Table):
            ids, own, x = rows["vec_id"].to_numpy(), rows["row"].to_numpy(), _matrix(rows["v"].to_pylist())
            with np.errstate(all="ignore"):
                tree = cover_tree(x)
            cells = [number, ids.tobytes(), own.tobytes(), x.tobytes(), x.shape[1], pickle.dumps(tree), x[tree.center].tobytes(), tree.radius, len(x)]
            return pa.RecordBatch.from_arrays([pa.array([c]) for c in cells], names=["block", "ids", "rows", "data", "width", "tree", "center", "radius", "n"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, size - n)
                parts.append(piece)
                at, n = at + piece.num_rows, n + piece.num_rows
                if n == size:
                    yield block(pa.Table.from_batches(parts))
                    number, parts, n = number + 1, [], 0
        if n:
            yield block(pa.Table.from_batches(parts))

    placed = df.select("vec_id", "row", "v").mapInArrow(assign, "vec_id long, row long, v array<double>, pivot int, gap double")
    ranged = placed.repartitionByRange(max(1, n_rows // (2 * size)), "pivot", "gap", "row").sortWithinPartitions("pivot", "gap", "row")
    return ranged.select("vec_id", "row", "v").mapInArrow(lambda batches: tidy(cut(batches)), _BLOCK)


def _opened(ids: bytes, rows: bytes, data: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(rows, np.int64), np.frombuffer(data).reshape(len(ids), width)


_FOUND = "query_row long, query_id long, vec_id long, vec_row long, score long"


def _searched(dealt: DataFrame, k: int, floors: bool) -> DataFrame:
    """Groups (q, g) of a query block (side 0) and the candidate blocks that it meets, searched. ``floor`` holds the queries' known kth scores."""

    def run(batches):
        group, s = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                q, g, side, _, ids, rows, data, width, tree, floor = (c[i].as_py() for c in batch.columns)
                with np.errstate(all="ignore"):
                    if side == 0:
                        if s is not None:
                            yield pa.RecordBatch.from_arrays([pa.array(a) for a in s.result()], names=names)
                        group = (q, g)
                        s = Search(*_opened(ids, rows, data, width), k, pickle.loads(tree), np.frombuffer(floor, np.int64).reshape(2, -1) if floors else None)
                    elif (q, g) == group:
                        s.add(*_opened(ids, rows, data, width), pickle.loads(tree))
        if s is not None:
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in s.result()], names=names)

    names = ["query_row", "query_id", "vec_id", "vec_row", "score"]
    cols = ("q", "g", "side", "block", "ids", "rows", "data", "width", "tree", "floor")
    return dealt.select(*cols).repartition("q", "g").sortWithinPartitions("q", "g", "side", "block").mapInArrow(lambda batches: tidy(run(batches)), _FOUND)


def search(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE, every: int = EVERY) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` highest scores of every query over all other vectors.

    Components become floor(scale * x); queries are the rows with an id divisible by ``every``; candidates all rows but the query's own, so
    rows that repeat an id are queries and candidates each. Ties go to the smaller id. A vector that is null, empty, or holds null or
    non-finite components takes no part, nor does a null id; vectors may be of any length, and where lengths differ, missing components
    are 0. A score beyond a long is the nearest long. An empty table, or one vector, gives no rows. Other columns are ignored,
    whatever their names.
    """
    spark = df.sparkSession
    clean = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).filter("vec_id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    scaled = clean.select("vec_id", F.expr(f"transform(v, x -> {float(scale)}D * cast(x as double))").alias("v")).filter("not exists(v, x -> abs(x) = double('infinity'))")
    # floor of a double beyond a long is itself
    whole = scaled.select("vec_id", F.expr("transform(v, x -> if(abs(x) < 9e15D, cast(floor(x) as double), x))").alias("v"))
    rows = materialise(whole.withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = rows.filter(F.col("vec_id") % every == 0)
    n, n_asked = rows.count(), asked.count()
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(PIVOTS).select("v").collect()
    if n < 2 or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = _tour(_matrix([r.v for r in sample]))
    cand = materialise(_blocks(rows, pivots, max(ROWS, -(-n // MAX_BLOCKS)), n), "candidate-blocks")
    query = materialise(_blocks(asked, pivots, max(QUERIES, -(-n_asked // MAX_BLOCKS)), n_asked), "query-blocks")
    # the number of blocks is bounded by MAX_BLOCKS and one more for each task
    roots = cand.select("block", "center", "radius", "n").orderBy("block").collect()
    known = spark.sparkContext.broadcast((np.array([r.block for r in roots]), _matrix([np.frombuffer(r.center).tolist() for r in roots]), np.array([r.radius for r in roots]), np.array([r.n for r in roots])))
    enough = ROWS

    def limits(x: np.ndarray) -> np.ndarray:
        """The most that each row can score in each candidate block."""
        _, centers, radii, _ = known.value
        width = max(x.shape[1], centers.shape[1])
        x, centers = _wide(x, width), _wide(centers, width)
        size, far = np.sqrt((x**2).sum(1))[:, None], np.sqrt((centers**2).sum(1))
        return np.nan_to_num(x @ centers.T + size * radii + 1e-9 * size * (far + radii) + 1e-6, nan=np.inf)

    def home(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = _opened(*(batch.column(c)[i].as_py() for c in ("ids", "rows", "data", "width")))[2]
                with np.errstate(all="ignore"):
                    order = np.argsort(-limits(x).sum(0), kind="stable")
                blocks, n = known.value[0], known.value[3]
                best = order[: int(np.searchsorted(np.cumsum(n[order]), enough)) + 1]  # blocks may be small, so several count as one
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(i, 1), pa.array([blocks[best].tolist()], pa.list_(pa.int64()))], names=["q", "homes"])

    plain = [F.col(c) for c in ("ids", "rows", "data", "width", "tree")]
    first = materialise(query.select("block", "ids", "rows", "data", "width").mapInArrow(home, "q long, homes array<long>"), "homes")
    no_floor = F.lit(None).cast("binary").alias("floor")
    left = query.select(F.col("block").alias("q"), F.lit(0).alias("g"), F.lit(0).alias("side"), "block", *plain, no_floor)
    right = cand.join(first.select("q", F.explode("homes").alias("c")), F.col("block") == F.col("c")).select("q", F.lit(0).alias("g"), F.lit(1).alias("side"), "block", *plain, no_floor)
    near = materialise(_searched(left.unionByName(right), k, False), "first-scores")
    # the kth of each query that has k of them
    kth = near.groupBy("query_row").agg(F.max(F.struct(F.bitwise_not("score").alias("low"), "vec_id")).alias("kth"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
    kth = kth.select("query_row", F.bitwise_not("kth.low").alias("score"), "kth.vec_id")

    def floors(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = np.frombuffer(batch.column("rows")[i].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), batch.column("block")[i].as_py())), pa.array(rows), pa.array(np.arange(len(rows)))], names=["block", "query_row", "at"])

    listed = query.select("block", "rows").mapInArrow(floors, "block long, query_row long, at long").join(kth, "query_row", "left")
    # a block's list is as long as the block
    kths = F.sort_array(F.collect_list(F.struct("at", F.coalesce("score", F.lit(_LOW)).alias("score"), F.coalesce("vec_id", F.lit(_HIGH)).alias("vec_id"))))
    held = listed.groupBy("block").agg(kths.alias("kths")).select("block", F.concat(F.transform("kths", lambda x: x["score"]), F.transform("kths", lambda x: x["vec_id"])).alias("floors"))
    known_q = materialise(query.join(held, "block").join(first.withColumnRenamed("q", "block"), "block"), "floors")

    def pairs(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = _opened(*(batch.column(c)[i].as_py() for c in ("ids", "rows", "data", "width")))[2]
                kth, kth_id = np.array(batch.column("floors")[i].as_py(), np.int64).reshape(2, -1)
                floor = np.where(kth_id < _HIGH, kth.astype(float), -np.inf)
                with np.errstate(all="ignore"):
                    open_ = (limits(x) >= floor[:, None]).any(0)
                open_ &= ~np.isin(known.value[0], batch.column("homes")[i].as_py())
                at = np.flatnonzero(open_)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), batch.column("block")[i].as_py())), pa.array(known.value[0][at]), pa.array((np.arange(len(at)) // GROUP).astype(np.int32))], names=["q", "c", "g"])

    met = materialise(known_q.select("block", "ids", "rows", "data", "width", "floors", "homes").mapInArrow(pairs, "q long, c long, g int"), "open-pairs")
    as_bytes = lambda batches: (
        pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array(v, np.int64).tobytes() for v in b.column(1).to_pylist()], pa.binary())], names=["q", "floor"]) for b in batches
    )
    floor = known_q.select(F.col("block").alias("q"), "floors").mapInArrow(as_bytes, "q long, floor binary")
    left = query.withColumnRenamed("block", "q").join(met.select("q", "g").distinct(), "q").join(floor, "q").select("q", "g", F.lit(0).alias("side"), F.col("q").alias("block"), *plain, "floor")
    right = cand.join(met, F.col("block") == F.col("c")).select("q", "g", F.lit(1).alias("side"), "block", *plain, no_floor)
    found = near.unionByName(_searched(left.unionByName(right), k, True))
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    return found.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
