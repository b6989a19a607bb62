"""Exact top-k inner-product search with a KD-tree for each shard.

Shards follow the tree's own splits: a coarse tree of median splits, made from a bounded sample, sends
every vector to a leaf, and a leaf that many equal vectors overfill is dealt out evenly.  Each shard
gets one tree, built once and stored with the tight box around its vectors.  A tree splits at the
median of the widest side of the tight box around a node's vectors.

A search goes best-first over the nodes by the largest inner product that a node's box allows, and
ends when no box can beat the k-th score.  It runs in two passes: every query first searches the
shard whose box allows most; the k-th score found there then rules out all shards whose boxes
cannot reach it, and only the pairs of queries and shards that are left are searched.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranges import small
from .storage import stored

LEAF = 256
#: Numbers of the sample from which the coarse tree is made, at most about 32 MB.
SAMPLE_NUMBERS = 4_000_000
#: Boxes that are compared with a block of queries at a time.
BOXES = 1024


class Coarse:
    """Median splits of a sample into about ``leaves`` leaves; equal vectors stay together."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.axis, self.cut, self.children, self.leaves = [0], [0], [[-1, -1]], 0
        todo = [(0, sample, leaves)]
        while todo:
            node, own, wanted = todo.pop()
            axis = int(np.argmax(own.max(0).astype(np.float64) - own.min(0))) if len(own) else 0
            values = np.sort(own[:, axis]) if len(own) else np.zeros(0)
            if wanted < 2 or not len(values) or values[0] == values[-1]:
                self.children[node] = [-1, self.leaves]
                self.leaves += 1
                continue
            cut = values[len(values) * (wanted // 2) // wanted]
            cut = cut if cut > values[0] else values[np.searchsorted(values, cut, "right")]
            left, right = own[own[:, axis] < cut], own[own[:, axis] >= cut]
            self.axis[node], self.cut[node] = axis, int(cut)
            self.children[node] = [len(self.axis), len(self.axis) + 1]
            for part, many in ((left, wanted // 2), (right, wanted - wanted // 2)):
                todo.append((len(self.axis), part, many))
                self.axis.append(0)
                self.cut.append(0)
                self.children.append([-1, -1])

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        axis, cut, children = np.array(self.axis), np.array(self.cut), np.array(self.children)
        node = np.zeros(len(points), np.int64)
        open_rows = np.arange(len(points))
        while len(open_rows):
            open_rows = open_rows[children[node[open_rows], 0] >= 0]
            at = node[open_rows]
            node[open_rows] = children[at, (points[open_rows, axis[at]] >= cut[at]).astype(np.int64)]
        return children[node, 1]


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product of each query with any point of each box."""
    q, low, high = queries.astype(np.float64), low.astype(np.float64), high.astype(np.float64)
    upper = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    return upper + 1e-12 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T)


class Tree:
    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        low, high, children, ranges, least = [], [], [], [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            begin, end, parent, side = todo.pop()
            own, node = points[order[begin:end]], len(low)
            low.append(own.min(0))
            high.append(own.max(0))
            children.append([-1, -1])
            ranges.append((begin, end))
            least.append(ids[order[begin:end]].min())
            if parent >= 0:
                children[parent][side] = node
            wide = high[node].astype(np.float64) - low[node]
            axis = int(wide.argmax())
            if end - begin > leaf and wide[axis] > 0:
                half = (end - begin) // 2
                order[begin:end] = order[begin:end][np.argpartition(own[:, axis], half)]
                todo += [(begin, begin + half, node, 0), (begin + half, end, node, 1)]
            else:
                order[begin:end] = order[begin:end][np.argsort(ids[order[begin:end]], kind="stable")]
        self.points, self.ids = points[order], ids[order]
        self.low, self.high = np.array(low), np.array(high)
        self.children, self.ranges, self.least = children, ranges, least

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray, floor_id: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and scores of each query's k best that beat ``(floor, floor_id)``, without ``own``."""
        upper = bounds(queries, self.low, self.high)
        exact = float(np.abs(queries).max(initial=0)) * float(max(np.abs(self.low).max(), np.abs(self.high).max())) * queries.shape[1] < 2**53
        points = self.points.astype(np.float64) if exact else self.points
        rows = queries.astype(np.float64) if exact else queries
        found_ids, found_scores = [], []
        for j, q in enumerate(rows):
            limit, limit_id = floor[j], floor_id[j]
            ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
            heap = [(-upper[j, 0], 0)]
            while heap:
                bound, node = heapq.heappop(heap)
                if -bound < limit:
                    break
                if self.children[node][0] >= 0:
                    for child in self.children[node]:
                        if upper[j, child] >= limit:
                            heapq.heappush(heap, (-upper[j, child], child))
                    continue
                begin, end = self.ranges[node]
                if -bound == limit and self.least[node] > limit_id:
                    continue
                score = (points[begin:end] @ q).astype(np.int64)
                of = self.ids[begin:end]
                good = np.flatnonzero(((score > limit) | ((score == limit) & (of < limit_id))) & (of != own[j]))
                if not len(good):
                    continue
                ids, scores = np.concatenate([ids, of[good]]), np.concatenate([scores, score[good]])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(ids) == k and (scores[-1] > limit or scores[-1] == limit and ids[-1] < limit_id):
                    limit, limit_id = scores[-1], ids[-1]
            found_ids.append(ids)
            found_scores.append(scores)
        return found_ids, found_scores


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


NOTHING = np.iinfo(np.int64).min
RESULT = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


INDEX = T.StructType([*[T.StructField(c, T.IntegerType()) for c in ("dim", "leaf", "sub")], *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("low", "high")], T.StructField("tree", T.BinaryType())])
PAIRS = T.StructType([T.StructField("id", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("leaf", T.IntegerType()), T.StructField("sub", T.IntegerType()), T.StructField("bound", T.DoubleType())])


def _empty(schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).empty_table()


def _indexed(shard: pa.Table) -> pa.Table:
    """The tree of one shard and the box around it."""
    tree = Tree(_matrix(shard["v"], shard.num_rows), shard["id"].to_numpy())
    key = {c: pa.array([shard[c][0].as_py()], pa.int32()) for c in ("dim", "leaf", "sub")}
    box = {c: pa.array([getattr(tree, c)[0].tolist()], pa.list_(pa.int64())) for c in ("low", "high")}
    return pa.table({**key, **box, "tree": pa.array([pickle.dumps(tree)], pa.binary())})


def _search(k: int):
    def run(shard: pa.Table, queries: pa.Table) -> pa.Table:
        if not shard.num_rows or not queries.num_rows:
            return _empty(RESULT)
        tree = pickle.loads(shard["tree"][0].as_py())
        own = queries["id"].to_numpy()
        ids, scores = tree.search(_matrix(queries["v"], queries.num_rows), own, k, queries["floor"].to_numpy(), queries["floor_id"].to_numpy())
        return pa.table({"query_id": np.repeat(own, [len(x) for x in ids]), "vec_id": np.concatenate(ids), "score": np.concatenate(scores)})

    return run


def _reached(first: bool):
    """Pairs of queries and boxes: the box that allows a query most, or all that allow its floor."""

    def run(boxes: pa.Table, queries: pa.Table) -> pa.Table:
        if not boxes.num_rows or not queries.num_rows:
            return _empty(PAIRS)
        upper = bounds(_matrix(queries["v"], queries.num_rows), _matrix(boxes["low"], boxes.num_rows), _matrix(boxes["high"], boxes.num_rows))
        if first:
            q, box = np.arange(len(upper)), upper.argmax(1)
        else:
            q, box = np.nonzero(upper >= queries["floor"].to_numpy()[:, None].astype(np.float64))
        keys = {c: pa.array(boxes[c].to_numpy()[box], pa.int32()) for c in ("dim", "leaf", "sub")}
        return pa.table({"id": pa.array(queries["id"].to_numpy()[q]), **keys, "bound": pa.array(upper[q, box])})

    return run


def quantised(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False))


def top_k(
    df: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    shard_rows: int = 8192,
    block_rows: int = 2048,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k largest inner products of every query row.

    Components become floor(scale * x).  Candidates are all rows but those with the query's own id;
    ties go to the smaller id; fewer than k candidates give as many rows.  Rows with a null id, a
    null or empty vector, or a null or non-finite component take no part.  Vectors of different
    lengths are not compared.  Repeated rows are candidates each; a repeated query id stands for one
    query with the greatest of its vectors.  Other columns are ignored.
    """
    wanted = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("raw"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    wanted = wanted.where(F.col("id").isNotNull() & usable(F.col("raw"))).select("id", "is_query", quantised(F.col("raw"), scale).alias("v"))
    table = stored(wanted.withColumn("place", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "vectors")
    rows, asked, numbers = table.agg(F.count("*"), F.count_if("is_query"), F.sum("dim")).first()
    if not rows:
        return table.sparkSession.createDataFrame([], RESULT).select("query_id", F.lit(0).alias("rank"), "vec_id", "score")
    index = _index(table, rows, numbers, shard_rows)
    boxes = stored(index.select("dim", "leaf", "sub", "low", "high"), "kd-boxes")
    n_boxes = boxes.count()

    queries = table.where("is_query").groupBy("dim", "id").agg(F.max("v").alias("v")).groupBy("id").agg(F.max_by("v", "dim").alias("v"))
    queries = stored(queries.select(F.size("v").alias("dim"), "id", "v"), "kd-queries")
    unbounded = queries.select("dim", "id", "v", F.lit(NOTHING).alias("floor"), F.lit(-1).cast("long").alias("floor_id"))

    def reached(asking: DataFrame, first: bool) -> DataFrame:
        chunks, blocks = math.ceil(n_boxes / BOXES), max(1, math.ceil(asked / block_rows))
        chunk, block = F.pmod(F.xxhash64("leaf", "sub"), F.lit(chunks)).cast("int"), F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int")
        left = boxes.withColumn("chunk", chunk).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = asking.withColumn("block", block).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        key = ["dim", "chunk", "block"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_reached(first), PAIRS)

    def searched(pairs: DataFrame, asking: DataFrame) -> DataFrame:
        """Queries of a shard go in blocks, so that a shard that all of them reach is split."""
        shard = ["dim", "leaf", "sub"]
        many = stored(pairs.groupBy(*shard).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")), "kd-blocks")
        copies = index.select(*shard, "tree").join(small(many), shard).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = pairs.join(small(many), shard).withColumn("block", F.pmod(F.xxhash64("id", F.lit("part")), F.col("blocks")).cast("int"))
        asks = dealt.select(*shard, "block", "id").join(asking.select("id", "v", "floor", "floor_id"), "id")
        key = [*shard, "block"]
        return copies.select(*key, "tree").groupBy(*key).cogroup(asks.groupBy(*key)).applyInArrow(_search(k), RESULT)

    most = reached(unbounded, True).groupBy("id").agg(F.max_by(F.struct("dim", "leaf", "sub"), F.struct("bound", "leaf", "sub")).alias("home"))
    home = stored(most.select("id", "home.*"), "kd-home")
    near = stored(searched(home, unbounded), "kd-home-scores")

    last = near.groupBy(F.col("query_id").alias("q")).agg(F.count("*").alias("n"), F.max(F.struct((-F.col("score")).alias("low"), F.col("vec_id"))).alias("worst")).where(F.col("n") >= k)
    bounded = queries.join(last, F.col("id") == F.col("q"), "left").select("dim", "id", "v", F.coalesce(-F.col("worst.low"), F.lit(NOTHING)).alias("floor"), F.coalesce("worst.vec_id", F.lit(-1)).alias("floor_id"))
    bounded = stored(bounded, "kd-floors")
    pairs = stored(reached(bounded, False).join(home, ["id", "dim", "leaf", "sub"], "left_anti"), "kd-pairs")
    away = searched(pairs, bounded)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.unionByName(away).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _index(table: DataFrame, rows: int, numbers: int, shard_rows: int) -> DataFrame:
    """A stored row for each shard: its key (dim, leaf, sub), its box and its tree.

    The sample is at most ``SAMPLE_NUMBERS`` numbers, by a hash of the row's place; vectors of a length
    that it lacks make one leaf.
    """
    share = min(1.0, SAMPLE_NUMBERS / numbers)
    some = table.where(F.pmod(F.xxhash64("place", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1)).select("dim", "v").toArrow()
    dims = some["dim"].to_numpy()
    coarse = {}
    for dim in np.unique(dims).tolist():
        own = _matrix(some["v"].filter(pa.array(dims == dim)), int((dims == dim).sum()))
        coarse[dim] = Coarse(own, max(1, math.ceil(rows * len(own) / len(dims) / shard_rows)))
    shared = table.sparkSession.sparkContext.broadcast(coarse)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, leaf = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int32)
            for dim in np.unique(dims).tolist():
                if dim in shared.value:
                    at = np.flatnonzero(dims == dim)
                    leaf[at] = shared.value[dim].leaf_of(_matrix(pa.chunked_array([batch.column("v").take(pa.array(at))]), len(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    fields = T.StructType([*table.select("dim", "id", "place", "v").schema, T.StructField("leaf", T.IntegerType())])
    placed = stored(table.select("dim", "id", "place", "v").mapInArrow(leaves, fields), "kd-leaves")
    subs = placed.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("subs"))
    dealt = placed.join(small(stored(subs, "kd-subs")), ["dim", "leaf"]).withColumn("sub", F.pmod(F.xxhash64("place", F.lit("sub")), F.col("subs")).cast("int"))
    return stored(dealt.select("dim", "leaf", "sub", "id", "v").groupBy("dim", "leaf", "sub").applyInArrow(_indexed, INDEX), "kd-index")
