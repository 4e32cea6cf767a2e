"""Exact top-k inner products by a dual cover-tree search.

The top of the data's cover tree is a bounded set of centres; every vector belongs to its nearest centre's cell, with a
covering radius, and large cells have a second level of centres below their own. Queries are indexed by the same centres and form groups with radii of their own. The inner product of a
query and a vector is at most <q, c> + |q| r_c + |c| r_q + r_q r_c for a group with centre q and a cell with centre c, so
a pair of nodes is pruned when this is below the group's worst k-th score. Below the centres, each task builds the rest
of both trees for its part of a cell and walks pairs of nodes in the same way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.sampling import lowest_ranks
from tidemark.sources.scratch import materialise

CENTRES = 256  # of the top level; drawn from a hash sample of eight times as many vectors
_LEAF = 48
_CHILDREN = 32  # of a node inside a task
_BRANCHES = 64  # of a cell with too many vectors, chosen from about 1,024 of them
_SCORES = 4_000_000  # products held at a time
_CELL_ROWS = 4096  # a larger cell is dealt to several tasks
_QUERY_ROWS = 32_768  # more queries that visit one cell are dealt to several tasks; each reads the cell's piece


def covering_centres(sample: np.ndarray, count: int) -> np.ndarray:
    """Centres chosen farthest first: they cover the sample with a radius at most twice the least possible."""
    if not len(sample):
        return sample
    chosen = [0]
    gap = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(count, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


class CoverTree:
    """A cover tree over rows of a matrix; nodes are rows, and `reach` is the covering distance of a node's children.

    The children of a node are a net of its rows: the first has the node's own centre, centres lie at least `reach` apart, and
    each row is within `reach` of the centre of its child. `reach` is half the node's radius at most, or where that takes more
    than `_CHILDREN` centres, the distance at which that many chosen farthest first cover all. `radius` is the
    largest distance of a node's rows from its centre.
    """

    def __init__(self, data: np.ndarray):
        self.data = data
        self.order = np.arange(len(data))
        self.row, self.radius, self.reach, self.start, self.end, self.children = [], [], [], [], [], []
        if not len(data):
            return
        middle = int(np.linalg.norm(data - data.mean(axis=0), axis=1).argmin())
        waiting = [self._node(0, len(data), middle)]
        while waiting:
            node = waiting.pop()
            if self.end[node] - self.start[node] > _LEAF and self.radius[node] > 0:
                self._split(node)
                waiting += self.children[node]

    def _node(self, start: int, end: int, row: int) -> int:
        self.row.append(row)
        self.radius.append(float(np.linalg.norm(self.data[self.order[start:end]] - self.data[row], axis=1).max()))
        self.reach.append(0.0)
        self.start.append(start)
        self.end.append(end)
        self.children.append([])
        return len(self.row) - 1

    def _split(self, node: int) -> None:
        start, end = self.start[node], self.end[node]
        members = self.order[start:end].copy()
        rows = self.data[members]
        gap = np.linalg.norm(rows - self.data[self.row[node]], axis=1)
        owner, picks = np.zeros(len(rows), np.int64), [self.row[node]]
        while gap.max() > self.radius[node] / 2 and len(picks) < _CHILDREN:
            far = int(gap.argmax())
            other = np.linalg.norm(rows - rows[far], axis=1)
            nearer = other < gap
            owner[nearer], gap = len(picks), np.minimum(gap, other)
            picks.append(int(members[far]))
        self.reach[node] = float(gap.max())
        self.order[start:end] = members[np.argsort(owner, kind="stable")]
        ends = start + np.cumsum(np.bincount(owner, minlength=len(picks)))
        for row, lo, hi in zip(picks, [start, *ends[:-1].tolist()], ends.tolist()):
            self.children[node].append(self._node(lo, hi, row))


def search_pair(
    queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int
) -> pd.DataFrame:
    """The best k of `data` for each query among those that can still enter its best k; ties go to smaller ids.

    `floor` holds each query's k-th score so far. Scores are whole numbers below 2^53, so the products are exact.
    """
    left, right = CoverTree(queries), CoverTree(data)
    best_score = np.full((len(queries), k), -np.inf)
    best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
    worst = floor.copy()
    if len(queries) and len(data):
        waiting = [(0, 0)]
        while waiting:
            a, b = waiting.pop()
            rows = left.order[left.start[a] : left.end[a]]
            q, c, rq, rc = queries[left.row[a]], data[right.row[b]], left.radius[a], right.radius[b]
            bound = q @ c + np.linalg.norm(q) * rc + np.linalg.norm(c) * rq + rq * rc
            if bound + abs(bound) * 1e-9 + 1e-6 < worst[rows].min():
                continue
            if not left.children[a] and not right.children[b]:
                # A leaf of copies may be large.
                columns = right.order[right.start[b] : right.end[b]]
                step = max(1, _SCORES // len(columns))
                for at in range(0, len(rows), step):
                    _score(queries, query_ids, data, ids, rows[at : at + step], columns, worst, best_score, best_id)
            elif left.children[a] and (not right.children[b] or rq > rc):
                waiting += [(child, b) for child in left.children[a]]
            else:
                # The most promising child is looked at first.
                waiting += sorted(((a, x) for x in right.children[b]), key=lambda pair: q @ data[right.row[pair[1]]])
    row, place = np.nonzero(best_score > -np.inf)
    return pd.DataFrame(
        {"query_id": query_ids[row], "vec_id": best_id[row, place], "score": best_score[row, place].astype(np.int64)}
    )


def _score(queries, query_ids, data, ids, rows, columns, worst, best_score, best_id) -> None:
    """Merge the scores of a pair of leaves into the best k of its queries."""
    score = queries[rows] @ data[columns].T
    score[query_ids[rows][:, None] == ids[columns][None, :]] = -np.inf  # a query is not its own candidate
    score[score < worst[rows][:, None]] = -np.inf
    k = best_score.shape[1]
    all_scores = np.concatenate([best_score[rows], score], axis=1)
    all_ids = np.concatenate([best_id[rows], np.broadcast_to(ids[columns], score.shape)], axis=1)
    order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
    best_score[rows] = np.take_along_axis(all_scores, order, axis=1)
    best_id[rows] = np.take_along_axis(all_ids, order, axis=1)
    worst[rows] = np.maximum(worst[rows], best_score[rows, -1])


def _branches(
    data: DataFrame, top: np.ndarray, large: pd.DataFrame, seed: int
) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """The second level of the data's tree: cells become nodes, cell * _BRANCHES + branch, each with its gap to its centre.

    The branches of a `large` cell are a net of about 1,024 of its rows, its own centre first; a cell that fits a task is its
    own only branch. Rows go to the nearest branch. Returns the rows and the centres of each cell.
    """
    wanted = {int(c): (int(n), float(r)) for c, n, r in zip(large["cell"], large["n"], large["radius"])}
    below = {i: top[i : i + 1] for i in range(len(top))}

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        cell = int(rows["cell"].iloc[0])
        sample = np.stack(rows.sort_values("deployment_id")["features"].to_numpy()).astype(float)
        points = np.concatenate([top[cell : cell + 1], sample])
        gap, picks = np.linalg.norm(points - points[0], axis=1), [0]
        while gap.max() > wanted[cell][1] / 2 and len(picks) < _BRANCHES:
            picks.append(int(gap.argmax()))
            gap = np.minimum(gap, np.linalg.norm(points - points[picks[-1]], axis=1))
        return pd.DataFrame({"cell": cell, "branch": range(len(picks)), "features": list(points[picks])})

    if wanted:
        share = data.sparkSession.createDataFrame([(c, n) for c, (n, _) in wanted.items()], "cell int, n long")
        drawn = data.join(F.broadcast(share), "cell").where(F.pmod(F.xxhash64(F.lit(seed + 1), "deployment_id", "features"), F.col("n")) < 1024)
        chosen = drawn.select("cell", "deployment_id", "features").groupBy("cell").applyInPandas(
            choose, "cell int, branch int, features array<double>"
        )
        for cell, part in chosen.toPandas().sort_values("branch").groupby("cell"):
            below[int(cell)] = np.stack(part["features"].to_numpy())

    @F.pandas_udf("struct<cell:int,gap:double>")
    def nearest_branch(cell: pd.Series, features: pd.Series, gap: pd.Series) -> pd.DataFrame:
        node, distance = cell.to_numpy(np.int64) * _BRANCHES, gap.to_numpy(float).copy()
        for own in np.intersect1d(cell.unique(), list(wanted)):
            at = np.nonzero(cell.to_numpy() == own)[0]
            rows, centres = np.stack(features.iloc[at].to_numpy()).astype(float), below[int(own)]
            for lo in range(0, len(at), 4096):
                part = rows[lo : lo + 4096]
                branch = ((centres**2).sum(axis=1)[None, :] - 2 * part @ centres.T).argmin(axis=1)
                node[at[lo : lo + 4096]] += branch
                distance[at[lo : lo + 4096]] = np.linalg.norm(part - centres[branch], axis=1)
        return pd.DataFrame({"cell": node.astype(np.int32), "gap": distance})

    placed = data.withColumn("_at", nearest_branch("cell", "features", "gap"))
    return materialise(placed.select("deployment_id", "features", "_at.cell", "_at.gap")), below


def nearest_deployments(
    deployments: DataFrame, queries: DataFrame, *, k: int = 10, centres: int = CENTRES, cell_rows: int = _CELL_ROWS,
    query_rows: int = _QUERY_ROWS, seed: int = 7,
) -> DataFrame:
    """The k deployments with the largest inner product for each query, exactly.

    Both tables need deployment_id (whole number) and features (array of whole numbers, all of one length); queries that
    also are deployments don't find themselves. Returns query_id, rank (from 1), deployment_id and score; equal scores are
    ranked by the smaller deployment_id.

    Rows with a null id, null features, or a null or infinite component take no part; vectors of another length than the first by id
    are an error. Repeated rows are one vector if id and features agree, and separate candidates if not. Fewer than k
    candidates give fewer rows; empty tables give none. Extra columns are ignored.

    The sample for the centres has at most 8 * `centres` vectors. A cell with more than `cell_rows` vectors is cut into up to 64
    branches by nearness to centres of its own, and a branch with more is dealt to several tasks, so copies of one vector don't
    meet in one, and so are more than `query_rows` queries that visit a node.
    """
    bad = F.exists("features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("deployment_id").isNotNull() & F.col("features").isNotNull() & ~bad

    def vectors(table: DataFrame) -> DataFrame:
        plain = table.select(F.col("deployment_id").cast("long"), F.col("features").cast("array<double>"))
        return plain.where(usable).distinct()

    points = materialise(vectors(deployments))
    ranked = points.withColumn("place", F.xxhash64(F.lit(seed), "deployment_id"))
    drawn = lowest_ranks(ranked, "place", 8 * centres, ("deployment_id", "features")).collect()
    sample = np.array([r["features"] for r in drawn], float)
    top = covering_centres(sample, centres)
    if not len(top):
        return points.select(
            F.col("deployment_id").alias("query_id"), F.lit(1).alias("rank"), "deployment_id", F.lit(0).cast("long").alias("score")
        )
    length = (top**2).sum(axis=1)

    @F.pandas_udf("struct<cell:int,gap:double>")
    def nearest_centre(features: pd.Series) -> pd.DataFrame:
        data = np.stack(features.to_numpy()).astype(float) if len(features) else np.zeros((0, top.shape[1]))
        cell, gap = np.zeros(len(data), np.int32), np.zeros(len(data))
        for at in range(0, len(data), 4096):
            part = data[at : at + 4096]
            square = length[None, :] - 2 * part @ top.T
            cell[at : at + 4096] = square.argmin(axis=1)
            gap[at : at + 4096] = np.linalg.norm(part - top[cell[at : at + 4096]], axis=1)
        return pd.DataFrame({"cell": cell, "gap": gap})

    def placed(table: DataFrame) -> DataFrame:
        return materialise(
            table.withColumn("_at", nearest_centre("features")).select("deployment_id", "features", "_at.cell", "_at.gap")
        )

    data, asked = placed(points), placed(vectors(queries))
    # One row for each top node: at most `centres` of them, whatever the table's size.
    cells = data.groupBy("cell").agg(F.max("gap").alias("radius"), F.count("*").alias("n")).toPandas().sort_values("cell")
    groups = asked.groupBy("cell").agg(F.max("gap").alias("radius"), F.count("*").alias("n")).toPandas().sort_values("cell")
    if not len(groups):
        return asked.select(
            F.col("deployment_id").alias("query_id"), F.lit(1).alias("rank"), "deployment_id", F.lit(0).cast("long").alias("score")
        )
    large = cells[(cells["n"] > cell_rows) & (cells["radius"] > 0)]
    data, below = _branches(data, top, large, seed)
    # The nodes searched: at most `centres` times `_BRANCHES`.
    cells = data.groupBy("cell").agg(F.max("gap").alias("radius"), F.count("*").alias("n")).toPandas().sort_values("cell")
    middle = np.array([below[name // _BRANCHES][name % _BRANCHES] for name in cells["cell"].tolist()])
    pieces = np.maximum(1, -(-cells["n"].to_numpy() // cell_rows))
    q, c = top[groups["cell"]], middle
    rq, rc = groups["radius"].to_numpy()[:, None], cells["radius"].to_numpy()[None, :]
    bound = q @ c.T + np.linalg.norm(q, axis=1)[:, None] * rc + np.linalg.norm(c, axis=1)[None, :] * rq + rq * rc
    bound = bound + np.abs(bound) * 1e-9 + 1e-6
    # First each group looks into the cells of highest bound that hold enough vectors for k scores.
    best = np.argsort(-(q @ c.T), axis=1)
    enough = np.cumsum(cells["n"].to_numpy()[best], axis=1) > k
    first = np.zeros(bound.shape, bool)
    for i in range(len(groups)):
        first[i, best[i, : int(enough[i].argmax()) + 1 if enough[i].any() else len(cells)]] = True
    spark = deployments.sparkSession
    names, asking = cells["cell"].tolist(), groups["cell"].tolist()
    piece_of = spark.createDataFrame(list(zip(names, pieces.tolist())), "data_cell int, pieces long")

    def visits(chosen: np.ndarray) -> tuple[DataFrame, DataFrame]:
        """The nodes that each group visits, one row a group, and the query blocks of the visited nodes."""
        visits = [(asking[i], [names[j] for j in np.nonzero(chosen[i])[0]]) for i in range(len(asking))]
        blocks = -(-(chosen * groups["n"].to_numpy()[:, None]).sum(axis=0) // query_rows)
        visited = [(name, int(n)) for name, n in zip(names, blocks) if n]
        return (
            spark.createDataFrame(visits, "cell int, data_cells array<int>"),
            spark.createDataFrame(visited, "data_cell int, blocks long"),
        )

    dealt = data.withColumnRenamed("cell", "data_cell").join(F.broadcast(piece_of), "data_cell")  # one row a node
    dealt = dealt.select(
        "data_cell", F.pmod(F.xxhash64("deployment_id"), F.col("pieces")).alias("piece"), "deployment_id", "features"
    )

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        def matrix(frame: pd.DataFrame) -> np.ndarray:
            return np.stack(frame["features"].to_numpy()).astype(float) if len(frame) else np.zeros((0, top.shape[1]))

        return search_pair(
            matrix(left),
            left["deployment_id"].to_numpy(np.int64),
            left["floor"].to_numpy(float),
            matrix(right),
            right["deployment_id"].to_numpy(np.int64),
            k,
        )

    def searched(queries: DataFrame, chosen: np.ndarray) -> DataFrame:
        visited, blocks = visits(chosen)
        zero = F.lit(0).cast("long")
        sent = queries.join(F.broadcast(visited), "cell").withColumn("data_cell", F.explode("data_cells")).drop("data_cells")
        sent = sent.join(F.broadcast(piece_of), "data_cell").join(F.broadcast(blocks), "data_cell")
        sent = sent.withColumn("block", F.pmod(F.xxhash64("deployment_id"), F.col("blocks")))
        sent = sent.withColumn("piece", F.explode(F.sequence(zero, F.col("pieces") - 1)))
        # Each block of queries reads the pieces of its cell; at most one row for each node is broadcast.
        read = dealt.join(F.broadcast(blocks), "data_cell").withColumn("block", F.explode(F.sequence(zero, F.col("blocks") - 1)))
        return (
            sent.select("data_cell", "piece", "block", "deployment_id", "features", "floor")
            .groupBy("data_cell", "piece", "block")
            .cogroup(read.drop("blocks").groupBy("data_cell", "piece", "block"))
            .applyInPandas(search, "query_id long, vec_id long, score long")
        )

    everywhere = asked.withColumn("floor", F.lit(float("-inf")))
    found = materialise(searched(everywhere, first))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = (
        found.withColumn("_n", F.row_number().over(ranked))
        .where(F.col("_n") == k)
        .select(F.col("query_id").alias("deployment_id"), F.col("score").cast("double").alias("floor"))
    )
    known = materialise(
        asked.join(kth, "deployment_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    )
    worst = known.groupBy("cell").agg(F.min("floor").alias("worst")).toPandas().set_index("cell")["worst"]
    rest = ~first & (bound >= worst.reindex(groups["cell"]).to_numpy()[:, None])
    everything = found.unionByName(searched(known, rest)) if rest.any() else found
    return (
        everything.distinct()
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("deployment_id"), "score")
    )
