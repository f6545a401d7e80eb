"""Hard-negative mining: exact searches of anchors against all rows, thinned by bounds along a spanning tree of the anchors.

Anchors lie in blocks of neighbours. A block's anchors form a minimum spanning tree. A candidate's score at a tree node is exact or an
interval; at a child it lies within that interval widened by edge length times the candidate's norm (Cauchy-Schwarz). Only candidates whose
interval meets the window in which the child still looks for rows are scored; for the others the widened interval goes on to the
grandchildren. Windows close as better rows are found. Two searches run this way: the first finds each anchor's positives, the second
the rows between the shares of the positives' scores.

Every block of anchors meets every slab of rows, in tasks of one block and one group of slabs: rows stream through in sorted order, so a task
holds one block and one slab. Neither all anchors nor all rows are ever in one place.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from tidemark.llm.shared import materialise, release
from tidemark.llm.vectors import matrix, whole_vectors

#: Anchors of a block, rows of a slab, rows that one task meets at most, planes that cut the anchors into neighbourhoods (2**12 at most).
BLOCK, SLAB, GROUP_ROWS, PLANES = 1024, 4096, 1 << 23, 12
_EXACT = float(1 << 53)


def spanning_tree(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of a minimum spanning tree over the rows of x: (nodes, places of their parents in the level above, edge lengths). The first
    level is the root, the row nearest to all others."""
    n, square = len(x), np.einsum("ij,ij->i", x, x)
    gap = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * (x @ x.T), 0))
    root = int(gap.sum(0).argmin())
    near, parent, out = gap[root].copy(), np.full(n, root), np.zeros(n, bool)
    depth = np.zeros(n, np.int64)
    out[root] = True
    for _ in range(n - 1):
        node = int(np.where(out, np.inf, near).argmin())
        out[node], depth[node] = True, depth[parent[node]] + 1
        closer = gap[node] < near
        near[closer & ~out], parent[closer & ~out] = gap[node][closer & ~out], node
    place, levels = np.zeros(n, np.int64), []
    for d in range(int(depth.max()) + 1):
        nodes = np.flatnonzero(depth == d)
        place[nodes] = np.arange(len(nodes))
        # lengths are taken anew from the difference: the product form above loses digits for near vectors
        levels.append((nodes, place[parent[nodes]], np.sqrt(((x[nodes] - x[parent[nodes]]) ** 2).sum(1))))
    return levels


class Search:
    """The state of one block: its anchors, their tree, what each looks for and the best rows so far."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, same: bool, most: int, windows: list[list[tuple[int, int]]] | None = None) -> None:
        """windows: per anchor, inclusive score windows; each keeps its `most` best rows. None: one open window each. same: rows of the
        anchor's label are looked for, else rows of other labels."""
        self.ids, self.labels, self.x, self.same, self.most = ids, labels, x, same, most
        self.levels = spanning_tree(x.astype(np.float64)) if len(x) else []
        self.windows = windows or [[(-(1 << 63), (1 << 63) - 1)] for _ in ids]
        self.found: list[list[list[tuple[int, int]]]] = [[[] for _ in w] for w in self.windows]  # per anchor and window: (-score, id)
        self.low = np.array([min((float(a) for a, b in w if a <= b), default=np.inf) for w in self.windows])
        self.high = np.array([max((float(b) for a, b in w if a <= b), default=-np.inf) for w in self.windows])
        self.pairs = self.scored = 0

    def _scores(self, nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
        a = self.x[nodes]
        largest = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, a.shape[1])
        if largest < _EXACT:
            return a.astype(np.float64) @ x.astype(np.float64).T
        exact = a.astype(object) @ x.astype(object).T
        if max(abs(int(v)) for v in exact.ravel()) >= 1 << 53:
            raise ValueError("a score needs more than 53 bits")
        return exact.astype(np.float64)

    def meet(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        """Takes a slab of rows."""
        wide = x.astype(np.float64)
        norms = np.sqrt(np.einsum("ij,ij->i", wide, wide))
        above_low = above_high = np.zeros((0, len(ids)))
        for depth, (nodes, parents, edges) in enumerate(self.levels):
            wanted = (self.labels[nodes][:, None] == labels[None, :]) == self.same
            wanted &= self.ids[nodes][:, None] != ids[None, :]
            if depth == 0:
                low = high = self._scores(nodes, x)
                self.scored += low.size
            else:
                reach = edges[:, None] * norms[None, :] * (1 + 1e-9) + 1.0  # the slack covers rounding
                low, high = above_low[parents] - reach, above_high[parents] + reach
                wanted &= (high >= self.low[nodes][:, None]) & (low <= self.high[nodes][:, None])
                hits = int(wanted.sum())
                if 8 * hits > wanted.size:  # one product for all is cheaper than gathering many
                    low = high = self._scores(nodes, x)
                    self.scored += low.size
                elif hits:
                    row, col = np.nonzero(wanted)
                    for node in np.unique(row):
                        own = col[row == node]
                        low[node, own] = high[node, own] = self._scores(nodes[node : node + 1], x[own])[0]
                    self.scored += hits
            self.pairs += low.size
            for k, node in enumerate(nodes):
                at = np.flatnonzero(wanted[k] & (low[k] >= self.low[node]) & (low[k] <= self.high[node]))
                if len(at):
                    self._keep(int(node), low[k][at], ids[at])
            above_low, above_high = low, high

    def _keep(self, node: int, scores: np.ndarray, ids: np.ndarray) -> None:
        lows = []
        for j, (low, high) in enumerate(self.windows[node]):
            if low > high:
                continue
            own = self.found[node][j]
            least = -own[-1][0] if len(own) == self.most else low
            at = np.flatnonzero((scores >= least) & (scores <= high))
            if len(at):
                if len(at) > self.most:
                    at = at[scores[at] >= np.partition(scores[at], len(at) - self.most)[len(at) - self.most]]
                at = at[np.lexsort((ids[at], -scores[at]))[: self.most]]
                own = sorted(own + [(-int(s), int(i)) for s, i in zip(scores[at], ids[at])])[: self.most]
                self.found[node][j] = own
            lows.append(float(-own[-1][0] if len(own) == self.most else low))
        self.low[node] = min(lows)

    def results(self) -> list[tuple[int, int, int, int]]:
        """(place of the anchor, place of the window, id, score) of all rows kept."""
        return [(a, j, i, -s) for a, each in enumerate(self.found) for j, own in enumerate(each) for s, i in own]


def _packed(width: int, groups: int, slab: int):
    """Packs rows into slabs (one row each): a group number, ids, labels and vectors as bytes."""

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, slab):
                part = batch.slice(at, slab)
                group = (task * 1_000_003 + number) % groups
                number += 1
                x = matrix(part["x"], width, np.int64)
                body = [np.asarray(part[c].to_numpy(zero_copy_only=False), "<i8").tobytes() for c in ("id", "label")]
                yield pa.RecordBatch.from_pydict({"group": pa.array([group], pa.int32()), "ids": [body[0]], "labels": [body[1]], "x": [x.astype("<i8").tobytes()]})

    return pack


def _cells(width: int, planes: int):
    """Adds to each anchor the cell of space it lies in: the signs of its products with fixed random directions."""

    def cut(batches):
        import pyarrow as pa

        sides = np.random.default_rng(12).standard_normal((width, planes))
        for batch in batches:
            bits = matrix(batch["x"], width, np.float64) @ sides > 0
            cell = bits @ (1 << np.arange(planes)) if planes else np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], batch["x"], pa.array(cell.astype(np.int32))], names=["id", "label", "x", "cell"])

    return cut


def _block(width: int):
    def pack(key, table):
        import pyarrow as pa

        table = table.sort_by([("id", "ascending"), ("label", "ascending")])
        body = [np.asarray(table[c].to_numpy(), "<i8").tobytes() for c in ("id", "label")]
        x = matrix(table["x"].combine_chunks(), width, np.int64)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "ids": [body[0]], "labels": [body[1]], "x": [x.astype("<i8").tobytes()]})

    return pack


def _searched(width: int, same: bool, most: int):
    """Streams sorted rows: a block's anchors, then its slabs; yields the best rows of each (block, group)."""

    def run(batches):
        import pyarrow as pa

        def results(search, block):
            rows = search.results()
            cols = list(zip(*rows)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays(
                [pa.array([block] * len(rows), pa.int64()), pa.array(search.ids[list(cols[0])] if rows else [], pa.int64()), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64())))],
                names=["block", "anchor_id", "place", "window", "row_id", "score"],
            )

        search, held = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch[c][k] for c in ("block", "group", "is_slab", "ids", "labels", "x")}
                at = (row["block"].as_py(), row["group"].as_py())
                ids, labels, x = (np.frombuffer(row[c].as_buffer(), "<i8") for c in ("ids", "labels", "x"))
                x = x.reshape(len(ids), width)
                if not row["is_slab"].as_py():
                    if search is not None:
                        yield results(search, held[0])
                    windows = None
                    if not same:
                        windows = [[] for _ in ids]
                        for w in batch["windows"][k].as_py() or []:
                            windows[w["place"]] = [tuple(x) for x in zip(w["low"], w["high"])]
                    search, held = Search(ids, labels, x, same, most, windows), at
                elif held == at:
                    search.meet(ids, labels, x)
        if search is not None:
            yield results(search, held[0])

    return run


_FOUND = "block long, anchor_id long, place int, window int, row_id long, score long"
_WINDOWS = "array<struct<place int, low array<long>, high array<long>>>"


def _search(slabs: DataFrame, blocks: DataFrame, n_blocks: int, groups: int, width: int, same: bool, most: int) -> DataFrame:
    """The `most` best rows of each anchor and window: block, anchor_id, place, best (array of (score, row_id), best first)."""
    anchors = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("is_slab", F.lit(False))
    if "windows" not in anchors.columns:
        anchors = anchors.withColumn("windows", F.lit(None).cast(_WINDOWS))
    rows = slabs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))).withColumn("is_slab", F.lit(True))
    rows = rows.withColumn("windows", F.lit(None).cast(_WINDOWS))
    names = ["block", "group", "is_slab", "ids", "labels", "x", "windows"]
    tasks = min(n_blocks * groups, 20_000)
    dealt = anchors.select(names).unionByName(rows.select(names)).repartition(tasks, "block", "group").sortWithinPartitions("block", "group", "is_slab")
    found = dealt.mapInArrow(_searched(width, same, most), _FOUND)
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "row_id")))  # `most` rows of each group of slabs
    return found.groupBy("block", "anchor_id", "place", "window").agg(F.slice(best, 1, most).alias("best"))


def mine(df: DataFrame, key: str, vector: str, label: str, is_anchor: Column, scale: float = 256.0, positives: int = 5, negatives: int = 3, shares: tuple[int, int] = (50, 95), block: int = BLOCK, slab: int = SLAB) -> DataFrame:
    """Hard negatives of the anchors; key and label are whole numbers. Each component c becomes the whole number floor(scale * c), and a row's
    score is its inner product with the anchor; higher scores come first, ties by smaller key. An anchor's positives are its first other rows of the same label; for
    each, the first rows of other labels whose score lies between the two shares (per cent) of the positive's score. Returns anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null key, label or vector, a null or non-finite component, or a vector of another width than most, take no part. Rows that repeat key, label and vector
    count once; rows of an anchor's own key are never found for it. An empty table, or one without anchors, gives no rows. Other columns
    do not matter, whatever they are called. Scores of more than 53 bits are an error. block, slab: sizes of what one task holds; the result
    does not depend on them."""
    whole, width = whole_vectors(df, vector)
    rows = whole.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda c: F.floor(c * scale)).alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    rows = materialise(rows.where(F.col("id").isNotNull() & F.col("label").isNotNull()).dropDuplicates(["id", "label", "x"]), "mined-rows")
    n_rows, n_anchors = (int(v or 0) for v in rows.agg(F.count("*"), F.sum(F.col("is_anchor").cast("long"))).first())
    planes = min(PLANES, max(0, round(np.log2(max(1, n_anchors) / block))))

    anchors = rows.where("is_anchor").select("id", "label", "x").mapInArrow(_cells(width, planes), "id long, label long, x array<long>, cell int")
    cells = anchors.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("long").alias("parts"))  # at most 2**PLANES rows
    cells = cells.withColumn("first", F.sum("parts").over(W.orderBy("cell")) - F.col("parts"))
    number = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block")
    blocks = anchors.join(F.broadcast(cells), "cell").select("id", "label", "x", number)
    blocks = materialise(blocks.groupBy("block").applyInArrow(_block(width), "block long, ids binary, labels binary, x binary"), "mined-blocks")
    n_blocks = int(blocks.agg(F.max("block")).first()[0] or 0) + 1

    spark = df.sparkSession
    groups = max(1, -(-2 * spark.sparkContext.defaultParallelism // n_blocks), -(-n_rows // GROUP_ROWS))
    slabs = materialise(rows.select("id", "label", "x").mapInArrow(_packed(width, groups, slab), "group int, ids binary, labels binary, x binary"), "mined-slabs")

    first = _search(slabs, blocks, n_blocks, groups, width, True, positives).select("block", "anchor_id", "place", F.posexplode("best").alias("nth", "hit"))
    first = materialise(first.select("block", "anchor_id", "place", "nth", F.col("hit.row_id").alias("positive_id"), (-F.col("hit.minus")).alias("positive_score")), "mined-positives")
    # 100 * score between the shares: as whole numbers, up from the lower and down from the upper bound
    low, high = F.expr(f"-((-positive_score * {shares[0]} - pmod(-positive_score * {shares[0]}, 100)) div 100)"), F.expr(f"(positive_score * {shares[1]} - pmod(positive_score * {shares[1]}, 100)) div 100")
    each = first.groupBy("block", "place").agg(F.array_sort(F.collect_list(F.struct("nth", low.alias("low"), high.alias("high")))).alias("w"))
    windows = each.groupBy("block").agg(F.collect_list(F.struct("place", F.col("w.low").alias("low"), F.col("w.high").alias("high"))).alias("windows"))
    second = _search(slabs, blocks.join(windows, "block"), n_blocks, groups, width, False, negatives)
    second = second.select("block", "place", F.col("window").alias("nth"), F.posexplode("best").alias("at", "hit"))
    out = second.join(first, ["block", "place", "nth"]).select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("hit.row_id").alias("negative_id"), "positive_score", (-F.col("hit.minus")).alias("negative_score"))
    out = materialise(out, "mined")
    release(rows, blocks, slabs, first)
    return out
