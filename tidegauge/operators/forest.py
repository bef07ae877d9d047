"""Forests of many nodes, grown without the driver: rows are binned once and every node is grown where its rows are.

MLlib keeps all nodes of a forest in the driver while it grows, with the statistics of every node and its children, and adds
up dense statistics of all nodes of a level in every task. Here

1. rows are written as blocks of bin numbers, one byte for each feature;
2. nodes with more than ``LOCAL_ROWS`` rows are split by histograms that tasks add up, a level at a time;
3. the rows of every other node meet in one task, which grows all that is below it;
4. the nodes of each tree are pruned, numbered and written in the form in which MLlib saves a forest.

The rules are MLlib's: at most 32 bins, Poisson resampling, a new choice of features for every node, Gini impurity with
class weights, and leaves of one parent with equal predictions become one. Random choices are hashes or streams of (seed,
tree, block or node), so a task that runs again does the same.
"""

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.plans.spread import settle, shared_folder

BINS = 32
#: A node of more rows than this is split by histograms; one of fewer is grown in a single task.
LOCAL_ROWS = 1 << 19
#: Entries of the histograms that a task works on at a time, and of those that a pass over the rows adds up.
PART, PASS = 1 << 22, 1 << 22
#: Nodes that are sent to the driver at a time.
SENT = 1 << 18
#: Bytes of resampled rows that trees may move at a time.
MOVED = 1 << 30

NODES = "tree int, node long, feature int, bin int, gain double, impurity double, rows long, stats array<double>"
_PLACED = ("treeID int, id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, "
           "leftChild int, rightChild int, feature int, bin int")
_HISTOGRAM = "tree int, node long, counts binary"


def candidates(rows: DataFrame, features: int) -> list:
    """Thresholds of every feature of the array column ``x``: between all values where they are few, else at quantiles."""

    def few(batches):
        held = [np.empty(0)] * features
        for batch in batches:
            x = _matrix(batch.column("x"), features)
            held = [None if h is None or len(u := np.union1d(h, x[:, i])) > BINS else u for i, h in enumerate(held)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(features), pa.int32()), pa.array([None if h is None else h.tolist() for h in held], pa.list_(pa.float64()))],
            names=["feature", "found"])

    found = [np.empty(0)] * features
    for r in rows.select("x").mapInArrow(few, "feature int, found array<double>").collect():
        h = found[r.feature]
        found[r.feature] = None if h is None or r.found is None or len(u := np.union1d(h, r.found)) > BINS else u
    many = [i for i, h in enumerate(found) if h is None]
    shares = [i / BINS for i in range(1, BINS)]
    cuts = rows.agg(*[F.percentile_approx(F.get("x", F.lit(i)), shares, 10_000).alias(f"q{i}") for i in many]).first() if many else {}
    return [np.unique(cuts[f"q{i}"]) if h is None else (h[1:] + h[:-1]) / 2 for i, h in enumerate(found)]


def _matrix(column, width):
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _packed(rows: DataFrame, thresholds) -> DataFrame:
    """(id, n, data): blocks of rows, a byte for the bin of each feature and one for the class; written."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), len(thresholds))
            out = np.empty((len(x), len(thresholds) + 1), np.uint8)
            for i, cuts in enumerate(thresholds):
                out[:, i] = np.searchsorted(cuts, x[:, i], side="left")
            out[:, -1] = batch.column("code").to_numpy()
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([out.tobytes()], pa.binary())], names=["n", "data"])

    return settle(rows.select("x", "code").mapInArrow(run, "n long, data binary").select(F.monotonically_increasing_id().alias("id"), "n", "data"))


def _mix(x):
    """Finalizer of splitmix64 on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Grower:
    """What tasks need to know to grow trees."""

    def __init__(self, features, weights, cfg):
        self.features, self.weights, self.classes = features, np.asarray(weights, float), len(weights)
        self.tried = max(1, int(np.ceil(np.sqrt(features)))) if cfg.num_trees > 1 else features
        self.seed, self.max_depth, self.min_leaf, self.trees = cfg.seed, cfg.max_depth, cfg.min_leaf, cfg.num_trees

    def drawn(self, tree, block, n):
        """How often each row of a block is in the tree's sample."""
        if self.trees == 1:
            return np.ones(n, np.uint8)
        return np.random.default_rng([self.seed & 0xFFFFFFFF, tree, block]).poisson(1.0, n).astype(np.uint8)

    def subsets(self, tree, nodes):
        """The features that each node may split on, as an array of a row per node."""
        with np.errstate(over="ignore"):
            start = _mix(np.array([self.seed & 0xFFFFFFFF], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(tree))
            h = _mix(_mix(nodes.astype(np.uint64) + start)[:, None] + np.arange(1, self.features + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return np.sort(np.argsort(h, axis=1, kind="stable")[:, :self.tried], axis=1)

    def histograms(self, x, y, c, at, subsets):
        """Rows in the sample per node, tried feature, bin and class."""
        nodes = len(subsets)
        shape, out = (nodes, BINS, self.classes), np.empty((nodes, self.tried, BINS, self.classes))
        flat, base, y = x.reshape(-1), np.arange(len(x)) * x.shape[1], y.astype(np.int64)
        for j in range(self.tried):
            key = (at * BINS + flat[base + subsets[at, j]]) * self.classes + y
            out[:, j] = np.bincount(key, c, nodes * BINS * self.classes).reshape(shape)
        return out

    def impurity(self, counts):
        """Gini impurity and weight of class counts (last axis)."""
        w = counts * self.weights
        total = w.sum(axis=-1)
        share = np.divide(w, total[..., None], out=np.zeros_like(w), where=total[..., None] > 0)
        return 1.0 - (share * share).sum(axis=-1), total

    def splits(self, counts, subsets):
        """Best (feature, bin, gain, class counts to the left) of every node; the feature is -1 where none is of use."""
        left = np.cumsum(counts, axis=2)[:, :, :-1]
        whole = counts[:, 0].sum(axis=1)
        right = whole[:, None, None] - left
        own, total = self.impurity(whole)
        il, wl = self.impurity(left)
        ir, wr = self.impurity(right)
        both = np.where(total > 0, total, 1.0)[:, None, None]
        gain = own[:, None, None] - wl / both * il - wr / both * ir
        gain[(left.sum(axis=-1) < self.min_leaf) | (right.sum(axis=-1) < self.min_leaf)] = -1.0
        best = gain.reshape(len(gain), -1).argmax(axis=1)
        j, b = np.divmod(best, BINS - 1)
        n = np.arange(len(gain))
        gain = gain[n, j, b]
        return np.where(gain > 0, subsets[n, j], -1), b, gain, left[n, j, b]

    def open(self, nodes, counts):
        """Nodes that may be split: not at the greatest depth and not of one class."""
        return (np.frexp(nodes.astype(float))[1] - 1 < self.max_depth) & (np.abs(self.impurity(counts)[0]) >= 1e-16)

    def table(self, tree, nodes, feature, bins, gain, counts):
        """Rows of NODES."""
        impurity, _ = self.impurity(counts)
        stats, n = counts * self.weights, len(nodes)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.classes), pa.array(stats.reshape(-1)))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, tree, np.int32)), pa.array(nodes.astype(np.int64)), pa.array(feature.astype(np.int32)), pa.array(bins.astype(np.int32)),
             pa.array(gain.astype(float)), pa.array(impurity), pa.array(counts.sum(axis=-1).astype(np.int64)), lists],
            names=["tree", "node", "feature", "bin", "gain", "impurity", "rows", "stats"])

    def grow(self, tree, root, x, y, c):
        """All nodes from ``root`` down, a batch for each level or part of it."""
        nodes, at = np.array([root], np.int64), np.zeros(len(x), np.int64)
        counts = np.bincount(y, c, self.classes)[None, :]
        part = max(1, PART // (self.tried * BINS * self.classes))
        while len(nodes):
            feature, bins, gain = np.full(len(nodes), -1), np.zeros(len(nodes), np.int64), np.full(len(nodes), -1.0)
            lefts, live = np.zeros_like(counts), np.flatnonzero(self.open(nodes, counts))
            place = np.full(len(nodes), -1)
            place[live] = np.arange(len(live))
            mine = place[at]
            for lo in range(0, len(live), part):
                some = live[lo:lo + part]
                rows = np.flatnonzero((mine >= lo) & (mine < lo + part))
                subsets = self.subsets(tree, nodes[some])
                found = self.histograms(x[rows], y[rows], c[rows], mine[rows] - lo, subsets)
                feature[some], bins[some], gain[some], lefts[some] = self.splits(found, subsets)
            yield self.table(tree, nodes, feature, bins, np.where(feature < 0, -1.0, gain), counts)
            split = np.flatnonzero(feature >= 0)
            place[:] = -1
            place[split] = np.arange(len(split))
            kept = np.flatnonzero(place[at] >= 0)
            x, y, c, at = x[kept], y[kept], c[kept], at[kept]
            right = x[np.arange(len(x)), feature[at]] > bins[at]
            at = 2 * place[at] + right
            nodes = np.column_stack([2 * nodes[split], 2 * nodes[split] + 1]).reshape(-1)
            counts = np.stack([lefts[split], counts[split] - lefts[split]], axis=1).reshape(-1, self.classes)


def _reached(x, known):
    """The node of every row: down the splits (node -> (feature, bin)) that are known."""
    at = np.ones(len(x), np.int64)
    if known:
        nodes = np.array(sorted(known))
        split = np.array([known[n] for n in nodes.tolist()])
        while True:
            i = np.minimum(np.searchsorted(nodes, at), len(nodes) - 1)
            on = np.flatnonzero(nodes[i] == at)
            if not len(on):
                break
            f, b = split[i[on]].T
            at[on] = 2 * at[on] + (x[on, f] > b)
    return at


def _blocks(batches, width):
    for batch in batches:
        for i, n, data in zip(batch.column("id").to_pylist(), batch.column("n").to_pylist(), batch.column("data")):
            yield i, np.frombuffer(data.as_buffer(), np.uint8).reshape(n, width)


def _split_large(packed, grower, known, large):
    """Splits of the ``large`` nodes (pairs of tree and node), from histograms of all rows; a row of NODES and the left counts each."""
    by_tree = {}
    for tree, node in large:
        by_tree.setdefault(tree, []).append(node)
    shape = (grower.tried, BINS, grower.classes)

    def count(batches):
        sums = {}
        for block, rows in _blocks(batches, grower.features + 1):
            x, y = rows[:, :-1], rows[:, -1]
            for tree, wanted in by_tree.items():
                nodes = np.array(sorted(wanted), np.int64)
                at, c = _reached(x, known.get(tree)), grower.drawn(tree, block, len(x))
                place = np.minimum(np.searchsorted(nodes, at), len(nodes) - 1)
                on = np.flatnonzero((nodes[place] == at) & (c > 0))
                found = grower.histograms(x[on], y[on], c[on], place[on], grower.subsets(tree, nodes))
                sums[tree] = sums[tree] + found if tree in sums else found
        for tree, found in sums.items():
            nodes = sorted(by_tree[tree])
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree] * len(nodes), pa.int32()), pa.array(nodes, pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())],
                names=["tree", "node", "counts"])

    def best(table):
        counts = sum(np.frombuffer(v.as_buffer(), float).reshape(shape) for v in table.column("counts"))[None]
        tree, nodes = table.column("tree")[0].as_py(), np.array([table.column("node")[0].as_py()])
        whole = counts[:, 0].sum(axis=1)
        subsets = grower.subsets(tree, nodes)
        feature, b, gain, left = grower.splits(counts, subsets)
        feature = np.where(grower.open(nodes, whole), feature, -1)
        made = grower.table(tree, nodes, feature, b, np.where(feature < 0, -1.0, gain), whole)
        return pa.Table.from_batches([made]).append_column("left", pa.array([left[0].tolist()], pa.list_(pa.float64())))

    return (packed.mapInArrow(count, _HISTOGRAM).groupBy("tree", "node").applyInArrow(best, f"{NODES}, left array<double>")).collect()


def _top(packed, grower, trees, n):
    """Nodes of more rows than a task takes, the splits among them, and the roots of what tasks grow."""
    made, known, jobs = [], {}, []
    large = [(t, 1) for t in trees] if n > LOCAL_ROWS else []
    jobs += [] if large else [(t, 1) for t in trees]
    a_pass = max(1, PASS // (grower.tried * BINS * grower.classes))
    while large:
        rows = [r for i in range(0, len(large), a_pass) for r in _split_large(packed, grower, known, large[i:i + a_pass])]
        large = []
        for r in rows:
            made.append(tuple(r)[:-1])
            if r.feature < 0:
                continue
            known.setdefault(r.tree, {})[r.node] = (r.feature, r.bin)
            for side, size in ((0, sum(r.left)), (1, r.rows - sum(r.left))):
                (large if size > LOCAL_ROWS else jobs).append((r.tree, 2 * r.node + side))
    return made, known, jobs


def _grow_trees(packed: DataFrame, grower: Grower, trees, n) -> DataFrame:
    """The nodes of some trees, as rows of NODES."""
    spark = packed.sparkSession
    made, known, jobs = _top(packed, grower, trees, n)
    roots = {}
    for tree, node in jobs:
        roots.setdefault(tree, set()).add(node)
    shared = spark.sparkContext.broadcast((grower, known, {t: np.array(sorted(r), np.int64) for t, r in roots.items()}))

    def deal(batches):
        grower, known, roots = shared.value
        for block, rows in _blocks(batches, grower.features + 1):
            trees, nodes, data = [], [], []
            for tree, wanted in roots.items():
                c = grower.drawn(tree, block, len(rows))
                on = np.flatnonzero(c)
                at = _reached(rows[on, :-1], known.get(tree))
                full = np.column_stack([rows[on], c[on]])
                for node in wanted.tolist() if tree in known else [1]:
                    some = full[at == node] if tree in known else full
                    if len(some):
                        trees.append(tree)
                        nodes.append(node)
                        data.append(some.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(trees, pa.int32()), pa.array(nodes, pa.int64()), pa.array(data, pa.binary())], names=["tree", "node", "data"])

    def below(table):
        grower = shared.value[0]
        rows = np.concatenate([np.frombuffer(v.as_buffer(), np.uint8) for v in table.column("data")]).reshape(-1, grower.features + 2)
        found = grower.grow(table.column("tree")[0].as_py(), table.column("node")[0].as_py(), rows[:, :-2], rows[:, -2], rows[:, -1])
        return pa.Table.from_batches(list(found))

    # As many partitions as roots: a root's rows are all that a task holds at a time.
    dealt = packed.mapInArrow(deal, "tree int, node long, data binary").repartition(max(1, len(jobs)), "tree", "node")
    out = dealt.groupBy("tree", "node").applyInArrow(below, NODES)
    return out.unionByName(spark.createDataFrame(made, NODES)) if made else out


def placed(table: pa.Table) -> pa.Table:
    """The nodes of one tree, pruned and numbered as MLlib saves them: parents first, left before right."""
    table = table.sort_by("node")
    heap, feature = table.column("node").to_numpy(), table.column("feature").to_numpy().copy()
    stats = table.column("stats").combine_chunks()
    guess = _matrix(stats, len(stats[0])).argmax(axis=1)
    levels = np.frexp(heap.astype(float))[1] - 1
    by_level = [np.flatnonzero(levels == d) for d in range(levels.max() + 1)]
    left, right = np.searchsorted(heap, 2 * heap), np.searchsorted(heap, 2 * heap + 1)
    size, kept = np.ones(len(heap), np.int64), np.zeros(len(heap), bool)
    for here in reversed(by_level):
        inner = here[feature[here] >= 0]
        a, b = left[inner], right[inner]
        feature[inner[(feature[a] < 0) & (feature[b] < 0) & (guess[a] == guess[b])]] = -1
        inner = here[feature[here] >= 0]
        size[inner] += size[left[inner]] + size[right[inner]]
    number = np.zeros(len(heap), np.int64)
    kept[0] = True
    for here in by_level:
        inner = here[(feature[here] >= 0) & kept[here]]
        kept[left[inner]] = kept[right[inner]] = True
        number[left[inner]] = number[inner] + 1
        number[right[inner]] = number[inner] + 1 + size[left[inner]]
    on = np.flatnonzero(kept)
    inner = feature[on] >= 0
    child = [np.where(inner, number[np.where(inner, side[on], 0)], -1).astype(np.int32) for side in (left, right)]
    get = {c: table.column(c).take(pa.array(on)) for c in ("tree", "impurity", "stats", "rows", "bin")}
    gain = np.where(inner, table.column("gain").to_numpy()[on], -1.0)
    return pa.table({
        "treeID": get["tree"], "id": pa.array(number[on].astype(np.int32)), "prediction": pa.array(guess[on].astype(float)),
        "impurity": get["impurity"], "impurityStats": get["stats"], "rawCount": get["rows"], "gain": pa.array(gain),
        "leftChild": pa.array(child[0]), "rightChild": pa.array(child[1]), "feature": pa.array(feature[on].astype(np.int32)), "bin": get["bin"]})


def _node_data(nodes: DataFrame, thresholds, form) -> DataFrame:
    """``placed`` nodes in the columns of a saved model."""
    cuts = F.array(*[F.lit([float(v) for v in t]).cast("array<double>") for t in thresholds])
    inner = F.col("feature") >= 0
    at = F.when(inner, F.array(F.get(F.get(cuts, F.col("feature")), F.col("bin")))).otherwise(F.array().cast("array<double>"))
    split = F.struct(F.col("feature").alias("featureIndex"), at.alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    data = F.struct("id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", split.alias("split"))
    return nodes.select(F.col("treeID").cast(form["treeID"].dataType), data.cast(form["nodeData"].dataType).alias("nodeData"))


def sliced(nodes: DataFrame):
    """The nodes of some trees after the other, in the order of ``tree``, and how many each has: the driver gets at most so many at a time."""
    part = []
    for r in [*nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).orderBy("tree").collect(), None]:
        if part and (r is None or sum(n for _, n in part) + r.n > SENT):
            yield nodes.filter(F.col("tree").between(part[0][0], part[-1][0])), [n for _, n in part]
            part = []
        part.append(r and (r.tree, r.n))


class _Writer(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path):
        spark = SparkSession.active()
        _write_text(spark, json.dumps(self.model.meta), f"{path}/metadata")
        for part in ("data", "treesMetadata"):
            spark.read.parquet(f"{self.model.path}/{part}").write.parquet(f"{path}/{part}")


class _Reader(MLReader):
    def load(self, path):
        return GrownForestModel(path)


def _write_text(spark, text, path):
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


class GrownForestModel(Model, MLReadable, MLWritable):
    """A forest that lies in a folder, in MLlib's form, and is applied from arrays of its nodes.

    MLlib's own model is sent to tasks as objects, several times the size of the arrays, which the driver holds more than once.
    """

    def __init__(self, path):
        super().__init__()
        self.path = path
        self.meta = json.loads(SparkSession.active().read.text(f"{path}/metadata").first().value)
        self._resetUid(self.meta["uid"])
        self.numFeatures, self.numClasses, self.getNumTrees = (self.meta[k] for k in ("numFeatures", "numClasses", "numTrees"))

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader()

    def _nodes(self):
        n = F.col("nodeData")
        return SparkSession.active().read.parquet(f"{self.path}/data").select(
            F.col("treeID").alias("tree"), n["id"].alias("node"), n["split"]["featureIndex"].alias("feature"),
            F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"), n["rightChild"].alias("right"),
            n["impurityStats"].alias("stats"), n["gain"].alias("gain"))

    def _arrays(self):
        """(starts of the trees, feature, threshold, right child, share of each class) of all nodes, a tree after the other."""
        sizes, parts = [], []
        for nodes, per_tree in sliced(self._nodes().select("tree", "node", F.col("feature").cast("short").alias("feature"), "threshold", "right", "stats")):
            t = nodes.toArrow()
            order = np.lexsort([t.column(c).to_numpy() for c in ("node", "tree")])
            stats = _matrix(t.column("stats").combine_chunks(), self.numClasses)[order]
            total = stats.sum(axis=1, keepdims=True)
            parts.append([*(t.column(c).to_numpy()[order] for c in ("feature", "threshold", "right")),
                          np.divide(stats, total, out=np.zeros_like(stats), where=total > 0)])
            sizes += per_tree
        return np.cumsum([0, *sizes]), *[np.concatenate(p) for p in zip(*parts)]

    @property
    def totalNumNodes(self):
        return self._nodes().count()

    @property
    def featureImportances(self):
        """Gains of the nodes weighted by their rows; trees count alike."""
        size = F.aggregate("stats", F.lit(0.0), lambda a, x: a + x)
        per = np.zeros((self.getNumTrees, self.numFeatures))
        for r in self._nodes().filter("feature >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * size).alias("g")).collect():
            per[r.tree, r.feature] = r.g
        whole = per.sum(axis=1, keepdims=True)
        out = np.divide(per, whole, out=np.zeros_like(per), where=whole != 0).sum(axis=0)
        return Vectors.dense(out / out.sum() if out.sum() else out)

    def _transform(self, df):
        sent, width = SparkSession.active().sparkContext.broadcast(self._arrays()), self.numFeatures

        @F.arrow_udf("array<double>")
        def votes(column: pa.Array) -> pa.Array:
            starts, feature, threshold, right, values = sent.value
            x = _matrix(column, width)
            out = np.zeros((len(x), values.shape[1]))
            for a, b in zip(starts[:-1], starts[1:]):
                out += values[a:b][_leaf(x, feature[a:b], threshold[a:b], right[a:b])]
            return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * out.shape[1], pa.array(out.reshape(-1)))

        names = {k: self.meta["paramMap"].get(f"{k}Col", v) for k, v in _COLUMNS.items()}
        kept = [F.col(f"`{c}`") for c in df.columns]
        raw = df.select(*kept, votes(vector_to_array(names["features"])).alias("__votes"))
        total = F.aggregate("__votes", F.lit(0.0), lambda a, v: a + v)
        shares = raw.select(*kept, "__votes", F.transform("__votes", lambda v: F.when(total != 0, v / total).otherwise(v)).alias("__shares"))
        best = (F.array_position("__shares", F.array_max("__shares")) - 1).cast("double")
        return shares.select(*kept, array_to_vector("__votes").alias(names["rawPrediction"]), array_to_vector("__shares").alias(names["probability"]),
                             best.alias(names["prediction"]))


_COLUMNS = {"features": "features", "rawPrediction": "rawPrediction", "probability": "probability", "prediction": "prediction"}


def _leaf(x, feature, threshold, right):
    """The leaf of every row in one tree; the left child of a node is the one after it."""
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    f = feature[at]
    while True:
        inner = f >= 0
        if not inner.all():
            rows, f = rows[inner], f[inner]
        if not len(rows):
            return at
        here = at[rows]
        here = np.where(x[rows, f] <= threshold[here], here + 1, right[here])
        at[rows], f = here, feature[here]


def fit_forest(classifier, scaled: DataFrame, weights, n: int, cfg) -> GrownForestModel:
    """A forest of ``classifier`` for the rows of ``scaled`` (its vector column and ``code``), ``weights`` by class, of ``n`` rows."""
    spark = scaled.sparkSession
    x = classifier.getFeaturesCol()
    features = len(scaled.select(x).first()[0])
    rows = scaled.select(vector_to_array(x).alias("x"), F.col("code"))
    thresholds = candidates(rows, features)
    packed = _packed(rows, thresholds)
    grower = Grower(features, weights, cfg)
    folder = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
    # MLlib's forest of a single leaf gives the form of the files.
    few = spark.createDataFrame([(Vectors.dense([0.0] * features), float(k), 1.0) for k in range(len(weights))], [x, "code", "weight"])
    classifier.copy({classifier.maxDepth: 0, classifier.numTrees: 1}).fit(few).save(f"{folder}/form")
    meta = json.loads(spark.read.text(f"{folder}/form/metadata").first().value)
    meta["paramMap"] |= {"maxDepth": cfg.max_depth, "numTrees": cfg.num_trees}
    _write_text(spark, json.dumps(meta | {"class": f"{__name__}.{GrownForestModel.__name__}", "numTrees": cfg.num_trees}), f"{folder}/model/metadata")
    trees = spark.read.parquet(f"{folder}/form/treesMetadata")
    ids = spark.range(cfg.num_trees).select(F.col("id").cast(trees.schema[0].dataType).alias(trees.columns[0]))
    ids.crossJoin(trees.drop(trees.columns[0])).select(*trees.columns).coalesce(1).write.parquet(f"{folder}/model/treesMetadata")
    form = spark.read.parquet(f"{folder}/form/data").schema
    step = max(1, int(MOVED // max(1, n * (features + 2))))
    for first in range(0, cfg.num_trees, step):
        grown = _grow_trees(packed, grower, range(first, min(first + step, cfg.num_trees)), n)
        nodes = grown.groupBy("tree").applyInArrow(placed, _PLACED)
        _node_data(nodes, thresholds, form).write.mode("append").parquet(f"{folder}/model/data")
    return GrownForestModel(f"{folder}/model")
