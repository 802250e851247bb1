"""Embedding near-duplicates by a forest of random-projection trees.

A tree splits vectors recursively at the median of a random projection; those within SPILL of a split go
to both sides, so near vectors seldom part, and what parts in one tree meets in another. Vectors that
share a leaf are compared exactly, in double precision.

Trees are fitted on a bounded sample. Where that is too small for leaves of a fixed size, a fitted leaf is split
further, by as many levels as the number of all vectors asks for, at its sample's medians: leaves stay small.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import cut, drop_cut, spread_join, table
from lexispark.llm.graph import connected_components, local_forest

COSINE = 0.95
TREES, SPILL = 8, 0.02
#: Trees are fitted on so many different vectors at most, those with the smallest hashes. Every vector is indexed.
FIT = 20_000
#: Vectors a leaf is meant to hold, and vectors of the sample that a fitted leaf holds at least.
LEAF, LEAST = 1000, 16
#: Of so many pairs of a leaf, one near: then near pairs are looked at one by one, else all together.
SPARSE = 100
#: Large leaves whose number of tiles is broadcast at most; more are joined.
MOST_BROADCAST = 10_000
#: Larger leaves, as of a tight cluster, are compared tile by tile, all pairs of tiles: none is left out.
TILE = 4096


@dataclass
class Tree:
    """Node k splits by directions[k] at thresholds[k] into the nodes children[k]; a negative child -1 - l is leaf l. Leaf l
    is split again by the directions deeper, at the thresholds further[l]: a side of each is a bit of its final number."""

    directions: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray
    deeper: np.ndarray
    further: np.ndarray

    @property
    def leaves(self) -> int:
        return len(self.further) << len(self.deeper)

    @classmethod
    def fit(cls, sample: np.ndarray, leaf: int, rng: np.random.Generator, levels: int = 0) -> Tree:
        directions, thresholds, children, further = [], [], [], []
        dims = sample.shape[1]
        deeper = rng.standard_normal((levels, dims))
        deeper /= np.linalg.norm(deeper, axis=1, keepdims=True)
        todo = [(np.arange(len(sample)), -1, 0, 0)]
        while todo:
            rows, parent, side, depth = todo.pop()
            sides = None
            if len(rows) > leaf and depth < 48:
                d = rng.standard_normal(dims)
                d /= np.linalg.norm(d)
                p = sample[rows] @ d
                t = float(np.median(p))
                sides = rows[p <= t + SPILL], rows[p > t - SPILL]
                if max(map(len, sides)) > 0.9 * len(rows):  # a tight cluster: no split parts it
                    sides = None
            if sides:
                me = len(directions)
                directions.append(d)
                thresholds.append(t)
                children.append([0, 0])
                todo += [(sides[0], me, 0, depth + 1), (sides[1], me, 1, depth + 1)]
            else:
                me = -1 - len(further)
                further.append(np.median(sample[rows] @ deeper.T, axis=0) if len(rows) else np.zeros(levels))
            if parent >= 0:
                children[parent][side] = me
        return cls(np.array(directions).reshape(-1, dims), np.array(thresholds), np.array(children, np.int64).reshape(-1, 2), deeper, np.array(further).reshape(len(further), levels))

    def leaves_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that a row of x falls in."""
        out, todo = [], [(0 if len(self.thresholds) else -1, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out.append((rows, np.full(len(rows), -1 - node)))
            elif len(rows):
                p, t = x[rows] @ self.directions[node], self.thresholds[node]
                left, right = self.children[node].tolist()
                todo += [(left, rows[p <= t + SPILL]), (right, rows[p > t - SPILL])]
        row, leaf = np.concatenate([r for r, _ in out]), np.concatenate([k for _, k in out])
        bits = np.zeros(len(row), np.int64)
        for level, d in enumerate(self.deeper):
            p, t = (x @ d)[row], self.further[leaf, level]
            low, high = p <= t + SPILL, p > t - SPILL
            row, leaf = np.concatenate((row[low], row[high])), np.concatenate((leaf[low], leaf[high]))
            bits = np.concatenate((bits[low] << 1, bits[high] << 1 | 1))
        return row, (leaf << len(self.deeper)) + bits


def unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # first, lest squares leave the range of doubles
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_forest(vectors: DataFrame, count: int, seed: int = 7) -> dict[int, list[Tree]]:
    """Trees for each length of vectors (c1, c2, v), over a bounded sample of all, of which there are count. A length
    that the sample misses has none: its vectors share one leaf."""
    sample = vectors.orderBy("c1", "c2").limit(FIT).select("v").collect()
    leaf, by_length = max(LEAST, LEAF * len(sample) // count), {}
    levels = 0
    while sample and 2 * leaf * count > 3 * LEAF * len(sample) << levels:  # what a fitted leaf holds of all vectors, halved level by level
        levels += 1
    for r in sample:
        by_length.setdefault(len(r["v"]), []).append(r["v"])
    return {d: [Tree.fit(unit(own), leaf, np.random.default_rng([seed, t]), levels) for t in range(TREES)] for d, own in sorted(by_length.items())}


def _place(forest: dict[int, list[Tree]]):
    """Rows (dims, leaf, c1, c2, n, least, v, leaves): a vector in each of its leaves, with all of them. Leaves are
    numbered anew for each length dims."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        for whole in batches:
            lengths = pc.list_value_length(whole.column(4))
            for dims in pc.unique(lengths).to_pylist():
                yield from placed(dims, whole.filter(pc.equal(lengths, dims)))

    def placed(dims, batch):
        trees = forest.get(dims) or [Tree(np.zeros((0, dims)), np.zeros(0), np.zeros((0, 2), np.int64), np.zeros((0, dims)), np.zeros((1, 0)))]
        base = np.cumsum([0, *(t.leaves for t in trees)])
        x = unit(batch.column(4).to_pylist())
        found = [t.leaves_of(x) for t in trees]
        row = np.concatenate([r for r, _ in found])
        leaf = np.concatenate([k + b for (_, k), b in zip(found, base, strict=False)])
        order = np.lexsort((leaf, row))
        row, leaf = row[order], leaf[order].astype(np.int64)
        ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
        own = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(leaf))
        full = pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([r.tobytes() for r in x], pa.binary()), own], names=["c1", "c2", "n", "least", "v", "leaves"])
        for i in range(0, len(row), 2000):
            part = full.take(pa.array(row[i : i + 2000]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, dims, np.int32)), pa.array(leaf[i : i + 2000]), *part.columns], names=["dims", "leaf", *part.schema.names])

    return run


def _compare(least_cosine: float):
    """Over one pair of tiles of a leaf: rows (c1, c2, links, least, root). A pair of vectors that share several
    leaves counts in the first of them alone; links joins what the tiles connect in a star, not in pairs."""

    def run(key, found):
        import pyarrow as pa

        _, leaf, a, b = (k.as_py() for k in key)
        x = np.frombuffer(b"".join(found["v"].to_pylist()), np.float64).reshape(found.num_rows, -1)
        n = found["n"].to_numpy()
        tile = found["tile"].to_numpy()
        lists = found["leaves"].combine_chunks()
        owner = np.repeat(np.arange(len(x)), np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten().to_numpy()
        early = flat < leaf
        shared, some_early = None, np.bincount(owner[early], minlength=len(x))
        ends = np.cumsum(some_early)
        listed = flat[early]  # row i's earlier leaves: listed[ends[i] - some_early[i] : ends[i]], ascending

        def apart_before(p, q):
            """Whether the rows p[i] and q[i] share no earlier leaf."""
            n = some_early[p]
            pair = np.repeat(np.arange(len(p)), n)
            own = listed[np.repeat(ends[p] - n - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            met = np.isin(own * len(x) + q[pair], listed * len(x) + owner[early])
            return np.bincount(pair[met], minlength=len(p)) == 0

        left, right = np.nonzero(tile == a)[0], np.nonzero(tile == b)[0]
        links, labels = np.zeros(len(x), np.int64), np.arange(len(x))
        for i in range(0, len(left), 512):
            own = left[i : i + 512]
            near = x[own] @ x[right].T >= least_cosine
            p, q = np.nonzero(near)
            if len(p) * SPARSE < near.size:
                lone = apart_before(own[p], right[q])
                if a == b:
                    lone &= own[p] != right[q]
                np.add.at(links, own[p[lone]], n[right[q[lone]]])
                if a != b:
                    np.add.at(links, right[q[lone]], n[own[p[lone]]])
            else:
                if shared is None:
                    names, column = np.unique(listed, return_inverse=True)
                    shared = np.zeros((len(x), max(1, len(names))), np.float32)
                    shared[owner[early], column] = 1
                first = near & (shared[own] @ shared[right].T == 0)
                if a == b:
                    first &= own[:, None] != right[None, :]
                links[own] += first @ n[right]
                if a != b:
                    links[right] += n[own] @ first
            p, q = own[p], right[q]
            apart = labels[p] != labels[q]
            labels = local_forest(len(x), p[apart], q[apart], labels)
        some = pa.array(np.nonzero((links > 0) | (labels != np.arange(len(x))))[0])
        least = found["least"].combine_chunks()
        out = [found["c1"], found["c2"], pa.array(links), least, least.take(pa.array(labels))]
        return pa.Table.from_arrays(out, names=["c1", "c2", "links", "least", "root"]).take(some)

    return run


def near_vectors(rows: DataFrame, least_cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row: id_col, n_links (other rows found with at least the cosine), component_id (the smallest id
    reachable over such links, itself included) and kept (whether that is its own).

    Equal vectors are one class, compared once and counted by their number. Vectors of different
    lengths do not link. Those that are null, zero, or hold null or non-finite components link with nothing, and so
    do rows with a null id, whose component_id is null and kept false. Rows of equal ids are one node. Repeated rows are
    rows of their own, links among them included. Other columns of rows are ignored; an empty table gives an empty one.
    """
    v = F.col(vector_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    own = rows.select(F.col(id_col).alias("id"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    keyed = own.withColumns({"c1": F.when(F.col("fine"), F.xxhash64("v")), "c2": F.when(F.col("fine"), F.xxhash64(F.lit(1), F.reverse("v")))})
    classes = cut(keyed.where("fine").groupBy("c1", "c2").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.first("v").alias("v")))
    trees = fit_forest(classes, max(1, classes.count()))
    kind = rows.schema[id_col].dataType.simpleString()
    placed = cut(classes.mapInArrow(_place(trees), f"dims int, leaf bigint, c1 bigint, c2 bigint, n bigint, least {kind}, v binary, leaves array<bigint>"))
    large = cut(placed.groupBy("dims", "leaf").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).where("tiles > 1"))
    tiled = placed.join(F.broadcast(large) if large.count() <= MOST_BROADCAST else large, ["dims", "leaf"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tiled = tiled.withColumn("tile", F.expr("cast(pmod(c1, tiles) as int)"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda u: F.struct(F.least(u, "tile").alias("a"), F.greatest(u, "tile").alias("b")))
    met = tiled.select("dims", "leaf", "c1", "c2", "n", "least", "v", "leaves", "tile", F.inline(pairs))
    found = cut(met.groupBy("dims", "leaf", "a", "b").applyInArrow(_compare(least_cosine), f"c1 bigint, c2 bigint, links bigint, least {kind}, root {kind}"))
    links = found.groupBy("c1", "c2").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("least").alias("a"), F.col("root").alias("b")))
    known = classes.select("c1", "c2", "n", "least").join(links, ["c1", "c2"], "left").join(parts.withColumnRenamed("node", "least"), "least", "left")
    known = cut(known.select(F.struct("c1", "c2").alias("c"), "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id")))
    drop_cut(found)
    named = F.struct(F.coalesce("c1", F.lit(0)).alias("c1"), F.coalesce("c2", F.lit(0)).alias("c2"))
    out = spread_join(keyed.where("fine").select("id", named.alias("c")), known, "c", "n", known.agg(F.sum("n")).first()[0] or 0).select("id", "n_links", "component_id")
    out = out.unionByName(keyed.where("not fine").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(False)).alias("kept"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, zeros, ties and repeated rows as in near_vectors()."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_sql() -> str:
    """All pairs: for tests on small tables."""
    return f"""
    with recursive e as (
      select vec_id, embedding::double[] as v from embeddings
      where embedding is not null and not list_contains(list_transform(embedding, lambda x: x is null or not isfinite(x)), true)
        and list_contains(list_transform(embedding, lambda x: x <> 0), true)),
    l as (select a.vec_id as a, b.vec_id as b from e a join e b on a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= {COSINE}),
    r as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from r join l on r.b = l.a),
    c as (select a as vec_id, min(b) as component_id from r group by a)
    select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
    from c left join (select a, count(*) as n from l group by a) on a = vec_id
    """
