"""SimHash fingerprints and their exact near-duplicate classes by tiled comparison."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.llm.common import Named, cut, pieces, row_key, spread_join, table
from lexispark.llm.graph import connected_components, local_forest

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints of a tile, about: one in TILES of all, so that what is shipped is a constant number of bytes a fingerprint,
#: but within these bounds, the upper one a few megabytes, beyond which the number of tiles grows.
TILE_LEAST, TILE_MOST, TILES = 16_384, 1 << 20, 128
#: Pairs of fingerprints of a task, about, and comparisons at a time.
TASK_WORK, AT_ONCE = 400_000_000, 4_000_000
#: The bits of each byte value, the lowest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a UTF-8 text; 0 if it is null or has no word."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()  # bytes.lower() changes A-Z alone
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) > width:
        starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
        hashes = np.fromiter([xxh64_intdigest(flat[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)
    else:
        hashes = np.array([xxh64_intdigest(flat, SEED)], np.uint64)
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ BITS for k in range(8)])
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th bigint, rk bigint, fp bigint) of every row; th is a hash of the text itself, rk one of the whole row."""
    import pyarrow as pa

    own = Named(docs)
    kind = own.types[int(own.at(id_col)[3:])]

    def run(batches):
        for batch in batches:
            fps = [fingerprint(x) for _, part in pieces(batch, 3) for x in part]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fps, pa.int64())], names=["id", "th", "rk", "fp"])

    text = own.at(text_col)
    rows = own.df.select(F.col(own.at(id_col)).alias("id"), F.xxhash64(text).alias("th"), row_key(own.df).alias("rk"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(run, T.StructType().add("id", kind).add("th", "long").add("rk", "long").add("fp", "long"))


def _by_parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, counts): x sorted into runs of equal population counts of its four 16-bit parts, where the runs
    start (with the end), and each run's four counts."""
    parts = np.bitwise_count(x.view(np.uint16).reshape(-1, 4)).astype(np.int16)
    code = ((parts[:, 0].astype(np.int32) * 17 + parts[:, 1]) * 17 + parts[:, 2]) * 17 + parts[:, 3]
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.diff(code[order], prepend=-1))
    return order, np.append(first, len(x)), parts[order[first]]


def near_pairs(x: np.ndarray, y: np.ndarray, radius: int):
    """Index arrays (i, j) with x[i] and y[j] at most radius bits apart, by exclusive-or and bit counts. Within a pair of
    tiles too, runs whose counts by parts differ by more than the radius in all are skipped."""
    ox, sx, cx = _by_parts(x)
    oy, sy, cy = _by_parts(y)
    ys = y[oy]
    for r in range(len(cx)):
        runs = np.flatnonzero(np.abs(cy - cx[r]).sum(1) <= radius)
        if not len(runs):
            continue
        lengths = sy[runs + 1] - sy[runs]
        at = np.repeat(sy[runs] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        own, near = ox[sx[r] : sx[r + 1]], ys[at]
        step = max(1, AT_ONCE // len(near))
        for i in range(0, len(own), step):
            a, b = np.nonzero(np.bitwise_count(x[own[i : i + step], None] ^ near[None, :]) <= radius)
            if len(a):
                yield own[a + i], oy[at[b]]


def _tile_links(radius: int):
    """Compares the fingerprints of two tiles and yields, for each that is linked, the smallest fingerprint (by
    position) of its class within the pair: a star, not all pairs."""

    def run(found):
        import pyarrow as pa

        tiles = [np.asarray(found["fps"][i].values).view(np.uint64) for i in range(found.num_rows)]
        x, y = tiles[0], tiles[-1]
        both, shift = (x, 0) if len(tiles) == 1 else (np.concatenate((x, y)), len(x))
        labels = np.arange(len(both))
        for a, b in near_pairs(x, y, radius):
            b = b + shift
            apart = labels[a] != labels[b]
            if apart.any():
                labels = local_forest(len(both), a[apart], b[apart], labels)
        moved = np.nonzero(labels != np.arange(len(both)))[0]
        return pa.table({"a": pa.array(both[moved].view(np.int64)), "b": pa.array(both[labels[moved]].view(np.int64))})

    return run


def fingerprint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that join exactly the fingerprints (column fp, distinct) with at most radius
    differing bits into classes.

    Fingerprints are dealt to tiles by population count; two tiles are compared unless their counts
    differ by more than the radius, as every pair across them then differs in more bits than that.
    A tile is sent once to each pair that it is in. The driver sees only the 65 sizes of the population counts.
    """
    spark = fps.sparkSession
    fps = fps.select("fp", F.bit_count("fp").alias("pop"))
    sizes = {r["pop"]: r["n"] for r in fps.groupBy("pop").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "a bigint, b bigint")
    most = min(TILE_MOST, max(TILE_LEAST, sum(sizes.values()) // TILES))
    shards = {pop: -(-n // most) for pop, n in sizes.items()}
    n_shards = F.create_map(*[F.lit(x) for pop in shards for x in (pop, shards[pop])])
    tile = lambda pop, k: (F.lit(pop) if isinstance(pop, int) else pop).cast("bigint") * (1 << 40) + k
    packed = fps.withColumn("k", F.expr("pmod(xxhash64(fp), 1L << 40)") % n_shards[F.col("pop")]).groupBy("pop", "k").agg(F.collect_list("fp").alias("fps"))
    of_pop = lambda pop: F.transform(F.sequence(F.lit(0), F.lit(shards[pop] - 1)), lambda k: tile(pop, k))
    met = [F.when(F.abs(F.col("pop") - pop) <= radius, of_pop(pop)) for pop in shards]
    others = F.explode(F.flatten(F.filter(F.array(*met), lambda x: x.isNotNull())))
    sent = packed.select(tile(F.col("pop"), F.col("k")).alias("t"), "fps", others.alias("u"))
    work = sum(sizes[p] * sizes[q] for p in sizes for q in sizes if 0 <= q - p <= radius)
    pairs = sent.select(F.least("t", "u").alias("x"), F.greatest("t", "u").alias("y"), "fps").repartition(1 + int(min(work // TASK_WORK, 100_000)), "x", "y")
    return pairs.groupBy("x", "y").applyInArrow(_tile_links(radius), "a bigint, b bigint")


def _near(docs: DataFrame, radius: int, id_col: str, text_col: str) -> DataFrame:
    """(fp, id, th, rk, component, component_id) of every row."""
    fps = cut(fingerprints(docs, id_col, text_col))
    total = fps.count()
    classes = fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    parts = connected_components(fingerprint_links(classes, radius))
    known = cut(classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component")), total)
    roots = known.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    named = spread_join(known, roots, "component", "m", known.count()).select("fp", "n", "component", "component_id")
    return spread_join(fps, named, "fp", "n", total).drop("n")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, fp, component (a fingerprint that names the class) and
    component_id, the smallest id reachable over links of at most radius differing bits.

    Null and empty texts have the fingerprint zero and link like others; very long ones are read whole. Rows with equal
    ids, and repeated rows, stay separate rows. A null id is never a component_id; a class of null ids alone has a null one.
    Other columns of docs are ignored.
    """
    return _near(docs, radius, id_col, text_col).select(F.col("id").alias(id_col), "fp", "component", "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near-duplicates: of each class the row with its smallest id stays (a null id only
    where all are null; among equal ids the smallest hash of the text, then of the row; one of repeated rows)."""
    own = Named(docs)
    found = _near(docs, radius, id_col, text_col)
    best = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), "th", "rk")
    first = found.groupBy("component").agg(F.min(best).alias("x")).select(F.col("x.id").cast("string").alias("first_id"), F.col("x.th").alias("th"), F.col("x.rk").alias("rk")).distinct()
    rows = own.df.withColumns({"th": F.xxhash64(own.at(text_col)), "rk": row_key(own.df), "own_id": F.coalesce(F.col(own.at(id_col)).cast("string"), F.lit(""))})
    same = first.select(F.coalesce("first_id", F.lit("")).alias("own_id"), "th", "rk")
    return own.back(rows.join(same, ["own_id", "th", "rk"], "left_semi").dropDuplicates(["own_id", "th", "rk"]))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, empty and repeated rows as in near_duplicates(); an empty table gives an empty one."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
