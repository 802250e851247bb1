"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.sources.tables import read_table

#: A word is a maximal run of characters other than the six ASCII white spaces.
#: ``bytes.split()`` without arguments cuts UTF-8 at exactly these characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def count_of(characters: str, c: Column) -> Column:
    """How many of a text's characters are among these; null for a null text."""
    return (F.length(c) - F.length(F.translate(c, characters, ""))).cast("bigint")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, whatever the optimizer collapses."""
    return F.transform(F.array(value), body)[0]


class Named:
    """A table whose columns are called in_0, in_1, ..., so that an operator's own names cannot meet them; back() gives
    the old names again. Columns that the operator adds replace those of the same name (in any case of letters)."""

    def __init__(self, df: DataFrame, *added: str):
        gone = {a.lower() for a in added}
        self.names, self.types = df.columns, [f.dataType for f in df.schema]
        self.df = df.toDF(*[f"in_{i}" for i in range(len(self.names))])
        self.left = [i for i, c in enumerate(self.names) if c.lower() not in gone]

    def at(self, name: str) -> str:
        """The present name of a column: the first that is called so, or so in another case of letters."""
        low = [c.lower() for c in self.names]
        return f"in_{self.names.index(name) if name in self.names else low.index(name.lower())}"

    def keep(self, names: list[str] | None, *but: str) -> Named:
        """Only these columns are given back (None: all but some); added ones stay replaced."""
        gone = {b.lower() for b in but}
        if names is None:
            self.left = [i for i in self.left if self.names[i].lower() not in gone]
        else:
            self.left = [i for i in (int(self.at(n)[3:]) for n in names) if i in self.left]
        return self

    @property
    def inside(self) -> list[str]:
        """Present names of the columns that are given back."""
        return [f"in_{i}" for i in self.left]

    def schema(self, *more: tuple[str, T.DataType], columns: list[str] | None = None) -> T.StructType:
        """Of columns (those given back, unless named) and more."""
        own = [(c, self.types[int(c[3:])]) for c in (self.inside if columns is None else columns)]
        return T.StructType([T.StructField(n, k) for n, k in [*own, *more]])

    def back(self, df: DataFrame, *more: Column | str) -> DataFrame:
        return df.select(*[F.col(f"in_{i}").alias(self.names[i]) for i in self.left], *more)


def row_key(df: DataFrame) -> Column:
    """A hash of all of a row's columns that can be hashed (maps cannot)."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()])


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the session's checkpoint folder. Only in local mode, as in tests, a
    temporary one stands in where the session names none; on a cluster its absence is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexispark-"))
    return sc.getCheckpointDir()


#: How cut() writes where the shared folder is a mounted one (other file systems ignore it): by Hadoop's plain local file
#: system, without a mark of success. The usual one adds a checksum file to each and, without its native library, starts a
#: chmod for it too. Until such a child executes, it shares its JVM's memory and counts as a second JVM.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
#: Whether an execution's shuffle files go at its end; otherwise they stay until the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a file of a table that is known to be small, about.
FILE_ROWS = 100_000

#: Tables that cut() wrote and nobody deleted yet, by path; the innermost scope's last.
_held: list[dict[str, DataFrame]] = [{}]


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, written to a table in the shared folder and read back: what follows neither recomputes it nor depends on an
    executor's local disk; what was shuffled for it goes at once. The table goes with drop_cut(), at the end of its scope(), or
    with the process. rows: about how many df has, where that is known; few rows are then few files, whatever the number of
    partitions."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, rows // FILE_ROWS))
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    told = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.options(**PLAIN_FILES).parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, told)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path  # type: ignore[attr-defined]
    _held[-1][path] = out
    return out


def drop_cut(df: DataFrame) -> None:
    """Deletes a table that cut() wrote, once nothing reads it any more."""
    path = getattr(df, "_scratch", None)
    if path:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        for held in _held:
            held.pop(path, None)


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Deletes, at its end, what was cut inside it: what is to stay must be written by then."""
    _held.append({})
    try:
        yield
    finally:
        own = _held.pop()
        for df in own.values():
            drop_cut(df)


def release(df: DataFrame) -> DataFrame:
    """df, a table of cut(), which now outlives the innermost scope()."""
    if len(_held) > 1 and _held[-1].pop(df._scratch, None) is not None:  # type: ignore[attr-defined]
        _held[-2][df._scratch] = df  # type: ignore[attr-defined]
    return df


def reads(df: DataFrame, scratch: DataFrame) -> bool:
    """Whether df's plan reads a table of cut()."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        said = leaf.toString()
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            said += leaf.relation().location().rootPaths().toString()
        if scratch._scratch.rsplit("/", 1)[-1] in said:  # type: ignore[attr-defined]
            return True
    return False


#: What steps() cut and left, in the order of the steps.
_left: list[DataFrame] = []


def steps(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A step of a pipeline whose steps' results are written before the next one is called: what earlier steps cut goes
    when the next one begins, unless its docs still read it."""

    @functools.wraps(function)
    def step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for df in list(_left):
            if not reads(docs, df):
                _left.remove(df)
                drop_cut(df)
        before = set(_held[-1])
        out = function(spark, docs, sf_dir)
        _left.extend(df for path, df in _held[-1].items() if path not in before)
        return out

    return step


def _drop_all() -> None:
    for held in _held:
        for df in list(held.values()):
            if df.sparkSession.sparkContext._jsc is not None:
                with contextlib.suppress(Exception):  # the process ends, and the session may be gone
                    drop_cut(df)


atexit.register(_drop_all)

#: Joins of less rows than FEW are plain; otherwise keys with more than one in MOST_HOT of all rows are hot.
FEW, MOST_HOT = 200_000, 500


def spread_join(rows: DataFrame, known: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined by key with known, which has one row a key and the number of rows of that key in the column size. A
    hot key's rows are not gathered: there are MOST_HOT such keys at most, so that their rows of known are broadcast."""
    if total < FEW:
        return rows.join(known, key)
    hot, rest = known.where(F.col(size) > total // MOST_HOT), known.where(F.col(size) <= total // MOST_HOT)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def give_back() -> None:
    """Hands a worker's free memory back to the machine, where its C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pieces(batch, column: int, most_bytes: int = 4_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, values) of a record batch's binary column, in pieces of about most_bytes
    so that what a worker derives from them stays small; a longer value stands alone."""
    import pyarrow.compute as pc

    col = batch.column(column)
    n = batch.num_rows
    if n == 0:
        return
    sizes = pc.binary_length(col).fill_null(0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most_bytes:
            yield start, col.slice(start, i - start).to_pylist()
            start, total = i, 0
        total += size
    yield start, col.slice(start, n - start).to_pylist()
