"""Mixing sources to target weights by weighted sampling without replacement, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexispark.llm.common import WORD, Named, count_of, cut, drop_cut, let, table

#: A source's words may be taken so many times at most.
CAP = 3
#: Source weights by rank of the source's name, repeating.
WEIGHTS = (1, 2, 3)
#: Rows of a range of the sampling key within a source, about: prefix sums run inside a range, on top of the ranges' sums.
RANGE_ROWS = 20_000
SYMBOLS = "#*$%&|<>"


def quality_weight(size: Column, symbols: Column) -> Column:
    """In (0, 1]: falls with the symbols a word, as the quality rules count them."""
    return (1.0 + size) / (1.0 + size + 4.0 * symbols)


def sampling_key(id_: Column, text: Column, weight: Column) -> Column:
    """Efraimidis and Spirakis: an exponential variate over the weight; smallest keys are drawn first. The variate comes
    from the id's digest (the text's, where the id is null), so reruns and other partitionings draw alike."""
    digest = F.substring(F.md5(F.coalesce(id_.cast("string"), text.cast("string"), F.lit("")).cast("binary")), 1, 13)
    uniform = (F.conv(digest, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(uniform) / weight


def drawn(id_: Column, text: Column) -> Column:
    """(size, key) of a row as a struct, its text read once for each."""
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
    counts = F.struct(size.alias("size"), F.coalesce(count_of(SYMBOLS, text), F.lit(0)).alias("symbols"))
    return let(counts, lambda m: F.struct(m["size"].alias("size"), sampling_key(id_, text, quality_weight(m["size"], m["symbols"])).alias("key")))


def targets(sources: DataFrame) -> DataFrame:
    """sources (sk, source, source_size) with target: all sizes shared out by weight, no target above
    CAP times its source's size. The excess always goes to the others by weight, so the result is
    min(cap, level * weight) at the one level that spends everything; sources sorted by cap / weight
    reach their caps one after another as the level rises, which a running sum finds."""
    order = W.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)
    ranked = sources.withColumn("w", weight).withColumn("cap", F.col("source_size") * CAP).withColumn("ratio", F.col("cap") / F.col("w"))
    full = W.orderBy("ratio", F.col("source").isNull(), "source")
    everything = full.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    spent = F.coalesce(F.sum("cap").over(full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("w").over(full.rowsBetween(0, W.unboundedFollowing))
    level = ((F.sum("source_size").over(everything) - spent) / open_weight).cast("double")
    found = ranked.withColumn("level", level).withColumn("level", F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(everything))
    return found.select("sk", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with size (words), source_size, target (words that the mix takes of the row's source) and
    taken, the words that it takes of the row: size times its whole epochs, and once more if the row is
    among the first by sampling key whose sizes come nearest to what is left of the target.

    Columns of docs with these names are replaced; any other names may occur. A null source is a source of its own, after
    all others; a null text has size 0 and, like an empty one, is never taken; very long texts count whole. Rows with equal
    ids, or null ids and equal texts, draw equal variates and stay separate rows; ties go by id, size and text. An empty
    table gives an empty one. There is a row a source in one task, and none of documents.
    """
    own = Named(docs, "size", "source_size", "target", "taken")
    id_, text, source = (F.col(own.at(c)) for c in (id_col, text_col, source_col))
    total = own.df.count()
    octave = max(4, total // (3 * RANGE_ROWS))  # ranges between a key and its double; three such hold most keys
    rows = own.df.withColumns({"sk": F.coalesce(F.concat(F.lit("="), source), F.lit("")), "d": drawn(id_, text)})
    rows = rows.withColumns({"size": F.col("d.size"), "key": F.col("d.key"), "range": F.coalesce(F.floor(F.log2("d.key") * octave), F.lit(0))}).drop("d")
    ranges = cut(rows.groupBy("sk", "range").agg(F.sum("size").alias("n"), F.min(source).alias("source")), total)
    sources = targets(ranges.groupBy("sk").agg(F.min("source").alias("source"), F.sum("n").alias("source_size")))
    before = F.coalesce(F.sum("n").over(W.partitionBy("sk").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    known = cut(ranges.select("sk", "range", before.alias("base")).join(sources, "sk"), total)
    drop_cut(ranges)
    whole = rows.join(known, ["sk", "range"])
    inside = W.partitionBy("sk", "range").orderBy("key", id_, "size", F.xxhash64(text)).rowsBetween(W.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    left = F.col("target") - F.col("epochs") * F.col("source_size")
    once_more = (F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2.0 <= left) & (F.col("size") > 0)
    whole = whole.withColumn("epochs", epochs).withColumn("taken", F.col("size") * (F.col("epochs") + F.when(once_more, 1).otherwise(0)))
    return own.back(whole, "size", "source_size", "target", F.col("taken").cast("bigint").alias("taken"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, ties and repeated rows as in mix()."""
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op8_sql(documents: str = "documents") -> str:
    return rf"""
    with d as (
      select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size,
             len(regexp_extract_all(coalesce(text, ''), '[{SYMBOLS}]')) as symbols, text from {documents}),
    k as (
      select *, -ln((cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), text, '')), 1, 13) as bigint)::double + 0.5) / {float(1 << 52)})
                / ((1.0::double + size) / (1.0::double + size + 4.0::double * symbols)) as key from d),
    s0 as (select source, sum(size)::bigint as source_size from k group by source),
    s1 as (select *, (row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1 as w, source_size * {CAP} as cap from s0),
    s2 as (select *, cap::double / w as ratio from s1),
    s3 as (
      select *, (sum(source_size) over ()
                 - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
                / (sum(w) over (order by ratio, source nulls last rows between current row and unbounded following))::double as level from s2),
    l as (select min(level) as level from (select level, row_number() over (order by ratio, source nulls last) as r from s3 where level <= ratio) where r = 1),
    s as (select s3.source, s3.source_size, least(cap::double, l.level * w) as target from s3, l),
    r as (
      select k.*, s.source_size, s.target, case when s.source_size > 0 then floor(s.target / s.source_size) else 0 end as epochs,
             coalesce(sum(size) over (partition by k.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as base
      from k join s on k.source is not distinct from s.source)
    select doc_id, size, source_size, target,
           (size * (epochs + case when size > 0 and base + size / 2.0::double <= target - epochs * source_size then 1 else 0 end))::bigint as taken
    from r
    """
