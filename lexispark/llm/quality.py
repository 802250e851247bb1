"""Quality rules with thresholds that follow the data, in DataFrame operations alone.

Quantile sketches are plain rows (group, metric, bucket, n): a bucket holds the integers that agree in
their leading bits, so sketches of any parts merge by adding counts, in any order, to the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexispark.llm.common import WORD, Named, count_of, cut, drop_cut, let, table

WINDOW, SYMBOLS, SPACES = 5, "#*$%&|<>", " \t\n\x0b\f\r"
#: Base rules: fewest words, and most words in repeated windows, of a hundred.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: metric: (what is added to the fence, whether there is a lower fence too). Permille, and hundredths for lengths.
METRICS = {"symbols": (200, False), "dup_lines": (400, False), "word_length": (150, True)}
#: A fence lies so many quartile distances from the quartiles.
REACH = 3
#: Leading bits that a bucket keeps: its width is at most a sixteenth of its values.
BITS = 5
#: Smaller groups use their language's merged sketch; languages as small set no threshold.
LEAST_GROUP = 30
#: Up to so many groups' thresholds are broadcast, a few hundred bytes each; more are joined by a shuffle.
MOST_BROADCAST = 10_000


def _repeated_words(words: Column) -> Column:
    """Words in WINDOW-word windows that are found twice or more in the array."""

    def counted(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda p, j, x: F.get(p, j)["h"].eqNullSafe(x["h"])
        twice = let(placed, lambda p: F.filter(p, lambda x, j: same(p, j - 1, x) | same(p, j + 1, x)))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(starts, zero, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    def hashed(words: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(words) - WINDOW)
        hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(counted(h)))

    return F.when(F.size(words) < WINDOW, 0).otherwise(hashed(words))


def measures(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_lines (lines with a word), n_dup_lines and n_repeat_words of a
    text, as a struct; all 0 for a null or empty one."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)

    def of(words: Column) -> Column:
        return let(
            lines,
            lambda kept: F.struct(
                F.size(words).cast("bigint").alias("n_words"),
                F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
                count_of(SYMBOLS, text).alias("n_symbols"),
                F.size(kept).cast("bigint").alias("n_lines"),
                (F.size(kept) - F.size(F.array_distinct(kept))).cast("bigint").alias("n_dup_lines"),
                _repeated_words(words).cast("bigint").alias("n_repeat_words"),
            ),
        )

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of)


def measured(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """docs with the struct _m of measures, the group keys _lk and _sk, base_failed, and _v, the metrics' values."""
    m = F.col("_m")
    failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])
    values = F.struct(
        F.expr("1000 * _m.n_symbols div greatest(_m.n_words, 1)").alias("symbols"),
        F.expr("1000 * _m.n_dup_lines div greatest(_m.n_lines, 1)").alias("dup_lines"),
        F.expr("100 * _m.word_chars div greatest(_m.n_words, 1)").alias("word_length"),
    )
    out = docs.withColumn("_m", measures(F.col(text_col)))
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))  # noqa: E731  null is a group of its own
    return out.withColumns({"_lk": key(lang_col), "_sk": key(source_col), "base_failed": failed, "_v": values})


def bucket(v: Column) -> Column:
    """The smallest integer of v's bucket: v with all but its BITS leading bits cleared."""
    shift = F.greatest(F.length(F.bin(v)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketch(rows: DataFrame) -> DataFrame:
    """(_lk, _sk, metric, bucket, n) over the rows that pass the base rules."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(f"_v.{m}")).alias("bucket")) for m in METRICS])
    return rows.where("not base_failed").select("_lk", "_sk", F.inline(each)).groupBy("_lk", "_sk", "metric", "bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches of the coarser groups that keys name."""
    return sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def thresholds(sketches: DataFrame) -> DataFrame:
    """(_lk, _sk, <metric>_least, <metric>_most) of every group; null where too few rows speak for a fence."""
    total = F.sum("n").over(W.partitionBy("_lk", "_sk", "metric"))
    own = sketches.withColumn("total", total)
    groups = own.groupBy("_lk", "_sk").agg(F.max("total").alias("total"))
    languages = merge(sketches, "_lk").withColumn("total", F.sum("n").over(W.partitionBy("_lk", "metric")))
    lent = groups.where(F.col("total") < LEAST_GROUP).select("_lk", "_sk").join(languages, "_lk")
    used = own.where(F.col("total") >= LEAST_GROUP).unionByName(lent.select("_lk", "_sk", "metric", "bucket", "n", "total"))
    upto = F.sum("n").over(W.partitionBy("_lk", "_sk", "metric").orderBy("bucket"))
    ranked = used.withColumn("upto", upto)
    quartile = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("total"), F.col("bucket")))
    found = ranked.groupBy("_lk", "_sk", "metric").agg(quartile(1).alias("q1"), quartile(3).alias("q3"), F.max("total").alias("total")).where(F.col("total") >= LEAST_GROUP)
    reach = REACH * (F.col("q3") - F.col("q1"))
    fences = []
    for name, (slack, lower) in METRICS.items():
        mine = F.col("metric") == name
        fences.append(F.max(F.when(mine, F.col("q3") + reach + slack)).alias(f"{name}_most"))
        if lower:
            fences.append(F.max(F.when(mine, F.col("q1") - reach - slack)).alias(f"{name}_least"))
    return found.groupBy("_lk", "_sk").agg(*fences)


def verdicts(rows: DataFrame, fences: DataFrame) -> DataFrame:
    """rows (of measured()) with kept: true unless a base rule or a fence of the row's group rejects it."""
    few = fences.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    joined = rows.join(F.broadcast(fences) if few else fences, ["_lk", "_sk"], "left")
    fine = ~F.col("base_failed")
    for name, (_, lower) in METRICS.items():
        fine &= F.coalesce(F.col(f"_v.{name}") <= F.col(f"{name}_most"), F.lit(True))
        if lower:
            fine &= F.coalesce(F.col(f"_v.{name}") >= F.col(f"{name}_least"), F.lit(True))
    return joined.withColumn("kept", fine).drop(*[c for c in fences.columns if c not in ("_lk", "_sk")])


ADDED = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """docs with the measures, base_failed and kept; columns of docs with these names are replaced, others may have any name.

    Texts are measured once, and the rows written with their measures, which both the sketches and the verdicts read. Null
    and empty texts have no words and fail; very long ones are measured whole. Null languages and sources are groups of
    their own. Rows are independent but for the fences: repeated ones get equal verdicts. An empty table gives an empty one.
    """
    own = Named(docs, *ADDED)
    rows = cut(measured(own.df, own.at(text_col), own.at(lang_col), own.at(source_col)))
    return own.back(verdicts(rows, _fences(rows)), "_m.*", "base_failed", "kept")


def _fences(rows: DataFrame) -> DataFrame:
    total = rows.count()
    counted = cut(sketch(rows), total)
    out = cut(thresholds(counted), total)
    drop_cut(counted)
    return out


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, empty texts and repeated rows as in judge(); the texts themselves are not written."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rows = cut(measured(docs, "text", "lang", "source").drop("text"))
    return verdicts(rows, _fences(rows)).select("doc_id", "_m.n_words", "_m.word_chars", "_m.n_symbols", "_m.n_dup_lines", "_m.n_repeat_words", "base_failed", "kept")


def op5_sql() -> str:
    symbols, dup_lines, word_length = (METRICS[m][0] for m in METRICS)
    return rf"""
    with d as (
      select doc_id, coalesce(lang, chr(1)) as lk, coalesce(source, chr(1)) as sk, coalesce(text, '') as t,
             regexp_extract_all(coalesce(text, ''), '{WORD}') as ws,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) as ls from documents),
    r0 as (select row_number() over () as r, * from d),
    g as (select r, p, array_to_string(list_slice(ws, p, p + {WINDOW - 1}), ' ') as g from (select r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as p from r0)),
    g2 as (select r, p from (select *, count(*) over (partition by r, g) as c from g) where c > 1),
    rep as (select r, count(distinct p + k) as n from g2, range({WINDOW}) as q(k) group by r),
    m as (
      select r0.r, doc_id, lk, sk, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
             len(regexp_extract_all(t, '[{SYMBOLS}]'))::bigint as n_symbols, len(ls) as n_lines,
             (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words
      from r0 left join rep on r0.r = rep.r),
    b as (
      select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed,
             1000 * n_symbols // greatest(n_words, 1) as symbols, 1000 * n_dup_lines // greatest(n_lines, 1) as dup_lines,
             100 * word_chars // greatest(n_words, 1) as word_length from m),
    v as (
      select lk, sk, metric, v from (
        select lk, sk, unnest(['symbols', 'dup_lines', 'word_length']) as metric, unnest([symbols, dup_lines, word_length]) as v from b where not base_failed)),
    s as (
      select lk, sk, metric, (v >> greatest(length(bin(v)) - {BITS}, 0)::int) << greatest(length(bin(v)) - {BITS}, 0)::int as bucket, count(*) as n from v group by all),
    own as (select *, sum(n) over (partition by lk, sk, metric) as total from s),
    lang as (select *, sum(n) over (partition by lk, metric) as total from (select lk, metric, bucket, sum(n) as n from s group by all)),
    used as (
      select lk, sk, metric, bucket, n, total from own where total >= {LEAST_GROUP}
      union all
      select lang.lk, x.sk, lang.metric, lang.bucket, lang.n, lang.total from lang join (select distinct lk, sk from own where total < {LEAST_GROUP}) x on x.lk = lang.lk),
    cum as (select *, sum(n) over (partition by lk, sk, metric order by bucket) as upto from used),
    q as (
      select lk, sk, metric, min(bucket) filter (where 4 * upto >= total) as q1, min(bucket) filter (where 4 * upto >= 3 * total) as q3 from cum
      group by all having max(total) >= {LEAST_GROUP}),
    f as (
      select lk, sk, max(q3 + {REACH} * (q3 - q1) + {symbols}) filter (where metric = 'symbols') as s_most,
             max(q3 + {REACH} * (q3 - q1) + {dup_lines}) filter (where metric = 'dup_lines') as d_most,
             max(q3 + {REACH} * (q3 - q1) + {word_length}) filter (where metric = 'word_length') as w_most,
             max(q1 - {REACH} * (q3 - q1) - {word_length}) filter (where metric = 'word_length') as w_least from q group by all)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           not base_failed and coalesce(symbols <= s_most, true) and coalesce(dup_lines <= d_most, true)
           and coalesce(word_length between w_least and w_most, true) as kept
    from b left join f on b.lk = f.lk and b.sk = f.sk
    """
