"""URL verdicts: listed rules first, and logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.llm.common import Named, ascii_lower, pieces, table

#: (host/path prefix, verdict).
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: Lengths of the n-grams, and hash slots for each of host and path.
SIZES, SLOTS = (2, 3, 4), 1 << 14
#: The labelled table is a bounded sample of so many different URLs at most.
LEARN_URLS = 4000
STEPS, RATE, DECAY = 300, 8.0, 1e-5


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule whose host is the URL's or a parent domain of it and whose path
    starts the URL's path; nulls if none fits. Rules of one length are tried in alphabetical order."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(sorted(rules, reverse=True), key=lambda r: len(r[0])):  # the last that fits stands
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        name, verdict = F.when(fits, text).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every n-gram of the hosts and paths, each with its ends marked."""
    rows, slots = [], []
    for part, texts in enumerate((hosts, paths)):
        marked = [b"\x02" + t.encode() + b"\x03" for t in texts]
        lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        row = np.repeat(np.arange(len(marked)), lengths)
        flat = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
        for n in SIZES:
            if len(flat) < n:
                continue
            h = np.full(len(flat) - n + 1, part * 16 + n, np.uint64)
            for j in range(n):
                h = (h ^ flat[j : len(flat) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            inside = row[: len(h)] == row[n - 1 :]
            rows.append(row[: len(h)][inside])
            slots.append((h[inside] % np.uint64(SLOTS)).astype(np.int64) + part * SLOTS)
    return (np.concatenate(rows), np.concatenate(slots)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


class Model:
    """Weights of the slots and a bias; a URL's n-grams weigh 1 / sqrt(their number) each."""

    def __init__(self):
        self.weights, self.bias = np.zeros(2 * SLOTS), 0.0

    @staticmethod
    def scaled(hosts, paths):
        rows, slots = features(hosts, paths)
        counts = np.bincount(rows, minlength=len(hosts))
        return rows, slots, 1 / np.sqrt(np.maximum(counts, 1))[rows]

    def fit(self, hosts: list[str], paths: list[str], blocked: list[bool]) -> Model:
        """Full-batch gradient descent from zero: the same for the same table."""
        if not hosts:
            return self
        rows, slots, values = self.scaled(hosts, paths)
        y = np.array(blocked, float)
        for _ in range(STEPS):
            off = (self._chance(rows, slots, values, len(y)) - y) / len(y)
            self.weights -= RATE * (np.bincount(slots, values * off[rows], 2 * SLOTS) + DECAY * self.weights)
            self.bias -= RATE * off.sum()
        return self

    def _chance(self, rows, slots, values, n):
        return 1 / (1 + np.exp(-np.clip(self.bias + np.bincount(rows, values * self.weights[slots], n), -60, 60)))

    def chance(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """The chance that each URL is to be blocked."""
        return self._chance(*self.scaled(hosts, paths), len(hosts))


def learn(labelled: DataFrame) -> Model:
    """A model from a labelled table (host, path, verdict), of which at most LEARN_URLS different rows, those
    with the smallest hashes, are used. Without rows, every chance is a half and nothing is blocked."""
    sample = labelled.select("host", "path", "verdict").distinct().orderBy(F.xxhash64("host", "path", "verdict"), "host", "path", "verdict").limit(LEARN_URLS).collect()
    return Model().fit([r["host"] for r in sample], [r["path"] for r in sample], [r["verdict"] == "block" for r in sample])


def judge(pages: DataFrame, model: Model, url_col: str = "url", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """pages with host, path, rule, verdict and block_score, the model's chance; columns with these names are replaced,
    others may have any name. A null URL, or one without ://, has an empty host and path, which no rule fits. URLs of any
    length are read whole and one by one: repeated rows get equal verdicts, and an empty table gives an empty one."""
    import pyarrow as pa

    added = ["host", "path", "rule", "verdict", "block_score"]
    own = Named(pages, *added)
    url, inside = F.col(own.at(url_col)), own.inside
    rows = own.df.select(*inside, host(url).alias("host"), path(url).alias("path"))
    found = rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": found[0], "verdict": found[1]}).withColumn("both", F.concat("host", "path").cast("binary"))
    n = len(inside)

    def run(batches):
        for batch in batches:
            for first, part in pieces(batch, n + 4, 500_000):
                columns = [c.slice(first, len(part)) for c in batch.columns[: n + 4]]
                chance = model.chance(columns[n].to_pylist(), columns[n + 1].to_pylist())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(chance, pa.float64())], names=[*inside, *added])

    out = rows.mapInArrow(run, own.schema(*[(c, T.StringType()) for c in added[:4]], ("block_score", T.DoubleType())))
    verdict = F.coalesce("verdict", F.when(F.col("block_score") > 0.5, "block").otherwise("allow"))
    return own.back(out, "host", "path", "rule", verdict.alias("verdict"), "block_score")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table is a bounded sample of the URLs that the rules decide. Nulls and ties as in judge()."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    own = pages.select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    labelled = own.withColumn("verdict", rule(F.col("host"), F.col("path"))[1]).where("verdict is not null")
    return judge(pages, learn(labelled)).select("page_id", "host", "path", "rule", "verdict", "block_score")
