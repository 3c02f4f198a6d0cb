"""Mixing sources to target weights by Poisson replication, with DataFrame functions alone.

Every document of a source is repeated a Poisson number of times. The mean is the source's target size over its
present size, so that in expectation the sources stand in the target proportions. The number is the inverse of the
distribution at a uniform value hashed from a seed and the id: runs agree, and a lost task repeats itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources whose sizes are broadcast (at most 64 bytes each or so); beyond, the sizes are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Parts that a source's documents are dealt to where its sizes are joined by a shuffle, as one source may hold a third of all.
SALTS = 32
#: Largest mean of one draw, as exp(-mean) is 0 for large ones; beyond, the sum of several draws is taken. Copies beyond
#: mean + 12 standard deviations + 30 have a probability below 1e-20.
LARGEST_MEAN = 500.0


def uniform(seed: int, *keys: Column) -> Column:
    """A value in [0, 1) from 52 bits of an MD5 of the seed and the keys."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("-")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def cumulated(mean: Column) -> Column:
    """The probabilities of at most 0, 1, 2 ... copies, for a mean of at most LARGEST_MEAN. The terms are summed from 0 up."""
    most = (mean + 12 * F.sqrt(mean) + 30).cast("int")
    zero = F.exp(-mean)
    start = F.struct(zero.alias("term"), zero.alias("sum"), F.array(zero).alias("sums"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * mean / i
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"), F.array_append(s["sums"], s["sum"] + term).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["sums"])


def intervals(means: DataFrame) -> DataFrame:
    """__source, __low, __high, __count for (__source, __mean): a uniform value in [low, high) means so many copies.

    Means are at most LARGEST_MEAN; the last interval ends above 1. Counts of 0 have no row.
    """
    rows = means.select("__source", cumulated(F.col("__mean")).alias("sums")).select("__source", "sums", F.posexplode(F.slice("sums", 2, 10_000)).alias("at", "__high"))
    low = F.element_at("sums", F.col("at") + 1)
    return rows.select("__source", low.alias("__low"), F.when(F.col("at") == F.size("sums") - 2, F.lit(2.0)).otherwise(F.col("__high")).alias("__high"), (F.col("at") + 1).alias("__count"))


def draws(means: DataFrame) -> DataFrame:
    """__source, __parts, __sums for (__source, __mean): so many draws of equal mean make up the mean, each by these sums.

    The sum of independent Poisson numbers is a Poisson number of the summed mean.
    """
    parts = F.ceil(F.col("__mean") / LARGEST_MEAN)
    rows = means.select("__source", parts.alias("__parts"), (F.col("__mean") / parts).alias("__mean"))
    return rows.select("__source", "__parts", cumulated(F.col("__mean")).alias("__sums"))


def rates(docs: DataFrame, weights: dict[str, float] | None, by: str, rows: float | None) -> tuple[DataFrame, DataFrame | None]:
    """The intervals of each source, whose mean is its target share of the whole over its own size; and the draws of those of larger means, if any."""
    size = F.count(F.lit(1)).cast("double") if by == "documents" else F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double")
    sizes = docs.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("__source")).agg(size.alias("__size"))
    known = sizes.limit(BROADCAST_SOURCES + 1).collect()
    if len(known) <= BROADCAST_SOURCES:
        size_of = {r[0]: r[1] for r in known if r[1]}
        share = {s: (1.0 if weights is None else float(weights.get(s, 0.0))) for s in size_of}
        whole, total = sum(size_of.values()) if rows is None else float(rows), sum(share.values())
        means = [(s, w / total * whole / size_of[s]) for s, w in share.items()] if total else []
        one, several = [docs.sparkSession.createDataFrame([m for m in means if (m[1] > LARGEST_MEAN) == large], "__source string, __mean double") for large in (False, True)]
        return F.broadcast(intervals(one)), F.broadcast(draws(several)) if any(m > LARGEST_MEAN for _, m in means) else None
    if weights is None:
        weighted = sizes.withColumn("__share", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "__source string, __share double")
        weighted = sizes.join(given, "__source")
    sums = weighted.agg(F.sum("__share").alias("t")).crossJoin(sizes.agg(F.sum("__size").alias("w"))).first()
    whole = sums["w"] if rows is None else float(rows)
    mean = F.col("__share") / F.lit(sums["t"]) * F.lit(whole) / F.col("__size")
    found = weighted.filter("__size > 0").select("__source", mean.alias("__mean"))
    several = found.filter(F.col("__mean") > LARGEST_MEAN)
    salted = lambda df: df.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted(intervals(found.filter(F.col("__mean") <= LARGEST_MEAN))), None if several.isEmpty() else salted(draws(several))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, by: str = "documents", rows: float | None = None, seed: int = 17) -> DataFrame:
    """Each document of docs (doc_id, text, source and any others) as often as its source's rate asks, in a random order.

    weights: target share of each source; sources not named get none. None: the same share for every source.
    by: what the shares are counted in, "documents" or "chars". rows: target size of the whole; None: as it is.
    Adds `copy` (from 1) and `shuffle_key`; columns of these names in docs are replaced. The copies are dealt to
    partitions by the key's hash and sorted by it there, which is a random order of the whole.
    A null source is the source "". Repeated rows share one count; a null id is replaced by a hash of the text. Null or empty texts are
    documents like others (by "chars", a source of only such texts has no size and goes). Means over LARGEST_MEAN
    are drawn in several parts, whose sum has the whole mean. An empty table gives an empty one.
    """
    given = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias("row"))  # as one column, so that no name of docs is met again
    key = F.coalesce(F.col("row")["doc_id"].cast("string"), F.md5(F.coalesce(F.col("row")["text"], F.lit("")).cast("binary")))
    drawn = docs.select("row", F.coalesce(F.col("row")["source"], F.lit("")).alias("__source"), uniform(seed, key).alias("__u"))
    docs = docs.select(F.col("row")["source"].alias("source"), F.col("row")["text"].alias("text"))
    one, several = rates(docs, weights, by, rows)
    drawn = drawn.withColumn("__part", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    same = lambda df: (F.col("__source") == F.col("__of")) & (F.col("__part") == F.col("__salt") if "__salt" in df.columns else F.lit(True))
    means = one.withColumnRenamed("__source", "__of")
    counted = drawn.join(means, same(one) & (F.col("__u") >= F.col("__low")) & (F.col("__u") < F.col("__high")))
    copies = counted.select("row", F.explode(F.sequence(F.lit(1), F.col("__count"))).alias("copy"))
    if several is not None:
        part = lambda i: F.size(F.filter(F.slice("__sums", 1, F.size("__sums") - 1), lambda p: p <= uniform(seed, F.col("__key"), i)))
        of_parts = drawn.withColumn("__key", key).join(several.withColumnRenamed("__source", "__of"), same(several))
        of_parts = of_parts.withColumn("__drawn", F.transform(F.sequence(F.lit(1), F.col("__parts").cast("int")), part))
        total = F.aggregate("__drawn", F.lit(0), lambda n, x: n + x)
        copies = copies.union(of_parts.withColumn("__count", total).filter("__count > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("__count"))).alias("copy")))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(f"order{seed}"), key, "copy")))
    dealt = keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "copy")
    return dealt.select(*[F.col("row")[c].alias(c) for c in given], "copy", "shuffle_key")


#: The query's statement: every source the same share, counted in documents. A mean over 500 is the sum of equal draws.
OP10_SQL = r"""
WITH RECURSIVE sizes AS (SELECT coalesce(source, '') s, count(*)::DOUBLE n FROM documents GROUP BY 1),
means AS (SELECT s, 1.0 / (SELECT count(*) FROM sizes) * (SELECT sum(n) FROM sizes) / n AS m FROM sizes),
parts AS (SELECT s, m / ceil(m / 500.0::DOUBLE) AS m, ceil(m / 500.0::DOUBLE)::INT AS parts FROM means),
rows AS (SELECT *, row_number() OVER () AS r, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS key FROM documents),
each AS (SELECT r, m, '17|' || key || CASE WHEN parts > 1 THEN '|' || part ELSE '' END AS seeded
  FROM rows JOIN parts ON coalesce(source, '') = s, LATERAL (SELECT unnest(generate_series(1, parts)) AS part)),
drawn AS (SELECT r, m, ('0x' || substr(md5(seeded), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM each),
steps(m, k, term, total) AS (
  SELECT DISTINCT m, 0, exp(-m), exp(-m) FROM parts
  UNION ALL SELECT m, k + 1, term * m / (k + 1), total + term * m / (k + 1) FROM steps WHERE k + 1 <= (m + 12 * sqrt(m) + 30)::INT),
bounded AS (SELECT m, k, CASE WHEN k = 0 THEN -1.0 ELSE lag(total) OVER (PARTITION BY m ORDER BY k) END AS low, CASE WHEN k = max(k) OVER (PARTITION BY m) THEN 2.0 ELSE total END AS high FROM steps),
counted AS (SELECT r, sum(k)::BIGINT AS n FROM drawn d JOIN bounded b ON d.m = b.m AND d.u >= b.low AND d.u < b.high GROUP BY r)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy, md5('order17|' || key || '|' || copy) AS shuffle_key
FROM rows JOIN counted USING (r), LATERAL (SELECT unnest(generate_series(1, n)) AS copy) WHERE n > 0
"""
