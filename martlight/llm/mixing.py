"""Mixing sources to target weights by Poisson replication.

Every source has a mean repetition rate: its target share of the characters times all characters, over the
characters it has.  A hash of the document is taken as a uniform number, the Poisson distribution with that mean is
inverted at it, and the document is repeated so many times.  Copies are then dealt out and ordered by a second hash.

Nothing is drawn at run time: a lost task gives the same copies again, and the same seed the same corpus.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlight.llm.base import columns_of, join_rates, key_of, table
from martlight.session import stable

#: Means above this are cut into equal parts whose counts add up (a sum of Poisson counts is Poisson again).
PART_MEAN = 16
#: Steps of the distribution; beyond, the probability is under 2^-60 for means up to PART_MEAN.
STEPS = 64


def _uniform(*parts: Column | str) -> Column:
    """52 bits of an MD5 as a double in [0, 1)."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mean_rates(sizes: DataFrame, temperature: float, weights: Mapping[str, float] | None) -> DataFrame:
    """One row per source: key, number of parts, cumulative probabilities of one part."""
    if weights is None:
        units = F.round(F.pow(F.col("size").cast("double"), F.lit(temperature)) * 1000).cast("long")
    else:
        given = F.create_map(*(F.lit(x) for k, v in weights.items() for x in (f"={k}", round(v * 1_000_000))))
        units = F.coalesce(F.try_element_at(given, F.col("key")), F.lit(0)).cast("long")
    sizes = sizes.withColumn("units", units)
    total = sizes.agg(F.sum("size").alias("size"), F.sum("units").alias("units")).first()
    share = F.col("units").cast("double") / F.lit(float(total["units"] or 1))
    rate = share * F.lit(float(total["size"] or 0)) / F.col("size").cast("double")
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_MEAN)).cast("int")
    zero = F.exp(-F.col("mean"))
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)),
        F.struct(zero.alias("p"), F.array(zero).alias("c")),
        lambda a, i: F.struct(
            (a["p"] * F.col("mean") / i.cast("double")).alias("p"),
            F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * F.col("mean") / i.cast("double"))).alias("c"),
        ),
    )["c"]
    return (
        sizes.withColumn("rate", rate)
        .withColumn("parts", parts)
        .withColumn("mean", F.col("rate") / F.col("parts").cast("double"))
        .select("key", "parts", steps.alias("steps"))
    )


def _hashable(field: T.StructField) -> Column:
    """The column, or its JSON where it holds what Spark does not hash."""
    column = F.col(f"`{field.name}`")
    kind = field.dataType.simpleString()
    return F.to_json(F.struct(column)) if "map<" in kind or "variant" in kind else column


def poisson_mix(
    docs: DataFrame,
    *,
    by: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    temperature: float = 0.5,
    weights: Mapping[str, float] | None = None,
    seed: int = 42,
) -> DataFrame:
    """The rows of ``docs``, each repeated by its Poisson count, in a global random order.

    Adds ``copy`` (from 1) and ``shuffle_key``; input columns of these names are replaced.  A document's size is its
    characters plus one, so that null and empty texts count; null sources are a source of their own.  ``weights`` gives
    target shares by source (a source it leaves out has share 0); without it a source's share grows with its size to
    the power ``temperature``.  Repeated rows with one id get the same count; a row without id is drawn and dealt out
    by a hash of its other columns.
    Sources of any number and size are allowed: rates are summed before they meet the documents, and the exchange is on
    a hash of the single copy.
    """
    own = docs.drop("copy", "shuffle_key")
    # The caller's columns travel in one struct, so that none can clash with those made here.
    rest = F.xxhash64(*(_hashable(f) for f in own.schema)).cast("string")
    keyed = own.select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("row "), rest)).alias("_name"),
        key_of(by).alias("_key"),
        F.col(f"`{text_col}`").alias("_text"),
        F.struct(*(F.col(f"`{c}`") for c in own.columns)).alias("_row"),
    )
    sizes = stable(
        keyed.select(F.col("_key").alias("key"), (F.coalesce(F.length("_text"), F.lit(0)) + 1).cast("long").alias("n"))
        .groupBy("key")
        .agg(F.sum("n").alias("size"))
    )
    rates = mean_rates(sizes, temperature, weights).select(
        F.col("key").alias("_key"), F.col("parts").alias("_parts"), F.col("steps").alias("_steps")
    )
    name = F.col("_name")
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("_parts")),
        F.lit(0),
        lambda a, i: a
        + F.size(F.filter("_steps", lambda c: c <= _uniform(F.lit(str(seed)), name, i.cast("string")))),
    )
    copies = (
        join_rates(keyed.drop("_text"), rates, "_key", sizes.count())
        .withColumn("_count", count)
        .where("_count > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_count"))))
    )
    digest = F.md5(F.concat_ws("|", F.lit(f"order {seed}"), name, F.col("copy").cast("string")))
    return (
        copies.select(
            *(F.col("_row").getField(c).alias(c) for c in own.columns),
            "copy",
            F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("shuffle_key"),
        )
        .repartition("shuffle_key")
        .sortWithinPartitions("shuffle_key")
    )


def op1_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = columns_of(table(spark, sf_dir, "documents"), {c: c for c in ("doc_id", "text", "lang", "source", "n_chars")})
    return poisson_mix(docs)


def mix_sql(documents: str, columns: str, seed: int = 42, temperature: float = 0.5) -> str:
    """DuckDB statement of :func:`poisson_mix` over a table with doc_id, source and text.

    It holds for rows with an id; those without are drawn by Spark's hash of the row, which DuckDB does not have.
    """
    return f"""
    WITH RECURSIVE sizes AS (
        SELECT coalesce('=' || source, '') AS key, sum(coalesce(length(text), 0) + 1)::BIGINT AS size
        FROM {documents} GROUP BY 1
    ), units AS (
        SELECT key, size, round(pow(size::DOUBLE, {temperature}) * 1000)::BIGINT AS units FROM sizes
    ), rates AS (
        SELECT key, units::DOUBLE / (SELECT sum(units)::DOUBLE FROM units)
            * (SELECT sum(size)::DOUBLE FROM units) / size::DOUBLE AS rate FROM units
    ), parts AS (
        SELECT key, greatest(1, ceil(rate / {PART_MEAN}))::INTEGER AS parts,
            rate / greatest(1, ceil(rate / {PART_MEAN}))::DOUBLE AS mean FROM rates
    ), steps(key, k, p, c) AS (
        SELECT key, 0, exp(-mean), exp(-mean) FROM parts
        UNION ALL
        SELECT s.key, s.k + 1, s.p * mean / (s.k + 1)::DOUBLE, s.c + s.p * mean / (s.k + 1)::DOUBLE
        FROM steps s JOIN parts USING (key) WHERE s.k < {STEPS}
    ), tables AS (
        SELECT key, list(c ORDER BY k) AS steps FROM steps GROUP BY key
    ), counted AS (
        SELECT d.*, list_sum(list_transform(range(1, parts + 1), lambda i: len(list_filter(steps,
            lambda c: c <= ('0x' || md5('{seed}|' || coalesce(doc_id::VARCHAR, '') || '|' || i::VARCHAR)[1:13])::BIGINT::DOUBLE
                / {1 << 52}.0::DOUBLE))))::BIGINT AS n_copies
        FROM {documents} d JOIN parts ON parts.key = coalesce('=' || d.source, '')
        JOIN tables ON tables.key = parts.key
    ), copies AS (
        SELECT *, unnest(range(1, n_copies + 1))::INTEGER AS copy FROM counted
    )
    SELECT {columns}, copy,
        ('0x' || md5('order {seed}|' || coalesce(doc_id::VARCHAR, '') || '|' || copy::VARCHAR)[1:15])::BIGINT AS shuffle_key
    FROM copies"""


QUERIES = {"op1_poisson_mixing": op1_poisson_mixing}
SQL = {"op1_poisson_mixing": mix_sql("documents", "doc_id, text, lang, source, n_chars")}
