"""SimHash near-duplicates found by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments.  Of two fingerprints that differ in at most two bits, one segment
differs in at most one, so both have a common variant of that segment with one bit taken out: 2 x 32 variants per
distinct fingerprint are indexed, joined by equality and verified.  Cutting into two instead of the usual three leaves
keys of 31 bits, which unrelated fingerprints seldom share.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martlight.llm.base import columns_of, map_slices, table
from martlight.llm.components import components
from martlight.llm.nearcopies import near_copies
from martlight.session import stable

SEED = 42
BITS = 64
SEGMENT = 32
#: Fingerprints in one variant up to which its pairs are compared one by one; fuller ones go by :func:`_crowded`.
BUCKET = 128


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bits set in over half of the hashes of the word shingles; zero without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    spans = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, spans)], dtype=">u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` with the fingerprint as a signed long; null and empty texts have 0."""
    texts = columns_of(docs, {"doc_id": id_col, "text": text_col})
    return map_slices(texts, lambda c: [c[0], [fingerprint(t) for t in c[1]]], "doc_id long, fp long")


def _variants(fps: DataFrame) -> DataFrame:
    """``key, fp``: segment, place of the bit taken out, and the other 31 bits, in one long."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", SEGMENT)
    place = F.explode(F.sequence(F.lit(0), F.lit(2 * SEGMENT - 1)))
    return (
        fps.select("fp", low.alias("low"), high.alias("high"), place.alias("place"))
        .withColumn("segment", F.when(F.col("place") < SEGMENT, F.col("low")).otherwise(F.col("high")))
        .withColumn("bit", F.expr(f"shiftleft(1L, place % {SEGMENT})"))
        .select(F.expr(f"shiftleft(cast(place as bigint), {SEGMENT}) | (segment & ~bit)").alias("key"), "fp")
    )


def _first_shared(bits: int) -> Column:
    """Whether this key is the first one a pair shares, so that each pair comes out of one bucket only."""
    xor = F.col("a").bitwiseXOR(F.col("b"))
    low = xor.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(xor, SEGMENT)
    place = F.shiftrightunsigned("key", SEGMENT)
    return (F.bit_count(xor) <= bits) & (
        place == F.when(F.bit_count(low) <= 1, _place(low)).otherwise(_place(high) + SEGMENT)
    )


def _place(segment: Column) -> Column:
    """Place of the only bit of a segment; 0 of an empty one."""
    return F.when(segment == 0, F.lit(0)).otherwise(F.bit_count(segment - 1))


def _crowded(fps: DataFrame) -> DataFrame:
    """Links between fingerprints of crowded variants, without comparing pairs.

    With two bits taken out, all fingerprints of one key are within distance two of each other and there are at most
    four; each is linked to the smallest.  2,016 keys per fingerprint: linear, whatever the crowd.
    """
    two = [(1 << i) | (1 << j) for i in range(BITS) for j in range(i)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in two]
    masks = F.array(*(F.lit(m) for m in signed))
    spread = fps.repartition("fp").select("fp", F.explode(masks).alias("mask"))
    least = spread.groupBy("mask", F.expr("fp & ~mask").alias("rest")).agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.collect_set("fp").alias("all"))
    return least.where("a < z").select("a", F.explode("all").alias("b")).where("a < b").distinct()


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """``a, b``: pairs of distinct fingerprints within two bits.

    Pairs inside a crowded variant are given as links to a smallest member within two bits; the components
    are the same.  ``fps`` has one row per distinct fingerprint.
    """
    if bits != 2:
        raise ValueError("two segments with one bit taken out find distances up to 2")
    variants = _variants(fps)
    sizes = variants.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stable(variants.join(sizes, "key"))
    few, many = shared.where(F.col("n") <= BUCKET), shared.where(F.col("n") > BUCKET)
    left = few.select("key", F.col("fp").alias("a"))
    right = few.select("key", F.col("fp").alias("b"))
    pairs = left.join(right, (left["key"] == right["key"]) & (F.col("a") < F.col("b"))).select(left["key"], "a", "b")
    found = pairs.where(_first_shared(bits)).select("a", "b")
    crowd = many.select("fp").distinct()
    return found.unionByName(_crowded(crowd)) if not many.isEmpty() else found


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id``: one row per row of ``docs``.

    ``component_id`` is the smallest id among documents joined by links of at most two bits (equal fingerprints
    included); ids may be null and are then left out of the minimum.  Copies are reduced to distinct fingerprints
    before anything is joined.  A fingerprint that a third of all documents share is summed and joined back per salt.
    """
    docs_fp = fingerprints(docs, id_col=id_col, text_col=text_col)
    docs_fp = stable(docs_fp.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int")))
    parts = stable(docs_fp.groupBy("fp", "salt").agg(F.min("doc_id").alias("least")))
    each = parts.groupBy("fp").agg(F.min("least").alias("least"))
    roots = stable(components(links(stable(each.select("fp")))))
    rooted = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "component_id")
    by_part = parts.select("fp", "salt").join(by_fp, "fp")
    return docs_fp.join(by_part, ["fp", "salt"]).select("doc_id", "fp", "component_id")


def fingerprint_pairs(texts: DataFrame) -> DataFrame:
    """``a, b``: pairs of ``node, text`` rows whose fingerprints are linked, as stars around one text per fingerprint."""
    fps = stable(fingerprints(texts, id_col="node").toDF("node", "fp").distinct())
    one = stable(fps.groupBy("fp").agg(F.min("node").alias("b")))
    equal = fps.join(one, "fp").where("node <> b").select(F.col("node").alias("a"), "b")
    near = links(one.select("fp")).toDF("fp", "other")
    near = near.join(one.toDF("fp", "a"), "fp").join(one.toDF("other", "b"), "other").select("a", "b")
    return equal.unionByName(near)


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component of near copies: the one with its smallest id.

    Near copies share 0.8 of their five-word shingles (:mod:`nearcopies`).  Pairs within two bits of SimHash are the first
    to be verified; these find little more than equal texts, so chosen paths look for what they miss.  Of rows with the same id one stays, the first by a hash of the row.  Rows without id cannot be named by a
    component and are kept as they are.
    """
    classes = near_copies(docs.where(F.col(f"`{id_col}`").isNotNull()), id_col=id_col, text_col=text_col, first=fingerprint_pairs)
    kept = classes.where("doc_id = component_id").select("doc_id").distinct()
    # The row is nested, so that no name of its columns can clash.
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"))
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(F.to_json("row")))
    one = rows.join(kept, "doc_id", "left_semi").withColumn("place", F.row_number().over(order)).where("place = 1")
    return one.select("doc_id", "row").unionByName(rows.where("doc_id IS NULL")).select("row.*")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash_dedup": op2_simhash_dedup}
SQL: dict[str, str] = {}
