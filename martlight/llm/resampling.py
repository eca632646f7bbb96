"""Importance resampling towards a target distribution, with n-grams found by overlapped regex scanning.

Separators of a text are collapsed to single spaces; one pattern per length then matches so many words between two
borders.  ``finditer(overlapped=True)`` tries the next match one place further, and the border look-behind lets it begin
at a word only, so every n-gram comes out once as a span of the text, without lists of words.  Spans are counted by the
CRC of their bytes modulo a number of buckets.  Counts over the whole corpus and the whole target give each bucket a
gain; a document's weight is the mean gain of its n-grams, and Gumbel noise makes the highest scores a sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlight.llm.base import columns_of, map_slices, table
from martlight.operators.ordering import ordered_prefix
from martlight.session import stable

#: Bytes of a word: digits, small letters, and all of a character beyond ASCII.
SEPARATORS = regex.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BUCKETS = 10_000
SEED = 2024


def patterns(longest: int) -> list[regex.Pattern]:
    """One pattern per number of words, with a border on both sides."""
    return [regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1)) for n in range(1, longest + 1)]


def collapse(text: str | None) -> bytes:
    """The text's words with A-Z in lower case, one space between them."""
    return SEPARATORS.sub(b" ", (text or "").encode("utf-8", "replace").lower()).strip(b" ")


def spans(words: bytes, longest: int) -> Iterator[tuple[int, int]]:
    """Start and end of every run of 1 to ``longest`` words in a collapsed text, by length, then place."""
    for pattern in patterns(longest):
        for found in pattern.finditer(words, overlapped=True):
            yield found.span()


def feature_buckets(words: bytes, scan: list[regex.Pattern], buckets: int) -> np.ndarray:
    """Bucket of every n-gram of a collapsed text."""
    crcs = (crc32(found[0]) for pattern in scan for found in pattern.finditer(words, overlapped=True))
    return np.fromiter(crcs, dtype=np.uint32) % np.uint32(buckets)


def bucket_counts(docs: DataFrame, *, text_col: str = "text", longest: int = 2, buckets: int = BUCKETS) -> np.ndarray:
    """n-grams per bucket over all texts.  A task sends one row per bucket; the driver receives ``buckets`` numbers."""
    texts = columns_of(docs, {"text": text_col})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, total = patterns(longest), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(feature_buckets(collapse(text.as_py()), scan, buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    counts = np.zeros(buckets, dtype=np.int64)
    for row in texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm by which a bucket is likelier in the target, both smoothed by one."""
    size = len(corpus)
    above = (target + 1).astype(float) * float(corpus.sum() + size)
    below = (corpus + 1).astype(float) * float(target.sum() + size)
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def weigh(
    docs: DataFrame,
    gain: np.ndarray,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    longest: int = 2,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` and a hash of the text per row, with the columns ``keep`` behind them in a
    struct ``kept``."""
    own = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{text_col}`").alias("text"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"),
        *([F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept")] if keep else []),
    )
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    kept_type = f", kept {own.schema['kept'].dataType.simpleString()}" if keep else ""

    def start():
        scan, gain = patterns(longest), shared.value

        def handle(columns):
            words = [collapse(t) for t in columns[1]]
            found = [feature_buckets(w, scan, len(gain)) for w in words]
            weights = [int(gain[f].sum()) // len(f) if len(f) else 0 for f in found]
            sizes = [w.count(b" ") + 1 if w else 0 for w in words]
            return [columns[0], columns[2], sizes, [len(f) for f in found], weights, *columns[3:]]

        return handle

    return map_slices(own, None, f"doc_id long, text_hash long, n_words long, n_features long, weight long{kept_type}", start=start)


def noise(seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise from a hash of the id; of the text for a row without id."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("text_hash").cast("string")))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), name).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 32))
    return F.floor(F.lit(-1000.0) * F.log(-F.log(uniform))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    longest: int = 2,
    buckets: int = BUCKETS,
    percent: int = 10,
    least_words: int = 20,
    seed: int = SEED,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Every row of ``docs`` as ``doc_id, n_words, n_features, weight, score, rank`` and the columns ``keep``.

    ``rank`` is 1, 2, 3... down the scores for the ``percent`` hundredths (floored) of the documents of ``least_words``
    or more that are drawn, null otherwise; equal scores go by id, then by a hash of the text.  A text without words, empty
    or null, has weight 0 and is never drawn.  Repeated rows are ranked each.  Input columns of the result's names are
    kept only if they are the id or listed in ``keep``, where they come back under their own name with ``kept_`` before
    it if it clashes.  Texts are read twice, for the counts and for the weights; the ranks come from one exchange of
    narrow rows, in ranges, so no task orders all.
    """
    gain = gains(
        bucket_counts(docs, text_col=text_col, longest=longest, buckets=buckets),
        bucket_counts(target, text_col=target_col, longest=longest, buckets=buckets),
    )
    weighed = weigh(docs, gain, id_col=id_col, text_col=text_col, longest=longest, keep=keep)
    scored = stable(weighed.withColumn("score", F.col("weight") + noise(seed)))
    able = (F.col("n_words") >= least_words).alias("able")
    drawn = scored.where(able).count() * percent // 100
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("text_hash")]
    placed = ordered_prefix(scored.withColumn("able", able), order)
    rank = F.when(F.col("position") <= drawn, F.col("position"))
    names = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    again = [F.col(f"kept.`{c}`").alias(f"kept_{c}" if c in names else c) for c in keep]
    return placed.withColumn("rank", rank).select(*names, *again)


def op12_regex_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resample(docs, target, longest=1).select("doc_id", "n_features", "weight", "score", "rank")


def resample_sql(documents: str, target: str, percent: int = 10, least_words: int = 20, seed: int = SEED) -> str:
    """DuckDB statement of :func:`resample` for single words; the CRC is taken byte by byte over the distinct words."""
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""
    WITH RECURSIVE rounds(byte, i, c) AS (
        SELECT range, 0, range FROM range(256)
        UNION ALL
        SELECT byte, i + 1, {step} FROM rounds WHERE i < 8
    ), steps AS (
        SELECT list(c ORDER BY byte) AS steps FROM rounds WHERE i = 8
    ), docs AS (
        SELECT row_number() OVER () AS row, doc_id, coalesce({words}, []) AS words FROM {documents}
    ), found AS (
        SELECT row, unnest(words) AS word FROM docs
    ), wanted AS (
        SELECT unnest({words}) AS word FROM {target}
    ), lexicon AS (
        SELECT word, hex(encode(word)) AS code FROM (SELECT word FROM found UNION SELECT word FROM wanted)
    ), crcs AS (
        SELECT word, xor(list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(range(1, length(code), 2), lambda i: ('0x' || code[i:i + 1])::BIGINT)),
            lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
        FROM lexicon, steps
    ), corpus AS (
        SELECT bucket, count(*) AS s FROM found JOIN crcs USING (word) GROUP BY 1
    ), goal AS (
        SELECT bucket, count(*) AS t FROM wanted JOIN crcs USING (word) GROUP BY 1
    ), gain AS (
        SELECT bucket, floor(1000 * ln(
            ((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM found) + {BUCKETS})::DOUBLE)
            / ((s + 1)::DOUBLE * ((SELECT count(*) FROM wanted) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
        FROM corpus LEFT JOIN goal USING (bucket)
    ), weights AS (
        SELECT row, count(*) AS n, sum(gain)::BIGINT AS gain FROM found JOIN crcs USING (word) JOIN gain USING (bucket) GROUP BY 1
    ), scored AS (
        SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(floor(gain::DOUBLE / n), 0)::BIGINT AS weight,
            ('0x' || sha256('{seed}:' || doc_id)[1:8])::BIGINT AS h
        FROM docs LEFT JOIN weights USING (row)
    ), totals AS (
        SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296.0::DOUBLE))))::BIGINT AS score FROM scored
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY n_features >= {least_words} ORDER BY score DESC, doc_id) AS place,
            count(*) FILTER (n_features >= {least_words}) OVER () AS able FROM totals
    )
    SELECT doc_id, n_features, weight, score,
        CASE WHEN n_features >= {least_words} AND place <= able * {percent} // 100 THEN place END AS rank
    FROM ranked"""


QUERIES = {"op12_regex_resampling": op12_regex_resampling}
SQL = {"op12_regex_resampling": resample_sql("documents", "benchmark")}
