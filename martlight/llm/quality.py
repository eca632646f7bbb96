"""Quality rules, the method's own being compression bands.

Text that repeats itself compresses far better than prose, random text hardly at all.  The ratio of bytes before and
after zstandard is taken over the whole document and over fixed chunks; limits depend on the length, since a longer
text gives the compressor more to refer to.  A low ratio alone does not tell noise from text in another alphabet, so it
is held against the entropy of single bytes too.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession

from martlight.llm.base import columns_of, map_slices, table

LEVEL = 3
CHUNK = 4096
#: Bytes up to which a band reaches, and the lowest and highest ratio that stay.  Letters and digits drawn at random have
#: at most 1.13, 1.23, 1.32, 1.38 and 1.40 at 0.3, 0.5, 1, 4 and 600 kB, random lower-case words 1.62, 1.69 and 1.72 at 1,
#: 4 and 600 kB, spaced hexadecimal 1.94.  Licence and copyright files and source code have at least 1.19, 1.34, 1.49 and
#: 1.70 at 0.3, 0.5, 1 and 2 kB, and at most 3.8, 4.8, 5.9, 5.9, 6.7 and 7.9 at 0.5, 1, 2, 4, 8 and 16 kB.  Under 256
#: bytes text and noise overlap, so nothing is too low there.
BANDS = (
    (128, 0.0, 3.2),
    (256, 0.0, 3.5),
    (384, 1.18, 4.0),
    (512, 1.30, 4.3),
    (768, 1.36, 4.8),
    (1024, 1.45, 5.3),
    (1536, 1.60, 6.0),
    (2048, 1.75, 6.3),
    (3072, 1.82, 6.5),
    (4096, 1.92, 6.5),
    (8192, 1.98, 7.5),
    (16_384, 2.0, 8.5),
    (1 << 62, 2.0, 9.0),
)
#: Bytes that zstandard adds to what a code for single bytes needs (frame and table), and the margin over noise.
OVERHEAD, MARGIN = 70, 1.01
#: Bytes from which text in scripts beyond ASCII stands out from noise.
OTHER_SCRIPTS = 750
#: Share of a document's chunks outside their band from which the document goes.
BAD_CHUNKS = 0.5

SYMBOLS = re.compile(r"[#*$%&|<>]")


def band(n_bytes: int) -> tuple[float, float]:
    return next((low, high) for most, low, high in BANDS if n_bytes <= most)


def entropy(data: bytes) -> float:
    """Bits a byte that a code for single bytes needs."""
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    shares = counts[counts > 0] / len(data)
    return float(-(shares * np.log2(shares)).sum())


def is_noise(data: bytes, ratio: float) -> bool:
    """Whether the compressor finds nothing in ``data`` but the frequencies of its bytes.

    Random text of any alphabet comes out ``OVERHEAD`` bytes above its entropy, text shorter.  ASCII must lie under its
    band too, since short prose has little to refer back to.  Characters of several bytes have lower ratios, which no
    band fits, so their texts go by the entropy alone, from ``OTHER_SCRIPTS`` bytes on.  Alphabets of some thirty letters in
    two bytes give the compressor pairs by chance: noise in them passes.
    """
    size = len(data)
    is_ascii = data.isascii() or 2 * int((np.frombuffer(data, dtype=np.uint8) < 128).sum()) >= size
    if is_ascii and ratio >= band(size)[0] or not is_ascii and size < OTHER_SCRIPTS:
        return False
    return ratio * entropy(data) / 8 < MARGIN * size / (size + OVERHEAD)


def compression(text: str, compressor: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Ratio of the whole text, share of chunks outside their band, and whether the bands let it pass."""
    data = text.encode("utf-8", "replace")
    if not data:
        return 0.0, 0.0, False

    def ratio(part: bytes) -> float:
        return len(part) / len(compressor.compress(part))

    def outside(part: bytes, value: float) -> bool:
        return value > band(len(part))[1] or is_noise(part, value)

    whole = ratio(data)
    chunks = [data[at : at + CHUNK] for at in range(0, len(data), CHUNK)] if len(data) > CHUNK else []
    bad = sum(outside(c, ratio(c)) for c in chunks) / len(chunks) if chunks else 0.0
    return whole, bad, not outside(data, whole) and bad < BAD_CHUNKS


def repeated_words(words: list) -> int:
    """Words in five-word windows that occur twice or more, the first included."""
    if len(words) < 6:
        return 0
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    hits = np.fromiter((counts[w] > 1 for w in windows), dtype=bool, count=len(windows)).nonzero()[0]
    np.add.at(edges, hits, 1)
    np.add.at(edges, hits + 5, -1)
    return int((np.cumsum(edges) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; null counts as empty."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()  # splits bytes at \x20 and \x09-\x0D only
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    return len(words), chars, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated_words(words)


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, compression ratio, share of bad chunks, and whether it is kept.

    A document fails the base rules with under ten words or over a fifth of its words in repeated windows; it is kept
    if it passes them and its ratios lie inside the bands for its length.  Null and empty texts fail.  Each text is
    judged whole and by itself: no exchange, and no state but one slice of texts.
    """

    def start():
        compressor = zstandard.ZstdCompressor(level=LEVEL)

        def handle(columns):
            rows = []
            for text in columns[1]:
                counts = base_counts(text)
                failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
                whole, bad, passes = compression(text or "", compressor)
                rows.append((*counts, failed, not failed and passes, whole, bad))
            return [columns[0], *map(list, zip(*rows, strict=True))] if rows else [[]] * 10

        return handle

    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, ratio double, bad_chunks double"
    )
    return map_slices(columns_of(docs, {"doc_id": id_col, "text": text_col}), None, schema, start=start)


def op3_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


QUERIES = {"op3_compression_quality": op3_compression_quality}
SQL: dict[str, str] = {}
