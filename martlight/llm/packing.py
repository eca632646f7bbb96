"""Packing documents into training sequences by minimum bin slack.

A document is encoded once, in a task of its own partition.  Whole windows of ``length`` ids fill a sequence each; what
remains is shorter than a sequence, and these remainders are combined.  For the longest remainder left, a dynamic
program over a bitset of reachable sums picks the multiset of remaining lengths that fills the sequence closest to its
capacity; counts are traced back through the bitsets, and the multiset is used again as long as the counts last.

Only ids of pieces and lengths are exchanged, never texts or tokens.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from martlight.llm.base import columns_of, map_slices, table, worker_store

LENGTH = 2048
END = 1
#: Remainders packed together; those that leave slack wait for the next window.
WINDOW = 32_768
#: Words whose ids a worker remembers since its memory was last renewed; as many older ones are kept beside them.
WORDS = 300_000


# --- tokens -----------------------------------------------------------------

#: The pre-tokens of the vocabulary file, as it states them.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Whether the machine's own unsigned integers are already the bytes that are asked for.
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
#: White space besides the blank at which a text may be cut without any effect on its tokens.
GAPS = "\t\n\r"
#: Words of these characters are lower-cased character by character alike everywhere.
PLAIN = re.compile(r"[\x21-\x7e\xa1-\xac\xae-\xff]+")


class Memory(dict):
    """Values by key, made where they are missing.

    At ``size`` entries a new generation begins; the last one is still asked, so that frequent keys stay while no more
    than twice ``size`` are held.  It changes no value, only how often one is made anew.
    """

    def __init__(self, make: Callable[[str], bytes], size: int):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class WordEncoder:
    """Ids of a text with the word-ending BPE file: words are encoded once and remembered.

    Lower-casing, composition and pre-tokens never reach across white space, so the ids of a text are those of its
    words in a row.  Words of Latin-1 are split here and merged by the library's model; others, and texts that hold a
    special token, go through the library whole.  Ids are kept as little-endian unsigned 32-bit bytes, ready to be joined.
    """

    def __init__(self, path: str, words: int = WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words, self.pieces = Memory(self._word, words), Memory(self._piece, words)
        # Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = (b for b in range(256) if b not in set(printable))
        self.byte = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}

    def whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else "".join([self.byte[b] for b in piece.encode()])
        return packed([t.id for t in self.model.tokenize(mapped)])

    def _word(self, word: str) -> bytes:
        if not word:
            return b""
        if not PLAIN.fullmatch(word):
            return self.whole(word)
        lower = unicodedata.normalize("NFC", word).lower()
        if lower.isalpha():
            return packed([t.id for t in self.model.tokenize(lower)]) if lower.isascii() else self._piece(lower)
        return b"".join(map(self.pieces.__getitem__, PRE_TOKEN.findall(lower)))

    def __call__(self, text: str) -> list[int]:
        return np.frombuffer(self.joined(text), dtype="<u4").tolist()

    def joined(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        for gap in GAPS:
            text = text.replace(gap, " ")
        return b"".join(map(self.words.__getitem__, text.split(" ")))


def packed(ids: Sequence[int]) -> bytes:
    return array("I", ids).tobytes() if LITTLE else np.array(ids, dtype="<u4").tobytes()


_ENCODERS: dict[str, WordEncoder] = worker_store("packing")


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process, so that its words outlive a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces_of(docs: DataFrame, encode: Callable[[], WordEncoder], length: int = LENGTH, end: int = END,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row_no, doc_tokens, crcs``: checksums of the pieces of ``length`` ids and of the remainder.

    ``encode`` makes the encoder in the worker; it gives the ids of a text as bytes.  The row number is that of the task; it only spreads repeated rows.
    """

    def start():
        ids_of, row, step, last = encode().joined, 0, 4 * length, packed([end])

        def handle(columns):
            nonlocal row
            tokens, crcs = [], []
            for text in columns[1]:
                ids = memoryview((ids_of(text) if text else b"") + last)
                tokens.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[at : at + step]) for at in range(0, len(ids), step)])
            rows = list(range(row, row + len(tokens)))
            row += len(tokens)
            return [columns[0], rows, tokens, crcs]

        return handle

    texts = columns_of(docs, {"doc_id": id_col, "text": text_col})
    return map_slices(texts, None, "doc_id long, row_no long, doc_tokens long, crcs array<long>", start=start, operator="packing")


# --- minimum bin slack ------------------------------------------------------


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum is closest to ``capacity`` from below.

    Bit s of a bitset says that sum s can be reached; lengths are added from the longest until the capacity itself is
    reached.  The counts are traced back through the bitsets kept before each length.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for size in sorted((s for s in counts if s <= capacity), reverse=True):
        steps.append((size, reach))
        left, times = min(counts[size], capacity // size), 1
        while left > 0:
            take = min(times, left)
            reach |= (reach << (take * size)) & mask
            left, times = left - take, times * 2
        if reach >> capacity & 1:
            break
    goal, chosen = reach.bit_length() - 1, {}
    for size, before in reversed(steps):
        while not before >> goal & 1:
            goal -= size
            chosen[size] = chosen.get(size, 0) + 1
    return chosen


def pack(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Multisets of lengths and how many times each is used, until ``counts`` is used up."""
    counts = {s: n for s, n in counts.items() if n}
    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        chosen = fill({s: n for s, n in rest.items() if n}, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(counts[s] // n for s, n in chosen.items())
        for s, n in chosen.items():
            counts[s] -= n * times
            if not counts[s]:
                del counts[s]
        yield chosen, times


def pack_pieces(pieces: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """One row per piece of ``pieces_of``: its place in its document and in its sequence.

    Documents are dealt out by hash and ordered within a partition, so that a repeated task numbers its sequences
    alike.  Remainders are packed in windows; sequences with slack are given back to the next window, and only those
    of the last one stay.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    arrow = pa.schema([(f.split()[0], pa.int64()) for f in schema.split(", ")])

    def run(batches):
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 36
        waiting: list[tuple[int, int, int, int]] = []  # remainder, doc_id, doc_tokens, checksum
        out: list[tuple] = []

        def flush(last: bool):
            nonlocal sequence, waiting
            by_size: dict[int, list] = {}
            for item in waiting:
                by_size.setdefault(item[0], []).append(item)
            waiting = []
            for chosen, times in pack({s: len(v) for s, v in by_size.items()}, length):
                full = sum(s * n for s, n in chosen.items()) == length
                for _ in range(times):
                    items = [by_size[s].pop() for s, n in chosen.items() for _ in range(n)]
                    if not (full or last):
                        waiting += items
                        continue
                    offset = 0
                    for size, doc, tokens, crc in items:
                        out.append((doc, tokens - size, size, crc, tokens, sequence, offset))
                        offset += size
                    sequence += 1

        def batches_out():
            nonlocal out
            rows, out = out, []
            columns = list(zip(*rows, strict=True)) or [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=arrow)

        limit = window
        for batch in batches:
            for doc, tokens, crcs in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                for i in range(tokens // length):
                    out.append((doc, i * length, length, crcs[i], tokens, sequence, 0))
                    sequence += 1
                if tokens % length:
                    waiting.append((tokens % length, doc, tokens, crcs[-1]))
                if len(waiting) >= limit:
                    flush(False)
                    limit = len(waiting) + window  # what did not fit waits beside a whole new window
                    yield batches_out()
            yield batches_out()
        flush(True)
        yield batches_out()

    dealt = pieces.repartition("doc_id", "row_no").sortWithinPartitions("doc_id", "doc_tokens", "crcs", "row_no")
    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str | None = None, *, length: int = LENGTH, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most ``length`` ids.

    ``path`` is the vocabulary file on every worker (default: the public word-ending BPE).  A null or empty text is
    its end id alone; rows without id and repeated rows are packed like any other.
    """

    def encode():
        if path:
            return encoder(path)
        import public_tokenizers

        return encoder(public_tokenizers.path("word_bpe_49k.json"))

    return pack_pieces(pieces_of(docs, encode, length, id_col=id_col, text_col=text_col), length)


def op6_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op6_bin_slack_packing": op6_bin_slack_packing}
SQL: dict[str, str] = {}
