"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time and labels every byte; a document's probabilities are
the mean over its bytes.  Sequences are the words of a text (runs without ASCII white space, in pieces of at most
``PIECE`` bytes), and the state starts anew with each: equal words then have equal labels, so a worker runs the network
once per distinct word and looks the others up.  Nothing of a text is left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlight.llm.base import columns_of, map_slices, map_texts, table, worker_store
from martlight.session import stable

PIECE = 32
HIDDEN = 16
#: Words whose pooled labels a worker remembers.
WORDS = 200_000
#: Words of one length run through the network together.
ROWS = 1024
PLAIN_LETTER = re.compile(r"[A-Za-z]")
UNDETERMINED = "und"


def words_of(text: str) -> list[bytes]:
    """All words in order, long ones in pieces."""
    words = text.encode("utf-8", "replace").split()
    if max(map(len, words), default=0) > PIECE:
        words = [w[at : at + PIECE] for w in words for at in range(0, len(w), PIECE)]
    return words


def has_letter(text: str | None) -> bool:
    return bool(text) and (PLAIN_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class ByteGRU:
    """``langs`` and the weights: for each direction an input table (256 x 3H) and U (H x 3H); W (2H x L) and c."""

    langs: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, langs: Sequence[str], hidden: int = HIDDEN, seed: int = 0) -> ByteGRU:
        rng = np.random.default_rng(seed)

        def draw(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        weights = {"W": draw(2 * hidden, len(langs), scale=0.3), "c": np.zeros(len(langs), np.float32)}
        for d in "fb":
            weights[f"E{d}"] = draw(256, 3 * hidden, scale=0.3)
            weights[f"U{d}"] = draw(hidden, 3 * hidden, scale=hidden**-0.5)
        return cls(list(langs), weights)

    def _states(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States after each byte of ``x`` (rows x length), in reading order of direction ``d``."""
        table, u = self.weights[f"E{d}"], self.weights[f"U{d}"]
        h_size = u.shape[0]
        h = np.zeros((len(x), h_size), table.dtype)
        states = np.empty((x.shape[1], len(x), h_size), table.dtype)
        for t in range(x.shape[1]):
            at = t if d == "f" else x.shape[1] - 1 - t
            given, past = table[x[:, at]], h @ u
            gates = _sigmoid(given[:, : 2 * h_size] + past[:, : 2 * h_size])
            z, r = gates[:, :h_size], gates[:, h_size:]
            n = np.tanh(given[:, 2 * h_size :] + r * past[:, 2 * h_size :])
            if keep is not None:
                keep.append((at, h, z, r, n, past[:, 2 * h_size :]))
            h = n + z * (h - n)
            states[at] = h
        return states

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the languages at every byte: length x rows x languages."""
        h_size = self.weights["Uf"].shape[0]
        w = self.weights["W"]
        logits = self._states(x, "f") @ w[:h_size] + self._states(x, "b") @ w[h_size:] + self.weights["c"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        return logits / logits.sum(axis=2, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions, and its gradients by backpropagation through time."""
        w, h_size = self.weights["W"], self.weights["Uf"].shape[0]
        kept: dict[str, list] = {"f": [], "b": []}
        states = {d: self._states(x, d, kept[d]) for d in "fb"}
        logits = states["f"] @ w[:h_size] + states["b"] @ w[h_size:] + self.weights["c"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        rows = np.arange(len(x))
        loss = float(-np.log(p[:, rows, y] + 1e-12).mean())
        p[:, rows, y] -= 1
        p /= p.shape[0] * p.shape[1]
        both = np.concatenate([states["f"], states["b"]], axis=2)
        grads = {"c": p.sum(axis=(0, 1)), "W": np.einsum("tnh,tnl->hl", both, p, optimize=True)}
        for d, part in (("f", w[:h_size]), ("b", w[h_size:])):
            u = self.weights[f"U{d}"]
            de, du = np.zeros_like(self.weights[f"E{d}"]), np.zeros_like(u)
            later = np.zeros((len(x), h_size), u.dtype)
            for at, before, z, r, n, past_n in reversed(kept[d]):
                dh = p[at] @ part.T + later
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (before - n) * z * (1 - z)
                dr = dn * past_n * r * (1 - r)
                given = np.concatenate([dz, dr, dn], axis=1)
                past = np.concatenate([dz, dr, dn * r], axis=1)
                np.add.at(de, x[:, at], given)
                du += before.T @ past
                later = dh * z + past @ u.T
            grads[f"E{d}"], grads[f"U{d}"] = de, du
        return loss, grads

    def stamp(self) -> int:
        return zlib.crc32(b"".join(self.weights[k].tobytes() for k in sorted(self.weights)))


def _batches(words: Sequence[bytes], order: np.ndarray, rows: int) -> Iterable[np.ndarray]:
    """Indices of words of equal length, at most ``rows`` together."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for size in np.unique(sizes[order]):
        own = order[sizes[order] == size]
        for at in range(0, len(own), rows):
            yield own[at : at + rows]


def _matrix(words: Sequence[bytes], rows: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join([words[i] for i in rows]), dtype=np.uint8).reshape(len(rows), -1)


def train(words: Sequence[bytes], labels: Sequence[str], *, hidden: int = HIDDEN, epochs: int = 9, batch: int = 128,
          rate: float = 0.01, seed: int = 0) -> ByteGRU:
    """Adam over batches of equal-length words; every byte of a word has the label of its document."""
    langs = sorted(set(labels))
    model = ByteGRU.fresh(langs, hidden, seed)
    index = {lang: i for i, lang in enumerate(langs)}
    y = np.array([index[v] for v in labels], dtype=np.int64)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step = 0
    for epoch in range(epochs):
        lots = list(_batches(words, rng.permutation(len(words)), batch))
        for i in rng.permutation(len(lots)):
            _, grads = model.gradients(_matrix(words, lots[i]), y[lots[i]])
            step += 1
            pace = rate * 0.5 ** (epoch / 4) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                model.weights[k] -= (pace * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return model


class WordScores:
    """Sums of position probabilities per distinct word, made on first sight and kept by the worker."""

    def __init__(self, model: ByteGRU):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.sums = np.zeros((1024, len(self.model.langs)), dtype=np.float64)

    def rows(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > WORDS:
            self._clear()
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        base = len(self.index)
        while base + len(new) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        for rows in _batches(new, np.arange(len(new)), ROWS) if new else ():
            self.sums[base + rows] = self.model.positions(_matrix(new, rows)).sum(axis=0)
        self.index.update(zip(new, range(base, base + len(new))))
        return np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))

    def documents(self, texts: Sequence[str | None]) -> list[tuple[str, float]]:
        """Language and pooled probability of each text."""
        lists = [words_of(t) if has_letter(t) else [] for t in texts]
        rows = self.rows([w for ws in lists for w in ws])
        out, at = [], 0
        for words in lists:
            if not words:
                out.append((UNDETERMINED, 0.0))
                continue
            pooled = self.sums[rows[at : at + len(words)]].sum(axis=0) / sum(map(len, words))
            at += len(words)
            best = int(pooled.argmax())
            out.append((self.model.langs[best], min(1.0, float(pooled[best]))))
        return out


_SCORES: dict[int, WordScores] = worker_store("langid")


def scores_of(model: ByteGRU) -> WordScores:
    """The worker's own store for a model; it outlives a task, but not the operator's last one."""
    stamp = model.stamp()
    if stamp not in _SCORES:
        _SCORES.clear()
        _SCORES[stamp] = WordScores(model)
    return _SCORES[stamp]


def label_spans(model: ByteGRU, text: str) -> list[tuple[int, int, str]]:
    """Every byte's language, as spans ``start, end, language`` of bytes of one word with the same label."""
    data, spans = text.encode("utf-8", "replace"), []
    for match in re.finditer(rb"[^\x20\x09-\x0d]+", data):
        for start in range(match.start(), match.end(), PIECE):
            word = data[start : min(start + PIECE, match.end())]
            best = model.positions(np.frombuffer(word, np.uint8)[None, :])[:, 0].argmax(axis=1)
            cuts = [0, *(np.flatnonzero(np.diff(best)) + 1), len(word)]
            spans += [(start + int(a), start + int(b), model.langs[best[a]]) for a, b in zip(cuts, cuts[1:])]
    return spans


def sample_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                 docs_per_lang: int = 600, max_words: int = 50_000) -> tuple[list[bytes], list[str]]:
    """Words and labels to learn from: about ``docs_per_lang`` documents of each language by a hash of their id, and
    about ``max_words`` of their words by a hash; never more than twice as many reach the driver.  Both bounds hold
    whatever the size of ``docs``, and rows are picked where they lie, without an order over all."""
    own = columns_of(docs, {"doc_id": id_col, "text": text_col, "lang": lang_col}).where("text is not null and lang is not null")
    counts = own.groupBy("lang").count().collect()
    if not counts:
        return [], []
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)).cast("double") / 1_000_000
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, docs_per_lang / r["count"]))))
    few = own.where(place < F.try_element_at(share, F.col("lang")))
    words = stable(
        few.select("doc_id", "lang", F.posexplode(F.split("text", r"[\x20\x09-\x0d]+")).alias("at", "word")).where("word <> ''")
    )
    spot = F.pmod(F.xxhash64("doc_id", "at", F.lit(7)), F.lit(1_000_000)).cast("double") / 1_000_000
    picked = words.where(spot < min(1.0, max_words / max(1, words.count()))).limit(2 * max_words)
    rows = sorted(picked.select("doc_id", "at", "word", "lang").collect(), key=lambda r: (r["doc_id"] or 0, r["at"], r["word"]))
    pairs = [(p, r["lang"]) for r in rows for p in words_of(r["word"])]
    return [p for p, _ in pairs], [lang for _, lang in pairs]


def held_out_column(id_col: str = "doc_id") -> Column:
    """Documents the query never learns from; rows without id are scored only."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, **bounds) -> ByteGRU:
    """A model of the languages named in ``docs``; with fewer than one named language it knows none."""
    words, labels = sample_words(docs, **bounds)
    return train(words, labels) if words else ByteGRU.fresh([], HIDDEN)


def identify(docs: DataFrame, model: ByteGRU, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``: one row per row of ``docs``.

    ``und`` with score 0 for null texts, texts without a letter, and a model without languages.  Texts are read whole
    and only the text is used; ties go to the language first in order.
    """

    def handle(columns):
        if not model.langs:
            return [columns[0], [UNDETERMINED] * len(columns[0]), [0.0] * len(columns[0])]
        found = scores_of(model).documents(columns[1])
        return [columns[0], [f[0] for f in found], [f[1] for f in found]]

    texts = columns_of(docs, {"doc_id": id_col, "text": text_col})
    return map_slices(texts, handle, "doc_id long, lang_pred string, score double", operator="langid")


def keep_known(docs: DataFrame, model: ByteGRU, *, least: float = 0.4, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is determined with at least ``least`` probability, ``lang`` as predicted."""
    from pyspark.sql.types import StringType, StructField, StructType

    names = [c for c in docs.columns if c != "lang"]
    schema = StructType([*(docs.schema[c] for c in names), StructField("lang", StringType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(names.index(text_col)).to_pylist()
                found = scores_of(model).documents(texts) if model.langs else [(UNDETERMINED, 0.0)] * len(texts)
                keep = pa.array([f[0] != UNDETERMINED and f[1] >= least for f in found], pa.bool_())
                langs = pa.array([f[0] for f in found], pa.string())
                out = pa.RecordBatch.from_arrays([*part.columns, langs], names=[*names, "lang"])
                yield out.filter(keep)

    kept = map_texts(docs.select(*(f"`{c}`" for c in names)), run, schema, "langid")
    return kept.select(*(f"`{c}`" for c in docs.columns))


def op8_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out_column()).where("doc_id is not null"))
    return identify(docs, model).withColumn("held_out", held_out_column()).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op8_gru_language": op8_gru_language}
SQL: dict[str, str] = {}
