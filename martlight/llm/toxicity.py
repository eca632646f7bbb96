"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word's embedding is put together from three hashed tables: of the word, of its first four and of its first six
characters, so that inflected forms share a part and two words rarely share all; what a word's documents tell by
themselves is the start.  Filters of width one, two and three
slide over the whole text, the two largest values of each filter over the text are kept (one insult quoted is not yet
a toxic text), and a logistic unit scores them; a second head guesses the language from the same filters.  Trained in numpy; since only the best place of a
filter counts, gradients touch few words.  Thresholds are set per guessed language, and a score is bent so that every
threshold comes to lie at ``CUT``.

All labelled documents are learnt from.  Where they are many, each task goes over its own part of them, epoch by epoch, and
the parts' changes are averaged after each: a row of a table over those parts whose documents touched it.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlight.llm.base import columns_of, map_slices, map_texts, table, worker_store
from martlight.session import stable

#: Characters of a word that each table sees (0: all), and the dimensions it gives.
PARTS = ((0, 8), (4, 4), (6, 4))
DIM = sum(d for _, d in PARTS)
BITS = 17
BUCKETS = 1 << BITS
#: Largest values of a filter that count.
TOP = 2
#: Batches that training takes at least, and documents of the rarer kind that a threshold's prior counts for.
STEPS, PRIOR = 300, 5
#: Words of a text that the filters pass over at once, and words of all texts together.
PIECE, BLOCK = 8192, 32_768
#: Characters of labelled texts up to which one process learns them all, and what a part has at least beyond: characters,
#: documents; parts are ``PARTITIONS`` at most.
ALONE, PART_CHARS, PART_DOCS, PARTITIONS = 24_000_000, 12_000_000, 4096, 64
#: Documents and words that a task holds of its part; they are mixed among themselves.
HELD_DOCS, HELD_WORDS = 8192, 4_000_000
#: Labelled documents that are sent to the texts as a list; more are joined by exchange.
LISTED = 1_000_000
#: Rows of a table whose changes travel together, and steps of a score where thresholds are set over many documents.
CHUNK, SCORES = 4096, 1 << 16
#: Words whose buckets a worker remembers.
WORDS = 300_000
FILTERS = 16
WIDTHS = (1, 2, 3)
PAD = max(WIDTHS) - 1
#: Weight of the language head in training, and deviations beyond which a word's first value does not grow.
LANG_SHARE, CLIP = 0.3, 5.0
#: The score at which a text counts as toxic, in every language.
CUT = 0.3
WORD = re.compile(r"\w+")


_CODES: dict[str, int] = worker_store("toxicity")


def _code(word: str) -> int:
    """Buckets of a word in all tables, packed; bucket 0 is the empty word, so real ones start at 1."""
    code = 0
    for i, (chars, _) in enumerate(PARTS):
        code |= (xxhash.xxh64_intdigest(word[:chars] if chars else word, i) % (BUCKETS - 1) + 1) << (BITS * i)
    if len(_CODES) > WORDS:
        _CODES.clear()
    _CODES[word] = code
    return code


def word_codes(text: str | None) -> np.ndarray:
    """Packed buckets of the lower-cased words."""
    known = _CODES.get
    words = (m.group() for m in WORD.finditer((text or "").lower()))
    return np.fromiter((known(w) or _code(w) for w in words), dtype=np.int64)


def _joined(docs: Sequence[np.ndarray], words: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all documents in a row with empty words between, the starts, and the places where filters begin.

    ``words`` is the number of those in each document; what follows them is only read by the last ones.
    """
    sizes = np.array([max(n, 1) for n in words])
    starts = np.concatenate([[0], np.cumsum(sizes + PAD)[:-1]])
    codes = np.zeros(int((sizes + PAD).sum()), np.int64)
    real = np.zeros(len(codes), bool)
    for at, size, own in zip(starts, sizes, docs):
        codes[at : at + len(own)] = own
        real[at : at + size] = True
    return codes, starts, real


def _pieces(docs: Sequence[np.ndarray]) -> Iterator[list[tuple[int, int, np.ndarray, int]]]:
    """Blocks of (document, first word, piece, places): filters begin at each word of a text in just one piece."""
    block, words = [], 0
    for i, doc in enumerate(docs):
        for at in range(0, max(len(doc), 1), PIECE):
            own = min(PIECE, len(doc) - at)
            if block and words + own > BLOCK:
                yield block
                block, words = [], 0
            block.append((i, at, doc[at : at + own + PAD], own))
            words += own
    if block:
        yield block


@dataclass
class TextCNN:
    tables: list[np.ndarray]
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    lang_out: np.ndarray
    langs: list[str]
    limits: dict[str, float] = field(default_factory=dict)
    limit: float = 0.5

    @classmethod
    def fresh(cls, langs: Sequence[str], seed: int = 0) -> TextCNN:
        rng = np.random.default_rng(seed)
        n = TOP * FILTERS * len(WIDTHS)
        tables = [rng.normal(0, 0.1, (BUCKETS, d)).astype(np.float32) for _, d in PARTS]
        for t in tables:
            t[0] = 0
        filters = [rng.normal(0, (DIM * w) ** -0.5, (DIM * w, FILTERS)).astype(np.float32) for w in WIDTHS]
        out = rng.normal(0, 0.1, n).astype(np.float32)
        lang_out = rng.normal(0, 0.1, (n + 1, max(1, len(langs)))).astype(np.float32)
        return cls(tables, filters, np.zeros(n, np.float32), out, 0.0, lang_out, list(langs) or [""])

    def embedded(self, codes: np.ndarray) -> np.ndarray:
        """A row per word, its parts from all tables side by side."""
        found = (np.take(v, codes >> (BITS * i) & (BUCKETS - 1), axis=0, mode="clip") for i, v in enumerate(self.tables))
        return np.concatenate(list(found), axis=1)

    def pooled(self, docs: Sequence[np.ndarray], words: Sequence[int] | None = None) -> np.ndarray:
        """The largest values of each filter over each document (the first ``words`` of it)."""
        return self._best(docs, words)[0]

    def _best(self, docs: Sequence[np.ndarray], words: Sequence[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The largest values of each filter over each document, and the words of it where they are."""
        codes, starts, real = _joined(docs, words or [len(d) for d in docs])
        x = self.embedded(codes)
        n = len(x)
        # A filter's values lie side by side, which argmax wants; filters are in order of their widths.
        y = np.concatenate([f[:DIM] for f in self.filters], axis=1).T @ x.T
        for k in range(1, max(WIDTHS)):
            wide = [i for i, width in enumerate(WIDTHS) if width > k]
            weights = np.concatenate([self.filters[i][k * DIM : (k + 1) * DIM] for i in wide], axis=1)
            y[wide[0] * FILTERS :, : n - k] += weights.T @ x[k:].T
        y[:, ~real] = -100.0
        best, where = [], []
        ends, columns = np.append(starts[1:], n), np.arange(len(y))
        for _ in range(TOP):
            at = np.stack([y[:, s:e].argmax(axis=1) for s, e in zip(starts, ends)])
            whole = at + starts[:, None]
            best.append(y[columns, whole])
            where.append(at)
            y[columns, whole] = -100.0
        return np.maximum(np.concatenate(best, axis=1), -100.0), np.concatenate(where, axis=1)

    def pooled_whole(self, docs: Sequence[np.ndarray]) -> np.ndarray:
        """As :func:`pooled`, in blocks of bounded size: the largest values of a text's pieces are carried along."""
        return self.places(docs)[0]

    def places(self, docs: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """:func:`pooled_whole` and the word where each value begins, of equal ones the first."""
        n = FILTERS * len(WIDTHS)
        best = np.full((len(docs), TOP * n), -100.0, np.float32)
        where = np.zeros((len(docs), TOP * n), np.int64)
        met: set[int] = set()
        for block in _pieces(docs):
            found, at = self._best([d for _, _, d, _ in block], [k for _, _, _, k in block])
            for (i, begin, _, _), own, place in zip(block, found, at + np.array([b for _, b, _, _ in block])[:, None]):
                if i in met:
                    both, spots = np.concatenate([best[i], own]).reshape(-1, n), np.concatenate([where[i], place]).reshape(-1, n)
                    order = np.argsort(-both, axis=0, kind="stable")[:TOP]
                    own, place = (np.take_along_axis(v, order, axis=0).ravel() for v in (both, spots))
                met.add(i)
                best[i], where[i] = own, place
        return best, where

    def raw(self, docs: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Probability before calibration, and the guessed language's number."""
        h = np.maximum(self.pooled_whole(docs) + self.bias, 0)
        p = 0.5 * np.tanh(0.5 * (h @ self.out + self.out_bias)) + 0.5
        return p, (h @ self.lang_out[:-1] + self.lang_out[-1]).argmax(axis=1)

    def scores(self, docs: Sequence[np.ndarray]) -> np.ndarray:
        """Calibrated scores: ``CUT`` at the threshold of the guessed language, linear on either side."""
        p, lang = self.raw(docs)
        p = p.astype(np.float64)
        t = np.array([self.limits.get(v, self.limit) for v in self.langs])[lang]
        return np.where(p < t, CUT * p / t, CUT + (1 - CUT) * (p - t) / (1 - t)).clip(0, 1)


def loss(model: TextCNN, docs: Sequence[np.ndarray], y: np.ndarray, tongue: np.ndarray) -> float:
    """Mean of both heads' cross entropies; ``tongue`` is the language's number, negative if unknown."""
    h = np.maximum(model.pooled(docs) + model.bias, 0)
    logit = h @ model.out + model.out_bias
    toxic = np.logaddexp(0, logit) - y * logit
    logits = h @ model.lang_out[:-1] + model.lang_out[-1]
    top = logits.max(axis=1)
    tongues = top + np.log(np.exp(logits - top[:, None]).sum(axis=1)) - logits[np.arange(len(docs)), np.maximum(tongue, 0)]
    return float((toxic + LANG_SHARE * np.where(tongue >= 0, tongues, 0)).mean())


def gradients(model: TextCNN, docs: Sequence[np.ndarray], y: np.ndarray, tongue: np.ndarray) -> tuple[dict, list]:
    """Gradients of :func:`loss`, those of the tables as (rows, gradient) for the rows that the best places touch."""
    best, place = model.places(docs)
    h = np.maximum(best + model.bias, 0)
    p = 0.5 * np.tanh(0.5 * (h @ model.out + model.out_bias)) + 0.5
    d_logit = ((p - y) / len(docs)).astype(np.float32)
    logits = h @ model.lang_out[:-1] + model.lang_out[-1]
    q = np.exp(logits - logits.max(axis=1, keepdims=True))
    q /= q.sum(axis=1, keepdims=True)
    known = tongue >= 0
    q[known, tongue[known]] -= 1
    q[~known] = 0
    q *= LANG_SHARE / len(docs)
    d_h = (d_logit[:, None] * model.out + q @ model.lang_out[:-1].T) * (h > 0)
    grads = {
        "lang": np.concatenate([h.T @ q, q.sum(axis=0)[None]]),
        "out": h.T @ d_logit,
        "out_bias": d_logit.sum(),
        "bias": d_h.sum(axis=0),
    }
    # Only the words where open filters have their best places take part, few of a text of any length.
    sizes = np.array([max(len(d), 1) + PAD for d in docs])
    starts = np.cumsum(sizes) - sizes
    words = np.zeros(int(sizes.sum()), np.int64)
    for start, doc in zip(starts, docs):
        words[start : start + len(doc)] = doc
    shape = (len(docs), TOP, len(WIDTHS), FILTERS)
    whole, d_h = (place + starts[:, None]).reshape(shape), d_h.reshape(shape)
    codes, parts = [], []
    for i, width in enumerate(WIDTHS):
        d_filter = np.zeros_like(model.filters[i])
        open_ones = np.nonzero(d_h[:, :, i])
        g, at = d_h[:, :, i][open_ones], whole[:, :, i][open_ones]
        by_filter = np.zeros((len(g), FILTERS), np.float32)
        by_filter[np.arange(len(g)), open_ones[2]] = g
        for k in range(width):
            block = slice(k * DIM, (k + 1) * DIM)
            codes.append(words[at + k])
            d_filter[block] = model.embedded(codes[-1]).T @ by_filter
            parts.append(by_filter @ model.filters[i][block].T)
        grads[f"filter{width}"] = d_filter
    codes, parts = np.concatenate(codes), np.concatenate(parts)
    touched, at = [], 0
    for i, (_, dim) in enumerate(PARTS):
        own, back_to = np.unique(codes >> (BITS * i) & (BUCKETS - 1), return_inverse=True)
        total = np.stack([np.bincount(back_to, parts[:, at + j], len(own)) for j in range(dim)], axis=1).astype(np.float32)
        total[own == 0] = 0
        touched.append((own, total))
        at += dim
    return grads, touched


def _counted(docs: Sequence[np.ndarray], y: Sequence[float], seen: np.ndarray) -> None:
    """Add to ``seen``, clean and toxic documents by bucket of their words in the first table."""
    for doc, toxic in zip(docs, y):
        seen[int(toxic)][np.unique(doc & (BUCKETS - 1))] += 1


def _informed(model: TextCNN, seen: np.ndarray, n: int, toxic: float) -> None:
    """Start from what single words tell: the first value of a word is how far its number of toxic documents lies from
    that expected, in deviations, and one filter reads it.  Rare words lie near zero.  Without it the few words that
    matter are seldom among a random filter's largest, and small samples teach nothing."""
    share = float(np.clip(toxic / n, 1 / (n + 1), n / (n + 1)))
    every = seen.sum(axis=0)
    far = (seen[1] - share * every) / np.sqrt(every * share * (1 - share) + 1)
    model.tables[0][1:, 0] = np.clip(far[1:], -CLIP, CLIP) / CLIP
    model.filters[0][:, 0] = 0
    model.filters[0][0, 0] = 1
    model.out[[top * FILTERS * len(WIDTHS) for top in range(TOP)]] = 1
    model.out_bias = float(np.log(share / (1 - share)))


def _weights(model: TextCNN) -> dict[str, np.ndarray]:
    """The trained arrays, each as rows; what is written into them is the model's but for ``out_bias``."""
    found = {"lang": model.lang_out, "out": model.out[None], "bias": model.bias[None]}
    found |= {f"filter{w}": f for w, f in zip(WIDTHS, model.filters)}
    return found | {f"table{i}": t for i, t in enumerate(model.tables)}


def _fresh_sums(model: TextCNN) -> dict[str, np.ndarray]:
    return {name: np.full_like(w, 1e-3) for name, w in _weights(model).items()}


def _learnt(model: TextCNN, sums: dict[str, np.ndarray], docs: Sequence[np.ndarray], y: np.ndarray, tongue: np.ndarray, order: np.ndarray, batch: int, pace: float, decay: float) -> None:
    """One pass of Adagrad over the documents; ``sums`` holds the squares of all gradients so far."""
    weights = _weights(model)

    def adagrad(name: str, grad: np.ndarray, rows=slice(None)) -> None:
        sums[name][rows] += grad * grad
        weights[name][rows] -= pace * grad / np.sqrt(sums[name][rows])

    for own in (order[at : at + batch] for at in range(0, len(order), batch)):
        grads, touched = gradients(model, [docs[i] for i in own], y[own], tongue[own])
        model.out_bias -= pace * float(grads.pop("out_bias"))
        for name, grad in grads.items():
            adagrad(name, grad if name == "bias" else grad + decay * weights[name].reshape(grad.shape))
        for i, (rows, grad) in enumerate(touched):
            adagrad(f"table{i}", grad, rows)


def train(docs: Sequence[np.ndarray], toxic: Sequence[int], lang: Sequence[str], *, epochs: int = 10, batch: int = 64,
          rate: float = 0.05, decay: float = 1e-4, seed: int = 0) -> TextCNN:
    """Adagrad on the sum of both heads' cross entropies; a fifth of the documents is kept back for the thresholds.

    Small samples are gone through more often, so that there are ``STEPS`` batches at least.
    """
    langs = sorted({v for v in lang if v is not None})
    model = TextCNN.fresh(langs, seed)
    if not len(docs):
        return model
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(docs))
    back, learn = order[: len(docs) // 5], order[len(docs) // 5 :]
    y = np.asarray(toxic, dtype=np.float32)
    batch = batch if len(learn) > 2000 else batch // 2
    epochs = max(epochs, -(-STEPS * batch // max(1, len(learn))))
    number = {v: i for i, v in enumerate(langs)}
    tongue = np.array([number.get(v, -1) for v in lang])
    seen = np.zeros((2, BUCKETS))
    _counted([docs[i] for i in learn], y[learn], seen)
    _informed(model, seen, len(learn), float(y[learn].sum()))
    sums = _fresh_sums(model)
    for epoch in range(epochs):
        _learnt(model, sums, docs, y, tongue, rng.permutation(learn), batch, rate * (1 - epoch / epochs), decay)
    _calibrate(model, [docs[i] for i in back], y[back])
    return model


def _best_limit(p: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """The threshold with the best F1, in the middle of its gap; ``n`` documents, ``y`` of them toxic, have the score ``p``."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    taken = np.arange(1, len(p) + 1) if n is None else np.cumsum(n[order])
    f1 = 2 * hits / (taken + y.sum())
    k = int(f1.argmax())
    below = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float(np.clip((p[order[k]] + below) / 2, 0.05, 0.95))


def _limits(model: TextCNN, p: np.ndarray, lang: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
    """Thresholds of all languages together and of each, by documents kept back: ``n`` of a score, ``y`` of them toxic.

    Each is drawn towards what is known without it, one half or the common one, as if by ``PRIOR`` documents.
    """

    def drawn(own: np.ndarray, prior: float) -> float:
        weight = min(y[own].sum(), (n - y)[own].sum())
        return float((weight * _best_limit(p[own], y[own], n[own]) + PRIOR * prior) / (weight + PRIOR)) if weight else prior

    model.limit = drawn(np.ones(len(p), bool), 0.5)
    for i, name in enumerate(model.langs):
        model.limits[name] = drawn(lang == i, model.limit)


def _calibrate(model: TextCNN, docs: list[np.ndarray], y: np.ndarray) -> None:
    """:func:`_limits` by documents at hand."""
    if docs:
        p, lang = model.raw(docs)
        _limits(model, p, lang, y, np.ones(len(docs), y.dtype))


# ---- learning from many documents, each task from a part of them -------------

_CHANGES = "part string, chunk int, rows array<int>, change array<float>"


def _changes(name: str, change: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of an array that are not zero, in chunks."""
    rows = np.flatnonzero(change.any(axis=1))
    for chunk in np.unique(rows // CHUNK).tolist():
        own = rows[rows // CHUNK == chunk]
        columns = [[name], [chunk], [own.astype(np.int32)], [change[own].ravel().astype(np.float32)]]
        kinds = [pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "chunk", "rows", "change"])


def _together(changes: DataFrame, widths: dict[str, int], mean: bool) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Name, rows and change of all tasks' changes together: sums, or means over the tasks that changed a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, times = None, None, None

        def finish():
            for found in _changes(key[0], total / np.maximum(times, 1)[:, None] if mean else total):
                rows = pa.array([found.column(2)[0].values.to_numpy() + key[1] * CHUNK], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([found.column(0), pa.array([key[1]], pa.int32()), rows, found.column(3)], found.schema.names)

        for batch in batches:
            for name, chunk, rows, change in zip(*batch.columns):
                own = name.as_py(), chunk.as_py()
                if own != key:
                    if key is not None:
                        yield from finish()
                    key, total, times = own, np.zeros((CHUNK, widths[own[0]])), np.zeros(CHUNK)
                rows = rows.values.to_numpy() - own[1] * CHUNK
                total[rows] += change.values.to_numpy().reshape(len(rows), -1)
                times[rows] += 1
        if key is not None:
            yield from finish()

    placed = changes.repartition(16, "part", "chunk").sortWithinPartitions("part", "chunk")
    for batch in placed.mapInArrow(run, _CHANGES).toArrow().to_batches():
        for name, _, rows, change in zip(*batch.columns):
            yield name.as_py(), rows.values.to_numpy(), change.values.to_numpy().reshape(len(rows), -1)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, list]]:
    """Codes, labels and languages of ``toxic, lang, codes`` rows, as many as a task holds at once."""
    docs, y, lang, words = [], [], [], 0
    for batch in batches:
        for at, codes in enumerate(batch.column(2)):
            docs.append(np.asarray(codes.values))
            words += len(docs[-1])
            y.append(batch.column(0)[at].as_py())
            lang.append(batch.column(1)[at].as_py())
            if len(docs) >= HELD_DOCS or words >= HELD_WORDS:
                yield docs, np.array(y, np.float32), lang
                docs, y, lang, words = [], [], [], 0
    if docs:
        yield docs, np.array(y, np.float32), lang


def _train_parts(coded: DataFrame, langs: list[str], parts: int, *, epochs: int = 10, batch: int = 64, rate: float = 0.05, decay: float = 1e-4, seed: int = 0) -> TextCNN:
    """:func:`train` over the partitions of ``toxic, lang, codes, back`` rows; those ``back`` are kept for the thresholds."""
    context = coded.sparkSession.sparkContext
    model = TextCNN.fresh(langs, seed)
    learn, back = coded.where("not back").select("toxic", "lang", "codes"), coded.where("back").select("toxic", "lang", "codes")
    n, toxic = learn.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    number = {v: i for i, v in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS))
        for docs, y, _ in _held(batches):
            _counted(docs, y, seen)
        yield from _changes("seen", seen.T)

    seen = np.zeros((2, BUCKETS))
    for _, rows, change in _together(map_texts(learn, count, _CHANGES, "toxicity"), {"seen": 2}, mean=False):
        seen[:, rows] = change.T
    _informed(model, seen, n, float(toxic))
    sums = _fresh_sums(model)
    # The bias travels with the arrays, and the squares behind each row's weights.
    widths = {name: 2 * w.shape[1] for name, w in _weights(model).items()} | {"out_bias": 1}
    epochs = max(epochs, -(-STEPS * batch * parts // max(1, n)))
    for epoch in range(epochs):
        shared = context.broadcast((model, sums))
        pace = rate * (1 - epoch / epochs)

        def one_pass(batches: Iterator[pa.RecordBatch], shared=shared, pace=pace, epoch=epoch) -> Iterator[pa.RecordBatch]:
            # A worker keeps a broadcast value for other tasks, so the task's own copy is changed.
            model, sums = copy.deepcopy(shared.value)
            rng = np.random.default_rng([seed, epoch, TaskContext.get().partitionId()])
            for docs, y, lang in _held(batches):
                tongue = np.array([number.get(v, -1) for v in lang])
                _learnt(model, sums, docs, y, tongue, rng.permutation(len(docs)), batch, pace, decay)
            before, squares = shared.value
            ends = _weights(model)
            for name, start in _weights(before).items():
                yield from _changes(name, np.concatenate([ends[name] - start, sums[name] - squares[name]], axis=1))
            yield from _changes("out_bias", np.array([[model.out_bias - before.out_bias]]))

        weights = _weights(model)
        for name, rows, change in _together(map_texts(learn, one_pass, _CHANGES, "toxicity"), widths, mean=True):
            if name == "out_bias":
                model.out_bias += float(change[0, 0])
            else:
                half = change.shape[1] // 2
                weights[name][rows] += change[:, :half]
                sums[name][rows] += change[:, half:]
        shared.destroy()
    shared = context.broadcast(model)

    def judge(columns):
        p, lang = shared.value.raw([np.array(c, np.int64) for c in columns[2]])
        return [lang.tolist(), np.floor(p * SCORES).astype(np.int64).tolist(), columns[0]]

    judged = map_slices(back, judge, "lang int, score long, toxic int", rows=64, operator="toxicity")
    found = judged.groupBy("lang", "score").agg(F.sum("toxic").alias("y"), F.count(F.lit(1)).alias("n")).toArrow().sort_by([("lang", "ascending"), ("score", "descending")])
    lang, step, y, n = (found[c].to_numpy() for c in ("lang", "score", "y", "n"))
    if len(step):
        # Languages share scores, so equal ones are one step for the common threshold as well.
        _limits(model, (step + 0.5) / SCORES, lang, y.astype(float), n.astype(float))
    shared.unpersist()
    return model


def held_out_column(id_col: str = "doc_id") -> Column:
    """Documents the query never learns labels from."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        label_col: str = "toxic", per_class: tuple[int, int] | None = None) -> TextCNN:
    """Train on all labelled documents, whole texts of any length.  A document with several labels counts as toxic if one
    says so.

    ``per_class`` leaves it at about so many (toxic, clean) documents by a hash of their id.  Texts of up to ``ALONE``
    characters together are learnt by the driver, in one part; more by tasks (:func:`_train_parts`).
    """
    marks = (
        columns_of(labels, {"doc_id": id_col, "toxic": label_col})
        .where("doc_id is not null and toxic is not null")
        .groupBy("doc_id").agg((F.max("toxic") != 0).cast("int").alias("toxic"))
    )
    n_clean, n_toxic = marks.agg(
        F.count(F.when(F.col("toxic") == 0, 1)).alias("clean"), F.count(F.when(F.col("toxic") != 0, 1)).alias("toxic")
    ).first()
    if per_class:
        place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)).cast("double") / 1_000_000
        marks = marks.where(place < F.when(F.col("toxic") != 0, per_class[0] / max(n_toxic, 1)).otherwise(per_class[1] / max(n_clean, 1)))
    texts = columns_of(docs, {"doc_id": id_col, "text": text_col, "lang": lang_col})
    sample = texts.join(F.broadcast(marks) if n_clean + n_toxic <= LISTED else marks, "doc_id").select("doc_id", "toxic", "lang", "text")
    codes = map_slices(
        sample,
        lambda c: [c[0], c[1], c[2], [word_codes(t).tolist() for t in c[3]]],
        "doc_id long, toxic int, lang string, codes array<long>",
        operator="toxicity",
    )
    chars, n = sample.agg(F.sum(F.length("text")), F.count(F.lit(1))).first()
    if (chars or 0) <= ALONE:
        rows = codes.toArrow().sort_by([("doc_id", "ascending")])
        docs_codes = [np.asarray(v.values) for v in rows["codes"]]
        return train(docs_codes, rows["toxic"].to_pylist(), rows["lang"].to_pylist())
    parts = int(max(1, min(chars // PART_CHARS, n // PART_DOCS, PARTITIONS)))
    kept_back = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0
    dealt = codes.withColumn("back", kept_back).repartition(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("codes"))
    coded = stable(dealt.select("toxic", "lang", "codes", "back"))
    langs = sorted(r[0] for r in coded.select("lang").where("lang is not null").distinct().collect())
    return _train_parts(coded, langs, parts)


def score(docs: DataFrame, model: TextCNN, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score``: one row per row of ``docs``; null and empty texts are scored as one empty word.

    Texts are whole, of any length: filters pass over them in pieces, and a word takes eight bytes besides.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by BUCKETS and DIM: 8 MB

    def handle(columns):
        return [columns[0], shared.value.scores([word_codes(t) for t in columns[1]]).tolist()]

    return map_slices(columns_of(docs, {"doc_id": id_col, "text": text_col}), handle, "doc_id long, score double", rows=64, operator="toxicity")


def op9_cnn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out_column()))
    return (
        score(docs, model)
        .withColumn("held_out", held_out_column())
        .withColumn("predicted", (F.col("score") >= CUT).cast("int"))
        .select("doc_id", "held_out", "score", "predicted")
    )


QUERIES = {"op9_cnn_toxicity": op9_cnn_toxicity}
SQL: dict[str, str] = {}
