"""Secret scans with a random forest that removes false positives.

Two patterns propose candidates: long runs of key characters, and values assigned to a name of a credential.  A forest
judges each by its length, its transitions between characters, how far dictionary words cover it, the path of its file
and the words beside it.  It is trained on labelled findings: :func:`train_forest` takes any; :func:`labelled_findings`
makes a bounded set from a corpus.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlight.llm.base import columns_of, map_slices, map_texts, table
from martlight.session import stable

# Names of credentials and of harmless values of a like shape.
CREDENTIAL_NAMES = (
    "access_key", "accesskey", "account_key", "api_key", "api-key", "apikey", "auth", "authorization", "bearer", "client_secret",
    "connection_string", "credential", "key", "passphrase", "passwd", "password", "private_key", "pwd", "secret",
    "secret_key", "token",
)
HARMLESS_NAMES = (
    "build", "card", "checksum", "commit", "digest", "doi", "etag", "hash", "id", "integrity", "isbn", "md5", "order",
    "phone", "revision", "session", "sha", "sha1", "sha256", "sku", "trace", "uuid", "version",
)
PATH_NAMES = ("config", "conf", "credential", "deploy", "env", "ini", "pem", "properties", "secret", "settings", "tf", "yaml", "yml")
TEST_NAMES = ("doc", "docs", "example", "examples", "fixture", "fixtures", "mock", "sample", "spec", "test", "tests")

RUN = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
ASSIGNED = r"(?:" + "|".join(map(re.escape, sorted(CREDENTIAL_NAMES, key=len, reverse=True))) + r")[\"']?\s{0,3}(?::|=>?|:=)\s{0,3}[\"']?([^\s\"'`<>]{8,})"
CANDIDATE = re.compile(RUN)
NAMED = re.compile(ASSIGNED, re.IGNORECASE)
LETTERS = re.compile(r"[^\W\d_]+")
#: Distinct words a task holds before it hands on their counts.
MOST_WORDS = 200_000
#: Letters from which a word's pairs are counted before they are added up.
MOST_LETTERS = 100
#: Characters before it are Latin; OTHER stands for any letter from there on.
LATIN, OTHER = "\u0250", "\u0250"
#: Characters on either side in which words count as neighbours.
NEAR = 40
WORD = re.compile(r"[A-Za-z][A-Za-z_\-]*")
CLASSES = {**dict.fromkeys(string.ascii_lowercase, 0), **dict.fromkeys(string.ascii_uppercase, 1), **dict.fromkeys(string.digits, 2)}
FEATURES = (
    "length", "entropy", "class_changes", "digits", "uppercase", "symbols", "hex", "transition", "dictionary",
    "longest_word", "assigned", "quoted", "credential_before", "harmless_before", "credential_near", "harmless_near",
    "path_config", "path_test",
)


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of candidates, in order and apart: values of credential names, and runs that hold a digit or two cases."""
    spans = [(m.start(1), m.end(1)) for m in NAMED.finditer(text)] if "=" in text or ":" in text else []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if any(c in run for c in string.digits) or (run != run.lower() and run[1:] != run[1:].lower() and run != run.upper()):
            spans.append(m.span())
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


@dataclass
class Lexicon:
    """What is known of plain words: log probabilities of character pairs, and common words."""

    pairs: dict[str, float]
    words: frozenset[str]

    @classmethod
    def of(cls, words: Iterable[str], pairs: dict[str, int]) -> Lexicon:
        starts: Counter = Counter()
        for pair, n in pairs.items():
            starts[pair[0]] += n
        return cls({p: math.log((n + 1) / (starts[p[0]] + 64)) for p, n in pairs.items()}, frozenset(words))

    def transition(self, value: str) -> float:
        low = value.lower() if value.isascii() else _folded(value.lower())
        return sum(self.pairs.get(low[i : i + 2], -6.0) for i in range(len(low) - 1)) / max(1, len(low) - 1)

    def coverage(self, value: str) -> tuple[float, int]:
        """Share of characters inside dictionary words, longest first from the left, and the longest such word."""
        low, at, covered, longest = value.lower(), 0, 0, 0
        while at < len(low):
            size = next((n for n in range(min(14, len(low) - at), 2, -1) if low[at : at + n] in self.words), 0)
            covered, longest, at = covered + size, max(longest, size), at + max(1, size)
        return covered / max(1, len(low)), longest


def features(text: str, start: int, end: int, path: str | None, lexicon: Lexicon) -> list[float]:
    value = text[start:end]
    n = len(value)
    counts = Counter(value)
    kinds = [CLASSES.get(c, 3) for c in value]
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    left = [w.lower() for w in WORD.findall(before)]
    near = {*left, *(w.lower() for w in WORD.findall(after))}
    last = left[-1] if left else ""
    folders = set(re.split(r"[^a-z0-9]+", (path or "").lower()))
    coverage, longest = lexicon.coverage(value)
    return [
        min(n, 512),
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, len(kinds) - 1),
        kinds.count(2) / len(kinds),
        kinds.count(1) / len(kinds),
        kinds.count(3) / len(kinds),
        float(all(c in string.hexdigits for c in counts)),
        lexicon.transition(value),
        coverage,
        longest,
        float(before.rstrip("\"' ")[-1:] in (":", "=", ">")),
        float(before[-1:] in ("\"", "'") and after[:1] in ("\"", "'")),
        float(any(last.endswith(c) for c in CREDENTIAL_NAMES)),
        float(last in HARMLESS_NAMES),
        float(any(w in CREDENTIAL_NAMES for w in near)),
        float(any(w in HARMLESS_NAMES for w in near)),
        float(not folders.isdisjoint(PATH_NAMES)),
        float(not folders.isdisjoint(TEST_NAMES)),
    ]


# --- the forest -------------------------------------------------------------


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), limit, left child (right is the next), share of positives."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, limit, child, share in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            while (inner := feature[node] >= 0).any():
                step = child[node] + (x[rows, np.maximum(feature[node], 0)] > limit[node])
                node = np.where(inner, step, node)
            total += share[node]
        return total / max(1, len(self.trees))


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int) -> tuple:
    feature, limit, child, share = [-1], [0.0], [0], [0.0]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        node, rows, level = todo.pop()
        share[node] = float(y[rows].mean())
        if level >= depth or len(rows) < 2 * least or share[node] in (0.0, 1.0):
            continue
        best = (0.0, -1, 0.0)
        for f in rng.choice(x.shape[1], size=max(1, round(math.sqrt(x.shape[1]))), replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            v, hits = x[rows[order], f], np.cumsum(y[rows[order]])
            sizes = np.arange(1, len(rows) + 1)
            cut = np.flatnonzero(v[1:] > v[:-1])
            cut = cut[(cut + 1 >= least) & (len(rows) - cut - 1 >= least)]
            if not len(cut):
                continue
            a, n = hits[cut] / sizes[cut], sizes[cut]
            b, m = (hits[-1] - hits[cut]) / (len(rows) - n), len(rows) - n
            gain = share[node] * (1 - share[node]) - (n * a * (1 - a) + m * b * (1 - b)) / len(rows)
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-12:
                best = (float(gain[k]), int(f), float((v[cut[k]] + v[cut[k] + 1]) / 2))
        if best[1] < 0:
            continue
        feature[node], limit[node], child[node] = best[1], best[2], len(feature)
        for right in (False, True):
            todo.append((len(feature), rows[(x[rows, best[1]] > best[2]) == right], level + 1))
            for array, start in ((feature, -1), (limit, 0.0), (child, 0), (share, 0.0)):
                array.append(start)
    return np.array(feature), np.array(limit), np.array(child), np.array(share)


def train_forest(x: np.ndarray, y: np.ndarray, *, trees: int = 32, depth: int = 10, least: int = 3, seed: int = 0) -> Forest:
    """Gini splits on the square root of the features, each tree on a bootstrap of the findings."""
    rng = np.random.default_rng(seed)
    forest = []
    for _ in range(trees if len(x) else 0):
        rows = rng.integers(0, len(x), len(x))
        forest.append(_grow(x[rows], y[rows].astype(float), rng, depth, least))
    return Forest(forest)


# --- labelled findings ------------------------------------------------------


def _value(rng: random.Random) -> str:
    """A secret of one of the common kinds: hexadecimal, base 64, url-safe, with a vendor's prefix."""
    hexes, mixed = "0123456789abcdef", string.ascii_letters + string.digits
    kind = rng.randrange(6)
    if kind == 0:
        return "".join(rng.choices(hexes, k=rng.choice((32, 40, 48, 64))))
    if kind == 1:
        return "".join(rng.choices(hexes.upper(), k=rng.choice((32, 40, 64))))
    if kind == 2:
        return "".join(rng.choices(mixed + "+/", k=rng.choice((24, 32, 40, 44, 64)))) + "=" * rng.randrange(3)
    if kind == 3:
        return "".join(rng.choices(mixed + "-_", k=rng.randint(20, 60)))
    if kind == 4:
        prefix = rng.choice(("sk_live_", "ghp_", "xoxb-", "AKIA", "AIza", "glpat-", "npm_", "key-"))
        return prefix + "".join(rng.choices(mixed, k=rng.randint(16, 40)))
    return "".join(rng.choices(mixed + "!@$^*", k=rng.randint(10, 24)))


def _lookalike(rng: random.Random, words: Sequence[str]) -> tuple[str, str]:
    """A harmless value and the name before it."""
    hexes = "0123456789abcdef"
    kind = rng.randrange(7)
    if kind == 0:
        return "".join(rng.choices(hexes, k=rng.choice((32, 40, 64)))), rng.choice(("commit", "sha", "checksum", "md5", "digest", "hash", "revision"))
    if kind == 1:
        return "-".join("".join(rng.choices(hexes, k=k)) for k in (8, 4, 4, 4, 12)), rng.choice(("uuid", "id", "trace", "session"))
    if kind == 2:
        return "".join(rng.choices(string.digits, k=rng.randint(16, 20))), rng.choice(("card", "phone", "order", "isbn", "id", ""))
    if kind == 3:
        return rng.choice("_-/").join(rng.choices(words, k=rng.randint(3, 6))) + rng.choice(("", "1", "2", "-v2")), ""
    if kind == 4:
        return "".join(w.capitalize() for w in rng.choices(words, k=rng.randint(3, 5))), ""
    if kind == 5:
        return rng.choice(("your-", "example-", "my_", "changeme-", "xxxx")) + rng.choice(("api-key-here", "secret-goes-here", "x" * 20, "token-placeholder")), rng.choice(CREDENTIAL_NAMES)
    return "".join(rng.choices(words, k=rng.randint(2, 4)))[:40], rng.choice((*CREDENTIAL_NAMES, ""))


def labelled_findings(sample: Sequence[tuple[str, str | None]], lexicon: Lexicon, *, bound: int = 8000, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of findings in a sample of ``(text, path)``.

    Real candidates of the sample count as findings where they are plain: digits or dictionary words alone are harmless,
    a random value assigned to a credential's name is a secret.  Besides, values of known kinds are put between the
    sample's own words, secrets after names of credentials and look-alikes after harmless ones.  At most ``bound``.
    """
    rng = random.Random(seed)
    x, y = [], []
    words = sorted(lexicon.words) or ["value", "name", "text"]
    for text, path in sample:
        for start, end in candidates(text)[:50]:
            value, row = text[start:end], features(text, start, end, path, lexicon)
            f = dict(zip(FEATURES, row))
            if value.isdigit() or f["dictionary"] > 0.8 or (f["digits"] == 0 and f["transition"] > -3.5):
                label = 0
            elif f["credential_before"] and f["assigned"] and f["entropy"] > 3 and f["digits"] > 0.1 and f["dictionary"] < 0.4:
                label = 1
            else:
                continue
            x.append(row)
            y.append(label)
            if len(x) >= bound // 4:
                break
    places = [t for t, _ in sample if len(t) > 100] or ["plain words stand before and after the value that is looked at here " * 2]
    paths = [p for _, p in sample] or [None]
    while len(x) < bound:
        text = rng.choice(places)
        at = rng.randrange(len(text) - 60)
        before, after = text[at : at + 30].rpartition(" ")[0], text[at + 30 : at + 60].partition(" ")[2]
        secret = rng.random() < 0.5
        value, name = (_value(rng), rng.choice(CREDENTIAL_NAMES)) if secret else _lookalike(rng, words)
        name = name.upper() if rng.random() < 0.2 else name
        mark = rng.choice((" = ", "=", ": ", ":", " ", ": ")) if name else " "
        quote = rng.choice(("", "\"", "'"))
        line = f"{before} {name}{mark}{quote}"
        folder = rng.choice((*paths, "config/settings.yml", "deploy/.env", "src/main.py", "tests/fixtures/a.json", "docs/readme.md"))
        full = f"{line}{value}{quote} {after}"
        x.append(features(full, len(line), len(line) + len(value), folder, lexicon))
        y.append(int(secret))
    return np.array(x, dtype=float), np.array(y, dtype=float)


@dataclass
class Scanner:
    lexicon: Lexicon
    forest: Forest
    limit: float = 0.5

    def scan(self, text: str | None, path: str | None) -> list[tuple[int, int, float]]:
        """Candidates of a text with the forest's vote."""
        spans = candidates(text) if text else []
        if not spans:
            return []
        votes = self.forest.predict(np.array([features(text, a, b, path, self.lexicon) for a, b in spans]))
        return [(a, b, float(v)) for (a, b), v in zip(spans, votes)]


def _term_counts(docs: DataFrame) -> DataFrame:
    """``term, is_pair, n`` over every text of ``docs``: words, and pairs of neighbouring letters inside them, counted
    inside the tasks before the exchange; a word's pairs take time in proportion to its length."""

    def run(batches):
        import pyarrow as pa

        def rows(words):
            pairs: Counter = Counter()
            for word, n in words.items():
                if len(word) > MOST_LETTERS:
                    for pair, m in Counter(map(str.__add__, word, word[1:])).items():
                        pairs[pair] += n * m
                else:
                    for pair in map(str.__add__, word, word[1:]):
                        pairs[pair] += n
            for counts, is_pair in ((words, False), (pairs, True)):
                terms = [t if not is_pair or t.isascii() else _folded(t) for t in counts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms, pa.string()), pa.array([is_pair] * len(terms), pa.bool_()), pa.array(counts.values(), pa.int64())],
                    names=["term", "is_pair", "n"],
                )

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(LETTERS.findall((text.as_py() or "").lower()))
                if len(counts) > MOST_WORDS:
                    yield from rows(counts)
                    counts.clear()
        yield from rows(counts)

    counted = map_texts(docs.select("text"), run, "term string, is_pair boolean, n long")
    return counted.groupBy("term", "is_pair").agg(F.sum("n").alias("n"))


def _word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over every text of ``docs``."""
    return _term_counts(docs).where("not is_pair").select(F.col("term").alias("word"), "n")


def _folded(pair: str) -> str:
    """A pair with ``OTHER`` for every letter beyond Latin, so that scripts of any size have a bounded number of pairs."""
    return "".join(c if c < LATIN else OTHER for c in pair)


def lexicon_of(docs: DataFrame, *, text_col: str = "text", size: int = 4000) -> Lexicon:
    """Lexicon of all texts: the ``size`` commonest words of three letters or more, and the character pairs.

    Only these words and pairs reach the driver.  Letters beyond the Latin scripts count as one, so that there are at
    most some 345,000 pairs (of about 590 letters) in any corpus.  Null and empty texts hold nothing; of equally common
    words the first in order are taken.
    """
    counts = stable(_term_counts(columns_of(docs, {"text": text_col})))
    words = counts.where("not is_pair and length(term) >= 3").orderBy(F.desc("n"), "term").limit(size).collect()
    return Lexicon.of([r["term"] for r in words], {r["term"]: r["n"] for r in counts.where("is_pair").collect()})


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", sample: int = 1500,
        most_chars: int = 20_000, findings: int = 8000) -> Scanner:
    """Lexicon from all texts, forest from a bounded sample: about ``sample`` documents of at most ``most_chars``
    characters, by a hash of their text, and at most ``findings`` labelled findings.  Documents are picked where they
    lie; no more than twice the sample reaches the driver."""
    lexicon = lexicon_of(docs, text_col=text_col)
    own = columns_of(docs, {"doc_id": id_col, "text": text_col, "path": path_col}).where(f"length(text) between 1 and {most_chars}")
    share = min(1.0, sample / max(1, own.count()))
    place = F.pmod(F.xxhash64("text"), F.lit(1_000_000)).cast("double") / 1_000_000
    rows = own.where(place < share).select("text", "path").distinct().limit(2 * sample).collect()
    pairs = sorted((r["text"], r["path"] or "") for r in rows)
    return Scanner(lexicon, train_forest(*labelled_findings(pairs, lexicon, bound=findings)))


def scan(docs: DataFrame, scanner: Scanner, *, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``doc_id, start, length, score, is_secret``: one row per candidate of every whole text, in code points.

    Null and empty texts have none; a null path is a path without names; repeated rows give repeated findings.
    """

    def handle(columns):
        rows = [
            (doc, a, b - a, score, score >= scanner.limit)
            for doc, text, path in zip(*columns)
            for a, b, score in scanner.scan(text, path)
        ]
        return [list(c) for c in zip(*rows)] if rows else [[]] * 5

    own = columns_of(docs, {"doc_id": id_col, "text": text_col, "path": path_col})
    return map_slices(own, handle, "doc_id long, start long, length long, score double, is_secret boolean")


def mask(docs: DataFrame, scanner: Scanner, *, text_col: str = "text", path_col: str = "source", by: str = "[secret]") -> DataFrame:
    """The rows and columns of ``docs`` with every secret's value replaced in ``text_col``."""
    names = docs.columns
    text_at, path_at = names.index(text_col), names.index(path_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = []
                for text, path in zip(part.column(text_at).to_pylist(), part.column(path_at).to_pylist()):
                    for a, b, score in reversed(scanner.scan(text, path)):
                        if score >= scanner.limit:
                            text = text[:a] + by + text[b:]
                    texts.append(text)
                columns = list(part.columns)
                columns[text_at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_texts(docs, run, docs.schema)


def op4_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))


QUERIES = {"op4_forest_secrets": op4_forest_secrets}
SQL: dict[str, str] = {}
