"""Set similarity join by chosen paths: near copies among texts as sets of word shingles.

A document descends a tree.  At a node it selects coordinates by the node's path, takes the least hash of its shingles under
each (its minwise token), and goes on to the children that the tokens name; documents with many common shingles share
children.  Two independent choices per node on the first levels let a pair at 0.8 keep a common node with probability
1 - (1 - 0.8 s)^2 per level, which stays above 0.937 however deep; four independent trees leave out 1 pair in 65,000.

Nodes are compared in an order that keeps crowds linear.  Every member is verified against one leader of its nodes first, then
against the others of another class; nodes of a tree prefer the same leaders, so a crowd has few.  Links are contracted to
classes after each step, and only the classes are carried on.  A node with one class needs nothing more.  In others, members
outside the largest class are verified with the nearest of a few of it, in some turns.  A node is small if at most ``SMALL`` of
its members lie outside its largest class: those are compared with all members of other classes.  Larger nodes branch
further, with 1.25 children on average, which unrelated documents leave at once, and the same steps follow.  What is
still together at depth ``DEEPEST`` is compared exhaustively in blocks, so nothing is capped.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlight.llm.base import columns_of, map_slices, table
from martlight.llm.components import components
from martlight.session import settled, stable

SEED = 42
TREES = 4
#: Levels with two choices per node that a document descends at once; then one, and a second with probability 1/4.
DEPTH = 3
DEEPEST = 14
#: Members outside a node's largest class up to which they are compared with the whole node, by sketches first.
SMALL = 512
#: Members of its largest class that a node offers to those outside at a time, and how often it does so at most.
MEET, TURNS = 8, 4
#: Nodes (one long each) of a list that may be broadcast to pick their texts; a longer one is joined by exchange.  The driver
#: holds several lists at a time, as rows, as a hash table and as blocks.
LISTED = 100_000
#: Texts whose sketches or sets one task holds.
TEXTS = 2_000
_SALTS = 64
#: Longs of a sketch: the bits of the tokens in two, parities in the others.
_CELLS = 8
_SKETCH = [f"s{i}" for i in range(2 + _CELLS)]
_LEAVES = 1 << DEPTH
_FIRST, _SECOND, _THIRD = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))  # splitmix64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x + _FIRST
    x = (x ^ (x >> np.uint64(30))) * _SECOND
    x = (x ^ (x >> np.uint64(27))) * _THIRD
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``size`` words, in order; a shorter text is one run, one without words none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    codes = np.array([digest(w, SEED) for w in words], dtype=np.uint64)
    size = min(size, len(words))
    runs = np.full(len(codes) - size + 1, size, dtype=np.uint64)
    for at in range(size):
        runs = _mix(runs ^ codes[at : at + len(runs)])
    return np.unique(runs)


def _coordinates(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash functions of coordinates, each a tree and a place in it (the root is 1, children of q are 2q, 2q + 1)."""
    seeds = _mix(places.astype(np.uint64))
    return _mix(seeds), _mix(seeds ^ _SECOND) | np.uint64(1)


def _least(hashes: np.ndarray, offsets: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least hash of a set under each coordinate."""
    least = np.full(len(offsets), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[at : at + 4096] ^ offsets[:, None]) * factors[:, None]).min(axis=1))
    return least


_PLACES = np.array([[(t << 48) | q for q in range(2, 2 * _LEAVES)] for t in range(TREES)])
_OFFSETS, _FACTORS = _coordinates(_PLACES.ravel())


def _first_paths(least: np.ndarray) -> np.ndarray:
    """Keys of the nodes that each set reaches at ``DEPTH``, one row per set, tree by tree and place by place."""
    least = least.reshape(len(least), TREES, -1)
    keys = np.broadcast_to(_mix(np.arange(TREES, dtype=np.uint64))[None, :, None], (len(least), TREES, 1))
    for level in range(1, DEPTH + 1):
        first = 1 << level
        places = _PLACES[:, first - 2 : 2 * first - 2].astype(np.uint64)
        tokens = least[:, :, first - 2 : 2 * first - 2]
        keys = _mix(np.repeat(keys, 2, axis=2) ^ _mix(tokens ^ _mix(places)[None]))
    return keys.reshape(len(least), -1)


def _children(key: np.uint64, place: int, hashes: np.ndarray) -> tuple[list[int], list[int]]:
    """Keys and places of the children that a set chooses below ``DEPTH``."""
    chosen = np.array([2 * place, 2 * place + 1][: 2 if int(key) % 4 == 0 else 1], dtype=np.uint64)
    tokens = _least(hashes, *_coordinates(chosen))
    keys = _mix(key ^ _mix(tokens ^ _mix(chosen)))
    return keys.view(np.int64).tolist(), chosen.tolist()


def _sketches(least: np.ndarray, hashes: list[np.ndarray]) -> np.ndarray:
    """Per set the two low bits of every token in two longs, then the parity of its hashes in each of 512 cells."""
    pairs = (least & np.uint64(3)).reshape(len(least), 2, -1)
    tokens = np.bitwise_or.reduce(pairs << (2 * np.arange(pairs.shape[2], dtype=np.uint64)), axis=2)
    odd = np.stack([np.bincount((h % np.uint64(64 * _CELLS)).astype(np.int64), minlength=64 * _CELLS) & 1 for h in hashes])
    parities = np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view("<u8")
    return np.concatenate([tokens, parities], axis=1)


def signed_nodes(texts: DataFrame, size: int) -> DataFrame:
    """``node, n, s0.., keys`` of ``node, text`` rows: number of shingles, sketch, and nodes at ``DEPTH`` (none for
    empty sets)."""

    def handle(columns):
        hashes = [shingles(t, size) for t in columns[1]]
        least = np.stack([_least(h, _OFFSETS, _FACTORS) for h in hashes])
        sketches, paths = _sketches(least, hashes).view(np.int64), _first_paths(least).view(np.int64)
        keys = [row.tolist() if len(h) else [] for row, h in zip(paths, hashes)]
        return [columns[0], [len(h) for h in hashes], *sketches.T.tolist(), keys]

    return map_slices(texts, handle, f"node long, n long, {', '.join(f'{c} long' for c in _SKETCH)}, keys array<long>")


def _possible(x: str, y: str, least: int) -> Column:
    """Whether numbers of shingles and sketches of two members allow the similarity.

    A shingle of one set alone turns one parity, so more odd cells than that differ only between sets further apart: this
    leaves out nothing, and is sharp for sets of up to some hundred shingles.  Of sets at 0.8 a token's two bits agree with
    probability 0.85; the limit for tokens lies five deviations away, so one similar pair in a million is left out.
    """
    together = F.col(f"{x}.n") + F.col(f"{y}.n")
    sizes = 100 * F.least(f"{x}.n", f"{y}.n") >= least * F.greatest(f"{x}.n", f"{y}.n")
    xor = [F.col(f"{x}.{part}").bitwiseXOR(F.col(f"{y}.{part}")) for part in _SKETCH[:2]]
    tokens = [F.bit_count(v.bitwiseOR(F.shiftrightunsigned(v, 1)).bitwiseAND(F.lit(0x5555555555555555))) for v in xor]
    # At the limit common = least (together - common) / 100, and together - 2 common shingles lie in one set alone.
    alone = _odd_cells(x, y) * (100 + least) <= together * (100 - least)
    return sizes & (tokens[0] + tokens[1] <= allowed_apart(least)) & alone


def _odd_cells(x: str, y: str) -> Column:
    """Cells of the sketches whose parities differ, which grow with the shingles that lie in one set alone."""
    return sum((F.bit_count(F.col(f"{x}.{part}").bitwiseXOR(F.col(f"{y}.{part}"))) for part in _SKETCH[2:]), F.lit(0))


def allowed_apart(least: int) -> int:
    """Tokens whose bits may differ between similar sets: the mean and five deviations."""
    count = len(_OFFSETS)
    differ = (1 - least / 100) * 3 / 4
    return min(count, int(np.ceil(count * differ + 5.1 * np.sqrt(count * differ * (1 - differ)))))


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _texts_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """One text for each of ``nodes``; a list of up to ``LISTED`` is sent to the texts, so that only theirs are exchanged."""
    nodes = settled(nodes.distinct())
    count = nodes.count()
    listed = F.broadcast(nodes) if count <= LISTED else nodes
    one = texts.join(listed, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    return one.coalesce(max(1, -(-count // TEXTS)))


def _verified(pairs: DataFrame, texts: DataFrame, size: int, least: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets share ``least`` hundredths of their union; every set is made once.

    Sets are kept on disk only as long as the pairs are verified, since checkpoints stay until the end.
    """
    pairs = settled(pairs.distinct(), TEXTS)
    if pairs.isEmpty():
        return pairs
    one = _texts_of(texts, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    hashed = map_slices(one, lambda c: [c[0], [shingles(t, size).view(np.int64) for t in c[1]]], "node long, hashes array<long>")
    sets = hashed.persist(StorageLevel.DISK_ONLY)
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    try:
        return settled(both.where(100 * common >= least * (F.size("x") + F.size("y") - common)).select("a", "b"))
    finally:
        sets.unpersist()


def _sketched(signed: DataFrame) -> DataFrame:
    """``node, member``: what :func:`_possible` compares."""
    return signed.select("node", F.struct("node", "n", *_SKETCH).alias("member"))


def _tree() -> Column:
    return F.shiftright("place", 48)


def _led(members: DataFrame) -> DataFrame:
    """``key, place, node, leader`` of ``key, place, node`` rows, where a node of the tree has several members.

    The leader is the member with the least hash of itself and the tree, so that nodes with many common members mostly
    have the same one.
    """
    shared = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    held = settled(members.join(shared, "key").select("key", "place", "node"))
    return held.join(held.groupBy("key").agg(F.min_by("node", F.xxhash64("node", _tree())).alias("leader")), "key")


def _candidates(pairs: DataFrame, signed: DataFrame, least: int) -> DataFrame:
    """``a, b``: the pairs ``node, other`` whose sketches allow the similarity."""
    pairs = pairs.where("node <> other").select(*_ordered("node", "other")).distinct()
    members = _sketched(signed)
    return pairs.join(members.toDF("a", "x"), "a").join(members.toDF("b", "y"), "b").where(_possible("x", "y", least)).select("a", "b")


def _contracted(forest: DataFrame, links: DataFrame) -> DataFrame:
    """``a, b``: each member of a class with its root, for the classes of ``forest`` joined by ``links``."""
    return forest if links.isEmpty() else components(forest.unionByName(links)).toDF("a", "b")


def _apart(pairs: DataFrame, forest: DataFrame) -> DataFrame:
    """The pairs ``node, other`` of members of different classes."""
    own, others = forest.toDF("node", "label"), forest.toDF("other", "other_label")
    labelled = pairs.distinct().join(own, "node", "left").join(others, "other", "left")
    return labelled.where(F.coalesce("label", "node") != F.coalesce("other_label", "other")).select("node", "other")


def _classed(rows: DataFrame, forest: DataFrame) -> DataFrame:
    """The rows of nodes with members of several classes, with ``label``, the node's largest class ``main`` and the number
    of members ``outside`` it."""
    labelled = rows.select("key", "place", "node", "leader").join(forest.toDF("node", "label"), "node", "left")
    labelled = settled(labelled.withColumn("label", F.coalesce("label", "node")))
    classes = labelled.groupBy("key", "label").agg(F.count("*").alias("members"))
    nodes = classes.groupBy("key").agg(
        F.max_by("label", F.struct("members", "label")).alias("main"),
        (F.sum("members") - F.max("members")).alias("outside"),
    )
    return labelled.join(nodes.where("outside > 0"), "key")


def _with_main(mixed: DataFrame, turn: int = 0) -> DataFrame:
    """``node, other``: members outside a node's largest class, with up to ``MEET`` of that class, others in each turn."""
    least = [F.min_by("node", F.xxhash64("node", "label", _tree(), F.lit(turn * MEET + i))) for i in range(MEET)]
    chosen = mixed.where("label = main").groupBy("key").agg(F.array_distinct(F.array(*least)).alias("others"))
    return mixed.where("label <> main").join(chosen, "key").select("node", F.explode("others").alias("other"))


def _nearest(pairs: DataFrame, signed: DataFrame, least: int) -> DataFrame:
    """``a, b``: of the pairs ``node, other`` whose sketches allow the similarity one for each ``node``, the likeliest."""
    members = _sketched(signed)
    met = pairs.where("node <> other").distinct().join(members.toDF("node", "x"), "node").join(members.toDF("other", "y"), "other")
    best = met.where(_possible("x", "y", least)).groupBy("node").agg(F.min_by("other", F.struct(_odd_cells("x", "y"), "other")).alias("other"))
    return best.select(*_ordered("node", "other"))


def _exhaustive(rows: DataFrame, signed: DataFrame, least: int) -> DataFrame:
    """``a, b``: in each node all members outside the main class, with all members of other classes than their own.

    A pair outside the main class comes up once, from its smaller member; pairs with the leader were verified before.  A
    node with more than ``SMALL`` outside is cut into blocks, and each pair of blocks is a key of its own.
    """
    blocks = F.ceil(F.sqrt(F.col("outside") / SMALL)).cast("int")
    rows = rows.where("node <> leader").join(_sketched(signed), "node").withColumn("blocks", blocks)
    own = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    cells = rows.withColumn("own", own).withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = cells.where("label <> main").select("key", F.col("own").alias("i"), F.col("cell").alias("j"), F.col("member").alias("x"), F.col("label").alias("label_x"))
    right = cells.select("key", F.col("cell").alias("i"), F.col("own").alias("j"), F.col("member").alias("y"), F.col("label").alias("label_y"), "main")
    once = (F.col("label_y") == F.col("main")) | (F.col("x.node") < F.col("y.node"))
    pairs = left.join(right, ["key", "i", "j"]).where((F.col("label_x") != F.col("label_y")) & once & _possible("x", "y", least))
    return pairs.select(*_ordered("x.node", "y.node"))


def _branched(rows: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The members of large nodes in the children that they choose, as ``key, place, node``."""

    def handle(columns):
        out = [[], [], []]
        for node, text, keys, places in zip(*columns):
            hashes = shingles(text, size)
            for key, place in zip(np.array(keys, dtype=np.int64).view(np.uint64), places):
                for column, value in zip(out, (*_children(key, place, hashes), node)):
                    column.extend(value if isinstance(value, list) else [value] * (len(out[0]) - len(out[2])))
        return out

    paths = rows.groupBy("node").agg(F.collect_list("key").alias("keys"), F.collect_list("place").alias("places"))
    one = _texts_of(texts, paths.select("node"))
    return map_slices(one.join(paths, "node").select("node", "text", "keys", "places"), handle, "key long, place long, node long")


def links(texts: DataFrame, signed: DataFrame, *, size: int, least: int = 80, first: DataFrame | None = None) -> DataFrame:
    """``a, b``: texts with the root of their class, one row per text that verified links connect to a smaller one.

    ``texts`` has ``node, text``, repeated nodes allowed; ``signed`` one row per node from :func:`signed_nodes`.  Pairs
    ``first``, found by another method, are verified before those of the tree.
    """
    paths = signed.select("node", F.posexplode("keys").alias("path", "key"))
    tree, leaf = F.floor(F.col("path") / _LEAVES).cast("long"), (F.col("path") % _LEAVES).cast("long")
    members = paths.select("key", (tree * F.lit(1 << 48) + _LEAVES + leaf).alias("place"), "node")
    forest = texts.sparkSession.createDataFrame([], "a long, b long")

    def verified(pairs: DataFrame) -> DataFrame:
        return _contracted(forest, _verified(pairs, texts, size, least))

    if first is not None:
        forest = verified(first)
    for depth in range(DEPTH, DEEPEST + 1):
        rows = settled(_led(members))
        led = rows.select("node", F.col("leader").alias("other"))
        # One leader for each member: a crowd is one class after that, and its other leaders need no pairs.
        one = led.where("node <> other").groupBy("node").agg(F.min_by("other", F.xxhash64("other")).alias("other"))
        forest = verified(_candidates(_apart(one, forest), signed, least))
        forest = verified(_candidates(_apart(led, forest), signed, least))
        mixed = settled(_classed(rows, forest))
        # Those that missed their leaders meet some of the largest class and are verified with the nearest of these: around a
        # crowd whose ends are not similar, each turn brings in the next, and few classes are left to compare.
        for turn in range(TURNS):
            before, forest = forest, verified(_nearest(_with_main(mixed, turn), signed, least))
            if forest is before:
                break
            mixed = settled(_classed(mixed, forest))
        deeper = mixed.where(F.col("outside") > SMALL)
        last = depth == DEEPEST or deeper.isEmpty()
        judged = mixed if last else mixed.where(F.col("outside") <= SMALL)
        forest = verified(_exhaustive(judged, signed, least))
        if last:
            return forest
        members = settled(_branched(deeper, texts, size))
    raise AssertionError("the loop ends at the last depth")


def similar_sets(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 2, least: int = 80, link_empty: bool = False,
    first: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per row of ``docs``.

    Documents are linked if they share ``least`` hundredths of the union of their distinct runs of ``size`` words;
    ``component_id`` is the smallest id that links reach.  Null, empty and blank texts have no shingles and are linked with nothing,
    with each other if ``link_empty``.  Equal texts are one member of the join (64-bit hash of the text), so copies
    cost one row each; a text that a third of all documents share is summed and joined back per salt.  Null ids
    are left out of the minimum; a component without any id is null.  Repeated rows come back repeated.  Other columns
    are ignored, so their names cannot clash.  ``first`` gives pairs ``a, b`` of ``node, text`` rows, which are verified ahead.
    """
    own = columns_of(docs, {"doc_id": id_col, "text": text_col}).withColumn("text", F.coalesce("text", F.lit("")))
    own = own.withColumn("node", F.xxhash64("text"))
    salted = own.select("doc_id", "node", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)).cast("int").alias("salt"))
    signed = signed_nodes(own.select("node", "text"), size)
    signed = settled(signed.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", *_SKETCH, "keys"))), TEXTS)
    texts = own.select("node", "text")
    found = links(texts, signed, size=size, least=least, first=first(texts) if first else None)
    if link_empty:
        empty = signed.where("n = 0").select("node")
        found = found.unionByName(empty.select(F.col("node").alias("a"), F.lit(empty.agg(F.min("node")).first()[0]).cast("long").alias("b")))
    roots = components(found)
    rooted = signed.select("node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = stable(salted.groupBy("node", "salt").agg(F.min("doc_id").alias("least")))
    each = stable(parts.groupBy("node").agg(F.min("least").alias("least")).join(rooted, "node"))
    named = each.groupBy("root").agg(F.min("least").alias("component_id"))
    by_part = parts.select("node", "salt").join(each.join(named, "root").select("node", "n", "component_id"), "node")
    alone = (F.col("n") == 0) & F.lit(not link_empty)
    return salted.join(by_part, ["node", "salt"]).select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def op13_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_sets(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


QUERIES = {"op13_chosen_path": op13_chosen_path}
#: Comparing all pairs in SQL is too slow on whole tables; tests compare with brute force.
SQL: dict[str, str] = {}
