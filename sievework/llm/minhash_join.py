"""Near-duplicate documents by an inverted join of MinHash signature coordinates (operator 3).

Documents with the same shingle set form a class, and one row stands for each class. A class posts its COORDINATES signature
values, each keyed by (coordinate, value). Values that one class alone holds can't match; the others are ordered from rare to
common, and a class posts only a prefix: a pair with THRESHOLD or more equal values must meet in both prefixes, so the long
lists of common values are skipped. Pairs that meet are counted over all coordinates, those at the threshold are confirmed on
their full shingle sets, and the confirmed links' connected components are the result.

A list of many near copies is not expanded into all pairs. First every member is compared with its list's leader, the member
that shares most of its shingles; members that are linked by then need no comparison. What is left of a list, members outside
its largest component, is compared with every member of another component whose set has a size it can be linked with, so no
link between components is lost. Sizes are bounded by the shingles that a class shares with any other one, and a
bitmap of each set bounds what two sets have in common.

A pair at similarity 0.75 has fewer than THRESHOLD of its COORDINATES values in common with a probability of 3e-6.

Defined cases: null, empty and blank texts have an empty set, link with nothing and keep their doc_id as component_id; fewer
than five words count as one shingle; rows that repeat a doc_id are one document if their sets are equal and are linked by
their sets otherwise; a null doc_id ranks above all others; of a component whose ids are all null one text is kept, that with
the least digests, and component_id is null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import Recent, Scratch, fresh, stage

SHINGLE, SIMILARITY = 5, 75
COORDINATES, THRESHOLD = 64, 31
STAR_ROUNDS = 1
BAND = 1.05
BIT_WORDS = 16
_RNG = np.random.default_rng(7)
_FACTORS = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH = "doc_id long, text_hash string, n_shingles long, node binary, keys array<long>"
#: Tells rows without an id apart.
_TEXT_HASH = "case when doc_id is null then md5(cast(coalesce(cast(text as string), '') as binary)) end"


@lru_cache(maxsize=1)
def _word_hashes() -> Recent:
    return Recent(xxhash.xxh3_64_intdigest, 300_000)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct word shingles."""
    words = text.encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII white-space characters
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    h = np.fromiter(map(_word_hashes().__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(words) - SHINGLE + 1
    total = h[:n] * _PLACES[0]
    for k in range(1, SHINGLE):
        total += h[k : k + n] * _PLACES[k]
    return np.unique(_mixed(total))


def signature_keys(shingles: np.ndarray) -> np.ndarray:
    """One signed 64-bit key for each (coordinate, least value)."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(low, (shingles[i : i + 2048, None] * _FACTORS).min(axis=0), out=low)
    return _mixed(low ^ _FACTORS).view(np.int64)


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * BIT_WORDS buckets: whether it holds an odd number of shingles. Bits that differ between two sets
    are at most as many as the shingles that only one of the two holds."""
    odd = np.bincount((shingles % np.uint64(64 * BIT_WORDS)).astype(np.int64), minlength=64 * BIT_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, nodes, keys = [], [], []
        for value in batch.column(2):
            shingles = shingle_set(value.as_py() or "")
            counts.append(len(shingles))
            nodes.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
            keys.append(signature_keys(shingles) if len(shingles) else np.zeros(0, dtype=np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*keys, np.zeros(0, dtype=np.int64)])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), listed], names=["doc_id", "text_hash", "n_shingles", "node", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, sets, bits = [], [], []
        for wanted, value in zip(batch.column(0), batch.column(1), strict=True):
            shingles = shingle_set(value.as_py() or "")
            if xxhash.xxh3_128_digest(shingles.tobytes()) == wanted.as_py():  # else a row that repeats the doc_id
                nodes.append(wanted.as_py())
                sets.append(shingles.view(np.int64))
                bits.append(parity_bits(shingles))
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sets, np.zeros(0, dtype=np.int64)])))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), listed, pa.array(bits, pa.list_(pa.int64()))], names=["node", "shingles", "bits"])


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(_TEXT_HASH).alias("text_hash"), F.col("text").cast("string").alias("text"))


def prefix_posts(classes: DataFrame, stages: Scratch) -> DataFrame:
    """(key, node): the posts of each class's prefix, values that no other class holds left out."""
    posts = classes.select("node", F.explode("keys").alias("key"))
    shared = stages(posts.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"), "shared")  # staged: a hot key's join is split
    ordered = posts.join(shared, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("held", "key"))).alias("values"))
    enough = ordered.filter(F.size("values") >= THRESHOLD)
    return enough.select("node", F.explode(F.expr(f"slice(values, 1, size(values) - {THRESHOLD - 1})")).alias("value")).select("value.key", "node")


def confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) those with enough equal coordinates and, on full sets, the similarity asked for."""
    keys = classes.select("node", "keys")
    met = pairs.join(keys.toDF("a", "keys_a"), "a").join(keys.toDF("b", "keys_b"), "b")
    met = met.filter(F.size(F.array_intersect("keys_a", "keys_b")) >= THRESHOLD).select("a", "b")
    full = met.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    full = full.withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    return full.filter(f"100 * common >= {SIMILARITY} * (size(set_a) + size(set_b) - common)").select("a", "b")


def _band(n: str) -> str:
    """A set size's place on a logarithmic scale, as an SQL expression."""
    return f"cast(floor(ln(greatest(1, floor({n}))) / ln({BAND})) as int)"


def size_bounds(sets: DataFrame) -> DataFrame:
    """(node, n, most, bits): a class's set size and the largest set it can be linked with; classes that can't be linked are left out.

    A shingle that one class alone holds is in no intersection. With s shared shingles of n, a partner of size m needs
    s >= SIMILARITY / (100 + SIMILARITY) * (n + m), so m is bounded; it is at least SIMILARITY % of n.
    """
    held = sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("held"), F.min("node").alias("node"))
    alone = held.filter("held = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    sized = sets.select("node", "bits", F.size("shingles").alias("n")).join(alone, "node", "left")
    sized = sized.withColumn("most", F.expr(f"(n - coalesce(alone, 0)) * {100 + SIMILARITY} div {SIMILARITY} - n"))
    return sized.filter(f"100 * most >= {SIMILARITY} * n").select("node", F.col("n").cast("long").alias("n"), F.col("most").cast("long").alias("most"), "bits")


def _may_link(n: str, most: str, bits: str, other_n: str, other_most: str, other_bits: str) -> str:
    """Necessary for a link, by sizes and by the bits that differ."""
    differ = " + ".join(f"bit_count({bits}[{i}] ^ {other_bits}[{i}])" for i in range(BIT_WORDS))
    return f"{n} <= {other_most} and {other_n} <= {most} and 100 * {n} >= {SIMILARITY} * {other_n} and 100 * {other_n} >= {SIMILARITY} * {n} and {100 - SIMILARITY} * ({n} + {other_n}) >= {100 + SIMILARITY} * ({differ})"


def links_between_classes(classes: DataFrame, sets_of, stages: Scratch) -> DataFrame:
    """(node, comp) of the classes that are linked to another one. sets_of: from nodes to their shingle sets."""
    posts = stages(prefix_posts(classes, stages), "posts")
    nodes = posts.select("node").distinct()
    sets = stages(sets_of(classes.join(nodes, "node")), "sets")
    sized = stages(size_bounds(sets), "sizes")
    few = stages(classes.join(sized.select("node"), "node").select("node", "keys"), "active")
    sets = sets.join(sized.select("node"), "node", "left_semi").select("node", "shingles")
    posts = stages(posts.join(sized, "node"), "posts")
    labels, found = few.select("node", F.col("node").alias("comp")), None
    for star in range(STAR_ROUNDS + 1):
        labelled = posts.join(labels, "node")
        sizes = labelled.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"))
        open_keys = stages(sizes.groupBy("key").agg(F.max(F.struct("size", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).filter("comps > 1"), "open-keys")
        open_posts = stages(labelled.join(open_keys, "key").select("key", "node", "n", "most", "bits", "comp", (F.col("comp") != F.col("main.comp")).alias("minor")), "open")
        if open_posts.isEmpty():
            break
        if star == STAR_ROUNDS:  # every member outside a list's largest component with every member of another one that has a size it can be linked with
            outside = open_posts.filter("minor").select("key", F.col("node").alias("x"), F.col("n").alias("n_x"), F.col("most").alias("most_x"), F.col("bits").alias("bits_x"), F.col("comp").alias("comp_x"))
            outside = outside.withColumn("band", F.explode(F.expr(f"sequence({_band(f'n_x * {SIMILARITY} / 100')}, {_band(f'least(most_x, n_x * 100 / {SIMILARITY})')})")))
            inside = open_posts.select("key", F.col("node").alias("y"), F.col("n").alias("n_y"), F.col("most").alias("most_y"), F.col("bits").alias("bits_y"), F.col("comp").alias("comp_y"), F.col("minor").alias("minor_y"), F.expr(_band("n")).alias("band"))
            pairs = outside.join(inside, ["key", "band"]).filter(f"comp_x != comp_y and (not minor_y or x < y) and {_may_link('n_x', 'most_x', 'bits_x', 'n_y', 'most_y', 'bits_y')}")
        else:  # the leader is the member that shares most, or, later, any other one
            order = F.struct(F.col("n") / (F.col("most") + F.col("n")), "node") if star == 0 else F.struct(F.xxhash64("node", F.lit(star)), "node")
            leaders = stages(open_posts.groupBy("key").agg(F.min_by(F.struct("node", "comp", "n", "most", "bits"), order).alias("leader")), "leaders")
            pairs = open_posts.join(leaders, "key").filter(f"comp != leader.comp and {_may_link('n', 'most', 'bits', 'leader.n', 'leader.most', 'leader.bits')}").select(F.col("node").alias("x"), F.col("leader.node").alias("y"))
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        new = stages(confirmed(pairs, few, sets), "links")
        found = new if found is None else found.union(new)
        labels = few.select("node").join(connected_components(found), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
    return labels


def _placed_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (of rows without an id), n_shingles, component_id, kept for every row of docs."""
    plain, stages = _plain(docs), Scratch(docs.sparkSession)
    sketch = stages(plain.mapInArrow(_sketches, _SKETCH), "sketch")
    # a class's rows have equal keys; first_hash finds the text of a class without ids
    classes = sketch.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.expr("case when min(doc_id) is null then min(text_hash) end").alias("first_hash"), F.first("keys").alias("keys"))
    classes = stages(classes, "classes")

    def sets_of(few: DataFrame) -> DataFrame:
        wanted = few.select("first_id", "first_hash", "node")
        met = F.col("first_id").eqNullSafe(F.col("doc_id")) & F.col("first_hash").eqNullSafe(F.col("text_hash"))
        return wanted.join(plain, met).select("node", "text").mapInArrow(_sets, "node binary, shingles array<long>, bits array<long>").dropDuplicates(["node"])

    labels = links_between_classes(classes, sets_of, stages)
    lowest = classes.select("node", "first_id").join(labels, "node")
    least = stages(lowest.groupBy("comp").agg(F.min("first_id").alias("component_id"), F.min("node").alias("main")), "least")
    lowest = lowest.join(least, "comp").select("node", "component_id", "main")
    by_class = classes.select("node", "first_id", "first_hash").join(lowest, "node", "left").select(F.col("node").alias("place"), F.coalesce("component_id", "first_id").alias("component_id"), F.expr("case when coalesce(main, node) = node then first_hash end").alias("kept_hash"))
    placed = sketch.select("doc_id", "text_hash", "n_shingles", F.coalesce("node", F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "utf-8")).alias("place"))
    out = placed.join(by_class, "place", "left").select("doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "kept_hash")
    kept = F.expr("doc_id <=> component_id and (doc_id is not null or n_shingles = 0 or text_hash <=> kept_hash)")
    out = stage(out.withColumn("kept", kept).drop("kept_hash"), "near")
    stages.drop()
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    return _placed_rows(docs).drop("text_hash")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the one with the least doc_id; rows that repeat that doc_id stay with it, and
    rows without ids stay or go by their text."""
    gone_id, gone_text = fresh(docs, "gone_id", "gone_text")
    gone = _placed_rows(docs).filter("not kept").select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_text)).distinct()
    met = F.col("doc_id").cast("long").eqNullSafe(F.col(gone_id)) & F.expr(_TEXT_HASH).eqNullSafe(F.col(gone_text))
    return docs.join(gone, met, "left_anti")
