"""Near-duplicates by circulant MinHash.

A document's set is that of its distinct word shingles (64-bit hashes; see shingles.py). Two permutations give the whole signature: the first,
a bijective mix of the hash, puts each shingle at a place of a ring; the second is a fixed permutation of the ring, and coordinate k is
its least value over the set's places shifted by k. Bands of ROWS coordinates are bucket keys.

Documents with equal sets are one class, so copies cost one row. Classes that share a bucket form candidate clusters, by connected
components. There the links are confirmed on the full sets. A cluster of up to BLOCK classes is judged as a whole. In a larger one each class
is first compared with a few heads of its buckets, which joins groups of near copies at a cost that grows with their number and not its square;
then what isn't in one group yet is cut into blocks, and the pairs of blocks that share a bucket, hold different groups and may have a link by
their sizes are judged, each on its own, so that no group meets in one task. Only a spanning forest of the links leaves a task, never all
pairs. Components of these links, with the smallest doc_id of each, are the result.

A pair at the threshold shares no bucket with probability (1 - t**rows) ** BANDS, 3e-6 at 0.85 and 5e-6 at 0.8; a chain of other links often
joins such a pair all the same.

Null and empty texts have an empty set and are linked with nothing. Rows with equal sets are in one component, whatever their doc_ids; a row is kept
if its doc_id is the component's smallest, so repeated rows are kept or not together. Rows that share a doc_id but no link are documents of
their own. A component whose rows all lack a doc_id has a null component_id and is kept; in others such rows aren't kept. Other columns are
ignored, whatever their names. An empty table gives an empty result. Texts of any length are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import checkpointed, map_rows, sliced, staged, table
from tidemark.llm.shingles import Words, mixed, shingle_set
from tidemark.operators.components import attached, components

RING, BANDS, SEED = 1 << 20, 40, 20240229
#: Classes that are judged together, more or less, and columns of the incidence matrix at once.
BLOCK, COLUMNS = 256, 4096
#: Shingles from which a set counts more than once in a block; heads that a class of a large cluster is compared with; members of a head that are compared in one group, about.
LOAD, HEADS, SALT_ROWS = 2048, 4, 50_000


def rows_of(percent: int) -> int:
    """Coordinates in a band: as many as leave a pair at the threshold about 0.27 of sharing a given band."""
    return max(1, round(math.log(0.27) / math.log(min(percent, 99) / 100)))


@lru_cache(2)
def _ring(width: int) -> np.ndarray:
    """ring[p] holds the second permutation's values from place p on, width of them."""
    order = np.random.default_rng(SEED).permutation(RING).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[:width]]), width)


def signature(shingles: np.ndarray, width: int) -> np.ndarray:
    """Circulant MinHash coordinates of a non-empty set."""
    places = (mixed(shingles ^ np.uint64(SEED)) >> np.uint64(44)).astype(np.int64)
    ring, least = _ring(width), np.full(width, RING, np.uint32)
    for a in range(0, len(places), 4096):
        np.minimum(least, ring[places[a : a + 4096]].min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band, different between bands."""
    key = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
    for column in least.reshape(BANDS, rows).T.astype(np.uint64):
        key = mixed(key) + column
    return mixed(key)


def set_hash(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    high, low = np.frombuffer(blake2b(own.tobytes(), digest_size=16).digest(), np.int64).tolist()
    return high, low


def _set_rows(docs: DataFrame, k: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, hi and lo (a 128-bit hash of the set) and band keys, of every row."""

    def make():
        words = Words()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, high, low, bands = [], [], [], []
            for text in batch.column("text").to_pylist():
                own = shingle_set(words.hashes(text or ""), k)
                n.append(len(own))
                hi, lo = set_hash(own)
                high.append(hi)
                low.append(lo)
                bands.append(band_keys(signature(own, rows * BANDS), rows).view(np.int64) if len(own) else None)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "hi", "lo", "bands"])

        return one

    return map_rows(docs, make, "doc_id long, n_shingles long, hi long, lo long, bands array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """The set of each row as bytes, and its hash."""

    def make():
        words = Words()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [shingle_set(words.hashes(t or ""), k) for t in batch.column("text").to_pylist()]
            hashes = [set_hash(own) for own in found]
            return pa.RecordBatch.from_arrays([*(pa.array([h[i] for h in hashes], pa.int64()) for i in (0, 1)), pa.array([own.tobytes() for own in found], pa.binary())], names=["hi", "lo", "items"])

        return one

    return map_rows(docs, make, "hi long, lo long, items binary")


def links(sets: list[np.ndarray], percent: int, split: int | None = None) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of sets with 100 * intersection >= percent * union; with split, only those with i < split <= j."""
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        common = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]] * 2)
    else:
        values, at = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        seen = np.bincount(at, None, len(values))
        rank = np.cumsum(seen > 1) - 1  # only shingles of several sets get a column
        shared = seen[at] > 1
        at, owner = rank[at[shared]], owner[shared]
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        common = np.zeros((len(sets), len(sets)), np.float64)
        for a in range(0, int(rank[-1]) + 1, COLUMNS):
            low, high = np.searchsorted(at, (a, a + COLUMNS))
            part = np.zeros((len(sets), COLUMNS), np.float32)
            part[owner[low:high], at[low:high] - a] = 1
            common += part @ part.T
    linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    i, j = np.nonzero(np.triu(linked, 1))
    if split is not None:
        keep = (i < split) & (j >= split)
        i, j = i[keep], j[keep]
    yield from zip(i.tolist(), j.tolist(), strict=True)


def _forest(nodes: list[int], pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, smallest node reachable) for every node that isn't its own smallest. Places with the same node belong together."""
    place: dict[int, int] = {}
    up = [place.setdefault(node, i) for i, node in enumerate(nodes)]

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in pairs:
        a, b = root(i), root(j)
        if a != b:
            a, b = (a, b) if nodes[a] < nodes[b] else (b, a)
            up[b] = a
    return [(nodes[x], nodes[root(x)]) for x in place.values() if root(x) != x]


def _grouped(rows: DataFrame, key: list[str], judge: Callable[[list[dict]], list[tuple[int, int]]]) -> DataFrame:
    """Edges (a, b) that judge finds in each group of rows with equal keys; groups stream through sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at, out = [], None, []
        for batch in sliced(batches):
            for row in batch.to_pylist():
                own = tuple(row[c] for c in key)
                if own != at:
                    out += judge(group)
                    group, at = [], own
                group.append(row)
            yield _edges(out)
            out = []
        yield _edges(judge(group))

    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long")


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _star_links(rows: DataFrame, percent: int) -> DataFrame:
    """rows (b, salt, member, node, items) -> links (a, b): a member's set against that of the head of its group, which sorts first. Groups stream, whatever their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in sliced(batches):
            found = []
            for r in batch.to_pylist():
                items = np.frombuffer(r["items"], np.uint64)
                if not r["member"]:
                    head = items
                else:
                    common = len(np.intersect1d(items, head, assume_unique=True))
                    if 100 * common >= percent * (len(items) + len(head) - common):
                        found.append((r["node"], r["b"]))
            yield _edges(found)

    return rows.repartition("b", "salt").sortWithinPartitions("b", "salt", "member").mapInArrow(run, "a long, b long")


def _stars(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """buckets (node, key) -> confirmed links (a, b) of each node with up to HEADS heads of its buckets, one head a bucket.

    The head is that with the least number mixed with the key, so the buckets of a group have different heads. Groups of a head are cut by SALT_ROWS.
    """
    heads = buckets.withColumn("p", F.col("node").bitwiseXOR(F.col("key"))).groupBy("key").agg(F.min("p").alias("p"), F.count("*").alias("n")).filter("n > 1")
    heads = checkpointed(heads.select("key", F.col("p").bitwiseXOR(F.col("key")).alias("b"), "n"))
    met = attached(buckets, heads, ["key"], "n", buckets.count()).filter("node <> b").groupBy("node", "b").agg(F.count("*").alias("shared"))
    order = Window.partitionBy("node").orderBy(F.desc("shared"), "b")
    stars = checkpointed(met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= HEADS).select("node", "b"))
    salted = stars.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(max(8, stars.count() // SALT_ROWS))))
    members = salted.join(sets, "node").select("b", "salt", F.lit(True).alias("member"), "node", "items")
    tops = salted.select("b", "salt").distinct().join(sets.withColumnRenamed("node", "b"), "b").select("b", "salt", F.lit(False).alias("member"), F.col("b").alias("node"), "items")
    return _star_links(members.unionByName(tops), percent)


def _pairs_of_blocks(buckets: DataFrame, blocked: DataFrame, percent: int) -> DataFrame:
    """cluster, left and right: the pairs of blocks in which a link between different groups can be, as they share a bucket and their sizes allow one.

    Two members of a bucket from different groups aren't both in the group that most of the bucket's blocks are of, so each block meets only those
    with others; the blocks of one large group don't meet each other.
    """
    held = buckets.join(blocked, "node").groupBy("key", "cluster", "block").agg(F.min("group").alias("low"), F.max("group").alias("high"))
    held = checkpointed(held)
    tops = held.groupBy("key", "low").agg(F.count("*").alias("n"), F.max("high").alias("most")).groupBy("key").agg(F.max_by("low", F.struct("n", "low")).alias("top"), F.min("low").alias("least"), F.max("most").alias("most")).filter("least < most")
    others = held.join(tops.select("key", "top"), "key").filter("low <> top or high <> top").select("key", F.col("block").alias("other"))
    pairs = held.select("key", "cluster", "block").join(others, "key").select("cluster", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")).distinct()
    blocks = blocked.groupBy("cluster", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("group").alias("first"), F.max("group").alias("last"))
    for side in ("left", "right"):
        pairs = pairs.join(blocks.select("cluster", F.col("block").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("low", "high", "first", "last"))), ["cluster", side])
    one = (F.col("left_first") == F.col("left_last")) & (F.col("left_first") == F.col("right_first")) & (F.col("left_first") == F.col("right_last"))
    fit = (F.col("left_high") * 100 >= F.col("right_low") * percent) & (F.col("right_high") * 100 >= F.col("left_low") * percent)
    return pairs.filter(fit & ~one).select("cluster", "left", "right")


def _judge_small(percent: int) -> Callable[[list[dict]], list[tuple[int, int]]]:
    def judge(group: list[dict]) -> list[tuple[int, int]]:
        return _forest([r["node"] for r in group], links([np.frombuffer(r["items"], np.uint64) for r in group], percent)) if len(group) > 1 else []

    return judge


def _judge_blocks(percent: int) -> Callable[[list[dict]], list[tuple[int, int]]]:
    def judge(group: list[dict]) -> list[tuple[int, int]]:
        if not group:
            return []
        group = sorted(group, key=lambda r: r["block"])
        split = None if group[0]["left"] == group[0]["right"] else sum(r["block"] == r["left"] for r in group)
        return _forest([r["node"] for r in group], links([np.frombuffer(r["items"], np.uint64) for r in group], percent, split)) if len(group) > 1 else []

    return judge


def _large(clustered: DataFrame, buckets: DataFrame, percent: int) -> DataFrame:
    """Links of the clusters that are too large to be judged as a whole: clustered (cluster, node, n, load, items) and their buckets (node, key)."""
    sets = clustered.select("node", "items")
    stars = checkpointed(_stars(buckets, sets, percent))
    groups = components(stars)
    members = clustered.select("cluster", "node", "n", "load").join(groups, "node", "left").select("cluster", F.coalesce("component", "node").alias("group"), "n", "node", "load")
    # blocks in the order of group and size, without a task that sees a whole cluster: running loads in a range, and the loads of the ranges before
    order = ["cluster", "group", "n", "node"]
    ranged = checkpointed(members.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("cluster", "part").agg(F.sum("load").alias("rows"))
    parts = parts.withColumn("before", F.sum("rows").over(Window.partitionBy("cluster").orderBy("part")) - F.col("rows")).drop("rows")
    own = F.sum("load").over(Window.partitionBy("cluster", "part").orderBy(*order[1:])) - F.col("load")
    blocked = checkpointed(ranged.withColumn("own", own).join(parts, ["cluster", "part"]).select(*order, F.floor((F.col("before") + F.col("own")) / BLOCK).alias("block")))
    pairs = checkpointed(_pairs_of_blocks(buckets, blocked, percent))
    wanted = pairs.select("*", F.col("left").alias("block")).unionByName(pairs.filter("left <> right").select("*", F.col("right").alias("block")))
    rows = sets.join(blocked.select("cluster", "node", "block"), "node").join(wanted, ["cluster", "block"])
    return stars.unionByName(_grouped(rows.select("cluster", "left", "right", "block", "node", "items"), ["cluster", "left", "right"], _judge_blocks(percent)))


def _confirmed(clustered: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """clustered (cluster, size, node, n, load, items) -> edges of a spanning forest of the links."""
    small = _grouped(clustered.filter(F.col("size") <= BLOCK).select("cluster", "node", "items"), ["cluster"], _judge_small(percent))
    large = clustered.filter(F.col("size") > BLOCK).drop("size")
    if large.isEmpty():
        return small
    buckets = checkpointed(classes.join(large.select("node"), "node", "left_semi").select("node", F.explode("bands").alias("key")))
    return small.unionByName(_large(large, buckets, percent))


def _load(n: Column) -> Column:
    """What a set of n shingles counts in a block: 1, and more if it is large, so that a block is bounded in bytes."""
    return F.floor(n / LOAD) + 1


def judged(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, hi and lo (the set's hash), component (a number, null for an empty set) and component_id of each row of docs (doc_id, text)."""
    rows, _ = staged(_set_rows(docs, k, rows_of(percent)), "shingles")
    classes = rows.filter("n_shingles > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("low"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"), F.count("*").alias("copies"))
    classes, _ = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    buckets = classes.select("node", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("most"), F.count("*").alias("weight")).filter("b < most").select("key", "b", "weight")
    stars = attached(buckets, shared, ["key"], "weight", BANDS * classes.count()).select(F.col("node").alias("a"), "b")
    clusters = components(stars).withColumnRenamed("component", "cluster")
    clusters = checkpointed(clusters.join(classes.select("node", "n", "low", "hi", "lo"), "node"))
    sizes = clusters.groupBy("cluster").agg(F.sum(_load(F.col("n"))).alias("size"), F.count("*").alias("weight"))
    # the texts of the clustered classes: a row's set is taken if its hash is the class's, as rows may repeat a doc_id
    named = docs.join(clusters.select(F.col("low").alias("doc_id")).distinct(), "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))
    sets = _sets(named, k).filter("length(items) > 0").dropDuplicates(["hi", "lo"])
    members = attached(clusters, sizes, ["cluster"], "weight", clusters.count()).select("cluster", "size", "node", "n", _load(F.col("n")).alias("load"), "hi", "lo")
    clustered = checkpointed(sets.join(members, ["hi", "lo"]).drop("hi", "lo"))
    found = checkpointed(components(_confirmed(clustered, classes, percent)).join(classes.select("node", "low"), "node"))
    lows = found.groupBy("component").agg(F.min("low").alias("least"), F.count("*").alias("weight"))
    found = attached(found, lows, ["component"], "weight", found.count()).select("node", "component", "least")
    names = checkpointed(classes.join(found, "node", "left").select("hi", "lo", F.coalesce("component", "node").alias("component"), F.coalesce("least", "low").alias("least"), "copies"))
    rows = rows.select("doc_id", "n_shingles", "hi", "lo")
    named = attached(rows.filter("n_shingles > 0"), names, ["hi", "lo"], "copies", rows.count())
    empty = rows.filter("n_shingles = 0").select("*", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("least"))
    return named.unionByName(empty).withColumnRenamed("least", "component_id")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach) and kept.

    Links are pairs with 100 * intersection >= percent * union of their sets of k-word shingles.
    """
    rows = judged(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), k, percent)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _hashed(rows: DataFrame, k: int) -> DataFrame:
    """rows (doc_id, text, doc) with the hash of their set."""

    def make():
        words = Words()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [set_hash(shingle_set(words.hashes(t or ""), k)) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([h[i] for h in found], pa.int64()) for i in (0, 1))], names=[*batch.schema.names, "hi", "lo"])

        return one

    return map_rows(rows, make, StructType([*rows.schema.fields, StructField("hi", LongType()), StructField("lo", LongType())]))


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each component, that with the smallest doc_id, and every row without words.

    Of several rows of a component with that doc_id, the one with the least text stays. Columns may have any names.
    """
    whole = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.struct(*(docs[c] for c in docs.columns)).alias("doc"))
    rows = checkpointed(judged(whole.select("doc_id", "text"), k, percent))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = checkpointed(rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(kept).alias("kept")).filter("n > 1 or not kept or doc_id is null"))
    sure = whole.select("doc_id", "doc").join(ids.select("doc_id"), "doc_id", "left_anti").filter("doc_id is not null").select("doc.*")
    again = ids.filter("n > 1 or doc_id is null")
    if again.isEmpty():
        return sure
    # rows that share a doc_id, or lack one, are told apart by their sets
    unsure = _hashed(whole.join(again.filter("kept").select("doc_id"), "doc_id", "left_semi").unionByName(whole.filter("doc_id is null")), k)
    places = rows.filter(kept).select("doc_id", "hi", "lo", "component").distinct().select(F.col("doc_id").alias("of"), F.col("hi").alias("of_hi"), F.col("lo").alias("of_lo"), "component")
    unsure = unsure.join(places, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("hi") == F.col("of_hi")) & (F.col("lo") == F.col("of_lo")))
    chosen = unsure.filter("component is not null").groupBy("component").agg(F.min_by("doc", F.struct("text", F.to_json("doc"))).alias("doc"))
    return sure.unionByName(chosen.select("doc.*")).unionByName(unsure.filter("component is null").select("doc.*"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 85)


OP2_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                                 ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.x, p.y FROM p JOIN n nx ON nx.doc_id = p.x JOIN n ny ON ny.doc_id = p.y WHERE 100 * p.k >= 85 * (nx.c + ny.c - p.k)),
r(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
g AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.c, 0)::BIGINT AS n_shingles, g.component_id, w.doc_id = g.component_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN g ON g.x = w.doc_id
"""
