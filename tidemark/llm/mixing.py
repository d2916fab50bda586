"""Mixing sources to target weights by capped water-filling.

Targets: the wanted total is shared out by weight; a source whose share exceeds its maximum number of epochs is clamped
there, and the excess goes to the others by weight until none is above. With sources sorted by cap over weight the
clamped ones come first, so one running sum over the table of sources finds the level.

Sampling: every document is taken as often as its source's target has whole epochs. What is left of the target is taken
in the order of a seeded hash of doc_id: documents before a source's cut once more, the one at the cut in part. The cut is
found in two steps, over the sums of 4,096 hash ranges and then over the documents of one range, so that no source, however
large, is sorted as a whole. The last pass joins documents with one row for each source and moves no text.

Sizes are counts of words, runs of characters other than space and U+0009 to U+000D. Null texts have size 0 and are taken 0
times; null sources form one source that sorts last. Rows that repeat a doc_id stand at the same place of the order; at a cut
they share what is left by size. Rows with a null doc_id are taken like others. Other columns don't matter, whatever their names; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, checkpointed, table

WEIGHTS, SHARE, EPOCHS, SEED = (5, 2, 1), 1.5, 2, "mix-1"
#: Parts of a source where goals are too many to be sent to every task.
SALTS = 32


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _order(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].isNull().alias("no_source"), F.coalesce(docs[source_col], F.lit("")).alias("source"), words(docs[text_col]).alias("size")).withColumns({"place": _order(F.col("doc_id"), seed)})


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """no_source, source, source_size -> target and whole (epochs taken in full), rest (words beyond them). One row for each source throughout."""
    by_name, every = Window.orderBy("no_source", "source"), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * F.lit(epochs))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "no_source", "source").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", F.sum("source_size").over(every).alias("all_size"), F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"), (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"))
    rows = rows.withColumn("level", (F.col("all_size") * F.lit(share) - F.col("cap_before")) / F.col("weight_left"))
    rows = rows.withColumn("free", F.col("level") * F.col("weight") < F.col("cap"))
    first = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("weight")).alias("ratio"), "no_source", "source", "level"))).over(every)
    rows = rows.withColumn("target", F.when(F.col("free"), first["level"] * F.col("weight")).otherwise(F.col("cap").cast("double")))
    whole = F.when(F.col("source_size") == 0, 0).when(~F.col("free"), epochs).otherwise(F.floor(F.try_divide(F.col("target"), F.col("source_size"))))
    rows = rows.withColumn("whole", whole.cast("long"))
    return rows.select("no_source", "source", "source_size", "target", "whole", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long").alias("rest"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **how) -> tuple[DataFrame, DataFrame]:
    """The sizes of all documents, and one row for each source: its target, whole epochs and cut (place, doc_id, words before it, words at it)."""
    sized = checkpointed(_sized(docs, id_col, text_col, source_col, seed))
    key = ["no_source", "source"]
    sums = sized.groupBy(*key, F.substring("place", 1, 3).alias("range")).agg(F.sum("size").alias("size"))
    sums = checkpointed(sums)
    goals = targets(sums.groupBy(*key).agg(F.sum("size").alias("source_size")), **how)
    upto = Window.partitionBy(*key).orderBy("range")
    ranges = sums.join(goals, key).withColumn("upto", F.sum("size").over(upto)).filter((F.col("rest") > 0) & (F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("size") < F.col("rest")))
    cut_range = ranges.select(*key, "range", (F.col("rest") - F.col("upto") + F.col("size")).alias("range_rest"))
    near = sized.withColumn("range", F.substring("place", 1, 3)).join(cut_range, [*key, "range"]).groupBy(*key, "place", "range_rest").agg(F.sum("size").alias("at_cut"))
    near = near.withColumn("upto", F.sum("at_cut").over(Window.partitionBy(*key).orderBy("place")))
    cut = near.filter((F.col("upto") >= F.col("range_rest")) & (F.col("upto") - F.col("at_cut") < F.col("range_rest"))).select(*key, F.col("place").alias("cut"), "at_cut", (F.col("range_rest") - F.col("upto") + F.col("at_cut")).alias("cut_rest"))
    return sized, checkpointed(goals.join(cut, key, "left"))


def _part(place: Column, size: Column) -> Column:
    """Words that a document gives beyond its whole epochs."""
    return F.when(place < F.col("_mix_cut"), size).when(place == F.col("_mix_cut"), F.floor(size * F.col("_mix_cut_rest") / F.col("_mix_at_cut")).cast("long")).otherwise(F.lit(0)).cast("long")


def _with_goals(rows: DataFrame, goals: DataFrame, no_source: Column, source: Column, doc_id: Column) -> DataFrame:
    """rows with their source's goal. Goals are one row for each source: few are sent to every task; many are joined, each source cut into SALTS parts."""
    goals = goals.select(*(F.col(c).alias(f"_mix_{c}") for c in goals.columns))
    same = (no_source == F.col("_mix_no_source")) & (source == F.col("_mix_source"))
    if (few := bounded(goals)) is not None:
        return rows.join(few, same)
    salt = F.coalesce(F.pmod(F.xxhash64(doc_id), F.lit(SALTS)), F.lit(0))
    goals = goals.withColumn("_mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(goals, same & (salt == F.col("_mix_salt"))).drop("_mix_salt")


def mixture(docs: DataFrame, **how) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken (its words in the mix, repeats counted)."""
    sized, goals = plan(docs, **how)
    rows = _with_goals(sized, goals, sized["no_source"], sized["source"], sized["doc_id"])
    return rows.select("doc_id", "size", F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("_mix_whole") * F.col("size") + _part(F.col("place"), F.col("size"))).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **how) -> DataFrame:
    """The rows of docs as the mix has them: each as often as it is taken, the one at a cut rounded to a whole time; a document without words as often as the whole epochs."""
    _, goals = plan(docs, id_col, text_col, source_col, seed, **how)
    # the row is held in one column, so that its names meet no others
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), docs[id_col].cast("long").alias("doc_id"), docs[source_col].isNull().alias("no_source"), F.coalesce(docs[source_col], F.lit("")).alias("source"))
    rows = _with_goals(rows, goals, rows["no_source"], rows["source"], rows["doc_id"])
    place = _order(F.col("doc_id"), seed)
    half = F.col("_mix_cut_rest") * 2 >= F.col("_mix_at_cut")
    times = F.col("_mix_whole") + F.when((place < F.col("_mix_cut")) | ((place == F.col("_mix_cut")) & half), 1).otherwise(0)
    return rows.select("doc", F.explode(F.when(times > 0, F.sequence(F.lit(1).cast("long"), times)).otherwise(F.array().cast("array<bigint>")))).select("doc.*")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH d AS (
  SELECT doc_id, source, source IS NULL AS no_source, coalesce(source, '') AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents),
s AS (
  SELECT no_source, src, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY no_source, src) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight
  FROM d GROUP BY 1, 2),
r AS (
  SELECT *, 2 * source_size AS cap, (2 * source_size)::DOUBLE / weight AS ratio FROM s),
l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY ratio, no_source, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER (ORDER BY ratio, no_source, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM r),
f AS (SELECT *, level * weight < cap AS free FROM l),
t AS (
  SELECT no_source, src, source_size, free,
         CASE WHEN free THEN first_value(level) OVER (ORDER BY CASE WHEN free THEN 0 ELSE 1 END, ratio, no_source, src
                                                      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * weight
              ELSE cap::DOUBLE END AS target
  FROM f),
g AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 WHEN NOT free THEN 2 ELSE floor(target / source_size) END::BIGINT AS whole FROM t),
h AS (SELECT *, round(target - whole * source_size)::BIGINT AS rest FROM g),
c AS (
  SELECT d.doc_id, d.size, h.source_size, h.target, h.whole, h.rest,
         sum(d.size) OVER (PARTITION BY d.no_source, d.src ORDER BY d.place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(d.size) OVER (PARTITION BY d.no_source, d.src, d.place) AS same
  FROM d JOIN h ON d.no_source = h.no_source AND d.src = h.src)
SELECT doc_id, size, source_size, target,
       (whole * size + CASE WHEN rest <= 0 THEN 0 WHEN upto <= rest THEN size WHEN upto - same >= rest THEN 0
                            ELSE floor(size::DOUBLE * (rest - upto + same)::DOUBLE / same::DOUBLE) END)::BIGINT AS taken
FROM c
"""
