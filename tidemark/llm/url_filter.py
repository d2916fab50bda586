"""URL rules by a sort-merge range join.

A host's canonical key is its labels in reverse order, each ended by U+0001; U+0002 and the path follow. A rule's key is a prefix of the keys of all URLs on
its host whose path starts with its path, so rules are intervals of the sorted keys, and intervals nest. A URL is probed once for its host and once
for each parent domain, as far as any rule's host reaches, with as much of its path as any rule's path has. Probes and rules are dealt into the same ranges of
keys; a rule goes to all ranges that its interval meets. Each range is sorted and swept once: a stack holds the rules whose interval the sweep is
in, and its top is the longest rule for a probe. Of a URL's probes, the rule with the most characters in host and path wins, and
among equals the longer host.

Ranges are cut by a bounded sample of keys. A key that is many cuts at once, as that of a hot host, is dealt over all of their ranges. Neither URLs
nor rules pass through the driver, and nothing is broadcast but the cuts.

Null URLs and those without "://" have an empty host and path. Null rules are left out; of equal rules with different verdicts,
block wins. A URL that no rule fits has a null rule and the default verdict. Repeated rows each get their own row; other columns are ignored,
whatever their names. An empty table gives an empty result, and without rules every URL has the default verdict.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import sliced, table

#: (host, path, verdict) of the dealt query.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DEFAULT = "allow"
UPPER, LOWER, END, PATH, LAST = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "\x01", "\x02", "\U0010ffff"
#: Sampled keys for each range of keys, and in all at most.
SAMPLED, SAMPLE = 32, 100_000


def host_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path up to ? or #."""
    found = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, found, 1), UPPER, LOWER), F.regexp_extract(url, found, 2)


def key_of(host: Column, path: Column) -> Column:
    """The canonical key; the characters that it uses as marks are written otherwise within a host."""
    for i, c in enumerate(("\x03", END, PATH)):
        host = F.replace(host, F.lit(c), F.lit(f"\x03{i}"))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), END), F.lit(END + PATH), path)


def cuts(keys: list[str], ranges: int) -> list[str]:
    """Keys that cut as many ranges, ascending; a frequent key may cut several times."""
    keys = sorted(keys)
    return [keys[i * len(keys) // ranges] for i in range(1, ranges)] if keys else []


def dealt(rows: DataFrame, at: list[str]) -> DataFrame:
    """rows with the range of keys that a probe is in, or once for each range that a rule's interval meets."""
    held = rows.sparkSession.sparkContext.broadcast(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = held.value
        for batch in sliced(batches, 4096):
            index, ranges = [], []
            for i, (key, url) in enumerate(zip(batch.column("key").to_pylist(), batch.column("url").to_pylist(), strict=True)):
                low, high = bisect_left(at, key), bisect_right(at, key if url is not None else key + LAST)
                for r in range(low, high + 1) if url is None else (low + url % (high - low + 1),):
                    index.append(i)
                    ranges.append(r)
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), *batch.take(pa.array(index, pa.int32())).columns], names=["range", *batch.schema.names])

    return rows.mapInArrow(run, "range int, " + rows._jdf.schema().toDDL())


def swept(rows: DataFrame) -> DataFrame:
    """rows (range, key, url, ..., rule, verdict, size, host_size) -> the probes, each with the longest rule whose key its own starts with."""
    taken = ["rule", "verdict", "size", "host_size"]
    kept = [c for c in rows.columns if c not in ("range", "key", *taken)]
    types = (pa.string(), pa.string(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, last = [], None
        for batch in sliced(batches, 4096):
            index, found = [], []
            ranges, keys, urls = (batch.column(c).to_pylist() for c in ("range", "key", "url"))
            rules = zip(*(batch.column(c).to_pylist() for c in taken), strict=True)
            for i, (r, key, url, rule) in enumerate(zip(ranges, keys, urls, rules, strict=True)):
                if r != last:
                    stack, last = [], r
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if url is None:
                    stack.append((key, rule))
                else:
                    index.append(i)
                    found.append(stack[-1][1] if stack else (None,) * 4)
            held = batch.select(kept).take(pa.array(index, pa.int32()))
            yield pa.RecordBatch.from_arrays([*held.columns, *(pa.array([x[j] for x in found], t) for j, t in enumerate(types))], names=[*kept, *taken])

    schema = rows.select(*kept, *taken)._jdf.schema().toDDL()
    # a rule stands before the probes with the same key
    return rows.repartition("range").sortWithinPartitions(F.col("range"), F.col("key"), F.col("url").asc_nulls_first()).mapInArrow(run, schema)


def verdicts(urls: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT, ranges: int | None = None) -> DataFrame:
    """One row for each row of urls: its id, host, path, rule (host and path of the winning rule, or null) and verdict. ranges: spark.sql.shuffle.partitions, if not given."""
    spark = urls.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    rules = rules.filter("host is not null and path is not null and verdict is not null").select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
    rules = rules.groupBy("host", "path").agg(F.when(F.max(F.col("verdict") == "block"), "block").otherwise(F.max("verdict")).alias("verdict"))
    labels, length = rules.agg(F.max(F.size(F.split("host", r"\."))), F.max(F.length("path"))).first()
    host, path = host_path(urls[url_col])
    rows = urls.select(urls[id_col].alias("page_id"), host.alias("host"), path.alias("path"))
    if labels is None:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    rows = rows.withColumn("url", F.monotonically_increasing_id())
    parents = F.array_distinct(F.array(*(F.substring_index("host", ".", -n) for n in range(labels, 0, -1))))
    start = F.substring("path", 1, length)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = rows.select(parents.alias("parents"), start.alias("start"), F.xxhash64("url").alias("h")).orderBy("h").limit(min(SAMPLE, SAMPLED * ranges))
    at = cuts([r.key for r in sample.select(F.explode("parents").alias("host"), "start").select(key_of(F.col("host"), F.col("start")).alias("key")).collect()], ranges)
    # what is returned of a URL goes with its first probe
    own = [F.when(F.col("n") == 0, F.col(c)).alias(c) for c in ("page_id", "host", "path")]
    probes = rows.select("url", "page_id", "host", "path", F.posexplode(parents).alias("n", "parent"))
    probes = probes.select(key_of(F.col("parent"), start).alias("key"), "url", *own, F.col("n") == 0)
    probes = probes.toDF("key", "url", "page_id", "host", "path", "first")
    for c, kind in (("rule", "string"), ("verdict", "string"), ("size", "int"), ("host_size", "int")):
        probes = probes.withColumn(c, F.lit(None).cast(kind))
    host_size = F.length("host")
    rules = rules.select(key_of(F.col("host"), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), "verdict", (host_size + F.length("path")).alias("size"), host_size.alias("host_size"))
    found = swept(dealt(probes.unionByName(rules, allowMissingColumns=True), at)).filter("first or rule is not null")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct("size", "host_size", "rule", "verdict")))
    found = found.groupBy("url").agg(*(F.max(c).alias(c) for c in ("page_id", "host", "path")), best.alias("best"))
    return found.select("page_id", "host", "path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "pages"), RULES)


OP10_SQL = """
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM h),
r(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                         ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
d AS (SELECT DISTINCT host, path FROM p),
b AS (
  SELECT d.host, d.path, rh || rp AS rule, rv,
         row_number() OVER (PARTITION BY d.host, d.path ORDER BY length(rh) + length(rp) DESC, length(rh) DESC) AS n
  FROM d JOIN r ON (d.host = rh OR ends_with(d.host, '.' || rh)) AND starts_with(d.path, rp))
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.rv, 'allow') AS verdict
FROM p LEFT JOIN b ON b.host = p.host AND b.path = p.path AND b.n = 1
"""
