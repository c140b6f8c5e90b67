"""Mixing sources to target weights, as a curriculum whose weights vary over training.

Targets: the sources, in order of code points with null last, weigh 5, 2, 1 and so on, and share the words of
all documents; a source stops at REPEATS times its own words and what it can't use is shared among the others by
weight, until none is above (water filling, in closed form over the sources sorted by the level at which they fill).

Which documents: a source's stream is its documents in order of md5(doc_id), then of doc_id, size and md5 of the text (a caller's `tie`),
repeated as often as needed. The mix
takes the stream's first `target` words; the document at the end of it is cut there, so every source's taken words
are its target, rounded down.

When: over training time t in [0, 1] a source's weight runs linearly from (1 - slope) to (1 + slope) times its mean;
its integral is the source's demand by t, target * (t + slope * (t * t - t)). A document's position is the t at which
that demand reaches the document's place in the stream, which is the root of a quadratic. `schedule` is sorted by
range on the position.

Running sums are taken in two steps, over BUCKETS buckets of a source's stream and inside a bucket, so no task holds
a source. Sources are numbered by range partitions and a count of each, and the level of the water is found by rounds of
sums over all of them, so many sources (hosts, say) fill no task either.

DataFrame functions only. Defined results: null texts have size 0 and are taken 0 words of; a null source is a source,
ordered last; documents without doc_id come last in their source, in order of md5 of the text; an empty table gives an empty result; equal rows
are told apart by nothing and each take a place, so reruns agree on the rows of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.shared import WORD, cut, table, words

WEIGHTS = (5, 2, 1)
#: A document, and so a source, is used so many times at most.
REPEATS = 3
#: How much a source's weight rises over training, in the order of WEIGHTS: heavy sources early, light ones late.
SLOPES = (-0.5, 0.0, 0.5)
#: Hex digits of md5 that name a bucket of a source's stream.
DIGITS = 3


def _nth(values: tuple, n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values)).cast("int") + 1)


def targets(sizes: DataFrame, repeats: int = REPEATS, weights: tuple = WEIGHTS, slopes: tuple = SLOPES) -> DataFrame:
    """(source, source_size) to the same with weight, slope and target."""
    ranged = cut(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    # a row for each partition: how many sources the ones before hold
    parts = cut(ranged.groupBy("part").agg(F.count("*").alias("held")))
    before = parts.alias("a").join(F.broadcast(parts.alias("b")), F.expr("b.part < a.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.held"), F.lit(0)).alias("before"))
    own = W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    ranked = ranged.withColumn("own", F.row_number().over(own) - 1).join(F.broadcast(before), "part").withColumn("nth", F.col("before") + F.col("own"))
    ranked = ranked.withColumn("weight", _nth(weights, F.col("nth"))).withColumn("slope", _nth(slopes, F.col("nth")))
    ranked = cut(ranked.withColumn("cap", repeats * F.col("source_size")).withColumn("fills", F.col("cap") / F.col("weight")).drop("part", "own", "before", "nth"))
    level = None
    while True:
        # who is full at a level stays full as it rises
        full = F.lit(False) if level is None else F.col("fills") <= level
        total, caps, weight = ranked.agg(F.sum("source_size"), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)), F.sum(F.when(~full, F.col("weight")))).first()
        if weight is None or (now := (total - caps) / weight) == level:
            break
        level = now
    target = F.col("cap").cast("double")
    if weight is not None:
        target = F.when(F.col("fills") <= level, target).otherwise(F.col("weight") * F.lit(level))
    return ranked.select("source", "source_size", "weight", "slope", target.alias("target"))


def _key() -> Column:
    """A key without null, so that windows and joins need the same partitioning and the rows move once."""
    return F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))


def placed(docs: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, source, size, tie) to the same with source_size, target, slope and `begins`, the words before it in its source's stream."""
    if "tie" not in docs.columns:
        docs = docs.withColumn("tie", F.lit(""))
    keyed = docs.withColumn("key", _key()).withColumn("digest", F.coalesce(F.md5(F.col("doc_id").cast("string")), "tie"))
    # "g" comes after all hex digits
    keyed = keyed.withColumn("bucket", F.concat(F.when(F.col("doc_id").isNull(), "g").otherwise(""), F.substring("digest", 1, DIGITS)))
    buckets = cut(keyed.groupBy("key", "source", "bucket").agg(F.sum("size").alias("words")))
    sources = targets(buckets.groupBy("key", "source").agg(F.sum("words").alias("source_size")).drop("key"), repeats).withColumn("key", _key())
    earlier = F.coalesce(F.sum("words").over(W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = buckets.withColumn("start", earlier).drop("words", "source").join(sources.drop("source"), "key")
    inside = W.partitionBy("key", "bucket").orderBy("digest", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    keyed = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    both = keyed.join(starts, ["key", "bucket"])
    return both.withColumn("begins", F.col("start") + F.col("inside")).drop("digest", "bucket", "key", "start", "inside")


def _taken(epoch: int) -> Column:
    """Words the mix takes of a document in a repetition of its source's stream."""
    left = F.floor("target") - (F.lit(epoch) * F.col("source_size") + F.col("begins"))
    return F.greatest(F.lit(0), F.least(left, F.col("size"))).cast("long")


def _position(place: Column) -> Column:
    """The time at which a source's demand reaches a place in its stream."""
    share, a = place / F.col("target"), F.col("slope")
    root = ((a - 1) + F.sqrt((1 - a) * (1 - a) + 4 * a * share)) / (2 * a)
    return F.when(F.col("target") <= 0, F.lit(None)).when(a == 0, share).otherwise(root)


def mixed(docs: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, source, size, tie) to size, source_size, target, taken and first_position, a row for each row, range-sorted by that position."""
    found = placed(docs, repeats)
    taken = sum((_taken(e) for e in range(repeats)), F.lit(0)).cast("long")
    first = F.when(F.col("begins") < F.floor("target"), _position(F.col("begins")))
    found = found.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), first.alias("first_position"))
    return found.repartitionByRange(F.col("first_position").asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(F.col("first_position").asc_nulls_last(), "doc_id", "size")


def uses(docs: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, source, size, and what else it has) to a row for each use of a document: epoch, taken words and position."""
    found = placed(docs, repeats)
    each = found.withColumn("use", F.explode(F.array(*(F.struct(F.lit(e).alias("epoch"), _taken(e).alias("taken"), _position(F.lit(e) * F.col("source_size") + F.col("begins")).alias("position")) for e in range(repeats)))))
    return each.where("use.taken > 0").select(*docs.columns, "use.*")


def schedule(docs: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """The uses of all documents, range-sorted by position."""
    return uses(docs, repeats).repartitionByRange(F.col("position"), F.col("doc_id")).sortWithinPartitions("position", "doc_id", "epoch")


def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's size and target, and the words the mix takes of it, in order of first use."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("tie"))
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken", "first_position")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: a row for each use of a document that the mix makes, in order of training.

    The last use of a source may be cut: its text then ends after the words that were taken. Documents
    without words weigh nothing, so no target holds for them; they stay, once.
    """
    tie = F.md5(F.coalesce("text", F.lit("")))
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"), tie.alias("tie"), F.struct(*docs.columns).alias("row"))
    taken = uses(sized.where("size > 0")).select("doc_id", "position", "epoch", "taken", "size", "row")
    still = sized.where("size = 0").select("doc_id", F.lit(None).cast("double").alias("position"), F.lit(0).alias("epoch"), F.lit(0).cast("long").alias("taken"), "size", "row")
    # cut between a word and white space; a repeated group in one pattern would overflow the stack on long texts
    pieces = F.split("row.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    head = F.array_join(F.slice(pieces, F.lit(1), F.col("taken").cast("int")), "")
    text = F.when(F.col("taken") < F.col("size"), head).otherwise(F.col("row.text"))
    rows = taken.unionByName(still).select("position", "epoch", "doc_id", F.col("row").withField("text", text).alias("row"))
    ordered = rows.repartitionByRange(F.col("position").asc_nulls_last(), F.col("doc_id")).sortWithinPartitions("position", "doc_id", "epoch")
    return ordered.select(*(F.col("row")[c].alias(c) for c in docs.columns))


#: DuckDB; {docs} is a relation with doc_id, source and size.
_SQL = f"""
WITH keyed AS (SELECT doc_id, source, size, coalesce(md5(CAST(doc_id AS VARCHAR)), tie) AS digest, tie, doc_id IS NULL AS last FROM {{docs}}),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source),
nth AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM sizes),
weighed AS (SELECT *, [5, 2, 1][CAST(nth % 3 + 1 AS INTEGER)] AS weight, [-0.5::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE][CAST(nth % 3 + 1 AS INTEGER)] AS slope, {REPEATS} * source_size AS cap FROM nth),
ordered AS (SELECT *, CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE) AS fills, sum(cap) OVER o AS caps, sum(weight) OVER o AS used, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
  FROM weighed WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), nth ROWS UNBOUNDED PRECEDING)),
leveled AS (SELECT *, CAST(total - (caps - cap) AS DOUBLE) / CAST(weights - (used - weight) AS DOUBLE) AS before FROM ordered),
level AS (SELECT arg_min(before, (fills, nth)) AS level FROM leveled WHERE fills > before),
targets AS (SELECT source, source_size, slope, CASE WHEN fills <= before OR level IS NULL THEN CAST(cap AS DOUBLE) ELSE CAST(weight AS DOUBLE) * level END AS target FROM leveled, level),
placed AS (SELECT k.doc_id, k.size, k.source, t.source_size, t.target, t.slope,
  CAST(coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.last, k.digest, k.doc_id, k.size, k.tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)"""


def _taken_sql(e: int) -> str:
    return f"greatest(0, least(CAST(floor(target) AS BIGINT) - ({e} * source_size + begins), size))"


def _position_sql(place: str) -> str:
    share = f"(CAST({place} AS DOUBLE) / target)"
    return f"CASE WHEN target <= 0 THEN NULL WHEN slope = 0 THEN {share} ELSE ((slope - 1) + sqrt((1 - slope) * (1 - slope) + 4 * slope * {share})) / (2 * slope) END"


def sized_sql(relation: str, more: str = "") -> str:
    return f"(SELECT doc_id, source{more}, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, md5(coalesce(text, '')) AS tie FROM {relation})"


ORACLE_SQL = _SQL.format(docs=sized_sql("documents")) + f"""
SELECT doc_id, size, source_size, target, CAST({' + '.join(_taken_sql(e) for e in range(REPEATS))} AS BIGINT) AS taken,
  CASE WHEN begins < floor(target) THEN {_position_sql('begins')} END AS first_position FROM placed"""
