"""Mixing sources to target weights over time (operator 8).

Each source gets a target, a share of 150 % of all words by its weight and at
most twice what it has. Its weight schedule is a ramp over the run, whose
integral is its cumulative token demand. A document takes its place in its
source's stream of words; inverting the demand at that place gives its
training position, and documents are range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Weights of sources in the order of their names, repeating, and the rate at which
#: each begins and ends (1 on average): the first fade out, the last come late.
WEIGHTS = (3, 1, 2)
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
SHARE, MOST = 1.5, 2
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """sizes (source, source_size) -> with target and ramp. One row for each source, ranked in one window.

    A source is full if its even share by weight of what fuller sources leave
    reaches MOST times its size; fullest first, that settles all reshares.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (place % len(values) + 1).cast("int"))
    weighed = sizes.select("source", "source_size", pick(WEIGHTS).alias("weight"), pick([r[0] for r in RAMPS]).alias("begin"), pick([r[1] for r in RAMPS]).alias("end"))
    fullest = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    past, every = fullest.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    limit = F.col("source_size") * MOST
    filled = weighed.withColumn("limit", limit).withColumn(
        "level",
        (F.sum("source_size").over(every) * SHARE - F.coalesce(F.sum("limit").over(past), F.lit(0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(past), F.lit(0))),
    )
    settled = F.max(F.when(F.col("limit") >= F.col("level") * F.col("weight"), F.col("level"))).over(every)
    target = F.least(F.col("limit").cast("double"), F.coalesce(settled, F.lit(0.0)) * F.col("weight"))
    return filled.select("source", "source_size", target.alias("target"), "begin", "end")


def _inverse(begin: Column, end: Column, demand: Column) -> Column:
    """The time by which a ramp from begin to end (1 on average) has asked for that share of its whole."""
    bend = (end - begin) / 2
    root = F.sqrt(F.greatest(begin * begin + bend * demand * 4, F.lit(0.0)))
    return F.when(bend == 0, demand / begin).otherwise((root - begin) / (bend * 2))


def mix_sources(docs: DataFrame, bucket_rows: int = 50_000) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, before, position for each row of documents.

    size is the text's words; taken is how many words the mix takes, the
    source's stream being repeated until its target is met, so that a source's
    taken words come within one word of its target and no document exceeds
    MOST times its size. before is the number of its source's words ahead of
    the document, position (0 to 1, null if nothing is taken) the time of its
    first use. Streams are ordered by the MD5 of doc_id, so reruns agree.

    Null texts have no words; a null source is a source, the last one. Rows
    that share or lack a doc_id are ordered by their texts' hashes. An empty
    table, or one without words, takes nothing.

    Sums ahead are made in two levels, over buckets of a source and within
    them, so that a source of any size is split.
    """
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        words(F.col("text")).alias("size"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
    )
    sized = materialize(sized.withColumn("turn", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows, digits = sized.count(), 1
    while 16**digits * bucket_rows < rows * 8 and digits < 8 or digits < 2:
        digits += 1
    sized = sized.withColumn("bucket", F.substring("turn", 1, digits))
    buckets = materialize(sized.groupBy("source", "bucket").agg(F.sum("size").alias("size")))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("size").alias("source_size")))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("start", F.coalesce(F.sum("size").over(ahead), F.lit(0))).drop("size")
    starts = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    within = Window.partitionBy("source", "bucket").orderBy("turn", "doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("near", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(starts, placed["source"].eqNullSafe(starts["source"]) & (placed["bucket"] == starts["bucket"])).drop(starts["source"]).drop(starts["bucket"])
    placed = placed.withColumn("before", F.col("start") + F.col("near"))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target") - F.col("rounds") * F.col("source_size"))
    placed = placed.withColumn("rounds", rounds.cast("long")).withColumn("rest", rest.cast("long"))
    taken = F.col("rounds") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    placed = placed.withColumn("taken", taken.cast("long"))
    position = F.when(F.col("taken") > 0, _inverse(F.col("begin"), F.col("end"), F.col("before") / F.col("target")))
    return placed.select("doc_id", "size", "source", "source_size", "target", "taken", "before", position.alias("position"), "text_hash", "rounds", "begin", "end")


def training_order(docs: DataFrame) -> DataFrame:
    """The mixed corpus: rows of docs, repeated and cut as the mix takes them, range-sorted by position.

    Each pass over a source takes its documents again, at the position where
    the demand reaches them; the one document of a source in which its target
    ends keeps its first words only. A column n_chars follows the text.
    Documents of which nothing is taken are left out. Rows that repeat a
    doc_id with its source and text are told apart by number. Null texts and
    those without words are never taken, nulls of other columns come back as
    they are; an empty table gives an empty result.
    """

    def key(doc_id: Column, source: Column, text_hash: Column) -> Column:
        return F.struct(F.coalesce(doc_id, F.lit(0)), doc_id.isNull(), F.coalesce(source, F.lit("")), source.isNull(), text_hash).alias("__key")

    plan = mix_sources(docs).withColumn("__key", key(F.col("doc_id"), F.col("source"), F.col("text_hash")))
    plan = plan.withColumn("__copy", F.row_number().over(Window.partitionBy("__key").orderBy("before"))).where("taken > 0")
    uses = plan.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)).alias("round"))
    demand = (F.col("round") * F.col("source_size") + F.col("before")) / F.col("target")
    uses = uses.select(
        F.col("__key").alias("__of"),
        F.col("__copy").alias("__number"),
        F.col("size").alias("__size"),
        F.least("size", F.col("taken") - F.col("round") * F.col("size")).alias("__words"),
        _inverse(F.col("begin"), F.col("end"), demand).alias("__position"),
    )
    keyed = docs.withColumn("__key", key(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64(F.col("text").cast("string"))))
    keyed = keyed.withColumn("__copy", F.row_number().over(Window.partitionBy("__key").orderBy("__key")))
    # Written as a difference, the number is no join key, and the window's partitioning serves the join.
    used = keyed.join(uses, (F.col("__key") == F.col("__of")) & (F.col("__copy") - F.col("__number") == 0))
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[\\x20\\x09-\\x0D]*" + WORD), 0), F.lit(1), F.col("__words").cast("int")), "")
    text = F.when(F.col("__words") < F.col("__size"), head).otherwise(F.col("text"))
    columns = {"text": text} | ({"n_chars": F.char_length(text).cast("long")} if "n_chars" in docs.columns else {})
    ordered = used.select(*(columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns), "__position")
    return ordered.repartitionByRange("__position", "doc_id").sortWithinPartitions("__position", "doc_id").drop("__position")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, text,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(doc_id::VARCHAR) AS turn
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, list_extract([3, 1, 2], 1 + ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)::INT) AS weight,
         list_extract([1.5::DOUBLE, 1.0, 0.5], 1 + ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)::INT) AS b
  FROM sources
), leveled AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(source_size * 2) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER ()
             - coalesce(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lvl
  FROM weighed
), targets AS (
  SELECT source, source_size, b,
         least((source_size * 2)::DOUBLE, coalesce(max(lvl) FILTER (WHERE source_size * 2 >= lvl * weight) OVER (), 0) * weight) AS target
  FROM leveled
), placed AS (
  SELECT z.doc_id, z.size, t.source_size, t.target, t.b,
         coalesce(sum(z.size) OVER (PARTITION BY z.source ORDER BY z.turn, z.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS rounds
  FROM sized z JOIN targets t ON z.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, (rounds * size + greatest(0, least(size, floor(target - rounds * source_size)::BIGINT - ahead)))::BIGINT AS taken FROM placed
)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN
         CASE WHEN b = 1 THEN (ahead / target) / b
         ELSE (sqrt(greatest(b * b + (2 - b - b) / 2 * (ahead / target) * 4, 0.0)) - b) / ((2 - b - b) / 2 * 2) END
       END AS position
FROM taken
"""
