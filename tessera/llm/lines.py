"""Line dedup over levelled sorted runs of line hashes (operator 2).

Documents come in batches, in any order. A batch's line keys are counted,
merge-anti-joined with the keys that the runs already know to be frequent and
to have a greater doc_id, and the rest become a sorted run of its own; when a
level has enough runs they are compacted into one of the next level, adding
counts and keeping the greatest doc_id. Keys are 128-bit hashes, and only
DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, materialize, release

KEY = ["a", "b"]
#: Most frequent keys whose lines are found by a broadcast (32 bytes each), so that none of them meets in one task.
HOTTEST = 10_000


class LineRuns:
    """Runs of (a, b, n, keep): a key's two hashes, in how many documents it is, the greatest doc_id."""

    def __init__(self, min_docs: int, fanout: int = 2):
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: list[list[DataFrame]] = []

    def add(self, keys: DataFrame) -> None:
        """keys (doc_id, a, b), once for each document; batches may come in any order."""
        run = keys.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("keep"))
        for known in (r for level in self.levels for r in level):
            # What a run knows to be frequent, with a greater doc_id, needs no more counting.
            frequent = known.where(F.col("n") >= self.min_docs).select(F.col("a").alias("a_"), F.col("b").alias("b_"), F.col("keep").alias("keep_"))
            same = (F.col("a") == F.col("a_")) & (F.col("b") == F.col("b_"))
            run = run.join(frequent.hint("merge"), same & (F.col("keep").isNull() | (F.col("keep") <= F.col("keep_"))), "left_anti")
        self._put(0, materialize(run.sortWithinPartitions(*KEY)))

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, materialize(self._merge(full).sortWithinPartitions(*KEY)))
            release(*full)

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for run in runs[1:]:
            rows = rows.union(run)
        return rows.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("keep").alias("keep"))

    def frequent(self) -> DataFrame:
        """Keys of at least min_docs documents: a, b, n, keep."""
        return self._merge([r for level in self.levels for r in level]).where(F.col("n") >= self.min_docs)


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased (lower does the same on plain ASCII, faster)."""
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(ascii_lower(bare))


def _hashes(text: Column, min_chars: int) -> Column:
    """A text's lines as hashes of their keys, in order; null for short keys."""
    keys = F.transform(F.split(text, "\n"), line_key)
    return F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b"))))


NAMES = ("kept_text", "n_lines", "n_dropped")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 3, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """docs with columns kept_text, n_lines and n_dropped (or as names calls them) besides their own.

    A line's key is the line without ASCII white space at both ends, A-Z
    lower-cased. Keys of at least min_chars code points that at least min_docs
    documents hold lose all their lines but those of the greatest doc_id.
    Other lines stay, joined by \\n.

    A null or empty text is one empty line. Each row is a document, also if
    it repeats a doc_id; a null doc_id counts as less than any other. All
    columns of docs come back; theirs of the same names are replaced. An
    empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = [F.col("doc_id").alias("__doc"), F.xxhash64(text).alias("__text")]
    parts = [i / batches for i in range(1, batches)]
    cuts = sorted(set(docs.approxQuantile("doc_id", parts, 0.01)), reverse=True) if parts else []
    batch = F.lit(0)
    for cut in cuts:
        batch = batch + F.coalesce((F.col("doc_id") < cut).cast("int"), F.lit(1))
    hashed = docs.select(*row, _hashes(text, min_chars).alias("lines"), batch.alias("batch"))
    hashed = materialize(hashed, "batch")

    runs = LineRuns(min_docs)
    for k in range(len(cuts) + 1):
        own = F.array_distinct(F.filter("lines", lambda x: x.isNotNull()))
        runs.add(hashed.where(F.col("batch") == k).select(F.col("__doc").alias("doc_id"), F.explode(own).alias("key")).select("doc_id", "key.*"))

    placed = hashed.select("__doc", "__text", F.posexplode("lines").alias("at", "key")).where("key is not null").select("__doc", "__text", "at", "key.*")
    frequent = materialize(runs.frequent())
    release(*(r for level in runs.levels for r in level))
    hot = materialize(frequent.orderBy(F.desc("n"), *KEY).limit(HOTTEST).select(*KEY, "keep"))
    cool = frequent.select(*KEY, "keep").join(F.broadcast(hot.select(*KEY)), KEY, "left_anti")
    of_hot = placed.join(F.broadcast(hot), KEY)
    of_cool = placed.join(F.broadcast(hot.select(*KEY)), KEY, "left_anti").join(cool.hint("merge"), KEY)
    gone = of_hot.unionByName(of_cool).where("not (__doc <=> keep)")
    gone = gone.groupBy("__doc", "__text").agg(F.collect_set("at").alias("__gone"))

    own = [c for c in docs.columns if c not in names]
    left = docs.select(*own, *row, F.split(text, "\n").alias("__lines"))
    gone = gone.select(F.col("__doc").alias("__doc2"), F.col("__text").alias("__text2"), "__gone")
    joined = left.join(gone, F.col("__doc").eqNullSafe(F.col("__doc2")) & (F.col("__text") == F.col("__text2")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n")
    return joined.select(
        *own,
        F.when(F.col("__gone").isNull(), F.array_join("__lines", "\n")).otherwise(kept).alias(names[0]),
        F.size("__lines").cast("long").alias(names[1]),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias(names[2]),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT y.doc_id, y.pos, y.line, f.k IS NOT NULL AND y.doc_id <> f.keep AS gone
  FROM keyed y LEFT JOIN frequent f ON y.k = f.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
