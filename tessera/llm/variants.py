"""Spelling variants of words, by merging light subtrees of their trie (operator 12).

The words' trie is split into heavy paths: at each node the child with most
words below it is heavy, the others, and a word that ends there, are light.
Two words that are one edit apart part at one node, and one of them leaves it
by a light way. So at each node only light subtrees are merged into the rest,
with the character where they leave replaced, skipped or preceded by the heavy
one: small into large, and a word has at most as many light ways as the
logarithm of the number of words. Where a merged word ends where another one
ends, the two are one edit apart; each such pair meets just once.

A trie isn't kept anywhere: a node is the hash of its prefix, the words below
it are a count, and merging is a join on the ends.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_bytes, column_buffer, materialize, release
from .shingles import mix

#: A maximal run of [A-Za-zÀ-ÿ] once A-Z are lower-cased: all of À to ÿ are C3 80 to C3 BF in UTF-8.
RUN = re.compile(rb"[a-z]+(?:\xc3[\x80-\xbf][a-z]*)*|(?:\xc3[\x80-\xbf][a-z]*)+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Every run whose hash this divides loses a character.
SPOILT = 97
#: Shortest words in code points, least number of occurrences, how many times as frequent a form must be.
LEAST_CHARS, LEAST_COUNT, TIMES = 5, 3, 2
#: Words that a task counts before it passes them on; nodes with most words below them that are found by broadcast
#: (24 bytes each), so that no other has more than this share of all prefixes; roots of most words, likewise.
HELD, HOTTEST, HOT_ROOTS = 200_000, 10_000, 1000


def _spoilt(run: bytes, h: int) -> bytes:
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def counted(docs: DataFrame, spoil: int | None = None) -> DataFrame:
    """word, n: the runs of letters of whole texts, A-Z lower-cased, and how often they occur. spoil: runs of a document
    whose crc32 of <doc_id>:<run> it divides lose a character; a null doc_id is written as nothing."""

    def table(words: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()).cast(pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in by_bytes(batches, 1):
            data, offsets = column_buffer(batch.column(1))
            low = data.tobytes().translate(LOWER)
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                own = Counter(RUN.findall(low, int(offsets[k]), int(offsets[k + 1])))
                if spoil:
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    hit = [(w, h) for w in own if not (h := zlib.crc32(w, start)) % spoil]
                    for w, n, h in [(w, own.pop(w), h) for w, h in hit]:
                        own[_spoilt(w, h)] += n
                for w, n in own.items():
                    total[w] += n
                if len(total) >= HELD:
                    yield table(total)
                    total = Counter()
        yield table(total)

    parts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, id) to (id, place, node, step): for each prefix its hash and the character that follows, none at the end."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    for batch in by_bytes(batches, 0, 1 << 17):
        texts = batch.column(0).to_pylist()
        lengths = np.array([len(t) + 1 for t in texts])
        codes = np.frombuffer("".join(t + "\0" for t in texts).encode("utf-32-le"), np.uint32)
        first = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        place = np.arange(len(codes)) - np.repeat(first, lengths)
        # A prefix's hash is the sum of its characters' at their places; equal hashes of unlike prefixes only share a heavy way.
        each = mix(((codes.astype(np.uint64) + np.uint64(1)) * odd) ^ mix((place.astype(np.uint64) + np.uint64(3)) * odd))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)))
        node = total[:-1] - np.repeat(total[first], lengths)
        step = [c for t in texts for c in (*t, "")]
        ids = np.repeat(batch.column(1).to_numpy(), lengths)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(place.astype(np.int32)), pa.array(node.view(np.int64)), pa.array(step)], names=["id", "place", "node", "step"])


def light_ways(words: DataFrame) -> DataFrame:
    """id, place, step, heavy: where words (word, id) leave a node (their first place characters) otherwise than most; step
    is the character by which they do, heavy the other one, both empty for the end of a word."""
    steps = words.select("word", "id").mapInArrow(_steps, "id long, place int, node long, step string")
    ways = steps.groupBy("node", "step").agg(F.count("*").alias("below"))
    nodes = ways.groupBy("node").agg(F.max_by("step", F.struct("below", "step")).alias("heavy"), F.sum("below").alias("below"), F.count("*").alias("ways"))
    nodes = materialize(nodes.where("ways > 1").drop("ways"))
    hot = materialize(nodes.orderBy(F.desc("below"), "node").limit(HOTTEST).select("node", F.col("heavy").alias("hot")))
    cool = nodes.select("node", "heavy").join(F.broadcast(hot.select("node")), "node", "left_anti")
    dealt = steps.join(F.broadcast(hot), "node", "left")
    light = dealt.where("hot is not null and step <> hot").select("id", "place", "step", F.col("hot").alias("heavy"))
    rest = dealt.where("hot is null").join(cool, "node").where("step <> heavy").select("id", "place", "step", "heavy")
    return light.unionByName(rest)


def merged(light: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Light words (word, n, place, step, heavy) merged into their nodes: (word, n, other), with the character where they
    leave it skipped, replaced by the heavy one, or after the heavy one; and (word, n, place, rest), equal in place and
    rest for words of one node whose light characters alone differ.

    A skipped character is the last of a row of equal ones, so that two words whose rows differ in length meet once.
    """
    before, own, after = F.left("word", F.col("place")), F.substr("word", F.col("place") + 1), F.substr("word", F.col("place") + 2)
    inside = F.col("step") != ""
    skipped = F.when(inside & (F.col("step") != F.left(after, F.lit(1))), F.concat(before, after))
    replaced = F.when(inside & (F.col("heavy") != ""), F.concat(before, "heavy", after))
    preceded = F.when(F.col("heavy") != "", F.concat(before, "heavy", own))
    made = light.select("word", "n", F.explode(F.array_compact(F.array(skipped, replaced, preceded))).alias("other"))
    return made, light.where(inside).select("word", "n", "place", F.concat(before, after).alias("rest"))


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best (minus_n, word): how many of words (word, n, id; each word once) are one edit away, and of those
    that are more frequent the most frequent one (ties: the least). Words without any near one are left out."""
    light = materialize(light_ways(words).join(words, "id"))
    made, alike = merged(light)
    met = made.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = lambda n, word: F.struct((-F.col(n)).alias("minus_n"), F.col(word).alias("word"))
    met = met.select(F.explode(F.array(F.struct("word", "n", best("other_n", "other").alias("best")), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), best("n", "word").alias("best")))).alias("m"))
    met = met.select("m.*", F.lit(1).cast("long").alias("near"))
    # Of the words that only a light character tells apart (as many as there are characters) the most frequent one is the best
    # for all others, and none of these is more frequent than itself.
    group = Window.partitionBy("place", "rest")
    alike = alike.select("word", "n", F.min(best("n", "word")).over(group).alias("best"), (F.count("*").over(group) - 1).alias("near")).where("near > 0")
    more = F.when(-F.col("best.minus_n") > F.col("n"), F.col("best"))
    return met.select("word", "n", "best", "near").unionByName(alike).groupBy("word").agg(F.sum("near").alias("n_near"), F.min(more).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following forms (word, form) from a word ends; there must be no cycle.

    Each round a word jumps to where its goal had got to, so rounds grow
    with the logarithm of the longest way. The HOT_ROOTS goals that most
    words have are broadcast, so that their words don't meet.
    """
    now = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        goals = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        hot = now.groupBy("root").agg(F.count("*").alias("words")).orderBy(F.desc("words"), "root").limit(HOT_ROOTS).select("root")
        hot = materialize(hot.join(goals, "root", "left").withColumn("hot", F.lit(True)))
        dealt = now.join(F.broadcast(hot.withColumnRenamed("far", "hot_far")), "root", "left")
        moved = dealt.where("hot").select("word", "root", F.col("hot_far").alias("far"))
        rest = dealt.where("hot is null").select("word", "root").join(goals, "root", "left").select("word", "root", "far")
        moved = materialize(moved.unionByName(rest))
        release(now, hot)
        if moved.where("far is not null").isEmpty():
            return moved.select("word", "root")
        nxt = materialize(moved.select("word", F.coalesce("far", "root").alias("root")))
        release(moved)
        now = nxt


def variants(docs: DataFrame, spoil: int | None = None, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of docs (doc_id, text) of enough characters and occurrences.

    Two words are near if one inserted, deleted or replaced code point tells
    them apart; n_near counts these. A word's form is its most frequent near
    word (ties: the least) if that is at least times as frequent, and root is
    where forms lead. Null texts have no words; repeated rows count each;
    texts without words, and empty tables, give no rows. Only doc_id and text
    of docs matter. times must be more than 1.
    """
    long = counted(docs, spoil).where((F.col("n") >= least_count) & (F.char_length("word") >= least_chars))
    words = materialize(long.select("word", "n", F.monotonically_increasing_id().alias("id")))
    rows = words.join(near_words(words), "word", "left")
    form_n = F.when(-F.col("best.minus_n") >= times * F.col("n"), -F.col("best.minus_n"))
    rows = materialize(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form_n.alias("form_n"), F.when(form_n.isNotNull(), F.col("best.word")).alias("form")))
    found = rows.join(roots(rows.where("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), SPOILT)


ORACLE = """
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
), grouped AS (
  SELECT doc, run, count(*) AS n, hex(encode(doc || ':' || run)) AS bytes FROM runs GROUP BY doc, run
), hashed AS (
  SELECT run, n, 4294967295 - list_reduce(
           list_transform(range(length(bytes) // 2), lambda i: ('0x' || substr(bytes, (2 * i + 1)::INT, 2))::BIGINT),
           lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::BIGINT) AS h
  FROM grouped
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), holes AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON h.rest = w.word
  UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON h.rest = w.word
), near AS (
  SELECT word, count(*) AS n_near, arg_min({'w': other, 'n': other_n}, {'m': -other_n, 'w': other}) AS best FROM pairs GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 2 * w.n THEN best.w END AS form, CASE WHEN best.n >= 2 * w.n THEN best.n END AS form_n
  FROM words w LEFT JOIN near USING (word)
), ways AS (
  SELECT word, form AS goal FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT ways.word, f.form FROM ways JOIN formed f ON ways.goal = f.word WHERE f.form IS NOT NULL
), ends AS (
  SELECT ways.word, goal FROM ways JOIN formed f ON goal = f.word WHERE f.form IS NULL
)
SELECT word, form, coalesce(goal, word) AS root, n, n_near, form_n FROM formed LEFT JOIN ends USING (word)
"""
