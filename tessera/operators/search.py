"""Hybrid retrieval: literal search, vector fallback, rerank."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MATCH, WORD, contains, trigram_similarity, trigrams
from ..functions.vectors import cosine_distance
from ..schemas import SEARCH_FIELDS
from ..sources.providers import ProviderError
from ..sources.shared import materialize

#: Results at most, distance up to which a vector counts as related, score under which a reranked result goes.
LIMIT, MAX_DISTANCE, LEAST_RERANK = 8, 0.55, 0.1
#: Grams of a word that are looked for, and records that have them, up to which these are looked up one by one.
PROBED, LOOKED_UP = 3, 200


class SearchError(ValueError):
    """A request that isn't valid."""


@dataclass(frozen=True)
class Search:
    """A query, or terms of which any must and none may be contained, over fields of the index."""

    query: str = ""
    any: tuple[str, ...] = ()
    none: tuple[str, ...] = ()
    all: tuple[str, ...] = ()
    fields: tuple[str, ...] = SEARCH_FIELDS
    limit: int = LIMIT

    @property
    def semantic(self) -> str:
        """What is embedded: the query, or else the wanted terms."""
        return self.query or " ".join([*self.all, *self.any])


def request(given: dict) -> Search:
    """A search from a request: {query} or {terms: {include, exclude}, filters}, and limit."""
    if unknown := set(given) - {"query", "limit", "terms", "filters"}:
        raise SearchError(f"unknown keys: {sorted(unknown)}")
    limit = given.get("limit", LIMIT)
    if not isinstance(limit, int) or limit < 1:
        raise SearchError("limit must be 1 or more")
    limit = min(limit, LIMIT)
    if ("terms" in given) != ("filters" in given):
        raise SearchError("terms and filters go together")
    if "terms" not in given:
        query = (given.get("query") or "").strip()
        if not query:
            raise SearchError("query must not be empty")
        if {"and", "or"} <= set(query.lower().split()):
            raise SearchError("AND and OR can't be mixed")
        return Search(query=query, limit=limit)
    if "query" in given:
        raise SearchError("query and terms exclude each other")
    terms, fields = given["terms"], tuple(given["filters"])
    if set(terms) != {"include", "exclude"}:
        raise SearchError("terms need include and exclude")
    if any(not t.strip() for t in [*terms["include"], *terms["exclude"]]) or not [*terms["include"], *terms["exclude"]]:
        raise SearchError("terms must not be blank, and one is needed")
    if not set(fields) <= set(SEARCH_FIELDS):
        raise SearchError("unknown filter")
    return Search(any=tuple(terms["include"]), none=tuple(terms["exclude"]), fields=fields or SEARCH_FIELDS, limit=limit)


def _text(name: str) -> str:
    return f"{name}_text"


def _holds(search: Search) -> Column:
    """The term predicate on search_text."""
    has = lambda t: contains(F.col("search_text"), F.lit(t))
    found = F.lit(True)
    for term in search.all:
        found = found & has(term)
    for term in search.none:
        found = found & ~has(term)
    if search.any:
        either = F.lit(False)
        for term in search.any:
            either = either | has(term)
        found = found & either
    return found


def _grams(session, *texts: str) -> list[list[str]]:
    """The trigrams of a query or its tokens, as Spark makes them: one row."""
    return list(session.range(1).select(*(trigrams(F.lit(t)).alias(f"g{k}") for k, t in enumerate(texts))).first())


def _scored(rows: DataFrame, search: Search) -> DataFrame:
    """Rows with search_text and a similarity for each field: hits, with score, matched fields and preview."""
    tokens = list(dict.fromkeys(t.lower() for t in search.query.split()))
    hit = {}
    for f in search.fields:
        holds = contains(F.col(_text(f)), F.lit(search.query))
        for token in search.query.split():
            holds = holds | contains(F.col(_text(f)), F.lit(token))
        hit[f] = (F.col(f"{f}_similarity") >= MATCH) | holds
    either = F.lit(False)
    for h in hit.values():
        either = either | h
    held = sum((contains(F.col("search_text"), F.lit(t)).cast("int") for t in tokens), F.lit(0))
    best = F.greatest(F.lit(0.0), *(F.col(f"{f}_similarity") for f in search.fields))
    fields = F.array_compact(F.array(*(F.when(hit[f], F.lit(f)) for f in SEARCH_FIELDS if f in hit)))
    preview = F.when(hit["content"], F.left("content_text", F.lit(120))) if "content" in hit else F.lit(None).cast("string")
    return rows.where(either).select("*", (held + best).alias("score"), fields.alias("matched_fields"), preview.alias("content_preview"))


SHOWN = ("memory_uuid", "title_text", "status", "summary_text", "content_preview", "matched_fields", "score")


def _first(rows: DataFrame, search: Search, limit: bool) -> DataFrame:
    rows = rows.select(*SHOWN)
    return rows.orderBy(F.desc("score"), "title_text", "memory_uuid").limit(search.limit) if limit else rows


def _beginning(text: Column, most: int) -> Column:
    """A text's first whole words."""
    return F.when(F.length(text) <= most, text).otherwise(F.regexp_replace(F.left(text, F.lit(most)), f"{WORD}$", ""))


def literal(index: DataFrame, search: Search, limit: bool = True) -> DataFrame:
    """memory_uuid, title_text, status, summary_text, content_preview, matched_fields, score, best first.

    A field matches a query that it contains or is similar to, or of which it
    contains a token; records score the distinct tokens that they hold plus
    the best similarity of a field. With terms all scores are 0. One pass over
    the index, which uses its trigrams if it has them; see indexed for one
    that reads what may match only.
    """
    rows = index.where("status <> 'trashed'").withColumn("search_text", F.concat_ws(" ", *(_text(f) for f in search.fields)))
    rows = rows.where(_holds(search))
    if not search.query:
        rows = rows.select("*", F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("matched_fields"), F.lit(None).cast("string").alias("content_preview"))
        return _first(rows, search, limit)
    grams = _grams(index.sparkSession, search.query)[0]
    asked = F.array(*map(F.lit, grams)).cast("array<string>")
    own = lambda f: F.col(f"{_text(f)}_trigrams") if f"{_text(f)}_trigrams" in index.columns else trigrams(F.col(_text(f)))
    # A similarity matters where a token is held, or if it reaches MATCH: then a field has so few grams that its first
    # words have too many already in most texts. Left out, it is below the one for which the record is found.
    holds = F.lit(False)
    for t in dict.fromkeys(t.lower() for t in search.query.split()):
        holds = holds | F.contains(F.lower("search_text"), F.lit(t))
    few = lambda f: F.size(trigrams(_beginning(F.col(_text(f)), 2 * most))) <= most
    most = int(len(grams) / MATCH)
    made = {f: F.when((F.length(_text(f)) <= 2 * most) | F.col("holds") | few(f), trigram_similarity(own(f), asked)).otherwise(0.0) for f in search.fields}
    rows = rows.select("*", F.inline(F.array(F.struct(holds.alias("holds")))))
    # A generator's result is a column that the optimizer can't inline, so each similarity is made once.
    once = F.inline(F.array(F.struct(*(made[f].alias(f"{f}_similarity") for f in search.fields))))
    columns = [c for c in rows.columns if not c.endswith("_trigrams")]
    return _first(_scored(rows.select(*columns, once), search), search, limit)


def _inner(grams: Sequence[str]) -> set[str]:
    """The grams that any text that holds the word has too, whatever is around it there."""
    return {g for g in grams if " " not in g}


def _wanted(search: Search, session, known: Callable[[list[str]], dict[str, int]]) -> tuple[list[list[str]], list[str]] | None:
    """Sets of grams, of one of which a record that matches has all, and grams of which it may have one instead.

    known tells in how many fields grams are. Of a word that must be held the
    PROBED rarest inner grams will do. A field that is like the query has a
    share of MATCH of its grams at least, so it has one of the rarest ones
    that remain when one gram less than that share is left out. None if some word has no inner grams.
    """
    texts = [*search.query.split(), *search.any, *search.all]
    found = _grams(session, search.query, *texts)
    similar, of_texts = found[0], [_inner(g) for g in found[1:]]
    optional = of_texts[: len(texts) - len(search.all)]
    must = of_texts[len(optional) :]
    if not all(optional) or not optional and not any(must):
        return None
    n = known(sorted({*similar, *(g for gs in of_texts for g in gs)}))
    rare = lambda gs: sorted(gs, key=lambda g: (n.get(g, 0), g))
    held = [rare(gs)[:PROBED] for gs in optional] if optional else [rare({g for gs in must for g in gs})[:PROBED]]
    least = max(1, math.ceil(MATCH * len(similar) - 1e-9))
    return held, rare(similar)[: len(similar) - least + 1] if search.query else []


def indexed(index: DataFrame, postings: DataFrame, search: Search, limit: bool = True, grams: DataFrame | None = None) -> DataFrame:
    """literal by the postings of a few of the query's or terms' grams (index.gram_postings): the same rows, without a pass over all texts.

    Only records with these grams are held against the search, like any
    others; if they are few (LOOKED_UP at most), they are looked up in the
    index, else joined. grams (gram, n), if given, tells how frequent grams
    were when postings were stored; whatever it says, the result is the same.
    Words without inner grams, and excluded terms alone, take the one pass.
    """

    def known(of: list[str]) -> dict[str, int]:
        return {r["gram"]: r["n"] for r in grams.where(F.col("gram").isin(of)).collect()} if grams is not None else {}  # a row a gram of the request

    wanted = _wanted(search, index.sparkSession, known)
    if wanted is None:
        return literal(index, search, limit)
    held, similar = wanted
    most = int(len(_grams(index.sparkSession, search.query)[0]) / MATCH + 1e-9) if similar else 0
    read = sorted({g for gs in [*held, similar] for g in gs})
    like = F.max(F.col("gram").isin(similar) & (F.col("size") <= most)) if similar else F.lit(False)
    met = postings.where(F.col("gram").isin(read) & F.col("field").isin(*search.fields)).groupBy("memory_uuid").agg(F.collect_set("gram").alias("met"), like.alias("may"))
    may = F.col("may")
    for gs in held:
        may = may | (F.size(F.array_intersect("met", F.array(*map(F.lit, gs)))) == len(gs))
    found = met.where(may).select("memory_uuid")
    if grams is None:  # postings that may not be stored either: made once, not to count what is found and then again to join it
        found = materialize(found)
    few = [r["memory_uuid"] for r in found.limit(LOOKED_UP + 1).collect()]
    if len(few) > LOOKED_UP:
        return literal(index.join(found, "memory_uuid", "left_semi"), search, limit)
    return literal(index.where(_one_of("memory_uuid", few)), search, limit)


def _one_of(column: str, values: list) -> Column:
    """Equality with one of few values, as a balanced tree of ORs: a scan skips the row groups that hold none of them,
    while of a long IN it only takes the least and the greatest value."""
    if len(values) <= 1:
        return F.col(column) == values[0] if values else F.lit(False)
    half = len(values) // 2
    return _one_of(column, values[:half]) | _one_of(column, values[half:])


def vector_fallback(index: DataFrame, embeddings: DataFrame, search: Search, vector: Sequence[float], model: str, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """Active records under the terms within a distance of the query's vector, nearest first; exact.

    The vector is a literal: one map-side pass and a top-k, no shuffle of vectors.
    """
    query = F.array(*(F.lit(float(x)) for x in vector))
    near = embeddings.where((F.col("embedding_model") == model) & (F.col("embedding_dimension") == len(vector)) & (F.size("embedding") == len(vector)))
    near = near.select("memory_uuid", cosine_distance(F.col("embedding"), query).alias("distance")).where(F.col("distance") <= max_distance)
    rows = index.where("status = 'active'").withColumn("search_text", F.concat_ws(" ", *(_text(f) for f in search.fields))).where(_holds(search))
    found = rows.join(near, "memory_uuid").select("memory_uuid", "title_text", "status", "summary_text", F.lit(None).cast("string").alias("content_preview"), F.array().cast("array<string>").alias("matched_fields"), (1 - F.col("distance")).alias("score"))
    return found.orderBy(F.desc("score"), "title_text", "memory_uuid").limit(search.limit)


def hybrid(index: DataFrame, embeddings: DataFrame, search: Search, vector: Sequence[float], model: str, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """Literal results, or if there are none those by vector, with the strategy that found them.

    Vectors are joined with one row that is there only if nothing matches
    literally; if it isn't, adaptive execution leaves their scan out.
    """
    some = literal(index, search, limit=False).limit(1).agg(F.count("*").alias("some"))
    asked = embeddings.crossJoin(F.broadcast(some.where("some = 0"))).drop("some")  # one row or none
    near = vector_fallback(index, asked, search, vector, model, max_distance)
    return literal(index, search).withColumn("strategy", F.lit("literal")).union(near.withColumn("strategy", F.lit("vector")))


def rerank_merge(candidates: DataFrame, ranked: DataFrame, least: float = LEAST_RERANK) -> DataFrame:
    """candidates (ordinal, score, ...) in the order of ranked (place, ordinal, rerank_score).

    Of a candidate's places the first counts; those under the least score go;
    candidates without a place follow in their own order and with their own
    score; places without a candidate don't count.
    """
    first = ranked.groupBy("ordinal").agg(F.min_by("rerank_score", "place").alias("rerank_score"), F.min("place").alias("place"))
    rows = candidates.join(first, "ordinal", "left").where(F.col("place").isNull() | (F.col("rerank_score") >= least))
    return rows.withColumn("score", F.coalesce("rerank_score", "score")).orderBy(F.col("place").asc_nulls_last(), "ordinal").drop("rerank_score")


@dataclass
class Retrieval:
    """The cascade for one request on the driver, which gets at most LIMIT rows: literal, vectors, rerank."""

    index: DataFrame
    embeddings: DataFrame
    model: str = ""
    embed: Callable[[str], Sequence[float]] | None = None
    rerank: Callable[[str, list[str]], list[tuple[int, float]]] | None = None
    max_distance: float = MAX_DISTANCE
    postings: DataFrame | None = None
    grams: DataFrame | None = None

    def search(self, given: dict) -> dict:
        wanted = request(given)
        first = indexed(self.index, self.postings, wanted, grams=self.grams) if self.postings is not None else literal(self.index, wanted)
        rows = [r.asDict() for r in first.collect()]
        fallback = reranked = False
        if not rows and wanted.semantic and self.embed:
            try:
                vector = self.embed(wanted.semantic)
                rows = [r.asDict() for r in vector_fallback(self.index, self.embeddings, wanted, vector, self.model, self.max_distance).collect()]
                fallback = True
            except (OSError, ProviderError):  # the provider can't be reached, or its answer can't be used
                rows = []
        if len(rows) > 1 and self.rerank:
            texts = ["\n".join(filter(None, [r["title_text"], r["summary_text"], r["content_preview"]])) for r in rows]
            try:
                rows, reranked = merge_ranks(rows, self.rerank(wanted.semantic, texts))
            except (OSError, ProviderError):
                reranked = False
        shown = ("memory_uuid", "title_text", "status", "summary_text", "matched_fields")
        results = [{k: r[k] for k in shown} | ({"score": r["score"]} if fallback or reranked else {}) | ({"content_preview": r["content_preview"]} if r["content_preview"] else {}) for r in rows]
        return {"count": len(results), "vector_fallback": fallback, "reranked": reranked, "results": results}


def merge_ranks(rows: list[dict], ranks: list[tuple[int, float]], least: float = LEAST_RERANK) -> tuple[list[dict], bool]:
    """rerank_merge for the few rows of one request; the flag is false without any rank."""
    out, seen = [], set()
    for at, score in ranks:
        if 0 <= at < len(rows) and at not in seen:
            seen.add(at)
            if score >= least:
                out.append(rows[at] | {"score": score})
    return (out + [r for k, r in enumerate(rows) if k not in seen], True) if ranks else (rows, False)
