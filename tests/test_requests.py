"""Requests that are taken and those that aren't, and merging of ranks."""

import pytest

from tessera.operators.search import LIMIT, SearchError, merge_ranks, request

GOOD = [
    ({"query": "  a b ", "limit": 3}, ("a b", (), (), 3)),
    ({"query": "and"}, ("and", (), (), LIMIT)),
    ({"query": "x", "limit": 50}, ("x", (), (), LIMIT)),
    ({"terms": {"include": ["a"], "exclude": ["b"]}, "filters": []}, ("", ("a",), ("b",), LIMIT)),
    ({"terms": {"include": [], "exclude": ["b c"]}, "filters": ["title"]}, ("", (), ("b c",), LIMIT)),
]
BAD = [
    {}, {"query": ""}, {"query": "  "}, {"query": "a AND b or c"}, {"query": "a", "terms": {"include": ["a"], "exclude": []}, "filters": []},
    {"terms": {"include": ["a"], "exclude": []}}, {"filters": ["title"]}, {"terms": {"include": ["a"], "exclude": []}, "filters": ["body"]},
    {"terms": {"all": ["a"], "none": [], "any": []}, "filters": []}, {"terms": {"include": [], "exclude": []}, "filters": []},
    {"terms": {"include": [" "], "exclude": []}, "filters": []}, {"terms": {"include": ["a"]}, "filters": []}, {"query": "a", "limit": 0}, {"query": "a", "other": 1},
]


@pytest.mark.parametrize("given, want", GOOD)
def test_good(given, want):
    s = request(given)
    assert (s.query, s.any, s.none, s.limit) == want


@pytest.mark.parametrize("given", BAD)
def test_bad(given):
    with pytest.raises(SearchError):
        request(given)


def test_semantic_text():
    assert request({"terms": {"include": ["a", "b"], "exclude": ["c"]}, "filters": []}).semantic == "a b"


def test_merge_ranks():
    rows = [{"id": k, "score": 1.0} for k in range(4)]
    out, flag = merge_ranks(rows, [(2, 0.9), (0, 0.0001), (9, 0.8), (2, 0.1)])
    assert flag and [(r["id"], r["score"]) for r in out] == [(2, 0.9), (1, 1.0), (3, 1.0)]
    assert merge_ranks(rows, []) == (rows, False)
