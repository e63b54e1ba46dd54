"""Column expressions on text: normalisation, trigram similarity, hashes, chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of trigram similarity are maximal runs of letters and digits.
WORD = "[\\p{L}\\p{N}]+"
#: Similarity from which two texts match.
MATCH = 0.3


def normalize_title(text: Column) -> Column:
    """Spaces trimmed, lower case, each run of white space one space."""
    return F.regexp_replace(F.lower(F.trim(text)), "\\s+", " ")


def normalize_keyword(text: Column) -> Column:
    """Like a title's, for any Unicode white space and at both ends."""
    return F.trim(F.regexp_replace(F.lower(text), "(?U)\\s+", " "))


def contains(text: Column, part: Column) -> Column:
    """Literal containment without regard to case; an empty part is in every text."""
    return F.contains(F.lower(text), F.lower(part))


def padded(text: Column) -> Column:
    """A text's distinct lower-cased words side by side, each with two spaces before it, and one at the end."""
    words = F.array_distinct(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"))
    return F.concat(F.lit("  "), F.array_join(words, "  "), F.lit(" "))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a text's lower-cased words, each with two spaces before and one after it.

    A word that a text repeats adds none, so each is taken once. They are
    padded side by side, and one expression that looks ahead at each place
    finds the windows of three that lie in one padded word.
    """
    return F.array_distinct(F.regexp_extract_all(padded(text), F.lit("(?=(  [^ ]| [^ ]{2}| [^ ] |[^ ]{3}|[^ ]{2} ))"), 1))


def jaccard(both: Column, a: Column, b: Column) -> Column:
    """From the sizes of an intersection and of two sets; 0 if either is empty."""
    return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(both / (a + b - both))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two trigram arrays; 0 if either is empty. a is evaluated once (a lambda's variable is not inlined)."""
    sizes = F.transform(F.array(a), lambda g: F.struct(F.size(F.array_intersect(g, b)).alias("both"), F.size(g).alias("own")))
    return F.element_at(F.transform(sizes, lambda s: jaccard(s["both"], s["own"], F.size(b))), 1)


def json_hash(json: Column) -> Column:
    """0x and the SHA-256 of compact JSON text in lower-case hex."""
    return F.concat(F.lit("0x"), F.sha2(json, 256))


def json_string(text: Column) -> Column:
    """A string as JSON text, null as null."""
    inner = F.to_json(F.struct(text.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(inner, F.lit(6), F.length(inner) - 6)


def chunks(text: Column, size: int = 500, most: int = 40) -> Column:
    """A text's first chunks of size characters, one at least."""
    count = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.length(text) / size))).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substring(text, k * size + 1, F.lit(size)))


def embedding_input(title: Column, summary: Column, content: Column, keywords: Column, most: int = 12_000) -> Column:
    """Trimmed parts that aren't empty and the keywords, a line each, cut to most characters; null if there is nothing."""
    part = lambda c: F.nullif(F.trim(c), F.lit(""))
    text = F.concat_ws("\n", part(title), part(summary), part(content), F.nullif(F.array_join(keywords, " "), F.lit("")))
    return F.nullif(F.left(text, F.lit(most)), F.lit(""))


def occurrences(text: Column, part: Column) -> Column:
    """How often a part that isn't empty is found from left to right."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")


def replace_unique(text: Column, part: Column, new: Column) -> Column:
    """text with its one occurrence of part replaced; null unless there is just one."""
    at = F.locate_pos(text, part) if hasattr(F, "locate_pos") else F.instr(text, part)
    return F.when(occurrences(text, part) == 1, F.overlay(text, new, at, F.length(part)))


#: A text's length is below 2 to this power.
LENGTH_BITS = 31


def _shared(p: Column, most: Column, at: Callable[[Column, Column], Column]) -> Column:
    """How many of most characters x and y have in common, which hold four bytes a character: the number is found bit by bit,
    and each bit compares only the bytes that it adds. at: where the characters after n begin, given how many they are."""
    powers = [F.lit(1 << bit) for bit in reversed(range(LENGTH_BITS))]

    def longer(n: Column, power: Column) -> Column:
        part = lambda c: F.substring(p[c], at(n, power)(p[c]), 4 * power)
        return F.when((power <= most - n) & (part("x") == part("y")), n + power).otherwise(n)

    return F.aggregate(F.array(*powers), F.lit(0), longer)


def text_diff(before: Column, after: Column) -> Column:
    """prefix, old, new, suffix: what two texts begin and then end with in common, in code points, and what is between; null is empty.

    Each step is bound as an array's element, so that it is made once.
    """
    empty = F.lit("")
    a, b = (F.coalesce(c, empty) for c in (before, after))
    pair = F.array(F.struct(a.alias("a"), b.alias("b"), F.encode(a, "UTF-32").alias("x"), F.encode(b, "UTF-32").alias("y"), F.least(F.length(a), F.length(b)).alias("most")))
    kept = lambda p: [p[c].alias(c) for c in ("a", "b", "x", "y", "most")]
    head = F.transform(pair, lambda p: F.struct(*kept(p), _shared(p, p["most"], lambda n, _: lambda _: 4 * n + 1).alias("n")))
    both = F.transform(head, lambda p: F.struct(*kept(p), p["n"].alias("n"), _shared(p, p["most"] - p["n"], lambda n, power: lambda c: F.length(c) - 4 * (n + power) + 1).alias("m")))
    between = lambda p, c: F.substring(p[c], p["n"] + 1, F.length(p[c]) - p["n"] - p["m"])
    parts = F.transform(both, lambda p: F.struct(F.left(p["a"], p["n"]).alias("prefix"), between(p, "a").alias("old"), between(p, "b").alias("new"), F.right(p["a"], p["m"]).alias("suffix")))
    return F.element_at(parts, 1)


def is_slug(text: Column) -> Column:
    return text.rlike("^[a-z][a-z0-9_]*$")
