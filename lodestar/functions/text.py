"""Text functions as column expressions: normalisation, tokens, keywords, sentences.

Each takes and returns a Column, so a plan over a catalog, a question or a
hundred million rows stays in the JVM. ``\\s`` and ``\\b`` follow Unicode.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.vocabulary import DESCRIPTION_STOPWORDS, LITERAL_REWRITES, NOISE_WORDS, PHRASE_REWRITES, SEARCH_FAMILIES

TOKEN = "[a-z0-9_]+|[一-鿿]+"
SPACE = r"[\s\x1C-\x1F]"
_ASCII = r"^[\x00-\x7F]*$"


#: The canonical term of each search term.
SEARCH_TERMS = {member: canonical for canonical, members in SEARCH_FAMILIES.items() for member in members}


def with_canonical(tokens: Column, terms: dict[str, str]) -> Column:
    """Each token followed by its canonical term, if it has one."""
    table = F.create_map(*[F.lit(x) for pair in terms.items() for x in pair])
    return F.flatten(F.transform(tokens, lambda t: F.array_compact(F.array(t, F.try_element_at(table, t)))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body, or a lambda in it, names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _anchors(pattern: str) -> list[str]:
    """Literal strings of which any text that the pattern matches holds at least one."""
    body = pattern.replace(r"\b", "")
    return [body.split("(")[0]] if "(" in body else body.split("|")


def _rewrite(text: Column, pattern: str, new: str) -> Column:
    """A rewrite that runs its expression only on texts that hold an anchor of it: a byte search is far cheaper."""

    def run(t: Column) -> Column:
        held = reduce(lambda x, y: x | y, [F.contains(t, F.lit(a)) for a in _anchors(pattern)])
        return F.when(held, F.regexp_replace(t, "(?U)" + pattern, new)).otherwise(t)

    return let(text, run)


def prepare(text: Column) -> Column:
    """Lower-cased text after the literal and the phrase rewrites."""
    literal = reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), LITERAL_REWRITES, F.lower(text))
    return reduce(lambda c, r: _rewrite(c, *r), PHRASE_REWRITES, literal)


def tokens(text: Column) -> Column:
    """Normalised tokens: words and CJK runs, canonical terms added, first occurrences in order. Null: none."""
    found = F.regexp_extract_all(prepare(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.array_distinct(with_canonical(F.array_distinct(found), SEARCH_TERMS))


def normalize_for_search(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def dedupe_terms(terms: Column) -> Column:
    """Distinct elements; the first of each stays where it is."""
    return F.array_distinct(terms)


def compact_sentence(text: Column) -> Column:
    """The first sentence with white space collapsed and one full stop at its end; blank: empty."""
    first = F.get(F.split(collapse_space(F.coalesce(text, F.lit(""))), r"(?<=[.!?]) +", 2), 0)
    return let(first, lambda s: F.when(s == "", "").otherwise(F.concat(F.regexp_replace(s, r"\.+$", ""), F.lit("."))))


def _is_ascii(t: Column) -> Column:
    return t.rlike(_ASCII)


def description_keywords(text: Column, limit: int = 8) -> Column:
    """The first ``limit`` tokens that are neither stop words nor ASCII of two characters or fewer."""
    stop = F.array(*[F.lit(w) for w in DESCRIPTION_STOPWORDS])
    kept = F.filter(tokens(text), lambda t: ~F.array_contains(stop, t) & ~((F.length(t) <= 2) & _is_ascii(t)))
    return F.slice(kept, 1, limit)


def exact_text(*parts: Column) -> Column:
    """Distinct tokens of all parts, in order, as one string; a part is an array of strings, null like an empty one.

    All parts go through one lambda: the rewrites are a large expression, and
    a copy for each part would cost more to analyse than the rows to compute.
    """
    none = F.array().cast("array<string>")
    every = F.concat(*[F.coalesce(p, none) for p in parts]) if len(parts) > 1 else F.coalesce(parts[0], none)
    return F.array_join(F.array_distinct(F.flatten(F.transform(every, tokens))), " ")


def label(table: Column, column: Column) -> Column:
    return F.concat(table, F.lit("::"), column)


def _terms(normalized: Column) -> Column:
    """Tokens of a text without noise words and single ASCII characters."""
    noise = F.array(*[F.lit(w) for w in NOISE_WORDS])
    return F.filter(tokens(normalized), lambda t: ~F.array_contains(noise, t) & ~((F.length(t) == 1) & _is_ascii(t)))


def query_terms(text: Column) -> Column:
    """Terms of a question: normalised twice (a rewrite may make way for another), noise dropped."""
    return _terms(normalize_for_search(text))


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"(?U){SPACE}+", " "), "^ +| +$", "")
