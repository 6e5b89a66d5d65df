"""Boolean trigram queries of regular expressions, and an inverted index of the trigrams that they name (Cox 2012)."""

from __future__ import annotations

import re
from itertools import product
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that a part of a pattern may stand for, as long as they are followed one by one.
_MOST_STRINGS, _MOST_CONJUNCTIONS = 64, 256

Query = frozenset[frozenset[str]]

#: A query that every text meets: one conjunction, of nothing.
EVERYTHING: Query = frozenset([frozenset()])


def _fewest(query: set[frozenset[str]]) -> Query:
    """Without conjunctions that another one implies. A query of too many of them is weakened to everything."""
    kept = frozenset(q for q in query if not any(other < q for other in query))
    return kept if len(kept) <= _MOST_CONJUNCTIONS else EVERYTHING


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > 4 * _MOST_CONJUNCTIONS:  # either alone is a weaker query
        return min(a, b, key=len)
    return _fewest({x | y for x, y in product(a, b)})


def _of_strings(strings: set[str]) -> Query:
    return _fewest({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _fold(code: int) -> str | None:
    """A character in lower case (A-Z); None beyond ASCII, where cases do not pair up one by one."""
    return chr(code).lower() if code < 128 else None


def _class(items) -> set[str] | None:
    """The characters of a class, if they are few and ASCII."""
    out: set[str | None] = set()
    for kind, value in items:
        if kind is sre.LITERAL:
            out.add(_fold(value))
        elif kind is sre.RANGE and value[1] - value[0] < _MOST_STRINGS:
            out |= {_fold(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return None if None in out else out


class _Walk:
    """A sequence of parts, read from the left: strings so far, where these are few, and what all strings before had to hold."""

    def __init__(self):
        self.strings, self.query = {""}, EVERYTHING

    def cut(self) -> None:
        """What follows is not known: only trigrams of the strings so far are kept."""
        self.query = _both(self.query, _of_strings(self.strings))
        self.strings = {""}

    def add(self, strings: set[str]) -> None:
        if len(self.strings) * len(strings) > _MOST_STRINGS:
            self.cut()
        if len(strings) > _MOST_STRINGS:
            self.query = _both(self.query, _of_strings(strings))
        else:
            self.strings = {a + b for a, b in product(self.strings, strings)}

    def take(self, part: tuple[set[str] | None, Query]) -> None:
        strings, query = part
        if strings is not None:
            self.add(strings)
        else:
            self.cut()
            self.query = _both(self.query, query)


def _part(kind, value) -> tuple[set[str] | None, Query]:
    """(the strings that a part of a pattern stands for, if few; a query that any of them meets)."""
    if kind is sre.LITERAL:
        char = _fold(value)
        return ({char}, EVERYTHING) if char else (None, EVERYTHING)
    if kind is sre.IN:
        return _class(value), EVERYTHING
    if kind is sre.SUBPATTERN:
        return _sequence(value[3])
    if kind is sre.ATOMIC_GROUP:
        return _sequence(value)
    if kind is sre.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        if all(s is not None for s, _ in parts):
            strings = set().union(*(s for s, _ in parts))
            return (strings, EVERYTHING) if len(strings) <= _MOST_STRINGS else (None, _of_strings(strings))
        return None, _fewest(set().union(*(_of_strings(s) if s is not None else q for s, q in parts)))
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, body = value
        strings, query = _sequence(body)
        if strings is not None and most is not sre.MAXREPEAT and sum(len(strings) ** n for n in range(least, min(most, 99) + 1)) <= _MOST_STRINGS:
            return {"".join(c) for n in range(least, most + 1) for c in product(strings, repeat=n)}, EVERYTHING
        if least == 0:
            return None, EVERYTHING
        walk = _Walk()
        for _ in range(min(least, 8)):
            walk.take((strings, query))
        walk.cut()
        return None, walk.query
    if kind in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {""}, EVERYTHING
    return None, EVERYTHING


def _sequence(parts) -> tuple[set[str] | None, Query]:
    walk, whole = _Walk(), True
    for kind, value in parts:
        part = _part(kind, value)
        whole = whole and part[0] is not None and len(walk.strings) * len(part[0]) <= _MOST_STRINGS
        walk.take(part)
    if whole:
        return walk.strings, EVERYTHING
    walk.cut()
    return None, walk.query


def trigram_query(pattern: str) -> Query:
    """Alternatives, each a set of trigrams, of which every text (in lower case) with a match of ``pattern`` holds one whole.

    ``EVERYTHING`` where the pattern has no mandatory trigram. Characters of a sequence are followed through small classes, alternatives
    and bounded repetitions, and cut where too many strings could stand; a cut weakens a query, and never loses a match.
    """
    strings, query = _sequence(parser.parse(pattern))
    return _of_strings(strings) if strings is not None else query


def can_be_empty(pattern: str) -> bool:
    return re.compile(pattern) is not None and parser.parse(pattern).getwidth()[0] == 0


def bound(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is used: what a fold of nothing begins, and ends, with."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, use)


def postings(rows: DataFrame, trigrams: list[str], key: str, text: str) -> DataFrame:
    """(trigram: its place in ``trigrams``, key): the inverted index of ``rows`` for these trigrams, once for each key.

    Texts are looked through in lower case. Only trigrams that some query names have postings, so a text has at most as many as there are of these.
    """
    held = lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    found = rows.select(F.explode(bound(F.lower(F.col(text)), held)).alias("trigram"), F.col(key).alias("key"))
    return found.distinct()


def candidates(index: DataFrame, queries: dict[str, Query], trigrams: list[str]) -> DataFrame:
    """(key, rules: array<string>): which of the named queries a key's postings meet; keys that meet none are left out.

    Postings of a conjunction's trigrams are intersected by counting them for each key. The table of conjunctions is as large as the rules
    are, whatever the corpus, and is broadcast.
    """
    place = {t: i for i, t in enumerate(trigrams)}
    terms = [(place[t], number, name, len(all_of)) for number, (name, all_of) in enumerate((n, q) for n, query in sorted(queries.items()) for q in sorted(map(sorted, query))) for t in all_of]
    table = F.broadcast(index.sparkSession.createDataFrame(terms, "trigram int, conjunction int, rule string, needed long"))
    met = index.join(table, "trigram").groupBy("key", "conjunction", "rule", "needed").agg(F.count("*").alias("held")).where(F.col("held") == F.col("needed"))
    return met.groupBy("key").agg(F.sort_array(F.collect_set("rule")).alias("rules"))  # as many as there are rules, at most
