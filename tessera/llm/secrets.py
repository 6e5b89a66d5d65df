"""Secrets in texts: rules as regular expressions, candidates by an inverted index of trigrams, matches verified in place. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import staged, text_or_empty
from tessera.llm.trigrams import EVERYTHING, bound, can_be_empty, candidates, postings, trigram_query


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` (in the syntax that Java and Python share), from the left and without overlaps, whose ``group`` has ``least`` characters or more.

    A match that is too short is dropped, but what it covers is not looked at again.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The three base kinds. Runs of hexadecimal digits are whole where they are found, so their length is part of the pattern.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)

# Published forms of keys and tokens that services hand out.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("live_key", r"[rs]k_live_[A-Za-z0-9]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)


def _running(amounts: Column) -> Column:
    """Running totals of an array, each with its own amount: sums over twice as many at each step, so n log n and not n squared."""
    doublings = lambda a: F.sequence(F.lit(0), F.ceil(F.log2(F.size(a) + 1.0)).cast("int"))
    add = lambda s, k: bound(F.pow(F.lit(2), k).cast("int"), lambda far: F.transform(s, lambda v, i: v + F.when(i >= far, F.get(s, i - far)).otherwise(0)))
    return bound(amounts, lambda a: F.aggregate(doublings(a), a, add))


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of a rule's matches, in code points, end exclusive.

    Matches and the pieces between them alternate, so a match starts behind all pieces and matches before it.
    """
    pattern = F.lit(rule.pattern)
    matches = lambda group: F.regexp_extract_all(text, pattern, F.lit(group))
    sized = lambda strings: F.transform(strings, lambda s: F.length(s))

    def placed(m: Column) -> Column:
        """``m``: lengths of matches, of their deciding groups, and of the pieces."""
        steps = F.transform(m["whole"], lambda n, i: F.get(m["between"], i) + F.when(i > 0, F.get(m["whole"], i - 1)).otherwise(0))
        every = bound(_running(steps), lambda starts: F.transform(starts, lambda s, i: F.struct(s.alias("start"), (s + F.get(m["whole"], i)).alias("end"), F.get(m["group"], i).alias("size"))))
        return F.transform(F.filter(every, lambda s: s["size"] >= rule.least), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    parts = F.struct(sized(matches(0)).alias("whole"), sized(matches(rule.group)).alias("group"), sized(F.split(text, rule.pattern, -1)).alias("between"))
    return F.when(text.rlike(rule.pattern), bound(parts, placed)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, found: array<struct<start, place, end, kind>>), a row for each row of ``docs``: matches of all rules in order of start, then of the rules (``place``: a rule's).

    Each rule's regular expression gives a Boolean query of trigrams (``trigram_query``). Texts are indexed by the trigrams that the queries name, postings are
    intersected, and a rule is run over its candidates only; rules without a mandatory trigram (as runs of digits) are run over all texts. Texts meet their
    candidates' rules by a hash of id and text, one row for each; a collision adds a candidate, which verification drops, and loses none. Rows of one id and text may be many: the join has no
    order to keep, so they are split like any skewed key.

    Null texts are empty, and empty ones have no matches; a null id keeps its row; repeated rows stay repeated, each with its matches; other columns are not read. An empty input
    gives an empty result. Texts are never cut.
    """
    if unfit := [r.kind for r in rules if can_be_empty(r.pattern)]:
        raise ValueError(f"patterns that match nothing at all: {', '.join(unfit)}")
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {kind: q for kind, q in queries.items() if EVERYTHING != q}
    trigrams = sorted({t for q in indexed.values() for all_of in q for t in all_of})
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("key", F.xxhash64("id", "text"))
    asked = rows.select("key", "text", F.lit(None).cast("array<string>").alias("rules"), "id")
    if indexed:
        index = staged(postings(rows, trigrams, "key", "text").sortWithinPartitions("trigram"), "secret-postings")
        asked = rows.join(candidates(index, indexed, trigrams), "key", "left")

    def matches(place: int, rule: Rule) -> Column:
        spans = F.transform(spans_of(F.col("text"), rule), lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), F.lit(rule.kind).alias("kind")))
        if rule.kind not in indexed:
            return spans
        return F.when(F.array_contains("rules", rule.kind), spans).otherwise(F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>"))

    return asked.select(F.col("id").alias(id_col), F.sort_array(F.concat(*[matches(i, r) for i, r in enumerate(rules)])).alias("found"))


def secret_report(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_<kind> of each base kind, base_sha256, spans): ``find_secrets``, counted and digested. spans: kind:start:end of all, comma-joined; base_sha256: of the base kinds' alone."""
    found = find_secrets(docs, base + more, id_col, text_col)
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_base = F.filter("found", lambda s: s["place"] < len(base))
    count = lambda place: F.size(F.filter("found", lambda s: s["place"] == place)).cast("long")
    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(base)]
    return found.select(id_col, *counts, F.sha2(written(of_base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rule_sql(place: int, rule: Rule) -> str:
    p = _quoted(rule.pattern)
    return f"""select n, {place} as place, '{rule.kind}' as kind, cast(list_sum([len(x) for x in pieces[1:i]]) + coalesce(list_sum([len(x) for x in whole[1:i-1]]), 0) as bigint) as b, len(whole[i]) as size
  from (select n, pieces, whole, deciding, unnest(range(1, len(whole) + 1)) as i from (select n, regexp_split_to_array(t, {p}) as pieces, regexp_extract_all(t, {p}, 0) as whole, regexp_extract_all(t, {p}, {rule.group}) as deciding from d where regexp_matches(t, {p})))
  where len(deciding[i]) >= {rule.least}"""


#: For DuckDB: every rule over every text.
OP13_SQL = f"""with d as (select row_number() over () as n, doc_id, coalesce(text, '') as t from documents), s as ({' union all '.join(_rule_sql(i, r) for i, r in enumerate(BASE + MORE))}),
g as (select n, {', '.join(f"count(*) filter (place = {i}) as n_{r.kind}" for i, r in enumerate(BASE))},
  string_agg(kind || ':' || b || ':' || (b + size), ',' order by b, place) filter (place < {len(BASE)}) as base, string_agg(kind || ':' || b || ':' || (b + size), ',' order by b, place) as spans from s group by n)
select doc_id, {', '.join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (n)"""
