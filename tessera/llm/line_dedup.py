"""Removal of lines that many sites share. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import staged, text_or_empty


@dataclass(frozen=True)
class Boilerplate:
    """A line on ``least_sites`` distinct sites or more is boilerplate; one of fewer than ``short_words`` words, which may recur by chance, on ``short_sites``.

    Blank lines are none. ``log_size``: sketches have 2 ** log_size registers, so their error is about 1.04 / 2 ** (log_size / 2), 1.6 % for 12.
    ``doubt``: estimates within this share of the threshold (and 1) are replaced by exact counts.
    """

    least_sites: int = 3
    short_words: int = 5
    short_sites: int = 6
    log_size: int = 12
    doubt: float = 0.1

    def sites_for(self, line: Column) -> Column:
        """How many distinct sites make this line boilerplate. The pattern is one of a line with ``short_words`` words, and stops there."""
        words = r"^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){%d}[^\x20\x09-\x0D]" % (self.short_words - 1)
        return F.when(F.rlike(line, F.lit(words)), self.least_sites).otherwise(self.short_sites)


_NOT_BLANK = r"[^\x20\x09-\x0D]"


def _line_key(line: Column) -> Column:
    """128 bits of a line: two 64-bit hashes with different seeds."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(6), line).alias("b"))


def shared_lines(occurrences: DataFrame, rule: Boilerplate) -> DataFrame:
    """(key, first_id) of boilerplate among ``occurrences`` (id, site, key, need: a row for each line of a document, and the sites that make it boilerplate).

    HyperLogLog sketches of the sites are merged for each line, from partial ones, so a line on any number of
    rows is a few bytes when it is shuffled. A line whose estimate is near the threshold is counted exactly; only
    these lines' rows are read again. A null site is no site.
    """
    spread = staged(
        occurrences.groupBy("key").agg(F.count("*").alias("rows"), F.min("id").alias("first_id"), F.first("need").alias("need"), F.hll_sketch_agg("site", F.lit(rule.log_size)).alias("sketch"))
        .where("rows >= need")
        .select("key", "first_id", "need", F.hll_sketch_estimate("sketch").alias("sites")),
        "line-spread",
    )
    margin = F.greatest(F.lit(1.0), rule.doubt * F.col("need"))
    doubtful = F.col("sites").between(F.col("need") - margin, F.col("need") + margin)
    near = spread.where(doubtful)
    counted = occurrences.join(near.select("key"), "key").groupBy("key").agg(F.countDistinct("site").alias("exact"), F.first("need").alias("enough")).where("exact >= enough")
    certain = spread.where(~doubtful & (F.col("sites") > F.col("need"))).select("key", "first_id")
    return certain.unionByName(near.join(counted.select("key"), "key").select("key", "first_id"))


def remove_boilerplate(docs: DataFrame, rule: Boilerplate = Boilerplate(), id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``docs`` with ``text_col`` without boilerplate lines, and ``removed_lines``: how many lines it lost (long).

    Lines are what stands between line feeds. A boilerplate line stays in the document of least id that has
    it (in rows of that id; wherever it stands there), so no passage leaves the corpus, and goes from all others.
    Lines are found by their hashes; texts are joined once with the few lines that each has to lose.

    Null texts stay null and empty ones empty; both lose no line. Rows with a null site help no line to spread, but lose lines
    like others; so do rows with a null id. Repeated rows stay repeated and lose the same lines. Other columns
    stay as they are. An empty input gives an empty result.
    """
    lines = F.split(text_or_empty(text_col), "\n", -1)
    filled = F.filter(lines, lambda line: F.rlike(line, F.lit(_NOT_BLANK)))
    judged = F.array_distinct(F.transform(filled, lambda line: F.struct(_line_key(line).alias("key"), rule.sites_for(line).alias("need"))))
    occurrences = docs.select(F.col(id_col).alias("id"), F.col(site_col).alias("site"), F.explode(judged).alias("line"))
    occurrences = staged(occurrences.select("id", "site", "line.key", "line.need"), "lines")
    shared = staged(shared_lines(occurrences, rule), "boilerplate")
    lose = (
        occurrences.join(shared, "key").where(~F.col("id").eqNullSafe(F.col("first_id")))
        .groupBy("id").agg(F.collect_set("key").alias("_lose")).withColumnRenamed("id", "_lose_id")
    )
    rows = docs.select(F.struct(*docs.columns).alias("row"))  # so that no name of theirs meets ours
    joined = rows.join(lose, F.col("row")[id_col].eqNullSafe(F.col("_lose_id")), "left")
    before = F.col("row")[text_col]
    kept = F.filter(F.split(before, "\n", -1), lambda line: ~F.array_contains(F.col("_lose"), _line_key(line)))
    cleaned = joined.select("row", F.when(F.col("_lose").isNotNull(), kept).alias("kept"))
    text = F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).otherwise(before)
    removed = F.when(F.col("kept").isNotNull(), F.size(F.split(before, "\n", -1)) - F.size("kept")).otherwise(0).cast("long")
    return cleaned.select(*(text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns), removed.alias("removed_lines"))


#: What ``op6_line_dedup`` returns, for DuckDB, by exact counts of all lines.
OP6_SQL = r"""
with lines as (
  select distinct doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents
), shared as (
  select line, min(doc_id) as first_id from lines
  where regexp_matches(line, '[^\x20\x09-\x0D]')
  group by line
  having count(distinct source) >= case when regexp_matches(line, '^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){4}[^\x20\x09-\x0D]') then 3 else 6 end
), lose as (
  select l.doc_id, list(distinct l.line) as lose from lines l join shared s on l.line = s.line where l.doc_id <> s.first_id group by l.doc_id
), kept as (
  select d.doc_id, d.text, l.lose, list_filter(string_split(d.text, chr(10)), lambda x: not list_contains(l.lose, x)) as kept
  from documents d left join lose l on d.doc_id = l.doc_id
)
select doc_id, case when lose is null then text else array_to_string(kept, chr(10)) end as text,
  case when lose is null then 0 else len(string_split(text, chr(10))) - len(kept) end as removed_lines
from kept
"""
