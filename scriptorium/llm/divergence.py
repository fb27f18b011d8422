"""How far the sources of a language differ in their words.

Plain relational: terms are exploded and counted by group, groups meet the kept vocabulary so that zeros count, groups
meet each other term by term, differences are summed and ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import bounded, stored

#: Terms are runs of letters, which are all characters but ASCII that is no letter; this is what lies between them.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of a language that a term must be in, what is added to each count, parts that a whole has, and terms listed for a group.
LEAST_DOCS, ADDED, WHOLE, TOP = 30, 5, 1_000_000_000, 50


def lowered(text: Column) -> Column:
    """A to Z in lower case and nothing else; the quick built-in serves where all of a text is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def term_counts(docs: DataFrame) -> DataFrame:
    """g, term, n (occurrences), docs (documents that have it) of g (a group's number) and text, without nulls.

    Texts are cut at what lies between terms. A document's terms are sorted before they are exploded, so that equal ones are one row with
    their number, and one aggregation, combined before the shuffle, counts occurrences and documents.
    """
    found = docs.select("g", F.sort_array(F.split(lowered(F.col("text")), BETWEEN)).alias("terms"))
    starts = F.filter(F.sequence(F.lit(0), F.size("terms") - 1), lambda at: (at == 0) | (F.get("terms", at - 1) != F.get("terms", at)))
    ends = lambda starts: F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size("terms")))
    cut = found.select("g", "terms", starts.alias("starts"))
    runs = cut.select("g", F.explode(F.zip_with("starts", ends(F.col("starts")), lambda at, end: F.struct(F.get("terms", at).alias("term"), (end - at).alias("n")))).alias("e"))
    return runs.select("g", "e.term", "e.n").where("term <> ''").groupBy("g", "term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


def share(n: str, total: str, terms: str, added: int, whole: int) -> Column:
    """1 + floor(whole * (n + added) / (total + added * terms)), in whole numbers of up to 38 digits."""
    return F.expr(f"1L + (CAST({whole} AS DECIMAL(12, 0)) * CAST({n} + {added}L AS DECIMAL(20, 0))) div CAST({total} + {added}L * {terms} AS DECIMAL(20, 0))")


def divergence(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, added: int = ADDED, whole: int = WHOLE, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank.

    Each lang keeps the terms that ``least_docs`` of its documents have. In each group of lang and source a kept term has a
    smoothed share of ``whole`` parts. Part ``pair`` lists the lang's other sources with the summed differences of all shares (0 without
    kept terms), part ``term`` the ``top`` terms that the group has more of than its lang.

    Null text, lang and source read as ''. Every row is a document, repeated ones too. A group without terms has only zeros; a
    lang of one source has no pairs. An empty table gives no rows. Further columns don't count.
    """
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))
    # Groups and kept terms go by numbers from here on; they are written once, so that these stay theirs.
    groups = stored(own.select("lang", "source").distinct().withColumn("g", F.monotonically_increasing_id()), "groups")
    counts = stored(term_counts(own.join(bounded(groups), ["lang", "source"]).select("g", "text")), "term-counts").join(bounded(groups.select("g", "lang")), "g")
    frequent = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= least_docs)
    kept = stored(frequent.withColumn("t", F.monotonically_increasing_id()), "kept-terms")

    filled = kept.select("lang", "t").join(bounded(groups.select("lang", "g")), "lang").select("g", "t")
    some = counts.select("g", "lang", "term", "n").join(bounded(kept.select("lang", "term", "t")), ["lang", "term"]).select("g", "t", "n")
    dense = stored(filled.join(some, ["g", "t"], "left").select("g", "t", F.coalesce("n", F.lit(0).cast("long")).alias("n")), "dense-counts")
    totals = stored(dense.groupBy("g").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms")), "group-totals")
    p = dense.join(bounded(totals), "g").select("g", "t", "n", share("n", "total", "terms", added, whole).alias("p"))
    of_lang = stored(kept.groupBy("lang").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms")), "lang-totals")
    q = stored(kept.join(bounded(of_lang), "lang").select("t", "term", share("n", "total", "terms", added, whole).alias("q")), "lang-shares")

    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    over = p.where("n > 0").join(bounded(q), "t").where("p > q").join(bounded(groups), "g").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    # A difference is the same both ways: each pair of sources meets once a term, the smaller number first.
    left, right = p.select("t", F.col("g").alias("a"), "p"), p.select("t", F.col("g").alias("b"), F.col("p").alias("q"))
    sums = left.join(right, "t").where("a < b").groupBy("a", "b").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("value"))
    pairs = groups.join(bounded(groups.select("lang", F.col("source").alias("other"), F.col("g").alias("h"))), "lang").where("g <> h")
    met = pairs.withColumn("a", F.least("g", "h")).withColumn("b", F.greatest("g", "h")).join(sums, ["a", "b"], "left")
    apart = met.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    return ranked(apart).unionByName(ranked(over).where(F.col("rank") <= top))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
e AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM e GROUP BY ALL),
k AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
z AS (SELECT g.lang, g.source, k.term, CAST(coalesce(c.n, 0) AS HUGEINT) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, CAST(1 + (1000000000 * (n + 5)) // (sum(n) OVER w + 5 * count(*) OVER w) AS BIGINT) AS p FROM z WINDOW w AS (PARTITION BY lang, source)),
q AS (SELECT lang, term, CAST(1 + (1000000000 * (n + 5)) // (sum(n) OVER w + 5 * count(*) OVER w) AS BIGINT) AS q FROM k WINDOW w AS (PARTITION BY lang)),
s AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b USING (lang, term) GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
v AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM u)
SELECT * FROM v WHERE part = 'pair' OR rank <= 50"""
