"""Benchmark decontamination: a positional inverted index of the training texts.

``build`` stores one posting (term, row, position) for every training token that is a term of the
test texts, plus one sentinel posting a document that carries its key and length. Test
phrases are windows of consecutive words. A window's candidates come from the offset-adjusted
list of its rarest term, are cut down with the list of its second rarest, and only then checked
against the lists of all its terms. Everything is DataFrame functions.

Defined cases: null and word-less texts have no words and no hits; a test text of fewer words than a
window is one window, one without words none; repeated documents each give a row, and so do null keys;
test texts that share an id count as one item, a null id is written as an empty string; no
documents give no rows; no test texts give rows without hits; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import alone, bounded, stored, text_id

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10


def words(text: Column) -> Column:
    """A-Z lower-cased, then runs of ASCII letters, digits and everything beyond ASCII."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


class Index(NamedTuple):
    """terms: term, word. postings: term, row, pos, key (null but for term 0, the sentinel, whose pos is the number of words)."""

    terms: DataFrame
    postings: DataFrame


def items(tests: DataFrame, *, item: str = "item_id", text: str = "text") -> DataFrame:
    """Test texts as stored rows: n (a number of the row), item (its id as a string), ws (its words)."""
    return stored(tests.select(F.monotonically_increasing_id().alias("n"), F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words(F.col(text).cast("string")).alias("ws")), "items")


def build(docs: DataFrame, tested: DataFrame, *, key: str = "doc_id", text: str = "text") -> Index:
    """Index ``docs`` for the terms of ``tested`` (from ``items``)."""
    vocabulary = tested.select(F.explode("ws").alias("word")).distinct()
    numbered = stored(vocabulary.select("word", (F.monotonically_increasing_id() + 1).alias("term")).union(docs.sparkSession.createDataFrame([("", 0)], "word string, term long")), "terms")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), words(F.col(text).cast("string")).alias("ws"))
    tokens = rows.select("row", "key", F.posexplode(F.array_append("ws", F.lit(""))).alias("pos", "word"))
    postings = tokens.join(bounded(numbered), "word").select("term", "row", "pos", F.when(F.col("term") == 0, F.col("key")).alias("key"))
    return Index(numbered, stored(postings, "postings"))


def windows(tested: DataFrame, size: int = WINDOW) -> DataFrame:
    """n, item, start, len, ws: every window of ``size`` consecutive words."""
    n = F.size("ws")
    starts = F.when(n >= size, F.sequence(F.lit(0), n - size)).when(n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return tested.select("n", "item", "ws", F.explode(starts).alias("start")).select("n", "item", "start", F.least(F.lit(size), F.size("ws")).alias("len"), F.slice("ws", F.col("start") + 1, size).alias("ws"))


def ranked_terms(index: Index, phrases: DataFrame) -> DataFrame:
    """phrase, off, term, rarity (1: the phrase's rarest), len; only phrases all of whose terms have postings. ``phrases``: phrase, ws.

    Terms get their frequency once each and meet the phrases' words by a broadcast, so no row is shuffled by a term.
    """
    frequency = index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("cf"))
    weighed = stored(index.terms.join(frequency, "term", "left"), "term-frequencies")
    spread = phrases.select("phrase", F.size("ws").alias("len"), F.posexplode("ws").alias("off", "word")).join(bounded(weighed), "word")
    per = Window.partitionBy("phrase")
    ranked = spread.withColumn("known", F.count("cf").over(per)).where("known = len").withColumn("rarity", F.row_number().over(per.orderBy("cf", "off")))
    return ranked.select("phrase", "off", "term", "rarity", "len")


def phrase_matches(index: Index, phrases: DataFrame) -> DataFrame:
    """row, phrase, at: where each phrase (phrase, ws) stands word for word."""
    terms = stored(ranked_terms(index, phrases), "phrase-terms")
    postings = index.postings.where("term > 0").select("term", "row", "pos")
    first = terms.where("rarity = 1").select("phrase", "off", "term", "len")
    found = postings.join(bounded(first), "term").select("row", "phrase", "len", (F.col("pos") - F.col("off")).alias("at"))
    second = terms.where("rarity = 2").select("phrase", F.col("off").alias("off2"), F.col("term").alias("term2"))
    narrow = found.join(bounded(second), "phrase", "left").withColumn("pos", F.col("at") + F.coalesce("off2", F.lit(0)))
    lists = postings.join(bounded(second.select(F.col("term2").alias("term")).distinct()), "term", "left_semi")
    alone = narrow.where("term2 is null").select("row", "phrase", "len", "at")
    pairs = narrow.where("term2 is not null").withColumnRenamed("term2", "term").join(lists, ["row", "pos", "term"], "left_semi").select("row", "phrase", "len", "at")
    left = stored(pairs.union(alone), "candidates")
    expected = left.join(bounded(terms.select("phrase", "off", "term")), "phrase").select("row", "phrase", "len", "at", "term", (F.col("at") + F.col("off")).alias("pos"))
    own = postings.join(bounded(left.select("row").distinct()), "row", "left_semi")
    whole = expected.join(own, ["row", "pos", "term"]).groupBy("row", "phrase", "len", "at").agg(F.count(F.lit(1)).alias("met")).where("met = len")
    return whole.select("row", "phrase", "at")


def proximity_matches(index: Index, phrases: DataFrame, within: int) -> DataFrame:
    """row, phrase, at: positions of each phrase's rarest term around which, at most ``within`` words away, all its terms stand in any order."""
    terms = stored(ranked_terms(index, phrases), "phrase-terms")
    postings = index.postings.where("term > 0").select("term", "row", "pos")
    anchors = postings.join(bounded(terms.where("rarity = 1").select("phrase", "term")), "term").select("row", "phrase", F.col("pos").alias("at"))
    cell = lambda p: F.floor(p / F.lit(within + 1))
    near = anchors.select("row", "phrase", "at", F.explode(F.array(*(cell(F.col("at")) + i for i in (-1, 0, 1)))).alias("cell"))
    wanted = near.join(bounded(terms.select("phrase", "term").distinct()), "phrase")
    met = wanted.join(postings.withColumn("cell", cell(F.col("pos"))), ["row", "cell", "term"]).where(F.abs(F.col("pos") - F.col("at")) <= within)
    needed = terms.groupBy("phrase").agg(F.countDistinct("term").alias("needed"))
    return met.groupBy("row", "phrase", "at").agg(F.countDistinct("term").alias("n")).join(bounded(needed), "phrase").where("n = needed").select("row", "phrase", "at")


def contamination(docs: DataFrame, tests: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", test_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row a document: key, n_words, n_hit (words inside any occurring window), items (array of item ids), spans (array of from, to)."""
    tested = items(tests, item=item, text=test_text)
    index = build(docs, tested, key=key, text=text)
    listed = stored(windows(tested, window).select(F.struct("n", "start").alias("phrase"), "item", "len", "ws"), "windows")
    # Windows that say the same are searched once.
    spoken = listed.groupBy("ws").agg(F.min("phrase").alias("first"))
    hits = stored(phrase_matches(index, spoken.select(F.col("first").alias("phrase"), "ws")), "hits")
    lengths = spoken.select(F.col("first").alias("phrase"), F.size("ws").alias("len"))
    spans = hits.join(bounded(lengths), "phrase").select("row", F.col("at").alias("from"), (F.col("at") + F.col("len")).alias("to"))
    # Overlapping spans merge; a document has at most as many as it has words.
    before = Window.partitionBy("row").orderBy("from", "to").rowsBetween(Window.unboundedPreceding, -1)
    opened = spans.withColumn("reach", F.max("to").over(before)).withColumn("new", (F.col("reach").isNull() | (F.col("from") > F.col("reach"))).cast("int"))
    numbered = opened.withColumn("span", F.sum("new").over(Window.partitionBy("row").orderBy("from", "to").rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("row", "span").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    touched = merged.groupBy("row").agg(F.sum(F.col("to") - F.col("from")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans"))
    owners = listed.join(spoken, "ws").select(F.col("first").alias("phrase"), "item").distinct()
    named = hits.select("row", "phrase").distinct().join(bounded(owners), "phrase").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    lengths_of = index.postings.where("term = 0").select("row", "key", F.col("pos").cast("long").alias("n_words"))
    out = lengths_of.join(touched, "row", "left").join(named, "row", "left")
    return out.select(F.col("key").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<from:int,to:int>>")).alias("spans"))


def contamination_table(docs: DataFrame, tests: DataFrame, **options) -> DataFrame:
    """``op7``: the digest of ``contamination``."""
    found = contamination(docs, tests, **options)
    return found.select(options.get("key", "doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, tests: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The rows without any hit, all columns. Each row is judged by its own text, whatever its key."""
    rows = docs.select(text_id(F.col(text)).alias("_said"), F.col(text).alias("_text"))
    hit = alone(docs.sparkSession, lambda: contamination(rows, tests, key="_said", text="_text", **options).where("n_hit > 0").select("_said").distinct(), "contaminated")
    return docs.join(bounded(hit), text_id(docs[text]) == hit["_said"], "left_anti")


ORACLE = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, {WINDOW} AS n, array_to_string(ws[s:s + {WINDOW - 1}], ' ') AS k FROM (SELECT item, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS s FROM b WHERE len(ws) >= {WINDOW})
       UNION SELECT item, len(ws), array_to_string(ws, ' ') FROM b WHERE len(ws) BETWEEN 1 AND {WINDOW - 1}),
dw AS (SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
h AS (SELECT DISTINCT r, i, n, item FROM dw JOIN bw USING (n, k)),
p AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r),
q AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN q USING (r)
"""
