"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

A source's target is its weight's part of the mix, up to a number of copies of the source. Within a source long documents are expected
in fewer copies than short ones. Whole expected copies are certain; what is left of a document's expectation is the chance of one copy more.
Documents are ranked by the odds of a random number divided by the odds of that chance, and taken from the smallest on
until the target's words are used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import bounded, discard, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order of their names, over and over; words of the mix a word of all documents; most copies of a source and a document.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Expected copies halve whenever the length doubles so many times.
HALVING = 2
#: Cells that the ranks of a source are counted in before rows of one of them are ordered.
CELLS = 1 << 16
#: Times that ranks are gone through: once for the sample, then for documents short enough for what is left of the target.
ROUNDS = 3
_BITS = 52


def _drawn(key: Column, text: Column) -> Column:
    """A number over 0 and under 1 that follows from a document's key and text alone."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return (F.conv(F.left(digest, F.lit(_BITS // 4)), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << _BITS))


def measured(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", halving: int | None = HALVING) -> DataFrame:
    """_key, _source, _size (words), _u (the draw), _step (length class), and _doc, the row itself."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), size.alias("_size"), _drawn(F.col(key), F.col(text)).alias("_u"), F.struct(*docs.columns).alias("_doc"))
    step = F.floor((F.length(F.bin("_size")) - 1) / halving).cast("int") if halving else F.lit(0)
    return rows.withColumn("_step", step)


def _level(total: Column, cap: str, weight: str, by: list[str], order: list) -> tuple[Column, Column]:
    """Whether a row's part is its ``cap``, and the height that the others' weights are multiplied by: parts add up to ``total``.

    ``order`` goes by cap over weight. A row is full if what the rows before it leave, shared by weight among it and those after, is at least its cap.
    """
    own = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    behind, ahead = own.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1), own.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = F.col(cap) * F.sum(weight).over(ahead) <= (total - F.coalesce(F.sum(cap).over(behind), F.lit(0))) * F.col(weight)
    return full, own


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """_source, _words, _target of _source, _words: a row a source, which is as long as the list of sources that a mix is made of."""
    everything = Window.partitionBy(F.lit(0))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    named = sizes.withColumn("_n", F.row_number().over(everything.orderBy(F.asc_nulls_last("_source"))) - 1).withColumn("_weight", F.get(cycle, F.col("_n") % len(weights)))
    capped = named.withColumn("_cap", F.col("_words") * F.lit(float(most))).withColumn("_total", F.sum("_words").over(everything) * F.lit(float(share)))
    full, own = _level(F.col("_total"), "_cap", "_weight", [], [F.col("_cap") / F.col("_weight"), F.col("_n")])
    judged = capped.withColumn("_full", full)
    left = F.col("_total") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(own), F.lit(0.0))
    return judged.select("_source", "_words", F.when(F.col("_full"), F.col("_cap")).otherwise(left * F.col("_weight") / F.sum(F.when(~F.col("_full"), F.col("_weight"))).over(own)).alias("_target"))


def rates(lengths: DataFrame, most: float = MOST) -> DataFrame:
    """``lengths`` (_source, _step, _words, _target) with _whole, the certain copies of the class's documents, _part, the chance of one more, and _rest, the words of the target that chances share."""
    weighed = lengths.withColumn("_w", F.col("_words") * (F.lit(1.0) / F.expr("shiftleft(1L, _step)"))).withColumn("_cap", F.col("_words") * F.lit(float(most)))
    full, own = _level(F.col("_target"), "_cap", "_w", ["_source"], [F.col("_step")])
    judged = weighed.withColumn("_full", full)
    height = (F.col("_target") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(own), F.lit(0.0))) / F.sum(F.when(~F.col("_full"), F.col("_w"))).over(own)
    rate = F.when(F.col("_full"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), height / F.expr("shiftleft(1L, _step)")))
    rated = judged.withColumn("_rate", rate).withColumn("_whole", F.floor("_rate")).withColumn("_part", F.col("_rate") - F.col("_whole"))
    return rated.withColumn("_rest", F.col("_target") - F.sum(F.col("_whole") * F.col("_words")).over(own)).drop("_w", "_cap", "_full", "_rate")


def _met(rows: DataFrame, side: DataFrame, *keys: str) -> DataFrame:
    """Each row with the side's row of the same keys, of which null is one."""
    named = side.select(*(F.col(k).alias(f"{k}_") for k in keys), *(c for c in side.columns if c not in keys))
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"{k}_"))
    return rows.join(bounded(named), on, "left").drop(*(f"{k}_" for k in keys))


def _rank() -> Column:
    """Cell, quotient of odds, draw. Documents alike in key and text have one rank."""
    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_part") / (1 - F.col("_part")))
    return F.when((F.col("_size") > 0) & (F.col("_part") > 0), F.struct(F.floor(odds / (1 + odds) * CELLS).cast("int").alias("cell"), odds.alias("q"), F.col("_u").alias("u")))


def _prefix(rows: DataFrame, left: str) -> DataFrame:
    """_source, edge (the last rank that fits; null if all do), used (their words): ranks from the smallest on while ``left`` holds their words.

    Words are summed a cell, then for the distinct ranks of the one cell in which ``left`` is used up.
    """
    cells = rows.groupBy("_source", F.col("_rank.cell").alias("_cell"), left).agg(F.sum("_size").alias("_n"))
    summed = cells.withColumn("_sum", F.sum("_n").over(Window.partitionBy("_source").orderBy("_cell")))
    fits = F.col("_sum") <= F.col(left)
    border = summed.groupBy("_source", left).agg(F.min(F.when(~fits, F.col("_cell"))).alias("_border"), F.coalesce(F.max(F.when(fits, F.col("_sum"))), F.lit(0)).alias("_before"))
    border = stored(border, "mix-borders")
    inside = _met(rows.drop(left), border, "_source").where(F.col("_rank.cell") == F.col("_border")).groupBy("_source", "_rank", left, "_before").agg(F.sum("_size").alias("_n"))
    near = inside.withColumn("_sum", F.col("_before") + F.sum("_n").over(Window.partitionBy("_source").orderBy("_rank")))
    last = near.where(F.col("_sum") <= F.col(left)).groupBy("_source").agg(F.max("_rank").alias("_last"), F.max("_sum").alias("_used"))
    none = F.struct(F.col("_border").alias("cell"), F.lit(-1.0).alias("q"), F.lit(-1.0).alias("u"))
    return _met(border, stored(last, "mix-edges"), "_source").select("_source", F.when(F.col("_border").isNotNull(), F.coalesce("_last", none)).alias("edge"), F.coalesce("_used", "_before").alias("used"))


def _chosen(round_: int) -> Column:
    """Whether a row with a rank is taken in the rounds up to ``round_``; the others' columns are null."""
    taken = F.lit(False)
    for k in range(round_ + 1):
        short = F.lit(True) if k == 0 else F.col("_size") <= F.col(f"_left{k}")
        taken = taken | (short & F.coalesce(F.col(f"_edge{k}").isNull() | (F.col("_rank") <= F.col(f"_edge{k}")), F.lit(True)))
    return taken & F.col("_rank").isNotNull()


def plan(rows: DataFrame, *, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """A row a source and length class of ``rows`` (``measured``): all that decides how many copies of a document are taken."""
    lengths = stored(rows.groupBy("_source", "_step").agg(F.sum("_size").alias("_words")), "mix-lengths")
    sources = stored(targets(lengths.groupBy("_source").agg(F.sum("_words").alias("_words")), weights, share, most).withColumnRenamed("_words", "_source_size"), "mix-sources")
    classes = stored(rates(_met(lengths.where("_words > 0"), sources, "_source"), most), "mix-rates")
    ranked = _met(rows.select("_source", "_step", "_size", "_u"), classes.select("_source", "_step", "_part"), "_source", "_step").withColumn("_rank", _rank()).where("_rank is not null")
    state = classes.groupBy("_source").agg(F.first("_rest").alias("_left0"))
    for k in range(ROUNDS):
        state = stored(state, "mix-state")
        own = _met(ranked, state, "_source")
        if k:
            own = own.where(~_chosen(k - 1) & (F.col("_size") <= F.col(f"_left{k}")))
        found = _prefix(own.select("_source", "_size", "_rank", f"_left{k}"), f"_left{k}")
        state = _met(state, stored(found, "mix-round"), "_source").withColumn(f"_left{k + 1}", F.col(f"_left{k}") - F.coalesce("used", F.lit(0))).withColumnRenamed("edge", f"_edge{k}").drop("used")
    state = stored(state, "mix-state")
    # One copy more, of the shortest document left, if that comes nearer to the target.
    nearer = _met(ranked, state, "_source").where(~_chosen(ROUNDS - 1) & (F.col("_size") < 2 * F.col(f"_left{ROUNDS}"))).groupBy("_source").agg(F.min(F.struct("_size", "_rank")).alias("_more"))
    whole = _met(_met(state, stored(nearer, "mix-more"), "_source"), sources, "_source")
    full = _met(sources, whole.drop("_source_size", "_target"), "_source")
    return stored(_met(lengths.drop("_words"), full, "_source").join(classes.select(F.col("_source").alias("_s"), F.col("_step").alias("_t"), "_whole", "_part"), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_step") == F.col("_t")), "left").drop("_s", "_t"), "mix-plan")


def with_copies(rows: DataFrame, plan_: DataFrame) -> DataFrame:
    """``rows`` (``measured``) with _source_size, _target and _copies."""
    met = _met(rows, plan_, "_source", "_step").withColumn("_rank", _rank())
    more = _chosen(ROUNDS - 1) | (F.coalesce(F.struct("_size", "_rank") == F.col("_more"), F.lit(False)) & F.col("_rank").isNotNull())
    copies = F.coalesce("_whole", F.lit(0)) + F.coalesce(more, F.lit(False)).cast("long")
    return met.withColumn("_copies", F.when(F.col("_size") > 0, copies).otherwise(0).cast("int"))


def mixed(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken.

    Null texts and texts without words are never taken. Null is a source of its own, the last. Rows alike in key, text and source share one
    fate. A null key is a key. Without words nothing is taken. Columns of ``docs`` keep their names, whatever they are.
    """
    own = measured(docs, key=key, text=text, source=source)
    thin = stored(own.drop("_doc", "_key"), "mix-sizes")
    taken = with_copies(own, plan(thin, weights=weights, share=share, most=most)).where("_copies > 0")
    return taken.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_k")).select("_doc.*")


def mix_table(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The key, size, source_size, target, taken, copies of every row of ``docs``; the cases are those of ``mixed``."""
    own = stored(measured(docs, key=key, text=text, source=source).drop("_doc"), "mix-sizes")
    made = with_copies(own, plan(own.drop("_key"), weights=weights, share=share, most=most))
    return made.select(F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies"))


def _round_sql(k: int) -> str:
    """CTE t{k}: rows left before round k that are short enough, with the words up to their rank; CTE r{k}: all rows with what round k takes."""
    return f"""
t{k} AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY cell, q, u) AS run FROM r{k} WHERE q IS NOT NULL AND NOT got AND size <= {'rest' if k else '1e300'}),
x{k} AS (SELECT id FROM t{k} WHERE run <= rest),
r{k + 1} AS (SELECT r.* EXCLUDE (got, rest), r.got OR x.id IS NOT NULL AS got, r.rest - coalesce(sum(CASE WHEN x.id IS NOT NULL THEN r.size END) OVER (PARTITION BY r.source), 0) AS rest FROM r{k} r LEFT JOIN x{k} x USING (id))"""


ORACLE = (
    r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  (CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
l AS (SELECT *, CASE WHEN size > 0 THEN (length(bin(size)) - 1) // 2 ELSE 0 END AS step FROM d),
s0 AS (SELECT source, CAST(sum(size) AS DOUBLE) AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM l GROUP BY source),
s1 AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][n % 3 + 1] AS w, 2 * words AS cap, 1.5::DOUBLE * sum(words) OVER () AS total FROM s0),
s2 AS (SELECT *, cap * sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= (total - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS isfull FROM s1),
s AS (SELECT source, words, CASE WHEN isfull THEN cap ELSE (total - coalesce(sum(CASE WHEN isfull THEN cap END) OVER (), 0)) * w / sum(CASE WHEN NOT isfull THEN w END) OVER () END AS target FROM s2),
c0 AS (SELECT l.source, step, CAST(sum(size) AS DOUBLE) AS words, any_value(target) AS target FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source GROUP BY l.source, step HAVING sum(size) > 0),
c1 AS (SELECT *, words * (1.0::DOUBLE / (1::BIGINT << step)) AS w, 2 * words AS cap FROM c0),
c2 AS (SELECT *, cap * sum(w) OVER (PARTITION BY source ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= (target - coalesce(sum(cap) OVER (PARTITION BY source ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS isfull FROM c1),
c3 AS (SELECT *, CASE WHEN isfull THEN 2.0::DOUBLE ELSE least(2.0::DOUBLE, (target - coalesce(sum(CASE WHEN isfull THEN cap END) OVER (PARTITION BY source), 0)) / sum(CASE WHEN NOT isfull THEN w END) OVER (PARTITION BY source) / (1::BIGINT << step)) END AS rate FROM c2),
c AS (SELECT source, step, floor(rate) AS whole, rate - floor(rate) AS part, target - sum(floor(rate) * words) OVER (PARTITION BY source) AS rest FROM c3),
o AS (SELECT l.*, coalesce(c.whole, 0) AS whole, c.rest, CASE WHEN size > 0 AND part > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS q FROM l LEFT JOIN c ON c.source IS NOT DISTINCT FROM l.source AND c.step = l.step),
r0 AS (SELECT *, CAST(floor(q / (1 + q) * 65536) AS INT) AS cell, false AS got FROM o),"""
    + ",".join(_round_sql(k) for k in range(ROUNDS))
    + f""",
m AS (SELECT source, min({{'size': size, 'cell': cell, 'q': q, 'u': u}}) AS least FROM r{ROUNDS} WHERE q IS NOT NULL AND NOT got AND size < 2 * rest GROUP BY source)
SELECT r.doc_id, r.size, CAST(s.words AS BIGINT) AS source_size, s.target, CAST(r.size * copies AS BIGINT) AS taken, CAST(copies AS INT) AS copies
FROM (SELECT r.*, CASE WHEN r.size > 0 THEN r.whole + CASE WHEN r.got OR coalesce(r.q IS NOT NULL AND {{'size': r.size, 'cell': r.cell, 'q': r.q, 'u': r.u}} = m.least, false) THEN 1 ELSE 0 END ELSE 0 END AS copies FROM r{ROUNDS} r LEFT JOIN m ON m.source IS NOT DISTINCT FROM r.source) r
JOIN s ON s.source IS NOT DISTINCT FROM r.source"""
)
