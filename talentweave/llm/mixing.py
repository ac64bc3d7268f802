"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target of words. A document's expected copies fall with its size (`rate_weight`), so that long texts are
repeated less: they are the least of MOST_COPIES and c times its weight, c being such that the source's expected words are its
target. The whole part of that number is certain and the fraction is the inclusion probability p of one more copy. The
additional copies are a Pareto sample of unequal probabilities: documents are ranked by the odds of a uniform number u(id)
over the odds of p and taken in that order. The size of the sample is fixed in words: it ends where the words left of the
target are used up; the document at the border is taken if that comes nearer to the target. u depends on the id alone, so
reruns agree.

Cumulative words in rank order need no sort of a whole source: ranks are cut into CELLS ranges of the quotient, the sums of
the ranges are aggregated, and only the range in which the target falls is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Ranges of ranks of a source; one of them holds about 1 / CELLS of its documents.
CELLS = 4096
_GROUPS = 64
_SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(key: Column, seed: str = _SEED) -> Column:
    """A number between 0 and 1, both excluded, that depends on the key and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def rate_weight(size: Column) -> Column:
    """Weight of a document's expected copies: 15 for one word, less by 1 for each doubling, 4 from 2,048 words on."""
    return (16 - F.least(F.lit(12), F.length(F.bin(size)))).cast("long")


def quotient(u: Column, p: Column) -> Column:
    """Odds of u over odds of p; null where p is 0, as nothing more is taken there."""
    return F.when(p > 0, (u * (1 - p)) / ((1 - u) * p))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row for each source.

    Sources in order of code points, null last, have the weights in turn and share the sum of all sizes; no target exceeds
    `most` times its source's size, and the excess goes to the others by weight. The common share t of a unit of weight
    then solves sum(min(t * weight, most * size)) = total; sources ordered by the t that fills them give it directly.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place).cast("long")).withColumn("cap", F.col("source_size") * most)
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    rest = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    # the share if all sources before this one are full and the others are not
    share = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    filled = weighed.withColumn("share", share).withColumn("open", F.col("cap") >= F.col("share") * F.col("weight"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("share")))).over(everything)["share"]
    return filled.select("source", "source_size", F.least(F.coalesce(level * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double")).alias("target"))


def rates(groups: DataFrame, aims: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """(source, weight, whole, p, left, source_size, target) from the words of each (source, weight) and the targets.

    `left` are the words of the source's target that are left after all whole copies. The rate c of a unit of weight solves
    sum(words * min(most, c * weight)) = target; groups in falling order of weight are full first.
    """
    by_fill = Window.partitionBy("source").orderBy(F.col("weight").desc())
    before = F.coalesce(F.sum("words").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * most
    rest = F.sum(F.col("words") * F.col("weight")).over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    both = groups.alias("g").join(aims.alias("t"), F.col("g.source").eqNullSafe(F.col("t.source"))).select("g.*", "t.source_size", "t.target")
    rows = both.where("words > 0").withColumn("c", (F.col("target") - before) / rest)
    of_source = Window.partitionBy("source")
    level = F.max(F.when(F.col("c") * F.col("weight") <= most, F.struct("weight", "c"))).over(of_source)["c"]
    rows = rows.withColumn("expected", F.least(F.coalesce(level * F.col("weight"), F.lit(float(most))), F.lit(float(most))))
    rows = rows.withColumn("whole", F.floor("expected")).withColumn("p", F.col("expected") - F.col("whole"))
    left = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(of_source)
    return rows.select("source", "weight", "whole", "p", left.alias("left"), "source_size", "target")


def mix(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = _SEED) -> DataFrame:
    """(id, source, size, source_size, target, copies, p, quotient) for every row.

    A null text has size 0; a null source is a source of its own, the last one. A row of size 0 has no copies. Repeated
    rows share their number and follow each other in rank, so the border may fall between them. An empty table gives an
    empty one; other columns are not read.
    """
    sized = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"))
    sized = scratch.save(sized.withColumn("weight", rate_weight(F.col("size"))).withColumn("u", uniform(F.col("id"), seed)), "sized")
    groups = scratch.save(sized.groupBy("source", "weight").agg(F.sum("size").alias("words")), "groups")
    aims = scratch.save(targets(groups.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most), "targets")
    found = scratch.save(rates(groups, aims, most), "rates")
    rows = sized.where("size > 0").alias("d").join(found.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.weight") == F.col("r.weight")))
    rows = rows.select("d.id", "d.source", "d.size", "r.whole", "r.p", "r.left", "r.source_size", "r.target", quotient(F.col("d.u"), F.col("r.p")).alias("quotient"))
    rows = rows.withColumn("cell", F.floor(F.col("quotient") / (1 + F.col("quotient")) * CELLS).cast("int"))

    cells = rows.where("cell is not null").groupBy("source", "cell").agg(F.sum("size").alias("words")).withColumn("part", F.floor(F.col("cell") / (CELLS // _GROUPS)))
    inner = Window.partitionBy("source", "part").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    parts = cells.groupBy("source", "part").agg(F.sum("words").alias("part_words"))
    outer = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("part_before", F.coalesce(F.sum("part_words").over(outer), F.lit(0))).drop("part_words")
    begins = (
        cells.withColumn("within", F.coalesce(F.sum("words").over(inner), F.lit(0)))
        .alias("c")
        .join(parts.alias("p"), F.col("c.source").eqNullSafe(F.col("p.source")) & (F.col("c.part") == F.col("p.part")))
        .select("c.source", "c.cell", "c.words", (F.col("p.part_before") + F.col("c.within")).alias("before"))
    )
    left = found.groupBy("source").agg(F.first("left").alias("left"))
    border = (
        begins.alias("b")
        .join(left.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
        .groupBy("b.source", "t.left")
        .agg(F.min(F.when(F.col("b.before") + F.col("b.words") > F.col("t.left"), F.struct("b.cell", "b.before"))).alias("at"))
        .select("source", F.coalesce(F.col("at.cell"), F.lit(CELLS + 1)).alias("border"), F.col("at.before").alias("border_before"))
    )
    border = scratch.save(border, "borders")
    rows = rows.alias("d").join(border.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")), "left").select("d.*", "b.border", "b.border_before")
    order = Window.partitionBy("source").orderBy("quotient", "id", "size")
    so_far = F.col("border_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at_border = F.coalesce(F.col("cell") == F.col("border"), F.lit(False))
    near = rows.where(at_border).withColumn("more", (so_far - F.col("size") / 2 <= F.col("left")).cast("int"))
    rest = rows.where(~at_border).withColumn("more", F.coalesce((F.col("cell") < F.col("border")).cast("int"), F.lit(0)))
    taken = near.unionByName(rest).select("id", "source", "size", "source_size", "target", (F.col("whole") + F.col("more")).cast("int").alias("copies"), "p", "quotient")
    empty = sized.where("size = 0").alias("d").join(aims.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    none = lambda c: F.lit(None).cast("double").alias(c)
    return taken.unionByName(empty.select("d.id", "d.source", "d.size", "t.source_size", "t.target", F.lit(0).alias("copies"), none("p"), none("quotient")))


def copies_of(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of `docs`, all columns, each as often as the mix takes it.

    Copies are counted for each (id, source, size); rows that share these share the copies evenly, the first ones by text
    having one more. The columns of `docs` travel as one struct, so no name can clash.
    """
    mixed = mix(docs, scratch, id_col, text_col, source_col)
    counted = mixed.groupBy("id", "source", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    counted = scratch.save(counted.where("copies > 0"), "copies")
    rows = docs.select(F.struct("*").alias("row"), docs[id_col].alias("row_id"), docs[source_col].alias("row_source"), word_count(docs[text_col]).alias("words"))
    same = rows["row_id"].eqNullSafe(counted["id"]) & rows["row_source"].eqNullSafe(counted["source"]) & (rows["words"] == counted["size"])
    rows = rows.join(counted.hint("merge"), same)  # it grows with the corpus, so it is never broadcast
    if counted.where("rows > 1").head(1):
        place = F.row_number().over(Window.partitionBy("id", "source", "size").orderBy(F.col("row")[text_col])) - 1
        share = F.floor(F.col("copies") / F.col("rows")) + (place < F.col("copies") % F.col("rows")).cast("int")
        rows = rows.withColumn("copies", share).where("copies > 0")
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(281474976710656 AS DOUBLE) AS u
  FROM documents),
weighted AS (SELECT *, CAST(16 - least(12, length(bin(size))) AS BIGINT) AS weight FROM sized),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, source_size * 3 AS cap,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS INT)] AS share_weight
  FROM sources),
shares AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(CAST(sum(cap) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
            / CAST(sum(share_weight) OVER (fill ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS share
  FROM weighed WINDOW fill AS (ORDER BY cap / share_weight, source IS NULL, encode(source))),
level AS (SELECT arg_min(share, cap / share_weight) AS share FROM shares WHERE cap >= share * share_weight),
targets AS (
  SELECT s.source, s.source_size, least(coalesce(l.share * s.share_weight, CAST(s.cap AS DOUBLE)), CAST(s.cap AS DOUBLE)) AS target
  FROM shares s CROSS JOIN level l),
groups AS (SELECT source, weight, CAST(sum(size) AS BIGINT) AS words FROM weighted WHERE size > 0 GROUP BY source, weight),
filling AS (
  SELECT g.*, t.target, (t.target - CAST(coalesce(sum(g.words) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3 AS DOUBLE))
         / CAST(sum(g.words * g.weight) OVER (fill ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS c
  FROM groups g JOIN targets t ON g.source IS NOT DISTINCT FROM t.source
  WINDOW fill AS (PARTITION BY g.source ORDER BY g.weight DESC)),
levels AS (SELECT source, arg_max(c, weight) AS c FROM filling WHERE c * weight <= 3 GROUP BY source),
expected AS (
  SELECT f.source, f.weight, f.words, f.target, least(coalesce(l.c * f.weight, CAST(3 AS DOUBLE)), CAST(3 AS DOUBLE)) AS expected
  FROM filling f LEFT JOIN levels l ON f.source IS NOT DISTINCT FROM l.source),
rates AS (
  SELECT source, weight, floor(expected) AS whole, expected - floor(expected) AS p,
         target - CAST(sum(CAST(floor(expected) AS BIGINT) * words) OVER (PARTITION BY source) AS DOUBLE) AS left_words
  FROM expected),
ranked AS (
  SELECT d.doc_id, d.source, d.size, r.whole, r.p, r.left_words, CASE WHEN r.p > 0 THEN (d.u * (1 - r.p)) / ((1 - d.u) * r.p) END AS quotient
  FROM weighted d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source AND d.weight = r.weight WHERE d.size > 0),
running AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY quotient NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS so_far FROM ranked),
taken AS (
  SELECT doc_id, source, size, CAST(size * (whole + CASE WHEN quotient IS NOT NULL AND so_far - size / 2 <= left_words THEN 1 ELSE 0 END) AS BIGINT) AS taken, p, quotient FROM running
  UNION ALL SELECT doc_id, source, size, 0, NULL, NULL FROM weighted WHERE size = 0)
SELECT x.doc_id, x.size, t.source_size, t.target, x.taken, x.p AS inclusion, x.quotient AS pareto_quotient
FROM taken x JOIN targets t ON x.source IS NOT DISTINCT FROM t.source
"""
