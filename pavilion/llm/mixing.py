"""Mix sources to target weights: whole copies plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a word is.
WORD = r"[^\x20\x09-\x0D]+"
#: Rates of at most so many sources are broadcast; beyond it the join shuffles.
BROADCAST_SOURCES = 100_000


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words; 0 for a NULL text) and ``draw``, a uniform number in [0, 1) fixed by id and text."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), draw().alias("draw"))


def draw(seed: str = "mix") -> Column:
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source: source_size, target and rate = target / source_size.

    Sources by code point, NULL last, take ``weights`` in turn and divide ``share`` of all words; no target is above
    ``most`` times its source, and what is cut goes to the others by weight.  Capping in order of cap / weight, the
    common level is the largest of (total - caps so far) / (weights left).  A source without words gets 0.  The
    windows without partitions see one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(named) - 1) % len(weights)
    rows = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * most)
    everything, before = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level).withColumn("target", F.least("cap", F.col("weight") * F.max("level").over(everything)))
    return rows.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))


def rated(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """``rows`` with their source's columns; every row stays."""
    per = rates.withColumnRenamed("source", "__source")
    if rates.count() <= BROADCAST_SOURCES:
        per = F.broadcast(per)
    return rows.join(per, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")


def copies() -> Column:
    """floor(rate) copies, and one more with probability equal to the fraction."""
    whole = F.floor("rate")
    return (whole + (F.col("draw") < F.col("rate") - whole).cast("long")).cast("long")


def plan(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies, taken for every document.

    A row repeated with the same id and text is decided alike; NULL ids count as an empty id; a document without
    words may be emitted and takes 0 words; an empty table gives an empty result.
    """
    from .common import kept

    sizes = kept(sized(docs))
    return rated(sizes, kept(targets(sizes, **how))).select(
        "doc_id", "size", "source_size", "target", "rate", copies().alias("copies"), (copies() * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: every document as often as its copies say, with its own columns.

    The caller's columns come back as they are, whatever their names.  Rows that repeat an id and a text are decided alike, each for
    itself; a NULL id or text draws as an empty one; a NULL source is a source; a document without words is emitted
    at its source's rate and adds nothing; an empty table gives an empty result.
    """
    from .common import kept

    rates = kept(targets(kept(sized(docs).select("source", "size")), **how)).select("source", "rate")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "source", draw().alias("draw"))
    rows = rated(own, rates).where(copies() > 0)
    return rows.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(copies(), F.lit(1)))).alias("__copy")).select("__row.*")


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS turn FROM sized GROUP BY source),
capped AS (SELECT source, source_size, source_size * 2.0::DOUBLE AS cap, CASE turn % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM capped WINDOW before AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM levels),
rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || coalesce(d.text, '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS draw
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, rate, copies, copies * size AS taken
FROM (SELECT *, CAST(floor(rate) AS BIGINT) + CAST(draw < rate - floor(rate) AS BIGINT) AS copies FROM rated)
"""
