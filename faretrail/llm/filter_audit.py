"""Interaction of document filters: what each removes in every order they can be applied in."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faretrail.llm.common import Scratch

WORDS = r"[^\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a (non-null) text."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _one_label_row(labels: DataFrame) -> DataFrame:
    """(id, good, toxic), a row per id; of repeated rows any 1 counts, null is not 1."""
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        flag("quality").alias("good"), flag("toxic").alias("toxic"))


def mask_cells(docs: DataFrame, labels: DataFrame, scratch: Scratch,
               filters: Mapping[str, Column] | None = None, repeats: str = "E") -> DataFrame:
    """Documents counted by (part, mask): ``n``, ``good``, ``toxic``.

    ``part`` is the lang value (null: empty string), bit i of ``mask`` says that
    the i-th of ``filters`` fails, and the last bit (filter ``repeats``) that a
    smaller id has the identical text anywhere in the table.

    One pass over the texts gives rows of a few bytes (digest, bits, id). The
    repeats are found without joining them back: rows are counted by (digest,
    id) and then, combined before the shuffle, by digest alone with the
    smallest id and its number of rows, so a text that stands in a third of
    all rows is a few rows when its group is put together.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    checks = filters if filters is not None else text_filters(text)
    mask = F.lit(0)
    for i, failed in enumerate(checks.values()):
        mask = mask + F.when(failed, 1 << i).otherwise(0)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        mask.cast("int").alias("mask"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    kinds = ["digest", "part", "mask", "good", "toxic"]
    each = (
        rows.join(_one_label_row(labels), "id", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
        .groupBy(*kinds, "id").agg(F.count("*").alias("n"))
    )
    own = each.groupBy(*kinds).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("low"),
    )
    lowest = F.min("low.id").over(Window.partitionBy("digest"))  # a row per part and label of one text
    first = F.when(F.col("low.id") == lowest, F.col("low.n")).otherwise(0)
    split = own.withColumn("keeps", F.col("nameless") + first).select(
        "part", "mask", "good", "toxic",
        F.inline(F.array(
            F.struct(F.lit(0).alias("again"), F.col("keeps").alias("n")),
            F.struct(F.lit(1 << len(checks)).alias("again"), (F.col("n") - F.col("keeps")).alias("n")),
        )),
    ).where("n > 0")
    return scratch.keep(
        split.groupBy("part", (F.col("mask") + F.col("again")).alias("mask")).agg(
            F.sum("n").cast("long").alias("n"),
            F.sum(F.col("n") * F.col("good")).cast("long").alias("good"),
            F.sum(F.col("n") * F.col("toxic")).cast("long").alias("toxic"),
        )
    )


#: Prefixes of filter orders, level by level: the anchor is the empty prefix
#: with every mask that occurs, each level adds one letter not used so far and
#: carries the bits applied before and with it. 326 prefixes of five letters
#: times at most 32 masks, whatever the size of the corpus.
ENUMERATION = """
WITH RECURSIVE steps(prefix, step, letter, bit, before, applied, mask) AS (
  SELECT '', 0, '', 0, 0, 0, mask FROM {masks}
  UNION ALL
  SELECT concat(prefix, l.letter), step + 1, l.letter, l.bit, applied, applied | l.bit, mask
  FROM steps LATERAL VIEW inline(filter({letters}, x -> x.bit & applied = 0)) l AS letter, bit
)
SELECT prefix, step, letter, mask,
       CAST(mask & applied = 0 AS INT) AS is_kept,
       CAST(mask & bit <> 0 AND mask & before = 0 AS INT) AS is_removed,
       CAST(mask & bit <> 0 AND mask & before <> 0 AS INT) AS is_redundant,
       CAST(mask = bit AS INT) AS is_unique
FROM steps WHERE step > 0
"""


def order_steps(cells: DataFrame, letters: str, scratch: Scratch) -> DataFrame:
    """A row per prefix of a filter order and mask of ``cells`` (``ENUMERATION``)."""
    table = ", ".join(f"struct('{c}' AS letter, {1 << i} AS bit)" for i, c in enumerate(letters))
    masks = scratch.keep(cells.select("mask").distinct())
    sql = ENUMERATION.replace("{letters}", f"array({table})")
    return scratch.keep(cells.sparkSession.sql(sql, masks=masks))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What five filters remove in each of their 120 orders, by part.

    Returns per ``part`` (lang, null: empty string), ``filter_order`` and
    ``step`` the document counts ``kept`` (after the step), ``removed`` (at the
    step), ``redundant`` (fails this filter, removed earlier), ``unique_fails``
    (fails this filter alone), ``good_lost`` and ``toxic_lost`` (removed here
    with label quality or toxic 1) and ``shapley`` (this filter's removals
    summed over all orders).

    A null text is empty and a null lang the part ''. A null id is never a
    smaller id, nor has it one, and has no label. Repeated rows count as
    documents of their own; rows with the same id and text are not each
    other's repeats. A label with a null or another value counts as not 1; of
    repeated label rows any 1 counts. Very long texts are judged whole. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    letters = "ABCDE"
    scratch = Scratch(spark, "filter-audit")
    cells = mask_cells(docs, labels, scratch)
    steps = order_steps(cells, letters, scratch)
    at_step = steps.join(cells, "mask").groupBy("part", "prefix", "step", "letter").agg(
        *[F.sum(F.col("n") * F.col(f"is_{c}")).alias(a)
          for c, a in (("kept", "kept"), ("removed", "removed"), ("redundant", "redundant"), ("unique", "unique_fails"))],
        F.sum(F.col("good") * F.col("is_removed")).alias("good_lost"),
        F.sum(F.col("toxic") * F.col("is_removed")).alias("toxic_lost"),
    )
    orders = steps.where(F.col("step") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct().select(
        "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("at"))
    placed = orders.withColumn("prefix", F.expr("substring(filter_order, 1, at)")).join(at_step, "prefix")
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))  # 120 rows a group
    return scratch.result(placed.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
        shapley.alias("shapley")))


SQL = r"""
WITH lab AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), t AS (
  SELECT d.doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents d
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS low FROM t
), f AS (
  SELECT part, doc_id,
    len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > low, false) AS e FROM w
), g AS (
  SELECT part, [a, b, c, d, e] AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
  FROM f LEFT JOIN lab USING (doc_id) GROUP BY ALL
), l AS (SELECT unnest([1, 2, 3, 4, 5]) AS i), o AS (
  SELECT [l1.i, l2.i, l3.i, l4.i, l5.i] AS seq FROM l l1 JOIN l l2 ON l2.i <> l1.i JOIN l l3 ON l3.i NOT IN (l1.i, l2.i)
  JOIN l l4 ON l4.i NOT IN (l1.i, l2.i, l3.i) JOIN l l5 ON l5.i NOT IN (l1.i, l2.i, l3.i, l4.i)
), s AS (
  SELECT seq, array_to_string(list_transform(seq, lambda x: 'ABCDE'[x]), '') AS filter_order, l.i AS step FROM o, l
), r AS (
  SELECT g.part, s.filter_order, s.step, 'ABCDE'[seq[step]] AS letter, g.n, g.good, g.toxic,
    fails[seq[step]] AS here, len(list_filter(seq[1:step - 1], lambda x: fails[x])) > 0 AS gone,
    len(list_filter(fails, lambda x: x)) = 1 AS once
  FROM g, s
), m AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN NOT here AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN here AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN here AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN here AND once THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN here AND NOT gone THEN n * good ELSE 0 END) AS good_lost,
    sum(CASE WHEN here AND NOT gone THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM m
"""
