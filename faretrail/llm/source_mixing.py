"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faretrail.llm.common import Scratch, small

#: Words: runs of characters other than space and \t \n \v \f \r.
WORDS = r"[^\x20\x09-\x0D]+"
#: Rows that a slot of the ranking variable should hold; a source is ranked row by row only in the slot of its cut.
SLOT_ROWS = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], max_copies: int) -> DataFrame:
    """Per source: ``source_size``, ``target``.

    The sources, ordered by code point with null last, carry ``weights`` in
    turn and share the sum of all sizes; a target stops at ``max_copies``
    times its source's size and the excess is shared again by weight. The
    fixed point is found in one pass: sources reach their limit in the order
    of limit / weight, so the common level is the first one that the next
    source in that order does not reach. The window runs over one row per
    source, not over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy("ratio", "rank")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = F.array(*[F.lit(int(x)) for x in weights])
    s = (
        sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
        .withColumn("rank", F.row_number().over(order))
        .withColumn("w", w[(F.col("rank") - 1) % len(weights)].cast("long"))
        .withColumn("cap", F.col("source_size") * max_copies)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
        .withColumn("rest", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("level", F.col("rest").cast("double") / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))))
        .withColumn("stop", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(every)["level"])
    )
    target = F.least(F.col("cap").cast("double"), F.coalesce("stop", F.lit(0.0)) * F.col("w"))
    return s.select("source", "source_size", target.alias("target"))


def _uniform(seed: int) -> Column:
    """In (0, 1), from the id alone (without an id from the text), so reruns agree."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col("text_md5")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def expected_copies(rows: DataFrame, targets: DataFrame, sources: int, max_copies: int) -> DataFrame:
    """Add to rows of (source, size) the copies ``e`` that a document is
    expected to have: the root of its size times one factor per source, at
    most ``max_copies``, so that the expected words are the source's target.

    The factor follows from the sums over sizes: from the longest size down,
    the first one that its own factor does not lift above ``max_copies`` ends
    the capped ones. Sums are of whole numbers, so every run gets the same
    factor. The window runs over the distinct sizes of a source, not over its
    documents.
    """
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    exact = lambda c: F.coalesce(c, F.lit(0).cast("decimal(38,0)")).cast("double")
    sizes = (
        rows.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("k"))
        .withColumn("root", F.floor(F.sqrt(F.col("size").cast("double"))).cast("long"))
        .withColumn("w", (F.col("size") * F.col("k")).cast("decimal(38,0)"))
        .withColumn("v", F.col("w") * F.col("root").cast("decimal(20,0)"))
        .withColumn("v", F.col("v").cast("decimal(38,0)"))
        .withColumn("capped", exact(F.sum("w").over(down.rowsBetween(Window.unboundedPreceding, -1))))
        .withColumn("rest", exact(F.sum("v").over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))))
    )
    t = targets.select(F.col("source").alias("s"), "target")
    factor = (
        sizes.join(small(t, sources), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("f", (F.col("target") - F.lit(float(max_copies)) * F.col("capped")) / F.col("rest"))
        .where(F.col("f") * F.col("root") <= max_copies)
        .groupBy("s").agg(F.max(F.struct("size", "f")).alias("top"))
        .select("s", F.col("top.f").alias("f"))
    )
    root = F.floor(F.sqrt(F.col("size").cast("double"))).cast("double")
    e = F.least(F.lit(float(max_copies)), F.coalesce("f", F.lit(1e300)) * root)
    return rows.join(small(factor, sources), F.col("source").eqNullSafe(F.col("s")), "left").withColumn(
        "e", F.when(F.col("size") > 0, e).otherwise(0.0)).drop("s", "f")


def mix_sizes(rows: DataFrame, targets: DataFrame, sources: int, scratch: Scratch, max_copies: int = 3, seed: int = 7) -> DataFrame:
    """Add ``copies`` to rows of (rid, doc_id, source, size, text_md5).

    The whole part of a document's expected copies is allocated for certain,
    the fraction is its inclusion probability for one more. All documents are
    ranked by Pareto's variable, the odds of a uniform number over the
    inclusion odds. Each source goes through its documents in that order and
    takes every one that fits into the words it still needs; one that does not
    fit is passed over. A source that still needs words when all have had their
    turn (a few documents too long to fit were expected to fill it) goes
    through them again, up to ``max_copies``. At last the document nearest to
    the gap left is taken if that brings the source nearer to its target, so
    the miss is at most half the size of the smallest document that could be
    taken once more.

    A round takes the documents before the first that does not fit: the sums
    of the slots of the variable tell the slot of that document, and only its
    rows are ranked one by one. What is left then needs less than that
    document's size, which the next round starts from. Tables of one row per
    source are broadcast if their counted number (``sources``) is small, so a
    hot source's documents stay where they are.
    """
    p = F.col("e") - F.col("whole")
    odds = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    slots = max(4096, rows.count() // SLOT_ROWS)
    planned = scratch.keep(
        expected_copies(rows, targets, sources, max_copies)
        .withColumn("whole", F.floor("e").cast("long"))
        .withColumn("u", _uniform(seed))
        .withColumn("z", F.when((F.col("size") > 0) & (F.col("whole") < max_copies), F.when(p > 0, odds / (1 + odds)).otherwise(1.0)))
        .withColumn("slot", F.least(F.floor(F.col("z") * slots), F.lit(slots - 1)).cast("int"))
        .select("rid", "doc_id", "source", "size", "whole", "z", "slot")
    )
    turns = range(max_copies)  # the documents' turn 0, then again

    def place(turn):
        return F.struct((F.lit(turn) * slots + F.col("slot")).cast("int").alias("slot"), "z",
                        F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), "size", "rid")

    def has(turn):
        return F.col("z").isNotNull() & (F.col("whole") + turn < max_copies)

    need = planned.groupBy("source").agg(F.sum(F.col("size") * F.col("whole")).alias("sure")).join(
        targets.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s")))
    state = scratch.keep(need.select("s", (F.col("target") - F.col("sure")).alias("gap"), F.lit(None).cast(
        "struct<slot: int, z: double, d: bigint, size: bigint, rid: bigint>").alias("after")))
    rounds = []
    while True:
        # (source, gap, after): documents behind ``after`` of at most ``gap`` words are still to come
        live = (
            planned.join(small(state, sources), F.col("source").eqNullSafe(F.col("s")))
            .where("z is not null and size <= gap")
            .select("s", "size", "gap", "after", F.explode(F.array(*[F.when(has(t), place(t)) for t in turns])).alias("at"))
            .where(F.col("at").isNotNull() & (F.col("after").isNull() | (F.col("at") > F.col("after"))))
            .withColumn("slot", F.col("at.slot"))
        )
        summed = live.groupBy("s", "slot").agg(F.sum("size").alias("words"), F.max("gap").alias("g")).withColumn(
            "end", F.sum("words").over(Window.partitionBy("s").orderBy("slot")))
        cuts = summed.where(F.col("end") > F.col("g")).groupBy("s").agg(
            F.min(F.struct("slot", (F.col("end") - F.col("words")).alias("base"))).alias("c")
        ).select(F.col("s").alias("cs"), F.col("c.slot").alias("cut"), F.col("c.base").alias("base"))
        in_order = Window.partitionBy("s").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        stops = (
            live.join(small(cuts, sources), F.col("s").eqNullSafe(F.col("cs")) & (F.col("slot") == F.col("cut")))
            .withColumn("sum", F.col("base") + F.sum("size").over(in_order))
            .where(F.col("sum") > F.col("gap")).groupBy("s")
            .agg(F.min(F.struct("at", "sum")).alias("stop"), F.max("gap").alias("gap"))
            .select("s", (F.col("gap") - F.col("stop.sum") + F.col("stop.at.size")).alias("gap"), F.col("stop.at").alias("after"))
        )
        stops = scratch.keep(stops)
        rounds.append(state.select("s", "gap", "after").join(
            stops.select(F.col("s").alias("t"), F.col("after").alias("upto")), F.col("s").eqNullSafe(F.col("t")), "left").drop("t"))
        state = stops
        if stops.isEmpty():
            break
    told = rounds[0]
    for r in rounds[1:]:
        told = told.unionByName(r)
    told = scratch.keep(told.groupBy("s").agg(F.collect_list(F.struct("gap", "after", "upto")).alias("told")))

    def taken(at):
        return F.exists("told", lambda r: (F.col("size") <= r["gap"]) & (r["after"].isNull() | (at > r["after"]))
                        & (r["upto"].isNull() | (at < r["upto"])))

    took = [F.when(has(t) & taken(place(t)), 1).otherwise(0) for t in turns]
    free = F.array_min(F.filter(F.array(*[F.when(has(t) & ~F.coalesce(taken(place(t)), F.lit(False)), place(t)) for t in turns]),
                                lambda x: x.isNotNull()))
    chosen = scratch.keep(
        planned.join(small(told, sources), F.col("source").eqNullSafe(F.col("s")), "left")
        .select("rid", "doc_id", "source", "size", "whole", sum(took[1:], took[0]).alias("extra"), free.alias("at"))
    )
    got = chosen.groupBy("source").agg(F.sum(F.col("size") * (F.col("whole") + F.col("extra"))).alias("got")).select(F.col("source").alias("s"), "got")
    open_ = (
        chosen.where("at is not null").join(small(got, sources), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .join(small(targets.select(F.col("source").alias("s"), "target"), sources), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("gap", F.col("target") - F.col("got"))
        .withColumn("miss", F.abs(F.col("gap") - F.col("size"))).where(F.col("miss") < F.abs("gap"))
    )
    last = open_.groupBy("s").agg(F.min(F.struct("miss", "at")).alias("pick")).select("s", F.col("pick.at.rid").alias("pick"))
    return chosen.join(small(last, sources), F.col("source").eqNullSafe(F.col("s")), "left").select(
        "rid", "doc_id", "source", "size",
        (F.col("whole") + F.col("extra") + F.coalesce((F.col("rid") == F.col("pick")).cast("int"), F.lit(0))).cast("long").alias("copies"))


def _mix(docs: DataFrame, scratch: Scratch, weights: Sequence[int], max_copies: int, seed: int) -> DataFrame:
    """(rid, doc_id, source, size, source_size, target, copies) of rows (rid, doc_id, source, text)."""
    rows = scratch.keep(docs.select(
        "rid", F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"), F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")))).alias("text_md5")))
    targets = scratch.keep(source_targets(rows, weights, max_copies))
    sources = targets.count()
    plan = mix_sizes(rows, targets, sources, scratch, max_copies, seed)
    return plan.join(small(targets.withColumnRenamed("source", "s"), sources), F.col("source").eqNullSafe(F.col("s"))).drop("s")


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_copies: int = 3, seed: int = 7
) -> DataFrame:
    """How often each document enters a mix of the sources.

    Returns a row per input row: ``doc_id, source, size, source_size, target,
    taken, copies``; ``taken = size * copies`` words. See ``source_targets``
    for the targets, ``expected_copies`` for the inclusion odds and
    ``mix_sizes`` for the sampling. Whole documents are taken, at most
    ``max_copies`` times.

    The texts are read once, into a table of sizes. A null text has size 0;
    a null source is a source of its own, last in order; documents of size 0
    are never taken. A row with a null id draws its random number from its
    text. Repeated rows are sampled as documents of their own, in any order
    among themselves. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "source-mixing")
    known = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", "text")
    return scratch.result(_mix(known, scratch, weights, max_copies, seed).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_copies: int = 3, seed: int = 7) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix_sources`` takes it.

    Rows keep all their columns, whatever their names: they are packed as one
    value while the mix is made. Nulls, empty texts and repeated rows as in
    ``mix_sources``; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixed-documents")
    packed = scratch.keep(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*docs.columns).alias("doc")))
    plan = _mix(packed.select("rid", "doc.doc_id", "doc.source", "doc.text"), scratch, weights, max_copies, seed)
    often = plan.where("copies > 0").select("rid", "copies")
    copies = F.transform(F.sequence(F.lit(1).cast("long"), F.col("copies")), lambda _: F.col("doc"))
    return scratch.result(packed.join(often, "rid").select(F.explode(copies).alias("doc")).select("doc.*"))


SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(text, '')) AS text_md5,
         row_number() OVER () AS rid FROM documents
), s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), s1 AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s0
), s2 AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 3 AS cap FROM s1
), s3 AS (
  SELECT *, CAST(cap AS DOUBLE) / w AS ratio, sum(source_size) OVER () AS total FROM s2
), s4 AS (
  SELECT *, CAST(total - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
       / CAST(sum(w) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM s3
), s5 AS (
  SELECT *, (SELECT level FROM s4 WHERE level <= ratio ORDER BY ratio, rank LIMIT 1) AS stop FROM s4
), targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(stop, 0.0) * w) AS target FROM s5
), sizes AS (
  SELECT source, size, CAST(floor(sqrt(size)) AS BIGINT) AS root, size * count(*) AS w, size * count(*) * CAST(floor(sqrt(size)) AS BIGINT) AS v
  FROM sized WHERE size > 0 GROUP BY source, size
), factors AS (
  SELECT source, arg_max(f, size) AS f FROM (
    SELECT a.source, a.size, a.root,
      (t.target - 3.0::DOUBLE * (SELECT coalesce(sum(w), 0) FROM sizes b WHERE b.source IS NOT DISTINCT FROM a.source AND b.size > a.size)::DOUBLE)
        / (SELECT sum(v) FROM sizes b WHERE b.source IS NOT DISTINCT FROM a.source AND b.size <= a.size)::DOUBLE AS f
    FROM sizes a JOIN targets t ON a.source IS NOT DISTINCT FROM t.source) WHERE f * root <= 3 GROUP BY source
), p0 AS (
  SELECT d.rid, d.doc_id, d.source, d.size, t.source_size, t.target,
         CASE WHEN d.size > 0 THEN least(3.0::DOUBLE, coalesce(f.f, 1e300) * floor(sqrt(d.size))) ELSE 0.0 END AS e,
         (CAST('0x' || md5('7:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null:' || d.text_md5))[1:13] AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN factors f ON d.source IS NOT DISTINCT FROM f.source
), p1 AS (
  SELECT *, CAST(floor(e) AS BIGINT) AS whole, e - floor(e) AS p FROM p0
), p2 AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM p1
), p3 AS (
  SELECT *, CASE WHEN size > 0 AND whole < 3 THEN coalesce(odds / (1 + odds), 1.0) END AS z FROM p2
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY turn, z, doc_id NULLS LAST, size) AS k
  FROM p3, (SELECT unnest([0, 1, 2]) AS turn) WHERE z IS NOT NULL AND whole + turn < 3
), walk(source, k, gap, extra) AS (
  SELECT source, CAST(0 AS BIGINT), max(target) - CAST(sum(size * whole) AS DOUBLE), 0 FROM p3 GROUP BY source
  UNION ALL
  SELECT w.source, o.k, CASE WHEN o.size <= w.gap THEN w.gap - o.size ELSE w.gap END, CASE WHEN o.size <= w.gap THEN 1 ELSE 0 END
  FROM walk w JOIN ordered o ON o.source IS NOT DISTINCT FROM w.source AND o.k = w.k + 1
), gaps AS (
  SELECT source, arg_min(gap, -k) AS gap FROM walk GROUP BY source
), plan AS (
  SELECT o.*, w.extra, g.gap FROM ordered o JOIN walk w ON o.source IS NOT DISTINCT FROM w.source AND o.k = w.k
  JOIN gaps g ON o.source IS NOT DISTINCT FROM g.source
), best AS (
  SELECT source, arg_min(k, (abs(gap - size), k)) AS k FROM plan WHERE extra = 0 AND abs(gap - size) < abs(gap) GROUP BY source
), extras AS (
  SELECT rid, CAST(sum(extra) + count(best.k) AS BIGINT) AS extra
  FROM plan LEFT JOIN best ON plan.source IS NOT DISTINCT FROM best.source AND plan.k = best.k GROUP BY rid
)
SELECT doc_id, size, source_size, target, CAST(size * (whole + coalesce(extra, 0)) AS BIGINT) AS taken FROM p3 LEFT JOIN extras USING (rid)
"""
