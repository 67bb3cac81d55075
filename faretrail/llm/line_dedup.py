"""Line deduplication: exact set-similarity join with rarity-ordered prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faretrail.llm import textops as X
from faretrail.llm.common import Scratch, prepare, semi_join, skew_join
from faretrail.llm.prefix_filter import Rule, rarest_first, rarity, shared_prefix_counts

#: Tokens to share per mille of a line's size in the first stage.
FIRST_STAGE = 50
_LAST = (1 << 63) - 1


def _lines(b: pa.RecordBatch, k: int):
    """(text index, line number, tokens, line of each, sizes, digests)."""
    raw, offsets = X.text_bytes(b.column(1))
    data = X.LOWER[raw]
    breaks = np.flatnonzero(raw == 10)
    text = np.r_[np.flatnonzero(np.diff(offsets)), np.searchsorted(offsets, breaks, side="right") - 1]
    start = np.r_[offsets[:-1][np.diff(offsets) > 0], breaks + 1]
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    nth = np.arange(len(text)) - np.searchsorted(text, text)
    s, e, line = X.word_bounds(data, np.r_[start, len(data)]) if len(start) else (np.zeros(0, np.int64),) * 3
    tokens, owner = X.distinct_sorted(*X.shingle_hashes(X.span_hashes(data, s, e), line, k))
    size = np.bincount(owner, minlength=len(text))
    some = np.flatnonzero(size)
    d1, d2 = np.zeros(len(text), np.uint64), np.zeros(len(text), np.uint64)
    d1[some], d2[some] = X.set_digests(tokens, (np.cumsum(size) - size)[some])
    return text, nth, tokens, owner, size, d1, d2


def _records(k: int, rule: Rule):
    def run(whole: pa.RecordBatch):
        for b in X.text_slices(whole, "text"):
            text, nth, tokens, owner, size, d1, d2 = _lines(b, k)
            place = np.arange(len(tokens)) - (np.cumsum(size) - size)[owner]
            inside = place < rule.prefix(size)[owner]
            columns = [b.column(0).take(pa.array(text)), pa.array(nth.astype(np.int32)), pa.array(size.astype(np.int32)), X.digest_column(d1, d2)]
            yield columns, d1, tokens[inside], owner[inside]

    return run


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in X.text_slices(whole, "text"):
                _, _, tokens, _, size, d1, d2 = _lines(b, k)
                ends = np.r_[0, np.cumsum(size)].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [X.digest_column(d1, d2), pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens.view(np.int64)))], names=["key", "toks"]
                )

    return run


class _Join:
    """Which sets (id, n, toks, first, copies) match one with an earlier ``first``."""

    def __init__(self, sets: DataFrame, rule: Rule, scratch: Scratch):
        self.sets, self.rule, self.scratch = sets, rule, scratch

    def _passes(self, x: Column, i: Column, y: Column, j: Column) -> Column:
        """Length filter, and positional filter: no more can be shared than
        stands from these places on."""
        return self.rule.c_fits(x, y) & (F.least(x - i, y - j) >= self.rule.c_overlap(x, y))

    def _verify(self, pairs: DataFrame) -> DataFrame:
        left = self.sets.select(F.col("id").alias("y"), F.col("n").alias("ny"), F.col("toks").alias("ty"))
        right = self.sets.select(F.col("id").alias("x"), F.col("n").alias("nx"), F.col("toks").alias("tx"))
        both = F.size(F.array_intersect("tx", "ty"))
        return (
            pairs.join(right, "x").join(left, "y")
            .where(both * self.rule.b >= (F.col("nx") + F.col("ny") - both) * self.rule.a).select("y").distinct()
        )

    def run(self) -> DataFrame:
        postings = rarest_first(self.sets, rarity(self.sets), self.rule, ["id", "n", "first", "copies"])
        again = postings.groupBy("tok").count().where("count > 1").select("tok")
        rows = self.scratch.keep(postings.join(again, "tok", "left_semi"))
        # first against each token's earliest and most copied line
        who = F.struct("first", "id", "n", "pos")
        lead = rows.groupBy("tok").agg(F.min(who).alias("a"), F.max_by(who, "copies").alias("b"))
        near = (
            rows.join(lead, "tok").select("id", "n", "pos", "first", F.explode(F.array("a", "b")).alias("x"))
            .where((F.col("x.first") < F.col("first")) & self._passes(F.col("n"), F.col("pos"), F.col("x.n"), F.col("x.pos")))
            .select(F.col("id").alias("y"), F.col("x.id").alias("x")).distinct()
        )
        hit = self.scratch.keep(self._verify(near))
        # lines still without a match against every earlier line
        l = rows.join(hit, rows["id"] == hit["y"], "left_anti").alias("l")
        r = rows.alias("r")
        rest = (
            l.join(r, (F.col("l.tok") == F.col("r.tok")) & (F.col("r.first") < F.col("l.first"))
                   & self._passes(F.col("l.n"), F.col("l.pos"), F.col("r.n"), F.col("r.pos")))
            .select(F.col("l.id").alias("y"), F.col("r.id").alias("x")).distinct()
        )
        more = self.scratch.keep(self._verify(rest))
        return hit.union(more).select(F.col("y").alias("id"))


def line_decisions(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """Which lines of which documents have an earlier match.

    Returns (doc_id, line, n, removed): a row per line of the texts, split at
    line feeds; ``n`` is its number of tokens.

    A line's tokens are its distinct shingles of ``k`` words (A-Z lower-cased;
    a shorter line is one shingle). A line is removed if an earlier line, in
    the order of id (null last) and line number, has a token set with a Jaccard
    similarity of at least ``threshold``. Lines without words stay.

    Equal sets are one class; its first line stands for it. Classes that share
    too few prefix tokens with all others are settled by ``prefix_filter``; the
    others are read again, order their tokens by rarity and go through prefix,
    length and positional filters. Every remaining pair is verified by its
    whole sets: first with the likeliest earlier lines of each token, then, for
    lines without a match so far, with all.

    A null or empty text has no lines. Rows with the same id are told apart
    only by their lines: an equal line at the same place of a repeated row is
    the same line. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "line-dedup")
    first_rule, rule = Rule(*threshold, FIRST_STAGE), Rule(*threshold, 0)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fields = [("doc_id", "long", pa.int64()), ("line", "int", pa.int32()), ("n", "int", pa.int32()), ("key", "binary", pa.binary())]
    rows, counts = shared_prefix_counts(src, fields, _records(k, first_rule), scratch)
    place = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("d"), F.col("line").alias("line"))
    classes = scratch.keep(
        rows.where("n > 0").groupBy("key")
        .agg(F.first("owner").alias("owner"), F.first("n").cast("long").alias("n"), F.min(place).alias("first"), F.count("*").alias("copies"))
    )
    able = classes.join(counts, "owner").where(F.col("shared") >= first_rule.c_matches(first_rule.c_least(F.col("n"))))
    tie = Window.partitionBy("owner").orderBy("key")
    able = scratch.keep(able.withColumn("id", F.col("owner") + F.row_number().over(tie) - 1).select("id", "key", "n", "first", "copies"))
    reps = able.select(F.col("first.d").alias("doc_id")).where(F.col("doc_id") != _LAST).distinct()
    texts = semi_join(src, reps, "doc_id").union(src.where("doc_id is null"))
    found = texts.mapInArrow(_set_rows(k), "key binary, toks array<long>").where("size(toks) > 0")
    sets = scratch.keep(found.join(able, "key").dropDuplicates(["id"]).select("id", "n", "toks", "first", "copies"))
    matched = able.select("id", "key").join(_Join(sets, rule, scratch).run(), "id").select("key", F.lit(True).alias("matched"))
    fate = scratch.keep(classes.select("key", "first", "copies").join(matched, "key", "left"))
    removed = F.coalesce("matched", F.lit(False)) | (place != F.col("first"))
    some = skew_join(rows.where("n > 0").select("doc_id", "line", "n", "key"), fate, "key", "copies", rows.count())
    none = rows.where("n = 0").select("doc_id", "line", "n", F.lit(False).alias("removed"))
    return some.select("doc_id", "line", "n", removed.alias("removed")).union(none)


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """A row per id: ``doc_id, n_lines, n_removed, removed`` (line numbers from
    0, in order), from ``line_decisions``. Ids whose texts are null or empty
    have no lines."""
    lines = line_decisions(docs, **options)
    per = lines.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.sum(F.col("removed").cast("long")).alias("n_removed"),
        F.sort_array(F.collect_set(F.when(F.col("removed"), F.col("line")))).alias("removed"),
    ).withColumnRenamed("doc_id", "_d")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    zero = F.lit(0).cast("long")
    return ids.join(per, ids["doc_id"].eqNullSafe(per["_d"]), "left").select(
        "doc_id", F.coalesce("n_lines", zero).alias("n_lines"), F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("removed", F.expr("cast(array() as array<int>)")).alias("removed"),
    )


def without_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with its columns, of any names; texts lose their removed lines.

    A null text stays null. Rows that share an id (null ids are one) lose the
    lines that ``line_dedup`` removes for it. An empty table gives no rows.
    """
    gone = line_dedup(docs, **options).where("n_removed > 0").select(F.col("doc_id").alias("id"), "removed")
    packed = docs.select(F.struct(*docs.columns).alias("doc"))
    parts = F.split("doc.text", "\n", -1)
    left = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("removed", i)), "\n")
    text = F.when(F.col("removed").isNull(), F.col("doc.text")).otherwise(left).alias("text")
    joined = packed.join(gone, F.col("doc.doc_id").eqNullSafe(F.col("id")), "left")
    return joined.select(*[text if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])
