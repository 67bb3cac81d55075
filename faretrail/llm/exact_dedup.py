"""Exact duplicates by content-defined chunk recipes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faretrail.llm import textops as X
from faretrail.llm.common import Scratch, prepare, semi_join

#: Bytes that decide whether a chunk may end after them.
WINDOW = 32


def chunk_ends(data: np.ndarray, offsets: np.ndarray, average: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(end, text index) of every chunk: a chunk ends where the hash of the
    last ``WINDOW`` bytes says so, so equal stretches of text are cut alike
    wherever they stand. Chunks have at least ``WINDOW`` and at most
    ``longest`` bytes; a text's last chunk may be shorter."""
    up, down = X._power_tables()
    mask = np.uint64((1 << max(1, average.bit_length() - 1)) - 1)
    marks = []
    step = X.BLOCK - WINDOW
    for at in range(0, len(data), step):
        part = data[at : at + X.BLOCK].astype(np.uint64) + np.uint64(1)
        if len(part) < WINDOW:
            break
        part *= up[: len(part)]
        sums = np.empty(len(part) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(part, out=sums[1:])
        count = len(part) - WINDOW + 1
        window = X.mix((sums[WINDOW:] - sums[:count]) * down[:count])
        found = np.flatnonzero((window & mask) == 0)
        marks.append(found[found < step] + at + WINDOW)
    cuts = np.concatenate(marks) if marks else np.zeros(0, np.int64)
    ends, owner = [], []
    for i in range(len(offsets) - 1):
        at, stop = int(offsets[i]), int(offsets[i + 1])
        if at == stop:
            continue
        own = cuts[np.searchsorted(cuts, at + WINDOW) : np.searchsorted(cuts, stop)].tolist()
        for c in (*own, stop):
            while c - at > longest:
                at += longest
                ends.append(at)
                owner.append(i)
            if c == stop or c - at >= WINDOW:
                if c > at:
                    ends.append(c)
                    owner.append(i)
                at = c
    return np.array(ends, np.int64), np.array(owner, np.int64)


def _chunks(batch: pa.RecordBatch, average: int, longest: int, bits: int):
    """(lower-cased bytes, offsets, chunk starts, ends, text index, fingerprints)."""
    raw, offsets = X.text_bytes(batch.column(1))
    data = X.LOWER[raw]
    ends, owner = chunk_ends(data, offsets, average, longest)
    first = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
    starts = np.where(first, offsets[owner] if len(owner) else 0, np.r_[0, ends[:-1]] if len(ends) else 0)
    prints = X.span_hashes(data, starts, ends) >> np.uint64(64 - bits)
    return data, offsets, starts, ends, owner, prints.view(np.int64)


def _recipes(average: int, longest: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in X.text_slices(whole, "text"):
                data, offsets, _, _, owner, prints = _chunks(b, average, longest, bits)
                view = memoryview(data)
                sha = [hashlib.sha256(view[offsets[i] : offsets[i + 1]]).hexdigest() for i in range(b.num_rows)]
                cut = np.searchsorted(owner, np.arange(b.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(sha), pa.ListArray.from_arrays(pa.array(cut), pa.array(prints))],
                    names=["doc_id", "text_sha256", "recipe"],
                )

    return run


def _bodies(average: int, longest: int, bits: int, places: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in X.text_slices(whole, "text"):
                data, offsets, starts, ends, owner, prints = _chunks(b, average, longest, bits)
                view = data.tobytes()
                body = [view[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
                cols = [pa.array(prints), pa.array(body, pa.binary())]
                names = ["fp", "body"]
                if places:
                    first = np.searchsorted(owner, owner)
                    sha = {i: hashlib.sha256(view[offsets[i] : offsets[i + 1]]).hexdigest() for i in set(owner.tolist())}
                    cols += [pa.array([sha[i] for i in owner.tolist()], pa.string()), pa.array((np.arange(len(owner)) - first).astype(np.int32))]
                    names += ["text_sha256", "pos"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _verified(texts: DataFrame, rows: DataFrame, scratch: Scratch, options: tuple) -> DataFrame:
    """``rows`` with recipes of verified chunk identifiers.

    A fingerprint that stands once needs no check. The bodies of the others
    are moved once, each distinct body once per task, and grouped by their
    bytes: a fingerprint with a single body is its verified identifier. Those
    with several bodies (collisions) get (fingerprint, rank of the body) as
    identifiers, and only the recipes that hold one are rewritten.
    """
    repeated = scratch.keep(
        rows.select("text_sha256", F.explode("recipe").alias("fp")).groupBy("fp").count().where("count > 1").select("fp")
    )
    bodies = texts.mapInArrow(_bodies(*options, False), "fp long, body binary")
    distinct = semi_join(bodies, repeated, "fp").groupBy("fp", "body").agg(F.count("*").alias("n"))
    clashing = scratch.keep(distinct.groupBy("fp").count().where("count > 1").select("fp"))
    pairs = F.transform("recipe", lambda x: F.struct(x.alias("fp"), F.lit(0).alias("k")))
    if clashing.isEmpty():
        return rows.withColumn("recipe", pairs)
    placed = semi_join(
        texts.mapInArrow(_bodies(*options, True), "fp long, body binary, text_sha256 string, pos int"), clashing, "fp"
    )
    known = placed.select("fp", "body").distinct()
    other = known.select("fp", F.col("body").alias("lower"))
    rank = (
        known.join(other, "fp").groupBy("fp", "body")
        .agg(F.sum((F.col("lower") < F.col("body")).cast("int")).cast("int").alias("k"))
    )
    fixes = (
        placed.dropDuplicates(["text_sha256", "pos"]).join(rank, ["fp", "body"])
        .groupBy("text_sha256").agg(F.map_from_entries(F.collect_list(F.struct("pos", "k"))).alias("ks"))
    )
    return rows.join(fixes, "text_sha256", "left").withColumn(
        "recipe",
        F.transform("recipe", lambda x, i: F.struct(x.alias("fp"), F.coalesce(F.col("ks")[i], F.lit(0)).alias("k"))),
    ).drop("ks")


def exact_dedup(docs: DataFrame, average: int = 1024, longest: int = 16384, bits: int = 64) -> DataFrame:
    """Group documents whose texts are equal after lower-casing A-Z.

    Returns a row per document: ``doc_id, keep_id`` (largest id of its group),
    ``group_size, kept, text_sha256`` (of the lower-cased UTF-8 text).

    Texts are cut into content-defined chunks inside the scan; what moves is
    each document's recipe, the ordered list of its chunk identifiers, and the
    body of each chunk that more than one place claims to hold (see
    ``_verified``). Documents are equal when their lists are equal. Groups are
    formed by partial aggregation, so a group with a third of all rows is
    combined before the shuffle.

    A null text counts as empty; all empty texts are one group. Rows with the
    same id and an equal text are returned as often as they stand, and all of
    them are kept if their id is the largest. A null id stays only in a group
    without other ids (then ``keep_id`` is null). Other columns are not read; an empty table gives an
    empty result. ``bits`` shortens the fingerprints (tests of collisions).
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "exact-dedup")
    options = (average, longest, bits)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = scratch.keep(
        texts.mapInArrow(_recipes(*options), "doc_id long, text_sha256 string, recipe array<long>")
        .groupBy("doc_id", "text_sha256", "recipe").agg(F.count("*").alias("n"))
    )
    ready = scratch.keep(_verified(texts, rows, scratch, options))
    groups = ready.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    once = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    return ready.join(groups, "recipe").withColumn("time", once).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs``, with its columns, per group of equal texts.

    The row with the largest id stays; of repeated rows with that id and text
    one stays, a null text is empty, and a null id stays only where its group
    has no other. An empty table gives no rows. The texts are shuffled once, by
    (id, text digest), packed with their other columns as one value, so these
    may have any names.
    """
    kept = exact_dedup(docs, **options).where("kept").select(_row_key(F.col("doc_id"), F.col("text_sha256")).alias("key"))
    sha = F.sha2(_ascii_lower(F.coalesce(F.col("text"), F.lit(""))).cast("binary"), 256)
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), _row_key(F.col("doc_id"), sha).alias("key"))
    return keyed.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("doc.*")


def _row_key(doc_id, sha):
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), sha)


def _ascii_lower(text):
    upper = "".join(chr(c) for c in range(65, 91))
    return F.translate(text, upper, upper.lower())


SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
