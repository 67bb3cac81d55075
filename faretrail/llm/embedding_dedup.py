"""Near-duplicate vectors: random-hyperplane signatures, exact cosine, components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from faretrail.llm.common import Scratch, prepare
from faretrail.llm.graph import connected_components

#: Vectors that an average bucket should hold; more bits follow from the count.
BUCKET = 64


def _rows(column: pa.Array) -> list[np.ndarray | None]:
    """Each row's vector in double precision; None unless it can be compared."""
    out: list[np.ndarray | None] = []
    offsets = column.offsets.to_numpy()
    values = column.values
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = ~np.isfinite(flat)
    if values.null_count:
        bad |= ~np.asarray(values.is_valid())
    valid = np.asarray(column.is_valid())
    for i in range(len(column)):
        s, e = offsets[i], offsets[i + 1]
        v = flat[s:e]
        out.append(v if valid[i] and e > s and not bad[s:e].any() and v.any() else None)
    return out


def _keyed(kind: str):
    """Rows of (id, key, vector's bytes); ``kind`` is the type of the table's
    entries, so that no byte is moved that it does not have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vecs = b.column(0), _rows(b.column(1))
            known = np.asarray(ids.is_valid())
            raw = [v.astype(kind).tobytes() if v is not None and known[i] else None for i, v in enumerate(vecs)]
            key = [hashlib.blake2b(r, digest_size=16).digest() if r is not None else None for r in raw]
            yield pa.RecordBatch.from_arrays([ids, pa.array(key, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "key", "vec"])

    return run


def plan_tables(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits per table, tables) so that a pair at the threshold is found with
    probability ``recall`` and an average bucket holds about ``BUCKET`` of n."""
    bits = max(1, round(math.log2(max(2.0, n / BUCKET))))
    agree = 1.0 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    hit = min(agree**bits, 1.0 - 1e-12)
    return bits, max(1, math.ceil(math.log(1.0 - recall) / math.log(1.0 - hit)))


def _signer(bits: int, tables: int, seed: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            sigs, dims = [], []
            for raw in b.column(2).to_pylist():
                v = np.frombuffer(raw, kind).astype(np.float64)
                if len(v) not in planes:
                    planes[len(v)] = np.random.default_rng(seed).standard_normal((tables * bits, len(v)))
                side = planes[len(v)] @ (v / np.abs(v).max()) > 0
                sigs.append(side.reshape(tables, bits) @ weights)
                dims.append(len(v))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(dims, pa.int32()), pa.array(sigs, pa.list_(pa.int64()))],
                names=["id", "n", "vec", "dim", "sigs"],
            )

    return run


def _local_components(i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    label = np.arange(size)
    while True:
        low = np.minimum(label[i], label[j])
        nxt = label.copy()
        np.minimum.at(nxt, i, low)
        np.minimum.at(nxt, j, low)
        nxt = nxt[nxt]
        if (nxt == label).all():
            return label
        label = nxt


def _compare(threshold: float, kind: str):
    empty = pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "near": pa.array([], pa.int64())})

    def run(key: tuple, group: pa.Table) -> pa.Table:
        lo, hi = key[3].as_py(), key[4].as_py()
        group = group.combine_chunks()
        ids = group.column("id").to_numpy()
        order = np.argsort(ids)  # a group's first row is its smallest id
        ids = ids[order]
        weight = group.column("n").to_numpy()[order]
        raw = group.column("vec").to_pylist()
        vecs = np.stack([np.frombuffer(raw[o], kind) for o in order]).astype(np.float64)
        vecs = vecs / np.abs(vecs).max(axis=1, keepdims=True)
        earlier = np.array(group.column("earlier").to_pylist(), dtype=np.int64)[order]
        norm = np.sqrt((vecs * vecs).sum(axis=1))
        if lo == hi:
            cos = (vecs @ vecs.T) / np.outer(norm, norm)
            i, j = np.nonzero(np.triu(cos >= threshold, 1))
        else:  # two blocks of one large bucket: only pairs across them
            part = group.column("part").to_numpy()[order]
            p, q = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
            if not len(p) or not len(q):
                return empty
            cos = (vecs[p] @ vecs[q].T) / np.outer(norm[p], norm[q])
            a, b = np.nonzero(cos >= threshold)
            i, j = p[a], q[b]
        fresh = ~(earlier[i] == earlier[j]).any(axis=1)  # not met in an earlier table
        i, j = i[fresh], j[fresh]
        if not len(i):
            return empty
        links = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
        label = _local_components(i, j, len(ids))
        hit = np.flatnonzero(links)
        return pa.table({"id": ids[hit], "links": links[hit].astype(np.int64), "near": ids[label[hit]]})

    return run


def embedding_neardup(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
    recall: float = 0.999,
    block: int = 1024,
    seed: int = 17,
) -> DataFrame:
    """Link vectors whose cosine is at least ``threshold``.

    Returns a row per input row: ``vec_id``, ``n_links`` (other rows linked
    directly), ``component_id`` (smallest id reachable) and ``kept``
    (``vec_id = component_id``).

    Identical vectors are collapsed first and counted by weight. Each distinct
    vector gets ``tables`` signatures of ``bits`` hyperplane signs; both
    numbers follow from the count of vectors, so buckets stay small and a pair
    at the threshold is met in some table with probability ``recall``. Buckets
    are compared exactly in double precision; a pair is counted in the first
    table where it meets. A bucket of more than ``block`` vectors is cut into
    blocks whose pairs are separate groups, so no task holds a hot bucket.
    Groups return one row per linked vector (its new links, and the smallest
    id of its group's component), never their pairs.

    Rows link with nothing if their vector is null, empty, zero or has a null
    or non-finite component, or if their id is null; vectors of different
    lengths never link. Repeated rows count as vectors of their own; an empty
    table gives an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "embedding-neardup")
    entries = vectors.schema[vector_col].dataType.elementType
    kind = "float32" if isinstance(entries, FloatType) else "float64"
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if kind == "float32" else "array<double>").alias("v"))
    keyed = src.mapInArrow(_keyed(kind), "vec_id long, key binary, vec binary")
    classes = scratch.keep(
        keyed.where("key is not null").groupBy("key")
        .agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    )
    bits, tables = plan_tables(classes.count(), threshold, recall)
    signed = scratch.keep(
        classes.select("id", "n", "vec").mapInArrow(
            _signer(bits, tables, seed, kind), "id long, n long, vec binary, dim int, sigs array<long>"
        )
    )
    buckets = (
        signed.select("dim", F.posexplode("sigs").alias("tab", "bucket"))
        .groupBy("dim", "tab", "bucket").count().where("count > 1")
        .select("dim", "tab", "bucket", F.ceil(F.col("count") / F.lit(block)).cast("int").alias("parts"))
    )
    members = (
        signed.select("*", F.posexplode("sigs").alias("tab", "bucket"))
        .join(buckets, ["dim", "tab", "bucket"])
        .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("lo", F.least("part", "other"))
        .withColumn("hi", F.greatest("part", "other"))
        .select("dim", "tab", "bucket", "lo", "hi", "part", "id", "n", "vec", F.slice("sigs", F.lit(1), F.col("tab")).alias("earlier"))
    )
    found = scratch.keep(
        members.groupBy("dim", "tab", "bucket", "lo", "hi")
        .applyInArrow(_compare(threshold, kind), "id long, links long, near long")
    )
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("id").alias("a"), F.col("near").alias("b")), scratch)
    per_class = (
        classes.select("key", "id", "n").join(links, "id", "left")
        .join(comps.withColumnRenamed("node", "id"), "id", "left")
        .select(
            "key",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    return (
        keyed.select("vec_id", "key").join(per_class, "key", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT vec_id, e FROM v WHERE vec_id IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), r(id, m) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT l.b, r.m FROM r JOIN l ON l.a = r.id WHERE r.m < l.b
), c AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT r.id AS vec_id, coalesce(any_value(c.n), 0) AS n_links, min(r.m) AS component_id, r.id = min(r.m) AS kept
FROM r LEFT JOIN c ON c.a = r.id GROUP BY r.id
"""
