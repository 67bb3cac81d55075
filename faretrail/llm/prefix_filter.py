"""First stage of the set joins: which records share enough prefix tokens with another.

Records are token sets with a 64-bit owner (a digest of the set, so equal sets
have one owner). Each record posts a prefix of its tokens in hash order. Map
tasks settle what they can see themselves and send every token once; what
moves is packed arrays of (token, owner), not a row per posting. The reply is a
count per owner: of its posted tokens, how many another owner posted too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faretrail.llm import textops as X
from faretrail.llm.common import Scratch

#: Packed arrays that one map task's postings are dealt to, at least; an input
#: of many partitions has one for each eight of them.
BUCKETS = 512
#: Postings that a map task holds before it sends them.
HELD = 3_000_000
#: Cells that tokens are counted in to order them by rarity (4 bytes each).
CELLS = 1 << 20
_SPREAD = np.uint64(0xC2B2AE3D27D4EB4F)


class Rule:
    """Jaccard similarity of at least a / b, and prefixes that must share
    several tokens.

    Two linked sets of sizes x and y share ``overlap(x, y)`` tokens at least,
    so a set of size n shares ``least(n)`` with any partner. Its prefix has
    ``n - least(n) + matches(n)`` tokens; two linked sets share at least the
    smaller one's ``matches`` tokens of their prefixes. ``per_mille`` lengthens
    prefixes: ``matches(n)`` is that share of n (1000: the whole set).
    """

    def __init__(self, a: int, b: int, per_mille: int):
        self.a, self.b, self.per_mille = a, b, per_mille

    # numpy, and Spark columns: integer arithmetic alike in both
    def least(self, n):
        return (n * self.a + (self.b - 1)) // self.b

    def matches(self, n):
        return np.minimum(self.least(n), np.maximum(1, (n * self.per_mille + 999) // 1000))

    def prefix(self, n):
        return n - self.least(n) + self.matches(n)

    def c_least(self, n: Column) -> Column:
        return _div(n * self.a + (self.b - 1), self.b)

    def c_most(self, n: Column) -> Column:
        return _div(n * self.b, self.a)

    def c_matches(self, n: Column) -> Column:
        return F.least(self.c_least(n), F.greatest(F.lit(1), _div(n * self.per_mille + 999, 1000)))

    def c_prefix(self, n: Column) -> Column:
        return n - self.c_least(n) + self.c_matches(n)

    def c_overlap(self, x: Column, y: Column) -> Column:
        return _div((x + y) * self.a + (self.a + self.b - 1), self.a + self.b)

    def c_need(self, x: Column, y: Column) -> Column:
        """Tokens that the prefixes of two linked sets of these sizes share."""
        o = self.c_overlap(x, y)
        return F.greatest(F.lit(1), F.least(o - x + self.c_prefix(x), o - y + self.c_prefix(y)))

    def c_fits(self, x: Column, y: Column) -> Column:
        return F.least(x, y) * self.b >= F.greatest(x, y) * self.a


def _div(x: Column, by: int) -> Column:
    return F.floor(x / F.lit(by)).cast("int")


#: What a task says about one slice of its input: record columns, their owners,
#: and prefix tokens with the index of their record.
Records = tuple[list[pa.Array], np.ndarray, np.ndarray, np.ndarray]


class _Held:
    def __init__(self) -> None:
        self.tokens: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        self.known: set[int] = set()
        self.size = 0

    def add(self, owners: np.ndarray, tokens: np.ndarray, record: np.ndarray) -> None:
        fresh = np.zeros(len(owners), bool)
        for i, o in enumerate(owners.tolist()):  # equal sets post once
            if o not in self.known:
                self.known.add(o)
                fresh[i] = True
        use = fresh[record]
        self.tokens.append(tokens[use] * _SPREAD)
        self.owners.append(owners[record[use]])
        self.size += int(use.sum())


def _groups(tokens: np.ndarray, owners: np.ndarray):
    order = np.argsort(tokens)
    tokens, owners = tokens[order], owners[order]
    first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    lo, hi = np.minimum.reduceat(owners, first), np.maximum.reduceat(owners, first)
    return order, tokens, owners, first, lo != hi


def _counted(owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(owners, return_counts=True)


def _shared_count(fields: list[pa.Field], records: Callable[[pa.RecordBatch], Iterator[Records]], buckets: int):
    names = ["route", "owner", "count", "tok", "own", "flag"]
    extra = [f.name for f in fields]

    def rows(_n: int, **given) -> pa.RecordBatch:
        kinds = dict(zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))) | {f.name: f.type for f in fields}
        return pa.RecordBatch.from_arrays([given[k] if k in given else pa.nulls(_n, t) for k, t in kinds.items()], names=list(kinds))

    def send(held: _Held) -> Iterator[pa.RecordBatch]:
        if not held.size:
            return
        _, tokens, owners, first, shared = _groups(np.concatenate(held.tokens), np.concatenate(held.owners))
        whose, counts = _counted(owners[np.repeat(shared, np.diff(np.r_[first, len(tokens)]))])
        if len(whose):  # seen here under two owners: settled for all of them
            yield rows(len(whose), route=pa.array((whose % np.uint64(buckets)).astype(np.int64)), owner=pa.array(whose.view(np.int64)), count=pa.array(counts))
        tokens, owners = tokens[first], owners[first]
        bucket = (tokens >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)
        edge = np.searchsorted(bucket, np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(edge))
        pack = lambda a: pa.array([a[edge[k] : edge[k + 1]].tobytes() for k in some], pa.binary())
        yield rows(len(some), route=pa.array(some), tok=pack(tokens), own=pack(owners), flag=pack(shared))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sent = _Held(), 0
        for whole in batches:
            for columns, owners, tokens, record in records(whole):
                if len(owners):  # records pass the reply as they are: dealt evenly, whatever their sets
                    turn = (np.arange(len(owners), dtype=np.int64) + sent) % buckets
                    sent += len(owners)
                    yield rows(
                        len(owners), route=pa.array(turn), owner=pa.array(owners.view(np.int64)),
                        **dict(zip(extra, columns)),
                    )
                held.add(owners, tokens, record)
                if held.size > HELD:
                    yield from send(held)
                    held = _Held()
        yield from send(held)

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        keep = ["owner", "count", *extra]
        for b in batches:
            at = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            packed = np.asarray(at["tok"].is_valid())
            for i in np.flatnonzero(packed).tolist():
                parts.append(tuple(np.frombuffer(at[c][i].as_buffer(), t) for c, t in (("tok", np.uint64), ("own", np.uint64), ("flag", bool))))
            if not packed.all():
                plain = b.filter(pa.array(~packed))
                yield pa.RecordBatch.from_arrays([plain.column(plain.schema.get_field_index(c)) for c in keep], names=keep)
        if not parts:
            return
        tokens, owners, flags = (np.concatenate(x) for x in zip(*parts))
        order, tokens, owners, first, shared = _groups(tokens, owners)
        flags = flags[order]
        shared |= np.logical_or.reduceat(flags, first)
        hit = np.repeat(shared, np.diff(np.r_[first, len(tokens)])) & ~flags
        whose, counts = _counted(owners[hit])
        yield pa.RecordBatch.from_arrays(
            [pa.array(whose.view(np.int64)), pa.array(counts), *(pa.nulls(len(whose), f.type) for f in fields)], names=keep
        )

    return post, reply


def shared_prefix_counts(
    src: DataFrame, fields: list[tuple[str, str, pa.DataType]], records: Callable, scratch: Scratch
) -> tuple[DataFrame, DataFrame]:
    """(records, counts): the record rows that ``records`` makes of ``src``
    (``owner`` and ``fields``: name, SQL type, Arrow type), and per owner the
    posted tokens that other owners posted too (too high a count is possible
    for sets met in several tasks, too low a one is not)."""
    buckets = 1 << (max(BUCKETS, src.rdd.getNumPartitions() // 8) - 1).bit_length()
    post, reply = _shared_count([pa.field(n, t) for n, _, t in fields], records, buckets)
    own = "".join(f", {n} {sql}" for n, sql, _ in fields)
    sent = src.mapInArrow(post, "route long, owner long, count long, tok binary, own binary, flag binary" + own)
    out = scratch.keep(sent.repartition("route").mapInArrow(reply, "owner long, count long" + own))
    rows = out.where("count is null").drop("count")
    counts = out.where("count is not null").groupBy("owner").agg(F.sum("count").alias("shared"))
    return rows, counts


# ------------------------------------------------------------- rarity order

def _cell(tokens: np.ndarray) -> np.ndarray:
    return (X.mix(tokens.view(np.uint64)) >> np.uint64(44)).astype(np.int64)


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CELLS, np.int64)
    for b in batches:
        total += np.bincount(_cell(b.column(0).flatten().to_numpy()), minlength=CELLS)
    for part, counts in enumerate(total.reshape(64, -1)):
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([counts.tolist()], pa.list_(pa.int64()))], names=["part", "counts"])


def rarity(sets: DataFrame):
    """A broadcast of the tokens of all ``sets`` (toks) counted in ``CELLS``
    cells: its size is fixed. Any order that all tasks share keeps a join
    exact; ``rarest_first`` puts tokens of much-used cells last."""
    parts = sets.select("toks").mapInArrow(_count_cells, "part long, counts array<long>")
    width = CELLS // 64
    sums = parts.select("part", F.posexplode("counts").alias("at", "c")).where("c > 0").groupBy("part", "at").agg(F.sum("c").alias("c"))
    out = np.zeros(CELLS, np.int32)
    got = sums.select((F.col("part") * width + F.col("at")).alias("cell"), F.least("c", F.lit(2**31 - 1)).cast("int").alias("c")).toArrow()
    out[got.column("cell").to_numpy()] = got.column("c").to_numpy()
    return sets.sparkSession.sparkContext.broadcast(out)


def rarest_first(sets: DataFrame, cells, rule: Rule, columns: list[str]) -> DataFrame:
    """Each set's prefix in rarity order: ``columns``, ``tok`` and its place
    ``pos`` from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = cells.value
        for b in batches:
            toks = b.column(b.schema.get_field_index("toks"))
            size = toks.value_lengths().to_numpy().astype(np.int64)
            flat = toks.flatten().to_numpy()
            owner = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((flat, counts[_cell(flat)], owner))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            inside = place < rule.prefix(size)[owner]
            who = pa.array(owner[inside])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(b.schema.get_field_index(c)).take(who) for c in columns), pa.array(flat[order][inside]), pa.array(place[inside])],
                names=[*columns, "tok", "pos"],
            )

    kinds = dict(sets.dtypes)
    own = ", ".join(f"{c} {kinds[c]}" for c in columns)
    return sets.select(*columns, "toks").mapInArrow(run, own + ", tok long, pos long")
