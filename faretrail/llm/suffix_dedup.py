"""Removal of byte passages that stand anywhere else, by suffix arrays built from Lyndon groups.

A suffix array of a whole corpus fits no task, so the passages are dealt first.
Each window of ``length`` bytes has an anchor, its k-gram of smallest hash, which
depends on the window's bytes alone: equal windows have equal anchors at equal
places. The windows of one anchor form a fragment (the bytes they cover), and
fragments meet by the hash of their anchor. What stands once by that hash is
unique; of fragments that are equal one goes on, with their number. The
fragments that share an anchor and differ are sorted by suffix: ``suffix_array``
groups suffixes by Lyndon prefix and emits the groups' order, and the longest
common prefixes of neighbours tell which windows stand in another fragment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faretrail.llm import textops
from faretrail.llm.common import Scratch, prepare, skew_join, small

#: Windows hashed at once; the low bits of a ranking key hold a place in the block.
BLOCK = 1 << 17
_PLACE = np.uint64((1 << 18) - 1)
#: Fragments of one anchor sorted in one task; groups beyond it are cut finer first.
GROUP = 2_000
#: Windows of a piece when a fragment of a large group is cut; one window is never cut.
FINER = (8, 1)
#: Bytes of fragments that a sorting task should hold.
TASK_BYTES = 4 << 20

OCCURRENCE = "row long, lo int, anchor int, size int, khash long, print long, w long"


# ---------------------------------------------------------------------------
# Suffix array
# ---------------------------------------------------------------------------


def suffix_array(s: Sequence[int]) -> list[int]:
    """Suffix array of a sequence of whole numbers that ends in a unique smallest one.

    First the suffixes are grouped by Lyndon prefix. Groups start as the
    symbols and are taken from the largest down. Each member points to the
    nearest place on its left whose group is still smaller; a place that
    members of the taken group point to has a longer Lyndon prefix than those
    of its own group that they do not, and the more pointers, the larger it is.
    So these places leave their group for new ones just above it. Every
    pointer is set once and skips what is taken, so the work is linear.

    Then the order inside the groups is emitted from the smallest suffix up:
    suffix i settles the places whose Lyndon prefix ends where i begins,
    which are i - 1 and its pointers up to one that is settled already.
    """
    n = len(s)
    members: list[list[int]] = []
    group = [0] * n
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        by_symbol.setdefault(c, []).append(i)
    for c in sorted(by_symbol):
        for i in by_symbol[c]:
            group[i] = len(members)
        members.append(by_symbol[c])
    size = [len(m) for m in members]
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members) + 1))
    pointer, taken, falling = [-1] * n, bytearray(n), []
    g = len(members) - 1
    while g >= 0:
        own = sorted(i for i in members[g] if group[i] == g)
        for i in own:
            taken[i] = 1
        hits: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and taken[p]:
                p = pointer[p]
            pointer[i] = p
            if p >= 0:
                hits[p] = hits.get(p, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for p, c in hits.items():
            moves.setdefault((-c, group[p]), []).append(p)
        for (_, h), places in sorted(moves.items()):
            if len(places) == size[h]:
                continue  # the whole group moves: it stays what it is
            new = len(members)
            members.append(places)
            size.append(len(places))
            size[h] -= len(places)
            below.append(h)
            above.append(above[h])
            below[above[h]] = new
            above[h] = new
            for p in places:
                group[p] = new
        falling.append(own)
        g = below[g]
    free, where, at = [], [0] * n, 0
    for k, own in enumerate(reversed(falling)):
        free.append(at)
        at += len(own)
        for i in own:
            where[i] = k
    out, settled = [0] * n, bytearray(n)
    out[0] = n - 1
    settled[n - 1] = 1
    for r in range(n):
        p = out[r] - 1
        while p >= 0 and not settled[p]:
            k = where[p]
            out[free[k]] = p
            free[k] += 1
            settled[p] = 1
            p = pointer[p]
    return out


def neighbour_prefixes(s: Sequence[int], sa: Sequence[int]) -> tuple[list[int], list[int]]:
    """(rank of each suffix, symbols that the suffixes of rank r - 1 and r share at the front)."""
    n = len(s)
    rank = [0] * n
    for r, i in enumerate(sa):
        rank[i] = r
    shared, h = [0] * (n + 1), 0
    for i in range(n):
        if rank[i] == 0:
            h = 0
            continue
        j = sa[rank[i] - 1]
        while i + h < n and j + h < n and s[i + h] == s[j + h]:
            h += 1
        shared[rank[i]] = h
        h = max(h - 1, 0)
    return rank, shared


def _common(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    diff = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return n - (diff.bit_length() + 7) // 8


def partings(texts: Sequence[bytes]) -> list[int]:
    """Where any two of ``texts`` part, rising. Of sorted texts any two part
    where some neighbours between them do."""
    kinds = sorted(set(texts))
    return sorted({_common(x, y) for x, y in zip(kinds, kinds[1:])} - {0})


def _runs(text: bytes, cuts: Sequence[int]) -> list[int]:
    """Ends of the runs of ``text`` between ``cuts``."""
    ends = [c for c in cuts if c < len(text)]
    return [*ends, len(text)] if text else ends


def repeated_windows(groups: Sequence[Sequence[tuple[bytes, int]]], length: int) -> list[list[list[tuple[int, int]]]]:
    """For each (fragment, place of its anchor) of each group the byte spans
    of its windows that stand in another fragment of the group.

    The fragments of a group are laid on their anchor. Bytes between two
    places where no fragments part are one symbol, told apart by place and
    content, so two fragments agree on all of a run or part at its start.
    The string of a fragment is its runs from the leftmost on and an end of
    its own; one suffix array holds all strings. The suffix at left run t
    shares r runs on the right of the anchor with a neighbour: then the windows
    that begin in run t and end within those r runs stand there as well.
    """
    string: list[int] = []
    layout = []
    fresh = 1
    for group in groups:
        lefts = [body[:anchor][::-1] for body, anchor in group]
        rights = [body[anchor:] for body, anchor in group]
        left_cuts, right_cuts = partings(lefts), partings(rights)
        symbols: dict[tuple[int, bytes], int] = {}
        for left, right in zip(lefts, rights):
            le, ri = _runs(left, left_cuts), _runs(right, right_cuts)
            layout.append((len(string), le, ri))
            part = []
            for side, text, ends in ((-1, left, le), (1, right, ri)):
                at = 0
                for t, end in enumerate(ends, 1):
                    key = (side * t, text[at:end])
                    if key not in symbols:
                        symbols[key] = fresh
                        fresh += 1
                    part.append(symbols[key])
                    at = end
            string += part[: len(le)][::-1] + part[len(le) :] + [fresh]
            fresh += 1
    string.append(0)
    rank, shared = neighbour_prefixes(string, suffix_array(string))
    out, k = [], 0
    for group in groups:
        found = []
        for body, anchor in group:
            base, le, ri = layout[k]
            k += 1
            spans = []
            first = max(0, anchor - (len(body) - length))  # the last window begins this far before the anchor
            for t in range(len(le) + 1):
                r = rank[base + len(le) - t]
                runs = max(shared[r], shared[r + 1]) - t
                if runs <= 0:
                    continue
                near = max(first, 0 if t == 0 else (le[t - 2] if t > 1 else 0) + 1, length - ri[runs - 1])
                far = 0 if t == 0 else le[t - 1]
                if near <= far:
                    spans.append((anchor - far, anchor - near + length))
            found.append(spans)
        out.append(found)
    return out


# ---------------------------------------------------------------------------
# Fragments
# ---------------------------------------------------------------------------


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest key of every ``width`` neighbours."""
    out, have = keys, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def fragments(data: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """(first window, anchor, last window + 1, hash of the anchor) of every
    fragment, as places in ``data``; no window crosses a text's end."""
    up, down = textops._power_tables()
    n = len(data)
    late = np.zeros(n + 1, dtype=np.int32)  # windows that begin here would cross an end
    ends = offsets[1:][np.diff(offsets) > 0]
    begins = offsets[:-1][np.diff(offsets) > 0]
    np.add.at(late, np.maximum(begins, ends - length + 1), 1)
    np.add.at(late, ends, -1)
    valid = np.cumsum(late[:-1]) == 0
    parts = []
    for at in range(0, n - length + 1, BLOCK):
        seg = data[at : at + BLOCK + length - 1].astype(np.uint64)
        seg += np.uint64(1)
        seg *= up[: len(seg)]
        sums = np.empty(len(seg) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(seg, out=sums[1:])
        grams = textops.mix((sums[k:] - sums[:-k]) * down[: len(seg) - k + 1])
        keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        least = (_smallest(keys, length - k + 1) & _PLACE).astype(np.int64)
        ok = np.flatnonzero(valid[at : at + len(least)])
        if not len(ok):
            continue
        a = least[ok]
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (ok[1:] != ok[:-1] + 1)])
        last = np.r_[new[1:], len(ok)] - 1
        parts.append((ok[new] + at, a[new] + at, ok[last] + at + 1, grams[a[new]].view(np.int64)))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _occurrence_batch(row, lo, anchor, size, khash, prints, w) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(row, pa.int64()), pa.array(lo, pa.int32()), pa.array(anchor, pa.int32()), pa.array(size, pa.int32()),
         pa.array(khash, pa.int64()), pa.array(prints, pa.int64()), pa.array(w, pa.int64())],
        names=["row", "lo", "anchor", "size", "khash", "print", "w"],
    )


def _cutter(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in textops.text_slices(batch, "data"):
                data, offsets = textops.text_bytes(b.column(1))
                first, anchor, stop, khash = fragments(data, offsets, length, k)
                owner = np.searchsorted(offsets, first, side="right") - 1
                end = stop + length - 1
                view = memoryview(np.ascontiguousarray(data))
                prints = np.fromiter((xxhash.xxh3_64_intdigest(view[s:e]) for s, e in zip(first.tolist(), end.tolist())),
                                     dtype=np.uint64, count=len(first)).view(np.int64)
                rows = np.asarray(b.column(0))[owner]
                yield _occurrence_batch(rows, first - offsets[owner], anchor - first, end - first, khash, prints, np.ones(len(first), np.int64))

    return run


def _finer(length: int, width: int):
    """Pieces of ``width`` windows of a fragment, dealt by the bytes that all
    windows of a piece share; pieces are laid on the anchor as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = ([], [], [], [], [], [], [])
            for row, body, cuts in zip(*(b.column(i).to_pylist() for i in range(3))):
                for c in cuts:
                    lo, anchor, size, khash, w = c["lo"], c["anchor"], c["size"], c["khash"], c["w"]
                    text = body[lo : lo + size]
                    nearest = anchor - (size - length)  # how far before the anchor the last window begins
                    for j in range(nearest // width, anchor // width + 1):
                        far, near = min(anchor, j * width + width - 1), max(nearest, j * width)
                        s, e = anchor - far, anchor - near + length
                        core = text[anchor - j * width : anchor - (j * width + width - 1) + length]
                        mixed = xxhash.xxh3_64_intdigest(core, seed=(khash * 1_000_003 + j) & ((1 << 64) - 1))
                        values = (row, lo + s, anchor - s, e - s, mixed, xxhash.xxh3_64_intdigest(text[s:e]), w)
                        for col, v in zip(out, values):
                            col.append(v)
            yield _occurrence_batch(*out[:4], np.array(out[4], np.uint64).view(np.int64), np.array(out[5], np.uint64).view(np.int64), out[6])

    return run


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(row, c["khash"], c["w"], c["lo"], c["anchor"], body[c["lo"] : c["lo"] + c["size"]])
                for row, body, cuts in zip(*(b.column(i).to_pylist() for i in range(3))) for c in cuts]
        cols = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()),
             pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.binary())],
            names=["row", "khash", "w", "lo", "anchor", "body"],
        )


def _sorter(length: int):
    def run(table: pa.Table) -> pa.Table:
        groups: dict[int, list] = {}
        for row, khash, w, lo, anchor, body in zip(*(table.column(c).to_pylist() for c in ("row", "khash", "w", "lo", "anchor", "body"))):
            groups.setdefault(khash, []).append((row, w, lo, anchor, body))
        order = list(groups.values())
        found = repeated_windows([[(body, anchor) for *_, anchor, body in g] for g in order], length)
        rows = [(row, lo + s, lo + e) for g, marks in zip(order, found)
                for (row, w, lo, _, _), spans in zip(g, marks) if w == 1 for s, e in spans]
        cols = list(zip(*rows)) or [()] * 3
        return pa.table({"row": pa.array(cols[0], pa.int64()), "s": pa.array(cols[1], pa.int32()), "e": pa.array(cols[2], pa.int32())})

    return run


# ---------------------------------------------------------------------------
# The corpus
# ---------------------------------------------------------------------------


def _with_texts(cuts: DataFrame, texts: DataFrame) -> DataFrame:
    """(row, data, cuts): each text with all that is cut out of it."""
    own = cuts.groupBy("row").agg(F.collect_list(F.struct("khash", "w", "lo", "anchor", "size")).alias("cuts"))
    return texts.join(own, "row").select("row", "data", "cuts")


def repeated_spans(texts: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(row, s, e): byte spans of ``texts`` (row, data) that are covered by
    ``length``-byte strings standing anywhere else; spans may overlap."""
    k = max(4, length * 8 // 25)
    level = scratch.keep(texts.where(F.octet_length("data") >= length).mapInArrow(_cutter(length, k), OCCURRENCE))
    covered = ["row", F.col("lo").alias("s"), (F.col("lo") + F.col("size")).alias("e")]
    spans = []
    for width in (*FINER, None):
        met = scratch.keep(
            level.groupBy("khash").agg(F.sum("w").alias("c"), F.count("*").alias("rows"), F.min("print").alias("p"), F.max("print").alias("q"))
            .where("c > 1").select("khash", "rows", (F.col("p") == F.col("q")).alias("equal"))
        )
        several = scratch.keep(skew_join(level, met, "khash", "rows", level.count()).drop("rows"))
        scratch.drop(level, met)
        spans.append(several.where("equal").select(*covered))
        apart = several.where("not equal").drop("equal")
        kinds = scratch.keep(
            apart.groupBy("khash", "print").agg(F.sum("w").alias("w"), F.count("*").alias("rows"), F.min(F.struct("row", "lo", "anchor", "size")).alias("at"))
        )
        again = kinds.where("rows > 1").select("khash", "print", "rows")
        spans.append(skew_join(apart, again, ["khash", "print"], "rows", apart.count()).select(*covered))
        groups = kinds.groupBy("khash").agg(F.count("*").alias("m"))
        large = scratch.keep(groups.where(F.col("m") > GROUP))  # fewer than one in GROUP
        sizes = large.count()
        few = kinds.select("khash", "w", "at.*")
        if sizes:
            few = few.join(small(large, sizes), "khash", "left_anti")
        total = few.agg(F.sum("size")).first()[0] or 0
        if total:
            buckets = -(-total // TASK_BYTES)
            bodies = _with_texts(few, texts).mapInArrow(_bodies, "row long, khash long, w long, lo int, anchor int, body binary")
            spans.append(
                bodies.groupBy(F.pmod(F.xxhash64("khash"), F.lit(buckets)).alias("bucket"))
                .applyInArrow(_sorter(length), "row long, s int, e int")
            )
        if width is None or not sizes:
            break
        many = kinds.select("khash", "w", "at.*").join(small(large, sizes), "khash", "left_semi")
        level = scratch.keep(_with_texts(many, texts).mapInArrow(_finer(length, width), OCCURRENCE))
    out = spans[0]
    for more in spans[1:]:
        out = out.union(more)
    return out


def _removal(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, count, sha, kept = [], [], [], [], []
            for data, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                data = data or b""
                digest, at, gone, runs, rest = hashlib.sha256(), 0, 0, 0, []
                end = -1
                for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
                    if s > end:
                        runs += 1
                        digest.update(data[max(at, 0) : s])
                        if texts:
                            rest.append(data[at:s])
                    gone += max(0, e - max(s, end))
                    end = at = max(end, e)
                digest.update(data[at:])
                n.append(len(data))
                removed.append(gone)
                count.append(runs)
                sha.append(digest.hexdigest())
                if texts:
                    kept.append(b"".join(rest) + data[at:])
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if texts:
                cols, names = [*cols, pa.array(kept, pa.binary())], [*names, "kept_bytes"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def suffix_dedup(docs: DataFrame, length: int = 200, texts: bool = False) -> DataFrame:
    """Remove from each text the bytes covered by ``length``-byte strings that
    also start anywhere else, in the same or another document.

    Returns a row per document: ``doc_id, n_bytes, n_removed, n_spans``
    (maximal removed runs) and ``kept_sha256`` of the remaining bytes joined;
    with ``texts`` also these, ``kept_bytes``. Texts are UTF-8 bytes as they
    are; strings are judged on the input, not on what is left, and may overlap.
    Matches never cross documents.

    A null text is empty. A text shorter than ``length`` loses nothing. Rows
    are documents of their own, also with equal, repeated or null ids, so a
    repeated row's text goes as far as it is long enough. Fragments are called
    equal by two 64-bit hashes (anchor and whole fragment); all other decisions
    compare bytes. An anchor with more than ``GROUP`` different fragments has
    them cut into pieces of fewer windows, dealt by the bytes these share, down
    to single windows, so no task holds a hot passage whole. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "suffix-dedup")
    kept = scratch.keep(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").cast("binary").alias("data")))
    spans = repeated_spans(kept.select("row", "data"), length, scratch)
    per_row = spans.groupBy("row").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_bytes binary" if texts else "")
    return scratch.result(kept.join(per_row, "row", "left").select("doc_id", "data", "spans").mapInArrow(_removal(texts), schema))
