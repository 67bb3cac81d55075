"""Near-duplicate documents: exact Jaccard join of word shingles with adaptive
multi-match prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faretrail.llm import textops as X
from faretrail.llm.common import prepare, Scratch, semi_join, skew_join
from faretrail.llm.graph import connected_components
from faretrail.llm.prefix_filter import Rule, rarest_first, rarity, shared_prefix_counts

#: Prefix lengths in turn, as tokens to share per mille of a set's size.
BASE, LONG, WHOLE = 50, 250, 1000
#: Candidate rows per prefix token up to which a document's partners are listed.
CHEAP = 4
#: Rounds in which each document is compared with its likeliest partner.
STARS = 2


def _sets(b: pa.RecordBatch, k: int):
    """(tokens, text index, sizes, digests) of the shingle sets of a slice."""
    raw, offsets = X.text_bytes(b.column(1))
    data = X.LOWER[raw]
    starts, ends, text = X.word_bounds(data, offsets)
    tokens, owner = X.distinct_sorted(*X.shingle_hashes(X.span_hashes(data, starts, ends), text, k))
    size = np.bincount(owner, minlength=b.num_rows)
    some = np.flatnonzero(size)
    d1, d2 = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64)
    d1[some], d2[some] = X.set_digests(tokens, (np.cumsum(size) - size)[some])
    return tokens, owner, size, d1, d2


def _records(k: int, rule: Rule):
    def run(whole: pa.RecordBatch):
        for b in X.text_slices(whole, "text"):
            tokens, owner, size, d1, d2 = _sets(b, k)
            place = np.arange(len(tokens)) - (np.cumsum(size) - size)[owner]
            inside = place < rule.prefix(size)[owner]
            columns = [b.column(0), pa.array(size.astype(np.int32)), X.digest_column(d1, d2)]
            yield columns, d1, tokens[inside], owner[inside]

    return run


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in X.text_slices(whole, "text"):
                tokens, _, size, d1, d2 = _sets(b, k)
                ends = np.r_[0, np.cumsum(size)].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [X.digest_column(d1, d2), pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens.view(np.int64)))], names=["key", "toks"]
                )

    return run


class _Join:
    """Components of a table of distinct sets (id, n, toks)."""

    def __init__(self, sets: DataFrame, rule: Rule, scratch: Scratch):
        self.sets, self.rule, self.scratch = sets, rule, scratch
        self.comps = scratch.keep(sets.select("id", F.col("id").alias("comp")))
        self.cells = rarity(sets)

    def _postings(self, sets: DataFrame, rule: Rule) -> DataFrame:
        """Prefixes in rarity order (tok, id, n, pos), of tokens that two sets post."""
        rows = rarest_first(sets, self.cells, rule, ["id", "n"])
        again = rows.groupBy("tok").count().where("count > 1").select("tok")
        return self.scratch.keep(rows.join(again, "tok", "left_semi"))

    def _foreign(self, postings: DataFrame) -> DataFrame:
        """Postings whose token another component posted too, with the number
        and the sizes of the sets that posted it."""
        rows = postings.join(self.comps, "id")
        stats = (
            rows.groupBy("tok").agg(
                F.count("*").alias("cnt"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("nlo"), F.max("n").alias("nhi")
            ).where("lo <> hi").select("tok", "cnt", "nlo", "nhi")
        )
        return rows.join(stats, "tok")

    def _able(self, foreign: DataFrame, rule: Rule) -> DataFrame:
        """(id, n, m, cost): sets that share enough tokens with other components
        for a link to exist, and the rows that listing their partners takes."""
        n, lo, hi = F.col("n"), F.col("ylo"), F.col("yhi")
        per = (
            foreign.groupBy("id").agg(
                F.first("n").alias("n"), F.count("*").alias("m"), F.sum(F.col("cnt") - 1).alias("cost"),
                F.min("nlo").alias("nlo"), F.max("nhi").alias("nhi"),
            )
            .withColumn("ylo", F.greatest(F.col("nlo"), rule.c_least(n)))
            .withColumn("yhi", F.least(F.col("nhi"), rule.c_most(n)))
            .where("ylo <= yhi")
        )
        # the smaller need lies at an end of the range of partner sizes, up to rounding
        need = F.least(rule.c_need(n, lo), rule.c_need(n, hi)) - (0 if rule.per_mille == WHOLE else 2)
        return per.where(F.col("m") >= need).select("id", "n", "m", "cost")

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """Links (a, b) among pairs (a, b) by their whole sets."""
        left = self.sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta"))
        right = self.sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb"))
        both = F.size(F.array_intersect("ta", "tb"))
        return (
            pairs.join(right, "b").join(left, "a")
            .where(both * self.rule.b >= (F.col("na") + F.col("nb") - both) * self.rule.a).select("a", "b")
        )

    def _merge(self, pairs: DataFrame) -> None:
        links = self.scratch.keep(self._verify(pairs))
        if not links.isEmpty():
            ca = self.comps.select(F.col("id").alias("a"), F.col("comp").alias("ca"))
            cb = self.comps.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
            ends = links.join(ca, "a").join(cb, "b").select("ca", "cb")
            moved = connected_components(ends, self.scratch, "ca", "cb").select(F.col("node").alias("comp"), "component")
            old = self.comps
            self.comps = self.scratch.keep(
                old.join(moved, "comp", "left").select("id", F.coalesce("component", "comp").alias("comp"))
            )
            self.scratch.drop(old)
        self.scratch.drop(links)

    def _star(self, postings: DataFrame, rule: Rule) -> None:
        """Compare each set with one of another component: of the sets that
        share most of their own prefix, the one that shares most with it. This
        joins cohesive groups by as many pairs as they have members."""
        foreign = self.scratch.keep(self._foreign(postings))
        able = self.scratch.keep(self._able(foreign, rule))
        rows = foreign.join(able.select("id", (F.col("m") / rule.c_prefix(F.col("n"))).alias("share")), "id")
        lead = rows.groupBy("tok").agg(F.max(F.struct("share", "id", "n", "comp")).alias("lead"))
        x, y = F.col("n"), F.col("lead.n")
        counted = (
            rows.join(lead, "tok").where((F.col("comp") != F.col("lead.comp")) & rule.c_fits(x, y))
            .groupBy(F.col("id").alias("a"), F.col("lead.id").alias("b")).agg(F.count("*").alias("c"), F.first(rule.c_need(x, y)).alias("need"))
            .where("c >= need")
        )
        self._merge(counted.groupBy("a").agg(F.max(F.struct("c", "b")).alias("best")).select("a", F.col("best.b").alias("b")))
        self.scratch.drop(foreign, able)

    def _listed(self, rows: DataFrame, matches: int) -> DataFrame:
        """Pairs of sets of different components that can be linked, at least
        one of them ``cheap``, from rows (tok, id, n, pos, comp, cheap, cap).

        Two sets that must share o tokens have ``matches`` of them among the
        first n - o + matches of either. A row is made if its token stands
        there in both, if neither set shares fewer tokens than o with others
        (``cap``), and if the places leave room for o shared tokens: as many
        before as stand before both, as many after as the shorter rest has.
        """
        l, r = rows.where("cheap").alias("l"), rows.alias("r")
        x, y, i, j = F.col("l.n"), F.col("r.n"), F.col("l.pos"), F.col("r.pos")
        o = self.rule.c_overlap(x, y)
        once = ~F.col("r.cheap") | (F.col("l.id") < F.col("r.id"))
        early = (i < x - o + matches) & (j < y - o + matches)
        room = (F.least(i, j) + F.least(x - i, y - j) >= o) & (F.least("l.cap", "r.cap") >= o)
        return (
            l.join(r, (F.col("l.tok") == F.col("r.tok")) & (F.col("l.comp") != F.col("r.comp")) & once & self.rule.c_fits(x, y) & early & room)
            .groupBy(F.col("l.id").alias("a"), F.col("r.id").alias("b")).agg(F.count("*").alias("c"))
            .where(F.col("c") >= matches).select("a", "b")
        )

    def _prune(self, ids: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
        """(ids, foreign postings): what is left of sets that must share enough
        of longer prefixes with each other. Each one that is done may be what
        kept another, so this is repeated, on the postings that are left, while
        it pays. ``ids`` get ``cap``, the tokens shared with other components."""
        scratch = self.scratch
        rows = self._postings(self.sets.join(ids, "id", "left_semi"), rule)
        left = ids.count()
        while True:
            foreign = scratch.keep(self._foreign(rows))
            fewer = scratch.keep(self._able(foreign, rule).select("id", F.col("m").alias("cap")))
            now = fewer.count()
            scratch.drop(rows, ids)
            if not now or now > 0.8 * left:
                return fewer, foreign
            rows = foreign.join(fewer.select("id"), "id", "left_semi").select("tok", "id", "n", "pos")
            rows, ids, left = scratch.keep(rows), fewer, now
            scratch.drop(foreign)

    def run(self) -> DataFrame:
        """(id, comp): short prefixes first; sets whose candidates would cost
        too much get longer ones, which must share more, until few are left."""
        base, long, whole = (Rule(self.rule.a, self.rule.b, m) for m in (BASE, LONG, WHOLE))
        postings = self._postings(self.sets, base)
        for _ in range(STARS):
            self._star(postings, base)
        foreign = self.scratch.keep(self._foreign(postings))
        able = self.scratch.keep(self._able(foreign, base).withColumn("cheap", F.col("cost") <= base.c_prefix(F.col("n")) * CHEAP))
        dear = self.scratch.keep(able.where("not cheap").select("id"))
        rows = foreign.join(able.select("id", "cheap"), "id").withColumn("cap", F.col("n"))
        self._merge(self._listed(rows, 1))
        self.scratch.drop(foreign, able, postings)
        for rule in (long, whole):
            if dear.isEmpty():
                return self.comps
            dear, foreign = self._prune(dear, rule)
        self._merge(self._listed(foreign.join(dear, "id").withColumn("cheap", F.lit(True)), 2))
        return self.comps


def ngram_components(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """Group documents whose sets of ``k``-word shingles have a Jaccard
    similarity of at least ``threshold`` (a fraction), directly or in chains.

    Returns a row per input row: ``doc_id, n_shingles, component_id`` (the
    smallest id reachable by links, its own included).

    Words are runs of characters other than ASCII white space, A-Z lower-cased;
    a text of fewer than ``k`` words is one shingle, a text without words has
    none and links with nothing. Shingles are 64-bit hashes, sets are told
    apart by 128-bit digests; equal sets are one node from the start.

    1. Every set posts a short prefix in hash order; sets that share fewer
       tokens with all others than a link needs are done (``prefix_filter``).
    2. The rest is read again into a table of whole sets, which post prefixes
       in rarity order. Each set is compared with its likeliest partner, which
       joins cohesive groups.
    3. Sets that can still link to another component list their candidates if
       that is estimated to take few rows. The others lengthen their prefix, at
       last to the whole set, and must share correspondingly more tokens of it;
       those that can't are done, the rest list their candidates.
    Every listed pair is verified by its whole sets. No pair inside a component
    is listed, and no step gathers a bucket in one task.

    A null text is empty. Rows with equal texts, repeated rows too, share a
    node; a row without an id belongs to its component but cannot name it (null
    if no other row does). An empty table gives an empty result. Other columns
    are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "ngram-join")
    rule = Rule(*threshold, BASE)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fields = [("doc_id", "long", pa.int64()), ("n", "int", pa.int32()), ("key", "binary", pa.binary())]
    rows, counts = shared_prefix_counts(src, fields, _records(k, rule), scratch)
    classes = rows.where("n > 0").groupBy("key").agg(F.first("owner").alias("owner"), F.first("n").cast("long").alias("n"), F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    # a partner may be smaller, and then has to match fewer tokens
    able = classes.join(counts, "owner").where(F.col("shared") >= rule.c_matches(rule.c_least(F.col("n"))))
    tie = Window.partitionBy("owner").orderBy("key")
    able = scratch.keep(able.withColumn("id", F.col("owner") + F.row_number().over(tie) - 1).select("id", "key", "n", "rep"))
    texts = semi_join(src, able.where("rep is not null").select(F.col("rep").alias("doc_id")), "doc_id").union(src.where("doc_id is null"))
    sets = scratch.keep(
        texts.mapInArrow(_set_rows(k), "key binary, toks array<long>").join(able.select("id", "key", "n"), "key")
        .dropDuplicates(["id"]).select("id", "n", "toks")
    )
    comps = _Join(sets, rule, scratch).run()
    node = scratch.keep(classes.select("key", "rep", "copies").join(able.select("key", "id"), "key", "left").join(comps, "id", "left"))
    grouped = node.where("comp is not null").select("key", "rep", "copies", "comp")
    first = grouped.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count("*").alias("members"))
    named = scratch.keep(
        skew_join(grouped, first, "comp", "members", node.count()).select("key", "copies", "component_id")
        .union(node.where("comp is null").select("key", "copies", F.col("rep").alias("component_id")))
    )
    some = skew_join(rows.where("n > 0").select("doc_id", "n", "key"), named, "key", "copies", rows.count())
    none = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return some.select("doc_id", "n", "component_id").union(none).select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def first_of_groups(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, with its columns, without those of documents that are
    linked to one with a smaller id."""
    gone = ngram_components(docs, **options).where("component_id < doc_id").select(F.col("doc_id").alias("_d")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_d"], "left_anti").select(*docs.columns)


SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS g FROM t
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)
), r(doc_id, m) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT l.b, r.m FROM r JOIN (SELECT x AS a, y AS b FROM e UNION ALL SELECT y, x FROM e) l ON l.a = r.doc_id WHERE r.m < l.b
)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.m) AS component_id
FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""
