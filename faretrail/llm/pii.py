"""Personal data by bootstrapped contextual extraction (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faretrail.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Runs are possessive and start at their first character,
#: which finds the same matches without trying every tail of a long run; after
#: a match (\G) an address may start inside a run, as a leftmost search would.
_LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_PART = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Words (runs without white space) that hold a digit or an at sign, and runs
#: of such words with single spaces between them.
_SPACE = r"\x20\x09-\x0D"
_WORD = rf"[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+"
RUN = rf"(?<![^{_SPACE}]){_WORD}(?: {_WORD})*+"
#: Numbers of words that candidates always have, besides those of the seeds,
#: and characters looked at on either side.
USUAL, CONTEXT = (1, 2, 3, 4), 48
#: Digits of an identifier at most (a card's). Each word of a candidate holds a
#: digit or an at sign, so longer stretches of words hold no single identifier.
MOST_DIGITS = 19
_OPEN, _CLOSE = r"""["'(\[{<]""", r"""[.,;:!?"')\]}>]"""
#: Opening marks before an identifier; a bracket around its first digits is its own.
_LEAD = r"""^(?:["'\[{<]|\((?![0-9+]++\)[ .-]?[0-9]))*+"""
#: Words after and before which a stretch of words ends.
_ENDS, _BEGINS = r"""[.,;:!?"'\]}>]$|^[^(]*+\)$""", r"""^["'\[{<]"""


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _passes(kind: Column, s: Column) -> Column:
    digits = F.regexp_replace(s, "[^0-9]", "")
    count = F.length(digits)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", s.rlike(rf"^{_PART}(\.{_PART}){{3}}$"))
        .when(kind == "card", F.when(count.between(12, 19), _luhn(digits)).otherwise(False))
        .otherwise(count.between(9, 15))
    )


def _matches(text: Column, pattern: str, tag: str) -> Column:
    """Matches in order with the text around them, which gives their places.
    The arrays are zipped, not indexed, so each is made once per text; the text
    around a match reaches into the matches beside it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def tail(c: Column) -> Column:
        return F.substring(c, F.greatest(F.length(c) - CONTEXT + 1, F.lit(1)), F.lit(CONTEXT))

    def head(c: Column) -> Column:
        return F.substring(c, F.lit(1), F.lit(CONTEXT))

    gaps = F.zip_with(between, F.concat(F.array(F.lit("")), found), lambda gap, last: F.struct(
        F.length(gap).alias("gap"), tail(F.concat(tail(last), tail(gap))).alias("before"),
    ))
    zipped = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("s"), g["gap"].alias("gap"), g["before"].alias("before")))
    rest = F.zip_with(F.slice(between, 2, 1 << 30), F.slice(found, 2, 1 << 30), lambda gap, m: head(F.concat(head(gap), head(F.coalesce(m, F.lit(""))))))
    after = F.zip_with(zipped, rest, lambda x, beyond: F.struct(
        x["s"].alias("s"), x["gap"].alias("gap"), x["before"].alias("before"), beyond.alias("after"),
    ))
    numbered = F.transform(after, lambda x, i: F.struct(
        F.lit(tag).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["s"].alias("s"), x["before"].alias("before"), x["after"].alias("after"),
    ))
    return F.when(text.rlike(pattern), F.filter(numbered, lambda x: x["s"].isNotNull())).otherwise(F.array())


def _placed(rows: DataFrame, per: list[str]) -> DataFrame:
    """Add ``start`` and ``end`` (code points) to matches exploded in order."""
    w = Window.partitionBy(*per).orderBy("i")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    start = F.sum("gap").over(w) + F.coalesce(F.sum(F.length("s")).over(past), F.lit(0))
    return rows.withColumn("start", start.cast("long")).withColumn("end", F.col("start") + F.length("s"))


def _last_word(before: Column) -> Column:
    return F.regexp_extract(before, rf"([^{_SPACE}]++)[{_SPACE}]*$", 1)


def _first_word(after: Column) -> Column:
    return F.regexp_extract(after, rf"^[{_SPACE}]*+([^{_SPACE}]++)", 1)


def base_spans(texts: DataFrame) -> DataFrame:
    """(key, kind, start, end, s, left, right): the base matches of distinct
    texts (key, text), with the words on either side."""
    hits = F.concat(*[_matches(F.col("text"), BASE[k], k) for k in KINDS])
    rows = texts.select("key", F.explode(hits).alias("m")).select("key", "m.kind", "m.i", "m.gap", "m.s", "m.before", "m.after")
    left = _last_word(F.regexp_replace("before", rf"{_OPEN}++$", ""))
    right = _first_word(F.regexp_replace("after", rf"^{_CLOSE}++(?=[{_SPACE}]|$)", ""))
    return _placed(rows, ["key", "kind"]).where(_passes(F.col("kind"), F.col("s"))).select(
        "key", "kind", "start", "end", "s", left.alias("left"), right.alias("right")
    )


def seed_lengths(base: DataFrame) -> list[int]:
    """Numbers of words of the base spans whose every word holds a digit or an
    at sign (others cannot equal a candidate); at most ``MOST_DIGITS`` values."""
    words = F.split("s", " ", -1)
    whole = base.where(F.forall(words, lambda w: w.rlike("[0-9@]")))
    return [r["n"] for r in whole.select(F.size(words).alias("n")).distinct().where(F.col("n") <= MOST_DIGITS).collect()]


def candidate_spans(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """(key, start, end, s, left, right, bounded): neighbouring words that hold
    a digit or an at sign, without quotes and punctuation around them, and the
    words on either side.

    There are candidates of each number of words in ``lengths``, and those that
    fill all of a stretch between other words or punctuation, of any number of
    words; these are ``bounded``.
    """
    runs = _placed(
        texts.select("key", F.explode(_matches(F.col("text"), RUN, "run")).alias("m")).select("key", "m.i", "m.gap", "m.s", "m.before", "m.after"),
        ["key"],
    )
    words = runs.select("key", "i", "start", "before", "after", F.posexplode(F.split("s", " ", -1)).alias("j", "word"))
    run = Window.partitionBy("key", "i").orderBy("j")
    at = F.col("start") + F.coalesce(F.sum(F.length("word") + 1).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parted = F.coalesce(F.lag("word").over(run).rlike(_ENDS), F.lit(False)) | F.col("word").rlike(_BEGINS)
    words = (
        words.withColumn("at", at)
        .withColumn("previous", F.coalesce(F.lag("word").over(run), _last_word(F.col("before"))))
        .withColumn("parted", parted.cast("int"))
        .withColumn("stretch", F.sum("parted").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    )
    for n in range(1, max(lengths) + 1):
        words = words.withColumn(f"w{n}", F.lead("word", n).over(run))
    first_after = _first_word(F.col("after"))
    spans = []
    for n in sorted(lengths):
        joined = F.concat_ws(" ", "word", *[F.col(f"w{k}") for k in range(1, n)])
        spans.append(F.when(
            F.lit(True) if n == 1 else F.col(f"w{n - 1}").isNotNull(),
            F.struct(joined.alias("raw"), F.coalesce(F.col(f"w{n}"), first_after).alias("right")),
        ))
    some = words.select("key", "at", F.col("previous").alias("left"), F.explode(F.array(*spans)).alias("c")).where("c is not null").select(
        "key", "at", "left", "c.raw", "c.right", F.lit(False).alias("bounded")
    )
    whole = (
        words.groupBy("key", "i", "stretch").agg(
            F.min("at").alias("at"), F.min_by("previous", "j").alias("left"), F.max_by(F.coalesce(F.col("w1"), first_after), "j").alias("right"),
            F.sort_array(F.collect_list(F.struct("j", "word"))).alias("all"),
        ).where(F.size("all") <= MOST_DIGITS)
        .select("key", "at", "left", F.array_join(F.transform("all", lambda x: x["word"]), " ").alias("raw"), "right", F.lit(True).alias("bounded"))
    )
    out = (
        some.union(whole)
        .withColumn("lead", F.regexp_extract("raw", _LEAD, 0))
        .withColumn("s", F.regexp_replace(F.expr("substring(raw, length(lead) + 1)"), rf"{_CLOSE}++$", ""))
        .withColumn("start", F.col("at") + F.length("lead"))
        .withColumn("end", F.col("start") + F.length("s"))
    )
    return out.where("length(s) > 0").select("key", "start", "end", "s", "left", "right", "bounded")


def patterns_of(spans: DataFrame) -> DataFrame:
    """(pattern, s): the lexical patterns that a span's occurrences give.

    ``S`` its shape (every digit as 9, runs of letters as a); ``L`` and ``R``
    the word before or after it with its coarse shape (runs of digits as 9);
    ``B`` both neighbouring words with its coarse shape. ``C`` and ``W`` are
    context alone: both neighbouring words, or the one before, whatever the
    shape. Only ``bounded`` spans between words without digits give them, so
    that a span cannot take in a number beside it or leave a part out.
    """
    shape = F.regexp_replace(F.regexp_replace("s", "[0-9]", "9"), "[A-Za-z]++", "a")
    coarse = F.regexp_replace(shape, "9++", "9")
    left, right = F.lower(F.coalesce("left", F.lit(""))), F.lower(F.coalesce("right", F.lit("")))
    open_left = F.col("bounded") & (left != "") & ~left.rlike("[0-9@]")
    return spans.select(
        "s",
        F.explode(F.array(
            F.when(open_left & ~right.rlike("[0-9@]"), F.concat_ws(" ", F.lit("C"), left, right)),
            F.when(open_left, F.concat_ws(" ", F.lit("W"), left)),
            F.concat(F.lit("S "), shape),
            F.concat_ws(" ", F.lit("L"), left, coarse),
            F.concat_ws(" ", F.lit("R"), coarse, right),
            F.concat_ws(" ", F.lit("B"), left, coarse, right),
        )).alias("pattern"),
    ).where("pattern is not null").distinct()


def _plausible(kind: Column, s: Column) -> Column:
    """What context alone may make a kind: a phone of 7 to 15 digits (and an
    extension), a card of 12 to 19 digits without a check digit that fits, an
    address with an at sign or with dots or colons."""
    count = F.length(F.regexp_replace(s, "[^0-9]", ""))
    return (
        F.when(kind == "email", s.rlike("[^@]@[^@]") & ~s.contains(" "))
        .when(kind == "ip", s.rlike("^[0-9A-Fa-f]*(?:[.:][0-9A-Fa-f]*){2,}(?:/[0-9]+)?$"))
        .when(kind == "card", s.rlike("^[0-9][0-9 ./-]+$") & count.between(12, 19))
        .otherwise(s.rlike(r"^[+(]*[0-9][0-9 ()./-]+(?:(?:x|ext\.?) ?[0-9]+)?$") & count.between(7, 15))
    )


def bootstrap(edges: DataFrame, seeds: DataFrame, scratch: Scratch, rounds: int, support: int, trust: float) -> DataFrame:
    """(s, kind, shaped): strings that the pattern graph assigns to a kind;
    ``shaped`` if the patterns with a shape are enough for that.

    ``edges`` links patterns and strings, ``seeds`` (s, kind) are certain. In
    each round a pattern's confidence in a kind is the sum of its strings'
    confidence over the number of its strings plus one, and counts only with at
    least ``support`` confident strings; a string's confidence is one minus the
    product of its patterns' doubts. Strings below ``trust`` count as evidence
    against; without enough patterns with a shape, a string must be plausible. Every round is two aggregations and two joins on the graph's own
    keys, written out.
    """
    strings = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    belief = seeds.select("s", "kind", F.lit(1.0).alias("conf"), F.lit(True).alias("shaped")).distinct()
    certain = belief
    for _ in range(rounds):
        scored = (
            edges.join(belief, "s").groupBy("pattern", "kind")
            .agg(F.sum("conf").alias("good"), F.count("*").alias("hits"))
            .where(F.col("hits") >= support).join(strings, "pattern")
            .select("pattern", "kind", (F.col("good") / (F.col("n") + 1)).alias("conf"))
            .where(F.col("conf") >= 0.5)
        )
        doubt = F.log1p(-F.least("conf", F.lit(0.999)))
        by_shape = F.coalesce(F.sum(F.when(~F.col("pattern").rlike("^[CW] "), doubt)), F.lit(0.0))
        strings_scored = (
            edges.join(scored, "pattern").groupBy("s", "kind")
            .agg((1 - F.exp(F.sum(doubt))).alias("conf"), (1 - F.exp(by_shape) >= trust).alias("shaped"))
            .where((F.col("conf") >= trust) & (F.col("shaped") | _plausible(F.col("kind"), F.col("s"))))
        )
        best = strings_scored.groupBy("s").agg(F.max(F.struct("shaped", "conf", "kind")).alias("b")).select("s", "b.kind", "b.conf", "b.shaped")
        new = best.join(seeds.select("s").distinct(), "s", "left_anti")
        belief = scratch.keep(certain.union(new))
    return belief.join(seeds.select("s").distinct(), "s", "left_anti").select("s", "kind", "shaped")


def _clear_of(spans: DataFrame, fixed: DataFrame) -> DataFrame:
    """``spans`` that overlap none of ``fixed``: one sorted pass per text."""
    marks = spans.withColumn("_fixed", F.lit(False)).unionByName(fixed.select("key", "start", "end", F.lit(True).alias("_fixed")), allowMissingColumns=True)
    to_here = Window.partitionBy("key").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    # from the far end, so that the frame only grows
    beyond = Window.partitionBy("key").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, -1)
    return (
        marks.withColumn("_reach", F.max(F.when(F.col("_fixed"), F.col("end"))).over(to_here))
        .withColumn("_next", F.min(F.when(F.col("_fixed"), F.col("start"))).over(beyond))
        .where(~F.col("_fixed") & (F.coalesce("_reach", F.lit(0)) <= F.col("start")) & (F.coalesce("_next", F.lit(1 << 62)) >= F.col("end")))
        .drop("_fixed", "_reach", "_next")
    )


def _apart(spans: DataFrame) -> DataFrame:
    """(key, kind, start, end): by start, then the longer one, each span that
    overlaps none kept before it. Spans are compared within groups that
    overlap in a chain; the kept ones are gathered in blocks, as appending to
    one long array copies it each time."""
    order = Window.partitionBy("key").orderBy("start", F.desc("end"), "kind")
    past, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    chains = (
        spans.select("key", "kind", "start", "end").withColumn("_new", (F.coalesce(F.max("end").over(past), F.lit(0)) <= F.col("start")).cast("int"))
        .withColumn("_chain", F.sum("_new").over(upto))
        .groupBy("key", "_chain").agg(F.sort_array(F.collect_list(F.struct("start", (-F.col("end")).alias("o"), "kind", "end"))).alias("all"))
    )
    one = "struct<start:bigint,o:bigint,kind:string,end:bigint>"

    def keep(kept: Column, x: Column) -> Column:
        full = F.size(kept["block"]) >= 256
        return F.when(x["start"] >= kept["end"], F.struct(
            x["end"].alias("end"),
            F.when(full, F.array(x)).otherwise(F.concat(kept["block"], F.array(x))).alias("block"),
            F.when(full, F.concat(kept["blocks"], F.array(kept["block"]))).otherwise(kept["blocks"]).alias("blocks"),
        )).otherwise(kept)

    start = F.expr(f"struct(0L as end, cast(array() as array<{one}>) as block, cast(array() as array<array<{one}>>) as blocks)")
    kept = F.aggregate("all", start, keep, lambda k: F.concat(F.flatten(k["blocks"]), k["block"]))
    return chains.select("key", F.explode(kept).alias("x")).select("key", "x.kind", "x.start", "x.end")


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def _listed(which: Column) -> Column:
    """kind:start:end of spans, by start, then kind as listed."""
    got = F.sort_array(F.collect_list(F.when(which, F.struct("start", _order(F.col("kind")).alias("o"), "end", "kind"))))
    return F.concat_ws(",", F.transform(got, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def personal_data(docs: DataFrame, rounds: int = 3, support: int = 5, trust: float = 0.9) -> DataFrame:
    """Find e-mail and IP addresses, card and phone numbers in whole texts.

    Returns a row per input row: ``doc_id, n_email, n_ip, n_card, n_phone``
    (all spans), ``base_sha256`` (of the base spans), ``spans`` (all spans as
    kind:start:end, comma-joined), ``n_added`` and ``base_email, base_ip,
    base_card, base_phone`` (base spans only).

    The base spans are regular-expression matches that pass their kind's test.
    They are the seeds of the bootstrapping, with the words beside them;
    candidates are neighbouring words with digits or at signs
    (``candidate_spans``) that overlap no base span. The seeds' shapes and
    neighbouring words become patterns, patterns and strings are scored in
    turn (``bootstrap``), and occurrences of the accepted strings are added,
    first those that patterns with a shape support, unless an added span that
    starts earlier, or there and is longer, overlaps them.

    Each distinct text with a digit or an at sign is searched once, whatever
    the number of its copies; matches are placed by running sums over a text's
    own matches. A null text is empty and has no spans; repeated rows get the
    same result; an empty table gives an empty result. Other columns are not
    read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pii")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = src.withColumn("key", F.sha2("text", 256))
    texts = scratch.keep(keyed.where(F.col("text").rlike("[0-9@]")).select("key", "text").dropDuplicates(["key"]))
    base = scratch.keep(base_spans(texts))
    unknown = _clear_of(candidate_spans(texts, sorted({*USUAL, *seed_lengths(base)})), base)
    known = base.select("key", "start", "end", "s", "left", "right", F.lit(True).alias("bounded"), F.col("kind").alias("seed"))
    spans = scratch.keep(known.unionByName(unknown.withColumn("seed", F.lit(None).cast("string"))))
    edges = scratch.keep(patterns_of(spans))
    seeds = scratch.keep(base.select("s", "kind").distinct())
    accepted = bootstrap(edges, seeds, scratch, rounds, support, trust)
    found = scratch.keep(spans.where("seed is null").select("key", "start", "end", "s").distinct().join(accepted, "s"))
    shaped = _apart(found.where("shaped"))
    added = shaped.union(_apart(_clear_of(found.where("not shaped"), shaped))).withColumn("is_base", F.lit(False))
    every = base.select("key", "kind", "start", "end", F.lit(True).alias("is_base")).union(added)
    counts = [F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in KINDS]
    counts += [F.sum((F.col("is_base") & (F.col("kind") == k)).cast("long")).alias(f"base_{k}") for k in KINDS]
    per_text = every.groupBy("key").agg(
        *counts, _listed(F.col("is_base")).alias("base"), _listed(F.lit(True)).alias("spans"), F.sum((~F.col("is_base")).cast("long")).alias("n_added")
    )
    zero = F.lit(0).cast("long")
    return keyed.select("doc_id", "key").join(per_text, "key", "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_added", zero).alias("n_added"),
        *[F.coalesce(f"base_{k}", zero).alias(f"base_{k}") for k in KINDS],
    )
