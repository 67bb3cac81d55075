"""Row filters and conditional rewrites of the journey and card tables.

Each rule is one DataFrame -> DataFrame function that only adds ``Project`` /
``Filter`` nodes, so Catalyst collapses a whole chain into one codegen stage
and pushes the filters on raw columns into the Parquet scan.

Three-valued logic is kept on purpose: a null mode or date is neither a known
nor an unknown trip, a null off-peak flag is neither peak nor off-peak, and a
null date is in no day class.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..config import JourneyConfig
from ..functions import in_days, map_values, not_in_days, tag_epoch_seconds

# ---------------------------------------------------------------------------
# Projections
# ---------------------------------------------------------------------------


def select_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Keep the named columns."""
    return df.select(*names)


def drop_positions(df: DataFrame, positions: Iterable[int]) -> DataFrame:
    """Drop columns by 1-based position (resolved at plan time)."""
    drop = set(positions)
    return df.select(*[c for i, c in enumerate(df.columns, start=1) if i not in drop])


def keep_positions(df: DataFrame, positions: Iterable[int]) -> DataFrame:
    """Keep columns by 1-based position, in the given order."""
    cols = df.columns
    return df.select(*[cols[i - 1] for i in positions])


# ---------------------------------------------------------------------------
# Filters (F1-F10)
# ---------------------------------------------------------------------------


def exclude_dates(df: DataFrame, dates: Iterable[int], col: str = "TAG1_DT_FK") -> DataFrame:
    """drop rows on the listed tag-on dates (null dates go too)."""
    cond = None
    for d in dates:
        part = F.col(col) != F.lit(d)
        cond = part if cond is None else (cond & part)
    return df if cond is None else df.filter(cond)


def known_trips(df: DataFrame) -> DataFrame:
    """mode is known and the tag-on date is not the missing sentinel."""
    return df.filter(
        (F.col("TS_TYP_CD") != F.lit(K.UNKNOWN)) & (F.col("TAG1_DT_FK") != F.lit(K.MISSING_DATE))
    )


def unknown_trips(df: DataFrame) -> DataFrame:
    """mode unknown or tag-on date missing (not the complement of F2 on nulls)."""
    return df.filter(
        (F.col("TS_TYP_CD") == F.lit(K.UNKNOWN)) | (F.col("TAG1_DT_FK") == F.lit(K.MISSING_DATE))
    )


def positive_duration(df: DataFrame) -> DataFrame:
    """keep trips whose (repaired) duration is positive."""
    return df.filter(F.col("JS_DURN_SEC") > 0)


def off_peak_condition(off_peak: bool, end: str = "TAG1") -> Column:
    """F5 predicate: off-peak or peak trips, judged at tag-on or tag-off."""
    return F.col(f"{end}_OFF_PEAK_IND") == F.lit(off_peak)


def day_class_condition(which: str, date_col: str = "TAG1_DT_FK", cfg: JourneyConfig | None = None) -> Column:
    """F6/F7 predicate: ``sunday``, ``saturday`` or ``weekday``.

    With ``cfg.day_rule == "lists"`` (the reference) the listed dates decide
    and any other date, -1 included, is a weekday; a null date is in no class.
    With ``"dayofweek"`` the calendar decides (Spark: Sunday = 1, Saturday = 7)
    and an unparsable date is in no class.
    """
    cfg = cfg or JourneyConfig()
    if which not in ("sunday", "saturday", "weekday"):
        raise ValueError(f"unknown day class {which!r}")
    if cfg.day_rule == "dayofweek":
        dow = F.dayofweek(F.try_to_date(F.col(date_col).cast("string"), "yyyyMMdd"))
        return {"sunday": dow == 1, "saturday": dow == 7}.get(which, dow.between(2, 6))
    if cfg.day_rule != "lists":
        raise ValueError(f"unknown day rule {cfg.day_rule!r}")
    if which == "sunday":
        return in_days(date_col, cfg.sundays)
    if which == "saturday":
        return in_days(date_col, cfg.saturdays)
    return not_in_days(date_col, cfg.sundays, cfg.saturdays)


def day_class_filter(df: DataFrame, which: str, date_col: str = "TAG1_DT_FK",
                     cfg: JourneyConfig | None = None) -> DataFrame:
    """keep ``sunday``, ``saturday`` or ``weekday`` trips."""
    return df.filter(day_class_condition(which, date_col, cfg))


def intermodal_condition() -> Column:
    """F8 predicate: trips that are an inter-modal transfer."""
    return F.col("IMTT_DESC") != F.lit(K.NO_TRANSFER)


def known_route_condition() -> Column:
    """F10 predicate: trips with a known route (the reference's SQL predicate text)."""
    return F.expr(f"ROUTE_val_ID != {K.NO_ROUTE}")


# ---------------------------------------------------------------------------
# Rewrites (C1-C9)
# ---------------------------------------------------------------------------


def normalise_discount(df: DataFrame) -> DataFrame:
    """Discount ``No DE`` is spelled ``No Discount``."""
    d = F.col("DISC_ENT_DESC")
    return df.withColumn("DISC_ENT_DESC", F.when(d == F.lit(K.NO_DE), F.lit(K.NO_DISCOUNT)).otherwise(d))


def infer_card_type(df: DataFrame, mode: str = "journey") -> DataFrame:
    """An ``UNKNOWN`` card type is inferred from the discount.

    ``journey``: substring ``UNKNOWN`` -> ``Adult`` when there is no discount.
    ``unknown``: same, and -> ``Concession`` for a concession discount.
    ``card``: whole value ``UNKNOWN`` -> ``Adult`` when there is no discount.
    Runs after C1 (it reads the normalised discount).
    """
    t, d = F.col("CARD_TYP_CD"), F.col("DISC_ENT_DESC")
    if mode == "journey":
        out = F.when(d == F.lit(K.NO_DISCOUNT), F.regexp_replace(t, K.UNKNOWN, K.ADULT)).otherwise(t)
    elif mode == "unknown":
        out = (
            F.when(d == F.lit(K.NO_DISCOUNT), F.regexp_replace(t, K.UNKNOWN, K.ADULT))
            .when(d == F.lit(K.CONCESSION), F.regexp_replace(t, K.UNKNOWN, K.CONCESSION))
            .otherwise(t)
        )
    elif mode == "card":
        out = F.when((d == F.lit(K.NO_DISCOUNT)) & (t == F.lit(K.UNKNOWN)), F.lit(K.ADULT)).otherwise(t)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return df.withColumn("CARD_TYP_CD", out)


def fold_single_trip(df: DataFrame, col: str = "CARD_TYP_CD") -> DataFrame:
    """``Sgl Trip <word> <word>...`` variants become ``Sgl Trip Ticket``."""
    return df.withColumn(col, F.regexp_replace(F.col(col), K.SINGLE_TRIP_PATTERN, K.SINGLE_TRIP_LABEL))


def fold_to_allowed(df: DataFrame, col: str = "CARD_TYP_CD",
                    allowed: Iterable[str] = K.ALLOWED_CARD_TYPES,
                    other: str = K.SINGLE_TRIP_LABEL) -> DataFrame:
    """C4: any value outside the allow-list becomes ``other``; null stays null."""
    c = F.col(col)
    return df.withColumn(col, F.when(~c.isin(list(allowed)), F.lit(other)).otherwise(c))


def repair_passenger_type(df: DataFrame) -> DataFrame:
    """Adult passenger on a child card with no discount is a child/youth."""
    p = F.col("PSNGR_TYP_DESC")
    cond = (
        (F.col("CARD_TYP_CD") == F.lit(K.CHILD_YOUTH))
        & (p == F.lit(K.ADULT))
        & (F.col("DISC_ENT_DESC") == F.lit(K.NO_DISCOUNT))
    )
    return df.withColumn("PSNGR_TYP_DESC", F.when(cond, F.lit(K.CHILD_YOUTH)).otherwise(p))


def fold_card_status(df: DataFrame, abnormal: Iterable[str] = K.ABNORMAL_CARD_STATUS) -> DataFrame:
    """Abnormal card states are reported as ``TEMPORARY``."""
    s = F.col("CARD_STAT_CD")
    return df.withColumn("CARD_STAT_CD", F.when(s.isin(list(abnormal)), F.lit(K.TEMPORARY_STATUS)).otherwise(s))


_TAG_OFF_COPIES = (
    ("TAG2_TM", "TAG1_TM"),
    ("TAG2_TS_NM", "TAG1_TS_NM"),
    ("TAG2_LAT_VAL", "TAG1_LAT_VAL"),
    ("TAG2_LONG_VAL", "TAG1_LONG_VAL"),
    ("TAG2_OFF_PEAK_IND", "TAG1_OFF_PEAK_IND"),
)


def impute_tag_off(df: DataFrame) -> DataFrame:
    """A missing tag-off (date ``-1``) copies time, stop, position and flag from tag-on.

    One ``withColumns``: every guard reads the original tag-off date. The date
    itself is rewritten by C8.
    """
    missing = F.col("TAG2_DT_FK") == F.lit(K.MISSING_DATE)
    return df.withColumns(
        {dst: F.when(missing, F.col(src)).otherwise(F.col(dst)) for dst, src in _TAG_OFF_COPIES}
    )


def clamp_tag_off_date(df: DataFrame, keep_dates: Iterable[int] = K.KEEP_TAG_OFF_DATES) -> DataFrame:
    """The tag-off date becomes the tag-on date when missing or different,
    except for trips that start on one of ``keep_dates``."""
    d1, d2 = F.col("TAG1_DT_FK"), F.col("TAG2_DT_FK")
    keep = d1.isin(list(keep_dates))
    out = (
        F.when((d2 == F.lit(K.MISSING_DATE)) | ((d2 != d1) & ~keep), d1).otherwise(d2)
    )
    return df.withColumn("TAG2_DT_FK", out)


def repair_duration(df: DataFrame, fmt: str = K.TAG_STAMP_FORMAT, wrap_midnight: bool = False) -> DataFrame:
    """A negative duration is replaced by |tag-off stamp - tag-on stamp| seconds.

    Runs after C7/C8, so a missing tag-off gives 0 (dropped later by F4). An
    unparsable stamp gives null (also dropped by F4). C8 moves a trip past
    midnight onto its tag-on date, so the reference gets about a day minus
    the trip; ``wrap_midnight=True`` instead takes (off - on) modulo a day.
    """
    dur = F.col("JS_DURN_SEC")
    diff = tag_epoch_seconds("TAG2_DT_FK", "TAG2_TM", fmt) - tag_epoch_seconds("TAG1_DT_FK", "TAG1_TM", fmt)
    gap = F.pmod(diff, F.lit(86400)) if wrap_midnight else F.abs(diff)
    return df.withColumn("JS_DURN_SEC", F.when(dur < 0, gap).otherwise(dur))


def relabel_transfers(df: DataFrame, mapping: dict | None = None) -> DataFrame:
    """Transfer labels that say train are spelled rail."""
    mapping = K.TRANSFER_RELABEL if mapping is None else mapping
    return df.withColumn("IMTT_DESC", map_values("IMTT_DESC", mapping))
