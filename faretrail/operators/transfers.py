"""Previous-trip lookup (W1) and inter-modal transfer detection.

The reference takes ``lag`` over a window partitioned by tag-on date only, so
one task sorts a whole day. A card's previous trip only matters when it is the
same card (the transfer test checks it), so the lookup is one per (date, card).
Card-days are counted first: those of a bounded size take a plain window, and a
card-day of any size (a sentinel card, with whatever null or junk times) is
dealt by ranges of (date, card, time, id) with the last trip of each range
handed to the next one (``ordered.previous_row``).

Null cards can never be a transfer (the card test is null): they have no
previous trip and are spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..config import JourneyConfig
from ..functions import tag_epoch_seconds
from . import cleaning as C
from .ordered import GROUP_ROWS, previous_row

PREV_CARD = "PREV_CARD_FK"
PREV_MODE = "PREV_TS_TYP_CD"
PREV_TAG2_DT = "PREV_TAG2_DT_FK"
PREV_TAG2_TM = "PREV_TAG2_TM"

# order among trips tied on (card, date, time, id): the carried values, then
# the duration (the transfer test reads it), so ties give one answer
TIE_ORDER = ("TS_TYP_CD", "TAG2_DT_FK", "TAG2_TM", "JS_DURN_SEC")

_PREV = "__ft_prev"


def previous_trip(df: DataFrame, date_col: str = "TAG1_DT_FK", card_col: str = "CARD_FK",
                  time_col: str = "TAG1_TM", tie_col: str = "JRNY_ID",
                  group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add the same card's previous trip on the same date.

    Adds ``PREV_CARD_FK`` (the card when a previous trip exists, else null),
    ``PREV_TS_TYP_CD``, ``PREV_TAG2_DT_FK`` and ``PREV_TAG2_TM``. Order is
    (time, id) within a card and date; null times sort first, as in Spark's
    ascending order; trips tied on (time, id) are ordered by their carried
    values (mode, tag-off date and time) and duration, so ties give one
    deterministic answer. Card-days of more than ``group_rows`` trips are
    dealt by ranges. A trip without a card or date has no previous trip.
    """
    carry = ("TS_TYP_CD", "TAG2_DT_FK", "TAG2_TM")
    order = [time_col, tie_col, *[c for c in TIE_ORDER if c in df.columns]]
    out = previous_row(df, [date_col, card_col], order, carry, _PREV, group_rows)
    return out.select(
        *df.columns,
        F.when(F.col(_PREV).isNotNull(), F.col(card_col)).alias(PREV_CARD),
        *[F.col(f"{_PREV}.{c}").alias(p) for c, p in zip(carry, (PREV_MODE, PREV_TAG2_DT, PREV_TAG2_TM))],
    )


def previous_trip_by_day(df: DataFrame) -> DataFrame:
    """W1 as the reference writes it: one window per tag-on date.

    Kept for comparison and property tests only; one task per date does not
    scale (see ``previous_trip``).
    """
    w = Window.partitionBy("TAG1_DT_FK").orderBy(
        *[F.col(c).asc_nulls_first() for c in ("CARD_FK", "TAG1_TM", "JRNY_ID", *TIE_ORDER)]
    )
    prev_card = F.lag("CARD_FK").over(w)
    return df.withColumns(
        {
            PREV_CARD: F.when(prev_card == F.col("CARD_FK"), prev_card),
            PREV_MODE: F.lag("TS_TYP_CD").over(w),
            PREV_TAG2_DT: F.lag("TAG2_DT_FK").over(w),
            PREV_TAG2_TM: F.lag("TAG2_TM").over(w),
        }
    )


def transfer_condition(max_gap_sec: int = K.MAX_TRANSFER_GAP_SEC, fmt: str = K.TAG_STAMP_FORMAT) -> Column:
    """Positive duration, same card, other mode, and tag-on within
    ``max_gap_sec`` of the previous tag-off (absolute gap, strict)."""
    gap = F.abs(
        tag_epoch_seconds("TAG1_DT_FK", "TAG1_TM", fmt) - tag_epoch_seconds(PREV_TAG2_DT, PREV_TAG2_TM, fmt)
    )
    return (
        (F.col("JS_DURN_SEC") > 0)
        & (F.col("CARD_FK") == F.col(PREV_CARD))
        & (F.col("TS_TYP_CD") != F.col(PREV_MODE))
        & (gap < F.lit(max_gap_sec))
    )


def detect_transfers(df: DataFrame, max_gap_sec: int = K.MAX_TRANSFER_GAP_SEC,
                     fmt: str = K.TAG_STAMP_FORMAT, keep_previous: bool = False) -> DataFrame:
    """T1 + T2: ``IMTT_DESC`` = ``"<Prev mode> to <mode in lower case>"`` or
    ``No inter-modal transfer``. Input must carry the W1 columns."""
    label = F.concat(F.col(PREV_MODE), F.lit(K.TRANSFER_JOINER), F.lower(F.col("TS_TYP_CD")))
    out = df.withColumn(
        "IMTT_DESC",
        F.when(transfer_condition(max_gap_sec, fmt), label).otherwise(F.lit(K.NO_TRANSFER)),
    )
    return out if keep_previous else out.drop(PREV_CARD, PREV_MODE, PREV_TAG2_DT, PREV_TAG2_TM)


# ---------------------------------------------------------------------------
# Compositions
# ---------------------------------------------------------------------------


def select_journeys(df: DataFrame, cfg: JourneyConfig | None = None) -> DataFrame:
    """F1 + P1: drop excluded tag-on dates, keep the journey columns."""
    from ..schemas import JOURNEY_COLUMNS

    cfg = cfg or JourneyConfig()
    return C.select_columns(C.exclude_dates(df, cfg.excluded_dates), JOURNEY_COLUMNS)


def repair_journeys(df: DataFrame, cfg: JourneyConfig | None = None) -> DataFrame:
    """F2, C1, C2a, C7, C8, C9 (everything of C10 before the window)."""
    cfg = cfg or JourneyConfig()
    out = C.known_trips(df)
    out = C.normalise_discount(out)
    out = C.infer_card_type(out, "journey")
    out = C.impute_tag_off(out)
    out = C.clamp_tag_off_date(out, cfg.keep_tag_off_dates)
    return C.repair_duration(out, cfg.stamp_format)


def clean_journeys(df: DataFrame, cfg: JourneyConfig | None = None,
                   group_rows: int = GROUP_ROWS) -> DataFrame:
    """The cleaned journey table every journey report reads.

    Order as the reference: F2, C1, C2a, C7, C8, C9, W1+T1+T2, T3, F4, C4.
    The positive-duration filter stays above the window, so a zero-duration
    trip still counts as somebody's previous trip.
    """
    cfg = cfg or JourneyConfig()
    out = repair_journeys(df, cfg)
    out = previous_trip(out, group_rows=group_rows)
    out = detect_transfers(out, cfg.max_transfer_gap_sec, cfg.stamp_format)
    out = C.relabel_transfers(out, cfg.transfer_relabel)
    out = C.positive_duration(out)
    return C.fold_to_allowed(out, "CARD_TYP_CD", cfg.allowed_card_types)


UNKNOWN_COLUMNS = ("PSNGR_TYP_CD", "CARD_TYP_CD", "TAG2_TS_NM", "TAG2_LAT_VAL", "TAG2_LONG_VAL", "TAG2_DT_FK")


def clean_unknown(df: DataFrame) -> DataFrame:
    """Unknown trips (F3) with C1 and C2b, projected to what their
    reports use. ``TAG2_DT_FK`` (raw) is kept for the day-class reports."""
    out = C.unknown_trips(df)
    out = C.normalise_discount(out)
    out = C.infer_card_type(out, "unknown")
    return out.select(*UNKNOWN_COLUMNS)


def clean_cards(df: DataFrame) -> DataFrame:
    """C11: card snapshot rows with C1, C3, C2c, C5, C6, in that order."""
    out = C.normalise_discount(df)
    out = C.fold_single_trip(out)
    out = C.infer_card_type(out, "card")
    out = C.repair_passenger_type(out)
    return C.fold_card_status(out)
