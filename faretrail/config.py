"""Run parameters: calendar, sentinels and thresholds, with reference defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

from . import constants as K


@dataclass(frozen=True)
class JourneyConfig:
    """Parameters of the journey cleaning and report plans.

    Defaults are the reference job's values; ``for_test_events`` gives the
    calendar of the driver's ``events`` table.
    """

    excluded_dates: tuple[int, ...] = K.EXCLUDED_DATES
    keep_tag_off_dates: tuple[int, ...] = K.KEEP_TAG_OFF_DATES
    sundays: tuple[int, ...] = K.SUNDAYS
    saturdays: tuple[int, ...] = K.SATURDAYS
    allowed_card_types: tuple[str, ...] = K.ALLOWED_CARD_TYPES
    max_transfer_gap_sec: int = K.MAX_TRANSFER_GAP_SEC
    transfer_relabel: dict = field(default_factory=lambda: dict(K.TRANSFER_RELABEL))
    stamp_format: str = K.TAG_STAMP_FORMAT
    # "lists": Sunday/Saturday are the listed dates, every other date (also -1)
    # is a weekday. "dayofweek": the calendar day of the yyyyMMdd date; a date
    # that does not parse (e.g. -1) is in no class.
    day_rule: str = "lists"

    @classmethod
    def for_test_events(cls) -> "JourneyConfig":
        """Calendar of the driver's ``events`` table (January 2024)."""
        return cls(
            excluded_dates=(20240101,),
            keep_tag_off_dates=(20240130,),
            sundays=(20240107, 20240114, 20240121, 20240128),
            saturdays=(20240106, 20240113, 20240120, 20240127),
        )


@dataclass(frozen=True)
class SurveyConfig:
    """Column blocks and labels of the commuter survey."""

    gender: str = "Q1"
    age: str = "Q2"
    occupation: str = "Q3"
    frequency: str = "Q4"
    mode: str = "Q5"
    overall: str = "Q12"
    q9: tuple[str, ...] = K.Q9_COLUMNS
    q10: tuple[str, ...] = K.Q10_COLUMNS
    non_commuter_level: int = K.NON_COMMUTER_LEVEL
