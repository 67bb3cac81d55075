"""Fixed values that must equal the reference job's for the same results.

Everything here is a default: every operator takes these as parameters, so a
different network, calendar or survey can pass its own.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values (journey job)
# ---------------------------------------------------------------------------

# Card types that survive the final fold; anything else becomes SINGLE_TRIP_LABEL.
ALLOWED_CARD_TYPES = (
    "Senior/Pensioner",
    "Adult",
    "Free Travel",
    "School Student",
    "Child/Youth",
    "Employee",
    "Concession",
)

# Calendar of the original data set (integer yyyyMMdd tag-on dates).
SUNDAYS = (20160807, 20160814, 20160821, 20160828, 20160904, 20160911, 20160918)
SATURDAYS = (20160806, 20160813, 20160820, 20160827, 20160903, 20160910, 20160917)

# Tag-on date removed before anything else.
EXCLUDED_DATES = (20160718,)

# Tag-on dates on which a trip that ends on another date keeps its tag-off date.
KEEP_TAG_OFF_DATES = (20160731,)

# Sentinels.
MISSING_DATE = -1
UNKNOWN = "UNKNOWN"
NO_ROUTE = -1

# Discount and card-type rewrites.
NO_DE = "No DE"
NO_DISCOUNT = "No Discount"
CONCESSION = "Concession"
ADULT = "Adult"
CHILD_YOUTH = "Child/Youth"

# Transfer detection.
NO_TRANSFER = "No inter-modal transfer"
TRANSFER_JOINER = " to "
MAX_TRANSFER_GAP_SEC = 3600
TAG_STAMP_FORMAT = "yyyyMMdd HH:mm:ss"

# Transfer labels that name the train as rail, in the reference's order.
TRANSFER_RELABEL = {
    "Bus to train": "Bus to rail",
    "Ferry to train": "Ferry to rail",
    "Light rail to train": "Light rail to rail",
    "Train to ferry": "Rail to ferry",
    "Train to bus": "Rail to bus",
    "Train to light rail": "Rail to light rail",
}

# ---------------------------------------------------------------------------
# Fixed values (card snapshot job)
# ---------------------------------------------------------------------------

SINGLE_TRIP_PATTERN = "Sgl Trip ([A-Za-z]+) ([A-Za-z]+).*"
SINGLE_TRIP_LABEL = "Sgl Trip Ticket"
ABNORMAL_CARD_STATUS = ("UNKNOWN", "HOTLISTED", "BLOCKED", "EXPIRED")
TEMPORARY_STATUS = "TEMPORARY"
SNAPSHOT_FILE_DATE_FORMAT = "yyyyMMdd"
SNAPSHOT_DATE_TEXT_FORMAT = "dd-MMM-yyyy"

# ---------------------------------------------------------------------------
# Fixed values (survey script): level labels in code order
# ---------------------------------------------------------------------------

GENDER_LABELS = ("Male", "Female")
AGE_LABELS = ("Under 18", "19-25", "26-35", "36-50", "51-70", "Over 70")
OCCUPATION_LABELS = (
    "Self-employed",
    "Employed Full Time",
    "Employed Part Time",
    "Job Seeker",
    "Student",
    "Homemaker",
    "Unemployed",
    "Disable",
    "Retired",
)
FREQUENCY_LABELS = ("Everyday", "Only on weekdays", "Occasionally", "Never use PT", "Others")
NON_COMMUTER_LEVEL = 4  # 1-based level of FREQUENCY_LABELS that marks non-commuters
MODE_LABELS = ("Train", "Bus", "Ferry", "Light Rail")

RATING9_LABELS = (
    "Worst", "Worse", "Bad", "Unacceptable", "Below Average",
    "Above Average", "Acceptable", "Good", "Better",
)
RATING8_LOW_LABELS = (
    "Worst", "Worse", "Bad", "Unacceptable", "Below Average",
    "Above Average", "Acceptable", "Good",
)
RATING8_HIGH_LABELS = (
    "Worse", "Bad", "Unacceptable", "Below Average",
    "Above Average", "Acceptable", "Good", "Better",
)
EXPERIENCE9_LABELS = (
    "Most Dissatisfying", "Dissatisfying", "Totally Unacceptable", "A Bit Unacceptable",
    "Below Average", "Above Average", "A Bit Acceptable", "Totally Acceptable", "Satisfying",
)
EXPERIENCE8_NO_DISSATISFYING_LABELS = (
    "Most Dissatisfying", "Totally Unacceptable", "A Bit Unacceptable",
    "Below Average", "Above Average", "A Bit Acceptable", "Totally Acceptable", "Satisfying",
)
EXPERIENCE8_NO_MOST_LABELS = (
    "Dissatisfying", "Totally Unacceptable", "A Bit Unacceptable",
    "Below Average", "Above Average", "A Bit Acceptable", "Totally Acceptable", "Satisfying",
)
OVERALL_LABELS = ("Poor", "Below Average", "Average", "Above Average", "Excellent")

Q9_COLUMNS = ("Q9_A", "Q9_B", "Q9_C", "Q9_D", "Q9_E", "Q9_F", "Q9_G")
Q10_COLUMNS = ("Q10_A", "Q10_B", "Q10_C", "Q10_D", "Q10_E", "Q10_F")

# Label lists per rating column, as the survey script attaches them to commuters.
RATING_LABELS = {
    "Q9_A": RATING9_LABELS,
    "Q9_B": RATING8_LOW_LABELS,
    "Q9_C": RATING9_LABELS,
    "Q9_D": RATING9_LABELS,
    "Q9_E": RATING8_HIGH_LABELS,
    "Q9_F": RATING8_HIGH_LABELS,
    "Q9_G": RATING8_LOW_LABELS,
    "Q10_A": EXPERIENCE9_LABELS,
    "Q10_B": EXPERIENCE9_LABELS,
    "Q10_C": EXPERIENCE8_NO_DISSATISFYING_LABELS,
    "Q10_D": EXPERIENCE9_LABELS,
    "Q10_E": EXPERIENCE8_NO_MOST_LABELS,
    "Q10_F": EXPERIENCE9_LABELS,
    "Q12": OVERALL_LABELS,
}

# Aspect names of the melted rating blocks.
Q9_ASPECTS = (
    "Info. offered", "Cleanliness", "Avai. assist.", "Refr. fac. var.",
    "Refr. fac. acc.", "Toilet fac.", "Wait. benches",
)
Q10_ASPECTS = (
    "Staff friendliness", "Comfort dur. travel", "Temperature",
    "On-board info.", "Cleanliness on veh.", "Other cus.s' behav.",
)

# Box-plot whisker reach in interquartile ranges.
WHISKER_IQR = 1.5
