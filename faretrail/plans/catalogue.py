"""Registered queries (Spark) and their oracle SQL (DuckDB), by key.

Keys follow SURVEY section 7.3: rule-level checks of the cleaning chain, one
key per journey report, card snapshot reports and survey statistics.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..config import JourneyConfig
from ..operators import aggregates as A
from ..operators import cleaning as C
from ..operators import transfers as T
from ..sources import adapters as AD
from ..sources.snapshots import latest_snapshot, snapshot_text
from . import files_plan as FP
from . import journey_reports as JR
from . import oracle as O
from . import survey_plan as SP

Query = Callable[[SparkSession, str], DataFrame]

PREV_COLS = (T.PREV_CARD, T.PREV_MODE, T.PREV_TAG2_DT, T.PREV_TAG2_TM)
TAG_OFF_COLS = ("TAG2_TM", "TAG2_TS_NM", "TAG2_LAT_VAL", "TAG2_LONG_VAL", "TAG2_OFF_PEAK_IND")
CARD_COLS = ("snapshot_date", "CARD_TYP_CD", "DISC_ENT_DESC", "PSNGR_TYP_DESC", "CARD_STAT_CD")


# ---------------------------------------------------------------------------
# Journey: rule by rule
# ---------------------------------------------------------------------------


def _selected(spark, d, cfg):
    return T.select_journeys(AD.journeys(spark, d), cfg)


def _known_c1(spark, d, cfg):
    return C.normalise_discount(C.known_trips(_selected(spark, d, cfg)))


def _c7(spark, d, cfg):
    return C.impute_tag_off(C.infer_card_type(_known_c1(spark, d, cfg), "journey"))


def _repaired(spark, d, cfg):
    return T.repair_journeys(_selected(spark, d, cfg), cfg)


def journey_rule_queries(cfg: JourneyConfig) -> dict[str, Query]:
    return {
        "journey_selected": lambda s, d: _selected(s, d, cfg),
        "known_trips": lambda s, d: C.known_trips(_selected(s, d, cfg)).select("JRNY_ID"),
        "unknown_trips": lambda s, d: C.unknown_trips(_selected(s, d, cfg)).select("JRNY_ID"),
        "clean_discount": lambda s, d: _known_c1(s, d, cfg).select("JRNY_ID", "DISC_ENT_DESC"),
        "clean_card_type": lambda s, d: C.infer_card_type(_known_c1(s, d, cfg), "journey").select(
            "JRNY_ID", "CARD_TYP_CD"),
        "clean_tag_off": lambda s, d: _c7(s, d, cfg).select("JRNY_ID", *TAG_OFF_COLS),
        "clean_tag_off_date": lambda s, d: C.clamp_tag_off_date(_c7(s, d, cfg), cfg.keep_tag_off_dates).select(
            "JRNY_ID", "TAG2_DT_FK"),
        "clean_duration": lambda s, d: _repaired(s, d, cfg).select("JRNY_ID", "JS_DURN_SEC"),
        "previous_trip": lambda s, d: T.previous_trip(_repaired(s, d, cfg)).select("JRNY_ID", *PREV_COLS),
        "transfer_detect": lambda s, d: T.detect_transfers(T.previous_trip(_repaired(s, d, cfg))).select(
            "JRNY_ID", "IMTT_DESC"),
        "transfer_relabel": lambda s, d: A.segmented_count(
            C.relabel_transfers(T.detect_transfers(T.previous_trip(_repaired(s, d, cfg))), cfg.transfer_relabel),
            ["IMTT_DESC"]),
        "clean_fold_card_type": lambda s, d: T.clean_journeys(_selected(s, d, cfg), cfg).select(
            "JRNY_ID", "CARD_TYP_CD"),
        "journey_clean": lambda s, d: T.clean_journeys(_selected(s, d, cfg), cfg),
        "journey_unknown": lambda s, d: T.clean_unknown(_selected(s, d, cfg)),
    }


def journey_rule_sql(cfg: JourneyConfig) -> dict[str, str]:
    h = O.journey_ctes(cfg)
    tag_off = ", ".join(TAG_OFF_COLS)
    return {
        "journey_selected": h + "SELECT * FROM selected",
        "known_trips": h + "SELECT JRNY_ID FROM known",
        "unknown_trips": h + "SELECT JRNY_ID FROM selected WHERE TS_TYP_CD = 'UNKNOWN' OR TAG1_DT_FK = -1",
        "clean_discount": h + "SELECT JRNY_ID, DISC_ENT_DESC FROM c1",
        "clean_card_type": h + "SELECT JRNY_ID, CARD_TYP_CD FROM c2",
        "clean_tag_off": h + f"SELECT JRNY_ID, {tag_off} FROM c7",
        "clean_tag_off_date": h + "SELECT JRNY_ID, TAG2_DT_FK FROM c8",
        "clean_duration": h + "SELECT JRNY_ID, JS_DURN_SEC FROM repaired",
        "previous_trip": h + f"""SELECT JRNY_ID,
            CASE WHEN p_card = CARD_FK THEN p_card END AS {T.PREV_CARD},
            CASE WHEN p_card = CARD_FK THEN p_mode END AS {T.PREV_MODE},
            CASE WHEN p_card = CARD_FK THEN p_d2 END AS {T.PREV_TAG2_DT},
            CASE WHEN p_card = CARD_FK THEN p_t2 END AS {T.PREV_TAG2_TM} FROM windowed""",
        "transfer_detect": h + "SELECT JRNY_ID, IMTT_DESC FROM transfers",
        "transfer_relabel": h + 'SELECT IMTT_DESC, count(*) AS "count" FROM relabelled GROUP BY IMTT_DESC',
        "clean_fold_card_type": h + "SELECT JRNY_ID, CARD_TYP_CD FROM journey",
        "journey_clean": h + "SELECT * FROM journey",
        "journey_unknown": h + "SELECT * FROM unknowns",
    }


# ---------------------------------------------------------------------------
# Journey reports
# ---------------------------------------------------------------------------


def _report_query(key: str, cfg: JourneyConfig) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        report = JR.BY_KEY[key]
        return JR.report_df(report, JR.bases(_selected(spark, d, cfg), cfg)[report.base], cfg)

    return run


def journey_report_queries(cfg: JourneyConfig) -> dict[str, Query]:
    return {r.key: _report_query(r.key, cfg) for r in JR.REPORTS}


# ---------------------------------------------------------------------------
# Card snapshots
# ---------------------------------------------------------------------------

CARD_SQL = """WITH cards_raw AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS snapshot_date,
    {card} AS CARD_TYP_CD, {disc} AS DISC_ENT_DESC, {psng} AS PSNGR_TYP_DESC, {stat} AS CARD_STAT_CD
  FROM orders),
c1 AS (SELECT * REPLACE (CASE WHEN DISC_ENT_DESC = 'No DE' THEN 'No Discount' ELSE DISC_ENT_DESC END AS DISC_ENT_DESC) FROM cards_raw),
c3 AS (SELECT * REPLACE (regexp_replace(CARD_TYP_CD, 'Sgl Trip ([A-Za-z]+) ([A-Za-z]+).*', 'Sgl Trip Ticket', 'g') AS CARD_TYP_CD) FROM c1),
c2 AS (SELECT * REPLACE (CASE WHEN DISC_ENT_DESC = 'No Discount' AND CARD_TYP_CD = 'UNKNOWN' THEN 'Adult' ELSE CARD_TYP_CD END AS CARD_TYP_CD) FROM c3),
c5 AS (SELECT * REPLACE (CASE WHEN CARD_TYP_CD = 'Child/Youth' AND PSNGR_TYP_DESC = 'Adult' AND DISC_ENT_DESC = 'No Discount' THEN 'Child/Youth' ELSE PSNGR_TYP_DESC END AS PSNGR_TYP_DESC) FROM c2),
cards AS (SELECT * REPLACE (CASE WHEN CARD_STAT_CD IN ('UNKNOWN', 'HOTLISTED', 'BLOCKED', 'EXPIRED') THEN 'TEMPORARY' ELSE CARD_STAT_CD END AS CARD_STAT_CD) FROM c5)
"""


def card_sql_head() -> str:
    return CARD_SQL.format(
        card=O._case("o_orderkey % 11", AD.CARD_TYPE_BY_MOD11, "UNKNOWN"),
        disc=O._case("o_custkey % 5", AD.DISCOUNT_BY_MOD5),
        psng=O._case("o_custkey % 4", AD.PASSENGER_BY_MOD4),
        stat=O._case("o_orderkey % 7", AD.STATUS_BY_MOD7, "ISSUED"),
    )


FILE_TABLES = ("region", "nation", "supplier", "orders")


def _file_row_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows per input file, all files in one scan, against the list of
    expected files (one of them is not among the files read and counts 0).

    A one-column placeholder schema reads no data pages, only row counts;
    the file comes from the hidden ``_metadata`` column.
    """
    paths = [os.path.join(d, f"{t}.parquet") for t in FILE_TABLES]
    rows = spark.read.schema("__placeholder INT").parquet(*paths).select(F.col("_metadata.file_name").alias("file_name"))
    listed = spark.range(1).select(F.explode(F.array(
        *[F.lit(f"{t}.parquet") for t in (*FILE_TABLES, "part")])).alias("file_name"))
    return A.rows_per_snapshot(rows, "file_name", expected=listed)


def _info_documents(spark: SparkSession, d: str) -> DataFrame:
    """K1 with O1 and O2: both card reports and one without records as
    documents, rows (report, position, line)."""
    cards = AD.cards(spark, d)
    data = A.rows_per_snapshot(cards).select(snapshot_text().alias("date"), "cardCount")
    types = A.card_type_counts(T.clean_cards(cards)).select(
        snapshot_text().alias("date"), F.col("CARD_TYP_CD").alias("type"), "typeCount")
    none = data.where(F.col("cardCount") < 0)
    text = F.lit("")
    lines = (
        data.select(F.lit("dataCount").alias("report"), F.col("cardCount").alias("n"), text.alias("d"), text.alias("t"),
                    F.to_json(F.struct("date", "cardCount")).alias("line"))
        .unionByName(types.select(F.lit("cardCount").alias("report"), F.lit(0).cast("long").alias("n"),
                                  F.col("date").alias("d"), F.col("type").alias("t"),
                                  F.to_json(F.struct("date", "type", "typeCount")).alias("line")))
        .unionByName(none.select(F.lit("noCount").alias("report"), F.col("cardCount").alias("n"), text.alias("d"),
                                 text.alias("t"), F.to_json(F.struct("date", "cardCount")).alias("line")))
    )
    return sinks.document_rows(lines, ["dataCount", "cardCount", "noCount"], order_by=["n", "d", "t"])[0]


def _info_documents_sql() -> str:
    return card_sql_head() + """, dc AS (SELECT strftime(snapshot_date, '%d-%b-%Y') AS date, count(*) AS cardCount
  FROM cards_raw GROUP BY snapshot_date),
cc AS (SELECT strftime(snapshot_date, '%d-%b-%Y') AS date, CARD_TYP_CD AS type, count(*) AS typeCount
  FROM cards GROUP BY snapshot_date, CARD_TYP_CD),
l AS (SELECT 'dataCount' AS report, cardCount AS n, '' AS d, '' AS t,
    CAST(to_json({'date': date, 'cardCount': cardCount}) AS VARCHAR) AS line FROM dc
  UNION ALL SELECT 'cardCount', 0, date, type,
    CAST(to_json({'date': date, 'type': type, 'typeCount': typeCount}) AS VARCHAR) FROM cc),
p AS (SELECT report, row_number() OVER (PARTITION BY report ORDER BY n, d, t, line) AS position, line FROM l),
names AS (SELECT unnest(['dataCount', 'cardCount', 'noCount']) AS report)
SELECT report, position, CASE WHEN position > 1 THEN ',' || line ELSE line END AS line FROM p
UNION ALL SELECT report, 0, '{"Info":[' FROM names
UNION ALL SELECT names.report, coalesce(max(position), 0) + 1, ']}' FROM names LEFT JOIN p ON p.report = names.report GROUP BY names.report"""


def card_queries() -> dict[str, Query]:
    def cleaned(s, d):
        return T.clean_cards(AD.cards(s, d))

    return {
        "clean_cards": lambda s, d: cleaned(s, d).select(*CARD_COLS),
        "r49_data_count": lambda s, d: A.rows_per_snapshot(AD.cards(s, d)).select(
            snapshot_text().alias("date"), "cardCount"),
        "r50_card_count": lambda s, d: A.card_type_counts(cleaned(s, d)).select(
            snapshot_text().alias("date"), F.col("CARD_TYP_CD").alias("type"), "typeCount"),
        "latest_snapshot": lambda s, d: C.fold_single_trip(latest_snapshot(AD.cards(s, d))).select(*CARD_COLS),
        "file_row_counts": _file_row_counts,
        "info_documents": _info_documents,
    }


def card_sql(sf_dir_hint: str | None = None) -> dict[str, str]:
    h = card_sql_head()
    cols = ", ".join(CARD_COLS)
    return {
        "clean_cards": h + f"SELECT {cols} FROM cards",
        "r49_data_count": h + "SELECT strftime(snapshot_date, '%d-%b-%Y') AS date, count(*) AS cardCount "
                              "FROM cards_raw GROUP BY snapshot_date",
        "r50_card_count": h + "SELECT strftime(snapshot_date, '%d-%b-%Y') AS date, CARD_TYP_CD AS type, "
                              "count(*) AS typeCount FROM cards GROUP BY snapshot_date, CARD_TYP_CD",
        "latest_snapshot": h + "SELECT snapshot_date, regexp_replace(CARD_TYP_CD, 'Sgl Trip ([A-Za-z]+) ([A-Za-z]+).*', "
                               "'Sgl Trip Ticket', 'g') AS CARD_TYP_CD, DISC_ENT_DESC, PSNGR_TYP_DESC, CARD_STAT_CD "
                               "FROM cards_raw WHERE snapshot_date = (SELECT max(snapshot_date) FROM cards_raw)",
        "file_row_counts": " UNION ALL ".join(
            f"SELECT '{t}.parquet' AS file_name, count(*) AS cardCount FROM {t}"
            for t in FILE_TABLES
        ) + " UNION ALL SELECT 'part.parquet', 0",
        "info_documents": _info_documents_sql(),
    }


# ---------------------------------------------------------------------------
# All
# ---------------------------------------------------------------------------


def queries(cfg: JourneyConfig) -> dict[str, Query]:
    return {
        **journey_rule_queries(cfg),
        **journey_report_queries(cfg),
        **card_queries(),
        **SP.survey_queries(),
        **FP.file_queries(cfg),
    }


def oracle_sql(cfg: JourneyConfig) -> dict[str, str]:
    return {
        **journey_rule_sql(cfg),
        **O.journey_report_sql(cfg),
        **card_sql(),
        **SP.survey_sql(),
        **FP.file_sql(cfg, card_sql()),
    }
