"""DuckDB SQL that states what each registered query must return.

Independent of the Spark plans: the journey window here is the reference's
(one window per tag-on date, ordered by card, time, id), while the Spark plan
takes the previous row per card and date; reports are plain filtered GROUP BYs,
while the suite picks them from grouping sets.
"""

from __future__ import annotations

from ..config import JourneyConfig
from . import journey_reports as JR


def _case(expr: str, mapping, default: str | None = None) -> str:
    items = mapping.items() if isinstance(mapping, dict) else enumerate(mapping)
    parts = " ".join(
        f"WHEN {k!r} THEN '{v}'" if isinstance(k, str) else f"WHEN {k} THEN '{v}'" for k, v in items
    )
    tail = f" ELSE '{default}'" if default is not None else ""
    return f"CASE {expr} {parts}{tail} END"


def _ts(date_sql: str, time_sql: str) -> str:
    return (
        "CAST(epoch(try_strptime(concat_ws(' ', CAST({d} AS VARCHAR), {t}), '%Y%m%d %H:%M:%S')) AS BIGINT)"
    ).format(d=date_sql, t=time_sql)


def _in(col: str, values) -> str:
    return f"{col} IN ({', '.join(str(v) for v in values)})"


def journey_raw_sql() -> str:
    from ..sources import adapters as AD

    return f"""
ev0 AS (
  SELECT event_id, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         date_trunc('second', ts) AS t1,
         CAST(floor(value * 60) AS BIGINT) AS dur
  FROM events
),
ev AS (
  SELECT *, t1 + to_seconds(dur) AS t2, (k * 7 + 3) % 100 AS k2, (event_id % 17 = 0) AS no_off FROM ev0
),
journey_raw AS (
  SELECT
    user_id AS CARD_FK,
    {_case('user_id % 4', AD.PASSENGER_BY_MOD4)} AS PSNGR_TYP_CD,
    {_case('user_id % 11', AD.CARD_TYPE_BY_MOD11, 'UNKNOWN')} AS CARD_TYP_CD,
    event_id AS JRNY_ID,
    {_case('user_id % 5', AD.DISCOUNT_BY_MOD5)} AS DISC_ENT_DESC,
    {_case('event_type', AD.MODE_BY_EVENT)} AS TS_TYP_CD,
    CAST(round(value * 100) AS BIGINT) AS JS_FARE_CENTS_AMT,
    CASE WHEN event_id % 13 = 0 THEN CAST(-1 AS BIGINT) ELSE dur END AS JS_DURN_SEC,
    CAST(NULL AS VARCHAR) AS IMTT_DESC,
    CASE WHEN event_id % 29 = 0 THEN -1 ELSE CAST(strftime(t1, '%Y%m%d') AS INTEGER) END AS TAG1_DT_FK,
    CASE WHEN no_off THEN -1 ELSE CAST(strftime(t2, '%Y%m%d') AS INTEGER) END AS TAG2_DT_FK,
    strftime(t1, '%H:%M:%S') AS TAG1_TM,
    CASE WHEN no_off THEN 'UNKNOWN' ELSE strftime(t2, '%H:%M:%S') END AS TAG2_TM,
    'Stop ' || CAST(k AS VARCHAR) AS TAG1_TS_NM,
    CAST(-33.0 AS DOUBLE) - k / 100 AS TAG1_LAT_VAL,
    CAST(151.0 AS DOUBLE) + k / 100 AS TAG1_LONG_VAL,
    CASE WHEN no_off THEN 'UNKNOWN' ELSE 'Stop ' || CAST(k2 AS VARCHAR) END AS TAG2_TS_NM,
    CAST(-33.0 AS DOUBLE) - k2 / 100 AS TAG2_LAT_VAL,
    CAST(151.0 AS DOUBLE) + k2 / 100 AS TAG2_LONG_VAL,
    hour(t1) NOT IN (7, 8, 16, 17) AS TAG1_OFF_PEAK_IND,
    hour(t2) NOT IN (7, 8, 16, 17) AS TAG2_OFF_PEAK_IND,
    CAST(CASE WHEN k % 10 = 0 THEN -1 ELSE k % 10 END AS INTEGER) AS ROUTE_val_ID,
    'Route ' || CAST(k % 10 AS VARCHAR) AS ROUTE_val_NM
  FROM ev
)"""


def journey_ctes(cfg: JourneyConfig) -> str:
    """WITH-list ending in ``selected``, ``repaired``, ``windowed``,
    ``transfers``, ``journey`` and ``unknowns``."""
    excl = " AND ".join(f"TAG1_DT_FK <> {d}" for d in cfg.excluded_dates)
    keep = _in("TAG1_DT_FK", cfg.keep_tag_off_dates)
    allowed = ", ".join(f"'{t}'" for t in cfg.allowed_card_types)
    relabel = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in cfg.transfer_relabel.items())
    miss = "TAG2_DT_FK = -1"
    return f"""WITH {journey_raw_sql()},
selected AS (SELECT * FROM journey_raw WHERE {excl}),
known AS (SELECT * FROM selected WHERE TS_TYP_CD <> 'UNKNOWN' AND TAG1_DT_FK <> -1),
c1 AS (SELECT * REPLACE (CASE WHEN DISC_ENT_DESC = 'No DE' THEN 'No Discount' ELSE DISC_ENT_DESC END AS DISC_ENT_DESC) FROM known),
c2 AS (SELECT * REPLACE (CASE WHEN DISC_ENT_DESC = 'No Discount' THEN replace(CARD_TYP_CD, 'UNKNOWN', 'Adult') ELSE CARD_TYP_CD END AS CARD_TYP_CD) FROM c1),
c7 AS (SELECT * REPLACE (
    CASE WHEN {miss} THEN TAG1_TM ELSE TAG2_TM END AS TAG2_TM,
    CASE WHEN {miss} THEN TAG1_TS_NM ELSE TAG2_TS_NM END AS TAG2_TS_NM,
    CASE WHEN {miss} THEN TAG1_LAT_VAL ELSE TAG2_LAT_VAL END AS TAG2_LAT_VAL,
    CASE WHEN {miss} THEN TAG1_LONG_VAL ELSE TAG2_LONG_VAL END AS TAG2_LONG_VAL,
    CASE WHEN {miss} THEN TAG1_OFF_PEAK_IND ELSE TAG2_OFF_PEAK_IND END AS TAG2_OFF_PEAK_IND) FROM c2),
c8 AS (SELECT * REPLACE (CASE WHEN {miss} THEN TAG1_DT_FK
    WHEN TAG2_DT_FK <> TAG1_DT_FK AND {keep} THEN TAG2_DT_FK
    WHEN TAG2_DT_FK <> TAG1_DT_FK AND NOT ({keep}) THEN TAG1_DT_FK
    ELSE TAG2_DT_FK END AS TAG2_DT_FK) FROM c7),
repaired AS (SELECT * REPLACE (CASE WHEN JS_DURN_SEC < 0
    THEN abs({_ts('TAG2_DT_FK', 'TAG2_TM')} - {_ts('TAG1_DT_FK', 'TAG1_TM')}) ELSE JS_DURN_SEC END AS JS_DURN_SEC) FROM c8),
windowed AS (SELECT *,
    lag(CARD_FK) OVER w AS p_card, lag(TS_TYP_CD) OVER w AS p_mode,
    lag(TAG2_DT_FK) OVER w AS p_d2, lag(TAG2_TM) OVER w AS p_t2
  FROM repaired
  WINDOW w AS (PARTITION BY TAG1_DT_FK ORDER BY CARD_FK ASC NULLS FIRST, TAG1_TM ASC NULLS FIRST,
               JRNY_ID ASC NULLS FIRST, TS_TYP_CD ASC NULLS FIRST, TAG2_DT_FK ASC NULLS FIRST, TAG2_TM ASC NULLS FIRST,
               JS_DURN_SEC ASC NULLS FIRST)),
transfers AS (SELECT * EXCLUDE (p_card, p_mode, p_d2, p_t2) REPLACE (
    CASE WHEN JS_DURN_SEC > 0 AND CARD_FK = p_card AND TS_TYP_CD <> p_mode
          AND abs({_ts('TAG1_DT_FK', 'TAG1_TM')} - {_ts('p_d2', 'p_t2')}) < {cfg.max_transfer_gap_sec}
         THEN p_mode || ' to ' || lower(TS_TYP_CD) ELSE 'No inter-modal transfer' END AS IMTT_DESC) FROM windowed),
relabelled AS (SELECT * REPLACE (CASE IMTT_DESC {relabel} ELSE IMTT_DESC END AS IMTT_DESC) FROM transfers),
journey AS (SELECT * REPLACE (
    CASE WHEN NOT (CARD_TYP_CD IN ({allowed})) THEN 'Sgl Trip Ticket' ELSE CARD_TYP_CD END AS CARD_TYP_CD)
  FROM relabelled WHERE JS_DURN_SEC > 0),
unk0 AS (SELECT * REPLACE (CASE WHEN DISC_ENT_DESC = 'No DE' THEN 'No Discount' ELSE DISC_ENT_DESC END AS DISC_ENT_DESC)
  FROM selected WHERE TS_TYP_CD = 'UNKNOWN' OR TAG1_DT_FK = -1),
unknowns AS (SELECT PSNGR_TYP_CD,
    CASE WHEN DISC_ENT_DESC = 'No Discount' THEN replace(CARD_TYP_CD, 'UNKNOWN', 'Adult')
         WHEN DISC_ENT_DESC = 'Concession' THEN replace(CARD_TYP_CD, 'UNKNOWN', 'Concession')
         ELSE CARD_TYP_CD END AS CARD_TYP_CD,
    TAG2_TS_NM, TAG2_LAT_VAL, TAG2_LONG_VAL, TAG2_DT_FK FROM unk0)
"""


def condition_sql(name: str, cfg: JourneyConfig) -> str:
    if name in ("offpeak1", "peak1", "offpeak2", "peak2"):
        end = "TAG1" if name.endswith("1") else "TAG2"
        return f"{end}_OFF_PEAK_IND = {'true' if name.startswith('off') else 'false'}"
    if name == "transfer":
        return "IMTT_DESC <> 'No inter-modal transfer'"
    if name == "route":
        return "ROUTE_val_ID <> -1"
    date_col = "TAG1_DT_FK" if name.endswith("1") else "TAG2_DT_FK"
    if name.startswith("sunday"):
        return _in(date_col, cfg.sundays)
    if name.startswith("saturday"):
        return _in(date_col, cfg.saturdays)
    if name.startswith("weekday"):
        return f"NOT ({_in(date_col, cfg.sundays)}) AND NOT ({_in(date_col, cfg.saturdays)})"
    raise KeyError(name)


def report_sql(r: JR.Report, cfg: JourneyConfig) -> str:
    where = " AND ".join(f"({condition_sql(n, cfg)})" for n in r.where) or "TRUE"
    keys = ", ".join(r.keys)
    head = journey_ctes(cfg)
    if r.measure == "count":
        body = f'SELECT {keys}, count(*) AS "count" FROM {r.base} WHERE {where} GROUP BY {keys}'
    elif r.measure == "avg_duration":
        body = f'SELECT {keys}, avg(JS_DURN_SEC) AS "avg(JS_DURN_SEC)" FROM {r.base} WHERE {where} GROUP BY {keys}'
    else:
        flag = "true" if r.measure == "kpi_off" else "false"
        name = "TOTAL_OFF_PEAK_TRIPS" if r.measure == "kpi_off" else "TOTAL_PEAK_TRIPS"
        body = (
            f"SELECT count(JRNY_ID) AS {name}, abs(CAST(sum(JS_DURN_SEC) AS DOUBLE) / 3600) AS TOTAL_TRIP_TM, "
            f"CAST(sum(JS_FARE_CENTS_AMT) AS BIGINT) AS TOTAL_FARE_PAID FROM journey WHERE TAG1_OFF_PEAK_IND = {flag}"
        )
    return head + body


def journey_report_sql(cfg: JourneyConfig) -> dict[str, str]:
    return {r.key: report_sql(r, cfg) for r in JR.REPORTS}
