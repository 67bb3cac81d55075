"""The journey reports (R01-R48) as a declarative catalogue, and a fused plan.

Each ``Report`` names its base table, filter conditions, keys and measure.
``report_df`` runs one report on its own (filter + groupBy). ``JourneySuite``
runs the whole catalogue from one aggregate over grouping sets of the cleaned
table and one of the unknown trips, instead of one scan, window and shuffle
per report.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import JourneyConfig
from ..operators import aggregates as A
from ..operators import cleaning as C
from ..operators import transfers as T
from ..schemas import DEPARTURE_KEYS as DEP
from ..schemas import DESTINATION_KEYS as DST
from ..session import materialize_at, release

CARD = ("CARD_TYP_CD",)
PSNGR = ("PSNGR_TYP_CD",)
PCARD = ("PSNGR_TYP_CD", "CARD_TYP_CD")


@dataclass(frozen=True)
class Report:
    key: str                 # query key
    name: str                # the reference's output name
    base: str                # journey | unknowns | selected
    keys: tuple[str, ...]
    where: tuple[str, ...] = ()
    measure: str = "count"   # count | avg_duration | kpi_off | kpi_peak
    sink: str = "info_json"  # info_json | jsonl | csv | console


REPORTS: tuple[Report, ...] = (
    Report("r01_departure", "departure", "journey", DEP),
    Report("r02_departure_offpeak", "departureOffpeak", "journey", DEP, ("offpeak1",)),
    Report("r03_departure_peak", "departurePeak", "journey", DEP, ("peak1",)),
    Report("r04_destination", "destination", "journey", DST),
    Report("r05_destination_offpeak", "destinationOffpeak", "journey", DST, ("offpeak2",)),
    Report("r06_destination_peak", "destinationPeak", "journey", DST, ("peak2",)),
    Report("r07_departure_card", "departureCard", "journey", CARD + DEP),
    Report("r08_departure_card_offpeak", "departureCardOffpeak", "journey", CARD + DEP, ("offpeak1",)),
    Report("r09_departure_card_peak", "departureCardPeak", "journey", CARD + DEP, ("peak1",)),
    Report("r10_destination_card", "destinationCard", "journey", CARD + DST),
    Report("r11_destination_card_offpeak", "destinationCardOffpeak", "journey", CARD + DST, ("offpeak2",)),
    Report("r12_destination_card_peak", "destinationCardPeak", "journey", CARD + DST, ("peak2",)),
    Report("r13_departure_intermodal", "departureIntermodal", "journey", ("IMTT_DESC",) + DEP, ("transfer",)),
    Report("r14_departure_intermodal_offpeak", "departureIntermodalOffpeak", "journey",
           ("IMTT_DESC",) + DEP, ("transfer", "offpeak1")),
    Report("r15_departure_intermodal_peak", "departureIntermodalPeak", "journey",
           ("IMTT_DESC",) + DEP, ("transfer", "peak1")),
    Report("r16_card_type_intermodal", "cardTypeIntermodal", "journey", ("CARD_TYP_CD", "IMTT_DESC"), ("transfer",)),
    Report("r17_passenger_card_discount", "passengerCardDiscount", "journey",
           ("PSNGR_TYP_CD", "CARD_TYP_CD", "DISC_ENT_DESC")),
    Report("r18_passenger", "passenger", "journey", PSNGR),
    Report("r19_card_type", "cardType", "journey", CARD),
    Report("r20_transport_mode", "transportMode", "journey", ("TS_TYP_CD",)),
    Report("r21_departure_sunday", "departureSunday", "journey", DEP, ("sunday1",)),
    Report("r22_departure_saturday", "departureSaturday", "journey", DEP, ("saturday1",)),
    Report("r23_departure_weekday", "departureWeekday", "journey", DEP, ("weekday1",)),
    Report("r24_destination_sunday", "destinationSunday", "journey", DST, ("sunday1",)),
    Report("r25_destination_saturday", "destinationSaturday", "journey", DST, ("saturday1",)),
    Report("r26_destination_weekday", "destinationWeekday", "journey", DST, ("weekday1",)),
    Report("r27_card_sunday", "cardSunday", "journey", PCARD, ("sunday1",)),
    Report("r28_card_saturday", "cardSaturday", "journey", PCARD, ("saturday1",)),
    Report("r29_card_weekday", "cardWeekday", "journey", PCARD, ("weekday1",)),
    Report("r30_average_duration", "averageDuration", "journey", ("TAG1_DT_FK",), (), "avg_duration"),
    Report("r31_average_duration_sunday", "averageDurationSunday", "journey", ("TAG1_DT_FK",), ("sunday1",),
           "avg_duration"),
    Report("r32_average_duration_saturday", "averageDurationSaturday", "journey", ("TAG1_DT_FK",),
           ("saturday1",), "avg_duration"),
    Report("r33_average_duration_weekday", "averageDurationWeekday", "journey", ("TAG1_DT_FK",),
           ("weekday1",), "avg_duration"),
    Report("r34_unknown_station", "unknownStation", "unknowns", DST),
    Report("r35_unknown_card", "unknownCard", "unknowns", PCARD),
    Report("r36_unknown_station_weekday", "unknownStationWeekday", "unknowns", DST, ("weekday2",)),
    Report("r37_unknown_station_saturday", "unknownStationSaturday", "unknowns", DST, ("saturday2",)),
    Report("r38_unknown_station_sunday", "unknownStationSunday", "unknowns", DST, ("sunday2",)),
    Report("r39_unknown_card_weekday", "unknownCardWeekday", "unknowns", PCARD, ("weekday2",)),
    Report("r40_unknown_card_saturday", "unknownCardSaturday", "unknowns", PCARD, ("saturday2",)),
    Report("r41_unknown_card_sunday", "unknownCardSunday", "unknowns", PCARD, ("sunday2",)),
    Report("r42_type_route", "typeRoute", "selected", ("TS_TYP_CD", "ROUTE_val_NM"), ("route",)),
    # One row per time of day and mode (and card type): too many for one JSON document at scale.
    Report("r43_time_mode", "timeMode", "journey", ("TS_TYP_CD", "TAG1_TM"), sink="jsonl"),
    Report("r44_card_time_mode", "cardTimeMode", "journey", ("CARD_TYP_CD", "TS_TYP_CD", "TAG1_TM"), sink="jsonl"),
    Report("r45_time_station", "timeStation", "journey", ("TAG1_TS_NM", "TAG1_TM"), sink="csv"),
    Report("r46_time_mode_station", "timeModeStation", "journey", ("TS_TYP_CD", "TAG1_TS_NM", "TAG1_TM"),
           sink="csv"),
    Report("r47_offpeak_kpis", "offPeakKpis", "journey", (), (), "kpi_off", sink="console"),
    Report("r48_peak_kpis", "peakKpis", "journey", (), (), "kpi_peak", sink="console"),
)

BY_KEY = {r.key: r for r in REPORTS}


def condition(name: str, cfg: JourneyConfig) -> Column:
    """The filter vocabulary of the catalogue (three-valued, as the reference)."""
    if name in ("offpeak1", "peak1", "offpeak2", "peak2"):
        return C.off_peak_condition(name.startswith("off"), "TAG1" if name.endswith("1") else "TAG2")
    if name == "transfer":
        return C.intermodal_condition()
    if name == "route":
        return C.known_route_condition()
    for cls in ("sunday", "saturday", "weekday"):
        if name.startswith(cls):
            date_col = "TAG1_DT_FK" if name.endswith("1") else "TAG2_DT_FK"
            return C.day_class_condition(cls, date_col, cfg)
    raise KeyError(name)


def all_of(names, cfg: JourneyConfig) -> Column | None:
    cond = None
    for n in names:
        c = condition(n, cfg)
        cond = c if cond is None else (cond & c)
    return cond


def bases(selected: DataFrame, cfg: JourneyConfig) -> dict[str, DataFrame]:
    """The three base tables of the reports, lazily, from selected journey rows."""
    return {
        "selected": selected,
        "journey": T.clean_journeys(selected, cfg),
        "unknowns": T.clean_unknown(selected),
    }


def report_df(r: Report, base: DataFrame, cfg: JourneyConfig) -> DataFrame:
    """Run one report on its own base table."""
    where = all_of(r.where, cfg)
    if r.measure == "count":
        return A.segmented_count(base, r.keys, where)
    if r.measure == "avg_duration":
        return A.average_duration(base, r.keys[0], where)
    if r.measure == "kpi_off":
        return A.trip_kpis(base, condition("offpeak1", cfg), "TOTAL_OFF_PEAK_TRIPS")
    if r.measure == "kpi_peak":
        return A.trip_kpis(base, condition("peak1", cfg), "TOTAL_PEAK_TRIPS")
    raise ValueError(r.measure)


#: The finest key sets of the reports; all others are rolled up from these.
JOURNEY_SETS = {
    "card_transfer_dep": ("CARD_TYP_CD", "IMTT_DESC") + DEP,
    "card_dst": CARD + DST,
    "passenger": ("PSNGR_TYP_CD", "CARD_TYP_CD", "DISC_ENT_DESC"),
    "card_time": ("CARD_TYP_CD", "TS_TYP_CD", "TAG1_TM"),
    "station_time": ("TS_TYP_CD", "TAG1_TS_NM", "TAG1_TM"),
    "date": ("TAG1_DT_FK",),
}
UNKNOWN_SETS = {"unknown_station": DST, "unknown_card": PCARD}
JOURNEY_FLAGS = ("offpeak1", "peak1", "offpeak2", "peak2", "sunday1", "saturday1", "weekday1")
UNKNOWN_FLAGS = ("sunday2", "saturday2", "weekday2")


def _counted(df: DataFrame, keys, flags, cfg: JourneyConfig) -> tuple[DataFrame, list[Column]]:
    """``df`` with the keys and one 1-or-null column per condition (evaluated
    once, before rows are multiplied by key sets), and the counts over them."""
    out = df.select(*keys, *[F.when(condition(f, cfg), 1).alias(f) for f in flags])
    return out, [F.count(F.lit(1)).alias("all"), *[F.count(f).alias(f) for f in flags]]


def _keys(sets) -> list[str]:
    return list(dict.fromkeys(k for keys in sets.values() for k in keys))


class JourneySuite:
    """All journey reports from two aggregates over grouping sets.

    ``materialize_bases=True`` parses the raw rows once: the selected, cleaned
    and unknown tables are written as Parquet in the shared folder
    (``spark.checkpoint.dir``), so the window runs once and a lost executor
    never recomputes it. The cleaned table is then scanned once: one aggregate
    counts every condition for every key set (``JOURNEY_SETS``), and its few
    rows are written by set. The unknown trips likewise. Every report is a
    selection or roll-up of one set.
    """

    def __init__(self, raw: DataFrame, cfg: JourneyConfig | None = None,
                 materialize_bases: bool = False):
        self.cfg = cfg or JourneyConfig()
        self._materialized = materialize_bases
        self._written: list[str] = []
        self._grouped: dict[str, DataFrame] = {}
        self._families: dict[str, DataFrame] = {}
        selected = self._keep(T.select_journeys(raw, self.cfg), "selected")
        self.bases = {name: df if df is selected else self._keep(df, name)
                      for name, df in bases(selected, self.cfg).items()}

    def _keep(self, df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
        if not self._materialized:
            return df
        df, path = materialize_at(df, name, by)
        self._written.append(path)
        return df

    def close(self) -> None:
        """Delete the written tables."""
        self._families.clear()
        self._grouped.clear()
        release(self.bases["selected"].sparkSession, self._written)
        self._written = []

    # -- key sets ---------------------------------------------------------
    def _measured(self, base: str) -> tuple[DataFrame, list[Column]]:
        if base == "unknowns":
            return _counted(self.bases[base], _keys(UNKNOWN_SETS), UNKNOWN_FLAGS, self.cfg)
        j = self.bases["journey"]
        off, peak = condition("offpeak1", self.cfg), condition("peak1", self.cfg)
        sums = {"dur": F.col("JS_DURN_SEC"), "off_dur": F.when(off, F.col("JS_DURN_SEC")), "peak_dur": F.when(peak, F.col("JS_DURN_SEC")),
                "off_fare": F.when(off, F.col("JS_FARE_CENTS_AMT")), "peak_fare": F.when(peak, F.col("JS_FARE_CENTS_AMT"))}
        trips = {"off_trips": F.when(off, F.col("JRNY_ID")), "peak_trips": F.when(peak, F.col("JRNY_ID"))}
        df = j.withColumns({**sums, **trips})
        df, counts = _counted(df, [*_keys(JOURNEY_SETS), *sums, *trips], JOURNEY_FLAGS, self.cfg)
        return df, [*counts, F.sum("dur").alias("dur_sum"), F.count("dur").alias("dur_n"),
                    *[F.sum(c).alias(c) for c in list(sums)[1:]], *[F.count(c).alias(c) for c in trips]]

    def grouped(self, base: str) -> DataFrame:
        """All key sets of a base table from one scan of it, written by set."""
        if base not in self._grouped:
            df, measures = self._measured(base)
            sets = UNKNOWN_SETS if base == "unknowns" else JOURNEY_SETS
            self._grouped[base] = self._keep(A.grouping_sets(df, sets, measures), f"{base}-sets", (A.SET_COL,))
        return self._grouped[base]

    def _set(self, base: str, name: str) -> DataFrame:
        """One key set; without written tables its own aggregate is cheaper."""
        sets = UNKNOWN_SETS if base == "unknowns" else JOURNEY_SETS
        if self._materialized:
            return A.set_rows(self.grouped(base), name, sets)
        df, measures = self._measured(base)
        return df.groupBy(*sets[name]).agg(*measures)

    # -- families: the key sets and what is rolled up from them -------------
    def family(self, name: str) -> DataFrame:
        if name not in self._families:
            self._families[name] = self._build(name)
        return self._families[name]

    def _build(self, name: str) -> DataFrame:
        def rolled(fine: str, keys, cols):
            return self._set("journey", fine).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cols])

        day1 = ("sunday1", "saturday1", "weekday1")
        if name == "dep":
            return rolled("card_transfer_dep", DEP, ("all", "offpeak1", "peak1", *day1))
        if name == "card_dep":
            return rolled("card_transfer_dep", CARD + DEP, ("all", "offpeak1", "peak1"))
        if name == "dst":
            return rolled("card_dst", DST, ("all", "offpeak2", "peak2", *day1))
        if name == "intermodal":
            return self._set("journey", "card_transfer_dep").where(condition("transfer", self.cfg))
        if name == "kpis":
            d = self._set("journey", "date")
            return d.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) if c.endswith("trips") else F.sum(c).alias(c)
                           for c in ("off_trips", "off_dur", "off_fare", "peak_trips", "peak_dur", "peak_fare")])
        if name == "duration":
            return self._set("journey", "date").select("TAG1_DT_FK", "dur_sum", "dur_n")
        if name in ("card_dst", "passenger", "card_time", "station_time"):
            return self._set("journey", name)
        if name in UNKNOWN_SETS:
            return self._set("unknowns", name)
        if name == "route":
            return A.segmented_count(self.bases["selected"], ("TS_TYP_CD", "ROUTE_val_NM"), condition("route", self.cfg))
        raise KeyError(name)

    # -- single reports out of the families -----------------------------
    _PICK = {
        # report key -> (family, count column, rollup?)
        "r01_departure": ("dep", "all", False),
        "r02_departure_offpeak": ("dep", "offpeak1", False),
        "r03_departure_peak": ("dep", "peak1", False),
        "r21_departure_sunday": ("dep", "sunday1", False),
        "r22_departure_saturday": ("dep", "saturday1", False),
        "r23_departure_weekday": ("dep", "weekday1", False),
        "r04_destination": ("dst", "all", False),
        "r05_destination_offpeak": ("dst", "offpeak2", False),
        "r06_destination_peak": ("dst", "peak2", False),
        "r24_destination_sunday": ("dst", "sunday1", False),
        "r25_destination_saturday": ("dst", "saturday1", False),
        "r26_destination_weekday": ("dst", "weekday1", False),
        "r07_departure_card": ("card_dep", "all", False),
        "r08_departure_card_offpeak": ("card_dep", "offpeak1", False),
        "r09_departure_card_peak": ("card_dep", "peak1", False),
        "r10_destination_card": ("card_dst", "all", False),
        "r11_destination_card_offpeak": ("card_dst", "offpeak2", False),
        "r12_destination_card_peak": ("card_dst", "peak2", False),
        "r13_departure_intermodal": ("intermodal", "all", True),
        "r14_departure_intermodal_offpeak": ("intermodal", "offpeak1", True),
        "r15_departure_intermodal_peak": ("intermodal", "peak1", True),
        "r16_card_type_intermodal": ("intermodal", "all", True),
        "r17_passenger_card_discount": ("passenger", "all", False),
        "r18_passenger": ("passenger", "all", True),
        "r19_card_type": ("passenger", "all", True),
        "r27_card_sunday": ("passenger", "sunday1", True),
        "r28_card_saturday": ("passenger", "saturday1", True),
        "r29_card_weekday": ("passenger", "weekday1", True),
        "r44_card_time_mode": ("card_time", "all", False),
        "r43_time_mode": ("card_time", "all", True),
        "r20_transport_mode": ("card_time", "all", True),
        "r46_time_mode_station": ("station_time", "all", False),
        "r45_time_station": ("station_time", "all", True),
        "r34_unknown_station": ("unknown_station", "all", False),
        "r36_unknown_station_weekday": ("unknown_station", "weekday2", False),
        "r37_unknown_station_saturday": ("unknown_station", "saturday2", False),
        "r38_unknown_station_sunday": ("unknown_station", "sunday2", False),
        "r35_unknown_card": ("unknown_card", "all", False),
        "r39_unknown_card_weekday": ("unknown_card", "weekday2", False),
        "r40_unknown_card_saturday": ("unknown_card", "saturday2", False),
        "r41_unknown_card_sunday": ("unknown_card", "sunday2", False),
    }

    def report(self, key: str) -> DataFrame:
        r = BY_KEY[key]
        if key in self._PICK:
            fam, col, rollup = self._PICK[key]
            fused = self.family(fam)
            if rollup:
                return A.rollup_count(fused, r.keys, col)
            return A.pick_count(fused, r.keys, col)
        if r.measure == "avg_duration":
            return A.average_from_sums(self.family("duration"), "TAG1_DT_FK", all_of(r.where, self.cfg))
        if r.measure == "kpi_off":
            return A.kpi_row(self.family("kpis"), "off", "TOTAL_OFF_PEAK_TRIPS")
        if r.measure == "kpi_peak":
            return A.kpi_row(self.family("kpis"), "peak", "TOTAL_PEAK_TRIPS")
        if key == "r42_type_route":
            return self.family("route")
        raise KeyError(key)

    # -- every document report as (report, JSON record), one branch per aggregate
    def document_names(self, sinks_: tuple[str, ...] = ("info_json", "console")) -> list[str]:
        """Names of the reports that ``document_lines`` holds the records of."""
        return [r.name for r in REPORTS if r.sink in sinks_]

    def document_lines(self, sinks_: tuple[str, ...] = ("info_json", "console")) -> DataFrame:
        """All reports written as JSON documents, as rows (report, line).

        Reports taken from the same fused aggregate (or rolled up to the
        same keys) come out of ONE branch: an ``explode`` over their count
        columns. About 17 branches for 44 reports, each over the few rows of
        a written key set. Lines equal ``to_json`` of each report's
        own rows (keys, then the measure; nulls omitted).
        """
        wanted = [r for r in REPORTS if r.sink in sinks_]
        groups: dict[tuple, list] = {}
        for r in wanted:
            if r.key in self._PICK:
                fam, col, rollup = self._PICK[r.key]
                keys = r.keys if rollup else None
                groups.setdefault((fam, keys), []).append((r, col))
            else:
                groups.setdefault((r.measure if r.measure != "count" else r.key, None), []).append((r, None))
        branches = []
        for (fam, keys), members in groups.items():
            branches.append(self._lines(fam, keys, members))
        out = branches[0]
        for b in branches[1:]:
            out = out.unionByName(b)
        return out

    def _lines(self, fam: str, keys, members) -> DataFrame:
        def explode_lines(base: DataFrame, key_cols, picks, value_name="count") -> DataFrame:
            # picks: (report name, include condition or None, value column)
            arr = F.array(*[
                F.struct(
                    F.lit(name).alias("report"),
                    (F.lit(True) if cond is None else cond).alias("keep"),
                    value.alias("value"),
                ) for name, cond, value in picks
            ])
            rows = base.select(*key_cols, F.explode(arr).alias("__p"))
            rows = rows.where(F.col("__p.keep"))
            return rows.select(
                F.col("__p.report").alias("report"),
                F.to_json(F.struct(*[F.col(k) for k in key_cols], F.col("__p.value").alias(value_name))).alias("line"),
            )

        if fam in ("avg_duration",):
            sums = self.family("duration")
            avg = F.col("dur_sum").cast("double") / F.col("dur_n")
            picks = [(r.name, all_of(r.where, self.cfg), avg) for r, _ in members]
            return explode_lines(sums, ["TAG1_DT_FK"], picks, A.AVG_DURATION_COL)
        if fam in ("kpi_off", "kpi_peak"):
            k = self.family("kpis")
            r = members[0][0]
            row = A.kpi_row(k, "off" if fam == "kpi_off" else "peak",
                            "TOTAL_OFF_PEAK_TRIPS" if fam == "kpi_off" else "TOTAL_PEAK_TRIPS")
            return row.select(F.lit(r.name).alias("report"), F.to_json(F.struct(*row.columns)).alias("line"))
        if fam == "r42_type_route":
            r = members[0][0]
            df = self.family("route")
            return df.select(F.lit(r.name).alias("report"), F.to_json(F.struct(*df.columns)).alias("line"))
        fused = self.family(fam)
        key_cols = list(members[0][0].keys)
        if keys is not None:
            cols = sorted({c for _, c in members})
            fused = fused.groupBy(*key_cols).agg(*[F.sum(c).alias(c) for c in cols])
        picks = [(r.name, F.col(c) > 0, F.col(c)) for r, c in members]
        return explode_lines(fused, key_cols, picks)
