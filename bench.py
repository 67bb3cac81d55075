"""Benchmark: the three applications end to end on the driver's test tables.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REFERENCE_STYLE=1 also times the reference's shape (one plan, window
and action per report, window per date) for comparison.

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Every result is fully computed (``noop`` sink or a collect of a small
report); the cleaned journey table is written once to the shared folder.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from faretrail import sinks  # noqa: E402
from faretrail.config import JourneyConfig  # noqa: E402
from faretrail.operators import transfers as T  # noqa: E402
from faretrail.plans import catalogue  # noqa: E402
from faretrail.plans import journey_reports as JR  # noqa: E402
from faretrail.plans.survey_plan import SurveyPlan  # noqa: E402
from faretrail.session import get_session  # noqa: E402
from faretrail.sources import adapters as AD  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(out: dict, key: str, fn):
    t0 = time.perf_counter()
    res = fn()
    out[key] = round(time.perf_counter() - t0, 3)
    return res


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(
        f"local[{cpus}]",
        app="faretrail-bench",
        **{
            "spark.sql.shuffle.partitions": str(cpus * 2),
            "spark.driver.memory": "16g",
        },
    )
    cfg = JourneyConfig.for_test_events()
    q: dict[str, float] = {}
    t_all = time.perf_counter()

    # warm-up: JVM, parquet footers (not counted)
    AD.table(spark, sf_dir, "events").limit(1).collect()

    out_dir = tempfile.mkdtemp(prefix="faretrail-bench-")

    # 1. Journey application: clean + transfers once (written as Parquet), then
    #    all reports in one job (44 JSON documents) + 2 CSV + 2 JSON-lines files.
    suite = timed(q, "journey_clean_materialize",
                  lambda: JR.JourneySuite(AD.journeys(spark, sf_dir), cfg, materialize_bases=True))

    def journey_reports():
        sinks.write_documents_from_lines(suite.document_lines(), os.path.join(out_dir, "journey"), suite.document_names())
        for r in JR.REPORTS:
            if r.sink == "csv":
                sinks.write_delimited(suite.report(r.key), os.path.join(out_dir, r.name + ".csv"))
            elif r.sink == "jsonl":
                sinks.write_json_lines(suite.report(r.key), os.path.join(out_dir, r.name + ".jsonl"))

    timed(q, "journey_48_reports_write", journey_reports)
    suite.close()

    # Flagship query on its own, nothing reused: raw -> clean + transfers -> one report
    # (after the first phase, so the JVM warm-up is not charged to it).
    timed(q, "flagship_r13_standalone",
          lambda: catalogue.journey_report_queries(cfg)["r13_departure_intermodal"](spark, sf_dir).collect())

    # 2. Card snapshots (orders as monthly snapshots).
    qs = catalogue.card_queries()
    timed(q, "card_reports_write", lambda: sinks.write_info_documents(
        {k: qs[k](spark, sf_dir) for k in ("r49_data_count", "r50_card_count", "file_row_counts")},
        os.path.join(out_dir, "cards")))

    # 3. Survey: every statistic; answers written once, level codes read in one job,
    #    results grouped into 7 tables (one write job each).
    def survey():
        from faretrail.plans.jobs import survey_tables

        p = SurveyPlan(AD.survey(spark, sf_dir), materialize_data=True)
        sinks.save_results(survey_tables(p), os.path.join(out_dir, "survey"))
        p.close()

    timed(q, "survey_all_write", survey)

    value = round(time.perf_counter() - t_all, 3)

    extra = {}
    if os.environ.get("BENCH_REFERENCE_STYLE") == "1":
        # The reference's shape: every report re-reads, re-cleans and re-windows (window per date).
        def reference_style():
            for r in JR.REPORTS:
                sel = T.select_journeys(AD.journeys(spark, sf_dir), cfg)
                if r.base == "journey":
                    rep = T.repair_journeys(sel, cfg)
                    rep = T.detect_transfers(T.previous_trip_by_day(rep))
                    from faretrail.operators import cleaning as C

                    base = C.fold_to_allowed(C.positive_duration(C.relabel_transfers(rep)), "CARD_TYP_CD",
                                             cfg.allowed_card_types)
                else:
                    base = T.clean_unknown(sel) if r.base == "unknowns" else sel
                JR.report_df(r, base, cfg).collect()

        t0 = time.perf_counter()
        reference_style()
        extra["reference_style_48_reports"] = round(time.perf_counter() - t0, 3)

    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "journey+card+survey suite wall time",
        "value": value,
        "unit": "sec",
        "queries": q,
        "sf": float(sf.group(1)) if sf else None,
        "cpus": cpus,
        **extra,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
