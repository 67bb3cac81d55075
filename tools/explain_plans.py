"""Write the formatted physical plans of the headline operators to docs/PLANS.md.

Usage: python tools/explain_plans.py [sf_dir]

The journey input is first written as Parquet with the declared schema, as a
production table would be, so the plans show pushdown and pruning at a real
scan. AQE is switched off here only so the printed plan is the final one
(with AQE the shape is the same, partition counts are decided at run time).
"""

from __future__ import annotations

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from faretrail.config import JourneyConfig  # noqa: E402
from faretrail.operators import aggregates as A  # noqa: E402
from faretrail.operators import survey as S  # noqa: E402
from faretrail.operators import transfers as T  # noqa: E402
from faretrail.plans import journey_reports as JR  # noqa: E402
from faretrail.plans.survey_plan import SurveyPlan  # noqa: E402
from faretrail.session import get_session  # noqa: E402
from faretrail.sources import adapters as AD  # noqa: E402


def formatted(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", **{"spark.sql.shuffle.partitions": "8"})
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    cfg = JourneyConfig.for_test_events()
    tmp = tempfile.mkdtemp(prefix="faretrail-plans-")
    jpath, spath = os.path.join(tmp, "journey"), os.path.join(tmp, "survey")
    AD.journeys(spark, sf_dir).write.parquet(jpath)
    AD.survey(spark, sf_dir).write.parquet(spath)
    raw = spark.read.parquet(jpath)
    suite = JR.JourneySuite(raw, cfg)
    measured, measures = suite._measured("journey")
    survey = SurveyPlan(spark.read.parquet(spath))
    sections = [
        ("C10: cleaned journeys with the counted card-day window (W1, T1-T3)",
         T.clean_journeys(T.select_journeys(raw, cfg), cfg)),
        ("R01-R41, R43-R48: all key sets of the cleaned table in one scan", A.grouping_sets(measured, JR.JOURNEY_SETS, measures)),
        ("R18: one aggregate over the cleaned rows", JR.report_df(JR.BY_KEY["r18_passenger"], suite.bases["journey"], cfg)),
        ("A8-A11: every cell of the survey in one scan", S.contingency(survey.raw, survey.all_cells(), survey.cfg.frequency)),
        ("A8: exact quartiles by rank from a weighted histogram", survey.box("Q9_A")),
        ("A12: covariance of a rating block, one aggregate", survey.covariance(survey.cfg.q9)),
    ]
    out = ["# Physical plans", "",
           "Generated by `tools/explain_plans.py` on the test tables written as Parquet "
           "(AQE off so the final plan prints; with AQE the shape is the same).", ""]
    for title, df in sections:
        out += [f"## {title}", "", "```", formatted(df).strip(), "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md")
    text = "\n".join(out).replace(tmp, "<tmp>")
    with open(path, "w") as f:
        f.write(text)
    print(path)
    spark.stop()


if __name__ == "__main__":
    main()
