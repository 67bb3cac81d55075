"""The three applications end to end: read, clean, report, write.

``python -m faretrail.plans.jobs journey --input 'dir/*.csv' --out out/``
``python -m faretrail.plans.jobs cards --manifest 'dir/0*_Cards.csv' --out out/``
``python -m faretrail.plans.jobs survey --input survey.csv --out out/``
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..config import JourneyConfig
from ..operators import aggregates as A
from ..operators import transfers as T
from ..schemas import JOURNEY_SCHEMA, SURVEY_SCHEMA
from ..session import get_session, input_bytes, size_shuffle_partitions
from ..sources.delimited import read_delimited
from ..sources.snapshots import (
    path_key, qualified_paths, read_card_snapshots, read_manifest, snapshot_text, with_snapshot_date,
)
from .journey_reports import REPORTS, JourneySuite
from .survey_plan import CROSSTABS, FREQUENCIES, Q9_ASPECT_MAP, Q10_ASPECT_MAP, SurveyPlan


def journey_job(raw: DataFrame, out_dir: str, cfg: JourneyConfig | None = None,
                materialize_bases: bool = True, single_file_csv: bool = False,
                show_kpis: bool = False, one_file: bool = False) -> dict[str, str]:
    """All journey reports from one cleaned table; each written with the
    reference's sink: JSON documents (one job for all), ``|`` delimited
    files for the stop-by-time reports (part files written in parallel;
    ``single_file_csv`` gathers each into one file as the reference does),
    JSON lines for the mode-by-time reports. ``show_kpis`` also prints the
    peak / off-peak totals to the console; ``one_file`` joins the parts of each
    document into ``documents/<name>.json``."""
    suite = JourneySuite(raw, cfg, materialize_bases=materialize_bases)
    if show_kpis:
        suite.report("r47_offpeak_kpis").show()
        suite.report("r48_peak_kpis").show()
    written = {"documents": sinks.write_documents_from_lines(
        suite.document_lines(), os.path.join(out_dir, "documents"), suite.document_names())}
    if one_file:
        for name in suite.document_names():
            folder = os.path.join(written["documents"], f"report={name}")
            written[name] = sinks.one_file(raw.sparkSession, folder, os.path.join(written["documents"], f"{name}.json"))
    for r in REPORTS:
        if r.sink == "csv":
            written[r.name] = os.path.join(out_dir, r.name + ".csv")
            sinks.write_delimited(suite.report(r.key), written[r.name], sep="|", single_file=single_file_csv)
        elif r.sink == "jsonl":
            written[r.name] = os.path.join(out_dir, r.name + ".jsonl")
            sinks.write_json_lines(suite.report(r.key), written[r.name])
    suite.close()
    return written


def card_job(spark: SparkSession, paths: list[str], out_dir: str, chronological: bool = False) -> dict[str, str]:
    """Rows per snapshot file (R49, by count ascending) and rows per file and
    card type after C11 (R50, by date text then type, or by date with
    ``chronological``). Every listed file in one scan; a file with no rows
    counts 0; two files of one date are two entries, as the reference counts
    file by file. Paths may be relative or without a scheme; rows of a file
    that is not listed raise."""
    paths = qualified_paths(spark, paths)
    cards = read_card_snapshots(spark, paths, keep_file=True).withColumn("file_path", path_key())
    # the file list is the manifest, not data
    expected = with_snapshot_date(spark.createDataFrame([(p,) for p in paths], "file_path string")).withColumn(
        "file_path", path_key(encoded=False))
    data_count = A.rows_per_snapshot(cards, expected=expected, by=["file_path"]).select(
        snapshot_text().alias("date"), "cardCount")
    card_count = A.card_type_counts(T.clean_cards(cards), by=["file_path"]).select(
        "snapshot_date", snapshot_text().alias("date"), F.col("CARD_TYP_CD").alias("type"), "typeCount")
    out = {"dataCount": os.path.join(out_dir, "dataCount.json"), "cardCount": os.path.join(out_dir, "cardCount.json")}
    sinks.write_info_json(data_count, out["dataCount"], order_by=["cardCount"])
    sinks.write_info_json(card_count, out["cardCount"],
                          order_by=["snapshot_date" if chronological else "date", "type"],
                          record_cols=["date", "type", "typeCount"])
    return out


def survey_tables(p: SurveyPlan) -> dict[str, DataFrame]:
    """Every survey result, grouped into one table per statistic family
    (a column names the block, question or cross-tab), and the labelled and
    melted respondent tables of the session. The 14 per-rating box plots and
    both melted blocks come from one histogram pass."""
    cfg = p.cfg
    cov = p.covariance(cfg.q9).withColumn("block", F.lit("Q9")).unionByName(
        p.covariance(cfg.q10).withColumn("block", F.lit("Q10")))
    rel = p.reliability(cfg.q9, "Q9").unionByName(p.reliability(cfg.q10, "Q10"))
    freq = None
    for c in FREQUENCIES:
        f = p.frequency(c).withColumn("question", F.lit(c))
        freq = f if freq is None else freq.unionByName(f)
    xt = None
    for a, b in CROSSTABS:
        t = p.crosstab(a, b).select(
            F.lit(a).alias("row_question"), F.col(a).alias("row_level"),
            F.lit(b).alias("col_question"), F.col(b).alias("col_level"), "count")
        xt = t if xt is None else xt.unionByName(t)
    aspects = {**Q9_ASPECT_MAP, **Q10_ASPECT_MAP}
    points = p.fenced()
    boxes = p.boxes(points).withColumn(
        "aspect", F.try_element_at(F.create_map(*[F.lit(x) for kv in aspects.items() for x in kv]), F.col("rating")))
    return {
        "covariance": cov, "reliability": rel, "frequency": freq, "crosstab": xt,
        "box_by_occupation": boxes, "box_outliers": p.outliers(points), "bar_occupation": p.bars(),
        "data": p.data, "commuters": p.commuters_labelled(), "non_commuters": p.non_commuters,
        "melt_q9": p.melted(cfg.q9, Q9_ASPECT_MAP), "melt_q10": p.melted(cfg.q10, Q10_ASPECT_MAP),
    }


def survey_job(raw: DataFrame, out_dir: str, materialize_data: bool = True) -> dict[str, str]:
    """The survey statistics written as Parquet tables (K5) plus the two
    covariance CSV files with a row index (K3), taken from the written table."""
    p = SurveyPlan(raw, materialize_data=materialize_data)
    written = sinks.save_results(survey_tables(p), os.path.join(out_dir, "results"))
    cov = raw.sparkSession.read.parquet(written["covariance"])
    for block in ("Q9", "Q10"):
        sinks.write_indexed_csv(cov.where(F.col("block") == block).drop("block"), os.path.join(out_dir, f"{block}_cov.csv"), ["col1", "col2"])
    p.close()
    return written


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="faretrail")
    ap.add_argument("job", choices=("journey", "cards", "survey"))
    ap.add_argument("--input")
    ap.add_argument("--manifest")
    ap.add_argument("--out", required=True)
    args = ap.parse_args(argv)
    spark = get_session()
    # size the shuffles to the input (metadata only; nothing is read)
    listed = args.input or read_manifest(spark, args.manifest)
    size_shuffle_partitions(spark, input_bytes(spark, listed))
    if args.job == "journey":
        journey_job(read_delimited(spark, args.input, JOURNEY_SCHEMA, sep="|"), args.out)
    elif args.job == "cards":
        card_job(spark, listed, args.out)
    else:
        from ..operators.cleaning import drop_positions, keep_positions

        raw = read_delimited(spark, args.input, None, sep=",")
        raw = drop_positions(raw, (1, 7, 8, 9, 23))
        raw = keep_positions(raw, range(1, len(SURVEY_SCHEMA.fields) + 1))
        raw = raw.toDF(*[f.name for f in SURVEY_SCHEMA.fields])
        raw = raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in SURVEY_SCHEMA.fields])
        survey_job(raw, args.out)


if __name__ == "__main__":
    main()
