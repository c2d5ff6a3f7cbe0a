"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR   tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
"""

from __future__ import annotations

import json
import os
import pathlib
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Observation, SparkSession, functions as F  # noqa: E402

from labelloom.operators import evaluation, features, pruning, tuning  # noqa: E402
from labelloom.plans import classify, preprocess  # noqa: E402
from labelloom.plans.scratch import materialize  # noqa: E402
from labelloom.workload import inputs  # noqa: E402
from labelloom.workload.queries import PART_SETTINGS, QUERIES  # noqa: E402

TRIALS = 30

HEADLINE = [
    "txt_clean_text",
    "pipe_companies",
    "tfidf_vocab_size",
    "pipe_tfidf_classify",
    "pipe_ensemble_opt",
    "pipe_ensemble_basic",
]


def tune_search(spark, sf):
    """30 random trials on the 200-row sample."""
    return tuning.search(
        inputs.part_texts(spark, sf), inputs.part_labels(spark, sf),
        tuning.search_space(spark, TRIALS), settings=PART_SETTINGS,
        synonyms=inputs.synonyms(spark),
    )


def calibration() -> float:
    """Seconds of a fixed piece of work, to tell machines apart."""
    start, x = time.time(), 0
    for i in range(5_000_000):
        x = (x * 31 + i) & 0xFFFFFFFF
    return round(time.time() - start, 3)


def from_event_log(folder: str) -> tuple[dict[str, float], dict[str, int]]:
    """MB written for shuffles and number of jobs per job group."""
    group_of, mb, jobs = {}, {}, {}
    for path in sorted(p for p in pathlib.Path(folder).rglob("*") if p.is_file() and not p.name.startswith((".", "appstatus"))):
        with open(path) as log:
            for line in log:
                if '"SparkListenerJobStart"' in line:
                    event = json.loads(line)
                    group = (event.get("Properties") or {}).get("spark.jobGroup.id", "")
                    jobs[group] = jobs.get(group, 0) + 1
                    group_of.update(dict.fromkeys(event["Stage IDs"], group))
                elif '"SparkListenerTaskEnd"' in line:
                    event = json.loads(line)
                    written = ((event.get("Task Metrics") or {}).get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                    group = group_of.get(event["Stage ID"], "")
                    mb[group] = mb.get(group, 0) + written / 1e6
    return mb, jobs


def formed_pairs(spark, sf) -> dict[str, int]:
    """Company-label pairs with a common term, and those that the top-k join of
    pipe_tfidf_classify forms."""
    rows, postings, norms = classify.tfidf_features(inputs.cleaned_documents(spark, sf), inputs.benchmark(spark, sf))
    grams = rows.where("kind = 'gram'").select("company_id", "term", "w")
    every = grams.join(F.broadcast(postings.select("term", "label_id")), "term").select("company_id", "label_id").distinct()
    bounds = pruning.term_bounds(postings, 3)
    terms = pruning.bounded_terms(grams, norms, bounds, "company_id", 0.05)
    formed = pruning.partial_sums(terms, postings, "company_id")
    return {"all": every.count(), "formed": formed.count()}


def pairs_into_top_k(spark, sf) -> int:
    """Company-label pairs that the ensemble ranks."""
    companies = preprocess.preprocess_companies(inputs.parts(spark, sf), combined=False)
    _, pairs = classify.ensemble_pairs(
        companies, inputs.part_labels(spark, sf), PART_SETTINGS, synonyms=inputs.synonyms(spark),
        repeats=features.repeat_plan(companies), best=PART_SETTINGS.top_k,
    )
    return pairs.count()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    log_folder = tempfile.mkdtemp(prefix="bench-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("labelloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", f"file://{log_folder}")
        .config("spark.eventLog.compress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, rows = {}, {}

    def timed(name, build):
        spark.sparkContext.setJobGroup(name, name)
        start, seen = time.time(), Observation()
        build().observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        rows[name] = seen.get["rows"]
        spark.sparkContext.setJobGroup("", "")
        print(f"{name}: {seconds[name]} s, {rows[name]} rows", file=sys.stderr)

    # code is compiled and files are known before anything is timed
    QUERIES["txt_clean_text"](spark, sf).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, sf))
    timed("tune_search", lambda: tune_search(spark, sf))
    labeled = materialize(
        classify.tfidf_classify(inputs.cleaned_documents(spark, sf), inputs.benchmark(spark, sf)), "labeled"
    )
    timed("eval_report", lambda: evaluation.evaluation_report(labeled))
    pairs, ranked = formed_pairs(spark, sf), pairs_into_top_k(spark, sf)
    spark.stop()
    shuffle, jobs = from_event_log(log_folder)
    scale = re.search(r"sf([\d.]+)", sf)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "rows": rows,
        "shuffle_mb": {name: round(shuffle.get(name, 0.0), 1) for name in seconds},
        "jobs": {name: jobs.get(name, 0) for name in seconds},
        "pairs_into_top_k": ranked,
        "tfidf_pairs": pairs,
        "calibration_seconds": calibration(),
        "sf": float(scale.group(1)) if scale else None,
        "seconds_per_trial": round(seconds["tune_search"] / TRIALS, 3),
    }))


if __name__ == "__main__":
    main()
