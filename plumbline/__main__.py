"""``python -m plumbline``: score, self-check and compare runs of the drawing pipeline.

    score DIR       case folders with source.parquet-like pictures: writes DIR/summary.json and DIR/summary.md
    check DIR       the structural check of every case: writes DIR/check.json
    compare A B     two runs' summary.json; exits with 1 if a metric of a case got worse by more than its tolerance

DIR holds ``images`` (image_id, role, height, width, data), ``labels`` and ``detections`` (see operators.score) as Parquet.
"""

from __future__ import annotations

import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from plumbline.operators import checks, metrics, score
from plumbline.sources import formats


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("score", "check", "compare") or (args[0] == "compare") != (len(args) == 3):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    if args[0] == "compare":
        runs = [formats.summary(spark, f"{d}/summary.json", score.NAMES) for d in args[1:]]
        flagged = score.compare(*runs, key="case_id").where("flag <> 'same'").orderBy("case_id", "metric").collect()
        for r in flagged:
            print(f"{r['case_id']}: {r['metric']} {r['before']} -> {r['after']} {r['flag']}")
        worse = sum(r["flag"] == "regression" for r in flagged)
        print(f"{worse} regression(s)")
        return int(worse > 0)
    at = Path(args[1])
    read = lambda name: spark.read.parquet(f"{args[1]}/{name}")
    if args[0] == "score":
        found = score.score(read("images"), read("labels"), read("detections")).withColumnRenamed("image_id", "case_id").cache()
        (at / "summary.json").write_text(formats.summary_json(found, score.NAMES), encoding="utf-8")
        (at / "summary.md").write_text(formats.summary_table(formats.summary(spark, f"{args[1]}/summary.json", score.NAMES), score.NAMES), encoding="utf-8")
    else:
        found = checks.check(read("images"), read("labels").select("image_id", "x0", "y0", "x1", "y1")).cache()
        issues = {r["image_id"]: [] for r in found.select("image_id").collect()}
        for r in metrics.issue_records(found, ["image_id"]).collect():
            issues[r["image_id"]].append({k: r[k] for k in ("type", "stage", "detail", "hint", "regions")})
        (at / "check.json").write_text(json.dumps(issues, ensure_ascii=False, indent=1), encoding="utf-8")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
