"""Write PLANS.md: the final (adaptive) physical plan facts of every registered query.

    python scripts/plan_report.py [sf_dir] [--all]

Queries that train a model take minutes and are left out without --all. Per query:
the jobs that ran before its own plan did (checkpoints, written tables, fits), raw file scans, shuffles, reused shuffle stages, broadcast/sort-merge
joins, window operators, Python evaluation nodes and the pushed filters and
read schemas of the scans. Each plan comes from executing the query's own
QueryExecution, so AQE's runtime choices (reuse, broadcast conversion) show.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def facts(plan: str) -> dict:
    final = plan.split("+- == Initial Plan ==")[0]
    pushed = sorted(set(re.findall(r"PushedFilters: \[([^\]]*)\]", final)))
    schemas = sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", final)))
    return {
        "scans": final.count("FileScan") + final.count("Scan ExistingRDD") + final.count("Scan binaryFile"),
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", final)),
        "reused": final.count("Reused"),
        "bhj": final.count("BroadcastHashJoin"),
        "smj": final.count("SortMergeJoin"),
        "windows": final.count("Window ["),
        "python": final.count("BatchEvalPython") + final.count("ArrowEvalPython") + final.count("FlatMapGroupsInPandas"),
        "pushed": "; ".join(p for p in pushed if p)[:160],
        "schema": "; ".join(schemas)[:160],
    }


def main() -> None:
    from bench import TRAINING
    from surgecast.plans.catalog import QUERIES
    from surgecast.session import build_session

    given = [a for a in sys.argv[1:] if a != "--all"]
    sf = given[0] if given else "/root/testdata/sf0.01"
    spark = build_session()
    rows = []
    for name, q in QUERIES.items():
        if name in TRAINING and "--all" not in sys.argv:
            continue
        spark.sparkContext.setJobGroup(name, name)
        df = q(spark, sf)
        eager = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        df._jdf.collectAsList()
        rows.append((name, facts(df._jdf.queryExecution().executedPlan().toString()) | {"eager": eager}))
    out = ["# Physical plans (final AQE plans at " + os.path.basename(sf) + ")", "",
           "Generated by `scripts/plan_report.py`. `scans` counts file scans in the final plan (queries that",
           "read a checkpointed demand table show the checkpoint as `Scan ExistingRDD`); `reused` counts",
           "shuffle stages AQE reused instead of recomputing; `python` counts Python evaluation nodes.", "",
           "`eager` counts the Spark jobs that ran before that plan (checkpoints, written tables); a stream's",
           "own jobs run in its own group and are not in it.", "",
           "| query | eager | scans | shuffles | reused | BHJ | SMJ | windows | python | pushed filters | read schema |",
           "|---|--:|--:|--:|--:|--:|--:|--:|--:|---|---|"]
    for name, f in rows:
        out.append(f"| {name} | {f['eager']} | {f['scans']} | {f['shuffles']} | {f['reused']} | {f['bhj']} | {f['smj']} | "
                   f"{f['windows']} | {f['python']} | {f['pushed'].replace('|', '/')} | {f['schema']} |")
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as fh:
        fh.write("\n".join(out) + "\n")
    print(f"wrote {path} ({len(rows)} queries)")


if __name__ == "__main__":
    main()
