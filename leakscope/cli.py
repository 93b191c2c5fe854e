"""spark-submit cli.py audit INSTANCES DIFFS MEMBERS OUT [--dates T] [--content T] [--copies T] [--mode M] | audit-pro INSTANCES FILES OUT | report JSON OUT | history FOLDER"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import functions as F

from leakscope.functions.risk import to_date
from leakscope.plans import report as R
from leakscope.plans.audit import AuditConfig, audit, evidence_rows
from leakscope.plans.consensus import consensus
from leakscope.session import get_spark
from leakscope.sources.instances import check_required, normalise, read_rows


def main(args: list[str]) -> int:
    named = {args[i][2:]: args[i + 1] for i in range(len(args) - 1) if args[i].startswith("--")}
    args = [a for i, a in enumerate(args) if not a.startswith("--") and not (i and args[i - 1].startswith("--"))]
    match args:
        case ["audit", instances, diffs, members, out]:
            spark = get_spark()
            config = AuditConfig(mode=named.get("mode", "pr_diff"))
            raw = read_rows(spark, instances)
            check_required(raw.columns, config.mode)
            extra = {k: read_rows(spark, named[o]) for k, o in (("merge_dates", "dates"), ("content", "content"), ("replication", "copies")) if o in named}
            risks = audit(normalise(raw), read_rows(spark, diffs), read_rows(spark, members), config, **extra).persist()
            rows = evidence_rows(risks, config)
            risks.write.mode("overwrite").parquet(f"{out}/risks.parquet")
            rows.write.mode("overwrite").parquet(f"{out}/evidence.parquet")
            made = R.build_report(risks, rows, Path(instances).stem)
            print("\n".join(R.summary_lines(made)))
            R.write_json(made, f"{out}/report.json"), R.write_markdown(made, f"{out}/report.md"), R.write_html(made, f"{out}/report.html")
        case ["audit-pro", instances, files, out]:
            spark = get_spark()
            raw = read_rows(spark, instances)
            check_required(raw.columns, "consensus")
            i = normalise(raw).withColumn("day", to_date(F.col("created_at"))).dropDuplicates(["instance_id"])
            consensus(i, read_rows(spark, files)).write.mode("overwrite").parquet(f"{out}/consensus.parquet")
        case ["history", folder]:
            R.read_history(get_spark(), folder).show(100, False)
        case ["report", source, out]:
            made = R.read_json(source)
            (R.write_html if out.endswith(".html") else R.write_markdown)(made, out)
        case _:
            print(__doc__)
            return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
