"""List physical-plan features of the registered queries that matter at scale."""
import sys

sys.path.insert(0, "/root/repo")
from provenor.catalogue import QUERIES  # noqa: E402
from provenor.session import build_session  # noqa: E402

spark = build_session("plans", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
spark.sparkContext.setLogLevel("ERROR")
for name, fn in QUERIES.items():
    df = fn(spark, "/root/testdata/sf0.001")
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    text = "\n".join(lines)
    flags = []
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapCoGroupsInPandas"):
        if word in text:
            flags.append(f"{word}x{text.count(word)}")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            above = next((u for u in reversed(lines[:i]) if "Sort" in u or "Window" in u or "Aggregate" in u or "Limit" in u or "TakeOrdered" in u), "")
            kind = "Window" if any("Window" in u for u in lines[max(0, i - 2):i]) else above.strip().split("(")[0][-20:]
            if "Aggregate" not in kind:
                flags.append(f"single[{kind}]")
    print(f"{name}: exchanges={text.count('Exchange hashpartitioning')} subqueries={text.count('Subquery subquery#')} {' '.join(flags)}", flush=True)
