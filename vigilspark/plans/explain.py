"""Print the final (post-AQE) physical plan of registered queries, condensed to
one line per operator, for plan review at any scale factor.

    python -m vigilspark.plans.explain /root/testdata/sf0.1 redact_documents rate_limit
"""

from __future__ import annotations

import re
import sys

KEEP = re.compile(r"(Exchange|Join|Aggregate|Window|Scan|Sort|TakeOrdered|Limit|Union|Generate|"
                  r"BroadcastExchange|WindowGroupLimit|Filter|Expand|ArrowEvalPython|BatchEvalPython|"
                  r"FlatMapGroupsInPandas|AQEShuffleRead|WholeStageCodegen|Coalesce)")


def condensed(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    out = []
    for line in plan.split("\n"):
        if not KEEP.search(line):
            continue
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r", \[plan_id=\d+\]", "", line)
        line = re.sub(r"Location: InMemoryFileIndex\([^)]*\)\[[^\]]*\]", "", line)
        out.append(line[:220])
    return "\n".join(out)


def main(argv):
    from ..session import get_session
    from .registry import queries
    sf_dir = "/root/testdata/sf0.1"
    names = []
    for a in argv:
        if a.startswith("/"):
            sf_dir = a
        else:
            names.append(a)
    spark = get_session("local[8]", 16)
    qs = queries()
    for n in names or sorted(qs):
        df = qs[n](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()  # final adaptive plan
        print(f"### {n}\n```\n{condensed(df)}\n```\n", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
