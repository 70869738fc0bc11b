"""Write the executed plans (after AQE) of the main queries to PLANS.md.

usage: python scripts/show_plans.py [sf_dir]
"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from threadlens.catalog import QUERIES  # noqa: E402
from threadlens.session import build_session  # noqa: E402

NOTES = {
    "filter_blocked": "The filter on the raw column is in `PushedFilters` of the scan.",
    "engaged_descriptions": "Two semi joins on keys; `pages` is not read; texts only in the last distinct.",
    "compile_engagement": "Articles with a topic by digest, then comments, then reactions; texts come with the last join.",
    "dedupe_keep_first": "Ranks on the written key rows (second scan of one table), texts joined to the kept rows.",
    "top_topic_per_user": "Ranks on the written counts; the history itself is read once, when they are written.",
    "user_conversation_rank": "Ranks distinct counts, joins the rank back; one scan, one exchange reused.",
    "knn": "Routed rows to small groups; the final top-k has a partial limit before its exchange.",
}
KEEP = re.compile(r"Scan|Join|Exchange|Window|Aggregate|Pandas|Arrow|Sort |Limit|Union")


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(extra={"spark.sql.autoBroadcastJoinThreshold": "-1"})
    out = ["# Executed plans", "", f"`python scripts/show_plans.py {sf_dir}`: operators of the plan that ran (after AQE), broadcasts",
           "off, as at a scale where no side is small. Expression ids and long lists are shortened.", ""]
    for name, note in NOTES.items():
        df = QUERIES[name](spark, sf_dir)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        lines = [re.sub(r"#\d+L?|, \[plan_id=\d+\]|file:[^,\]]*/", "", x).replace("AdaptiveSparkPlan", "") for x in plan.split("\n")
                 if KEEP.search(x)]
        out += [f"## {name}", "", note, "", "```", *[x[:170].rstrip() for x in lines], "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
