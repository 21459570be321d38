"""Time the headline queries at $BENCH_SF_DIR and print one JSON line.

The catalog tables are derived from the star schema before the clock starts, as a landing job
would; every query is then run to completion (all rows, all columns) into a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from harness.inputs import DEFINITIONS  # noqa: E402
from harness.queries import QUERIES, Catalog  # noqa: E402
from harness.session import local_session  # noqa: E402

HEADLINE = (
    "privilege_anomalies",
    "diagnose_rights",
    "role_closure",
    "effective_privileges",
    "render_commands",
    "reset_all_plan",
    "move_object_plan",
    "reassign_role_plan",
    "validate_changes",
    "registry_from_events",
    "menu_index",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark = local_session()
    catalog = Catalog(spark, sf_dir)
    started = time.time()
    for name in DEFINITIONS:
        getattr(catalog, name)
    catalog.usage, catalog.member
    landing = time.time() - started
    seconds = {}
    for name in names:
        started = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 2)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "access_governance_headline_queries",
                "value": round(sum(seconds.values()), 2),
                "unit": "sec",
                "queries": seconds,
                "landing": round(landing, 2),
                "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
