"""Print the formatted physical plan of registered queries over the stored layout.

usage: python tools/show_plan.py KEY [KEY ...]   (SF dir from $SF_DIR, default /root/testdata/sf0.01)

The four tables are first written in the stored layout (facts partitioned by Year) under the
session's checkpoint folder, so the plans show partition pruning and pushed filters as a
deployment would see them.
"""

from __future__ import annotations

import os
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    keys = sys.argv[1:]
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    from salescope.plans import registry
    from salescope.session import build_session, checkpoint_dir
    from salescope.sources.ingest import write_tables
    from salescope.sources.tables import load_tables, star_tables

    spark = build_session(master="local[8]", shuffle_partitions=16, app="salescope-plans")
    root = f"{checkpoint_dir(spark).rstrip('/')}/salescope-plans-{uuid.uuid4().hex[:8]}"
    write_tables(star_tables(spark, sf_dir), root)
    tables = load_tables(spark, root)
    for key in keys or ["oos_items"]:
        print(f"===== {key} =====")
        registry.run_on(tables, spark, key, sf_dir).explain("formatted")


if __name__ == "__main__":
    main()
