"""Print the formatted physical plan of registered queries (for plan review).

usage: python tools/explain_plans.py [sf_dir] [name ...]
Queries that write intermediate tables do that work while being planned.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lensmap.plans import catalog  # noqa: E402
from lensmap.session import build_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or ["R3_map_feedback", "T1_clean_text", "R2_build_feedback",
                             "V10_semantic_search", "C4_upsert_entities"]
    spark = build_session(shuffle_partitions=16)
    for n in names:
        print(f"===== {n}")
        catalog.QUERIES[n](spark, sf).explain("formatted")


if __name__ == "__main__":
    main()
