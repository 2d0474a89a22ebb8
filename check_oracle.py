"""Run registered queries against their DuckDB oracles: python check_oracle.py [sf_dir] [name ...]"""

from __future__ import annotations

import json
import sys
import time

from gramframe.plans import ORACLE, QUERIES
from gramframe.plans.compare import compare
from gramframe.session import local_session


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or sorted(QUERIES)
    import os
    spark = local_session(shuffle_partitions=int(os.environ.get("CHECK_SHUFFLE_PARTITIONS", "8")))
    bad = 0
    for name in names:
        if name not in ORACLE:
            t0 = time.time()
            n = QUERIES[name](spark, sf_dir).count()
            print(json.dumps({"query": name, "rows_only": n, "sec": round(time.time() - t0, 2)}))
            continue
        t0 = time.time()
        try:
            res = compare(spark, name, sf_dir, QUERIES[name], ORACLE[name])
        except Exception as exc:  # report and go on
            res = {"query": name, "ok": False, "error": repr(exc)[:800]}
        res["sec"] = round(time.time() - t0, 2)
        bad += not res["ok"]
        print(json.dumps(res, default=str))
    print(json.dumps({"failed": bad, "checked": len(names)}))
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
