"""python tests/run_checks.py [dir] [prefix ...]: compare queries with their checks."""

import logging
import sys
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1])]

from compare import compare, connect  # noqa: E402
from gridwake.queries import ORACLES, QUERIES  # noqa: E402
from gridwake.session import build_session  # noqa: E402

if __name__ == "__main__":
    path = sys.argv[1]
    picks = sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                                                "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    logging.disable(logging.CRITICAL)
    con = connect(path)
    bad = 0
    for name in QUERIES:
        if picks and not any(name.startswith(p) for p in picks):
            continue
        try:
            res = compare(spark, con, name, QUERIES, ORACLES, path)
        except Exception as exc:  # noqa: BLE001
            res = {"name": name, "ok": False, "why": f"{type(exc).__name__}: {str(exc)[:400]}"}
        bad += not res["ok"]
        print(("ok  " if res["ok"] else "FAIL"), name, {k: v for k, v in res.items() if k not in ("name", "ok")}, flush=True)
    print("failures:", bad)
