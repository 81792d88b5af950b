"""Compare registered queries with their oracles: `python tests/check_queries.py [sf_dir] [key …]`."""

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402
from tallyfold.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    queries, oracles = entry.queries(), entry.oracle_sql()
    keys = sys.argv[2:] or list(queries)
    spark, con = local_session(8), compare.duck_connection(sf)
    bad = 0
    for key in keys:
        start = time.time()
        try:
            left = compare.spark_bag(queries[key](spark, sf))
            spent = time.time() - start
            note = compare.difference(left, compare.duck_bag(con, oracles[key])) if key in oracles else "no oracle"
            size = len(left[1])
        except Exception as e:  # noqa: BLE001 - report and go on
            note, spent, size = f"{type(e).__name__}: {str(e)[:900]}", time.time() - start, -1
        bad += note not in (None, "no oracle")
        print(f"{'ok ' if note is None else '-- ' if note == 'no oracle' else 'BAD'} {key} rows={size} {spent:.2f}s {note or ''}", flush=True)
    print(f"{len(keys)} queries, {bad} bad")
    spark.stop()
    sys.exit(1 if bad else 0)
