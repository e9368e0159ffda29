"""Compare registered queries with their SQL: python tests/run_checks.py [filter] [sf]"""

from __future__ import annotations

import sys
import time
import traceback

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")

import __spark_entry__ as entry
from compare import compare, oracle_connection
from tidemark.session import local_session

pattern = sys.argv[1] if len(sys.argv) > 1 else ""
sf_dir = f"/root/testdata/sf{sys.argv[2] if len(sys.argv) > 2 else '0.01'}"
spark = local_session()
spark.sparkContext.setLogLevel("ERROR")
con = oracle_connection(sf_dir)
queries, oracles = entry.queries(), entry.oracle_sql()
bad = []
for name, fn in queries.items():
    if not any(p in name for p in pattern.split(",")):
        continue
    start = time.time()
    try:
        if name in oracles:
            problem = compare(fn, oracles[name], spark, sf_dir, con)
        else:
            n = fn(spark, sf_dir).count()
            problem = None if n else "EMPTY"
    except Exception as exc:
        text = str(exc)
        problem = "ERROR " + type(exc).__name__ + " " + text[:1500] + (traceback.format_exc()[-600:] if "JVM" not in text else "")
    took = time.time() - start
    print(f"{'ok  ' if problem is None else 'BAD '} {name} {took:.1f}s {'' if problem is None else problem}", flush=True)
    if problem:
        bad.append(name)
print(f"{len(bad)} bad: {bad}")
