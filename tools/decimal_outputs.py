"""Regenerate vistaspark/plans/decimal_outputs.py: decimal output columns of each query.

usage: python tools/decimal_outputs.py
"""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import types as T  # noqa: E402

from vistaspark.plans.registry import REGISTRY, raw_build  # noqa: E402
from vistaspark.plans import catalog  # noqa: E402,F401
from vistaspark.session import build_session  # noqa: E402


def main() -> None:
    spark = build_session("local[8]", 8)
    out = {}
    for k, q in sorted(REGISTRY.items()):
        if not q.sql:
            continue
        df = raw_build(q, spark, "/root/testdata/sf0.001")
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)]
        if cols:
            out[k] = cols
    lines = ['"""Generated by tools/decimal_outputs.py: decimal (money) output columns per query.',
             "", "They leave the query as DOUBLE (cast after the exact decimal arithmetic) in both the",
             'Spark result and its DuckDB twin, so the two compare equal however they are read."""', "",
             "DECIMAL_OUTPUTS: dict[str, list[str]] = {"]
    lines += [f"    {k!r}: {v!r}," for k, v in out.items()] + ["}", ""]
    with open(os.path.join(ROOT, "vistaspark", "plans", "decimal_outputs.py"), "w") as f:
        f.write("\n".join(lines))
    print(len(out), "queries with decimal outputs")


if __name__ == "__main__":
    main()
