"""python -m fathom [--version] | index|search|status STORE PATH [QUERY] | serve [STORE]: the three entry points, with JSON answers.

serve answers requests on standard input, one a line; without STORE the store is the folder that FATHOM_STORE names.
"""

from __future__ import annotations

import json
import os
import sys


def main(args: list[str]) -> int:
    if args in (["--version"], ["-v"]):
        from fathom.schema import VERSION

        print(f"fathom, dataset version {VERSION}")
        return 0
    if args[:1] == ["serve"] and len(args) <= 2 and (store := (args[1:] or [os.environ.get("FATHOM_STORE", "")])[0]):
        from pyspark.sql import SparkSession

        from fathom.plans.api import Engine
        from fathom.plans.serve import serve

        serve(Engine(SparkSession.builder.getOrCreate(), store, keep_results=True), sys.stdin, sys.stdout)
        return 0
    if len(args) < 3 or args[0] not in ("index", "search", "status") or (args[0] == "search") != (len(args) == 4):
        print(__doc__, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from fathom.plans.api import ApiError, Engine

    engine = Engine(SparkSession.builder.getOrCreate(), args[1])
    call = {"index": engine.index_codebase, "search": engine.search_code, "status": engine.get_status}[args[0]]
    try:
        answer, code = call({"path": args[2]} | ({"query": args[3]} if len(args) == 4 else {})), 0
    except ApiError as e:
        answer, code = {"error": {"code": e.code, "message": str(e)}}, 1
    print(json.dumps(answer, indent=2, sort_keys=True, default=str))
    return code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
