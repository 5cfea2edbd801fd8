"""Run corpus queries against their SQL:  python -m tests.llm.run SF_DIR [query ...]"""

import sys
import time

from tests.oracle_check import compare, connect
from tracewell.llm.queries import LLM_ORACLES, LLM_QUERIES
from tracewell.session import build_session


def main(sf_dir, names):
    spark, con, bad = build_session(), connect(sf_dir), 0
    for name in names or LLM_QUERIES:
        start = time.time()
        if name in LLM_ORACLES:
            problems = compare(LLM_QUERIES[name](spark, sf_dir), con, LLM_ORACLES[name])
        else:
            df = LLM_QUERIES[name](spark, sf_dir)
            problems = []
            df.show(8, truncate=60)
            print(df.count())
        bad += bool(problems)
        print("FAIL" if problems else "ok", name, f"{time.time() - start:.2f}s", *problems, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
