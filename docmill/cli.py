"""Command line: convert one file."""

from __future__ import annotations

import argparse
import signal
import sys
import threading
from datetime import datetime

from docmill.cancellation import Cancellation
from docmill.engine import Settings, convert
from docmill.sinks.parts import fresh_folder


def main(argv: list[str] | None = None) -> int:
    """Exit codes: 0 done, 1 error, 2 done with failures, 130 interrupted."""
    p = argparse.ArgumentParser(prog="docmill", description="Prepare a file for use with language models.")
    p.add_argument("source")
    p.add_argument("--output", help="folder; made from the file's name and the time if not given")
    p.add_argument("--profile", choices=["platform", "api"], default="platform")
    p.add_argument("--max-mib", type=float, default=50)
    p.add_argument("--max-tokens", type=int, default=500_000)
    p.add_argument("--include-html", action="store_true")
    a = p.parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("docmill").getOrCreate()
    out = a.output or fresh_folder(spark, a.source, a.source.rsplit("/", 1)[0] if "/" in a.source else ".", datetime.now())
    stop = Cancellation(spark)
    before = signal.signal(signal.SIGINT, lambda *_: stop.cancel()) if threading.current_thread() is threading.main_thread() else None
    try:
        report = convert(spark, a.source, out, Settings(a.max_mib, a.max_tokens, a.profile, a.include_html), lambda stage: print(stage, file=sys.stderr), stop)
    except Exception as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    finally:
        if before is not None:
            signal.signal(signal.SIGINT, before)
    if report["result"] == "cancelled":
        return 130
    print(f"{report['result']}: {out}")
    return 2 if report["result"] == "failure" or report["counts"].get("failed") else 0


if __name__ == "__main__":
    sys.exit(main())
