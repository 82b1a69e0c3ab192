"""python -m docsift FOLDER REPORT: analyses a folder of PDF files."""

import sys

from pyspark.sql import SparkSession

from docsift.plans.report import run_directory


def main(args: list[str]) -> int:
    folder, out = (args + ["./pdfs", "./batches.json"][len(args) :])[:2]
    try:
        print(run_directory(SparkSession.builder.getOrCreate(), folder, out))
    except Exception as e:
        print(f"failed: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
