"""python -m maskwright.cli scan FILE | redact FILE --output FILE [--dry-run] | evaluate FOLDER --predictions TABLE"""

from __future__ import annotations

import argparse
import json
import sys


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="maskwright", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("scan").add_argument("file")
    redact = commands.add_parser("redact")
    redact.add_argument("file")
    redact.add_argument("--output")
    redact.add_argument("--dry-run", action="store_true")
    evaluate = commands.add_parser("evaluate")
    evaluate.add_argument("folder")
    evaluate.add_argument("--predictions", required=True)
    given = parser.parse_args(arguments)

    from pyspark.sql import SparkSession

    from .operators import score
    from .plans import documents, ground_truth

    spark = SparkSession.builder.appName("maskwright").getOrCreate()
    try:
        if given.command == "scan":
            out = documents.scan_report(spark, given.file)
        elif given.command == "evaluate":
            containers, truth = ground_truth.load(spark, given.folder)
            made = spark.read.parquet(given.predictions).join(containers, "container_id", "left_semi")
            out = score.evaluation_report(made, truth)
        elif given.dry_run:
            secret, source = documents.secret_from_environment()
            out = documents.dry_run(spark, given.file, secret) | {"pseudonym_key_source": source}
        else:
            if not given.output:
                parser.error("redact needs --output or --dry-run")
            secret, source = documents.secret_from_environment(required=True)
            out = documents.redact(spark, given.file, given.output, secret) | {"pseudonym_key_source": source}
    except (ValueError, OSError) as e:
        print(f"maskwright: {e}", file=sys.stderr)
        return 1
    print(json.dumps(out, indent=2, sort_keys=True))
    return 0


if __name__ == "__main__":
    sys.exit(main())
