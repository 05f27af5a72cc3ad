"""Publish the layers, or check the published gold tables, as a Spark job.

    python -m adtally all --root /lake/ads --source /landing/2026-03-01 \\
        --run-ts 2026-03-01T06:00:00 --run-id run-20260301
"""

from __future__ import annotations

import argparse
import json
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from adtally.functions.rules import DEFAULT_RULES, STRICT_RULES
from adtally.operators.fact import BROADCAST_LIMIT
from adtally.plans.bronze import ingest
from adtally.plans.merge import merge_silver
from adtally.plans.publish import (
    Lake,
    gold_report,
    publish,
    publish_bronze,
    publish_gold,
    publish_silver,
)
from adtally.session import SETTINGS
from adtally.sources.contracts import EVENT_GRAIN, EVENT_KEY
from adtally.sources.tables import typed_scan


def clock(text: str) -> datetime:
    """A time that no session's zone can move."""
    value = datetime.fromisoformat(text)
    return value if value.tzinfo else value.replace(tzinfo=UTC)


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="adtally", description=__doc__)
    parser.add_argument("step", choices=["bronze", "silver", "merge", "gold", "all", "check"])
    parser.add_argument("--root", required=True, help="folder of the schemas and the quarantine")
    parser.add_argument("--source", help="landed files under the source contract")
    parser.add_argument("--source-format", default="parquet")
    parser.add_argument("--format", default="parquet", help="table format of the layers")
    parser.add_argument("--catalog", default="spark_catalog")
    parser.add_argument("--bronze", default="bronze")
    parser.add_argument("--silver", default="silver")
    parser.add_argument("--gold", default="gold")
    parser.add_argument("--run-ts", required=True, type=clock, help="UTC if without an offset")
    parser.add_argument(
        "--broadcast-limit", type=int, default=BROADCAST_LIMIT,
        help="bytes up to which a dimension is broadcast",
    )
    parser.add_argument("--run-id", required=True)
    parser.add_argument("--strict", action="store_true", help="also apply the strict rules")
    parser.add_argument(
        "--stable-keys", action="store_true", help="members keep the keys that they have"
    )
    parser.add_argument(
        "--incremental", action="store_true", help="check what changed since the last such check"
    )
    parser.add_argument(
        "--cluster-by", nargs="*", default=[], metavar="COLUMN",
        help="columns by which silver is ordered inside its directories",
    )
    parser.add_argument("--by-grain", action="store_true", help="keep one row per market too")
    args = parser.parse_args(argv)
    if args.step in ("bronze", "merge", "all") and not args.source:
        parser.error(f"{args.step} needs --source")
    return args


def run(spark: SparkSession, args: argparse.Namespace) -> dict[str, int]:
    """Rows written per table; for a check, the failures of each failed test."""
    lake = Lake(args.root, args.catalog, args.bronze, args.silver, args.gold, args.format)
    rules = STRICT_RULES if args.strict else DEFAULT_RULES
    keys = EVENT_GRAIN if args.by_grain else EVENT_KEY
    run_date = args.run_ts.date()
    if args.step == "all":
        source = typed_scan(spark, args.source, fmt=args.source_format)
        return publish(
            source, lake, args.run_ts, run_date, args.run_id, rules, keys, args.broadcast_limit,
            stable_keys=args.stable_keys,
        )
    lake.prepare(spark)
    if args.step == "bronze":
        source = typed_scan(spark, args.source, fmt=args.source_format)
        return {"bronze": publish_bronze(source, lake, args.run_ts)}
    if args.step == "silver":
        counts = publish_silver(
            spark, lake, args.run_ts, args.run_id, rules, keys, args.cluster_by
        )
        return dict(zip(("silver", "rejected"), counts, strict=True))
    if args.step == "merge":
        source = ingest(typed_scan(spark, args.source, fmt=args.source_format), args.run_ts)
        merged = merge_silver(source, lake, args.run_ts, args.run_id, rules, keys)
        return {"silver": merged.rows, "rejected": merged.rejected}
    if args.step == "check":
        failed = gold_report(spark, lake, args.incremental).where("failures > 0").collect()
        return {f"{r.check} {r.table_name}.{r.column_name}": r.failures for r in failed}
    return publish_gold(spark, lake, run_date, args.broadcast_limit, args.stable_keys)


def main() -> None:
    args = parse()
    builder = SparkSession.builder.appName(f"adtally {args.step}")
    spark = builder.config(map=SETTINGS).getOrCreate()
    counts = run(spark, args)
    print(json.dumps(counts))
    if args.step == "check" and counts:
        raise SystemExit(1)


if __name__ == "__main__":
    main()
