"""Command line: check, next, explain and validate."""

from __future__ import annotations

import argparse
import os
import sys
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession

from tidewatch import __version__
from tidewatch.operators.evaluate import exit_code
from tidewatch.plans import api, report
from tidewatch.sources.config import ConfigError, Issue
from tidewatch.sources.observe import QueryError


def instant(text: str) -> datetime:
    """An ISO date-time with an offset, in UTC."""
    try:
        value = datetime.fromisoformat(text)
    except ValueError:
        value = None
    if value is None or value.tzinfo is None:
        raise ConfigError([Issue("E211", f"--now must be an ISO 8601 date-time with a UTC offset; got '{text}'")])
    return value.astimezone(UTC).replace(tzinfo=None)


def observed(text: str) -> tuple[datetime | None, bool]:
    """``null``, or an ISO date-time: with an offset in UTC, without one as wall time."""
    if text == "null":
        return None, False
    try:
        value = datetime.fromisoformat(text)
    except ValueError as e:
        raise ConfigError([Issue("E211", f"--observed must be an ISO 8601 date-time (with or without a UTC offset) or 'null'; got '{text}'")]) from e
    return (value, True) if value.tzinfo is None else (value.astimezone(UTC).replace(tzinfo=None), False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidewatch")
    top.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    commands = top.add_subparsers(dest="command")
    for name in ("check", "next", "explain", "validate"):
        p = commands.add_parser(name)
        p.add_argument("-c", "--config", default="tidewatch.yml")
        p.add_argument("--now")
        if name == "explain":
            p.add_argument("source_id")
            p.add_argument("--observed")
            continue
        p.add_argument("-s", "--select", action="append", default=[])
        if name != "validate":
            p.add_argument("--format", choices=("table", "json"), default="table")
            p.add_argument("-o", "--output")
        if name == "next":
            p.add_argument("--count", type=int, choices=range(1, 101), default=3, metavar="1-100")
    return top


def _run(args: argparse.Namespace, spark: SparkSession) -> tuple[str, int]:
    now = instant(args.now) if args.now else datetime.now(UTC).replace(tzinfo=None)
    if args.command == "explain":
        given = observed(args.observed) if args.observed is not None else None
        lines, status = api.explain(spark, args.config, args.source_id, now, observed=given)
        return "\n".join(lines) + "\n", report.exit_code([status])
    if args.command == "validate":
        rows = api.validate(spark, args.config, now, args.select).collect()
        text = "".join(f"{r['message']}\n" for r in rows)
        errors = len({r["source_id"] for r in rows if r["severity"] == "error"})
        valid = len(api.load_entries(args.config, args.select)[1]) - errors
        return text + f"{valid} {'source' if valid == 1 else 'sources'} valid, {errors} with errors, {sum(r['severity'] == 'warning' for r in rows)} warnings\n", 2 if errors else 0
    if args.output and not report.writable(args.output):
        raise ConfigError([Issue("E217", f"cannot write output file {args.output}")])
    rows = (api.check(spark, args.config, now, args.select) if args.command == "check" else api.upcoming(spark, args.config, now, args.count, args.select)).cache()
    if args.command == "check" and args.format == "json" and args.output and rows.count() > report.ONE_FILE:
        report.write_json_report(rows, now, args.output + ".parts")
        return f"parts of this report are in {args.output}.parts\n", exit_code(rows).first()[0]
    text = report.json_report(rows, args.command, now) if args.format == "json" else report.table_report(rows, args.command, now)
    if args.command == "check":
        return text, report.exit_code([r["status"] for r in rows.select("status").collect()])
    return text, 2 if rows.where("error is not null").limit(1).count() else 0


def _deliver(text: str, code: int, output: str | None) -> int:
    """Write the text and give the exit code: a file that can't be written is E217 and at least 2; a reader that has gone
    away is no fault."""
    if output:
        try:
            Path(output).write_text(text, encoding="utf-8")
        except OSError as e:
            print(f"E217 cannot write output file {output}: {e.strerror}", file=sys.stderr)
            return max(code, 2)
        return code
    try:
        sys.stdout.write(text)
        sys.stdout.flush()  # here and not when the interpreter ends, where a broken pipe would be a fault
    except BrokenPipeError:
        if (hole := os.open(os.devnull, os.O_WRONLY)) >= 0 and hasattr(sys.stdout, "fileno"):
            try:
                os.dup2(hole, sys.stdout.fileno())
            except (OSError, ValueError):  # a stream without a descriptor has nothing left to flush
                pass
    return code


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return e.code if isinstance(e.code, int) else 0
    if not args.command:
        parser().print_usage(sys.stderr)
        return 2
    if hasattr(sys.stdout, "reconfigure"):  # names may hold what the terminal can't show
        sys.stdout.reconfigure(errors="backslashreplace")
    try:
        spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        text, code = _run(args, spark)
        return _deliver(text, code, getattr(args, "output", None))
    except ConfigError as e:
        print("\n".join(map(str, e.issues)), file=sys.stderr)
        return 2
    except QueryError as e:
        print(f"{e.code} {e}", file=sys.stderr)
        return 3
    except Exception as e:  # whatever else goes wrong is told in one line
        print(f"E599 internal error: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
