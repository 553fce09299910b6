"""Command line: ingest, reingest, list, get, find, verify, info, rm, doctor. Exit codes: 0 done, 1 not found or failed, 2 usage."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from leafmill.library import Library


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="leafmill")
    p.add_argument("--library", default=os.environ.get("LIB_HOME", "./library"))
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("ingest").add_argument("paths", nargs="+")
    sub.add_parser("list").add_argument("--json", action="store_true")
    get = sub.add_parser("get")
    get.add_argument("book")
    get.add_argument("--chapters")
    get.add_argument("--budget", type=int)
    get.add_argument("--from", dest="start", type=int, default=1)
    find = sub.add_parser("find")
    find.add_argument("query")
    find.add_argument("--limit", type=int, default=10)
    find.add_argument("--book")
    find.add_argument("--json", action="store_true")
    check = sub.add_parser("verify")
    check.add_argument("quote")
    check.add_argument("--book")
    check.add_argument("--json", action="store_true")
    for name in ("info", "rm"):
        sub.add_parser(name).add_argument("book")
    sub.add_parser("doctor")
    sub.add_parser("reingest")
    return p


def show(df, as_json: bool) -> int:
    rows = df.toJSON().collect() if as_json else ["\t".join("" if v is None else str(v) for v in r) for r in df.collect()]
    print(*rows, sep="\n")
    return len(rows)


def report(found) -> int:
    """The matches of a quote in words: where, how alike, the passage, and what differs."""
    rows = found.collect()
    for r in rows:
        print(f"{r.book}, chapter {r.n} ({r.title}): {r.verdict}, similarity {r.similarity:.4f}", f"  {r.passage}", sep="\n")
        for d in r["diff"]:
            print(f"  quoted: {d.quoted or '-'} / source: {d.source or '-'}")
    if not rows:
        print("not found")
    return len(rows)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    lib = Library(spark or SparkSession.builder.getOrCreate(), a.library)
    try:
        if a.command == "ingest":
            return int(lib.ingest(*a.paths).filter("status = 'failed'").count() > 0)
        if a.command == "list":
            show(lib.list_books(), a.json)
        elif a.command == "get":
            got = lib.get_chapters(a.book, a.chapters, a.budget, a.start)
            print(got["text"] or got.get("message", ""))
        elif a.command == "find":
            return int(not show(lib.find(a.query, a.limit, a.book), a.json))
        elif a.command == "verify":
            found = lib.verify(a.quote, a.book)
            return int(not (show(found, True) if a.json else report(found)))
        elif a.command == "info":
            show(lib.info(a.book), True)
        elif a.command == "reingest":
            return int(lib.reingest().filter("status = 'failed'").count() > 0)
        elif a.command == "rm":
            lib.remove(a.book)
        else:
            show(lib.review(), False)
    except (KeyError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2 if isinstance(e, ValueError) else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
