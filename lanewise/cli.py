"""Commands over a space: python -m lanewise.cli ROOT COMMAND ...

Exit codes: 0 done, 1 a mistake of the caller, 2 held by another session, 3 fenced.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from lanewise.errors import Fenced, Held, LogError
from lanewise.sources.files import Files
from lanewise.space import Space

READING = {"recall", "checkpoints", "log", "stats", "owner", "agents", "spaces"}


def _metadata(pairs: list[str]) -> dict[str, str]:
    if wrong := [p for p in pairs if "=" not in p]:
        raise ValueError(f"expected KEY=VALUE, not {wrong[0]!r}")
    return dict(p.split("=", 1) for p in pairs)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lanewise", description=__doc__)
    top.add_argument("root", help="folder or URI of the store")
    top.add_argument("--space", default="shared")
    top.add_argument("--agent", default="agent")
    top.add_argument("--json", action="store_true", help="one JSON object a line")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: tuple[tuple, dict]) -> None:
        command = commands.add_parser(name)
        for names, options in arguments:
            command.add_argument(*names, **options)

    add("init", (("--dim",), {"type": int}))
    add("remember", (("text",), {"nargs": "+"}), (("--meta",), {"action": "append", "default": [], "metavar": "KEY=VALUE"}), (("--note",), {"default": ""}))
    add("recall", (("query",), {}), (("-k",), {"type": int, "default": 5}), (("--where",), {"action": "append", "default": [], "metavar": "KEY=VALUE"}), (("--by",), {}), (("--at",), {}))
    add("forget", (("id",), {}))
    add("checkpoint", (("name",), {}))
    add("lease", (("name",), {}), (("--ttl",), {"type": float, "default": 30.0}))
    add("log", (("--limit",), {"type": int, "default": 20}), (("--by",), {}))
    add("compact", (("--width",), {"type": int}))
    add("gc", (("--keep",), {"type": int, "default": 1}))
    for name in ("checkpoints", "stats", "owner", "agents", "spaces"):
        add(name)
    return top


def run(args: argparse.Namespace, spark: SparkSession, show) -> None:
    if args.command == "spaces":
        return show([{"space": x} for x in Files(spark, args.root).names("")])
    root = f"{args.root.rstrip('/')}/{args.space}"
    if args.command not in ("init", "remember") and Files(spark, root).load("config.json") is None:
        raise ValueError(f"no space at {root}")
    with Space(spark, root, None if args.command in READING else args.agent, **({"dim": args.dim} if args.command == "init" else {})) as space:
        if args.command == "remember":
            rows = spark.createDataFrame([(t, json.dumps(_metadata(args.meta), sort_keys=True)) for t in args.text], "text string, metadata string")
            show(space.remember(rows, args.note))
        elif args.command == "recall":
            show(space.recall(args.query, args.k, _metadata(args.where) or None, args.by, args.at).select("fid", "score", "text", "metadata", "authors"))
        elif args.command == "forget":
            show(space.forget([space.resolve_id(args.id)]))
        elif args.command == "checkpoint":
            show([{"name": args.name, "cut": space.checkpoint(args.name)}])
        elif args.command == "checkpoints":
            show([{"name": x} for x in space.checkpoints()])
        elif args.command == "lease":
            with space.task(args.name, args.ttl) as lease:
                show([{"name": args.name, "epoch": lease.epoch}])
        elif args.command == "log":
            show(space.history(args.limit, args.by))
        elif args.command == "stats":
            show(space.stats())
        elif args.command == "owner":
            from lanewise.operators.lease import Lease

            show([{"agent": a, "holder": Lease(space.files, f"lanes/{a}").holder()} for a in space.agents()])
        elif args.command == "agents":
            show([{"agent": x} for x in space.agents()])
        elif args.command == "compact":
            space.compact(args.width)
        elif args.command == "gc":
            show([{"deleted": space.gc(args.keep)}])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)

    def show(rows: DataFrame | list[dict]) -> None:
        for row in (r.asDict() for r in rows.toLocalIterator()) if isinstance(rows, DataFrame) else rows:
            print(json.dumps(row, ensure_ascii=False, default=str) if args.json else "  ".join(f"{k}={v}" for k, v in row.items()))

    try:
        run(args, spark or SparkSession.builder.appName("lanewise").getOrCreate(), show)
    except Held as error:
        print(error, file=sys.stderr)
        return 2
    except Fenced as error:
        print(error, file=sys.stderr)
        return 3
    except (ValueError, KeyError, PermissionError, LogError) as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
