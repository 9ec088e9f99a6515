"""Command line: init, index update|rebuild, search, get, related, status, workspace discover."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from millrace.engine import Engine, Root, to_json
from millrace.errors import EngineError
from millrace.operators.models import HashingProvider, dimension, parse_model
from millrace.plans.present import render
from millrace.sources import workspace


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="millrace")
    out.add_argument("--place", required=True, help="folder of the durable tables")
    out.add_argument("--documents", action="append", default=[], metavar="ID=FOLDER")
    out.add_argument("--code", action="append", default=[], metavar="ID=FOLDER")
    out.add_argument("--model", default=None, help="embed with the hashing stand-in for this model")
    out.add_argument("--document-only", action="store_true", help="index whole sections, without chunks")
    out.add_argument("--workspace", default=None, metavar="PROFILE", help="take roots, rules and model from a profile beside them")
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("init")
    commands.add_parser("index").add_argument("what", choices=["update", "rebuild"])
    search = commands.add_parser("search")
    search.add_argument("text")
    search.add_argument("--mode", choices=["balanced", "current", "design"], default="balanced")
    search.add_argument("--format", choices=["technical", "human", "json"], default="technical")
    search.add_argument("--page", type=int, default=1)
    for name in ("get", "related"):
        commands.add_parser(name).add_argument("id")
    commands.add_parser("status")
    commands.add_parser("inspect").add_argument("folder")
    found = commands.add_parser("workspace")
    found.add_argument("what", choices=["discover"])
    found.add_argument("folder")
    found.add_argument("--save", default=None, metavar="PROFILE")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 for success, 1 for an engine error, 2 for wrong usage."""
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    spark = spark or SparkSession.builder.appName("millrace").getOrCreate()
    try:
        roots = [Root(*x.split("=", 1), contour) for contour, given in (("documents", args.documents), ("code", args.code)) for x in given]
        provider = model = None
        if args.model:
            model = parse_model(args.model)
            if model is None:
                raise EngineError("InvalidConfiguration", f"unknown model {args.model!r}")
            provider = HashingProvider(dimension(model))
        if args.command == "workspace":
            profile = workspace.profile_of(spark, args.folder)
            if args.save:
                profile.save(args.save)
            print(to_json({"schema_version": 1, "kind": "workspace", "documents": profile.documents, "code": profile.code}))
            return 0
        more = {"provider": provider, "chunked": not args.document_only}
        if args.workspace:
            engine = Engine.of_workspace(spark, args.place, workspace.Profile.load(args.workspace), Path(args.workspace).resolve().parent, **more)
            engine.roots += roots
            engine.model = model or engine.model
        else:
            engine = Engine(spark, args.place, roots, model or "multilingual-e5-small", **more)
        if args.command in ("init", "index"):
            print(to_json(engine.index(full=args.command == "init" or args.what == "rebuild")))
        elif args.command == "search":
            engine.index()  # a direct search sees the sources as they are
            print(render(engine.search(args.text, args.mode), args.format, args.page))
        elif args.command == "get":
            found = engine.get(args.id)
            if found is None:
                raise EngineError("NotFound", f"no such record: {args.id}")
            print(to_json(found))
        elif args.command == "related":
            print(to_json({"schema_version": 1, "kind": "related", "records": engine.related(args.id)}))
        elif args.command == "inspect":
            print(to_json(engine.export(args.folder)))
        else:
            print(to_json(engine.status()))
        return 0
    except EngineError as e:
        print(to_json({"schema_version": 1, "kind": "error", "code": e.code, "message": str(e)}), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
