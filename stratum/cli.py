"""Command line: ``python -m stratum.cli ROOT COMMAND ...``; results are JSON or a table."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .engine import Engine
from .errors import EngineError
from .operators import browse, history
from .read import read
from .sources.replica import Replica

#: Rows that a read prints at most.
SHOWN = 500


def session() -> SparkSession:
    spark = SparkSession.builder.appName("stratum").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stratum")
    top.add_argument("root")
    sub = top.add_subparsers(dest="command", required=True)
    add = sub.add_parser
    add("init").add_argument("--force-new", action="store_true")
    add("schema").add_argument("table", nargs="?")
    for name in ("plan", "apply"):
        add(name).add_argument("-f", "--file", default="-", help="plan file; - reads standard input")
    r = add("read")
    r.add_argument("--sql", required=True)
    r.add_argument("--json", action="store_true")
    add("status")
    h = add("history")
    h.add_argument("--limit", type=int)
    h.add_argument("--page", type=int)
    h.add_argument("--kind", choices=("apply", "revert"))
    h.add_argument("--table")
    for name in ("revert", "recover"):
        add(name).add_argument("commit")
    add("verify").add_argument("--full", action="store_true")
    m = add("remote")
    m.add_argument("action", choices=("connect", "status"))
    m.add_argument("url", nargs="?")
    for name in ("push", "pull", "sync"):
        add(name)
    c = add("clone")
    c.add_argument("url")
    c.add_argument("--force-new", action="store_true")
    s = add("studio")
    s.add_argument("--port", type=int, default=7420)
    return top


def _plan(path: str) -> str:
    if path == "-":
        return sys.stdin.read()
    with open(path, encoding="utf-8") as f:
        return f.read()


def run(a: argparse.Namespace, spark: SparkSession):
    if a.command == "init":
        return Engine.init(spark, a.root, a.force_new).status()
    if a.command == "clone":
        return Replica.clone(spark, a.url, a.root, a.force_new).status()
    engine = Engine.open(spark, a.root)
    replica = Replica(engine)
    if a.command == "schema":
        return browse.describe_db(engine, a.table)
    if a.command == "plan":
        return engine.check(_plan(a.file))
    if a.command == "apply":
        commit = engine.apply(_plan(a.file))
        return {"commit": {k: v for k, v in commit.items() if k != "manifest"}, "warning": engine.size_warning(commit), "sync": replica.auto_sync()}
    if a.command == "read":
        rows = read(engine, a.sql).limit(SHOWN)
        if not a.json:
            rows.show(SHOWN, truncate=False)
            return None
        return [json.loads(r) for r in rows.toJSON().collect()]
    if a.command == "status":
        return engine.status()
    if a.command == "history":
        return history.history(engine.commits_df(), a.limit, a.page, a.kind, a.table)
    if a.command == "revert":
        out = engine.revert(a.commit)
        return out | {"commit": out["commit"] and out["commit"]["commitId"]}
    if a.command == "recover":
        return engine.recover(a.commit)
    if a.command == "verify":
        return engine.verify(a.full)
    if a.command == "remote":
        return replica.connect(a.url) if a.action == "connect" else replica.status()
    if a.command == "studio":
        from .http import serve

        serve(engine, a.port)
        return None
    return getattr(replica, a.command)()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        out = run(a, session())
    except EngineError as e:
        print(json.dumps(e.to_json(), ensure_ascii=False), file=sys.stderr)
        return 1
    if out is not None:
        print(json.dumps(out, ensure_ascii=False, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
