"""The engine over HTTP: eight JSON routes, errors as problem details."""

from __future__ import annotations

import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from .engine import Engine
from .errors import STATUS, EngineError
from .operators import browse, history


def _number(query: dict, name: str) -> int | None:
    value = query.get(name, [None])[0]
    if value is None:
        return None
    if not re.fullmatch(r"-?\d{1,9}", value):
        raise EngineError("INVALID_OPERATION", f"{name} is no number")
    return int(value)


def _history(engine: Engine, query: dict, table: str | None = None) -> dict:
    kind = query.get("kind", [None])[0]
    return {"commits": history.history(engine.commits_df(), _number(query, "limit"), _number(query, "page"), kind, table or query.get("table", [None])[0])}


def _commit(engine: Engine, commit_id: str) -> dict:
    commit = engine.find_commit(commit_id)
    effects = [json.loads(r) for r in engine.commit_effects(commit).limit(500).toJSON().collect()]
    return {"commit": {k: v for k, v in commit.items() if k not in ("manifest", "operations", "schemaEffects")}, "operations": commit["operations"], "rowEffects": effects, "schemaEffects": commit["schemaEffects"]}


def _rows(engine: Engine, table: str, body: dict) -> dict:
    known = {"page": "page", "pageSize": "limit", "sortBy": "sort_by", "sortDir": "sort_dir", "filters": "filters"}
    if not isinstance(body, dict) or set(body) - set(known):
        raise EngineError("INVALID_OPERATION", f"the body may hold {', '.join(known)}")
    return browse.query_table(engine, table, **{known[k]: v for k, v in body.items() if v is not None})


def _revert(engine: Engine, commit_id: str) -> tuple[int, dict]:
    out = engine.revert(commit_id)
    return (200 if out["ok"] else 409), out | {"commit": out["commit"] and out["commit"]["commitId"]}


def handle(engine: Engine, method: str, target: str, body: str = "") -> tuple[int, dict]:
    """Status and JSON body of one request."""
    url = urlsplit(target)
    query = parse_qs(url.query)
    routes = [
        ("GET", r"/api/tables", lambda: {"tables": browse.table_overview(engine)}),
        ("POST", r"/api/tables/([^/]+)/rows/query", lambda t: _rows(engine, t, json.loads(body or "{}"))),
        ("GET", r"/api/tables/([^/]+)/schema", lambda t: browse.describe_db(engine, t)),
        ("GET", r"/api/tables/([^/]+)/history", lambda t: _history(engine, query, t)),
        ("GET", r"/api/commits", lambda: _history(engine, query)),
        ("GET", r"/api/commits/([^/]+)", lambda c: _commit(engine, c)),
        ("POST", r"/api/commits/([^/]+)/revert", lambda c: _revert(engine, c)),
        ("GET", r"/api/status", lambda: engine.status()),
    ]
    try:
        for verb, form, run in routes:
            m = re.fullmatch(form, url.path)
            if m and verb == method:
                out = run(*map(unquote, m.groups()))
                return out if isinstance(out, tuple) else (200, out)
        raise EngineError("NOT_FOUND", f"no such route: {method} {url.path}")
    except EngineError as e:
        return STATUS[e.code], e.problem(url.path)
    except ValueError as e:
        return 400, EngineError("INVALID_JSON", str(e)).problem(url.path)


def serve(engine: Engine, port: int) -> None:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            status, out = handle(engine, self.command, self.path, body)
            data = json.dumps(out, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json" if status < 400 else "application/problem+json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer  # noqa: N815

    ThreadingHTTPServer(("127.0.0.1", port), Handler).serve_forever()
