"""The command line's reading commands over HTTP: GET /COMMAND?work=..&limit=.. answers JSON, `python -m quillgraph --library DIR serve`.

Parameters are named like the command line's; a name that occurs several times is a list.  The server listens on this
machine alone unless it is told otherwise, and changes nothing.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

#: Rows of an answer; `limit` and `offset` page through more where a command has them.
MOST = 10_000


class BadRequest(ValueError):
    pass


def arguments(target: str, parser) -> list[str]:
    """The command line that a request stands for."""
    parts = urlsplit(target)
    command = parts.path.strip("/")
    asked = {k.replace("_", "-"): v for k, v in parse_qs(parts.query, keep_blank_values=True).items()}
    actions = parser._subparsers._group_actions[0].choices
    if command not in actions:
        raise BadRequest(f"no command is called {command!r}")
    plain, named = [], []
    for action in actions[command]._actions:
        if action.dest == "help":
            continue
        values = asked.pop(action.dest.replace("_", "-"), None)
        if values is None:
            continue
        if not action.option_strings:
            plain += values
        elif action.nargs == 0:
            named += [action.option_strings[0]] if values[-1] not in ("", "0", "false") else []
        else:
            named += [f"{action.option_strings[0]}={v}" for v in values]
    if asked:
        raise BadRequest(f"unknown parameters: {', '.join(sorted(asked))}")
    return [command, *named, *(["--", *plain] if plain else [])]


def answer(spark: SparkSession, library: str, target: str) -> tuple[int, dict]:
    """Status and body of a GET."""
    from quillgraph.__main__ import READS, Library, parser

    if urlsplit(target).path.strip("/") == "":
        return 200, {"commands": sorted(READS)}
    try:
        words = arguments(target, made := parser(strict=False))
        if words[0] not in READS:
            raise BadRequest(f"{words[0]} isn't served")
        a = made.parse_args(["--library", library, *words])
        rows = READS[a.command](Library(spark, a.library), a)
    except (ValueError, KeyError) as e:
        return 400, {"error": str(e)}
    found = [json.loads(x) for x in rows.limit(MOST + 1).toJSON().collect()]
    return 200, {"rows": found[:MOST], "more": len(found) > MOST}


def serve(spark: SparkSession, library: str, host: str = "127.0.0.1", port: int = 8765) -> ThreadingHTTPServer:
    """A server that is ready; the caller runs `serve_forever`."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, body = answer(spark, library, self.path)
            raw = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
