"""A small HTTP server: /health, /<collection>/get/<key>, /<collection>/search?..."""

from __future__ import annotations

import json
import logging
from collections.abc import Iterable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from itertools import chain
from urllib.parse import parse_qsl, unquote, urlsplit

from frostline.plans.catalog import Catalog

log = logging.getLogger(__name__)
PARAMETERS = ("q", "lat", "lon", "radius", "min_lat", "min_lon", "max_lat", "max_lon", "filter_by", "top_n", "group_by")


def respond(catalog: Catalog, target: str) -> tuple[int, str, Iterable[str]]:
    """Status, content type and the pieces of the body of a GET request. It holds one set of collections throughout."""
    parts, collections = urlsplit(target), catalog.collections
    steps = [unquote(s) for s in parts.path.strip("/").split("/")]
    if steps == ["health"]:
        return 200, "application/json", [json.dumps([c.health() for c in collections.values()])]
    if len(steps) < 2 or steps[0] not in collections:
        return 404, "text/plain", ["no such collection"]
    collection = collections[steps[0]]
    try:
        if steps[1] == "get" and len(steps) == 3:
            found = collection.get_json(steps[2])
            return (200, "application/json", [found]) if found else (404, "text/plain", ["no such document"])
        if steps[1:] == ["search"]:
            given = dict(parse_qsl(parts.query, keep_blank_values=True))
            given.setdefault("filter_by", given.get("filter"))
            body = collection.rendered("json" if given.get("output") == "json" else "geojson", **{k: given.get(k) for k in PARAMETERS})
            first = [next(body), next(body)]  # the first row, so that a search that fails is an error
            return 200, "application/json", chain(first, body)
    except Exception as e:  # noqa: BLE001
        log.warning("%s: %s", target, e)
        return 500, "text/plain", [f"the search failed: {e}"]
    return 404, "text/plain", ["no such path"]


def serve(catalog: Catalog, host: str = "127.0.0.1", port: int = 3001) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            status, kind, body = respond(catalog, self.path)
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.end_headers()  # HTTP/1.0: the end of the body is that of the connection
            for piece in body:
                self.wfile.write(piece.encode())

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
