"""EP8: the library over HTTP, with the standard library's server; JSON in and out."""

from __future__ import annotations

import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote, urlsplit

from .library import Library, LibraryError

_NOT_FOUND = {"WORLD_NOT_FOUND", "ASSET_NOT_FOUND"}
LIMIT = 4 << 20


def _handler(library: Library):
    asset = r"/api/user-assets/([^/]+)"
    routes = [
        ("GET", r"/api/health", lambda m, b, h: {"status": "ok"}),
        ("GET", r"/api/worlds", lambda m, b, h: {"worlds": [r.asDict() for r in library.worlds().collect()]}),
        ("GET", r"/api/worlds/([^/]+)/detail", lambda m, b, h: library.detail(m[1])),
        ("PATCH", r"/api/worlds/([^/]+)/detail", lambda m, b, h: library.save(m[1], **{k: v for k, v in json.loads(b or b"{}").items() if k in ("display_name", "description", "background_asset_id", "font_asset_id")})),
        ("POST", r"/api/user-assets/(image|font)s", lambda m, b, h: {"asset_id": library.upload(m[1], b, unquote(h.get("X-Filename") or ""))}),
        ("GET", asset + "/delete-impact", lambda m, b, h: library.delete_impact(m[1])), ("GET", asset, lambda m, b, h: library.content(m[1])), ("DELETE", asset, lambda m, b, h: library.delete(m[1])),
    ]

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > LIMIT:
                return self._send(413, {"error": "ASSET_TOO_LARGE"})
            body = self.rfile.read(size)
            for method, pattern, call in routes:
                if method == self.command and (m := re.fullmatch(pattern, unquote(urlsplit(self.path).path))):
                    try:
                        return self._send(200, call(m, body, self.headers))
                    except LibraryError as e:
                        return self._send(404 if str(e) in _NOT_FOUND else 400, {"error": str(e)})
                    except (ValueError, TypeError):
                        return self._send(400, {"error": "REQUEST_INVALID"})
            self._send(404, {"error": "NOT_FOUND"})

        do_GET = do_POST = do_PATCH = do_DELETE = _answer

        def _send(self, code: int, answer) -> None:
            data, kind = answer if isinstance(answer, tuple) else (json.dumps(answer, default=str).encode(), "application/json")
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

    return Handler


def serve(library: Library, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that is bound but not started: call serve_forever()."""
    return ThreadingHTTPServer((host, port), _handler(library))
