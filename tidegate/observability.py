"""Health, counters and information about a running engine as plain records, and where to show them."""

from __future__ import annotations

import json
import re
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .functions.scalars import printable

#: What only a detailed answer says.
SENSITIVE = ("application", "store", "roles")


def health_json(alive: bool, ready: bool, degraded: bool, reasons: dict[str, str]) -> str:
    """One line of JSON; reasons are cut to printable text, as they may hold what a record says."""
    return json.dumps({"status": "UP" if alive else "DOWN", "ready": ready, "degraded": degraded, "reasons": {k: printable(v) for k, v in sorted(reasons.items())}}, separators=(",", ":"))


def info_json(info: dict[str, object], detailed: bool = False) -> str:
    return json.dumps({k: v for k, v in info.items() if detailed or k not in SENSITIVE}, separators=(",", ":"), sort_keys=True)


def exposition(counters: dict[str, float | dict]) -> str:
    """Counters as text, one line each; a dictionary's keys become the partition label."""
    lines = []
    for name, value in sorted(counters.items()):
        plain = "tidegate_" + re.sub(r"[^a-z0-9_]", "_", name.lower())
        if isinstance(value, dict):
            lines += [f'{plain}{{partition="{k}"}} {v}' for k, v in sorted(value.items())]
        elif value is not None:
            lines.append(f"{plain} {value}")
    return "\n".join(lines) + "\n"


class Endpoints:
    """The three answers of one engine: /metrics, /health/live and /health/ready, /info."""

    def __init__(self, snapshot: Callable[[], dict], info: dict[str, object] | None = None, detailed: bool = False):
        self._snapshot, self._info, self._detailed = snapshot, info or {}, detailed

    def answer(self, path: str) -> tuple[int, str, str]:
        """Status, kind and body."""
        now = self._snapshot()
        if path == "/metrics":
            return 200, "text/plain; version=0.0.4", exposition({k: v for k, v in now.get("counters", {}).items() if not isinstance(v, (set, str))})
        if path in ("/health/live", "/health/ready"):
            good = now.get("live" if path.endswith("live") else "ready", False)
            return (200 if good else 503), "application/json", health_json(now.get("live", False), now.get("ready", False), now.get("degraded", False), now.get("reasons", {}))
        if path == "/info":
            return 200, "application/json", info_json(self._info, self._detailed)
        return 404, "text/plain", "not found\n"


class HttpObserver:
    """Serves the endpoints on a port (0: any free one) until it is closed."""

    def __init__(self, endpoints: Endpoints, address: str = "127.0.0.1", port: int = 0):
        class Handler(BaseHTTPRequestHandler):
            timeout = 10

            def do_GET(self):  # noqa: N802
                status, kind, body = endpoints.answer(self.path.split("?")[0])
                data = body.encode()
                self.send_response(status)
                self.send_header("Content-Type", kind)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *_):
                pass

        self._server = ThreadingHTTPServer((address, port), Handler)
        self._server.daemon_threads = True
        self.port = self._server.server_address[1]
        threading.Thread(target=self._server.serve_forever, daemon=True).start()

    def close(self) -> None:
        self._server.shutdown()
        self._server.server_close()


class NoObserver:
    """Shows nothing."""

    port = None

    def __init__(self, endpoints: Endpoints, *_):
        self.endpoints = endpoints

    def close(self) -> None:
        pass


OBSERVERS: dict[str, type] = {"none": NoObserver, "http": HttpObserver}


def observer(kind: str, endpoints: Endpoints, *args):
    if kind not in OBSERVERS:
        raise ValueError(f"no observer {kind!r}; there are {', '.join(sorted(OBSERVERS))}")
    return OBSERVERS[kind](endpoints, *args)
