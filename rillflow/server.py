"""A thin HTTP front: one session behind one port, and a gateway over sessions.

Session: ``POST /query`` with {"query": text}; ``GET /status`` in plain text, one of
``running``, ``stop-and-poll``, ``shutdown``. A ``Processor`` is a session that says to
a gateway where it listens.
Gateway: ``POST /login`` gives {"session_id": ...}; ``POST /query`` with a
session_id goes to that session; ``POST /registration/<key>`` with
{"action": "register", "ip": ..., "port": ...} or {"action": "unregister"} says
where a session's processor listens.
"""

from __future__ import annotations

import json
import random
import string
import threading
import urllib.error
import urllib.request
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .engine import Engine, Response


class _Front(BaseHTTPRequestHandler):
    answer: Callable[[str, str, str], Response | str]

    def _serve(self) -> None:
        size = int(self.headers.get("Content-Length") or 0)
        body = self.rfile.read(size).decode("utf-8", "replace")
        try:
            out = type(self).answer(self.command, self.path, body)
        except Exception as e:  # noqa: BLE001
            out = Response(500, {"result": str(e)})
        code, data, kind = (200, out, "text/plain") if isinstance(out, str) else (out.code, json.dumps(out.body, ensure_ascii=False), "application/json")
        self.send_response(code)
        self.send_header("Content-Type", f"{kind}; charset=utf-8")
        self.end_headers()
        self.wfile.write(data.encode())

    do_GET = do_POST = _serve

    def log_message(self, *args) -> None:
        pass


def listen(answer: Callable[[str, str, str], Response | str], port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """Serve ``answer(method, path, body)`` on a thread; port 0 takes a free one."""
    front = type("Front", (_Front,), {"answer": staticmethod(answer)})
    server = ThreadingHTTPServer((host, port), front)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


class Registration:
    """Tells a gateway where this session listens, and when it is gone.

    ``url`` is the gateway's ``/registration/<key>``. Both calls give None, or what went
    wrong: a bad address, a gateway that is away, an answer other than 2xx.
    """

    def __init__(self, url: str, seconds: float = 30):
        self.url, self.seconds = url, seconds

    def register(self, ip: str, port: int) -> str | None:
        return self._tell({"action": "register", "ip": ip, "port": port})

    def unregister(self) -> str | None:
        return self._tell({"action": "unregister"})

    def _tell(self, what: dict) -> str | None:
        try:
            request = urllib.request.Request(self.url, json.dumps(what).encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=self.seconds):  # noqa: S310
                return None
        except (OSError, ValueError) as e:
            return str(e)


class Processor:
    """An engine behind a port that registers with a gateway while it serves."""

    def __init__(self, engine: Engine, port: int = 0, registration: Registration | None = None, ip: str = "127.0.0.1"):
        self.registration = registration
        self.server = serve_engine(engine, port, host=ip)
        if registration is not None:
            error = registration.register(ip, self.server.server_address[1])
            if error is not None:
                self.server.shutdown()
                self.server.server_close()
                raise ConnectionError(f"registration failed: {error}")

    def close(self) -> str | None:
        """Stop listening; gives what went wrong when the gateway was told, or None."""
        self.server.shutdown()
        self.server.server_close()
        return None if self.registration is None else self.registration.unregister()


def serve_engine(engine: Engine, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    def answer(method: str, path: str, body: str) -> Response | str:
        if path == "/status":
            return engine.state
        if path != "/query" or method != "POST":
            return Response(404, {"result": "not found"})
        return engine.request(body)

    return listen(answer, port, host)


def _key() -> str:
    return "".join(random.SystemRandom().choices(string.ascii_letters + string.digits, k=20))


class Gateway:
    """Sessions by id and by secret key; ``start(key)`` launches a session's processor."""

    def __init__(self, start: Callable[[str], object], port: int = 9877):
        self.start = start
        self.places: dict[str, tuple[str, int] | None] = {}
        self.keys: dict[str, str] = {}
        self.lock = threading.Lock()
        self.server = listen(self.answer, port)

    def answer(self, method: str, path: str, body: str) -> Response | str:
        if path == "/login":
            session, key = _key(), _key()
            with self.lock:
                self.places[session], self.keys[key] = None, session
            self.start(key)
            return Response(200, {"session_id": session})
        try:
            asked = json.loads(body)
            if not isinstance(asked, dict):
                raise ValueError
        except ValueError:
            return Response(400, {"result": "the request is not a JSON object"})
        if path == "/query":
            return self._forward(asked)
        if path.startswith("/registration/"):
            return self._register(path.removeprefix("/registration/"), asked)
        return Response(404, {"result": "not found"})

    def _forward(self, asked: dict) -> Response:
        if not isinstance(asked.get("session_id"), str) or not isinstance(asked.get("query"), str):
            return Response(400, {"result": "session_id and query are needed"})
        if asked["session_id"] not in self.places:
            return Response(401, {"result": "unknown session_id"})
        place = self.places[asked["session_id"]]
        if place is None:
            return Response(503, {"result": "the processor has not registered yet"})
        request = urllib.request.Request(f"http://{place[0]}:{place[1]}/query", json.dumps({"query": asked["query"]}).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request) as r:  # noqa: S310
                return Response(r.status, json.load(r))
        except urllib.error.HTTPError as e:
            return Response(e.code, json.load(e))
        except (OSError, ValueError):
            return Response(502, {"result": "the processor cannot be reached"})

    def _register(self, key: str, asked: dict) -> Response:
        session = self.keys.get(key)
        if session is None:
            return Response(401, {"result": "unknown key"})
        if asked.get("action") == "register" and isinstance(asked.get("ip"), str) and isinstance(asked.get("port"), int):
            self.places[session] = (asked["ip"], asked["port"])
        elif asked.get("action") == "unregister":
            with self.lock:
                self.places.pop(session, None)
                self.keys.pop(key, None)
        else:
            return Response(400, {"result": "no such action"})
        return Response(200, {"result": "ok"})
