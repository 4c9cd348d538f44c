"""What ``jql`` offers to the bodies of Python functions: HTTP and mail.

Each call gives an ``Attempt`` and never raises: an answer other than 2xx, a bad
address or a lost connection is an attempt without success.
"""

from __future__ import annotations

import smtplib
import urllib.parse
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from email.message import EmailMessage

SECONDS = 60  # a call that hangs must not hold a task for ever


@dataclass(frozen=True)
class Attempt:
    isSuccess: bool  # noqa: N815
    get: str | None = None
    error: str | None = None


def _attempt(f: Callable[[], str]) -> Attempt:
    try:
        return Attempt(True, f())
    except Exception as e:  # noqa: BLE001
        return Attempt(False, error=str(e))


def _form(values: Mapping) -> str:
    """Values as a form; whole numbers are written without a fraction."""
    shown = {str(k): str(int(v)) if isinstance(v, float) and v.is_integer() else str(v) for k, v in values.items()}
    return urllib.parse.urlencode(shown)


def _http(url: str, data: bytes | None = None, kind: str = "text/plain; charset=utf-8") -> str:
    if urllib.parse.urlparse(url).scheme not in ("http", "https"):
        raise ValueError(f"not an HTTP address: {url}")
    request = urllib.request.Request(url, data, {} if data is None else {"Content-Type": kind})
    with urllib.request.urlopen(request, timeout=SECONDS) as r:  # noqa: S310
        return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")


class Helpers:
    """The object ``jql``."""

    def test(self) -> str:
        return "test"

    def httpGet(self, url: str, params: Mapping | None = None) -> Attempt:  # noqa: N802
        return _attempt(lambda: _http(url + (("&" if "?" in url else "?") + _form(params) if params else "")))

    def httpPost(self, url: str, body: str | Mapping = "") -> Attempt:  # noqa: N802
        if isinstance(body, Mapping):
            return _attempt(lambda: _http(url, _form(body).encode(), "application/x-www-form-urlencoded; charset=utf-8"))
        return _attempt(lambda: _http(url, body.encode()))

    def sendMail(self, host: str, port: float, sender: str, to: str, subject: str, body: str) -> Attempt:  # noqa: N802
        def send() -> str:
            message = EmailMessage()
            message["From"], message["To"], message["Subject"] = sender, to, subject
            message.set_content(body)
            with smtplib.SMTP(host, int(port), timeout=SECONDS) as server:
                server.send_message(message)
            return "Mail sent"

        return _attempt(send)


JQL = Helpers()
