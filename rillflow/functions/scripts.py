"""User functions written as text: JavaScript in a node child process, or Python.

One child serves a Python worker for as long as it lives; a whole Arrow batch goes
to it at a time. ``jql`` is the helper object that bodies may use.
"""

from __future__ import annotations

import json
import shutil
import subprocess
import textwrap
from dataclasses import dataclass

from .helpers import JQL

NODE = shutil.which("node")

_SERVER = r"""
const run = (s) => require('child_process').execFileSync(process.execPath, ['-e', s], {encoding: 'utf8'});
const call = (url, options) => run(`fetch(${JSON.stringify(url)}, ${JSON.stringify(options)}).then(r => r.text()).then(t => process.stdout.write(t))`);
const query = (p) => p ? '?' + new URLSearchParams(p).toString() : '';
const attempt = (f) => { try { return {isSuccess: true, get: f()}; } catch (e) { return {isSuccess: false, error: String(e)}; } };
const jql = {
  test: () => 'test',
  httpGet: (url, params) => attempt(() => call(url + query(params), {})),
  httpPost: (url, body) => attempt(() => call(url, {method: 'POST', body: typeof body === 'object' ? new URLSearchParams(body).toString() : body})),
  sendMail: (server, port, from, to, subject, content) => attempt(() => run(
    `const s=require('net').connect(${JSON.stringify(port)},${JSON.stringify(server)});const q=${JSON.stringify(['HELO localhost', 'MAIL FROM:<' + from + '>', 'RCPT TO:<' + to + '>', 'DATA', 'Subject: ' + subject + '\r\nFrom: ' + from + '\r\nTo: ' + to + '\r\n\r\n' + content + '\r\n.', 'QUIT'])};s.on('data',()=>q.length?s.write(q.shift()+'\r\n'):s.end());`)),
};
const made = new Map();
const make = (names, body) => {
  const key = JSON.stringify([names, body]);
  if (!made.has(key)) made.set(key, new Function('jql', ...names, body));
  return made.get(key);
};
require('readline').createInterface({input: process.stdin}).on('line', (line) => {
  const {names, body, rows} = JSON.parse(line);
  let out;
  try {
    const f = make(names, body);
    out = rows.map((r) => { try { return {value: f(jql, ...r) ?? null}; } catch (e) { return {error: String(e)}; } });
  } catch (e) { out = {error: String(e)}; }
  console.log(JSON.stringify(out));
});
"""

_child: subprocess.Popen | None = None


class BadScript(ValueError):
    pass


def _node(names: list[str], body: str, rows: list[list]) -> list[dict]:
    global _child
    if NODE is None:
        raise BadScript("there is no JavaScript engine: node is not installed")
    if _child is None or _child.poll() is not None:
        _child = subprocess.Popen([NODE, "-e", _SERVER], stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, encoding="utf-8")
    _child.stdin.write(json.dumps({"names": names, "body": body, "rows": rows}) + "\n")
    _child.stdin.flush()
    out = json.loads(_child.stdout.readline())
    if isinstance(out, dict):
        raise BadScript(out["error"])
    return out


@dataclass(frozen=True)
class Script:
    """A function body with named arguments."""

    name: str
    names: tuple[str, ...]
    body: str
    language: str = "javascript"

    def check(self) -> None:
        """Raise ``BadScript`` if the body has a syntax error."""
        self.run([])

    def run(self, rows: list[list]) -> list[dict]:
        """``{"value": ...}`` or ``{"error": ...}`` for each row of arguments."""
        if self.language == "javascript":
            return _node(list(self.names), self.body, rows)
        space: dict = {"jql": JQL}
        code = f"def {self.name}({', '.join(self.names)}):\n" + textwrap.indent(textwrap.dedent(self.body).strip("\n") or "pass", "    ")
        try:
            exec(compile(code, self.name, "exec"), space)  # noqa: S102
        except SyntaxError as e:
            raise BadScript(str(e)) from e
        out = []
        for row in rows:
            try:
                out.append({"value": space[self.name](*row)})
            except Exception as e:  # noqa: BLE001
                out.append({"error": str(e)})
        return out


DEFAULTS = {"numeric": 0.0, "string": "", "boolean": False}


def coerce(kind: str, result: dict):
    """The value in the declared type; any error or other type gives the type's default."""
    value = result.get("value")
    try:
        if "error" in result or value is None:
            return DEFAULTS[kind]
        if kind == "numeric":
            return float(value)
        if kind == "boolean":
            return value if isinstance(value, bool) else DEFAULTS[kind]
        if isinstance(value, float) and value.is_integer():
            value = int(value)
        return value if isinstance(value, str) else json.dumps(value)
    except (TypeError, ValueError):
        return DEFAULTS[kind]
