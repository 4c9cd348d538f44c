"""The HTTP front and the gateway's protocol."""

import json
import threading
import time
import urllib.error
import urllib.request

import pytest

from rillflow.engine import Engine
from rillflow.functions.helpers import JQL
from rillflow.functions.scripts import Script
from rillflow.server import Gateway, Processor, Registration, listen, serve_engine


def post(server, path, body):
    data = body if isinstance(body, str) else json.dumps(body)
    request = urllib.request.Request(f"http://127.0.0.1:{server.server_address[1]}{path}", data.encode())
    try:
        with urllib.request.urlopen(request) as r:
            return r.status, json.load(r)
    except urllib.error.HTTPError as e:
        return e.code, json.load(e)


def test_session_and_gateway(spark):
    processor = serve_engine(Engine(spark))
    keys = []
    gateway = Gateway(keys.append, port=0)
    try:
        assert post(processor, "/query", {"query": "STATUS"})[0] == 200
        assert post(processor, "/query", "{")[0] == 400 and post(processor, "/nix", {})[0] == 404
        code, said = post(gateway.server, "/login", "")
        asked = {"session_id": said["session_id"], "query": "STATUS"}
        assert code == 200 and len(said["session_id"]) == 20
        assert post(gateway.server, "/query", "{")[0] == 400 and post(gateway.server, "/query", {})[0] == 400
        assert post(gateway.server, "/query", {"session_id": "nix", "query": "STATUS"})[0] == 401
        assert post(gateway.server, "/query", asked)[0] == 503
        assert post(gateway.server, "/registration/nix", {"action": "register", "ip": "127.0.0.1", "port": 1})[0] == 401
        assert post(gateway.server, f"/registration/{keys[0]}", {"action": "register", "ip": "127.0.0.1", "port": 1})[0] == 200
        assert post(gateway.server, "/query", asked)[0] == 502
        post(gateway.server, f"/registration/{keys[0]}", {"action": "register", "ip": "127.0.0.1", "port": processor.server_address[1]})
        assert post(gateway.server, "/query", asked)[1]["result"] == "STATUS"
        assert post(gateway.server, "/query", {**asked, "query": "nonsense"})[0] == 400
        assert post(gateway.server, f"/registration/{keys[0]}", {"action": "unregister"})[0] == 200
        assert post(gateway.server, "/query", asked)[0] == 401
    finally:
        processor.shutdown()
        gateway.server.shutdown()


def test_processor_registers_with_a_gateway(spark):
    keys = []
    gateway = Gateway(keys.append, port=0)
    place = f"http://127.0.0.1:{gateway.server.server_address[1]}/registration/"
    try:
        session = post(gateway.server, "/login", "")[1]["session_id"]
        processor = Processor(Engine(spark), registration=Registration(place + keys[0]))
        asked = {"session_id": session, "query": "STATUS"}
        assert post(gateway.server, "/query", asked)[1]["result"] == "STATUS"
        assert processor.close() is None
        assert post(gateway.server, "/query", asked)[0] == 401
        assert "401" in Registration(place + "nix").unregister()
        for bad in (place + "nix", "no address", "http://127.0.0.1:1/registration/x"):
            with pytest.raises(ConnectionError):
                Processor(Engine(spark), registration=Registration(bad))
    finally:
        gateway.server.shutdown()


def test_status_while_a_stream_ends(spark):
    engine = Engine(spark)
    server = serve_engine(engine)
    status = lambda: urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}/status").read()
    go = threading.Event()

    class Running:
        def stop(self):
            go.wait(30)

    try:
        assert status() == b"running"
        engine.current, engine.running, engine.live_began = type("Source", (), {"state": "Running"})(), Running(), time.time()
        stopping = threading.Thread(target=engine.execute, args=("STOP PROCESSING",))
        stopping.start()
        until = time.time() + 10
        while status() != b"stop-and-poll" and time.time() < until:
            time.sleep(0.01)
        assert status() == b"stop-and-poll"
        go.set()
        stopping.join(30)
        assert status() == b"running"
        engine.execute("SHUTDOWN")
        assert status() == b"shutdown"
    finally:
        go.set()
        server.shutdown()


def test_helpers_of_python_functions():
    seen = []

    def answer(method, path, body):
        seen.append((method, path, body))
        if path == "/no":
            raise RuntimeError("no")
        return "yes"

    server = listen(answer)
    at = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        assert JQL.test() == "test"
        assert JQL.httpGet(at + "/a", {"x": 1.0, "y": "ü&"}).get == "yes"
        assert JQL.httpPost(at + "/b", "text").isSuccess and JQL.httpPost(at + "/c", {"k": 2.5}).isSuccess and JQL.httpPost(at + "/d").isSuccess
        assert seen == [("GET", "/a?x=1&y=%C3%BC%26", ""), ("POST", "/b", "text"), ("POST", "/c", "k=2.5"), ("POST", "/d", "")]
        for failed in (JQL.httpGet(at + "/no"), JQL.httpGet("file:///etc/hostname"), JQL.httpGet("nix"), JQL.sendMail("127.0.0.1", 1, "a@x", "b@x", "s", "b")):
            assert not failed.isSuccess and failed.get is None and failed.error
        body = "r = jql.httpGet(url)\nreturn r.get if r.isSuccess else 'failed'"
        assert Script("f", ("url",), body, "python").run([[at + "/a"], [at + "/no"]]) == [{"value": "yes"}, {"value": "failed"}]
    finally:
        server.shutdown()
