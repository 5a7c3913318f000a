"""Calls to a server that counts how it is called."""

import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.request import urlopen

import pytest

from lodestone.operators.services import Caller, Manners, answers_at, asked, host_of, passing


class Counting(ThreadingHTTPServer):
    daemon_threads = True

    def __init__(self):
        super().__init__(("127.0.0.1", 0), Handler)
        self.lock, self.now, self.most, self.seen, self.times = threading.Lock(), 0, 0, {}, []

    @property
    def url(self):
        return f"http://127.0.0.1:{self.server_port}"


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        s = self.server
        with s.lock:
            s.now, s.seen[self.path] = s.now + 1, s.seen.get(self.path, 0) + 1
            s.most = max(s.most, s.now)
            s.times.append(time.monotonic())
            nth = s.seen[self.path]
        time.sleep(0.05)
        code = 404 if "gone" in self.path else 503 if ("busy" in self.path and nth < 3) or "broken" in self.path else 200
        with s.lock:
            s.now -= 1
        self.send_response(code)
        self.end_headers()
        self.wfile.write(self.path.encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    s = Counting()
    thread = threading.Thread(target=s.serve_forever, daemon=True)
    thread.start()
    yield s
    s.shutdown()


def get(url):
    with urlopen(url, timeout=10) as answer:
        return answer.read().decode()


QUICK = Manners(in_flight=5, wait=0.01)


def requests(spark, server, paths):
    return spark.createDataFrame([(f"{server.url}/{p}" if p is not None else None,) for p in paths], "request string").coalesce(1)


def test_requests_in_flight_are_bounded_and_many(spark, server, tmp_path):
    out = asked(requests(spark, server, [*range(40), *range(10), None]), get, str(tmp_path / "k"), manners=QUICK).collect()
    assert len(out) == 40 and all(r.answer == r.request.removeprefix(server.url) and r.error is None for r in out)
    assert set(server.seen.values()) == {1}  # repeats are asked once
    assert 1 < server.most <= 5 * 4  # a task has five in flight, and the session four threads


def test_one_task_has_so_many_in_flight(server):
    found = Caller(Manners(in_flight=6, per_host=3)).all(get, [f"{server.url}/{k}" for k in range(20)], host_of)
    assert [a for a, _ in found] == [f"/{k}" for k in range(20)] and server.most == 3


def test_retries_and_errors(spark, server, tmp_path):
    out = {r.request.rpartition("/")[2]: r for r in asked(requests(spark, server, ["busy", "gone", "broken", "fine"]), get, str(tmp_path / "k"), manners=QUICK).collect()}
    assert out["busy"].answer == "/busy" and server.seen["/busy"] == 3
    assert out["gone"].answer is None and "404" in out["gone"].error and server.seen["/gone"] == 1
    assert "503" in out["broken"].error and server.seen["/broken"] == QUICK.tries


def test_answers_that_are_kept_are_not_asked_again(spark, server, tmp_path):
    keep = str(tmp_path / "k")
    asked(requests(spark, server, ["a", "b", "gone"]), get, keep, manners=QUICK)
    out = asked(requests(spark, server, ["a", "b", "c", "gone"]), get, keep, manners=QUICK, blocks=3)
    assert {r.request.rpartition("/")[2]: r.answer for r in out.collect()} == {"a": "/a", "b": "/b", "c": "/c", "gone": None}
    assert server.seen == {"/a": 1, "/b": 1, "/c": 1, "/gone": 2}
    assert answers_at(out, keep).count() == 4


def test_courtesy_to_a_host(spark, server, tmp_path):
    asked(requests(spark, server, range(8)), get, str(tmp_path / "k"), manners=Manners(in_flight=8, per_host=2, pause=0.1), host=host_of)
    times = sorted(server.times)
    assert server.most <= 2 and min(b - a for a, b in zip(times, times[1:])) > 0.05


def test_what_is_tried_again():
    assert passing(ConnectionRefusedError()) and passing(TimeoutError()) and not passing(ValueError())
