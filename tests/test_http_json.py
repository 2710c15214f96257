"""The HTTP source against a server on this machine."""

import collections
import datetime
import decimal
import http.server
import json
import threading
import time
import urllib.parse

import pytest

from mendwright.sources import http_json

ROWS = {
    "vehicles": [{"id": k, "plate": f"W {k}", "odometer": k * 1.5, "secret": "x" * 1000} for k in range(95)],
    "expenses": [{"id": k, "amount": f"{k}.25", "spent": "2024-05-01T10:00:00", "note": None if k % 2 else {"a": k}} for k in range(40)],
    "documents": [{"id": "7", "day": "2024-05-01", "tags": ["a", 1], "ok": True}, {"id": "x", "day": "soon", "ok": "maybe"}, {}],
    "none": [],
}


class Server(http.server.BaseHTTPRequestHandler):
    seen: collections.Counter = collections.Counter()
    threads: set = set()
    sent = 0

    def do_GET(self):  # noqa: N802
        url = urllib.parse.urlparse(self.path)
        kind, name = url.path.strip("/").split("/")
        query = dict(urllib.parse.parse_qsl(url.query))
        Server.seen[self.path] += 1
        if kind == "flaky" and Server.seen[self.path] < 3 or kind == "down":
            self.send_response(503)
            self.end_headers()
            return
        if kind == "locked" and self.headers.get("Authorization") != "Bearer key":
            self.send_response(401)
            self.end_headers()
            return
        fields = query["fields"].split(",")
        rows = [{k: r[k] for k in fields if k in r} for r in ROWS[name]]
        if "limit" in query and kind != "whole":
            rows = rows[int(query["offset"]) :][: int(query["limit"])]
        if rows and kind == "slow":
            time.sleep(0.3)
        body = json.dumps({"rows": rows} if kind == "wrapped" else rows).encode()
        self.send_response(200)
        if kind not in ("untold", "whole"):
            self.send_header("X-Total-Count", str(len(ROWS[name])))
        self.end_headers()
        self.wfile.write(body)
        Server.sent += len(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}"
    s.shutdown()


def test_three_tables(spark, server):
    schemas = {"vehicles": "id long, plate string, odometer double", "expenses": "id int, amount decimal(10,2), spent timestamp_ntz, note string", "documents": "id int, day date, tags array<string>, ok boolean"}
    Server.sent = 0
    found = http_json.read_all(spark, {n: (f"{server}/api/{n}", s) for n, s in schemas.items()}, page_rows=10, wait=0.01)
    assert found["vehicles"].rdd.getNumPartitions() == 10 and found["expenses"].rdd.getNumPartitions() == 4
    assert sorted(map(tuple, found["vehicles"].collect())) == [(k, f"W {k}", k * 1.5) for k in range(95)]
    assert Server.sent < 20_000  # the large column stays where it is
    assert sorted(map(tuple, found["expenses"].collect()))[:2] == [(0, decimal.Decimal("0.25"), datetime.datetime(2024, 5, 1, 10), '{"a": 0}'), (1, decimal.Decimal("1.25"), datetime.datetime(2024, 5, 1, 10), None)]
    assert sorted(map(tuple, found["documents"].collect()), key=repr) == [(7, datetime.date(2024, 5, 1), ["a", "1"], True), (None, None, None, None), (None, None, None, None)]
    joined = found["vehicles"].join(found["expenses"], "id").count()
    assert joined == 40


@pytest.mark.parametrize("kind,options", [("api", {}), ("untold", {}), ("whole", {"paged": "false"}), ("wrapped", {"rows": "rows"}), ("flaky", {"page_rows": 10}), ("locked", {"token": "key"})])
def test_servers(spark, server, kind, options):
    for name, n in (("vehicles", 95), ("none", 0)):
        rows = http_json.read_http(spark, f"{server}/{kind}/{name}", "id long", **({"page_rows": 30, "wait": 0.01} | options)).collect()
        assert sorted(r["id"] for r in rows) == list(range(n))


@pytest.mark.parametrize("kind", ["down", "locked"])
def test_a_failing_server_ends_the_query(spark, server, kind):
    with pytest.raises(Exception, match="503|401"):
        http_json.read_http(spark, f"{server}/{kind}/expenses", "id long", retries=1, wait=0.01).collect()
    assert Server.seen[f"/{kind}/expenses?fields=id&offset=0&limit=0"] == (2 if kind == "down" else 1)


def test_pages_are_read_side_by_side(spark, server):
    began = time.time()
    assert http_json.read_http(spark, f"{server}/slow/vehicles", "id long", page_rows=12).count() == 95
    assert time.time() - began < 60
    with pytest.raises(Exception, match="schema"):
        from mendwright.sources.http_json import HttpJsonSource

        spark.dataSource.register(HttpJsonSource)
        spark.read.format("http_json").option("url", server).load()
