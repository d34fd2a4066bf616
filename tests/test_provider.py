"""Generated docstrings from a service that fails, stalls and talks nonsense at times."""

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from graphloom.functions import provider
from graphloom.operators import sync as Y


@pytest.fixture()
def service():
    asked, now, most, lock = Counter(), [0], [0], threading.Lock()

    class Stub(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            name = body["prompt"].split("function ")[1].split(" ")[0]
            with lock:
                asked[name] += 1
                nth, now[0] = asked[name], now[0] + 1
                most[0] = max(most[0], now[0])
            time.sleep(0.05)
            try:
                if name.startswith("stalls") and nth == 1:
                    time.sleep(2)
                if name == "gone":
                    return self.send_error(404)
                if name == "fails" or name == "recovers" and nth < 3:
                    return self.send_error(503)
                said = f"The function {name} does one thing well for {body['model']}.\nMore words."
                answer = b"no json" if name == "nonsense" else json.dumps({"response": "" if name == "silent" else "Too short." if name == "terse" else said}).encode()
                self.send_response(200)
                self.end_headers()
                self.wfile.write(answer)
            except OSError:
                pass
            finally:
                with lock:
                    now[0] -= 1

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/api/generate", asked, most
    server.shutdown()


def test_docstrings_of_a_service(spark, service):
    url, asked, most = service
    names = ["good", "stalls", "gone", "fails", "recovers", "nonsense", "silent", "terse", *(f"more{k}" for k in range(20))]
    rows = [(f"n{k}", n, f"def {n}(): ...", None, f"h-{n}") for k, n in enumerate(names)]
    rows += [(f"copy{k}", "good", "def good(): ...", None, "h-good") for k in range(50)] + [("own", "own", "def own(): ...", "Own words.", "h-own"), ("bare", "bare", None, None, "h-bare")]
    functions = spark.createDataFrame(rows, "node_id string, name string, chunk string, docstring string, body_hash string").repartition(4)
    cache = spark.createDataFrame([], "body_hash string, doc string")
    known, grown = Y.with_generated_docs(functions, cache, provider.http_provider(url, "m1", timeout_s=0.7, pause_s=0.05, under_way=3))
    for _ in range(2):  # reading again asks nothing
        docs = {r.node_id: (r.docstring, r.docstring_source) for r in known.collect()}
    told = {n: docs[f"n{k}"] for k, n in enumerate(names)}
    assert {n for n, (_, source) in told.items() if source == "none"} == {"gone", "fails", "nonsense", "silent", "terse"}
    assert all(d == (f"The function {n} does one thing well for m1.", "auto") for n, d in told.items() if d[1] == "auto")
    assert docs["own"] == ("Own words.", "native") and docs["bare"] == ("", "none") and all(docs[f"copy{k}"] == told["good"] for k in range(50))
    assert asked["good"] == 1 and asked["stalls"] == 2 and asked["gone"] == 1 and asked["fails"] == asked["recovers"] == asked["nonsense"] == 3 and not asked["own"] and not asked["bare"]
    assert 1 < most[0] <= 3 * 4
    # What failed is asked for at the next sync, what was said is not.
    before = asked["good"]
    Y.with_generated_docs(functions, grown, provider.http_provider(url, "m1", timeout_s=0.7, tries=1))[0].collect()
    assert asked["good"] == before and asked["fails"] == 4
