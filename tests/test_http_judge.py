import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from lexifold.operators.judge import HttpJudge, judged

ITEMS = [{"start": 4, "text": "kivy", "options": [{"preferred": "Kivi", "kind": "product", "note": ""}], "hint": ""}]
REQUESTS = "user_id string, doc_id long, version long, sentence string, items array<struct<start:int,text:string,options:array<struct<preferred:string,kind:string,note:string>>,hint:string>>"


@pytest.fixture
def endpoint(monkeypatch):
    """A local chat endpoint; gives its address, what it was asked, and the statuses it answers with first."""
    asked, statuses = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.headers["Authorization"], body))
            status = statuses.pop(0) if statuses else 200
            said = json.dumps({"decisions": [{"index": 0, "apply": True, "preferred": "Kivi", "reason": "the product"}]})
            out = json.dumps({"choices": [{"message": {"content": f"```json\n{said}\n```"}}], "usage": {"prompt_tokens": 12, "completion_tokens": 5}}).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("JUDGE_API_KEY", " secret ")
    yield f"http://127.0.0.1:{server.server_port}/chat", asked, statuses
    server.shutdown()
    server.server_close()


def test_answer_over_http(endpoint):
    url, asked, statuses = endpoint
    statuses.append(429)  # asked again
    answer = HttpJudge(url, "m", backoff=0.0).judge("the kivy runs", ITEMS)
    assert answer.decisions[0] == {"apply": True, "preferred": "Kivi", "reason": "the product"} | ({"index": 0} if "index" in answer.decisions[0] else {})
    assert (answer.model, answer.input_tokens, answer.output_tokens) == ("m", 12, 5) and len(asked) == 2
    key, body = asked[1]
    assert key == "Bearer secret" and body["model"] == "m" and json.loads(body["messages"][1]["content"])["text"] == "the kivy runs"


def test_refusal_is_told(endpoint, spark):
    url, asked, statuses = endpoint
    statuses += [400, 200]  # not asked again: the second document gets the next answer
    requests = spark.createDataFrame([("u", i, 0, f"the kivy runs {i}", ITEMS) for i in (1, 2)], REQUESTS).coalesce(1)
    got = {r.doc_id: r for r in judged(requests, HttpJudge(url, "m", backoff=0.0)).collect()}
    assert len(asked) == 2 and got[1].apply is None and "400" in got[1].reason
    assert (got[2].start, got[2].apply, got[2].preferred, got[2].reason) == (4, True, "Kivi", "the product")


def test_without_a_key(monkeypatch):
    for name in ("JUDGE_API_KEY", "LLM_API_KEY"):
        monkeypatch.delenv(name, raising=False)
    assert not HttpJudge("http://127.0.0.1:9", "m").available
