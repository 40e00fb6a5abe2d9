import json
import math
import random
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.operators import vectors
from lodestar.operators.embedcache import Batches, Child, EmbeddingCache, LocalHash, Ollama, OpenAI


def rows(df):
    return {r.id: None if r.embedding is None else [round(x, 6) for x in r.embedding] for r in df.collect()}


@pytest.fixture
def service():
    """Vectors (length of the text, 3, 4); texts that were answered are kept, and after ``most`` of them it fails."""
    told = {"seen": [], "most": 10**9, "asked": []}
    lock = threading.Lock()

    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            with lock:
                told["asked"].append((self.path, body["model"], self.headers.get("Authorization")))
                fails = len(told["seen"]) >= told["most"]
                if not fails:
                    told["seen"] += body["input"]
            found = [[float(len(t)), 3.0, 4.0] for t in body["input"]]
            if self.path == "/api/embed":
                answer = {"embeddings": found}
            else:
                answer = {"data": [{"index": k, "embedding": v} for k, v in reversed(list(enumerate(found)))]}
            text = json.dumps(answer).encode()
            self.send_response(503 if fails else 200)
            self.send_header("Content-Length", str(len(text)))
            self.end_headers()
            self.wfile.write(text)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", told
    server.shutdown()


def vector(n):
    length = math.sqrt(n * n + 25)
    return [round(x / length, 6) for x in (n, 3, 4)]


def test_local_hash_is_made_once_a_text(spark, tmp_path):
    cache, provider = EmbeddingCache(spark, f"{tmp_path}/cache"), LocalHash(32)
    docs = spark.createDataFrame([("1", "wing body", 7), ("2", "wing body", 8), ("3", None, 9), ("4", "", 9), (None, "flow", 9)], "id string, text string, key int")
    assert cache.fill(docs.where("id = '1'"), provider) == 1
    assert cache.fill(docs, provider) == 2 and cache.fill(docs, provider) == 0
    assert cache.fill(docs.limit(0), provider) == 0
    direct = rows(vectors.hash_embeddings(docs.select("id", "text"), "text", 32).where("id is not null"))
    got = rows(cache.lookup(docs, provider))
    assert {k: v for k, v in got.items() if k} == direct and got[None] is not None and len(got) == 5
    assert rows(cache.lookup(docs, LocalHash(8))) == dict.fromkeys(got)  # another space
    cache.drop()
    assert rows(cache.lookup(docs, provider)) == dict.fromkeys(got)


def test_both_ways_of_hashing_agree(spark):
    rng = random.Random(5)
    texts = [None, "", "a", "wing", "a b c", "x" * 5000 + " " + "y1 " * 40, "É été Kelvin \u212a 42"] + [" ".join("".join(rng.choices("ab1É", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    docs = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "id string, text string")
    for n in (7, 384):
        plain = rows(vectors.hash_embeddings(docs, "text", n))
        column = pa.array(texts, pa.string())
        for at, part in ((0, column), (50, column.slice(50, 100)), (0, column.slice(0, 0)), (1, column.slice(1, 1))):
            got = vectors.hash_matrix(part, n)
            assert got.shape == (len(part), n)
            assert {str(at + k): [round(x, 6) for x in v] for k, v in enumerate(got.tolist())} == {str(k): plain[str(k)] for k in range(at, at + len(part))}


def test_a_run_that_is_broken_off_makes_nothing_again(spark, tmp_path, service):
    host, told = service
    cache, provider = EmbeddingCache(spark, f"{tmp_path}/cache"), Ollama("m", host + "/").provider(4)
    texts = ["x" * k for k in range(1, 201)]
    docs = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "id string, text string")
    told["most"] = 90
    with pytest.raises(Exception, match="503"):
        cache.fill(docs, provider, write_rows=20)
    written = {r.key for r in cache.held(provider).collect()}
    assert 0 < len(written) < 120 and cache.held(provider).count() == len(written)
    kept = {r.text for r in docs.withColumn("key", F.sha2("text", 256)).collect() if r.key in written}
    told["most"], told["seen"] = 10**9, []
    assert cache.fill(docs, provider, write_rows=20) == 200 - len(written)
    assert sorted(told["seen"]) == sorted(set(texts) - kept)
    assert rows(cache.lookup(docs, provider)) == {str(k): vector(len(t)) for k, t in enumerate(texts)}
    assert {a[:2] for a in told["asked"]} == {("/api/embed", "m")}


def test_services_programs_and_bad_answers(spark, tmp_path, service):
    host, told = service
    docs = spark.createDataFrame([(str(k), "y" * k) for k in range(9)], "id string, text string")
    expected = {str(k): vector(k) for k in range(9)}
    cache = EmbeddingCache(spark, f"{tmp_path}/cache")
    remote = OpenAI("m", "word", host)
    assert rows(cache.embedded(docs, remote.provider(2))) == expected
    assert {a[2] for a in told["asked"]} == {"Bearer word"} and "word" not in repr(remote)
    code = "import json,sys; r = json.load(sys.stdin)['rows']; json.dump({'embeddings': [{'id': x['id'], 'embedding': [len(x['text']), 3, 4]} for x in r[::-1]]}, sys.stdout)"
    assert rows(cache.embedded(docs, Child("m", (sys.executable, "-c", code)).provider(4))) == expected
    for embed, said in ((lambda t: [], "vectors for"), (lambda t: [[]] * len(t), "empty"), (lambda t: [[float("nan")]] * len(t), "no numbers")):
        with pytest.raises(Exception, match=said):
            cache.fill(docs, Batches("bad", said, embed))
    with pytest.raises(Exception, match="status 3"):
        cache.fill(docs, Child("n", (sys.executable, "-c", "raise SystemExit(3)")).provider())
    assert rows(cache.embedded(docs.limit(1), Batches("zero", "z", lambda t: [[0.0, 0.0]] * len(t)))) == {"0": [0.0, 0.0]}
