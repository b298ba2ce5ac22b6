import json
import math
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from variantlake.functions import numbers
from variantlake.operators import batches
from variantlake.sources import fetch


class Server(BaseHTTPRequestHandler):
    failures: dict = {}
    asked: list = []

    def _fails(self, key):
        left = Server.failures.setdefault(key, 2)
        Server.failures[key] = left - 1
        if left > 0:
            self.send_error(503)
        return left > 0

    def do_GET(self):
        page = int(self.path.rsplit("=", 1)[1])
        if page == 99:
            return self.send_error(404)
        if not self._fails(page):
            self._answer({"records": [{"id": 10 * page + i, "name": f"n{page}"} for i in range(page)]})

    def do_POST(self):
        ids = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if not self._fails(tuple(ids)):
            Server.asked.append(len(ids))
            self._answer({i: {"v": int(i)} for i in ids if int(i) % 3})

    def _answer(self, what):
        data = json.dumps(what).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *args):
        pass


@pytest.fixture
def url():
    Server.failures, Server.asked = {}, []
    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_pages_are_partitions_and_failures_are_retried(spark, url):
    spark.dataSource.register(fetch.PagedJson)
    df = spark.read.format("paged_json").options(url=url + "/?page={page}", pages=4, field="records", wait=0.01).load()
    assert df.rdd.getNumPartitions() == 4
    got = [(r.page, r.place, r.x["id"], r.x["name"]) for r in df.withColumn("x", F.from_json("record", "id int, name string")).collect()]
    assert sorted(got) == [(p, i, 10 * p + i, f"n{p}") for p in range(4) for i in range(p)]
    with pytest.raises(Exception, match="404"):
        fetch.fetch(url + "/?page=99", wait=0.01)
    Server.failures = {5: 9}
    with pytest.raises(Exception, match="503"):
        fetch.fetch(url + "/?page=5", tries=3, wait=0.01)
    assert Server.failures[5] == 6


def test_ids_are_asked_for_in_chunks(spark, url):
    df = spark.createDataFrame([(str(i % 25),) for i in range(60)] + [(None,)], "id string")
    got = fetch.fetch_by_ids(df, "id", url, chunk=7, wait=0.01, chunks_at_once=1).collect()
    assert {r.id: r.record for r in got} == {str(i): json.dumps({"v": i}) if i % 3 else None for i in range(25)}
    assert sorted(Server.asked, reverse=True) == [7, 7, 7, 4]


def test_scoring_goes_on_after_a_failure(spark, tmp_path):
    root, log = str(tmp_path / "scores"), tmp_path / "log"
    df = spark.createDataFrame([(i % 90, f"k{i % 90}") for i in range(100)], "id int, name string")

    def scorer(fail_at):
        calls = iter(range(1000))

        def score(rows):
            if next(calls) == fail_at:
                raise RuntimeError("the service is gone")

            def write(parts):
                for p in parts:
                    with log.open("a") as f:
                        f.writelines(f"{i}\n" for i in p["id"])
                    yield p.assign(score=p["id"] * 2.0)[["id", "score"]]

            return rows.mapInPandas(write, "id int, score double")

        return score

    with pytest.raises(RuntimeError):
        batches.score_in_batches(df, root, ["id"], scorer(3), 10)
    before = batches.scores(spark, root).count()
    assert 0 < before < 90
    for _ in range(2):  # the second call finds nothing to do
        got = batches.score_in_batches(df, root, ["id"], scorer(None), 10)
        assert sorted((r.id, r.score) for r in got.collect()) == [(i, 2.0 * i) for i in range(90)]
    asked = log.read_text().split()
    assert len(asked) == len(set(asked)) == 90
    assert batches.score_in_batches(df.limit(0), str(tmp_path / "none"), ["id"], scorer(None), 10).collect() == []


def test_window_scores_equal_plain_products(spark):
    rng = np.random.default_rng(3)
    # As for acceptors: a consensus in the middle, five windows over the rest, four overlaps taken out.
    rest = [i for i in range(23) if i not in (18, 19)]
    spans = [(0, 7, 1), (7, 14, 1), (14, 21, 1), (4, 11, 1), (11, 18, 1), (4, 7, -1), (7, 11, -1), (11, 14, -1), (14, 18, -1)]
    factors = [(tuple(rest[a:b]), rng.uniform(0.01, 2, 4 ** (b - a)), power) for a, b, power in spans]
    fixed = {18: dict(zip("ACGT", (0.9, 0.01, 0.02, 0.03))), 19: dict(zip("ACGT", (0.02, 0.01, 0.95, 0.01)))}
    r = random.Random(4)
    seqs = ["".join(r.choice("ACGT") for _ in range(23)) for _ in range(60)] + ["acgt" * 5 + "acg", "ACG", None, "N" * 23, "", "é" * 23]
    got = spark.createDataFrame(list(enumerate(seqs)), "i int, s string").select("i", numbers.score_udf(numbers.WindowScorer(23, factors, fixed))("s").alias("x")).collect()

    def plain(s):
        if s is None or len(s) != 23 or set(s.upper()) - set("ACGT"):
            return None
        s = s.upper()
        product = fixed[18][s[18]] * fixed[19][s[19]]
        left = s[:18] + s[20:]
        for (a, b, power), (_, table, _) in zip(spans, factors):
            number = 0
            for c in left[a:b]:
                number = number * 4 + "ACGT".index(c)
            product *= table[number] ** power
        return math.log2(product)

    for x in got:
        want = plain(seqs[x.i])
        assert x.x is None if want is None else abs(x.x - want) <= 0.005 + 1e-9
    with pytest.raises(ValueError):
        numbers.WindowScorer(3, [((0, 1), np.ones(15), 1)])
