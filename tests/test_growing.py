"""Sources by ranges: growing files, pages from a server on this machine, a database in memory."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from millrace.sources import growing as G
from millrace.sources.readers import json_items


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    G.register(spark)


@pytest.mark.parametrize("step", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("text", ["a\nbb\n\nccc\né日\n", "no end", "x\n" * 50 + "tail", "", "\n", "a\r\nb\x0cc\x85d\n"])
def test_ranges_give_every_line_once(tmp_path, text, step):
    path = tmp_path / "f"
    path.write_bytes(text.encode())
    size = len(text.encode())
    got = [x for r in G.ranges(str(path), 0, size, step) for x in G.lines_of(r)]
    want = text.split("\n")[: -1 if text.endswith("\n") or not text else None]
    assert [line for _, _, line in got] == want
    assert [at for _, at, _ in got] == [len("\n".join(want[:k]).encode()) + (k > 0) for k in range(len(want))]


def test_batch_reads_folders_and_unfinished_lines(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.log").write_text("1\n2\n3")
    (tmp_path / "sub" / "b.log").write_text("4\n")
    for path in (str(tmp_path), f"file://{tmp_path}"):
        rows = spark.read.format("growing_lines").option("path", path).option("step", 2).load()
        assert sorted(r.line for r in rows.collect()) == ["1", "2", "3", "4"] and rows.rdd.getNumPartitions() > 2


def test_a_growing_file_is_handed_on_once_and_a_restart_loses_nothing(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    log = folder / "a.log"

    def run():
        lines = spark.readStream.format("growing_lines").option("path", str(folder)).option("step", 5).load()
        query = lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted((r.path[-5:], r.start, r.line) for r in spark.read.schema("path string, start bigint, line string").parquet(out).collect())

    log.write_text("one\ntwo\nunfin")
    assert run() == [("a.log", 0, "one"), ("a.log", 4, "two")]
    with log.open("a") as f:
        f.write("ished\nthree\n")
    (folder / "b.log").write_text("other\n")
    assert run() == [("a.log", 0, "one"), ("a.log", 4, "two"), ("a.log", 8, "unfinished"), ("a.log", 19, "three"), ("b.log", 0, "other")]
    assert len(run()) == 5
    log.write_text("new\n")
    assert ("a.log", 0, "new") in run() and len(run()) == 6


def test_offsets_read_back_no_further_than_known(tmp_path):
    path = tmp_path / "f"
    path.write_bytes(b"a\n" + b"x" * (3 * G.BLOCK))
    size = path.stat().st_size
    assert G.whole_lines(str(path), size, 0) == 2 and G.whole_lines(str(path), size, 2) == 2
    path.write_bytes(b"x" * G.BLOCK + b"\n" + b"y" * G.BLOCK)
    assert G.whole_lines(str(path), path.stat().st_size, 0) == G.BLOCK + 1
    reader = G._AppendedLines({"path": str(path)})
    assert reader.partitions({str(path): 900}, {str(path): 5}) == [G.Range(str(path), 0, 5, True)]


class Server(BaseHTTPRequestHandler):
    rows = [{"timestamp": 100 + i, "hotkey": f"k{i}"} for i in range(95)]
    asked: list[tuple] = []
    failing = {"left": 0}

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        Server.asked.append((q["timestamp_start"], q["page"], self.headers.get("Authorization"), q["netuid"]))
        if Server.failing["left"] > 0:
            Server.failing["left"] -= 1
            self.send_error(503)
            return
        if self.headers.get("Authorization") != "key":
            self.send_error(403)
            return
        mine = [r for r in self.rows if int(q["timestamp_start"]) <= r["timestamp"] <= int(q["timestamp_end"])]
        page, limit = int(q["page"]), int(q["limit"])
        part = mine[(page - 1) * limit : page * limit]
        body = json.dumps({"data": part, "pagination": {"next_page": page + 1 if page * limit < len(mine) else None}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        return


@pytest.fixture
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    Server.asked.clear()
    yield f"http://127.0.0.1:{s.server_port}/rows"
    s.shutdown()


def test_pages_are_followed_in_each_span(spark, server):
    source = spark.read.format("paged_bodies").options(**{"url": server, "start": "90", "end": "199", "spans": "4", "limit": "10", "wait": "0.01", "header.Authorization": "key", "param.netuid": "97"})
    bodies = source.load()
    assert bodies.rdd.getNumPartitions() == 4
    Server.asked.clear()
    Server.failing["left"] = 2
    items = bodies.select("span", "page", F.explode(json_items(F.col("body"), "struct<timestamp: bigint, hotkey: string>")).alias("r")).select("r.*")
    assert sorted(tuple(r) for r in items.collect()) == [(r["timestamp"], r["hotkey"]) for r in Server.rows]
    assert len(Server.asked) == 2 + 2 + 3 + 3 + 3 and {a[2:] for a in Server.asked} == {("key", "97")}
    with pytest.raises(Exception, match="403"):
        source.option("header.Authorization", "other").load().collect()


def test_rows_of_a_database(spark):
    url, options = "jdbc:derby:memory:rows;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    rows.write.format("jdbc").options(url=url, dbtable="t", **options).mode("overwrite").save()
    got = G.database_rows(spark, url, "t", "k", parts=5, **options)
    assert got.rdd.getNumPartitions() == 5 and got.selectExpr("count(*)", "sum(v)").first() == (1000, 999000)
    rows.limit(0).write.format("jdbc").options(url=url, dbtable="nothing", **options).mode("overwrite").save()
    assert G.database_rows(spark, url, "nothing", "k", **options).collect() == []
