"""Projections, sinks, the client, pipelines, streams, configuration and the command line."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from inferframe import cli, client, config, registry
from inferframe.adapters import OpenAIAdapter, SimpleAdapter
from inferframe.functions import messages as m
from inferframe.operators import normalize, project, resume
from inferframe.operators.routing import Policy
from inferframe.plans.pipeline import Pipeline, compacted
from inferframe.sinks import files as sinks
from inferframe.sources import files, mock
from inferframe.streaming.runner import Stream, run_stream

OUT = {"choices": [{"index": 0, "message": {"role": "assistant", "content": "hello"}, "finish_reason": "stop"}], "usage": {"total_tokens": 5}}
TWO = {"choices": [*OUT["choices"], {"message": {"content": "bonjour"}, "finish_reason": "length"}, "odd", {"message": "odd"}], "usage": {"prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 12}}
SHAPE = "request_id string, model_output string, error string, additional_data string, source_file string, source_dir string, line_num long, item_idx int"


def results(spark, *rows):
    return spark.createDataFrame([(i, o if o is None or isinstance(o, str) else json.dumps(o), e, a, f, d, n, 0) for i, o, e, a, f, d, n in rows], SHAPE)


@pytest.fixture
def two(spark):
    return results(spark, ("req-1", OUT, None, '{"k":1}', "a/b.jsonl", "a", 1), ("req-2", TWO, None, None, "c.jsonl", "", 8))


def text(path):
    return [json.loads(x) for p in sorted(path.rglob("*.txt")) for x in p.read_text().splitlines()]


def test_minimal_projection(two):
    a, b = sorted(project.minimal(two).collect(), key=lambda r: r["request_id"])
    assert (a["content"], a["contents"], a["finish_reason"], a["finish_reasons"], a["usage"]["total_tokens"], a["additional_data"]) == ("hello", ["hello"], "stop", ["stop"], 5, '{"k":1}')
    assert b["contents"] == ["hello", "bonjour", None] and b["finish_reasons"] == ["stop", "length", None] and b["usage"]["prompt_tokens"] == 1


def test_projections_of_odd_responses(spark):
    r = {x["request_id"]: x for x in project.minimal(results(spark, ("a", "{}", None, None, None, None, None), ("b", None, "boom", None, None, None, None), ("c", "not json", None, None, None, None, None), ("d", {"choices": []}, None, None, None, None, None))).collect()}
    assert all(r[k]["content"] is None for k in "abcd") and r["d"]["contents"] == [] and r["b"]["error"] == "boom"


def test_jsonl_sink(two, tmp_path):
    sinks.write_jsonl(two, str(tmp_path / "o"), projection="minimal")
    a, b = sorted(text(tmp_path / "o"), key=lambda r: r["request_id"])
    assert a == {"request_id": "req-1", "content": "hello", "contents": ["hello"], "finish_reason": "stop", "finish_reasons": ["stop"], "usage": {"prompt_tokens": None, "completion_tokens": None, "total_tokens": 5}, "additional_data": {"k": 1}}
    assert "additional_data" not in b and "error" not in b
    sinks.write_jsonl(two, str(tmp_path / "o"), projection="minimal", fields=["request_id"])
    assert len(text(tmp_path / "o")) == 4
    sinks.write_jsonl(two, str(tmp_path / "f"), append=False)
    full = sorted(text(tmp_path / "f"), key=lambda r: r["request_id"])
    assert full[0]["model_output"] == OUT and full[1]["additional_data"] is None and "timestamp" in full[0]
    assert {r["request_id"] for r in files.completed(two.sparkSession, str(tmp_path / "o")).collect()} == {"req-1", "req-2"}
    with pytest.raises(ValueError):
        sinks.shaped(two, "other")


def test_json_and_csv_sinks(two, tmp_path):
    sinks.write_json(two, str(tmp_path / "j"), timestamp=False)
    body = json.loads("\n".join(p.read_text() for p in (tmp_path / "j").glob("*.txt")))
    assert sorted(x["request_id"] for x in body) == ["req-1", "req-2"]
    assert {r[0] for r in files.completed(two.sparkSession, str(tmp_path / "j"), "json").collect()} == {"req-1", "req-2"}
    sinks.write_json(two.where("false"), str(tmp_path / "e"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "e").glob("*.txt"))) == []
    sinks.write_csv(two, str(tmp_path / "c"))
    sinks.write_csv(two, str(tmp_path / "c"))
    r = two.sparkSession.read.csv(str(tmp_path / "c"), header=True, escape='"').orderBy("request_id").collect()
    assert len(r) == 4 and (r[3]["content"], json.loads(r[3]["contents"]), r[3]["num_choices"], r[3]["total_tokens"]) == ("hello", ["hello", "bonjour", None], "3", "12")
    assert {x[0] for x in files.completed(two.sparkSession, str(tmp_path / "c"), "csv").collect()} == {"req-1", "req-2"}
    assert project.csv_rows(two, ["request_id", "content", "missing"]).columns == ["request_id", "content", "missing"]
    assert files.completed(two.sparkSession, str(tmp_path / "none")).collect() == []


def test_mirrored_sink(two, tmp_path):
    for _ in range(2):
        sinks.write_mirrored(two, str(tmp_path / "o"), projection="minimal")
    assert sorted(str(p.relative_to(tmp_path / "o")) for p in (tmp_path / "o").rglob("*.jsonl")) == ["a/result-00001.jsonl", "a/result.jsonl", "result-00001.jsonl", "result.jsonl"]
    assert json.loads((tmp_path / "o/a/result.jsonl").read_text())["request_id"] == "req-1"
    sinks.write_mirrored(two, str(tmp_path / "p"), "{source}_out.jsonl", timestamp=False)
    assert (tmp_path / "p/a/b_out.jsonl").exists() and (tmp_path / "p/c_out.jsonl").exists()
    sinks.write_mirrored(two, str(tmp_path / "q"), preserve=False)
    assert [p.name for p in (tmp_path / "q").rglob("*.jsonl")] == ["result.jsonl"]
    assert {r[0] for r in files.completed(two.sparkSession, str(tmp_path / "o")).collect()} == {"req-1", "req-2"}


def test_console(two, capsys):
    sinks.show(two, details=True)
    said = capsys.readouterr().out
    assert "Request: req-2" in said and "Choices: 3" in said and "Tokens: 12" in said and 'Additional: {"k":1}' in said


def test_payloads(spark):
    d = spark.createDataFrame([("say \"é\"\n",)], "p string").select(m.with_system(m.user_message("p"), "Be kind").alias("x"))
    one = json.loads(d.select(m.chat_payload("x", "model", 0.5, 10, rollout_n=3)).first()[0])
    assert one["messages"] == [{"role": "system", "content": "Be kind"}, {"role": "user", "content": 'say "é"\n'}] and one["n"] == 3 and one["temperature"] == 0.5
    assert "n" not in json.loads(d.select(m.chat_payload("x")).first()[0])
    assert json.loads(d.select(m.simple_payload("x", 5, 0.1)).first()[0]) == {"prompt": 'System: Be kind\nUser: say "é"\n', "max_tokens": 5, "temperature": 0.1}
    parts = spark.createDataFrame([("p", ["u1"])], "p string, u array<string>")
    from inferframe.functions.images import content_parts

    body = json.loads(parts.select(m.messages_json(m.multimodal_message(content_parts("p", F.col("u"))))).first()[0])
    assert body == [{"role": "user", "content": [{"type": "image_url", "image_url": {"url": "u1"}}, {"type": "text", "text": "p"}]}]


class Fake:
    """A model server in a thread; fails the first tries as told."""

    def __init__(self, failures=0, simple=False):
        owner = self
        self.seen, self.failures = [], failures

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                self.send_response(200), self.end_headers()

            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                owner.seen.append((self.path, body, self.headers.get("Authorization")))
                owner.failures -= 1
                ok = owner.failures < 0
                self.send_response(200 if ok else 500), self.end_headers()
                if ok:
                    self.wfile.write(json.dumps({"text": "t", "tokens": 3} if simple else {"choices": [{"message": {"content": "re: " + body["messages"][-1]["content"]}, "finish_reason": "stop"}], "usage": {"total_tokens": 4}}).encode())

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


def requests(spark, n=5):
    return normalize.requests(files.prompt_list(spark, [f"q{i}" for i in range(n)]))


def test_client_over_http(spark):
    a, b = Fake(), Fake()
    got = client.infer(requests(spark).repartition(1), [("a", a.url), ("b", b.url)], client.ClientSettings(3, health_interval=0), OpenAIAdapter((("Authorization", "Bearer k"),)), system_prompt="S").collect()
    assert {json.loads(r["model_output"])["choices"][0]["message"]["content"] for r in got} == {f"re: q{i}" for i in range(5)}
    assert len(a.seen) + len(b.seen) == 5 and a.seen and b.seen and a.seen[0][0] == "/v1/chat/completions" and a.seen[0][2] == "Bearer k"
    assert a.seen[0][1]["messages"][0] == {"role": "system", "content": "S"}


def test_client_retries_elsewhere(spark):
    bad, good = Fake(failures=100), Fake()
    got = client.infer(requests(spark, 4).repartition(1), [("bad", bad.url), ("good", good.url)], client.ClientSettings(1, 2, 0.0, health_interval=0)).collect()
    assert all(r["error"] is None for r in got) and max(len(r["attempts"]) for r in got) == 2
    tries = client.attempt_log(spark.createDataFrame([r for r in got], client.infer(requests(spark), []).schema))
    assert tries.where("not ok").select("server").distinct().collect()[0][0] == "bad"


def test_client_gives_up_with_an_error_row(spark):
    bad = Fake(failures=100)
    got = client.infer(requests(spark, 2), [("bad", bad.url)], client.ClientSettings(1, 1, 0.0, health_interval=0)).collect()
    assert all("500" in r["error"] and r["model_output"] is None and len(r["attempts"]) == 2 for r in got)
    none = client.infer(requests(spark, 2), [], client.ClientSettings(health_interval=0)).collect()
    assert [r["error"] for r in none] == ["no server available"] * 2


def test_backoff_and_unhealthy_servers():
    waits, calls = [], []

    def send(url, *_):
        calls.append(url)
        raise OSError("down")

    s = client.Session([("a", "http://a"), ("b", "http://b")], client.ClientSettings(max_retries=3, retry_delay=0.5, health_interval=0), OpenAIAdapter(), send, waits.append)
    answer, error, log = s.ask("{}", 1.0)
    assert answer is None and error == "down" and waits == [0.5, 1.0, 2.0] and [x["server"] for x in log][:2] == ["a", "b"] and len(log) == 4
    for x in s.router.servers:
        x.healthy = False
    assert s.ask("{}", 1.0)[1] == "no server available"


def test_health_probes():
    up = Fake()
    from inferframe.operators.routing import Server

    servers = [Server("up", up.url), Server("down", "http://127.0.0.1:9")]
    assert client.check_all(servers, OpenAIAdapter(), 2, 0.5) == []
    assert client.check_all(servers, OpenAIAdapter(), 2, 0.5) == ["down"] and not servers[1].healthy and servers[0].healthy


def test_simple_adapter(spark):
    s = Fake(simple=True)
    got = client.infer(requests(spark, 1), [("s", s.url)], client.ClientSettings(health_interval=0), SimpleAdapter()).first()
    out = json.loads(got["model_output"])
    assert out["choices"][0]["message"]["content"] == "t" and out["usage"]["total_tokens"] == 3 and s.seen[0][0] == "/generate" and s.seen[0][1]["prompt"] == "User: q0"
    assert SimpleAdapter().parse({"text": "", "output": "o"})["choices"][0]["message"]["content"] == "o" and SimpleAdapter().parse({})["usage"]["total_tokens"] == 0
    with pytest.raises(ValueError):
        client.infer(requests(spark, 1), [], adapter=SimpleAdapter(), rollout_n=2)
    with pytest.raises(ValueError):
        client.infer(requests(spark, 1), [], rollout_n=0)


def test_pipeline_resumes(spark, tmp_path):
    asked = []

    def model(df):
        asked.append(df.count())
        bad = F.col("request_id") == "prompt_2"
        return mock.complete(df).withColumn("error", F.when(bad, "boom")).withColumn("model_output", F.when(~bad, F.col("model_output")))

    p = Pipeline(requests(spark), model, lambda df: sinks.write_jsonl(df, str(tmp_path / "o"), projection="minimal"), str(tmp_path / "w"))
    one = p.run()
    assert (one["total"], one["completed"], one["failed"], one["success_rate"]) == (5, 4, 1, 0.8) and one["total_tokens"] == 4 * 33
    assert p.run()["total"] == 1 and asked == [5, 1] and len(text(tmp_path / "o")) == 4


def test_pipeline_by_position_and_bitmaps(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/conv.jsonl").write_text("".join(json.dumps({"id": i, "prompt": "p"}) + "\n" for i in range(10)))
    reqs = normalize.requests(files.directory_jsonl(spark, str(tmp_path / "in")))
    p = Pipeline(reqs.where("line_num in (1, 8)"), mock.complete, lambda df: df.count(), str(tmp_path / "w"))
    p.run()
    maps = compacted(spark, str(tmp_path / "w"))
    assert maps.select(F.bitmap_count("bits")).first()[0] == 2 and bytes(maps.first()["bits"])[0] == 0x81
    assert {r["line_num"] for r in resume.pending_by_bitmap(reqs, maps).collect()} == set(range(1, 11)) - {1, 8}
    assert {r["line_num"] for r in Pipeline(reqs, mock.complete, lambda df: None, str(tmp_path / "w")).pending().collect()} == set(range(1, 11)) - {1, 8}
    other = resume.bitmaps(reqs.where("line_num = 2"))
    assert resume.merged(maps, other).select(F.bitmap_count("bits")).first()[0] == 3


def test_bitmap_borders(spark):
    d = spark.createDataFrame([("f", n, i) for n in (1, 8, 32768, 32769) for i in (0, 1) if (n, i) != (32769, 1)], "source_file string, line_num long, item_idx int")
    maps = resume.bitmaps(d.where("not (line_num = 8 and item_idx = 1)"))
    asked = spark.createDataFrame([("f", 8, 1), ("f", 8, 0), ("f", 2, 0), ("f", 32769, 0), ("f", 32769, 1), ("g", 1, 0)], "source_file string, line_num long, item_idx int")
    assert {tuple(r) for r in resume.pending_by_bitmap(asked, maps).collect()} == {("f", 8, 1), ("f", 2, 0), ("f", 32769, 1), ("g", 1, 0)}


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    (tmp_path / "in/a").mkdir(parents=True)
    (tmp_path / "in/a/conv.jsonl").write_text('{"id":1,"prompt":"x"}\n\n[{"id":2,"prompt":"y"},{"id":3,"prompt":"z"}]\n')
    (tmp_path / "in/conv.jsonl").write_text('{"id":4,"prompt":"r"}\n')
    s = Stream(str(tmp_path / "in"), "conv.jsonl", str(tmp_path / "w"), files_per_batch=1)

    def go():
        run_stream(spark, s, mock.complete, lambda df: sinks.write_jsonl(df.select("*"), str(tmp_path / "o"), fields=["request_id"])).awaitTermination()
        return sorted(x["request_id"] for x in text(tmp_path / "o"))

    batch = normalize.requests(files.directory_jsonl(spark, str(tmp_path / "in")))
    assert go() == sorted(r["request_id"] for r in batch.collect()) == ["1", "2", "3", "4"]
    (tmp_path / "in/b").mkdir()
    (tmp_path / "in/b/conv.jsonl").write_text('{"id":5,"prompt":"n"}\n')
    assert go() == ["1", "2", "3", "4", "5"]
    log = spark.read.parquet(str(tmp_path / "w/resume"))
    assert {(r["source_file"], r["line_num"], r["item_idx"]) for r in log.collect()} == {("a/conv.jsonl", 1, 0), ("a/conv.jsonl", 3, 0), ("a/conv.jsonl", 3, 1), ("b/conv.jsonl", 1, 0), ("conv.jsonl", 1, 0)}


def test_stream_progress(spark, tmp_path):
    import time

    from inferframe.streaming.progress import Progress

    (tmp_path / "in").mkdir()
    (tmp_path / "in/conv.jsonl").write_text('{"id":1,"prompt":"x"}\n')
    seen, ends = [], []
    listener = Progress(lambda b, n, rate: seen.append((b, n)), on_end=ends.append)
    spark.streams.addListener(listener)
    try:
        run_stream(spark, Stream(str(tmp_path / "in"), "conv.jsonl", str(tmp_path / "w")), mock.complete, lambda df: df.count()).awaitTermination()
        for _ in range(50):
            if ends:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert seen and seen[0][0] == 0 and seen[0][1] >= 1 and ends == [None]


@pytest.fixture
def plain_logging():
    import logging

    root = logging.getLogger()
    kept, level = root.handlers[:], root.level
    yield
    root.handlers[:] = kept
    root.setLevel(level)


def conf(tmp_path, **runner):
    c = {"loader": {"class": "PromptListLoader", "params": {"prompts": ["a", "b"]}}, "saver": {"class": "JSONLResultSaver", "params": {"output_path": str(tmp_path / "out"), "output_projection": "minimal"}}, "runner": runner}
    p = tmp_path / "c.json"
    p.write_text(json.dumps(c))
    return str(p)


def test_command_line(spark, tmp_path, plain_logging):
    path = conf(tmp_path, model_name="m")
    assert cli.main(["-c", path, "--mock"]) == 0
    assert sorted(x["request_id"] for x in text(tmp_path / "out")) == ["prompt_0", "prompt_1"]
    assert cli.main(["-c", path, "--mock"]) == 0 and len(text(tmp_path / "out")) == 2
    assert cli.main(["-c", conf(tmp_path, nonsense=1), "--mock"]) == 1
    assert cli.main(["-c", str(tmp_path / "none.yaml"), "--mock"]) == 1


def test_command_line_with_servers(spark, tmp_path, plain_logging):
    s = Fake()
    (tmp_path / "servers").mkdir()
    (tmp_path / f"servers/server_127.0.0.1_{s.server.server_port}").write_text("")
    path = conf(tmp_path, servers_dir=str(tmp_path / "servers"), health_check_interval=0)
    assert cli.main(["-c", path, "--concurrency", "2", "--model", "big", "--temperature", "0", "--max-tokens", "7", "--set", f"saver.params.output_path={tmp_path}/other"]) == 0
    assert {x["content"] for x in text(tmp_path / "other")} == {"re: a", "re: b"}
    assert s.seen[0][1]["model"] == "big" and s.seen[0][1]["temperature"] == 0 and s.seen[0][1]["max_tokens"] == 7


def test_configuration(tmp_path):
    assert config.build({"loader": {"class": "A"}, "saver": {"class": "B"}, "runner": {"stream_queue_size": 7}}).runner.producer_prefetch == 7
    for bad in ({}, {"loader": {}, "saver": {"class": "B"}, "runner": {}}, {"loader": {"class": "A"}, "saver": {}, "runner": {}}, {"loader": {"class": "A"}, "saver": {"class": "B"}}):
        with pytest.raises(ValueError):
            config.build(bad)
    with pytest.raises(TypeError):
        config.build({"loader": {"class": "A"}, "saver": {"class": "B"}, "runner": {"x": 1}})
    with pytest.raises(ValueError):
        config.Runner(rollout_n=0)
    r = config.Runner(max_concurrency=10, max_active_requests=50, load_balancing_strategy="p2c_cost_aware").client(4)
    assert r.concurrency == 3 and r.policy == Policy("p2c_cost_aware", max_active=13)


def test_yaml(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("loader:\n  class: PromptListLoader\n  params:\n    prompts: [a]\nsaver:\n  class: ConsoleResultSaver\nrunner:\n  max_concurrency: 3\n")
    c = config.load(str(tmp_path / "c.yaml"), {"loader.params.chunk_index": 2})
    assert c.runner.max_concurrency == 3 and c.loader["params"] == {"prompts": ["a"], "chunk_index": 2}


def test_registry(tmp_path, monkeypatch):
    (tmp_path / "my_parts.py").write_text("from inferframe.registry import register_source\n\n@register_source('Mine')\ndef mine(spark, p):\n    return None\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert registry.import_modules(["my_parts", "no_such_module"]) == ["my_parts"] and "Mine" in registry.names("source")
    assert registry.unregister("source", "Mine") and not registry.unregister("source", "Mine")
    with pytest.raises(ValueError, match="unknown source"):
        registry.get("source", "Mine")
    with pytest.raises(TypeError):
        registry.register("sink")(3)


def test_slots_are_filled_again_as_they_come_free():
    """One slow request doesn't keep the others from being replaced; no more than n run at once."""
    import time

    running, most, order, lock = 0, 0, [], threading.Lock()

    def work(x):
        nonlocal running, most
        with lock:
            running += 1
            most = max(most, running)
        time.sleep(0.5 if x == 0 else 0.01)
        with lock:
            running -= 1
            order.append(x)
        return x

    pulled = []

    def source():
        for x in range(30):
            pulled.append(x)
            yield x

    got = [r for r in client._in_flight(source(), work, 3) if r is not None]
    assert sorted(x for x, _ in got) == list(range(30)) and most <= 3
    assert order.index(0) > 15  # the others went on meanwhile


def test_answers_go_on_when_nothing_more_comes():
    gate = threading.Event()
    out = client._in_flight(iter([1, 2]), lambda x: (x == 1 or gate.wait(5)) and x, 2, flush=0.05)
    seen = [next(out), next(out)]
    gate.set()
    assert seen[0] == (1, 1) and seen[1] is None and [x for x in out if x is not None] == [(2, 2)]


def test_a_wait_for_the_next_try_takes_no_slot():
    """40 requests that wait 0.3 s each, two at a time: 6 s if they waited in their slots. Never more than two are at the server, nor more held than are read ahead."""
    import time

    now, most, ahead, lock = [0], [0], [0, 0], threading.Lock()

    def send(url, *_):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.005)
        with lock:
            now[0] -= 1
        raise OSError("down")

    def source():
        for i in range(40):
            ahead[0] += 1
            ahead[1] = max(ahead[1], ahead[0])
            yield i

    s = client.Session([("a", "http://a")], client.ClientSettings(max_retries=2, retry_delay=0.1, health_interval=0), OpenAIAdapter(), send)
    began, got = time.monotonic(), []
    for x in client._in_flight(source(), lambda i: client._step(s.tries("{}", 1.0)), 2, 18):
        ahead[0] -= 1
        got.append(x)
    took = time.monotonic() - began
    assert sorted(i for i, _ in got) == list(range(40)) and all(len(log) == 3 and [t["backoff_s"] for t in log] == [0.1, 0.2, 0.0] for _, (_, _, log) in got)
    assert 0.6 <= took < 4 and most[0] == 2 and ahead[1] <= 20


def test_retries_go_on_while_the_source_is_slow_and_errors_come_through():
    gate = threading.Event()

    def source():
        yield 1
        yield 2
        assert gate.wait(5)  # set by the second step of 1, before more is read
        yield 3

    def work(x):
        return client.Later(0.02, lambda: gate.set() or x) if x == 1 else x

    assert sorted(r[0] for r in client._in_flight(source(), work, 2, 5) if r is not None) == [1, 2, 3]
    with pytest.raises(ZeroDivisionError):
        list(client._in_flight(iter([1, 0]), lambda x: 1 / x, 2))
    before = threading.active_count()
    out = client._in_flight(iter(range(100)), lambda x: x, 4, 10)
    next(out)
    out.close()
    assert threading.active_count() <= before


class KeepAlive(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"
    connections: set = set()
    closing = False

    def do_POST(self):
        self.connections.add(self.client_address)
        body = self.rfile.read(int(self.headers["Content-Length"]))
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        if self.closing:
            self.send_header("Connection", "close")
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_connections_are_kept_and_limited():
    from concurrent.futures import ThreadPoolExecutor

    class Handler(KeepAlive):
        connections: set = set()

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/x?y=1"
    c = client.Connections(2, 1)
    with ThreadPoolExecutor(8) as pool:
        assert list(pool.map(lambda i: c.post(url, json.dumps({"i": i}).encode(), 5), range(40))) == [{"i": i} for i in range(40)]
    assert c.kept == 1 and c.opened == len(Handler.connections) < 40
    for own in c.free.values():  # a server that has closed a kept connection meanwhile
        for x in own:
            x.sock.close()
            x.sock = None
    assert c.post(url, b"{}", 5) == {}
    Handler.closing = True
    c.post(url, b"{}", 5), c.close()
    assert c.kept == 0


def test_fresh_probes_are_shared(monkeypatch):
    asked = []
    monkeypatch.setattr(client, "probe", lambda url, timeout: asked.append(url) or True)
    monkeypatch.setattr(client, "_probes", {})
    assert client.probed("u", 1, 10) and client.probed("u", 1, 10) and len(asked) == 1
    assert client.probed("u", 1, 0) and len(asked) == 2


def test_bitmap_backend_leaves_rows_without_a_position_in_the_log(spark, tmp_path):
    from inferframe.plans.pipeline import Pipeline, compacted
    from inferframe.sources import mock

    lines = spark.createDataFrame([("a", "", i, json.dumps({"id": i, "prompt": f"p{i}"})) for i in range(1, 5)], "source_file string, source_dir string, line_num long, value string")
    rows = normalize.requests(normalize.fan_out(lines)).union(normalize.requests(files.prompt_list(spark, ["x", "y"])))
    seen = []
    job = Pipeline(rows, mock.complete, lambda df: seen.append(df.count()), str(tmp_path / "w"), backend="bitmap")
    first, second = job.run(), job.run()
    assert (first["total"], first["skipped"]) == (6, 0) and (second["total"], second["skipped"]) == (0, 6) and seen == [6, 0]
    assert spark.read.parquet(job.log_path()).count() == 2 and compacted(spark, job.work).count() == 1
    with pytest.raises(ValueError):
        Pipeline(rows, mock.complete, print, "w", backend="other")


def test_a_json_array_is_written_and_read_by_many_tasks(spark, tmp_path):
    """One document in one file, in the order of the rows; the scan of its ids splits it, whatever entries hold."""
    body = {"choices": [{"message": {"content": 'a\n  {\n"request_id": 7}, [\n{ é'}}], "nested": {"request_id": "no", "x": [{}, {"y": None}]}}
    rows = results(spark, *[(f"r{i:03}", body, None, None, None, None, None) for i in range(300)]).repartitionByRange(5, "request_id").sortWithinPartitions("request_id")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for pretty in (True, False):
        sinks.write_json(rows.limit(2), str(tmp_path / "j"), pretty)
        sinks.write_json(rows, str(tmp_path / "j"), pretty, timestamp=False)
        (file,) = (tmp_path / "j").glob("*.txt")
        got = json.loads(file.read_text())
        assert [x["request_id"] for x in got] == [f"r{i:03}" for i in range(300)] and got[7]["model_output"] == body
        assert not list(tmp_path.glob("_staging*"))
        for size in (997, 4001):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            try:
                ids = files.completed(spark, str(tmp_path / "j"), "json")
                found = files._array_ids(spark, str(tmp_path / "j"))
                assert found.rdd.getNumPartitions() > 5 and found.count() == 300 and ids.count() == 300
            finally:
                spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("text, want", [
    (json.dumps([{"request_id": "a"}, {"request_id": 2}, {"x": 1}]), {"a", "2"}),
    (json.dumps([{"request_id": "a", "x": [{"request_id": "n"}]}, {}, {"request_id": "b"}, None, {"request_id": "c"}], indent=2), {"a", "b", "c"}),
    ('[\n{"request_id": "a"},\n{"request_id": "b"}, {"request_id": "c"}\n]', {"a", "b", "c"}),
    ('[\n  {\n "request_id": "a", "x": [1,\n  {\n "request_id": "n"}]},\n  {\n "request_id": "b"}]', {"a", "b"}),
    ('[\n{"request_id": "a", "x": [\n{"request_id": "n"}\n]},\n{"request_id": "b"}\n]', {"a", "b"}),
    ('[\r\n  {\r\n    "request_id": "a"\r\n  }\r\n]\r\n', {"a"}),
    ("[]", set()), ("", set()), ("[\n{", set()),
])
def test_finished_ids_of_arrays_in_other_layouts(spark, tmp_path, text, want):
    (tmp_path / "a.json").write_bytes(text.encode())
    assert {r[0] for r in files.completed(spark, str(tmp_path / "a.json"), "json").collect()} == want
    assert {r[0] for r in files.completed(spark, str(tmp_path), "json").collect()} == want


def test_a_first_run_reads_its_source_once(spark, tmp_path):
    """With nothing done before, no scan counts what was skipped."""
    from inferframe.plans.pipeline import Pipeline
    from inferframe.sources import mock

    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = normalize.requests(files.prompt_list(spark, ["x", "y", "z"]))
    rows = rows.mapInArrow(seen, rows.schema)
    job = Pipeline(rows, mock.complete, lambda df: None, str(tmp_path / "w"))
    assert job.run()["skipped"] == 0 and read.value == 3
    assert job.run()["skipped"] == 3


def test_lifecycle_of_a_run_that_fails(spark, tmp_path):
    from inferframe.plans.pipeline import Lifecycle, Pipeline
    from inferframe.sources import mock

    told = []
    life = Lifecycle(on_start=lambda w: told.append("start"), on_complete=lambda s: told.append("end"), on_error=lambda e: told.append(str(e)))

    def sink(df):
        raise OSError("disk full")

    with pytest.raises(OSError):
        Pipeline(requests(spark), mock.complete, sink, str(tmp_path / "w"), lifecycle=life).run()
    assert told == ["start", "disk full"]
    boom = Lifecycle(on_start=lambda w: 1 / 0)  # a hook's own error is only logged
    assert Pipeline(requests(spark), mock.complete, lambda df: None, str(tmp_path / "v"), lifecycle=boom).run()["total"] == 5


def test_a_repeated_micro_batch_replaces_its_output(spark, tmp_path):
    rows = spark.createDataFrame([("1", "{}", None, None)], "request_id string, model_output string, additional_data string, error string")
    sink = sinks.batch_jsonl(str(tmp_path / "out"), projection="minimal", timestamp=False)
    sink(rows, 3), sink(rows, 3), sink(rows, 4)
    assert spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "out")).count() == 2


def test_task_progress(spark):
    import time

    from inferframe.streaming.progress import TaskProgress

    told = []
    with TaskProgress(spark, 0.02, lambda *x: told.append(x)):
        spark.range(4).repartition(3).count()
        time.sleep(0.1)
    n = len(told)
    time.sleep(0.1)
    assert told and len(told) <= n + 1 and all(a <= b for a, b in told)
    with TaskProgress(spark, 0, lambda *x: told.append(None)):
        time.sleep(0.05)
    assert None not in told


def test_classes_of_modules(tmp_path, monkeypatch):
    (tmp_path / "my_json_loader.py").write_text("class MyJSONLoader:\n    pass\n\ndef make(spark, p):\n    return 1\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert registry.snake("MyJSONLoader") == "my_json_loader" and registry.get("source", "MyJSONLoader").__name__ == "MyJSONLoader"
    assert registry.get("source", "my_json_loader.make")(None, {}) == 1
    for name in ("NoSuchLoader", "my_json_loader.absent", "no.such.Thing"):
        with pytest.raises(ValueError):
            registry.get("source", name)


def test_example_configurations(spark):
    from pathlib import Path

    found = sorted((Path(__file__).parent.parent / "examples").glob("*.json"))
    assert len(found) >= 6
    for p in found:
        c = config.load(str(p))
        assert registry.get("source", c.loader["class"]) and registry.get("sink", c.saver["class"]) and c.runner.client(4).concurrency >= 1


def test_settings_of_a_task():
    c = config.Runner(max_concurrency=64, producer_prefetch=40, writer_batch_size=7, writer_flush_interval_ms=250, http_max_connections=100, http_max_keepalive_connections=10, health_check_concurrency=5).client(4)
    assert (c.concurrency, c.prefetch, c.batch, c.flush, c.connections, c.keepalive, c.health_workers) == (16, 10, 7, 0.25, 25, 3, 5)
