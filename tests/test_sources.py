"""Files in, requests out."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from inferframe import components
from inferframe.functions.ids import canonical_id
from inferframe.operators import chunks, normalize
from inferframe.operators.normalize import Fields, Hooks
from inferframe.registry import get
from inferframe.sources import files, servers


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def jl(*rows):
    return "".join(json.dumps(r) + "\n" for r in rows)


def load(spark, name, **params):
    rows = get("source", name)(spark, params).collect()
    return sorted(rows, key=lambda r: (r["source_file"] or "", r["line_num"] or 0, r["item_idx"] or 0, r["request_id"]))


def test_jsonl(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", b'{"id":1,"prompt":"What is AI?","category":"tech","priority":5,"n":null}\r\n\r\n  \n{bad\n{"prompt":"No id","x":[1,"b"]}\n{"id":"3","question":"none"}\n{"id":"4","prompt":""}\n')
    r = load(spark, "JSONLDataLoader", file_path=p)
    assert [(x["request_id"], x["prompt"], x["line_num"]) for x in r][0] == ("1", "What is AI?", 1)
    assert json.loads(r[0]["additional_data"]) == {"category": "tech", "priority": 5}
    assert r[1]["request_id"] == canonical_id('{"prompt":"No id","x":[1,"b"]}', "prompt", "id") and r[1]["line_num"] == 5
    assert (r[2]["request_id"], r[2]["prompt"], r[2]["dispatch_cost"]) == ("4", "", 1.0) and len(r) == 3
    assert r[0]["messages"][0]["role"] == "user" and r[0]["messages"][0]["content"] == "What is AI?"
    with pytest.raises(ValueError, match="not JSON"):
        load(spark, "JSONLDataLoader", file_path=p, streaming=False)


def test_empty_file_is_an_error_only_in_batch_mode(spark, tmp_path):
    p = write(tmp_path / "e.jsonl", "\n")
    assert load(spark, "JSONLDataLoader", file_path=p) == []
    with pytest.raises(ValueError, match="no data"):
        load(spark, "JSONLDataLoader", file_path=p, streaming=False)


def test_canonical_id():
    import hashlib

    want = hashlib.sha256(json.dumps({"prompt": "é", "data": {"a": 1, "b": [2]}}, sort_keys=True).encode()).hexdigest()
    assert canonical_id('{"b":[2],"prompt":"é","a":1}', "prompt", "id") == want
    assert canonical_id('{"b":[2],"prompt":"é","a":1,"uid":7}', "prompt", "uid") == want
    assert canonical_id("[1]", "prompt", "id") is None and canonical_id("{", "prompt", "id") is None


def test_fan_out_of_list_lines(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", '[{"id":"q","prompt":"one"},7,{"id":"q","prompt":"two"},{"prompt":"three"}]\n[{"id":"s","prompt":"alone"}]\n5\n"x"\nnull\n{"id":"d","prompt":"a","prompt":"b"}\n')
    r = load(spark, "JSONLDataLoader", file_path=p)
    assert [(x["prompt"], x["item_idx"]) for x in r] == [("one", 0), ("two", 2), ("three", 3), ("alone", 0), ("b", 0)]
    assert [x["request_id"] for x in r[:2]] == ["q_0", "q_2"] and r[3]["request_id"] == "s"


def test_dispatch_cost_fields(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", jl({"id": 1, "prompt": "x" * 40}, {"id": 2, "prompt": "x", "input_tokens": 9, "prompt_tokens": 4}, {"id": 3, "prompt": "x" * 8, "dispatch_cost": 0, "estimated_tokens": "7"}, {"id": 4, "prompt": "x", "dispatch_cost": True}))
    assert [x["dispatch_cost"] for x in load(spark, "JSONLDataLoader", file_path=p)] == [10.0, 9.0, 2.0, 1.0]


def test_hooks(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", jl({"id": 1, "text": "a", "language": "en"}, {"id": 2, "text": "b", "language": "fr"}, {"id": 3, "question": "c"}))
    hooks = Hooks(skip=lambda i: normalize.text_of(i, "language") == "fr", prompt=lambda i: normalize.first_present(i, "question", "text"), transform_prompt=lambda q, i: F.upper(q), request_id=lambda i: F.concat(F.lit("r"), normalize.text_of(i, "id")))
    assert [(x["request_id"], x["prompt"]) for x in load(spark, "JSONLDataLoader", file_path=p, hooks=hooks)] == [("r1", "A"), ("r3", "C")]


def test_json_array(spark, tmp_path):
    p = write(tmp_path / "a.json", json.dumps([{"id": 1, "prompt": "a", "k": None}, {"id": 2, "other": 1}, {"prompt": "c"}], indent=1))
    r = load(spark, "JSONDataLoader", file_path=p)
    assert [x["prompt"] for x in r] == ["a", "c"] and json.loads(r[0]["additional_data"]) == {"k": None}
    with pytest.raises(ValueError, match="list"):
        load(spark, "JSONDataLoader", file_path=write(tmp_path / "b.json", '{"id":1}'))
    assert [x["prompt"] for x in load(spark, "JSONDataLoader", file_path=p, num_chunks=2, chunk_index=1)] == []


def test_csv(spark, tmp_path):
    p = write(tmp_path / "a.csv", 'id,prompt,category\n1,"say ""hi""\nthere",x\n2,,y\n,third,\n')
    r = load(spark, "CSVDataLoader", file_path=p)
    assert {x["prompt"] for x in r} == {'say "hi"\nthere', "third"}
    one = next(x for x in r if x["request_id"] == "1")
    assert json.loads(one["additional_data"]) == {"category": "x"} and next(x for x in r if x["prompt"] == "third")["additional_data"] is None
    with pytest.raises(ValueError, match="no column"):
        load(spark, "CSVDataLoader", file_path=p, prompt_field="text")


def test_prompt_list(spark):
    r = load(spark, "PromptListLoader", prompts=["a", {"prompt": "b", "id": "x"}, {"id": "no"}, {"prompt": "d"}])
    assert {(x["request_id"], x["prompt"]) for x in r} == {("prompt_0", "a"), ("x", "b"), ("prompt_3", "d")}
    with pytest.raises(ValueError):
        load(spark, "PromptListLoader")
    with pytest.raises(ValueError):
        load(spark, "PromptListLoader", prompts="a")


def test_directory(spark, tmp_path):
    write(tmp_path / "conv.jsonl", jl({"id": 0, "prompt": "root"}))
    write(tmp_path / "a b/ü+1/conv.jsonl", "x\n" + jl({"id": 1, "prompt": "deep"}))
    write(tmp_path / "a b/other.jsonl", jl({"id": 2, "prompt": "no"}))
    r = load(spark, "DirectoryJSONLDataLoader", input_dir=str(tmp_path))
    assert [(x["source_file"], x["source_dir"], x["line_num"], x["prompt"]) for x in r] == [("a b/ü+1/conv.jsonl", "a b/ü+1", 2, "deep"), ("conv.jsonl", "", 1, "root")]
    assert [x["prompt"] for x in load(spark, "DirectoryJSONLDataLoader", input_dir=str(tmp_path), recursive=False)] == ["root"]


def test_chunks_of_a_directory_are_disjoint_and_complete(spark, tmp_path):
    for f in "ab":
        write(tmp_path / f / "conv.jsonl", jl(*[{"id": f"{f}{i}", "prompt": "p"} for i in range(3)]))
    got = [{x["request_id"] for x in load(spark, "DirectoryJSONLDataLoader", input_dir=str(tmp_path), num_chunks=2, chunk_index=k)} for k in (0, 1)]
    assert got == [{"a0", "a2", "b1"}, {"a1", "b0", "b2"}]
    with pytest.raises(ValueError):
        load(spark, "DirectoryJSONLDataLoader", input_dir=str(tmp_path), num_chunks=2, chunk_index=2)


def test_a_chunk_reads_its_folder_twice_and_shuffles_no_line(spark, tmp_path):
    """Once to count lines by block, once for the lines; the table of blocks goes to the tasks."""
    for f in "abc":
        write(tmp_path / f / "conv.jsonl", "\n" + jl(*[{"id": f"{f}{i}", "prompt": "p"} for i in range(4)]) + "  \n")
    one = files.lines(spark, str(tmp_path), "conv.jsonl", num_chunks=4, chunk_index=1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 2 and "SortMergeJoin" not in plan
    assert {(r["source_file"], r["line_num"]) for r in one.collect()} == {("a/conv.jsonl", 2), ("b/conv.jsonl", 4), ("c/conv.jsonl", 2)}
    deep = files.lines(spark, str(tmp_path), "conv.jsonl", recursive=False, num_chunks=2, chunk_index=0)
    assert deep.count() == 0
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:  # blocks of a file
        p = write(tmp_path / "big.jsonl", "".join(f"line {i}\n" for i in range(5000)))
        for k in range(3):
            assert sorted(int(r["value"][5:]) for r in files.lines(spark, p, num_chunks=3, chunk_index=k).collect()) == list(range(k, 5000, 3))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_strip(spark):
    from inferframe.functions.text import strip

    texts = ["", " ", "a", " a", "a\t\n", "\u2003a b\u0085", "\u200ba", "\u2028x\ny\u2029", None, "\x1f b"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(strip("t")).collect()
    assert [r[0] for r in got] == ["", "", "a", "a", "a", "a b", "\u200ba", "x\ny", None, "\x1f b"]


def test_line_numbers_over_split_files(spark, tmp_path):
    p = write(tmp_path / "big.jsonl", "".join(f"line {i} {'x' * (i % 37)}\n" for i in range(1, 5001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = files.lines(spark, p)
        assert rows.count() == 5000 and rows.where(F.split("value", " ")[1].cast("long") != F.col("line_num")).count() == 0
        assert files.scan(spark, p).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_skipped_sources(spark, tmp_path):
    for f in "ab":
        write(tmp_path / f / "conv.jsonl", jl({"id": f, "prompt": "p"}))
    rows = files.lines(spark, str(tmp_path), "conv.jsonl", skip_source=lambda f: f.contains("/a/"))
    assert [r["source_file"] for r in rows.collect()] == ["b/conv.jsonl"]


def test_fan_out_in_sql(spark):
    from inferframe.sources import udtf

    udtf.register(spark)
    rows = spark.sql("""SELECT n, item_idx, raw FROM VALUES (1, '[{"a":1},2,{"b":"é"}]'), (2, '{"c":3}'), (3, 'x'), (4, null) AS t(n, v), LATERAL fan_out(v) ORDER BY n, item_idx""").collect()
    assert [tuple(r) for r in rows] == [(1, 0, '{"a": 1}'), (1, 2, '{"b": "é"}'), (2, 0, '{"c": 3}')]


def test_text_lines(spark, tmp_path):
    write(tmp_path / "d/a.txt", "first\n\n third \n")
    assert [(x["request_id"], x["prompt"]) for x in load(spark, "TextLinesLoader", input_dir=str(tmp_path))] == [("a.txt:1", "first"), ("a.txt:3", "third")]


def test_images(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", jl({"id": 1, "prompt": "p", "image": "photo.jpg"}, {"id": 2, "prompt": "p", "images": ["a.jpg", "data:image/png;base64,QQ==", "http://x/b.png"]}, {"id": 3, "prompt": "p", "image": "s.jpg", "images": ["t.jpg"]}, {"id": 4, "prompt": "p", "image": "", "images": ["t.jpg"]}, {"id": 5, "prompt": "p"}))
    r = load(spark, "MultimodalJSONLDataLoader", file_path=p, encode_images=False, image_base_dir="/data")
    assert [x["images"] for x in r] == [["photo.jpg"], ["data:image/png;base64,QQ==", "a.jpg", "http://x/b.png"], ["s.jpg"], None, None]
    urls = [[q["image_url"]["url"] for q in (x["messages"][0]["parts"] or []) if q["type"] == "image_url"] for x in r]
    assert urls == [["file:///data/photo.jpg"], ["data:image/png;base64,QQ==", "file:///data/a.jpg", "http://x/b.png"], ["file:///data/s.jpg"], [], []]
    assert r[0]["messages"][0]["parts"][-1]["text"] == "p" and r[4]["messages"][0]["content"] == "p"
    assert [x["dispatch_cost"] for x in r] == [257.0, 769.0, 257.0, 1.0, 1.0]


def test_images_beside_their_file_are_encoded(spark, tmp_path):
    png = bytes(range(256)) * 3
    write(tmp_path / "shard_000/sample.png", png)
    write(tmp_path / "shard_000/conv.jsonl", jl({"id": 1, "prompt": "p", "image": "sample.png"}, {"id": 2, "prompt": "p", "image": "missing.png"}))
    r = load(spark, "MultimodalDirectoryJSONLDataLoader", input_dir=str(tmp_path))
    url = [x["messages"][0]["parts"][0]["image_url"]["url"] for x in r]
    assert url == ["data:image/png;base64," + base64.b64encode(png).decode(), "missing.png"] and r[0]["source_dir"] == "shard_000"
    r = load(spark, "MultimodalDirectoryJSONLDataLoader", input_dir=str(tmp_path), image_base_dir=str(tmp_path / "shard_000"))
    assert r[0]["messages"][0]["parts"][0]["image_url"]["url"].startswith("data:image/png;base64,")


def test_variations(spark):
    items = files.prompt_list(spark, [])
    raw = spark.createDataFrame([('{"id":"a","variations":["x","y"],"k":1}',), ('{"id":"b"}',)], "raw string")
    items = items.unionByName(raw.select(F.lit("f").alias("source_file"), F.lit("").alias("source_dir"), F.lit(1).cast("long").alias("line_num"), F.lit(0).alias("item_idx"), F.lit(1).alias("n_same"), "raw"))
    r = sorted(normalize.requests(normalize.explode_field(items, "variations")).collect(), key=lambda x: x["request_id"])
    assert [(x["request_id"], x["prompt"], json.loads(x["additional_data"])) for x in r] == [("a_var_0", "x", {"k": 1, "_variation_index": 0}), ("a_var_1", "y", {"k": 1, "_variation_index": 1})]


def test_nested_items_and_media(spark):
    d = spark.createDataFrame([('{"data":{"prompt":"in","media":[{"type":"image","path":"a.png"},{"type":"audio","path":"b"}]}}',), ('{"prompt":"out"}',)], "raw string")
    item = normalize.nested(F.from_json("raw", "map<string,variant>"), "data", "content")
    assert [r[0] for r in d.select(normalize.text_of(item, "prompt")).collect()] == ["in", "out"]


def test_allow_list(spark):
    d = spark.createDataFrame([('{"id":1,"prompt":"p","category":"c","secret":"s"}',)], "raw string")
    item = F.from_json("raw", "map<string,variant>")
    assert d.select(normalize.additional(item, Fields(keep=("category",)))).first()[0] == '{"category":"c"}'


def test_servers(spark, tmp_path):
    for n in ("server_10.0.0.1_8000", "server_10.0.0.2_8001.bak", "notes", "server_node-b_9"):
        write(tmp_path / n, "")
    (tmp_path / "server_dir_1").mkdir()
    assert [(r["name"], r["url"]) for r in servers.discover(spark, str(tmp_path)).collect()] == [("server_10.0.0.1_8000", "http://10.0.0.1:8000"), ("server_node-b_9", "http://node-b:9")]
    with pytest.raises(ValueError):
        servers.discover(spark, str(tmp_path / "server_dir_1"))


def test_chunk_paths():
    assert chunks.chunk_path("out/r.jsonl", 3, 1) == "out/r_chunk_1.jsonl" and chunks.chunk_path("out/r", 2, 0) == "out/r_chunk_0"
    assert chunks.chunk_path("out/r.jsonl", 1, 0) == "out/r.jsonl"
    assert components.output_path({"output_path": "o.jsonl"}, {"num_chunks": 4, "chunk_index": 2}) == "o_chunk_2.jsonl"
    assert components.output_path({"output_path": "o.jsonl", "add_chunk_suffix": False}, {"num_chunks": 4, "chunk_index": 2}) == "o.jsonl"
