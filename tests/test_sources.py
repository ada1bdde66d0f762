import json

from pyspark.sql import functions as F

from opsframe.schemas import ENTITIES
from opsframe.sources import entities as en
from opsframe.sources import files as fs
from opsframe.sources import jsonl as js


def test_line_numbers_over_splits(spark, tmp_path, both_ways):
    """Numbers count blank and torn lines, in files cut into several splits."""
    path = tmp_path / "log"
    path.mkdir()
    for name in "ab":
        lines = [
            "" if i % 10 == 3 else ('{"n": ' if i % 10 == 5 else json.dumps({"n": i, "pad": "x" * 50}))
            for i in range(1, 401)
        ]
        (path / name).write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        log = js.read_jsonl_tolerant(spark, str(path), "n int, pad string")
        rows = log.select("path", "line_no", "torn", "record.n").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 720
    assert all(r.torn == (r.line_no % 10 == 5) for r in rows)
    assert all(r.n == r.line_no for r in rows if not r.torn)


def test_quarantine_and_append(spark, tmp_path):
    records = spark.createDataFrame(
        [("note", 'say "é"', {"b": "2", "a": "1"}), ("note", "x", None)], "kind string, content string, provenance map<string,string>"
    )
    now = F.lit("2024-05-06 07:08:09").cast("timestamp")
    log = str(tmp_path / "log")
    js.append_records(records, log, now)
    spark.createDataFrame([('{"kind": "torn',)], "value string").write.mode("append").text(log)
    read = js.read_jsonl_tolerant(spark, log)
    lines = {r.text for r in read.filter("not torn").collect()}
    want = {
        json.dumps({"timestamp": "2024-05-06T07:08:09+00:00", "kind": "note", "content": c, "provenance": p},
                   ensure_ascii=False, sort_keys=True)
        for c, p in [('say "é"', {"a": "1", "b": "2"}), ("x", {})]
    }
    assert lines == want
    counts = js.quarantine_torn(read, str(tmp_path / "new"), str(tmp_path / "bad"), now)
    assert counts == (2, 1)
    assert js.read_jsonl_tolerant(spark, str(tmp_path / "new")).filter("torn").count() == 0
    moved = spark.read.text(str(tmp_path / "bad")).collect()
    assert moved[0].value.startswith("# torn line 1 (quarantined 2024-05-06T07:08:09Z)")


def test_entity_round_trip(spark):
    row = {
        "id": "w1", "namespace": "n", "name": "é", "image": "i", "replicas": 1, "min_replicas": 0,
        "max_replicas": 4, "cpu": 100, "memory": 128, "policy": "fifo", "node_tags": ["b", "a"], "pin": None,
        "spread": False, "priority": 0, "status": "active", "desired_replicas": 1, "created_at": 1.5,
        "updated_at": 2.0, "health_path": None,
        "scaler": {"cooldown_seconds": 3.0, "metrics": {"z": {"target": 1.0, "min": 0.5, "max": 2.0}, "a": {"target": 2.0, "min": 1.0, "max": 3.0}}},
    }
    text = json.dumps(row, sort_keys=True, separators=(",", ":"))
    rows = spark.createDataFrame([("w1", text)], "id string, payload string")
    decoded = en.decode_entity_rows(rows, "workloads")
    assert en.encode_entity_rows(decoded).first().payload == text
    bare = spark.createDataFrame([("w", '{"id":"w","status":"pending"}')], "id string, payload string")
    flow = en.decode_entity_rows(bare, "workflows").first()
    assert (flow.dead_letter, flow.trace_id, flow.cancel_requested, flow.epoch) == (True, "", False, 1)
    assert set(ENTITIES) >= {"tokens", "leases", "attempts", "events", "dlq", "nodes"}
    for entity in ENTITIES:
        en.decode_entity_rows(bare, entity).collect()


def test_file_hashes(spark, tmp_path):
    import hashlib

    (tmp_path / "a.txt").write_bytes(b"hello")
    hashes = fs.file_hashes(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", "[^/]+$", 0))
    asked = spark.createDataFrame([("a.txt",), ("b.txt",)], "path string")
    got = {r.path: (r["exists"], r.hash) for r in fs.file_snapshot(asked, hashes).collect()}
    assert got == {"a.txt": (True, hashlib.sha256(b"hello").hexdigest()), "b.txt": (False, None)}


def test_large_files_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    """A file beyond what Spark reads as one value has its hash, whatever its bytes and name."""
    import hashlib
    import random

    monkeypatch.setattr(fs, "WHOLE_FILE_BYTES", 1000)
    monkeypatch.setattr(fs, "PIECE_BYTES", 700)
    noise, mark = random.Random(3).randbytes, b"\xef\xbb\xbf"
    contents = {
        "small": b"a\n", "at 1000": noise(1000), "noise 100%.bin": noise(50_000), "ends": noise(9000) + b"\n",
        "breaks": b"\n" * 5000, "none": b"x" * 30_000, "mark": mark + noise(4000), "mark ends": mark + noise(4000) + b"\r\n",
        "two marks": mark * 2 + b"y" * 2000, "mark, one line": mark + b"z" * 2000, "é[1]{2}": noise(1001), "b=1": noise(3000) + mark,
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.sources.binaryFile.maxLength")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
        found = [tuple(r) for r in fs.file_hashes(spark, str(tmp_path)).collect()]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    (tmp_path / "packed.gz").write_bytes(noise(3000))
    also = dict(fs.file_hashes(spark, str(tmp_path)).collect())
    want = {f"file:{tmp_path}/{name}": hashlib.sha256(content).hexdigest() for name, content in contents.items()}
    assert sorted(found) == sorted(want.items())
    assert also == want | {f"file:{tmp_path}/packed.gz": hashlib.sha256((tmp_path / "packed.gz").read_bytes()).hexdigest()}
