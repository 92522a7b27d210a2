"""Files: numbered lines over several splits, flat token files by byte ranges, datasets with manifests, reports."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.sources import files, lines, tokens


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_over_splits(spark, tmp_path, small_splits):
    told = [f"line {i} " + "x" * (i % 37) for i in range(300)]
    (tmp_path / "a.txt").write_text("\n".join(told))
    (tmp_path / "b.txt").write_text("one\n\nthree\n" + "y" * 900 + "\nfive\n")
    (tmp_path / "empty.txt").write_text("")
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    found = {}
    for r in lines.read_lines(spark, str(tmp_path)).collect():
        found.setdefault(r["file"].rsplit("/", 1)[1], {})[r["line"]] = r["value"]
    assert found["a.txt"] == dict(enumerate(told, 1))
    assert found["b.txt"] == {1: "one", 2: "", 3: "three", 4: "y" * 900, 5: "five"}
    assert set(found) == {"a.txt", "b.txt"}


def test_jsonl_names_the_line(spark, tmp_path, small_splits):
    good = [{"step": i, "loss": 1.0 / (i + 1), "lr": 0.1, "grad_norm": None, "tokens": i * 10} for i in range(60)]
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, good)) + "\n\n")
    rows = files.read_jsonl(spark, str(tmp_path / "log.jsonl"), files.LOG, order="step")
    assert sorted((r["step"], r["tokens"]) for r in rows.collect()) == [(i, 10 * i) for i in range(60)]
    broken = [json.dumps(x) for x in good]
    broken[41] = '{"step": 41, "loss": "much"'
    (tmp_path / "bad.jsonl").write_text("\n".join(broken))
    with pytest.raises(Exception, match="bad.jsonl line 42: bad line"):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), files.LOG).collect()
    (tmp_path / "blank.jsonl").write_text(json.dumps(good[0]) + "\n\n" + json.dumps(good[1]))
    with pytest.raises(Exception, match="line 2: bad line"):
        files.read_jsonl(spark, str(tmp_path / "blank.jsonl"), files.LOG, skip_blank=False).collect()
    back = good[:30] + good[20:]
    (tmp_path / "back.jsonl").write_text("\n".join(map(json.dumps, back)))
    with pytest.raises(Exception, match="back.jsonl line 31: step goes back"):
        files.read_jsonl(spark, str(tmp_path / "back.jsonl"), files.LOG, order="step").collect()


def test_flat_tokens(spark, tmp_path):
    rng = np.random.default_rng(4)
    given = [(i, [int(x) for x in rng.integers(0, 65536, rng.integers(0, 60))]) for i in range(200)] + [(200, None), (201, [])]
    flat = [x for _, ids in given for x in ids or []]
    rows = spark.createDataFrame(given, "k int, ids array<int>").repartition(7)
    path = f"file://{tmp_path}/t"
    assert tokens.write_tokens(rows, "ids", ["k"], path, 65536) == len(flat)
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "t").glob("*.bin")))
    assert np.frombuffer(whole, "<u2").tolist() == flat
    # one file longer than a split: several tasks, blocks that never straddle one
    (tmp_path / "one.bin").write_bytes(whole)
    back = tokens.read_tokens(spark, f"file://{tmp_path}/one.bin", block=16, split=512)
    assert back.rdd.getNumPartitions() == -(-len(whole) // 512) > 5
    found = sorted((r["pos"], r["ids"]) for r in back.collect())
    assert [p for p, _ in found] == list(range(0, len(flat), 16)) and [x for _, ids in found for x in ids] == flat
    with pytest.raises(Exception, match="outside the vocabulary of 100"):
        tokens.read_tokens(spark, path, vocab_size=100).collect()
    with pytest.raises(Exception, match="outside the vocabulary of 50"):
        tokens.write_tokens(rows, "ids", ["k"], f"file://{tmp_path}/u", 50)
    assert not list((tmp_path / "u").glob("*"))  # an aborted job leaves nothing
    with pytest.raises(Exception, match="16 bits"):
        tokens.write_tokens(rows, "ids", ["k"], f"file://{tmp_path}/u", 70_000)
    with pytest.raises(Exception, match="holds token files"):
        tokens.write_tokens(rows, "ids", ["k"], path, 65536)
    assert tokens.write_tokens(rows.where("k < 3"), "ids", ["k"], path, 65536, "overwrite") == sum(len(x) for _, x in given[:3])
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="two bytes a token"):
        tokens.read_tokens(spark, f"file://{tmp_path}/odd.bin").collect()


def test_split_token_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "abcdefghij"), (2, "klmnopqrst")], "k int, text string")
    assert tokens.write_split(rows, "text", ["k"], None, f"file://{tmp_path}/s", 0.2, 256) == {"train": 16, "val": 4}
    back = lambda side: bytes(x for r in tokens.read_tokens(spark, f"file://{tmp_path}/s/{side}").orderBy("file", "pos").collect() for x in r["ids"])
    assert (back("train"), back("val")) == (b"abcdefghklmnopqr", b"ijst")


def test_dataset_and_manifest(spark, tmp_path):
    from quillon.operators.corpus import split_digest

    rows = spark.createDataFrame([(f"e{i}", "train" if i % 3 else "test", f"note {i}") for i in range(20)], "example_id string, split string, note string")
    line = F.concat_ws("|", "example_id", "note")
    path = f"file://{tmp_path}/d"
    files.write_dataset(rows, path, 7, split_digest(rows, "split", "example_id", line))
    schema = "example_id string, note string, split string"
    assert sorted(r["example_id"] for r in files.read_dataset(spark, path, schema, line, "example_id").collect()) == sorted(f"e{i}" for i in range(20))
    for part in (tmp_path / "d/examples/split=test").glob("*.json"):
        (part.parent / f".{part.name}.crc").unlink()
        part.write_text(part.read_text().replace("note 0", "note zero"))
    with pytest.raises(ValueError, match="test"):
        files.read_dataset(spark, path, schema, line, "example_id")


def test_reports(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"name": "b", "rate": 0.5}, indent=2))
    (tmp_path / "a.json").write_text(json.dumps({"name": "a", "rate": 1.0}))
    (tmp_path / "c.json").write_text("{not json")
    found = files.read_reports(spark, f"file://{tmp_path}/*.json", "name string, rate double")
    assert sorted(r["name"] for r in found.collect()) == ["a", "b"]
    table = files.markdown_table(found.select("name", "rate"), ["name"])
    assert table == "| name | rate |\n|---|---|\n| a | 1.0000 |\n| b | 0.5000 |\n"
    assert files.stable_json({"b": 1, "a": [2]}) == files.stable_json({"a": [2], "b": 1}) == '{\n  "a": [\n    2\n  ],\n  "b": 1\n}\n'
