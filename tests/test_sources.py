"""Readers, sinks and the file stream."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kipimo.plans import source_queries, stage, views
from kipimo.sources import readers, writers
from kipimo.streaming import scoring as stream


def _dump(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(content, ensure_ascii=False, indent=2), encoding="utf-8")
    return str(path)


def test_manifests(spark, tmp_path):
    pair = {"id": "p", "category": "c", "text_a": "é", "text_b": "b", "expected_relation": "similar"}
    path = _dump(tmp_path / "pairs.json", [pair, pair | {"id": "q"}])
    rows = readers.read_pairs(spark, path, multi_line=True).collect()
    assert [r.asDict() for r in rows] == [pair, pair | {"id": "q"}]
    speech = {"id": "s", "category": "c", "audio": "a.wav", "reference": "r"}
    lines = tmp_path / "speech.jsonl"
    lines.write_text("\n".join(json.dumps(speech | {"id": str(k)}) for k in range(3)))
    assert readers.read_speech_manifest(spark, str(lines), multi_line=False).count() == 3


def test_result_records(spark, tmp_path):
    score = {"similarity": 0.5, "inference_time_ms": 1.0, "embedding_dimension": 8, "device": "cpu"}
    record = {"id": "p", "category": "c", "models": {"org/model-a": score, "org/model-b": score}}
    path = _dump(tmp_path / "r.json", {"experiment": "x", "records": [record, record]})
    rows = readers.read_result_records(spark, path, multi_line=True).collect()
    assert len(rows) == 2 and rows[0]["models"]["org/model-b"]["embedding_dimension"] == 8
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_result_records(spark, str(tmp_path / "absent.json"))


def _save(root, split, label, name, array):
    folder = root / split / label
    folder.mkdir(parents=True, exist_ok=True)
    np.save(folder / name, array)


def test_clip_directory(spark, tmp_path):
    good = np.arange(12, dtype=np.float32).reshape(2, 6)
    _save(tmp_path, "train", "my", "b.npy", good)
    _save(tmp_path, "test", "is", "a.npy", good * 2)
    clips = readers.read_clips(spark, str(tmp_path), width=6).orderBy("label").collect()
    assert [(c["split"], c["label"], c["file"]) for c in clips] == [("test", "is", "a.npy"), ("train", "my", "b.npy")]
    assert clips[1]["frames"] == good.tolist()
    _save(tmp_path, "train", "my", "bad.npy", good[:, :5])
    _save(tmp_path, "train", "my", "flat.npy", good[0])
    _save(tmp_path, "train", "my", "nan.npy", good * np.nan)
    loose = readers.read_clips(spark, str(tmp_path), width=6, strict=False)
    reasons = {r["file"]: r["reason"] for r in loose.collect()}
    assert reasons == {"a.npy": None, "b.npy": None, "bad.npy": "width", "flat.npy": "dimensions", "nan.npy": "not_finite"}
    with pytest.raises(Exception, match="unusable clip"):
        readers.read_clips(spark, str(tmp_path), width=6).collect()


def test_assets(spark, tmp_path):
    for name in ("b.MP4", "a.mov", "c.txt", "sub/d.avi"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"12345")
    found = readers.list_assets(spark, str(tmp_path)).collect()
    assert [r["path"].rsplit("/", 1)[1] for r in found] == ["a.mov", "b.MP4", "d.avi"]
    assert {r["length"] for r in found} == {5}
    with pytest.raises(FileNotFoundError):
        readers.list_assets(spark, str(tmp_path), suffixes=("wav",))


def test_report_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("é", 1 / 3, None)], "name string, x double, y double")
    writers.write_report(df, str(tmp_path / "report"))
    row = spark.read.json(str(tmp_path / "report")).first()
    assert (row["name"], row["x"], row["y"]) == ("é", 0.333333, None)
    pretty = json.loads(writers.report_json(df).first()["value"])
    assert pretty == {"name": "é", "x": 0.333333, "y": None}
    other = spark.createDataFrame([(1, 2.0000004), (2, None)], "k int, v double")
    writers.write_nested_report({"name": "é", "n": 2}, {"a": df, "b": other}, str(tmp_path / "nested"))
    (part,) = (tmp_path / "nested").glob("part-*")
    text = part.read_text(encoding="utf-8")
    assert '\n  "' in text
    assert json.loads(text) == {
        "name": "é",
        "n": 2,
        "a": [{"name": "é", "x": 0.333333, "y": None}],
        "b": [{"k": 1, "v": 2.0}, {"k": 2, "v": None}],
    }
    text = spark.createDataFrame([('a "quoted", text', 1)], "t string, n int")
    writers.write_csv(text, str(tmp_path / "csv"))
    back = spark.read.schema(text.schema).option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert [tuple(r) for r in back.collect()] == [('a "quoted", text', 1)]


def test_clip_table_sink(spark, tmp_path):
    rows = [("my", "one.npy", [[1.0, 2.0], [3.0, 4.0]])]
    clips = spark.createDataFrame(rows, "label string, file string, sequence array<array<float>>")
    writers.write_clip_table(clips, str(tmp_path / "clips"))
    row = spark.read.parquet(str(tmp_path / "clips")).first()
    assert (row["label"], row["name"], row["frames"][1]) == ("my", "one_2x2", [3.0, 4.0])


_CLIPS = "label string, file string, sequence array<array<float>>"


def _tree(path):
    """Files where readers look: a task that outlives its failed job may leave some in a hidden folder."""
    found = (p.relative_to(path) for p in path.rglob("*") if p.is_file() and p.name != "_SUCCESS")
    return sorted(str(p) for p in found if not p.parts[0].startswith("."))


def test_clip_files_round_trip(spark, tmp_path):
    rows = [("c" + str(i % 3), f"clip_{i}.npy", [[float(i), 2.0], [3.0, -i / 7]][: 1 + i % 2]) for i in range(40)]
    clips = spark.createDataFrame(rows, _CLIPS).repartition(5)
    path = tmp_path / "out"
    writers.write_clips(clips, str(path))
    assert _tree(path) == sorted(f"{c}/{f[:-4]}_{len(s)}x2.npy" for c, f, s in rows)
    assert np.load(path / "c1/clip_1_2x2.npy").dtype == np.float32
    found = readers.read_clips(spark, f"file://{path}", width=2).collect()
    expected = {(c, f"{f[:-4]}_{len(s)}x2.npy"): np.float32(s).tolist() for c, f, s in rows}
    assert {(r.label, r.file): r.frames for r in found} == expected and {r.split for r in found} == {None}
    with pytest.raises(FileExistsError):
        writers.write_clips(clips, str(path))
    writers.write_clips(clips.filter("label = 'c2'"), str(path), mode="overwrite")
    assert {p.split("/")[0] for p in _tree(path)} == {"c2"}
    writers.write_clips(clips.filter("label = 'c0'"), str(path), mode="append")
    assert {p.split("/")[0] for p in _tree(path)} == {"c0", "c2"}


@pytest.mark.parametrize("bad", [None, [[1.0], [1.0, 2.0]], "../up.npy", "two names"])
def test_a_failed_write_leaves_no_file(spark, tmp_path, bad):
    rows = [("a", f"{i}.npy", [[1.0, 2.0]]) for i in range(30)]
    name = {"two names": "0.npy", "../up.npy": "../up.npy"}.get(bad if isinstance(bad, str) else "", "x.npy")
    rows.append(("a", name, [[1.0, 2.0]] if isinstance(bad, str) else bad))
    path = tmp_path / "out"
    with pytest.raises(Exception):
        writers.write_clips(spark.createDataFrame(rows, _CLIPS).repartition(4), str(path))
    assert not path.exists() or _tree(path) == []
    assert not path.exists() or readers.read_clips(spark, str(path), width=2).collect() == []
    assert not list(tmp_path.glob("*.npy"))


def test_clip_partitions_follow_bytes(spark, tmp_path):
    from kipimo.sources.clip_files import FORMAT, registered

    for i in range(20):
        _save(tmp_path, "train", "hot", f"{i:02}.npy", np.ones((50, 4), np.float32))
    _save(tmp_path, "test", "cold", "x.npy", np.ones((1, 4), np.float32))
    np.save(tmp_path / "top.npy", np.ones((2, 4)))
    (tmp_path / "train/hot/broken.npy").write_bytes(b"no array")
    (tmp_path / "train/hot/notes.txt").write_text("x")
    np.save(tmp_path / "train/hot/text.npy", np.array([["a", "b"]]))
    np.save(tmp_path / "train/hot/none.npy", np.ones((0, 4), np.float32))
    read = registered(spark).read.format(FORMAT).option("width", 4).option("partition_bytes", 2000)
    clips = read.load(str(tmp_path))
    assert clips.rdd.getNumPartitions() >= 12
    rows = clips.collect()
    assert len(rows) == 25 and {r.bytes for r in rows if r.file == "00.npy"} == {928}
    assert {r.file: r.reason for r in rows if r.reason} == {"broken.npy": "unreadable", "text.npy": "unreadable", "none.npy": "empty"}
    assert {(r.split, r.label) for r in rows} == {("train", "hot"), ("test", "cold"), (None, None)}
    with pytest.raises(Exception, match="no folder"):
        readers.read_clips(spark, str(tmp_path / "absent")).collect()
    (tmp_path / "bare").mkdir()
    assert readers.read_clips(spark, str(tmp_path / "bare")).collect() == []


def test_listing_by_levels(spark, tmp_path):
    for name in ("a/b/c/deep.MOV", "a/b/x.mp4", "a/.hidden/y.mp4", "a/_tmp/y.mp4", "noext", "z.avi.txt", "ä ö/ü.AVI"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"123")
    found = readers.list_assets(spark, f"file://{tmp_path}".replace(" ", "%20")).collect()
    assert [(r.path[len(str(tmp_path)) + 1 :], r.length, r.suffix) for r in found] == [
        ("a/b/c/deep.MOV", 3, "mov"), ("a/b/x.mp4", 3, "mp4"), ("ä ö/ü.AVI", 3, "avi"),
    ]


def test_decoded_files_of_any_store(spark, tmp_path):
    _save(tmp_path, "train", "my", "b.npy", np.ones((2, 6), np.float32))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    (row,) = readers.decode_clips(files, width=6).collect()
    assert (row.split, row.label, row.file, len(row.frames)) == ("train", "my", "b.npy", 2)


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    first = [("u1", "c", "m", "Habari, yako?", "habari ya")]
    second = [("u2", "c", "m", "Moja mbili", "moja"), ("u3", "c", "m", "", "x")]
    frames = [spark.createDataFrame(rows, stream.UTTERANCE) for rows in (first, second)]
    for df in frames:
        df.write.mode("append").json(source)
        stream.score_stream(spark, source, sink, state)
    columns = ["id", "wer", "cer"]
    streamed = {tuple(r) for r in spark.read.parquet(sink).select(*columns).collect()}
    batch = stream.score_utterance_rows(frames[0].unionByName(frames[1])).select(*columns)
    assert streamed == {tuple(r) for r in batch.collect()}
    assert ("u2", 0.5, 0.6) in streamed and ("u3", None, None) in streamed


def test_streamed_utterances_take_little_disk(spark, data, tmp_path, monkeypatch):
    """Landed files, sink and state together stay within four times the input."""
    monkeypatch.setattr(source_queries, "scratch_path", lambda _, name: str(tmp_path / name))
    scored = source_queries.score_stream(spark, data)
    landed = spark.read.schema(stream.UTTERANCE).json(str(tmp_path / "stream/in"))
    assert scored.count() == landed.count() == views.utterances(spark, data).count()
    taken = sum(p.stat().st_size for p in (tmp_path / "stream").rglob("*") if p.is_file())
    assert taken <= 4 * os.path.getsize(f"{data}/documents.parquet")


def test_landed_files_are_cut(spark, data, tmp_path, monkeypatch):
    """A compressed file is not split, so none holds more than so many rows."""
    monkeypatch.setattr(source_queries, "scratch_path", lambda _, name: str(tmp_path / name))
    monkeypatch.setitem(source_queries._LANDED, "maxRecordsPerFile", 1000)
    n = source_queries.score_stream(spark, data).count()
    files = spark.read.schema(stream.UTTERANCE).json(str(tmp_path / "stream/in")).groupBy(F.input_file_name())
    rows = [r["count"] for r in files.count().collect()]
    assert sum(rows) == n > 1000 >= max(rows)


def test_staging(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2.0)
    kept = stage.staged(df)
    assert kept.schema.names == ["id", "x"] and kept.count() == 10
    assert "Range" not in kept._jdf.queryExecution().toString()


def test_compact_inputs_are_widened(spark):
    assert stage.widened(spark.range(10).coalesce(1)).rdd.getNumPartitions() == 1
    spark.conf.set(stage.PARTITIONS, "5")
    try:
        assert stage.widened(spark.range(10).coalesce(1)).rdd.getNumPartitions() == 5
    finally:
        spark.conf.unset(stage.PARTITIONS)


def test_staged_tables_can_be_cleared(spark):
    kept = stage.staged(spark.range(3))
    assert kept.count() == 3
    assert stage.clear_staged(spark)
    assert stage.staged(spark.range(2)).count() == 2


def test_leaked_content(spark):
    from kipimo.operators.tables import exclude_leaked, leaked_counts

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a"), (5, "c")], "id long, content string")
    other = spark.createDataFrame([("a",), ("a",), (None,), ("z",)], "content string")
    assert sorted(r.id for r in exclude_leaked(rows, other).collect()) == [2, 3, 5]
    assert tuple(leaked_counts(rows, other).first()) == (5, 2, 1)
    assert tuple(leaked_counts(rows.limit(0), other).first()) == (0, 0, 0)
