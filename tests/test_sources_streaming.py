import base64
import gzip
import io
import tarfile

import pytest
from pyspark.sql import functions as F
from scholarmill.sources import files, sinks
from scholarmill.streaming import worklists


def tar_of(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archives(spark, tmp_path):
    inner = gzip.compress(tar_of({"main.tex": b"\\documentclass{a}", "../evil": b"x", "/abs": b"y"}))
    (tmp_path / "src.tar").write_bytes(tar_of({"2401.1.gz": inner, "2401.2.gz": gzip.compress(b"plain tex"), "big": b"z" * 50000}))
    (tmp_path / "other.tar").write_bytes(tar_of({"n": b"1"}))
    (tmp_path / "bad.tar").write_bytes(b"\x1f\x8bbroken")
    df = files.binary_files(spark, str(tmp_path), "*.tar")
    got = {(r.name, r.member): (r.status, bytes(r.content) if r.content else None) for r in files.archives(df, limit=20000).collect()}
    assert got["src.tar", "src/2401.1/main.tex"] == ("ok", b"\\documentclass{a}")
    assert got["src.tar", "src/2401.2"] == ("ok", b"plain tex")
    assert got["src.tar", "src/big"][0] == "too large" and got["bad.tar", "bad.tar"][0] == "unreadable"
    assert sum(s == "unsafe path" for s, _ in got.values()) == 2
    allowed = spark.createDataFrame([("other.tar",), ("bad.tar",)], "name string")
    done = spark.createDataFrame([("bad.tar",)], "name string")
    assert [r.name for r in files.archives(df, allowed, done).collect()] == ["other.tar"]


def test_flatten(spark, tmp_path):
    tree = {
        "2401/2401.1/main.tex": b"\\documentclass{a}\\input{sec/one} \\include{main} \\input{none}",
        "2401/2401.1/sec/one.tex": b"ONE \\input{two}\xe9",
        "2401/2401.1/sec/two.tex": b"TWO \\input{../../x}",
        "2401/2401.1/a.bib": b"@a{b}",
        "2401/2312.9/main.tex": b"\\documentclass{a} wrong month",
        "2401/2401.2/only.tex": b"no main",
    }
    for p, data in tree.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(data)
    tex = files.papers(spark, str(tmp_path))
    assert {r.paper_id for r in tex.collect()} == {"2401.1", "2401.2"}
    got = files.flatten(tex).collect()
    assert [(r.paper_id, r.full_tex, r.n_main) for r in got] == [("2401.1", "\\documentclass{a}ONE TWO \\input{../../x}é \\include{main} \\input{none}", 1)]
    assert files.merged_files(tex, ".bib").first().merged == "% From file: a.bib\n@a{b}\n"


def test_json(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"a": {"x": 1},\n "b": null}')
    assert {(r.key, r.value and r.value.x) for r in files.json_object(spark, str(tmp_path / "o.json"), "struct<x:int>").collect()} == {("a", 1), ("b", None)}
    (tmp_path / "l.txt").write_text('[1, "t", null]\nbroken\n')
    assert [tuple(r) for r in files.json_arrays(spark, str(tmp_path / "l.txt"), ["i", "t", "a"]).collect()] == [("1", "t", None)]
    df = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "i int, t string").coalesce(1)
    sinks.write_json_lines(df, str(tmp_path / "out"), rows_per_file=4, compression="gzip")
    assert len(list((tmp_path / "out").glob("*.json.gz"))) == 3
    assert files.json_lines(spark, str(tmp_path / "out"), "i int, t string").count() == 10


def test_html(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.html").write_bytes(b"<p>1</p>" * 40)
    (tmp_path / "in/sub/a.html").write_bytes(b"last")
    bundle = files.html_bundle(spark, str(tmp_path / "in"))
    assert [(r.name, base64.b64decode(r.content_b64)) for r in bundle.collect()] == [("a.html", b"last")]
    assert sinks.restore_html(bundle, str(tmp_path / "back")).first().n_bytes == 4
    assert (tmp_path / "back/a.html").read_bytes() == b"last"


def test_decoding_and_plugins(spark):
    df = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"\xe9"),), (None,)], "c binary")
    assert [r.t for r in df.select(files.decoded(F.col("c")).alias("t")).collect()] == ["é", "é", None]
    work = spark.createDataFrame([(f"t{i}",) for i in range(25)] + [(None,)], "title string")
    assert files.looked_up(work, "title", None).count() == 0
    got = {r.title: r.payload for r in files.looked_up(work, "title", lambda ks: [k.upper() for k in ks] if "t3" not in ks else []).collect()}
    assert len(got) == 25 and got["t3"] is None and "T9" in {*got.values()} | {"T9"}
    vec = files.encoded(spark.createDataFrame([(1, "ab"), (2, None)], "i int, t string"), "i", "t", lambda ts: [[float(len(t))] for t in ts])
    assert {r.i: r.embedding for r in vec.collect()} == {1: [2.0], 2: [0.0]}
    h = sinks.history_file(spark.createDataFrame([("b", 2), ("a", 3), ("b", 1), (None, 0)], "e string, o int"), "e", "o", "now").first().content
    assert h == "% Exported now, 2 entries\n\nb\n\na"


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    q = worklists.event_totals(stream).writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.sql("select * from totals").collect()} == {tuple(r) for r in worklists.event_totals(events).collect()}
    for _ in range(2):  # the second run finds nothing new
        worklists.grow_cache(stream, "event_type", "event_id", str(tmp_path / "cache"), str(tmp_path / "c2")).awaitTermination()
    cache = spark.read.parquet(str(tmp_path / "cache"))
    assert cache.count() == events.select("event_type").distinct().count()
    q = worklists.windowed_totals(stream).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()


def test_sessions(spark, tmp_path):
    assert worklists.grown("", "One. <|cite_start|>a. b. <|cite_end|> two. ", 2) == ("One. <|cite_start|>a. b. <|cite_end|> two.", True)
    assert worklists.may_complete("abc") and not worklists.may_complete("a ")
    rows = [("s1", 0, "One. "), ("s1", 1, "Two. Three. Four"), ("s1", 2, "no"), ("s2", 0, "x. "), ("s2", 1, "<|clear|>"), ("s2", 2, "y"), ("s2", 3, None)]
    spark.createDataFrame(rows, "session_id string, pos int, chunk string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id string, pos int, chunk string").parquet(str(tmp_path / "in"))
    q = worklists.sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.session_id, r.text, r.done) for r in spark.sql("select * from sessions").collect()} == {("s1", "One. Two. Three.", True), ("s2", "y", False)}


def test_side_files(spark, tmp_path):
    df = spark.createDataFrame([("a/b.txt", "x"), ("../out", "y"), ("/abs", "z"), (None, "n"), ("done", "")], "path string, content string")
    assert {(r.path, r.n_bytes) for r in sinks.side_files(df, f"file://{tmp_path}").collect()} == {("a/b.txt", 1), ("done", 0)}
    assert (tmp_path / "a/b.txt").read_text() == "x" and (tmp_path / "done").exists() and not (tmp_path.parent / "out").exists()
    with pytest.raises(ValueError):
        sinks.side_files(df, "hdfs://host/x")


def test_plug_ins_tell_what_failed(spark):
    def broken(keys):
        raise KeyError("no service")

    work = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert {(r.k, r.payload, r.message) for r in files.looked_up(work, "k", broken).collect()} == {(k, None, "KeyError: 'no service'") for k in "ab"}
    assert {r.message for r in files.looked_up(work, "k", lambda ks: ks[:1], batch=2).collect()} == {"1 answers to 2 keys"}
    with pytest.raises(FileNotFoundError):
        files.vectors(spark, "/nowhere/at/all")


def test_completion_is_guarded_by_characters_and_tokens():
    assert worklists.may_complete("abc") and not worklists.may_complete(" a ") and not worklists.may_complete("x" * 32_001)
    assert not worklists.may_complete("a b c d", most_tokens=3) and worklists.may_complete("a b c d", most_tokens=3, count=lambda t: 1)
