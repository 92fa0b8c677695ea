"""Reading, writing, validating, and incremental runs against batch runs."""

import base64
import os

import pytest
from pyspark.sql import functions as F

import corpusguard as cg
from corpusguard.session import shared_dir
from corpusguard.sources import readers
from corpusguard.streaming import incremental as inc


def test_tree_and_tables(spark, corpus_of, tmp_path):
    root = tmp_path / "tree"
    (root / "src" / "deep").mkdir(parents=True)
    (root / "src" / "a.js").write_text("eval(x)\n", encoding="utf-8")
    (root / "src" / "deep" / "b.py").write_bytes(b"exec(y)\n\xff\n")
    tree = cg.read_tree(spark, str(root), "r")
    rows = {r.file: r.content for r in tree.collect()}
    assert rows == {"src/a.js": "eval(x)\n", "src/deep/b.py": "exec(y)\n�\n"}
    assert cg.build_findings(tree).count() == 2
    table = str(tmp_path / "corpus")
    tree.write.parquet(table)
    assert cg.read_corpus(spark, table).count() == 2


def test_ignored_files_of_a_tree_are_never_read(spark, tmp_path):
    root = tmp_path / "tree"
    kept = {"src/a.js": "eval(x)\n", "src/Build.d/ü b.py": "exec(y)\n", "lib/c.TS": "t\n"}
    others = ["node_modules/pkg/d.js", "src/dist/e.js", "Vendor/f.php", "docs/g.md", "src/h.min", "big.bin"]
    for name in (*kept, *others):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(kept.get(name, "x" * 1000), encoding="utf-8")
    tree = cg.read_tree(spark, str(root), "r", analyzable_only=True)
    everything = cg.read_tree(spark, str(root), "r")
    for name in others:  # they were listed; reading one now would fail
        (root / name).unlink()
    assert {r.file: r.content for r in tree.collect()} == kept
    with pytest.raises(Exception, match="FILE_NOT_EXIST|FileNotFound|does not exist"):
        everything.collect()


def test_results_round_trip(spark, corpus_of, tmp_path):
    result = cg.analyze(corpus_of(("a.js", "eval(x)"), ("b.py", "exec(y)")))
    paths = cg.write_results(result, str(tmp_path / "out"))
    assert [os.path.basename(p) for p in paths] == ["findings", "metadata", "modules", "repos", "hotspots", "module_files", "payloads"]
    assert spark.read.parquet(paths[4]).count() == 2 and spark.read.parquet(paths[5]).count() == 2
    assert '"findingCount":2' in spark.read.parquet(paths[6]).first().payload
    back = spark.read.parquet(paths[0])
    assert sorted(r.id for r in back.collect()) == sorted(r.id for r in result.findings.collect())
    assert os.path.isdir(os.path.join(paths[0], "repo=r"))


def test_decode(spark):
    chunked = base64.b64encode("héllo\nworld".encode() * 20).decode()
    chunked = "\n".join(chunked[i:i + 60] for i in range(0, len(chunked), 60)) + "\n"
    rows = spark.createDataFrame([(1, chunked, "base64"), (2, "abc", "none"), (3, None, "base64"), (4, "/w==", "base64")], "n int, content string, encoding string")
    got = {r.n: (r.content, r.error) for r in readers.decode_content(rows).collect()}
    assert got[1] == ("héllo\nworld" * 20, None) and got[4] == ("�", None)
    assert got[2] == got[3] == (None, readers.NOT_DECODABLE)


@pytest.mark.parametrize("url,expected", [
    ("https://github.com/a/b", ("a", "b")), ("https://www.GITHUB.com/a/b.git", ("a", "b")), ("https://github.com/a/", ("a", "")),
    ("https://github.com/a", None), ("https://example.com/a/b", None), ("nonsense", None), ("https://github.com/a/b/tree/x", ("a", "b"))])
def test_repository_urls(spark, url, expected):
    row = readers.with_repo(spark.createDataFrame([(url,)], "url string")).first()
    assert (row.owner, row.repo_name) == (expected or (None, None))


def test_requests_need_url_then_path(spark):
    rows = spark.createDataFrame([("", "p"), ("https://github.com/a/b", " "), ("https://x.org/a/b", "p"), (" https://github.com/a/b ", "p")], "url string, path string")
    checked = readers.check_requests(rows)
    assert [r.reason for r in checked.collect()] == [readers.NO_URL, readers.NO_PATH, readers.BAD_URL, None]
    assert readers.accepted(checked).count() == 1 and readers.rejected(checked).count() == 3


def test_empty_content_is_kept(spark, corpus_of):
    result = cg.analyze(corpus_of(("a.js", ""), ("  ", "x"), ("b.js", None)))
    assert [(r.file, r.metrics.lines_of_code) for r in result.metadata.collect()] == [("a.js", 0)]


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark).startswith("file:" + os.path.dirname(spark.conf.get("spark.checkpoint.dir"))) or \
        os.path.basename(spark.conf.get("spark.checkpoint.dir")) in shared_dir(spark)


def test_stream_in_batches_equals_batch(spark, corpus_of, tmp_path):
    first = corpus_of(("a.js", "eval(x)\ntoken = 'abcdefgh1'"), ("b.py", "exec(y)"), ("c.md", "eval(x)"))
    second = spark.createDataFrame([("r", "a.js", "token = 'abcdefgh1'", 10), ("r", "d.php", "system($x)", 11)], readers.CORPUS_SCHEMA)
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    first.coalesce(1).write.mode("append").parquet(source)
    inc.run(inc.log_batches(inc.read_corpus_stream(spark, source), log, str(tmp_path / "marks")))
    second.coalesce(1).write.mode("append").parquet(source)
    inc.run(inc.log_batches(inc.read_corpus_stream(spark, source), log, str(tmp_path / "marks")))

    merged = inc.merged_findings(spark, log)
    ids = sorted(r.id for r in merged.collect())
    assert ids == sorted({r.id for c in (first, second) for r in cg.build_findings(c).collect()})
    assert any("a.js:1:JS/TS Dynamic" in i for i in ids)     # vanished findings stay
    profiles = {r.file: r for r in inc.merged_profiles(spark, log).collect()}
    assert profiles["a.js"].version == 1 and profiles["a.js"].position.version == 0 and profiles["a.js"].lines_of_code == 1
    total = inc.summary(spark, log).first()
    assert (total.file_count, total.scanned_file_count, total.finding_count) == (4, 3, len(ids))
    compacted = str(tmp_path / "compacted")
    for name, key in (("findings", ["repo", "id"]), ("profiles", ["repo", "file"]), ("inputs", ["repo", "file"])):
        inc.compact(spark, log, name, key, compacted)
    was = {r.id: (r.version, r.position) for r in merged.collect()}
    assert {r.id: (r.version, r.position) for r in inc.merged_findings(spark, compacted).collect()} == was

    # a later run into the compacted log keeps what was there, its places, and wins where both have a file
    later, source = spark.createDataFrame([("r", "a.js", "x\ny\nz", 3), ("r", "e.js", "eval(q)", 4)], readers.CORPUS_SCHEMA), str(tmp_path / "in2")
    later.coalesce(1).write.parquet(source)
    counts = []
    inc.run(inc.log_batches(inc.read_corpus_stream(spark, source), compacted, str(tmp_path / "marks2"), epoch=1,
                            on_batch=lambda s, path: counts.append(inc.summary(s, path).first().file_count)))
    rows = {r.id: r for r in inc.merged_findings(spark, compacted).collect()}
    assert set(was) < set(rows) and len(rows) == len(was) + 1
    assert all(rows[i].position == p for i, (_, p) in was.items())
    newest = {r.file: r for r in inc.merged_profiles(spark, compacted).collect()}
    assert newest["a.js"].lines_of_code == 3 and newest["a.js"].version == inc.EPOCH and newest["a.js"].position.version == 0
    assert counts == [5]


def test_streaming_scan_and_state(spark, corpus_of, tmp_path):
    source = str(tmp_path / "in")
    corpus = corpus_of(("a.js", "eval(x)"), ("b.py", "exec(y)"))
    corpus.write.parquet(source)
    out = str(tmp_path / "out")
    inc.run(inc.write_findings(inc.read_corpus_stream(spark, source), out, str(tmp_path / "marks")))
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == sorted(r.id for r in cg.build_findings(corpus).collect())
    state = str(tmp_path / "state")
    writer = (inc.latest_files(inc.read_corpus_stream(spark, source)).writeStream.outputMode("update")
              .option("checkpointLocation", str(tmp_path / "marks2")).trigger(availableNow=True)
              .foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{state}/batch={i}")))
    inc.run(writer)
    rows = spark.read.parquet(state).orderBy("file").select("file", "length", "first_seq").collect()
    assert [(r.file, r.length, r.first_seq) for r in rows] == [("a.js", 7, 0), ("b.py", 7, 1)]


def test_detection_rate_and_scores(spark):
    from corpusguard.operators import metrics as Q
    items = spark.createDataFrame([(i, 100) for i in range(10)], "k int, loc int")
    alerts = spark.createDataFrame([(0,), (0,), (1,), (2,)], "k int")
    truth = spark.createDataFrame([(i, i in (0, 1, 5, 6)) for i in range(8)], "k int, vulnerable boolean")
    out = Q.outcomes(items, alerts, truth, "k")
    row = Q.scores(out).first()
    assert (row.true_alerts, row.missed, row.false_alerts, row.precision, row.recall) == (2, 2, 1, 0.666667, 0.5)
    assert Q.false_alert_density(out).first().per_thousand_lines == 1.25
