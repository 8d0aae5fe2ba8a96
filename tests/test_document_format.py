"""The file-writing data source, and word files of any size."""

import pytest
from pyspark.sql import functions as F

from florilex.sources import document_format, files, sinks


def listing(path):
    return {str(p.relative_to(path)): p.read_bytes() for p in path.rglob("*") if p.is_file() and "_written" not in str(p) and not p.name.endswith(".crc")}


def saved(df, path, mode="append"):
    df.sparkSession.dataSource.register(document_format.DocumentFiles)
    df.write.format("document_files").mode(mode).save(str(path))


def rows(spark, found, parts=3):
    return spark.createDataFrame(found, "name string, content string").select("name", F.col("content").cast("binary").alias("content")).repartition(parts)


def test_files_appear_together_and_stay(spark, tmp_path):
    saved(rows(spark, [("a/b.txt", "x"), ("é.txt", "é"), ("none", None)]), tmp_path / "out")
    assert listing(tmp_path / "out") == {"a/b.txt": b"x", "é.txt": "é".encode(), "none": b""}
    saved(rows(spark, [("a/c.txt", "y"), ("é.txt", "again")]), tmp_path / "out")
    assert listing(tmp_path / "out") == {"a/b.txt": b"x", "a/c.txt": b"y", "é.txt": b"again", "none": b""}
    saved(rows(spark, [("only", "1")]), tmp_path / "out", "overwrite")
    assert listing(tmp_path / "out") == {"only": b"1"}
    saved(rows(spark, []), tmp_path / "empty")
    assert listing(tmp_path / "empty") == {} and sinks.write_files(rows(spark, []), f"{tmp_path}/none", "name", "content").count() == 0


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    """A task fails after others have written; what was there before stays as it was."""
    saved(rows(spark, [("kept", "old")]), tmp_path / "out")
    bad = spark.range(40, numPartitions=8).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 39, F.raise_error(F.lit("broken row"))).otherwise(F.lit("x")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="broken row"):
        saved(bad, tmp_path / "out")
    assert listing(tmp_path / "out") == {"kept": b"old"} and not list((tmp_path / "out").glob("_staging*"))


@pytest.mark.parametrize("parts", [1, 4])
def test_two_rows_of_one_name_fail_the_job(spark, tmp_path, parts):
    twice = spark.range(8, numPartitions=parts).select(F.concat(F.lit("d/f"), F.col("id") % 7).alias("name"), F.lit("x").cast("binary").alias("content"))
    with pytest.raises(Exception, match="share names|two rows are called"):
        saved(twice, tmp_path / "out")
    assert listing(tmp_path / "out") == {}


@pytest.mark.parametrize("name", ["../x", "/x", "a//b", "", None, "_hidden"])
def test_names_stay_within_the_folder(spark, tmp_path, name):
    with pytest.raises(Exception, match="not a name"):
        saved(rows(spark, [(name, "x")]), tmp_path / "out")
    assert listing(tmp_path / "out") == {}


def test_a_folder_that_is_not_shared_fails(spark, tmp_path):
    writer = document_format.FileWriter(f"file:{tmp_path}/out", "j", False, False)
    (tmp_path / "out/_staging-j/_shared").unlink()
    with pytest.raises(ValueError, match="share"):
        writer.write(iter([]))
    writer.abort([])
    assert not list((tmp_path / "out").iterdir())


def test_attempts_that_do_not_count_are_left_out(tmp_path):
    writer = document_format.FileWriter(str(tmp_path), "j", False, False)
    stage = tmp_path / "_staging-j/files/d"
    stage.mkdir(parents=True)
    for tag, text in (("0-1", "failed"), ("0-2", "good"), ("1-3", "other")):
        (stage / f"{'x@y' if tag[0] == '0' else 'z'}@{tag}").write_text(text)
    writer.commit([document_format.Written("0-2", 1), document_format.Written("1-3", 1)])
    assert listing(tmp_path) == {"d/x@y": b"good", "d/z": b"other"}


def test_lines_of_files_that_are_split(spark, tmp_path):
    """Files of many splits, with blank lines, either line end, and none at the end: numbers are those of a walk."""
    want = set()
    for f in range(3):
        lines = [files.HEADER] + [f"{k}\tword{k} é\tNaR\to\to" if k % 5 else "" for k in range(f * 400 + 1)]
        (tmp_path / f"{f}_reuses.tsv").write_text(("\r\n" if f == 1 else "\n").join(lines))
        want |= {(f"{f}_reuses.tsv", k, x.split("\t")[1]) for k, x in enumerate([x for x in lines[1:] if x])}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1000)
    try:
        found = files.word_files(spark, str(tmp_path))
        got = {(x.source_file, x.word_index, x.word) for x in found.collect()}
        assert files.numbered_lines(spark, str(tmp_path), "*.tsv").rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want and "wholetext" not in found._jdf.queryExecution().toString().lower()


def test_bad_word_files_are_named(spark, tmp_path):
    good = "1\tx\tNaR\to\to"
    for name, lines in {"a": [good, good], "long": [good, good + "\tmore"], "head": None, "short": ["1\tx", good], "quoted": ['1\t"a\tb ""c"""\tNaR\to\to'], "b/none": []}.items():
        path = tmp_path / f"{name}_reuses.tsv"
        path.parent.mkdir(exist_ok=True)
        path.write_text("\n".join([files.HEADER, *lines]) if lines is not None else f"word\tline\n{good}\n")
    bad = {(x.path.rpartition("/")[2], x.at, x.kind) for x in files.bad_word_files(spark, str(tmp_path)).collect()}
    assert bad == {("long_reuses.tsv", 2, "long"), ("head_reuses.tsv", 0, "header"), ("short_reuses.tsv", 1, "short")}
    got = sorted((x.source_file, x.word_index, x.word, x.label) for x in files.word_files(spark, str(tmp_path)).collect())
    assert got == [("a_reuses.tsv", 0, "x", "NaR"), ("a_reuses.tsv", 1, "x", "NaR"), ("quoted_reuses.tsv", 0, 'a\tb "c"', "NaR"), ("short_reuses.tsv", 0, "x", ""), ("short_reuses.tsv", 1, "x", "NaR")]
    assert {x.source_file for x in files.word_files(spark, str(tmp_path), recursive=False).collect()} <= {"a_reuses.tsv", "quoted_reuses.tsv", "short_reuses.tsv"}


def test_the_driver_keeps_no_list_of_files(spark, tmp_path):
    """The same files as by Spark's own source, whatever their names and folders, and none of them in the plan."""
    names = ["a.xml", "b.XML", "c.txt", "sub/d e.xml", "sub/deep/é%20.xml", "_hidden/x.xml", ".y.xml", "_z.xml", "_k=2.xml", "empty.xml", "a.xml.bak", "sub/_w/v.xml"]
    for x in names:
        (tmp_path / x).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / x).write_bytes(b"" if x == "empty.xml" else x.encode())
    for path in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}/"):
        for pattern, deep in (("*.{xml,XML}", True), ("*.xml", False), ("*.none", True)):
            own = spark.read.format("binaryFile").option("recursiveFileLookup", str(deep).lower()).option("pathGlobFilter", pattern).load(path).select("path", "content")
            found = files.binary_files(spark, path, pattern, deep)
            assert sorted(map(tuple, found.collect())) == sorted(map(tuple, own.collect()))
            assert not found.inputFiles() and found.schema.names == own.schema.names
    assert files.binary_files(spark, f"{tmp_path}/sub*", "*.xml").count() == 2 and files.binary_files(spark, f"{tmp_path}/a.xml", "*.xml").count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.binary_files(spark, f"{tmp_path}/missing", "*.xml")
