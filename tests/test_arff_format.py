"""ARFF as a data source: ranges of one file, foreign files, commits."""

import random

import pytest
from pyspark.sql import functions as F

from lodestream.sources import arff, arff_format

FOREIGN = """% a comment, with 'commas', in it
@relation 'some data'
@attribute 'a b' REAL
@attribute kind {x, 'y z', '?'}
@attribute note string
@attribute cls {yes,no}

@data
1.5,x,'it\\'s, so',yes
% between
?,'?',?,no

-2e3,'y z','two\\nlines \\\\n',yes"""


@pytest.fixture(scope="module")
def load(spark):
    arff_format.register(spark)

    def of(path, **options):
        return spark.read.format("arff").options(**options).load(str(path))

    return of


@pytest.mark.parametrize("split", [7, 40, 300, 1 << 20])
def test_foreign_file_in_ranges(load, tmp_path, split):
    (tmp_path / "d.arff").write_text(FOREIGN)
    df = load(tmp_path / "d.arff", split_bytes=split)
    want = [(-2000.0, "y z", "two\nlines \\n", "yes"), (1.5, "x", "it's, so", "yes"), (None, "?", None, "no")]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    assert df.schema["kind"].metadata == {arff.DOMAIN: ["x", "y z", "?"]} and arff.class_column(df) == "cls"
    assert df.rdd.getNumPartitions() == -(-len(FOREIGN) // split)


@pytest.mark.parametrize("piece", [16, 1 << 20])
def test_every_cut_of_a_file_gives_each_line_once(tmp_path, monkeypatch, piece):
    monkeypatch.setattr(arff_format, "PIECE", piece)
    rng = random.Random(1)
    for ends in ("", "\n"):
        lines = ["".join(rng.choice("ab,") for _ in range(rng.randrange(40))) for _ in range(50)] + ["end"]
        head = "@relation r\n@attribute x string\n@data\n"
        (tmp_path / "c.arff").write_text(head + "\n".join(lines) + ends)
        folder = arff_format.Folder(str(tmp_path / "c.arff"))
        size = folder.files()[0].size
        for split in (1, 2, 5, 17, 64, 1000, size):
            pieces = []
            for at in range(0, size, split):
                part = arff_format.Range(folder.path, at, min(at + split, size))
                pieces += arff_format.ArffReader._pieces(folder, part, len(head))
            assert b"".join(pieces).decode() == "\n".join(lines) + ends


def test_round_trip_of_awkward_values(spark, load, tmp_path):
    values = ["", "?", "a b", "it's", 'say "x"', "100%", "%", "{z}", "back\\slash", "\\n", "line\nend", "\r", "é", "x,y", None]
    df = spark.createDataFrame([(float(i) / 3, v, v, i % 2 == 0) for i, v in enumerate(values)], "n double, free string, cls string, flag boolean").repartition(4)
    own = arff.described(df, "cls").withMetadata("free", {})
    own.write.format("arff").mode("overwrite").option("relation", "r").save(str(tmp_path / "r"))
    back = load(tmp_path / "r")
    assert back.columns == ["n", "free", "flag", "cls"]
    got = {(round(r.n, 9), r.free, r.cls, r.flag) for r in back.collect()}
    assert got == {(round(i / 3, 9), v, v, str(int(i % 2 == 0))) for i, v in enumerate(values)}
    assert arff.DOMAIN not in back.schema["free"].metadata
    assert sorted(back.schema["cls"].metadata[arff.DOMAIN]) == sorted(v for v in values if v is not None)


def test_commits_replace_append_and_leave_nothing(spark, load, tmp_path):
    path, df = str(tmp_path / "w"), spark.range(10).select(F.col("id").cast("double").alias("x"), F.lit("c").alias("cls"))
    arff.write(df, path, "w", "cls")
    arff.write(df.where("x < 4"), path, "w", "cls")
    assert load(path).count() == 4
    arff.described(df, "cls").write.format("arff").mode("append").save(path)
    assert load(path).count() == 14
    files = {p.name for p in (tmp_path / "w").iterdir()}
    failing = arff.described(df, "cls").withColumn("x", F.when(F.col("x") < 9, F.col("x")).otherwise(F.raise_error(F.lit("stop")).cast("double")))
    with pytest.raises(Exception):
        failing.write.format("arff").mode("overwrite").save(path)
    assert {p.name for p in (tmp_path / "w").iterdir()} == files and load(path).count() == 14


def test_other_headers_and_missing_files_are_errors(spark, load, tmp_path):
    with pytest.raises(Exception, match="no ARFF file"):
        load(tmp_path / "none")
    for name, kind in (("a", "string"), ("b", "numeric")):
        (tmp_path / f"{name}.arff").write_text(f"@relation r\n@attribute x {kind}\n@data\n1\n")
    with pytest.raises(Exception, match="declares other attributes"):
        load(tmp_path).collect()


def test_empty_table(spark, load, tmp_path):
    arff.write(spark.createDataFrame([], "x double, cls string"), str(tmp_path / "e"), "e", "cls")
    df = load(tmp_path / "e")
    assert df.columns == ["x", "cls"] and df.count() == 0
