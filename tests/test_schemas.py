"""Declarations that a schema carries through filters, selections and files."""

import pytest

from lodestream.sources import arff

ROWS = [(1.5, "it's", "a b", 3, True), (2.0, "x,y", "", 4, False), (None, "?", "back\\slash", 5, None), (7.0, "plain", "{z}", 3, True)]


@pytest.fixture(scope="module")
def described(spark):
    return arff.described(spark.createDataFrame(ROWS, "size double, cls string, name string, code int, flag boolean"), "cls", ["code"])


def test_declarations_outlive_filters_and_selections(spark, described, tmp_path):
    few = arff.reduced(described.where("size > 1.6"), ["name", "code"])
    assert few.columns == ["name", "code", "cls"] and arff.class_column(few) == "cls"
    assert few.schema["code"].metadata == {arff.DOMAIN: ["3", "4", "5"]}
    assert few.schema["cls"].metadata == {arff.DOMAIN: sorted(r[1] for r in ROWS), arff.CLASS: True}
    arff.write(few, str(tmp_path / "few"), "few", "cls")
    back = arff.read(spark, str(tmp_path / "few"))
    assert [(f.name, f.metadata) for f in back.schema] == [(f.name, f.metadata) for f in few.schema]
    assert sorted(tuple(r) for r in back.collect()) == sorted((r[2], str(r[3]), r[1]) for r in ROWS if r[0] and r[0] > 1.6)
    again = arff.header(back, "few", "cls")
    assert again == arff.header(few, "few", "cls")


def test_what_is_missing_is_an_error(spark, described):
    with pytest.raises(ValueError):
        arff.reduced(described, ["name", "none"])
    with pytest.raises(ValueError):
        arff.class_column(spark.range(1))
    assert arff.reduced(described, []).columns == ["cls"]
