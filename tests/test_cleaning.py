import pytest

from lucarne.operators import cleaning


def test_names():
    assert cleaning.clean_names(["﻿id", " id ", "val", "", "  "]) == ["id", "id_1", "val", "column", "column_1"]
    assert cleaning.clean_names(["a", "a", "a"]) == ["a", "a_1", "a_2"]
    assert len(set(cleaning.clean_names(["a", "a", "a_1", "a_1"]))) == 4


def test_header_fill():
    assert cleaning.fill_header(["A", "Unnamed: 1", "", "B"]) == ["A", "A", "A", "B"]
    assert cleaning.fill_header(["", "B"]) == ["", "B"]


def test_validation(spark, rows):
    with pytest.raises(cleaning.TableError, match="no columns"):
        cleaning.validate_table(spark.range(1).select())
    with pytest.raises(cleaning.TableError, match="no rows"):
        cleaning.validate_table(rows([], "a int"))
    with pytest.raises(cleaning.TableError, match="null"):
        cleaning.validate_table(rows([(None, None)], "a int, b string"))
    assert cleaning.validate_table(rows([(None, "x")], "a int, b string")).count() == 1


def test_tokens(rows):
    df = rows([("NA", 1), ("#N/A", 2), ("", 3), ("ok", 4), (None, 5)], "t string, n int")
    assert [r.t for r in cleaning.null_tokens_to_null(df).orderBy("n").collect()] == [None, "#N/A", None, "ok", None]
    assert [r.t for r in cleaning.error_tokens_to_null(df).orderBy("n").collect()] == ["NA", None, "", "ok", None]


def test_flatten(spark):
    df = spark.sql("SELECT 1 AS id, array(1, 2) AS a, struct(1 AS x, 'y' AS z) AS s, map('k', 1) AS m")
    assert cleaning.flatten_nested(df).first().asDict() == {"id": 1, "a": "[1,2]", "s": '{"x":1,"z":"y"}', "m": '{"k":1}'}


def test_header_heuristic():
    assert cleaning.first_row_looks_like_data(["2020", "12.5", "-"])
    assert not cleaning.first_row_looks_like_data(["2020", "total"])
