import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from lucarne.functions import arithmetic, casts
from lucarne.functions.formula import formula


def one(spark, value, of, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(of(F.col("v"))).first()[0]


@pytest.mark.parametrize("text,day", [
    ("2023-01-05", (2023, 1, 5)), ("2023/1/5", (2023, 1, 5)), ("5.1.2023", (2023, 1, 5)), ("05 01 2023", (2023, 1, 5)),
    ("13/02/2023", (2023, 2, 13)), ("02/13/2023", (2023, 2, 13)), (" 2023-01-05 ", (2023, 1, 5)),
    ("5 mars 2023", (2023, 3, 5)), ("5 Février 2023", (2023, 2, 5)), ("2023 août 9", (2023, 8, 9)), ("9 Dec 2022", (2022, 12, 9)),
    ("janvier-2023-04", (2023, 1, 4)), ("march 5 2023", (2023, 5, 3)),
    ("31/02/2023", None), ("2023", None), ("mai", None), ("15mars2023", None), ("5 mars mars 2023", None), ("x" * 500, None), (None, None),
])
def test_dates(spark, text, day):
    assert one(spark, text, casts.to_date) == (dt.date(*day) if day else None)


@pytest.mark.parametrize("text,moment", [
    ("2023-01-05 10:11:12", dt.datetime(2023, 1, 5, 10, 11, 12)), ("2023/01/05 10:11:12", dt.datetime(2023, 1, 5, 10, 11, 12)),
    ("5/1/2023 1:2:3", dt.datetime(2023, 1, 5, 1, 2, 3)), ("2023-01-05T10:11:12", dt.datetime(2023, 1, 5, 10, 11, 12)),
    ("2023-01-05 10:11:12.5", dt.datetime(2023, 1, 5, 10, 11, 12, 500000)), ("2023-01-05 10:11", dt.datetime(2023, 1, 5, 10, 11)),
    ("2023-01-05 25:00:00", None), ("2023-01-05", None), ("2023-01-05T10:11", None),
])
def test_timestamps(spark, text, moment):
    assert one(spark, text, casts.to_timestamp) == moment


@pytest.mark.parametrize("text,number", [
    ("100.50", 100.5), ("50,25", 50.25), ("1 234,5 €", 1234.5), ("$12", 12.0), ("-3", -3.0), ("1,234,5", None), ("abc", None), ("", None), ("--5", None),
])
def test_numbers(spark, text, number):
    assert one(spark, text, casts.clean_number) == number
    assert one(spark, text, casts.clean_integer) == (None if number is None else math.trunc(number))


def test_unix_seconds_and_milliseconds(spark):
    shown = lambda c: F.date_format(casts.unix_to_timestamp(c), "yyyy-MM-dd HH:mm:ss.SSS")
    assert one(spark, "1700000000", shown) == "2023-11-14 22:13:20.000"
    assert one(spark, "1700000000123", shown) == "2023-11-14 22:13:20.123"
    assert one(spark, "100000000000", shown).startswith("5138-11-16")    # the limit itself still counts as seconds
    assert one(spark, "x", shown) is None


@pytest.mark.parametrize("text,strict,lenient", [
    (" OUI ", True, True), ("1", True, True), ("t", True, True), ("1.0", None, True), ("Faux", False, False), ("n", False, False), ("maybe", None, False), (None, None, None),
])
def test_booleans(spark, text, strict, lenient):
    assert one(spark, text, casts.to_boolean_strict) is strict
    assert one(spark, text, casts.to_boolean_lenient) is lenient


def test_large_doubles_do_not_pass_through_their_exponent(spark):
    df = spark.createDataFrame([(12345678.9,)], "v double")
    assert df.select(casts.recast(F.col("v"), "double", "Float64", through_text=True)).first()[0] == 12345678.9


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(3.0, 2.0, 2.0, "7", "x")], "a double, b double, `unit price` double, s string, w string").cache()


@pytest.mark.parametrize("text,value", [
    ("-a**2", 9.0), ("-(a**2)", -9.0), ("a**b**2", 81.0), ("a**(b**3)", 6561.0), ("(a)**b", 9.0), ("2**-b", 0.25), ("2**-b**2", 0.0625),
    ("a**(-b**2)", 81.0), ("a - b - 1", 0.0), ("a*-b", -6.0), ("--a", 3.0), ("a/b*2", 3.0), ("2*-a**2", 18.0),
    ("unit price*2", 4.0), ("f['unit price'] + \"a\" + 'b'", 7.0), ("f[\"a\"]", 3.0), ("round(a/7, 2)", 0.43), ("ROUND(2.5)", 2.0),
    ("abs(-b)", 2.0), ("Log(100)", 2.0), ("log(8, 2)", 3.0), ("LN(EXP(2))", 2.0), ("SQRT(a*a)", 3.0), ("s + 1", 8.0), ("w + 1", None),
    ("1/0", math.inf), ("-1/0", -math.inf), ("LN(0)", -math.inf), ("1.5 + .5", 2.0),
])
def test_formulas(numbers, text, value):
    assert numbers.select(formula(text, numbers.columns)).first()[0] == (value if value is None else pytest.approx(value))


@pytest.mark.parametrize("text", ["0/0", "LN(-1)", "SQRT(-1)", "LOG(-2)"])
def test_formulas_outside_their_domain(numbers, text):
    assert math.isnan(numbers.select(formula(text, numbers.columns)).first()[0])


@pytest.mark.parametrize("text", ["", "a+", "zz", "'q'", "+a", "a//b", "a % b", "a < b", "__import__('os')", "a.b", "f['a' * 2", "MAX(a)", "lambda: 1", "a b"])
def test_formulas_refused(numbers, text):
    with pytest.raises(ValueError):
        formula(text, numbers.columns)


def test_rounding_agrees_with_python(spark):
    values = [i / 20 for i in range(-200, 400)] + [i / 200 for i in range(-300, 3000)] + [i / 8 for i in range(60)] + [2.675, 1.005, 5.149999999999999]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", arithmetic.round_exact(F.col("v"), 1), arithmetic.round_exact(F.col("v"), 2), arithmetic.one_decimal(F.abs("v"))
    ).collect()
    for v, one_digit, two_digits, text in got:
        assert (one_digit, two_digits, text) == (round(v, 1), round(v, 2), f"{abs(v):.1f}")
