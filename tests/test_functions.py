import pytest
from pyspark.sql import functions as F

from tallyloom.functions import dates, money, text


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_amounts_in_comma_style(spark):
    cases = {"1.234,56": 123456, "-12,5": -1250, "+ 7": 700, "EUR 10,00": 1000, "10,00 €": 1000, "eur EUR 3,00 EUR": 300, "1.23,00": None, "1,234": None, "12.34": None, "": None, "1 EUR 2": None, "90071992547409,91": 9007199254740991, "90071992547409,92": None, "--5": None}
    assert values(spark, money.parse_cents(F.col("x"), "comma"), cases) == list(cases.values())


def test_amounts_in_dot_style_and_without_sign(spark):
    assert values(spark, money.parse_cents(F.col("x"), "dot"), ["1234.5", "1,234.50", "-0.07", None]) == [123450, None, -7, None]
    assert values(spark, money.parse_unsigned_cents(F.col("x"), "comma"), ["5,00", "-5,00", "+5,00", "EUR 5,00"]) == [500, None, None, 500]


def test_display(spark):
    assert values(spark, money.display(F.col("x")), [-123405, 0, 5, 100000000], "x long") == ["-1.234,05", "0,00", "0,05", "1.000.000,00"]


def test_dates_are_strict(spark):
    assert [str(d) for d in values(spark, dates.parse_date(F.col("x"), "DD/MM/YYYY"), ["29/02/2024", "29/02/2023", "1/2/2024", " 01/02/2024 ", "2024-02-01"])] == ["2024-02-29", "None", "None", "2024-02-01", "None"]
    assert [str(d) for d in values(spark, dates.parse_date(F.col("x"), "DD.MM.YY"), ["05.03.26", "05.03.2026"])] == ["2026-03-05", "None"]


def test_local_days_and_months(spark):
    day = dates.local_day(F.to_timestamp("x"))
    assert [str(d) for d in values(spark, day, ["2026-03-28 22:59:00", "2026-03-28 23:00:00", "2026-03-29 21:59:00", "2026-03-29 22:00:00"])] == ["2026-03-28", "2026-03-29", "2026-03-29", "2026-03-30"]
    assert values(spark, dates.shifted_month(F.col("x"), -1), ["2026-01", "2026-03"]) == ["2025-12", "2026-02"]
    assert values(spark, dates.asked_month(F.col("x"), F.lit("2026-03")), ["2026-02", "2026-04", "2026-13", None]) == ["2026-02", "2026-03", "2026-03", "2026-03"]


PINNED = {
    "Bancontact-aankoop via Google Pay - ALDI 123 9000 GENT kaart nr. 6703 1234 5678 9012": "ALDI 123",
    "colruyt  gent": "COLRUYT",
    "GENT": "GENT",
    "GENT BRUSSEL": "GENT",
    "BETALING MET DEBETKAART DELHAIZE 12/03 14:22": "DELHAIZE",
    "NETFLIX <NL> 12-03-2026": "NETFLIX",
    "KAART 6703 1234 5678 9012": "KAART",
    "SHOP 2020 9000 GENT": "SHOP 2020 9000",
    "A - - - B": "A - B",
    " ;;MOBILE VIKINGS.. ": "MOBILE VIKINGS",
    "": "",
}


def test_normaliser_and_its_closure(spark):
    got = values(spark, text.normalise_counterparty(F.col("x")), PINNED)
    assert dict(zip(PINNED, got)) == PINNED
    assert values(spark, text.normalise_counterparty(F.col("x")), got) == got


def test_keys_masks_and_globs(spark):
    assert values(spark, text.key_text(F.col("x")), [" café  x ", "a\tb"]) == ["CAFÉ X", "A B"]
    assert values(spark, text.masked_cards(F.col("x")), ["KAART NR. 6703 1234 5678 9012 X", "CARD NO 1111.2222.3333.444X", "CARD 1111 2222 3333 4444", "MIJNKAART 1111 2222 3333 4444"]) == ["KAART NR. **** 9012 X", "CARD NO **** 444X", "CARD 1111 2222 3333 4444", "MIJNKAART 1111 2222 3333 4444"]
    pairs = spark.createDataFrame([("A*C", "ABBC"), ("A*C", "ABCD"), ("A.C", "ABC"), ("*", "X"), ("A\\E*", "A\\EZ"), ("A+B", "A+B")], "g string, t string")
    shaped = pairs.withColumn("r", text.glob_to_regex(F.col("g")))
    assert [r[0] for r in shaped.selectExpr("t rlike r").collect()] == [True, False, False, True, True, True]


@pytest.mark.parametrize("iban,key", [("be12 3", "iban:BE123"), (None, "text:N")])
def test_refund_keys(spark, iban, key):
    row = spark.createDataFrame([(iban, "n", "d")], "i string, n string, d string")
    assert row.select(text.refund_key(F.col("i"), F.col("n"), F.col("d"))).first()[0] == key
