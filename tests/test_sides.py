"""Tables of a row a file or a line are not sent to all tasks through the driver, however few bytes they take."""

import pytest
from pyspark.sql import functions as F
from test_sources import CARD, CURRENT, PAIR, files

from tallyloom.operators import joins
from tallyloom.sources import ingest, profile


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def written(monkeypatch, module):
    """The plans of the steps that a module writes, by name."""
    plans, staged = {}, module.staged

    def kept(df, name="step"):
        plans[name] = planned(df)
        return staged(df, name)

    monkeypatch.setattr(module, "staged", kept)
    return plans


TEXTS = {"current": CURRENT, "again": CURRENT, "none": "", "flat": "hello\nworld"}


@pytest.mark.parametrize("kinds", [None, -1])
def test_inference_merges_what_is_a_row_a_file(spark, monkeypatch, kinds):
    plans = written(monkeypatch, profile)
    if kinds is not None:
        monkeypatch.setattr(profile, "KINDS", kinds)
    found = profile.infer(files(spark, **TEXTS))
    assert {"shapes", "columns", "kinds"} <= set(plans) and not [n for n, p in plans.items() if "Broadcast" in p]
    assert planned(found).count("BroadcastHashJoin") == (kinds is None)
    got = {r.file_id: (r.reason, r.spec and r.spec.columns.description) for r in found.collect()}
    assert got == {"current": (None, 7), "again": (None, 7), "none": ("empty-file", None), "flat": ("no-delimiter", None)}


def test_inference_of_uploads_in_many_forms_sends_only_their_kinds(spark, monkeypatch):
    # two columns of amounts, a mark, an old encoding and two accounts: all that is asked of a file's amounts is asked
    mixed = CURRENT + CURRENT.split("\n")[-2].replace("BE1", "BE3") + "\n"
    forms = {"current": CURRENT, "card": CARD, "pair": PAIR, "old": CURRENT.encode("cp1252"), "mixed": mixed, "both": PAIR.replace(",12.50,,", ",12.50,1.00,")}
    plans = written(monkeypatch, profile)
    found = profile.infer(files(spark, **forms))
    assert not [n for n, p in plans.items() if "Broadcast" in p]
    assert planned(found).count("BroadcastHashJoin") == 1
    got = {r.file_id: r.reason or (r.spec.amount.kind, r.spec.encoding) for r in found.collect()}
    assert got == {"current": ("signed", "utf-8"), "card": ("indicator", "utf-8"), "pair": ("debitCredit", "utf-8"), "old": ("signed", "windows-1252"), "mixed": ("signed", "utf-8"), "both": "ambiguous-amount-columns"}


def test_uploads_meet_what_is_a_row_a_file_by_merges(spark):
    sent = files(spark, a=CARD, b=CARD, c=CURRENT, late=CARD.replace("03.08.26", "33.08.26"), mixed=CURRENT + CURRENT.split("\n")[-2].replace("BE1", "BE3") + "\n")
    card = profile.infer(files(spark, a=CARD)).first().spec
    found = profile.infer(sent)
    specs = spark.createDataFrame([(r.household_id, r.file_id, card if r.file_id == "late" else r.spec) for r in found.collect()], found.drop("reason").schema)
    stored = specs.where("file_id = 'a'").select("household_id", F.lit("P").alias("id"), F.lit("bound").alias("account_id"), F.lit(1).alias("created_at"), "spec")
    accounts = spark.createDataFrame([("h", "acc", "BE11111111111111")], "household_id string, id string, iban string")
    done = ingest.uploaded(*map(profile.staged, (sent, specs, stored, accounts)))
    # the stored profiles and the accounts may be sent; nothing that has a row a file
    assert planned(done).count("BroadcastHashJoin") == 2
    assert "file_id" not in " ".join(x for x in planned(done).split("\n") if "BroadcastHashJoin" in x)
    assert {tuple(r)[1:] for r in done.collect()} == {("a", None, "P", "bound", 2, -650), ("b", None, "P", "bound", 2, -650), ("c", None, None, "acc", 2, 248750), ("late", "row-date", None, None, 0, 0), ("mixed", "mixed-accounts", None, None, 0, 0)}


@pytest.mark.parametrize("few", [None, 0])
def test_a_reparse_sends_only_what_is_counted_as_few(spark, monkeypatch, few):
    if few is not None:
        monkeypatch.setattr(joins, "FEW", few)
    spec = profile.infer(files(spark, a=CARD)).select("household_id", "spec")
    wrong, cards = CARD.replace("5,50", "5.5,0"), CARD.split("\n")[2:4]
    rows = [("h", p, 1, i, bytearray(t.encode())) for p, i, t in (("p", "f", CARD), ("p", "g", CARD), ("q", "x", CARD), ("q", "y", wrong))]
    given = spark.createDataFrame(rows, "household_id string, profile_id string, import_order int, import_id string, content binary").join(spec, "household_id")
    given = profile.staged(given)
    facts = [("h", p, i, "acc", f"{i}{n}", raw, f"h:{i}{n}#0") for _, p, _, i, t in rows for n, raw in enumerate(t.decode().split("\n")[2:4])]
    stored = spark.createDataFrame(facts, "household_id string, profile_id string, import_id string, account_id string, id string, raw_line string, dedup_key string")
    plans = written(monkeypatch, ingest)
    rewritten, refused = ingest.fix_profile(given, profile.staged(stored))
    assert "Broadcast" not in plans["bad"] and [p for p in plans["parsed"].split("\n") if "Join" in p][0].find("SortMergeJoin") >= 0
    assert ("Broadcast" in plans["refused"]) == (few is None)
    first = next(x for x in planned(rewritten).split("\n") if "Join" in x)
    assert "SortMergeJoin" in first and "line_no" in first
    assert {tuple(r) for r in refused.collect()} == {("h", "q", "y", "row-amount", "y1")}
    assert {(r.import_id, r.id, r.raw_line, r.amount_cents) for r in rewritten.collect()} == {(i, f"{i}{n}", cards[n], (-1200, 550)[n]) for i in "fg" for n in (0, 1)}
