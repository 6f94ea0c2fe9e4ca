"""Stored tables that are replaced in part: re-interpretation of new imports, re-parse, keyed lookups."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from test_ledger import ACCOUNT, ACCOUNTS, D0, FACT, fact

from tallyloom.plans import incremental
from tallyloom.plans.interpret import interpret
from tallyloom.sources import ingest, profile
from tallyloom.sources.ingest import append, stored_keys
from tallyloom.sources.snapshots import Snapshot, part_of

SHAPE = "household_id string, period string, id long, v string"


def snapshot(spark, tmp_path, parts=2):
    return Snapshot(spark, f"file://{tmp_path}/s", {"t": StructType.fromDDL(SHAPE)}, parts)


def table(spark, rows):
    return spark.createDataFrame(rows, SHAPE)


def rows_of(store, **k):
    return sorted(tuple(r) for r in store.read("t", **k).collect())


def test_versions_splices_and_a_writer_that_dies(spark, tmp_path):
    store = snapshot(spark, tmp_path)
    assert store.version() == 0 and rows_of(store) == []
    first = [(h, p, n, "old") for h in "abcd" for p in ("1", "2") for n in range(2)]
    assert store.commit({"t": (table(spark, first), None)}) == 1 and rows_of(store) == sorted(first)
    # one row moves to another period, one is new, one goes
    new = table(spark, [("a", "2", 0, "new"), ("b", "3", 9, "new")])
    gone = table(spark, [("a", "1", 0, ""), ("c", "2", 1, "")])
    change = store.splice("t", new, ["household_id", "id"], gone)
    want = sorted([r for r in first if r[:3] not in (("a", "1", 0), ("a", "2", 0), ("c", "1", 1), ("c", "2", 1))] + [("a", "2", 0, "new"), ("b", "3", 9, "new")])
    # ids repeat over periods here, so the rows of a key go from all partitions that are touched
    touched = {(part, p) for part, p in store.pointer().select("part", "period").collect()}
    assert store.commit({"t": change}) == 2
    assert [r for r in rows_of(store) if r[0] in "ab"] == [r for r in want if r[0] in "ab"] and len(touched) <= 4
    assert rows_of(store, version=1) == sorted(first)
    files = set(store.read("t", households=spark.createDataFrame([("a",)], "household_id string"), periods=["1"]).inputFiles())
    own = spark.range(1).select(part_of(F.lit("a"), 2).alias("p")).first().p
    assert files and all(f"part={own}/period=1" in f for f in files)
    before = rows_of(store)
    failing = table(spark, [("a", "1", 5, "x")]).withColumn("v", F.raise_error(F.lit("executor lost")).cast("string"))
    with pytest.raises(Exception, match="executor lost"):
        store.commit({"t": (failing, None)})
    assert store.version() == 2 and rows_of(store) == before
    # files of a pointer without its mark do not count
    table(spark, first).limit(0).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{store.root}/pointers/v=7")
    assert store.version() == 2
    assert store.commit({"t": (table(spark, [("d", "2", 4, "last")]), table(spark, [("d", "2", 0, "")]))}) == 3


def test_spliced_equals_recomputed(spark, tmp_path):
    debit = "MASTERCARD AFREKENING NUMMER 7"
    old = [
        fact("back", "a", -300, 200, name="Shop"),  # income until the shop is first paid, far from the window
        fact("c1", "card", -200, -600, imported="m1"), fact("s1", "a", -190, -600, debit), fact("m1c", "card", -189, 600, "Domiciliering via je bank", imported="m2"),
        fact("far1", "a", -54, -10, iban="BE2"), fact("far2", "b", -52, 10, iban="BE1"), fact("far3", "a", -50, -10, iban="BE2"), fact("far4", "b", -48, 10, iban="BE1"),  # a chain over the window's edge
        fact("t1", "a", 0, -70, iban="BE2"), fact("lone", "b", 400, 5, iban="BE1"), fact("pay", "a", 420, 900, name="BOSS"),
    ]
    new = [fact("t2", "b", 2, 70, iban="BE1", imported="n"), fact("shop", "a", 1, -33, name="SHOP", imported="n"), fact("s2", "a", 3, -600, debit, imported="n"), fact("o", "a", 0, -70, iban="BE2", imported="n")]
    facts, before = (spark.createDataFrame(r, FACT) for r in (old + new, old))
    accounts = spark.createDataFrame(ACCOUNTS, ACCOUNT)
    store = incremental.stored_interpretation(spark, f"file://{tmp_path}/i", parts=2)
    incremental.recompute(store, before, accounts)
    assert {r.id: r.flow for r in store.read("rows").collect()}["back"] == "INCOME"
    imports = spark.createDataFrame([("h", "n")], "household_id string, import_id string")
    incremental.reinterpret(store, facts, accounts, imports)
    want = interpret(facts, accounts)
    pick = ["id", "flow", "is_cash", "is_unmatched"]
    assert sorted(map(tuple, store.read("rows").select(pick).collect())) == sorted(map(tuple, want.rows.select(pick).collect()))
    ends = ["outgoing_id", "incoming_id", "card_import_id"]
    assert sorted(map(str, store.read("links").select(ends).collect())) == sorted(map(str, want.links.select(ends).collect()))
    assert {tuple(r) for r in store.read("states").select("import_id", "status").collect()} == {(i, "INTERPRETED") for i in ("a-i", "b-i", "card-i", "m1", "m2", "n")} - {("card-i", "INTERPRETED")}
    assert incremental.affected(facts, accounts, imports).where("id = 'pay'").count() == 0


CARD = "Kaart\nDatum;Valuta;Omschrijving;Bedrag;DC\n01.08.26;02.08.26;SHOP A;12,00;D\n03.08.26;04.08.26;SHOP B;5,50;C\n"


def test_rewrite_is_whole_or_nothing(spark, tmp_path, monkeypatch):
    files = spark.createDataFrame([("h", "f", bytearray(CARD.encode()))], "household_id string, file_id string, content binary")
    spec = profile.infer(files).where("reason IS NULL").select("household_id", "spec")
    a, b = CARD.split("\n")[2:4]
    day = dt.date(2025, 8, 1)
    facts = spark.createDataFrame([("h", i, "f", "acc", "p", day, 1, "wrong", raw, f"h:o{i}#0") for i, raw in (("1", a), ("2", b))], "household_id string, id string, import_id string, account_id string, profile_id string, booking_date date, amount_cents long, description string, raw_line string, dedup_key string")
    store = ingest.fact_store(spark, f"file://{tmp_path}/facts", parts=2)
    states = spark.createDataFrame([("h", "f", "INTERPRETED"), ("h", "other", "INTERPRETED")], "household_id string, import_id string, status string")
    ingest.put_facts(store, facts, states, spec.withColumn("profile_id", F.lit("p")).withColumn("spec", F.col("spec").withField("decimal_style", F.lit("dot"))))
    given = spark.createDataFrame([("h", "p", 1, "f", bytearray(CARD.encode()))], "household_id string, profile_id string, import_order int, import_id string, content binary").join(spec, "household_id")
    look = lambda: (sorted((r.id, str(r.booking_date), r.amount_cents) for r in store.read("facts").collect()), sorted((r.import_id, r.status) for r in store.read("states").collect()))
    before = look()
    written = Snapshot._written

    def dies(self, base):
        if "/states/" in base:
            raise RuntimeError("lost midway")
        return written(self, base)

    monkeypatch.setattr(Snapshot, "_written", dies)
    with pytest.raises(RuntimeError, match="lost midway"):
        ingest.rewrite(store, given)
    assert look() == before and store.version() == 1  # the facts' files were written, and nobody reads them
    monkeypatch.setattr(Snapshot, "_written", written)
    version, refused = ingest.rewrite(store, given)
    assert version == 2 and refused.count() == 0
    assert look() == ([("1", "2026-08-01", -1200), ("2", "2026-08-03", 550)], [("f", "INGESTED"), ("other", "INTERPRETED")])
    assert store.read("profiles").where(F.get_json_object("spec", "$.decimal_style") == "comma").count() == 1
    # a correction that the file refuses changes nothing
    wrong = given.withColumn("spec", F.col("spec").withField("decimal_style", F.lit("dot")))
    now = look()
    _, refused = ingest.rewrite(store, wrong)
    assert [r.reason for r in refused.collect()] == ["row-amount"] and look() == now


def test_keys_are_looked_up_in_touched_parts_only(spark, tmp_path):
    rows = spark.createDataFrame([(f"h{n}", f"k{n}", D0) for n in range(40)], "household_id string, dedup_key string, booking_date date")
    path = f"file://{tmp_path}/appended"
    assert stored_keys(spark, path, rows).count() == 0
    append(rows, path)
    batch = rows.where("household_id = 'h7'")
    found = stored_keys(spark, path, batch)
    part = batch.select(part_of(F.col("household_id")).alias("p")).first().p
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^\]]*part#\d+ = {part}\)", plan) and ("h7", "k7") in set(map(tuple, found.collect()))
    assert {r.household_id for r in found.collect()} == {r.household_id for r in rows.where(part_of(F.col("household_id")) == part).collect()}
    assert stored_keys(spark, path, rows.limit(0)).count() == 0


def test_files_are_parsed_once_for_a_corrected_profile(spark):
    files = spark.createDataFrame([("h", f, bytearray(CARD.encode())) for f in ("f", "g")], "household_id string, import_id string, content binary")
    spec = profile.infer(files.withColumnRenamed("import_id", "file_id")).where("reason IS NULL").select("household_id", F.col("file_id").alias("import_id"), "spec")
    given = files.join(spec, ["household_id", "import_id"]).withColumns({"profile_id": F.lit("p"), "import_order": F.lit(1)})
    rows = [("h", "p", f, f"acc-{f}", f"{f}{n}", raw, f"h:o{f}{n}#0") for f in "fg" for n, raw in enumerate(CARD.split("\n")[2:4])]
    stored = spark.createDataFrame(rows, "household_id string, profile_id string, import_id string, account_id string, id string, raw_line string, dedup_key string")
    rewritten, refused = ingest.fix_profile(given, stored)
    # nothing that is made of the rows takes the files' lines apart again
    assert "posexplode" not in rewritten._jdf.queryExecution().optimizedPlan().toString()
    assert refused.count() == 0
    assert sorted((r.import_id, r.id, r.line_no, r.account_id, r.amount_cents) for r in rewritten.collect()) == [(f, f"{f}{n}", n + 3, f"acc-{f}", c) for f in "fg" for n, c in enumerate((-1200, 550))]
