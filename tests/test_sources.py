import pytest
from pyspark.sql import functions as F

from tallyloom.sources import delimited, ingest, positioned, profile

H = "household_id string, file_id string, content binary"


def files(spark, **texts):
    return spark.createDataFrame([("h", k, bytearray(t if isinstance(t, bytes) else t.encode())) for k, t in texts.items()], H)


def inferred(spark, **texts):
    return {r.file_id: r for r in profile.infer(files(spark, **texts)).collect()}


CURRENT = "Export\nAfschrift;Volgnummer;Datum;Valuta;Rekening;Tegenrekening;Naam;Omschrijving;Bedrag\n1;1;01/08/2026;02/08/2026;BE11111111111111;;Boss;\"SALARY; AUG\";2.500,00\n1;2;03/08/2026;03/08/2026;BE11111111111111;BE22222222222222;;CAFÉ;-12,50\n"
CARD = "Kaart\nDatum;Verrekening;Omschrijving;Bedrag;DC\n01.08.26;02.08.26;SHOP A;12,00;D\n03.08.26;04.08.26;SHOP B;5,50;C\n"
PAIR = "Date,Counterparty account,Name,Details,Debit,Credit,Account\n2026-08-01,,Shop,food,12.50,,BE11111111111111\n2026-08-02,,Boss,pay,,100.00,BE11111111111111\n"


def test_fields_quotes(spark):
    cases = {'a;b': ["a", "b"], '"a;b";c': ["a;b", "c"], '"a"b;c': ["ab", "c"], '"a""b"': ['a"b'], 'x"y;z': ['x"y', "z"], '"open;rest': ["open;rest"], '""': [""], ";": ["", ""]}
    got = [r[0] for r in spark.createDataFrame([(k,) for k in cases], "x string").select(delimited.fields(F.col("x"), F.lit(";"))).collect()]
    assert dict(zip(cases, got)) == cases


def test_infers_and_parses_three_layouts_and_an_old_encoding(spark):
    texts = {"current": CURRENT, "card": CARD, "pair": PAIR, "old": CURRENT.encode("cp1252"), "none": "", "flat": "hello\nworld", "headless": "01/08/2026;1,00\n"}
    got = inferred(spark, **texts)
    assert got["none"].reason == "empty-file" and got["flat"].reason == "no-delimiter" and got["headless"].reason == "no-header-row"
    assert got["current"].spec.amount.kind == "signed" and got["card"].spec.amount.kind == "indicator" and got["pair"].spec.amount.kind == "debitCredit"
    assert got["old"].spec.encoding == "windows-1252" and got["current"].spec.columns.counterparty_iban == 5
    good = profile.infer(files(spark, **texts)).where("reason IS NULL").select("household_id", "file_id", "spec")
    rows, bad = delimited.statements(files(spark, **texts).join(good, ["household_id", "file_id"]))
    cents = {}
    for r in rows.orderBy("file_id", "line_no").collect():
        cents.setdefault(r.file_id, []).append((r.amount_cents, r.description))
    assert bad.count() == 0
    assert cents == {"current": [(250000, "SALARY; AUG"), (-1250, "CAFÉ")], "old": [(250000, "SALARY; AUG"), (-1250, "CAFÉ")], "card": [(-1200, "SHOP A"), (550, "SHOP B")], "pair": [(-1250, "food"), (10000, "pay")]}


def test_one_bad_row_fails_the_file(spark):
    spec = profile.infer(files(spark, ok=CARD)).first().spec
    texts = files(spark, ok=CARD, storno=CARD.replace(";C\n", ";X\n"), late=CARD.replace("03.08.26", "33.08.26"), empty="Kaart\nDatum;x\n\n", fused=CARD.replace("5,50", "5.5,0"))
    specs = spark.createDataFrame([(spec,)], profile.infer(files(spark, ok=CARD)).select("spec").schema)
    rows, bad = delimited.statements(texts.crossJoin(specs))
    assert {r.file_id: (r.reason, r.line_no) for r in bad.collect()} == {"storno": ("row-indicator", 4), "late": ("row-date", 4), "empty": ("empty-file", None), "fused": ("row-amount", 4)}
    assert {r.file_id for r in rows.collect()} == {"ok"}


def test_spec_validation_and_recognition(spark):
    spec = profile.infer(files(spark, a=CARD)).first().spec.asDict(recursive=True)
    assert profile.spec_problem(spec) is None
    assert profile.spec_problem(spec | {"delimiter": "|"}) == "delimiter"
    assert profile.spec_problem(spec | {"amount": spec["amount"] | {"credit_value": "d"}}) == "indicator"
    assert profile.spec_problem({"kind": "pdf-layout", "template_id": "x", "version": 1}) is None


def test_account_resolution(spark):
    rows = spark.createDataFrame([("h", "f1", "BE1", "bound"), ("h", "f2", None, "bound"), ("h", "f3", "BE7", "bound")], "household_id string, file_id string, account_iban string, bound_account string")
    accounts = spark.createDataFrame([("h", "a", "BE1")], "household_id string, id string, iban string")
    assert {r.file_id: r.account_id for r in ingest.resolve_accounts(rows, accounts).collect()} == {"f1": "a", "f2": "bound", "f3": None}


ITEM = "household_id string, file_id string, page int, x double, y double, width double, text string"


def statement(file, closing="+ 1.010,00", second="0002", stray=None):
    lines = [(800, 40, "Belfius Bank NV"), (780, 40, "BLZ. : 1/1"), (770, 40, "-- BE11 1111 1111 1111 --"), (760, 40, "SALDO OP 01-08-2026 EUR + 1.000,00"), (700, 40, "0001 02-08-2026 (VAL. 03-08-2026) + 20,00"), (690, 60, "FROM BE22 2222 2222 2222 BOSS"), (660, 40, f"{second} 04-08-2026 (VAL. 04-08-2026) - 10,00"), (650, 60, "SALDO OP LOOKALIKE"), (600, 40, f"SALDO OP 31-08-2026 EUR {closing}")]
    return [("h", file, 0, float(x), float(y), 100.0, t) for y, x, t in lines + ([(655, 40, stray)] if stray else [])]


def test_lines_group_by_their_first_run(spark):
    items = [("h", "f", 0, 0.0, 10.0, 5.0, "a"), ("h", "f", 0, 5.5, 8.5, 5.0, "b"), ("h", "f", 0, 20.0, 7.9, 5.0, "c"), ("h", "f", 0, 30.0, 9.0, 1.0, " ")]
    assert [(r.text, r.x) for r in positioned.lines(spark.createDataFrame(items, ITEM)).orderBy("line_no").collect()] == [("ab", 0.0), ("c", 20.0)]


def test_positioned_statements_and_their_gates(spark):
    items = statement("good") + statement("gap", second="0003") + statement("off", closing="+ 1.011,00") + statement("stray", stray="WHAT IS THIS") + [("h", "other", 0, 1.0, 1.0, 1.0, "hello")]
    rows, bad = positioned.statements(positioned.lines(spark.createDataFrame(items, ITEM)))
    assert {r.file_id: r.reason for r in bad.collect()} == {"gap": "sequence-order", "off": "balance-mismatch", "stray": "unrecognized-line", "other": "layout-unsupported"}
    got = [(r.amount_cents, str(r.booking_date), r.counterparty_iban, r.account_iban, r.description) for r in rows.orderBy("line_no").collect()]
    assert got == [(2000, "2026-08-02", "BE22222222222222", "BE11111111111111", "FROM BE22 2222 2222 2222 BOSS"), (-1000, "2026-08-04", None, "BE11111111111111", "SALDO OP LOOKALIKE")]


def test_blocks_and_sequences_run_on_over_pages(spark):
    def page(n, numbers, extra=()):
        runs = [(800, 40, "Belfius Bank NV"), (780, 40, f"BLZ. : {n + 1}/5"), *extra]
        for i, number in enumerate(numbers):
            runs += [(700 - 30 * i, 40, f"{number:04} 02-08-2026 (VAL. 03-08-2026) + 1,00"), (690 - 30 * i, 60, f"SAID {number}")]
        return [(n, float(y), float(x), t) for y, x, t in runs]

    def file(name, numbers):
        head = [(770, 40, "-- BE11 1111 1111 1111 --"), (760, 40, "SALDO OP 01-08-2026 EUR + 0,00")]
        total = sum(map(len, numbers))
        rows = [r for n, some in enumerate(numbers) for r in page(n, some, head if n == 0 else ())]
        rows += [(len(numbers) - 1, 100.0, 40.0, f"SALDO OP 31-08-2026 EUR + {total},00")]
        return [("h", name, n, x, y, 100.0, t) for n, y, x, t in rows]

    # a page without a transaction in between carries on; a hole between two pages breaks the file
    items = file("good", [[1, 2, 3], [], [4], [5, 6]]) + file("hole", [[1, 2], [], [4, 5]]) + file("again", [[1, 2], [2, 3]])
    rows, bad = positioned.statements(positioned.lines(spark.createDataFrame(items, ITEM)))
    assert {r.file_id: r.reason for r in bad.collect()} == {"hole": "sequence-order", "again": "sequence-order"}
    assert [(r.line_no, r.sequence_number, r.description) for r in rows.orderBy("line_no").collect()] == [(n, f"{n:04}", f"SAID {n}") for n in range(1, 7)]


def test_stream_ingest_adds_each_row_once(spark, tmp_path):
    from tallyloom.streaming.incremental import stream_ingest

    shape = "household_id string, account_id string, import_id string, line_no long, booking_date date, amount_cents long, description string, counterparty_name string, reference string, statement_number string, sequence_number string"
    row = spark.sql("SELECT 'h' household_id, 'a' account_id, 'f' import_id, 1L line_no, date'2026-08-01' booking_date, 100L amount_cents, 'x' description, cast(null as string) counterparty_name, cast(null as string) reference, cast(null as string) statement_number, cast(null as string) sequence_number")
    for n in range(2):
        row.withColumn("import_id", F.lit(f"f{n}")).write.mode("append").parquet(f"{tmp_path}/in")
        stream_ingest(spark.readStream.schema(shape).parquet(f"{tmp_path}/in"), f"{tmp_path}/facts", f"{tmp_path}/cp").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/facts").count() == 1


def test_fix_profile_rewrites_whole_profiles_or_nothing(spark):
    spec = profile.infer(files(spark, ok=CARD)).where("reason IS NULL").select("household_id", "spec")
    late = CARD.replace("05,50", "5,50") + "05.08.26;06.08.26;SHOP B;5,50;C\n"
    rows = [("h", "p", 1, "f", bytearray(CARD.encode())), ("h", "p", 2, "g", bytearray(late.encode())), ("h", "q", 1, "x", bytearray(CARD.encode())), ("h", "q", 2, "y", bytearray(CARD.replace("5,50", "5.5,0").encode())), ("h", "p", 3, "unused", bytearray(b"?"))]
    given = spark.createDataFrame(rows, "household_id string, profile_id string, import_order int, import_id string, content binary").join(spec, "household_id")
    a, b, c = (line for line in late.split("\n")[2:5])
    stored = [("h", "p", "f", "acc", "1", a, "h:o1#0"), ("h", "p", "f", "acc", "2", b, "h:o2#0"), ("h", "p", "g", "acc", "3", b, "h:o3#0"), ("h", "p", "g", "acc", "4", c, "h:o4#0"), ("h", "q", "x", "acc", "5", a, "h:o5#0"), ("h", "q", "y", "acc", "6", b.replace("5,50", "5.5,0"), "h:o6#0")]
    facts = spark.createDataFrame(stored, "household_id string, profile_id string, import_id string, account_id string, id string, raw_line string, dedup_key string")
    rewritten, refused = ingest.fix_profile(given, facts)
    assert {tuple(r) for r in refused.collect()} == {("h", "q", "y", "row-amount", "6")}
    got = {r.id: r for r in rewritten.collect()}
    assert {i: (r.import_id, r.account_id, r.raw_line, r.booking_date.day, r.amount_cents) for i, r in got.items()} == {"1": ("f", "acc", a, 1, -1200), "2": ("f", "acc", b, 3, 550), "3": ("g", "acc", b, 3, 550), "4": ("g", "acc", c, 5, 550)}
    assert len({r.dedup_key for r in got.values()}) == 4 and got["2"].dedup_key[:-1] == got["3"].dedup_key[:-1] and got["3"].dedup_key.endswith("#1")
    states = spark.createDataFrame([("h", "f", "INTERPRETED"), ("h", "g", "INGESTED"), ("h", "x", "INTERPRETED")], "household_id string, import_id string, status string")
    assert [tuple(r) for r in ingest.reopened(rewritten, states).collect()] == [("h", "f", "INGESTED")]
    mixed = facts.withColumn("account_id", F.col("id"))
    with pytest.raises(Exception, match="facts of two accounts"):
        ingest.fix_profile(given, mixed)[0].collect()


def test_an_extractor_that_fails_fails_its_file_whole(spark):
    def extract(content):
        if content == b"none":
            raise ModuleNotFoundError("reader")
        yield [(1, 2, 3, "a"), (4, 5, 6, None)]
        if content == b"late":
            raise KeyError("second page")
        yield [] if content == b"short" else [(7, 8, 9, "b")]

    def nothing(content):
        return []

    shape = "household_id string, file_id string, content binary, page string"
    files = spark.createDataFrame([("h", f, c, "clash") for f, c in (("1", b"good"), ("2", b"late"), ("3", b"none"), ("4", None), ("5", b"short"))], shape)
    items, failed = positioned.items_from_bytes(files, extract)
    assert sorted((r.file_id, r.page, r.x, r.text or "") for r in items.collect()) == [("1", 0, 1.0, "a"), ("1", 0, 4.0, ""), ("1", 1, 7.0, "b"), ("5", 0, 1.0, "a"), ("5", 0, 4.0, "")]
    assert {(r.file_id, r.reason, r.error) for r in failed.collect()} == {("2", "extraction-failed", "KeyError"), ("3", "module-unavailable", "ModuleNotFoundError"), ("4", "extraction-failed", "ValueError")}
    for files in (files.limit(0), files.where("file_id = '1'")):
        assert [x.count() for x in positioned.items_from_bytes(files, nothing)] == [0, 0]


def test_cells_of_quoted_lines_and_old_bytes(spark):
    lines = {'"a;b";c': ["a;b", "c"], '"";x': ["", "x"], '"a""b"c"d;e': ['a"bc"d', "e"], 'a"b;"c;d': ['a"b', "c;d"], '"' + "x" * 20000 + '";"y': ["x" * 20000, "y"], ';"";': ["", "", ""]}
    assert [r[0] for r in spark.createDataFrame([(x,) for x in lines], "line string").select(delimited.fields(F.col("line"), F.lit(";"))).collect()] == list(lines.values())
    files = spark.createDataFrame([("h", "a", b"\x80\x81\xe9"), ("h", "b", b"\xef\xbb\xbf\xef\xbb\xbfx"), ("h", "c", None)], "household_id string, file_id string, content binary")
    read = delimited.decoded(files)
    assert [r[0] for r in read.select("text").collect()] == ["€\x81é", "﻿x", None]
    assert "MapInArrow" not in read._jdf.queryExecution().toString()


def test_files_of_one_kind_are_decided_once_and_their_lines_stay(spark):
    content = lambda said: f"Datum;A;B;Bedrag\n01/02/2026;{said};-1,00\n02/02/2026;{said};2,00"
    rows = [("h", f"f{i}", content("x;a longer text" if i % 2 else "a longer text;x").encode()) for i in range(20)]
    files = spark.createDataFrame(rows, "household_id string, file_id string, content binary")
    found = profile.infer(files)
    assert {(int(r.file_id[1:]) % 2, r.spec.columns.description) for r in found.collect()} == {(1, 2), (0, 1)}
    plan = profile.column_statistics(files, spark.createDataFrame([("h", "f0", "utf-8", ";", 1, None)], "household_id string, file_id string, encoding string, delimiter string, first_data int, reason string"))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "MapInArrow" not in plan


def test_pages_come_to_python_many_in_a_batch(spark):
    runs = [("h", "f", p, 10.0 + p, 5.0 - (i % 2), 3.0, t) for p in range(50) for i, t in enumerate(("b", " ", "a"))] + [("h", "f", 50, 50.0, None, 1.0, "last"), ("h", "f", 50, 1.0, 9.0, 1.0, "first"), ("h", "f", 50, 1.0, 9.0, 1.0, None)]
    items = spark.createDataFrame(runs, "household_id string, file_id string, page int, x double, y double, width double, text string")
    found = positioned.lines(items)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    rows = {(r.page, r.line_no): r.text for r in found.collect()}
    assert len(rows) == 51 and rows[50, 0] == "first last" and all("a" in rows[p, 0] and "b" in rows[p, 0] for p in range(50))
