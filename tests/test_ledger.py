import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import dedup, ledger, merchants
from tallyloom.plans import month
from tallyloom.plans.interpret import interpret

FACT = "household_id string, id string, account_id string, import_id string, booking_date date, amount_cents long, description string, counterparty_iban string, counterparty_name string"
ACCOUNT = "household_id string, id string, role string, iban string, label string"
ACCOUNTS = [("h", "a", "POT", "BE1", "A"), ("h", "b", "POT", "BE2", "B"), ("h", "card", "POT", None, "Card"), ("h", "r", "RESERVE", "BE9", "Savings")]
D0 = dt.date(2026, 8, 1)


def fact(i, account, day, cents, said="x", iban=None, name=None, imported=None):
    return ("h", i, account, imported or f"{account}-i", D0 + dt.timedelta(day), cents, said, iban, name)


def run(spark, rows, accounts=ACCOUNTS):
    return interpret(spark.createDataFrame(rows, FACT), spark.createDataFrame(accounts, ACCOUNT))


def flows(found):
    return {r.id: r.flow for r in found.rows.collect()}


def test_every_flow(spark):
    rows = [
        fact("in", "a", 0, 5000, name="BOSS"), fact("out", "a", 1, -300, name="Shop"), fact("back", "a", 0, 200, name=" shop "), fact("cash", "a", 2, -1000, "GELDOPNAME"),
        fact("park", "a", 2, -500, iban="BE9"), fact("draw", "a", 3, 100, iban="BE9"), fact("t1", "a", 4, -700, iban="BE2"), fact("t2", "b", 8, 700, iban="BE1"),
        fact("lone", "a", 4, -50, iban="BE2"), fact("zero", "a", 5, 0), fact("alien", "r", 5, 900),
    ]
    found = run(spark, rows)
    assert flows(found) == {"in": "INCOME", "out": "SPEND", "back": "SPEND", "cash": "SPEND", "park": "RESERVE", "draw": "RESERVE", "t1": "INTERNAL", "t2": "INTERNAL", "lone": "INTERNAL", "zero": "UNRESOLVED"}
    assert [r.id for r in found.rows.where("is_unmatched").collect()] == ["lone"]
    assert [(r.outgoing_id, r.incoming_id) for r in found.links.collect()] == [("t1", "t2")]
    assert [r.id for r in found.rows.where("is_cash").collect()] == ["cash"]


def test_days_and_ties_of_transfers(spark):
    rows = [fact("o1", "a", 0, -10, iban="BE2"), fact("o2", "a", 0, -10, iban="BE2"), fact("i1", "b", 1, 10, iban="BE1"), fact("o3", "a", 20, -10, iban="BE2"), fact("i3", "b", 25, 10, iban="BE1")]
    found = run(spark, rows)
    assert [(r.outgoing_id, r.incoming_id) for r in found.links.collect()] == [("o1", "i1")]  # equal distance: the smaller id; five days are too many
    assert sorted(r.id for r in found.rows.where("is_unmatched").collect()) == ["i3", "o2", "o3"]


def test_settlement_with_mirror_and_a_loser(spark):
    debit = "MASTERCARD AFREKENING NUMMER 7"
    rows = [fact("c1", "card", 0, -600, imported="m1"), fact("c2", "card", 3, -400, imported="m1"), fact("s1", "a", 10, -1000, debit), fact("s2", "a", 12, -1000, debit), fact("m", "card", 11, 1000, "Domiciliering via je bank", imported="m2"), fact("s3", "a", 12, -77, debit)]
    found = run(spark, rows)
    assert {k: v for k, v in flows(found).items() if k[0] in "sm"} == {"s1": "INTERNAL", "s2": "SPEND", "s3": "SPEND", "m": "INTERNAL"}
    assert [(r.outgoing_id, r.incoming_id, r.card_import_id) for r in found.links.collect()] == [("s1", "m", "m1")]


def test_figures_verdict_and_transit(spark):
    rows = [fact("in", "a", 0, 100000, name="BOSS"), fact("t1", "a", 30, -30000, iban="BE2"), fact("t2", "b", 32, 30000, iban="BE1"), fact("g1", "a", 3, -10, iban="BE2"), fact("g2", "b", 20, 10, iban="BE1")]
    found = run(spark, rows)
    got = {r.month: r for r in month.figures(found.rows, found.links).collect()}
    assert (got["2026-08"].income_cents, got["2026-08"].difference_cents, got["2026-08"].in_transit_count, got["2026-09"].difference_cents) == (100000, -30000, 1, 30000)
    assert got["2026-08"].unmatched_internal_cents == 0 and got["2026-08"].unmatched_internal_count == 2 and not got["2026-08"].reconciles
    gaps = month.gap_rows(found.rows, found.links, spark.createDataFrame(ACCOUNTS, ACCOUNT)).orderBy("booking_date", "id").collect()
    assert [(g.id, g.gap) for g in gaps] == [("g1", "unmatched-internal"), ("g2", "unmatched-internal"), ("t1", "in-transit"), ("t2", "in-transit")]


def brute(rows):
    """Greedy pairing of transfers by hand."""
    own = {a[1]: a[3] for a in ACCOUNTS}
    legs = [r for r in rows if r[7] in ("BE1", "BE2")]
    edges = sorted((abs((o[4] - i[4]).days), o[1], i[1]) for o in legs for i in legs if o[5] < 0 and i[5] == -o[5] and o[2] != i[2] and o[7] == own[i[2]] and i[7] == own[o[2]] and abs((o[4] - i[4]).days) <= 4)
    used, out = set(), set()
    for _, o, i in edges:
        if o not in used and i not in used:
            used |= {o, i}
            out.add((o, i))
    return out


def test_identity_and_pairs_on_random_ledgers(spark):
    r = random.Random(4)
    for case in range(3):
        rows = []
        for n in range(60):
            kind, day, cents = r.randrange(6), r.randrange(40), r.choice([100, 200, 300])
            rows.append([fact(f"{n:03}", "a", day, cents, name="B"), fact(f"{n:03}", "a", day, -cents, name=f"S{n % 4}"), fact(f"{n:03}", "a", day, -cents, iban="BE2"), fact(f"{n:03}", "b", day, cents, iban="BE1"), fact(f"{n:03}", "a", day, -cents, iban="BE9"), fact(f"{n:03}", "b", day, 0)][kind])
        found = run(spark, rows)
        assert {(x.outgoing_id, x.incoming_id) for x in found.links.collect()} == brute(rows)
        total = ledger.reconcile(found.rows, ["household_id"]).first()
        assert total.difference_cents == total.unresolved_gap_cents + total.unmatched_internal_gap_cents


def test_twins_of_one_day_and_later_days(spark):
    r = random.Random(7)
    rows = [fact(f"{n:03}", *r.choice([("a", r.randrange(9), -100), ("b", r.randrange(9), 100)]), iban="?") for n in range(80)]
    rows = [(*x[:7], "BE2" if x[2] == "a" else "BE1", None) for x in rows]
    found = run(spark, rows)
    assert {(x.outgoing_id, x.incoming_id) for x in found.links.collect()} == brute(rows)
    empty = ledger.match_transfers(found.rows.limit(0))
    assert empty.columns == ["household_id", "out_id", "in_id"] and empty.count() == 0


def test_greedy_by_rounds_equals_the_walk(spark):
    r = random.Random(9)
    rows = sorted({(f"c{r.randrange(3)}", f"o{r.randrange(12)}", f"i{r.randrange(12)}") for _ in range(150)})
    edges = spark.createDataFrame([(*x, r.randrange(3)) for x in rows], "c string, o string, i string, d int")
    want = []
    for c in ("c0", "c1", "c2"):
        used: set = set()
        for e in sorted((x.d, x.o, x.i) for x in edges.collect() if x.c == c):
            if not used & set(e[1:]):
                used |= set(e[1:])
                want.append((c, *e[1:]))
    for walked in (1, 12, 1000):
        got = ledger.greedy(edges, ["c"], "o", "i", ["d", "o", "i"], walked)
        assert sorted((x.c, x.o, x.i) for x in got.collect()) == sorted(want)


def test_ties_are_closed_in_bounded_rounds(spark, monkeypatch):
    """Each of 30 outs ties with each of 30 ins: of all edges one is first at both ends, so without the walk ahead it takes 30 rounds."""
    edges = spark.range(900).selectExpr("'c' AS c", "id div 30 AS o", "id % 30 AS i", "1 AS d")
    rounds = []
    whole = ledger.numbered
    monkeypatch.setattr(ledger, "numbered", lambda *a, **k: rounds.append(1) or whole(*a, **k))
    got = ledger.greedy(edges, ["c"], "o", "i", ["d", "o", "i"], walked=300)
    assert sorted((x.o, x.i) for x in got.collect()) == [(n, n) for n in range(30)]
    assert 1 <= len(rounds) <= 900 // 300


def test_rules_by_tier_and_specificity(spark):
    rules = [("h", "1", "m1", "PREFIX", "SHOP"), ("h", "2", "m2", "PREFIX", "SHOP 1"), ("h", "3", "m3", "EXACT", "SHOP 12"), ("h", "4", "m4", "PATTERN", "*OP*"), ("h", "5", "m5", "PATTERN", "*HOP*"), ("h", "6", "m6", "EXACT", ""), ("x", "7", "m7", "EXACT", "SHOP 3")]
    rules = spark.createDataFrame(rules, "household_id string, id string, merchant_id string, kind string, pattern string")
    keys = spark.createDataFrame([("h", t) for t in ("SHOP 12", "SHOP 13", "SHOP 3", "CHOPIN", "COPY", "", "NONE")], "household_id string, text string")
    assert {r.text: r.merchant_id for r in merchants.match_rules(keys, rules).collect()} == {"SHOP 12": "m3", "SHOP 13": "m2", "SHOP 3": "m1", "CHOPIN": "m5", "COPY": "m4"}


def test_globs_by_their_longest_literal(spark):
    import fnmatch
    import random

    r = random.Random(6)
    word = lambda n: "".join(r.choice("AB*") for _ in range(n))
    patterns = sorted({word(r.randint(1, 14)) for _ in range(120)} | {"*", "**", "*ABABABABAB*", "A*B", "*A.B*"})
    rules = spark.createDataFrame([("h", f"{n:03}", f"m{n}", "PATTERN", p) for n, p in enumerate(patterns)] + [("g", "x", "mg", "PATTERN", "*ABA*")], "household_id string, id string, merchant_id string, kind string, pattern string")
    texts = sorted({word(r.randint(1, 16)).replace("*", "C") for _ in range(150)} | {"XA.BX", "XABABABABABX"})
    keys = spark.createDataFrame([(h, t) for h in "gh" for t in texts], "household_id string, text string")
    want = {}
    for t in texts:
        fits = [(-len(p), p, f"{n:03}") for n, p in enumerate(patterns) if fnmatch.fnmatchcase(t, p)]
        want["h", t] = min(fits)[2]
        if "ABA" in t:
            want["g", t] = "x"
    assert {(x.household_id, x.text): x.rule_id for x in merchants.match_rules(keys, rules).collect()} == want
    # without a glob of stars alone no join is by household only
    some = merchants.match_rules(keys, rules.where("pattern = '*ABA*'"))
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "part" in plan


def test_dedup_ordinals_and_idempotent_ingest(spark):
    rows = spark.createDataFrame([("h", "a", f, n, D0, 100, "x", None, None, s, s and "1") for f, n, s in (("f", 1, None), ("f", 2, None), ("f", 3, "9"), ("g", 1, None))], "household_id string, account_id string, import_id string, line_no long, booking_date date, amount_cents long, description string, counterparty_name string, reference string, statement_number string, sequence_number string")
    keyed = dedup.with_keys(rows)
    keys = {(r.import_id, r.line_no): r.dedup_key for r in keyed.collect()}
    assert keys["f", 1].endswith("#0") and keys["f", 2] == keys["f", 1][:-1] + "1" and keys["g", 1] == keys["f", 1] and keys["f", 3] == "nat:a:9:1"
    added = dedup.new_rows(keyed, keyed.limit(0))
    assert {(r.import_id, r.rows_added, r.rows_known) for r in dedup.ingest_report(keyed, added).collect()} == {("f", 3, 0), ("g", 0, 1)}
    assert dedup.new_rows(keyed, added).count() == 0


def test_reparse_keeps_twins_in_order(spark):
    stored = spark.createDataFrame([("h", "p", 1, "f", "t1", "L", "h:x#0"), ("h", "p", 1, "f", "t2", "L", "h:x#1"), ("h", "p", 2, "g", "t3", "L", "h:x#2")], "household_id string, profile_id string, import_order int, import_id string, id string, raw_line string, dedup_key string")
    parsed = spark.createDataFrame([("h", "p", "f", 3, "L", "h:y#0"), ("h", "p", "f", 4, "L", "h:y#1"), ("h", "p", "g", 3, "L", "h:y#0")], "household_id string, profile_id string, import_id string, line_no long, raw_line string, dedup_key string")
    assert {r.id: (r.line_no, r.dedup_key) for r in dedup.align_reparse(stored, parsed).collect()} == {"t1": (3, "h:y#0"), "t2": (4, "h:y#1"), "t3": (3, "h:y#2")}


def test_groups_fold_and_deltas(spark):
    rows = spark.createDataFrame([("h", m, None, None, None, t, c, -n, 1) for m, t, c, n in (("2026-07", "Lidl Gent", False, 100), ("2026-08", "LIDL", False, 130), ("2026-08", "lidl", False, 20), ("2026-08", "x", True, 50))], "household_id string, month string, merchant_id string, merchant_name string, primary_tag string, counterparty_text string, is_cash boolean, total_cents long, row_count long")
    got = {(r.month, r.group_key): (r.total_cents, r.delta_cents) for r in month.with_deltas(month.folded(rows, True)).collect()}
    assert got == {("2026-07", "text:LIDL"): (-100, 100), ("2026-08", "text:LIDL"): (-150, 50), ("2026-08", "cash"): (-50, 50)}
    assert F.lit(1) is not None


def test_reparse_groups_rows_that_are_alike_and_wants_every_line(spark):
    stored = [("h", "p", n, f, i, raw, f"h:x{i}#0") for n, f, i, raw in ((1, "f", "a", "L 1"), (1, "f", "b", "L  1"), (2, "g", "c", "L 1"), (1, "f", "d", "M"), (2, "g", "e", "N"))]
    parsed = [("h", "p", "f", 1, "L 1", "h:y#0"), ("h", "p", "f", 2, "L  1", "h:y#1"), ("h", "p", "g", 1, "L 1", "h:y#0"), ("h", "p", "f", 3, "M", "nat:a:1:1"), ("h", "p", "g", 2, "N", "h:z#0"), ("h", "p", "g", 3, "never stored", "h:w#0")]
    shapes = ["household_id string, profile_id string, import_order int, import_id string, id string, raw_line string, dedup_key string", "household_id string, profile_id string, import_id string, line_no long, raw_line string, dedup_key string"]
    anew = spark.createDataFrame(parsed, shapes[1])
    found = {r.id: (r.line_no, r.dedup_key) for r in dedup.align_reparse(spark.createDataFrame(stored, shapes[0]), anew).collect()}
    assert found == {"a": (1, "h:y#0"), "b": (2, "h:y#1"), "c": (1, "h:y#2"), "d": (3, "nat:a:1:1"), "e": (2, "h:z#0")}
    with pytest.raises(Exception, match="no such line in its file: row lost"):
        dedup.align_reparse(spark.createDataFrame([("h", "p", 1, "f", "lost", "?", "h:x#0")], shapes[0]), anew).collect()


def test_assignment_moves_rules_and_names_new_merchants(spark):
    declared = spark.createDataFrame([("h", 1, " Corner ", "Shop 12"), ("h", 2, "Bakery", "shop 12"), ("h", 3, "Corner", "Cafe"), ("h", 4, " ", "x"), ("h", 5, "Corner", None), ("g", 6, "Corner", "Cafe")], "household_id string, at int, merchant_name string, counterparty_text string")
    known = spark.createDataFrame([("h", "m1", "Corner")], "household_id string, id string, name string")
    rules = spark.createDataFrame([("h", "r1", "m1", "EXACT", "CAFE"), ("h", "r2", "m1", "PREFIX", "SHOP"), ("h", "r3", "m1", "EXACT", "SHOP 12")], "household_id string, id string, merchant_id string, kind string, pattern string")
    named, after, problems = merchants.assigned(declared, known, rules)
    name = {(r.household_id, r.id): r.name for r in named.collect()}
    assert sorted((h, n) for (h, _), n in name.items()) == [("g", "Corner"), ("h", "Bakery"), ("h", "Corner")]
    assert {(r.household_id, r.kind, r.pattern): (r.id[:2], name[r.household_id, r.merchant_id]) for r in after.collect()} == {("h", "EXACT", "CAFE"): ("r1", "Corner"), ("h", "PREFIX", "SHOP"): ("r2", "Corner"), ("h", "EXACT", "SHOP 12"): ("r3", "Bakery"), ("g", "EXACT", "CAFE"): ("r:", "Corner")}
    assert {(r["at"], r.problem) for r in problems.collect()} == {(4, "empty-merchant-name"), (5, "empty-counterparty")}


def test_tagging_keeps_one_primary(spark):
    shape = "household_id string, merchant_id string, tag_id string, is_primary boolean"
    before = spark.createDataFrame([("h", "m", "a", True), ("h", "n", "a", True), ("h", "o", "a", True)], shape)
    declared = spark.createDataFrame([("h", "m", "b", True, 1), ("h", "m", "c", True, 2), ("h", "m", "c", False, 3), ("h", "n", "b", False, 4), ("h", "o", "b", True, 5), ("h", "o", "a", True, 6), ("g", "m", "a", True, 7), ("h", "m", "zz", True, 8)], shape + ", at int")
    of = spark.createDataFrame([("h", x) for x in "mnoabc"], "household_id string, id string")
    rows, foreign = merchants.tagged(before, declared, of, of)
    assert {(r.merchant_id, r.tag_id): r.is_primary for r in rows.collect()} == {("m", "a"): False, ("m", "b"): False, ("m", "c"): False, ("n", "a"): True, ("n", "b"): False, ("o", "a"): True, ("o", "b"): False}
    assert {r["at"] for r in foreign.collect()} == {7, 8}


def test_components_are_walked_many_in_a_batch(spark):
    rows = [("h", c, a, b, n) for c in range(40) for n, (a, b) in enumerate((("x", "p"), ("x", "q"), ("y", "p"), ("y", "q")))]
    edges = spark.createDataFrame(rows, "household_id string, c int, l string, r string, n int")
    taken = ledger.greedy(edges, ["household_id", "c"], "l", "r", ["n"])
    assert "FlatMapGroupsInPandas" not in taken._jdf.queryExecution().toString()
    assert sorted((r.c, r.l, r.r) for r in taken.collect()) == sorted((c, *e) for c in range(40) for e in (("x", "p"), ("y", "q")))
