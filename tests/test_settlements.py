"""Settlements of amounts that come up often: matched as a walk over all candidates would, without making all of them."""

import datetime as dt
import random

from tallyloom.operators import ledger
from tallyloom.plans.interpret import interpret

FACT = "household_id string, id string, account_id string, import_id string, booking_date date, amount_cents long, description string, counterparty_iban string, counterparty_name string"
ACCOUNT = "household_id string, id string, role string, iban string, label string"
ACCOUNTS = [("h", "a", "POT", "BE1", "A"), *(("h", f"card{k}", "POT", None, "Card") for k in range(3))]
D0 = dt.date(2026, 8, 1)


def fact(i, account, day, cents, said, imported):
    return ("h", i, account, imported, D0 + dt.timedelta(day), cents, said, None, None)


def settled(spark, rows):
    facts, accounts = spark.createDataFrame(rows, FACT), spark.createDataFrame(ACCOUNTS, ACCOUNT)
    return sorted((r.outgoing_id, r.card_import_id) for r in interpret(facts, accounts).links.where("card_import_id IS NOT NULL").collect())


def brute(rows):
    last, of = {}, {}
    for _, _, account, imported, day, cents, *_ in rows:
        if account.startswith("card"):
            last[imported], of[imported] = max(day, last.get(imported, day)), account
    total = {m: sum(-r[5] for r in rows if r[3] == m and r[5] < 0) for m in last}
    debits = [r for r in rows if r[5] < 0 and "AFREKENING" in r[6]]
    edges = sorted((abs((r[4] - last[m]).days), r[1], m) for r in debits for m in last if total[m] == -r[5] and of[m] != r[2] and abs((r[4] - last[m]).days) <= 45)
    used, out = set(), []
    for _, d, m in edges:
        if ("d", d) not in used and ("m", m) not in used:
            used |= {("d", d), ("m", m)}
            out.append((d, m))
    return sorted(out)


def test_equal_settlements_give_no_square_of_edges(spark, monkeypatch):
    n, counts, staged = 30, {}, ledger.staged

    def counted(df, name="step"):
        found = staged(df, name)
        counts[name] = counts.get(name, 0) + found.count()
        return found

    monkeypatch.setattr(ledger, "staged", counted)
    rows = [fact(f"c{k:02}", "card0", 0, -1000, "item", f"m{k:02}") for k in range(n)] + [fact(f"s{k:02}", "a", 10, -1000, "MASTERCARD AFREKENING NUMMER 1", "i") for k in range(n + 2)]
    assert settled(spark, rows) == [(f"s{k:02}", f"m{k:02}") for k in range(n)] == brute(rows)
    assert max(counts.values()) <= 3 * n


def test_settlements_equal_a_walk_over_all_candidates(spark):
    for seed in range(4):
        pick = random.Random(seed)
        rows = [fact(f"c{k:02}", f"card{pick.randrange(3)}", pick.choice([0, 3, 6, 40, 60]), -pick.choice([500, 700]), "item", f"m{k:02}") for k in range(24)]
        sides = ["a"] if seed % 2 == 0 else ["a", "a", "a", "card0"]
        rows += [fact(f"s{k:02}", pick.choice(sides), pick.choice([2, 9, 10, 50, 120]), -pick.choice([500, 700]), "MASTERCARD AFREKENING NUMMER 1", f"i{k:02}") for k in range(30)]
        assert settled(spark, rows) == brute(rows), seed
