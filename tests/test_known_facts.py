"""An interpretation reads its facts once, and writes no row again that a link cannot change."""

from test_settlements import ACCOUNT, ACCOUNTS, FACT, brute, fact

from tallyloom.operators import ledger
from tallyloom.plans import interpret as plan


def test_facts_meet_their_accounts_once(spark, monkeypatch):
    calls, met = [], ledger.pot_facts
    monkeypatch.setattr(ledger, "pot_facts", lambda *a: calls.append(1) or met(*a))
    written, staged = {}, plan.staged

    def counted(df, name="step"):
        written[name] = staged(df, name)
        return written[name]

    monkeypatch.setattr(plan, "staged", counted)
    rows = [fact("c0", "card0", 0, -1000, "item", "m0"), *(fact(f"s{k}", "a", 9 + k, -1000, "MASTERCARD AFREKENING NUMMER 1", "i") for k in range(2))]
    rows += [fact(f"x{k}", "a", k, -7, "SHOP", "i") for k in range(5)]
    found = plan.interpret(spark.createDataFrame(rows, FACT), spark.createDataFrame(ACCOUNTS, ACCOUNT))
    assert sorted((r.outgoing_id, r.card_import_id) for r in found.links.collect()) == brute(rows) == [("s0", "m0")]
    assert {r.id: (r.flow, r.is_unmatched) for r in found.rows.collect()} == {"c0": ("SPEND", False), "s0": ("INTERNAL", True), "s1": ("SPEND", False), **{f"x{k}": ("SPEND", False) for k in range(5)}}
    assert len(calls) == 1
    assert all(df.count() <= 2 for df in written.values())
