"""Interpretation of facts: rings, flows, exclusive matching, reconciliation.

Facts: household_id, id, account_id, import_id, booking_date, amount_cents (bigint), description, counterparty_iban,
counterparty_name. Accounts: household_id, id, role (POT or RESERVE), iban, label. Every join and grouping carries
household_id. Declarations are small next to facts, yet nothing here broadcasts them by force: the planner does where
their size allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.constants import CASH, SETTLEMENT_CREDIT, SETTLEMENT_DAYS, SETTLEMENT_DEBIT, TRANSFER_DAYS
from tallyloom.functions.dates import day_distance
from tallyloom.functions.text import counterparty_text, refund_key
from tallyloom.operators.joins import HASH, hashed_join, key_hash
from tallyloom.operators.numbering import numbered
from tallyloom.staging import staged

H = "household_id"


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?i){pattern}")


def rings(accounts: DataFrame) -> DataFrame:
    """accounts with `ring`: reserve, pot or card (a pot account without IBAN); a reserve without IBAN is in none."""
    reserve, bare = F.col("role") == "RESERVE", F.col("iban").isNull()
    ring = F.when(reserve & ~bare, "reserve").when(reserve, None).when(bare, "card").otherwise("pot")
    return accounts.withColumn("ring", ring)


def pot_facts(facts: DataFrame, accounts: DataFrame) -> DataFrame:
    """Facts on pot and card accounts, with is_card and the account's own IBAN."""
    own = rings(accounts).where("role = 'POT'").select(H, F.col("id").alias("account_id"), F.col("iban").alias("own_iban"), (F.col("ring") == "card").alias("is_card"))
    return hashed_join(facts, own, [H, "account_id"])


def known_facts(facts: DataFrame, accounts: DataFrame) -> DataFrame:
    """`pot_facts` with what accounts say of the other side (to_reserve, to_pot; IBANs are compared as they stand) and
    `asks` (a settlement debit by its text), written. All of an interpretation reads these rows, so facts meet the accounts
    once, however many accounts there are."""
    owned = rings(accounts).where("ring IN ('reserve', 'pot')").select(H, F.col("iban").alias("counterparty_iban"), (F.col("ring") == "reserve").alias("r"))
    owned = owned.groupBy(H, "counterparty_iban").agg(F.max("r").alias("to_reserve"), F.max(~F.col("r")).alias("to_pot"))
    rows = hashed_join(pot_facts(facts, accounts), owned, [H, "counterparty_iban"], "left", spread="id")
    asks = (F.col("amount_cents") < 0) & matches(F.col("description"), SETTLEMENT_DEBIT)
    flags = (F.coalesce(c, F.lit(False)).alias(name) for c, name in ((F.col("to_reserve"), "to_reserve"), (F.col("to_pot"), "to_pot"), (asks, "asks")))
    return staged(rows.select(*facts.columns, "own_iban", "is_card", *flags), "known")


def card_imports(facts: DataFrame, accounts: DataFrame) -> DataFrame:
    """Per import on a card account: the sum of its debits and its last day."""
    return _card_imports(pot_facts(facts, accounts))


def _card_imports(pot: DataFrame) -> DataFrame:
    debit = F.when(F.col("amount_cents") < 0, -F.col("amount_cents")).otherwise(0)
    return pot.where("is_card").groupBy(H, "import_id").agg(F.min("account_id").alias("account_id"), F.sum(debit).alias("settlement_total_cents"), F.max("booking_date").alias("period_end"))


def import_periods(facts: DataFrame) -> DataFrame:
    return facts.groupBy(H, "import_id").agg(F.min("booking_date").alias("period_start"), F.max("booking_date").alias("period_end"))


def outgoing_keys(facts: DataFrame, accounts: DataFrame) -> DataFrame:
    """Distinct refund keys of everything that ever went out of the pot, whatever the date."""
    return _parties(pot_facts(facts, accounts)).where("went").select(H, "refund_key").distinct()


def _party(iban: Column, name: Column, description: Column) -> Column:
    """What a refund key is made of, as it stands: rows have one key if they have this in common."""
    return F.when(iban.isNotNull(), F.concat(F.lit("iban:"), iban)).otherwise(F.concat(F.lit("text:"), counterparty_text(name, description)))


def _parties(rows: DataFrame, *more: Column) -> DataFrame:
    """(household_id, counterparty_iban, party, refund_key, went, came): once for each party, whether money ever went to it
    and came from it, and what else is asked of its rows. Keys cost much, so they are made of parties, written for no
    filter on a key to move onto all rows."""
    iban, text, cents = F.col("counterparty_iban"), F.col("text"), F.col("amount_cents")
    told = rows.withColumn("text", F.when(iban.isNull(), counterparty_text(F.col("counterparty_name"), F.col("description"))))
    told = staged(told.groupBy(H, "counterparty_iban", "text").agg(F.max(cents < 0).alias("went"), F.max(cents > 0).alias("came"), *more), "parties")
    return told.withColumns({"party": _party(iban, text, text), "refund_key": refund_key(iban, text, text)}).drop("text")


def settlement_debits(facts: DataFrame, accounts: DataFrame) -> DataFrame:
    return _debits(pot_facts(facts, accounts).where((F.col("amount_cents") < 0) & matches(F.col("description"), SETTLEMENT_DEBIT)))


def _debits(asking: DataFrame) -> DataFrame:
    return asking.select(H, F.col("id").alias("debit_id"), F.col("account_id").alias("debit_account"), (-F.col("amount_cents")).alias("cents"), F.col("booking_date").alias("debit_date"))


def settlement_cards(facts: DataFrame, accounts: DataFrame) -> DataFrame:
    return cards_of(pot_facts(facts, accounts))


def cards_of(pot: DataFrame) -> DataFrame:
    """`settlement_cards` of rows that are `pot_facts` already."""
    cards = _card_imports(pot).where("settlement_total_cents > 0")
    return cards.select(H, F.col("import_id").alias("card_import_id"), F.col("account_id").alias("card_account"), F.col("settlement_total_cents").alias("cents"), "period_end")


def settlement_candidates(facts: DataFrame, accounts: DataFrame) -> DataFrame:
    """Settlement debits with the card imports whose total they could pay: an equi-join on the amount, days as residue."""
    return _candidates(settlement_debits(facts, accounts), settlement_cards(facts, accounts))


def _candidates(debits: DataFrame, cards: DataFrame) -> DataFrame:
    near = hashed_join(debits, cards, [H, "cents"]).withColumn("distance", day_distance(F.col("debit_date"), F.col("period_end")))
    return near.where((F.col("debit_account") != F.col("card_account")) & (F.col("distance") <= SETTLEMENT_DAYS))


def payable(debits: DataFrame, cards: DataFrame) -> DataFrame:
    """(household_id, cents, debit_date, debit_account), once each, of the debits that have a candidate. Days and accounts
    are compared once each, as an amount that comes up often would give pairs by the square of its number."""
    told = [H, "cents", "debit_date", "debit_account"]
    ends = cards.groupBy(H, "cents", "period_end").agg(F.min("card_account").alias("_low"), F.max("card_account").alias("_high"))
    near = hashed_join(debits.select(*told).distinct(), ends, [H, "cents"]).where(day_distance(F.col("debit_date"), F.col("period_end")) <= SETTLEMENT_DAYS)
    other = (F.col("_low") != F.col("debit_account")) | (F.col("_high") != F.col("debit_account"))
    return near.where(other).select(*told).distinct()


def refunded(known: DataFrame, paid: DataFrame | None = None) -> DataFrame:
    """(household_id, party): those outside the household's rings that money came from and that were ever paid."""
    parties = _parties(known, F.max(~F.col("to_reserve") & ~F.col("to_pot")).alias("outside"))
    paid = parties.where("went").select(H, "refund_key").distinct() if paid is None else paid
    return hashed_join(parties.where("came AND outside"), paid, [H, "refund_key"], "left_semi").select(H, "party").distinct()


def classify(facts: DataFrame, accounts: DataFrame, paid: DataFrame | None = None) -> DataFrame:
    """Facts of the pot with flow, is_cash, mirror_credit and pattern_debit (a settlement debit that has a candidate).

    Order of the rules: reserve, pot, settlement, outgoing, refund, incoming, nothing. IBANs are compared as they stand.
    `paid` (household_id, refund_key) is what ever went out, where facts are only a part of the ledger.
    """
    internal, others = classified(known_facts(facts, accounts), paid)
    return internal.unionByName(others)


def classified(known: DataFrame, paid: DataFrame | None = None, cards: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """`classify` of `known_facts`: the rows of flow INTERNAL, and all others. `cards`: the `settlement_cards`, if they are
    there already.

    Only settlement debits meet the imports, and are written with what these say; parties that were paid are written too:
    where they are few, the planner then knows, and what is left is a filter and a look-up of each row as it is read.
    Rows that nothing was received by have no key there. The flow of internal rows is a literal, so who asks for other
    flows does not read them.
    """
    told = {"cents": -F.col("amount_cents"), "debit_date": F.col("booking_date"), "debit_account": F.col("account_id")}
    asking = known.where("asks").withColumns(told)
    cards = staged(cards_of(known), "cards") if cards is None else cards
    asking = hashed_join(asking, payable(asking, cards).withColumn("has_import", F.lit(True)), [H, *told], "left")
    asking = staged(asking.select(*known.columns, F.coalesce("has_import", F.lit(False)).alias("has_import")), "asking")
    paid = staged(refunded(known, paid), "refunded").select(H, F.col("party").alias("_party"), F.lit(True).alias("paid_before"))
    rows = known.where("NOT asks").withColumn("has_import", F.lit(False)).unionByName(asking)
    plain = ~F.col("to_reserve") & ~F.col("to_pot")
    amount, said = F.col("amount_cents"), F.col("description")
    mirror = plain & (amount > 0) & F.col("is_card") & matches(said, SETTLEMENT_CREDIT)
    debit = plain & F.col("asks")
    cash = plain & ~debit & (amount < 0) & matches(said, CASH)
    inner = F.coalesce(~F.col("to_reserve") & (F.col("to_pot") | mirror | (debit & F.col("has_import"))), F.lit(False))
    party = _party(F.col("counterparty_iban"), F.col("counterparty_name"), said)
    others = hashed_join(rows.where(~inner).withColumn("_party", F.when(amount > 0, party)), paid, [H, "_party"], "left", spread="id")
    flow = (
        F.when(F.col("to_reserve"), "RESERVE")
        .when(amount < 0, "SPEND")
        .when((amount > 0) & F.col("paid_before").isNotNull(), "SPEND")
        .when(amount > 0, "INCOME")
        .otherwise("UNRESOLVED")
    )
    columns = [c for c in known.columns if c not in ("to_reserve", "to_pot", "asks")]
    marks = (cash.alias("is_cash"), mirror.alias("mirror_credit"), (debit & F.col("has_import")).alias("pattern_debit"))
    return rows.where(inner).select(*columns, F.lit("INTERNAL").alias("flow"), *marks), others.select(*columns, flow.alias("flow"), *marks)


def _islands(edges: DataFrame, keys: list[str], day: str, gap: int) -> DataFrame:
    """Splits components further where no edge can reach across: days more than `gap` apart. Bounds what one task matches."""
    by = Window.partitionBy(*keys).orderBy(day)
    far = F.coalesce(F.date_diff(F.col(day), F.lag(day).over(by)) > gap, F.lit(True))
    return edges.withColumn("_far", far.cast("int")).withColumn("island", F.sum("_far").over(by.rangeBetween(Window.unboundedPreceding, 0))).drop("_far")


#: Edges of one component that one Python task walks at once; larger components go by rounds of so many.
WALKED = 1_000_000


def greedy(edges: DataFrame, component: list[str], left: str, right: str, order: list[str], walked: int = WALKED) -> DataFrame:
    """Edges that a walk in `order` takes, each end used once. Components (no nulls) are matched apart from each other;
    `order` tells all edges of a component apart.

    Components of more than `walked` edges go by rounds. A round walks the first `walked` edges that are left of each, on
    which later ones have no bearing, and takes besides every edge that is first at both of its ends, as the walk would
    whatever came before; then all edges at used ends go. Each edge walked is taken or meets a taken one, so `walked` edges
    or more go in each round: a component of n edges is done in n / walked rounds, rounded up, however many of them tie."""
    names = [*component, left, right]
    kinds = dict(edges.dtypes)
    shape = ", ".join(f"{n} {kinds[n]}" for n in names)
    walked = max(walked, 1)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # components follow each other in a task's rows, each in its order, over however many batches
        at, used = None, set()
        for b in batches:
            kept = []
            for of, x, y in zip(zip(*(b.column(c).to_pylist() for c in component)), b.column(left).to_pylist(), b.column(right).to_pylist()):
                if of != at:
                    at, used = of, set()
                free = ("l", x) not in used and ("r", y) not in used
                if free:
                    used |= {("l", x), ("r", y)}
                kept.append(free)
            yield b.filter(pa.array(kept, pa.bool_())).select(names)

    def walks(some: DataFrame) -> DataFrame:
        """A call and a frame for each component would cost more than its few edges."""
        return some.repartition(*component).sortWithinPartitions(*component, *order).mapInArrow(walk, shape)

    parts, edges = [], staged(edges, "edges")
    while True:
        sizes = staged(edges.groupBy(*component).agg(F.count(F.lit(1)).alias("_n")), "sizes")
        alone, few, many = (edges.join(sizes.where(which).select(*component), component, "left_semi") for which in ("_n = 1", F.col("_n").between(2, walked), F.col("_n") > walked))
        # an edge alone in its component is taken as it is; only contested ones are walked in Python
        parts.append(alone.select(*names))
        parts.append(walks(few))
        if sizes.where(F.col("_n") > walked).isEmpty():
            return reduce(DataFrame.unionByName, parts)
        place = F.struct(*order)
        first = [F.min(place).over(Window.partitionBy(*component, end)) for end in (left, right)]
        sure = many.select(*names, (place == first[0]).alias("_l"), (place == first[1]).alias("_r")).where("_l AND _r").select(*names)
        ahead = numbered(many, component, order, "_place").where(F.col("_place") <= walked)
        won = staged(walks(ahead).unionByName(sure).distinct(), "won")
        parts.append(won)
        edges = staged(many.join(won.drop(right), [*component, left], "left_anti").join(won.drop(left), [*component, right], "left_anti"), "edges")


def allocate_settlements(flows: DataFrame, facts: DataFrame, accounts: DataFrame, cards: DataFrame | None = None) -> DataFrame:
    """(household_id, debit_id, card_import_id, card_account, cents, debit_date): nearest first, then ids; each side once.
    `cards`: the `settlement_cards`, if they are there already."""
    cards = staged(settlement_cards(facts, accounts), "cards") if cards is None else cards
    wanted = flows.where("pattern_debit").select(H, F.col("id").alias("debit_id"), F.col("account_id").alias("debit_account"), (-F.col("amount_cents")).alias("cents"), F.col("booking_date").alias("debit_date"), "is_card")
    return match_settlements(staged(wanted, "wanted"), cards)


def match_settlements(debits: DataFrame, cards: DataFrame) -> DataFrame:
    """What `greedy` makes of the candidates (nearest first, then ids). Debits of one amount and day are as far from all
    imports of that total that end on one day. Where each of two such groups is the other's nearest and no third is as near,
    nothing comes before their edges, so they pair off by their ids and are numbered against each other here; only what one
    side has more of, and groups with a rival, meet as edges. Amounts that recur many times thus give no edges by the
    square of their number. A debit on a card account may be barred from its own imports: its amount goes the long way."""
    left, right = [H, "cents", "debit_date"], [H, "cents", "period_end"]
    barred = debits.where("is_card").select(H, "cents").distinct()
    groups = hashed_join(debits.select(*left).distinct(), barred, [H, "cents"], "left_anti")
    near = hashed_join(groups, cards.select(*right).distinct(), [H, "cents"]).withColumn("distance", day_distance(F.col("debit_date"), F.col("period_end")))
    near = near.where(F.col("distance") <= SETTLEMENT_DAYS)
    for keys, name in ((left, "_l"), (right, "_r")):
        by = Window.partitionBy(HASH, *keys).orderBy("distance")
        lead = (F.row_number().over(by) == 1) & (F.coalesce(F.lead("distance").over(by), F.lit(-1)) != F.col("distance"))
        near = near.withColumn(HASH, key_hash(keys)).withColumn(name, lead).drop(HASH)
    near = staged(near.where("_l AND _r").select(H, "cents", "debit_date", "period_end"), "near")

    def numbers(side: DataFrame, keys: list[str], of: str) -> DataFrame:
        some = hashed_join(side, near, keys).withColumn(HASH, key_hash(keys))
        return some.withColumn("_number", F.row_number().over(Window.partitionBy(HASH, *keys).orderBy(of))).drop(HASH)

    ins = numbers(cards, right, "card_import_id").select(*left, "_number", "card_import_id", "card_account")
    sure = staged(hashed_join(numbers(debits, left, "debit_id").select(*left, "_number", "debit_id"), ins, [*left, "_number"]), "sure")
    names = [H, "debit_id", "card_import_id", "card_account", "cents", "debit_date"]
    rest = hashed_join(debits, sure.select(H, "debit_id"), [H, "debit_id"], "left_anti")
    open_ = hashed_join(cards, sure.select(H, "card_import_id"), [H, "card_import_id"], "left_anti")
    known = staged(_candidates(rest, open_), "known")
    edges = _islands(known, [H, "cents"], "debit_date", 2 * SETTLEMENT_DAYS)
    taken = greedy(edges, [H, "cents", "island"], "debit_id", "card_import_id", ["distance", "debit_id", "card_import_id"])
    taken = hashed_join(taken.select(H, "debit_id", "card_import_id"), known, [H, "debit_id", "card_import_id"])
    return sure.select(*names).unionByName(taken.select(*names))


def assign_mirrors(flows: DataFrame, settled: DataFrame) -> DataFrame:
    """(household_id, debit_id, credit_id): debits in the order of their ids take the nearest credit left, if any."""
    credits = flows.where("mirror_credit").select(H, F.col("id").alias("credit_id"), F.col("account_id").alias("card_account"), F.col("amount_cents").alias("cents"), F.col("booking_date").alias("credit_date"))
    edges = settled.join(credits, [H, "card_account", "cents"]).withColumn("distance", day_distance(F.col("debit_date"), F.col("credit_date"))).where(F.col("distance") <= TRANSFER_DAYS)
    edges = _islands(edges, [H, "card_account", "cents"], "debit_date", 2 * TRANSFER_DAYS)
    return greedy(edges, [H, "card_account", "cents", "island"], "debit_id", "credit_id", ["debit_id", "distance", "credit_id"]).select(H, "debit_id", "credit_id")


def transfer_candidates(legs: DataFrame) -> DataFrame:
    """Pairs of opposite legs that name each other's account within the days: an equi-join on household, amount and both IBANs."""
    out = legs.where("amount_cents < 0").select(H, F.col("id").alias("out_id"), F.col("account_id").alias("out_account"), (-F.col("amount_cents")).alias("cents"), F.col("booking_date").alias("out_date"), F.col("own_iban").alias("from_iban"), F.col("counterparty_iban").alias("to_iban"))
    inn = legs.where("amount_cents > 0").select(H, F.col("id").alias("in_id"), F.col("account_id").alias("in_account"), F.col("amount_cents").alias("cents"), F.col("booking_date").alias("in_date"), F.col("counterparty_iban").alias("from_iban"), F.col("own_iban").alias("to_iban"))
    near = hashed_join(out, inn, [H, "cents", "from_iban", "to_iban"]).withColumn("distance", day_distance(F.col("out_date"), F.col("in_date")))
    return near.where((F.col("distance") <= TRANSFER_DAYS) & (F.col("out_account") != F.col("in_account")))


def pair_transfers(candidates: DataFrame) -> DataFrame:
    """(household_id, out_id, in_id): nearest first, then ids; each leg once."""
    edges = _islands(candidates, [H, "cents", "from_iban", "to_iban"], "out_date", 2 * TRANSFER_DAYS)
    return greedy(edges, [H, "cents", "from_iban", "to_iban", "island"], "out_id", "in_id", ["distance", "out_id", "in_id"]).select(H, "out_id", "in_id")


def match_transfers(legs: DataFrame) -> DataFrame:
    """(household_id, out_id, in_id): what `pair_transfers` makes of the candidates among the legs. Legs of one day come
    first there and pair off by their ids, so they are numbered against each other here; only what one side has more of
    meets the legs of other days. Amounts that recur many times a day thus give no edges by the square of their number."""
    ends_of = [H, "_cents", "_from", "_to", "booking_date"]
    day = [HASH, *ends_of]  # sorted by the hash first, as texts of one household begin alike
    out = F.col("amount_cents") < 0
    own, other = F.col("own_iban"), F.col("counterparty_iban")
    ends = legs.where((F.col("amount_cents") != 0) & own.isNotNull() & other.isNotNull())
    ends = ends.select(H, "id", "account_id", "booking_date", "amount_cents", "own_iban", "counterparty_iban", out.alias("_out"), F.abs("amount_cents").alias("_cents"), F.when(out, own).otherwise(other).alias("_from"), F.when(out, other).otherwise(own).alias("_to")).withColumn(HASH, key_hash(ends_of))
    across = F.sum(F.when(F.col("_out"), 1).otherwise(0)).over(Window.partitionBy(*day))
    total = F.count(F.lit(1)).over(Window.partitionBy(*day))
    number = F.row_number().over(Window.partitionBy(*day, "_out").orderBy("id"))
    ends = ends.withColumn("_number", number).withColumn("_across", F.when(F.col("_out"), total - across).otherwise(across))
    # one IBAN on both sides may be one account, which is no transfer: such legs go the long way
    ends = staged(ends.withColumn("_same", (F.col("_from") != F.col("_to")) & (F.col("_number") <= F.col("_across"))), "legs")
    same = ends.where("_same")
    outs = same.where("_out").select(*day, "_number", F.col("id").alias("out_id"))
    ins = same.where("NOT _out").select(*day, "_number", F.col("id").alias("in_id"))
    rest = pair_transfers(transfer_candidates(ends.where("NOT _same")))
    return outs.join(ins, [*day, "_number"]).select(H, "out_id", "in_id").unionByName(rest)


def reconcile(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sums by flow over interpreted rows (flow not null), and the two gaps; rows carry flow and is_unmatched."""
    cents, flow = F.col("amount_cents"), F.col("flow")
    total = lambda c: F.coalesce(F.sum(F.when(c, cents)), F.lit(0)).cast("long")
    out = rows.where("flow IS NOT NULL").groupBy(*by).agg(
        total(flow == "INCOME").alias("income_cents"),
        (-total(flow == "SPEND")).alias("spend_cents"),
        (-total(flow == "RESERVE")).alias("net_to_reserves_cents"),
        F.sum(cents).alias("change_in_pot_cents"),
        total(flow == "UNRESOLVED").alias("unresolved_gap_cents"),
        total(F.col("is_unmatched")).alias("unmatched_internal_gap_cents"),
    )
    difference = F.col("change_in_pot_cents") - (F.col("income_cents") - F.col("spend_cents") - F.col("net_to_reserves_cents"))
    return out.withColumn("difference_cents", difference).withColumn("reconciles", difference == 0)
