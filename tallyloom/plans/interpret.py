"""The whole interpretation as one lineage: facts and declarations in, flows, links, merchants and gaps out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.constants import PADDING_DAYS
from tallyloom.operators import ledger, merchants
from tallyloom.operators.joins import HASH, hashed_join, key_hash
from tallyloom.staging import staged

H = "household_id"


@dataclass
class Interpretation:
    """rows: pot facts with flow, is_cash, is_unmatched, merchant_id, normal_text. links: household_id, outgoing_id,
    incoming_id (null: a settlement without its mirror), card_import_id (null: a transfer)."""

    rows: DataFrame
    links: DataFrame


def interpret(facts: DataFrame, accounts: DataFrame, rules: DataFrame | None = None, paid: DataFrame | None = None) -> Interpretation:
    """Classify, allocate settlements (losers become spend), assign mirrors, pair what internal legs remain. `paid` as in
    `ledger.classify`. Facts are read once. Only internal rows can have a link, so these alone are written with their flow
    and meet the links; all others are found in the known facts as they are read."""
    known = ledger.known_facts(facts, accounts)
    cards = staged(ledger.cards_of(known), "cards")
    internal, others = ledger.classified(known, paid, cards)
    internal = staged(internal, "internal")  # read by each of the three matchings and by the rows
    settled = staged(ledger.allocate_settlements(internal, facts, accounts, cards), "settled")
    mirrors = ledger.assign_mirrors(internal, settled)
    pairs = ledger.match_transfers(internal.where("NOT pattern_debit AND NOT mirror_credit"))
    settlements = hashed_join(settled, mirrors, [H, "debit_id"], "left").select(H, F.col("debit_id").alias("outgoing_id"), F.col("credit_id").alias("incoming_id"), "card_import_id")
    links = settlements.unionByName(pairs.select(H, F.col("out_id").alias("outgoing_id"), F.col("in_id").alias("incoming_id"), F.lit(None).cast("string").alias("card_import_id")))
    links = staged(links, "links")
    won = links.where("card_import_id IS NOT NULL").select(H, F.col("outgoing_id").alias("id"), F.lit(True).alias("won"), F.lit(None).cast("boolean").alias("matched"))
    sides = matched_sides(links).select(H, "id", F.lit(None).cast("boolean").alias("won"), F.lit(True).alias("matched"))
    ends = won.unionByName(sides).groupBy(key_hash([H, "id"]).alias(HASH), H, "id").agg(F.max("won").alias("won"), F.max("matched").alias("matched"))
    met = internal.withColumn(HASH, key_hash([H, "id"])).join(ends, [HASH, H, "id"], "left").drop(HASH)
    flow = F.when(F.col("won").isNull(), "SPEND").otherwise("INTERNAL")
    debits = met.where("pattern_debit").withColumns({"flow": flow, "is_unmatched": F.col("won").isNotNull() & F.col("matched").isNull()})
    legs = met.where("NOT pattern_debit").withColumns({"flow": F.lit("INTERNAL"), "is_unmatched": F.col("matched").isNull()})
    rows = others.withColumn("is_unmatched", F.lit(False))
    for some in (debits, legs):
        rows = rows.unionByName(some.drop("won", "matched"))
    if rules is not None:
        rows = merchants.resolve(rows, rules)
    return Interpretation(rows, links)


def matched_sides(links: DataFrame) -> DataFrame:
    """Links whose both ends are known, once per end: (household_id, id, partner_id)."""
    both = links.where("incoming_id IS NOT NULL")
    return both.select(H, F.col("outgoing_id").alias("id"), F.col("incoming_id").alias("partner_id")).unionByName(both.select(H, F.col("incoming_id").alias("id"), F.col("outgoing_id").alias("partner_id")))


def window_facts(facts: DataFrame, accounts: DataFrame, imports: DataFrame) -> DataFrame:
    """The facts that interpreting some imports anew reads: their households' days with padding; card rows without bound,
    as a card statement counts whole."""
    span = ledger.import_periods(facts).join(imports, [H, "import_id"], "left_semi").groupBy(H).agg(F.date_sub(F.min("period_start"), PADDING_DAYS).alias("since"), F.date_add(F.max("period_end"), PADDING_DAYS).alias("until"))
    rows = ledger.pot_facts(facts, accounts).join(span, H)
    return rows.where(F.col("is_card") | F.col("booking_date").between(F.col("since"), F.col("until"))).select(*facts.columns, "is_card")


def interpretation_summary(found: Interpretation) -> DataFrame:
    """Per household: rows, pairs, settlements, unmatched, unresolved, cash."""
    rows = found.rows.groupBy(H).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("is_unmatched").alias("n_unmatched"), F.count_if(F.col("flow") == "UNRESOLVED").alias("n_unresolved"), F.count_if("is_cash").alias("n_cash"))
    links = found.links.groupBy(H).agg(F.count_if(F.col("card_import_id").isNull()).alias("n_pairs"), F.count_if(F.col("card_import_id").isNotNull()).alias("n_settlements"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(links, H, "left").select(H, "n_rows", "n_unmatched", "n_unresolved", "n_cash", zero("n_pairs"), zero("n_settlements"))
