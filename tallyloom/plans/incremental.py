"""A stored interpretation that new imports change in part.

Stored tables: `rows` (household_id, id, period, import_id, flow, is_cash, is_unmatched, merchant_id), `links` (household_id,
period of the outgoing row, outgoing_id, incoming_id, card_import_id) and `states` (household_id, import_id, period, status).

What new imports can change is closed before anything is computed: the days around them with padding, all card rows and
settlement debits of their households, incoming rows whose counterparty they pay for the first time, and whole chains of
transfer legs, so that no pair reaches across the edge. Interpreted on its own, with what the whole ledger ever paid, this
part comes out as a recompute of everything would have it; links that touch it are dropped, and only the partitions it
lies in are written anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.constants import SETTLEMENT_DEBIT, TRANSFER_DAYS
from tallyloom.functions.text import refund_key
from tallyloom.operators import ledger
from tallyloom.plans.interpret import Interpretation, interpret, window_facts
from tallyloom.sources.snapshots import PARTS, Snapshot
from tallyloom.staging import shared_folder, staged

H = "household_id"
SCHEMAS = {
    "rows": "household_id string, id string, period string, import_id string, flow string, is_cash boolean, is_unmatched boolean, merchant_id string",
    "links": "household_id string, period string, outgoing_id string, incoming_id string, card_import_id string",
    "states": "household_id string, import_id string, period string, status string",
}


#: What a partition covers: long enough that a commit of a small ledger is not all folders.
PERIOD = "yyyy"


def period_of(day: Column) -> Column:
    return F.date_format(day, PERIOD)


def stored_interpretation(spark: SparkSession, root: str | None = None, parts: int = PARTS) -> Snapshot:
    """The snapshot at a folder, or at a new one in the shared folder."""
    root = root or f"{shared_folder(spark)}/interpretation-{uuid.uuid4().hex}"
    return Snapshot(spark, root, {n: StructType.fromDDL(s) for n, s in SCHEMAS.items()}, parts)


def affected(facts: DataFrame, accounts: DataFrame, imports: DataFrame) -> DataFrame:
    """The facts whose interpretation some new imports (household_id, import_id) can change, and all that it depends on
    but the outgoing history."""
    columns = facts.columns
    ours = facts.join(imports.select(H).distinct(), H, "left_semi")
    near = window_facts(ours, accounts, imports).select(*columns)
    pot = ledger.pot_facts(ours, accounts)
    debits = pot.where((F.col("amount_cents") < 0) & ledger.matches(F.col("description"), SETTLEMENT_DEBIT)).select(*columns)
    key = refund_key(F.col("counterparty_iban"), F.col("counterparty_name"), F.col("description"))
    paid = pot.join(imports, [H, "import_id"], "left_semi").where("amount_cents < 0").select(H, key.alias("_key")).distinct()
    refunds = pot.where("amount_cents > 0").withColumn("_key", key).join(paid, [H, "_key"], "left_semi").select(*columns)
    # legs of transfers, in chains no two neighbours of which a pair could not join
    own = ledger.rings(accounts).where("ring = 'pot'").select(H, F.col("iban").alias("counterparty_iban")).distinct()
    pair = F.array_sort(F.array("own_iban", "counterparty_iban"))
    legs = pot.where("amount_cents <> 0 AND own_iban IS NOT NULL").join(own, [H, "counterparty_iban"]).withColumn("_group", F.struct(F.abs("amount_cents").alias("cents"), pair.alias("pair")))
    near = near.unionByName(debits).unionByName(refunds)
    inside = near.select(H, "id").distinct().withColumn("_near", F.lit(True))
    chain = Window.partitionBy(H, "_group").orderBy("booking_date")
    first = F.coalesce(F.date_diff("booking_date", F.lag("booking_date").over(chain)) > TRANSFER_DAYS, F.lit(True))
    legs = legs.join(inside, [H, "id"], "left").withColumn("_first", first.cast("int"))
    legs = legs.withColumn("_chain", F.sum("_first").over(chain.rangeBetween(Window.unboundedPreceding, 0)))
    met = F.max(F.coalesce("_near", F.lit(False))).over(Window.partitionBy(H, "_group", "_chain"))
    chains = legs.withColumn("_met", met).where("_met").select(*columns)
    return near.unionByName(chains).dropDuplicates([H, "id"])


def _shaped(found: Interpretation) -> tuple[DataFrame, DataFrame]:
    rows = staged(found.rows.withColumn("period", period_of(F.col("booking_date"))), "shaped")
    if "merchant_id" not in rows.columns:
        rows = rows.withColumn("merchant_id", F.lit(None).cast("string"))
    out = rows.select(H, F.col("id").alias("outgoing_id"), "period")
    return rows.select(*StructType.fromDDL(SCHEMAS["rows"]).names), found.links.join(out, [H, "outgoing_id"]).select(*StructType.fromDDL(SCHEMAS["links"]).names)


def _states(facts: DataFrame, status: str) -> DataFrame:
    """The state of each import, filed under the period it begins in."""
    return ledger.import_periods(facts).select(H, "import_id", period_of(F.col("period_start")).alias("period"), F.lit(status).alias("status"))


def recompute(store: Snapshot, facts: DataFrame, accounts: DataFrame, rules: DataFrame | None = None) -> int:
    """Interprets everything and stores it as a new version."""
    rows, links = _shaped(interpret(facts, accounts, rules))
    changes = {"rows": (rows, store.read("rows")), "links": (links, store.read("links")), "states": (_states(facts, "INTERPRETED"), store.read("states"))}
    return store.commit({n: (df, old.select(H, "period")) for n, (df, old) in changes.items()})


def reinterpret(store: Snapshot, facts: DataFrame, accounts: DataFrame, imports: DataFrame, rules: DataFrame | None = None) -> int:
    """Splices what some new imports (household_id, import_id) change into the stored interpretation. facts: the whole
    ledger, theirs included. Every import of which a row was interpreted becomes INTERPRETED in the same version."""
    part = staged(affected(facts, accounts, imports), "affected")
    paid = ledger.outgoing_keys(facts.join(imports.select(H).distinct(), H, "left_semi"), accounts)
    rows, links = (staged(df, "spliced") for df in _shaped(interpret(part, accounts, rules, paid)))
    ids = part.select(H, "id", period_of(F.col("booking_date")).alias("period"))
    old = store.read("links", households=imports, periods=[r.period for r in ids.select("period").distinct().collect()])
    sides = [old.join(ids.select(H, F.col("id").alias(end)), [H, end], "left_semi") for end in ("outgoing_id", "incoming_id")]
    gone = sides[0].unionByName(sides[1]).select(H, "period", "outgoing_id").distinct()
    states = _states(facts.join(part.select(H, "import_id").distinct(), [H, "import_id"], "left_semi"), "INTERPRETED")
    filed = store.read("states", households=imports).join(states.select(H, "import_id"), [H, "import_id"], "left_semi").select(H, "import_id", "period")
    return store.commit({
        "rows": store.splice("rows", rows, [H, "id"], ids),
        "links": store.splice("links", links, [H, "outgoing_id"], gone),
        "states": store.splice("states", states, [H, "import_id"], filed),
    })
