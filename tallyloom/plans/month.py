"""The month view: figures with their verdict, groups with deltas, reserve movements, named gaps.

All functions give every household and month at once, from one pass over the interpreted rows; `at` narrows to some months
before anything is joined, and the filter reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.constants import CASH
from tallyloom.functions.dates import month_of, shifted_month
from tallyloom.functions.text import counterparty_text, normalise_counterparty
from tallyloom.operators.joins import HASH, hashed_join, key_hash
from tallyloom.operators.ledger import matches
from tallyloom.plans.interpret import matched_sides
from tallyloom.staging import staged

H = "household_id"
BY = [H, "month"]


def at(rows: DataFrame, months: list[str]) -> DataFrame:
    return rows.where(month_of(F.col("booking_date")).isin(months))


def linked(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with month, matched and in_transit (the partner lies in another month): links are joined once, by one key."""
    first = F.trunc("booking_date", "month")
    days = rows.select(H, F.col("id").alias("partner_id"), first.alias("there"))
    # days, not texts of months: the earliest and the latest of them are kept without sorting
    sides = hashed_join(matched_sides(links), days, [H, "partner_id"], "left")
    sides = sides.groupBy(key_hash([H, "id"]).alias(HASH), H, "id").agg(F.lit(True).alias("matched"), F.min("there").alias("since"), F.max("there").alias("until"))
    rows = rows.withColumns({"month": month_of(F.col("booking_date")), HASH: key_hash([H, "id"])}).join(sides, [HASH, H, "id"], "left").drop(HASH)
    away = F.when(F.col("since").isNull(), False).otherwise((F.col("since") != first) | (F.col("until") != first))
    return rows.withColumns({"matched": F.coalesce("matched", F.lit(False)), "in_transit": away}).drop("since", "until")


def figures(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Per household and month the sums, the difference and the verdict; all gaps must be empty, not only cancel out."""
    return verdict(raw_figures(linked(rows, links)))


def raw_figures(rows: DataFrame) -> DataFrame:
    cents, flow = F.col("amount_cents"), F.col("flow")
    total = lambda c: F.coalesce(F.sum(F.when(c, cents)), F.lit(0)).cast("long")
    internal = flow == "INTERNAL"
    return rows.groupBy(*BY).agg(
        total(flow == "INCOME").alias("income_cents"), (-total(flow == "SPEND")).alias("spend_cents"), (-total(flow == "RESERVE")).alias("net_to_reserves_cents"), total(flow.isNotNull()).alias("change_in_pot_cents"),
        total(flow == "UNRESOLVED").alias("unresolved_cents"), F.count_if(flow == "UNRESOLVED").alias("unresolved_count"),
        total(internal & ~F.col("matched")).alias("unmatched_internal_cents"), F.count_if(internal & ~F.col("matched")).alias("unmatched_internal_count"),
        total(internal & F.col("in_transit")).alias("in_transit_cents"), F.count_if(internal & F.col("in_transit")).alias("in_transit_count"),
        F.count_if(flow.isNull()).alias("uninterpreted_count"), F.count_if(flow.isNotNull()).alias("row_count"),
    )


def verdict(raw: DataFrame) -> DataFrame:
    difference = F.col("change_in_pot_cents") - (F.col("income_cents") - F.col("spend_cents") - F.col("net_to_reserves_cents"))
    gaps = F.col("unmatched_internal_count") + F.col("unresolved_count") + F.col("in_transit_count") + F.col("uninterpreted_count")
    return raw.withColumn("difference_cents", difference).withColumn("reconciles", (difference == 0) & (gaps == 0))


def counted_groups(rows: DataFrame, merchants: DataFrame, merchant_tags: DataFrame, tags: DataFrame, flow: str) -> DataFrame:
    """Sums and counts by merchant, primary tag, text and cash mark; the mark looks at the text only, not at the sign."""
    named = merchants.select(H, F.col("id").alias("merchant_id"), F.col("name").alias("merchant_name"))
    primary = merchant_tags.where("is_primary").join(tags.select(H, F.col("id").alias("tag_id"), F.col("name").alias("primary_tag")), [H, "tag_id"]).select(H, "merchant_id", "primary_tag")
    counted = rows.where(F.col("flow") == flow).withColumn("month", month_of(F.col("booking_date")))
    text = counterparty_text(F.col("counterparty_name"), F.col("description"))
    sums = counted.groupBy(*BY, "merchant_id", text.alias("counterparty_text"), matches(F.col("description"), CASH).alias("is_cash")).agg(F.sum("amount_cents").alias("total_cents"), F.count(F.lit(1)).alias("row_count"))
    return sums.join(named, [H, "merchant_id"], "left").join(primary, [H, "merchant_id"], "left")


def folded(groups: DataFrame, use_tags: bool) -> DataFrame:
    """Groups by cash, else tag (if asked), else merchant, else normalised text; texts are normalised once each. The
    groups are written, as they are read for their texts and for their sums, and by what compares months again."""
    groups = staged(groups, "groups")
    texts = groups.where("merchant_id IS NULL AND NOT is_cash").select("counterparty_text").distinct().withColumn("normal", normalise_counterparty(F.col("counterparty_text")))
    groups = groups.join(texts, "counterparty_text", "left")
    known = F.col("merchant_id").isNotNull()
    tagged = known & F.col("primary_tag").isNotNull() if use_tags else F.lit(False)
    pick = lambda *v: F.when(F.col("is_cash"), v[0]).when(tagged, v[1]).when(known, v[2]).otherwise(v[3])
    key = pick(F.lit("cash"), F.concat(F.lit("tag:"), "primary_tag"), F.concat(F.lit("merchant:"), "merchant_id"), F.concat(F.lit("text:"), "normal"))
    kind = pick(F.lit("cash"), F.lit("tag"), F.lit("merchant"), F.lit("unresolved"))
    label = pick(F.lit(""), F.col("primary_tag"), F.coalesce("merchant_name", F.lit("")), F.col("normal"))
    return groups.groupBy(*BY, key.alias("group_key"), kind.alias("kind")).agg(F.min(label).alias("label"), F.sum("total_cents").alias("total_cents"), F.sum("row_count").alias("row_count"))


def with_deltas(groups: DataFrame, key: list[str] | None = None) -> DataFrame:
    """delta_cents: the change of the absolute total against the month before; a group that is new counts from 0."""
    key = key or ["group_key"]
    before = groups.select(H, shifted_month(F.col("month"), 1).alias("month"), *key, F.col("total_cents").alias("_before"))
    joined = groups.join(before, [*BY, *key], "left")
    return joined.withColumn("delta_cents", F.abs("total_cents") - F.abs(F.coalesce("_before", F.lit(0)))).drop("_before")


def group_order() -> list[Column]:
    """Largest first; labels as people sort them, then the key."""
    return [F.abs("total_cents").desc(), F.collate(F.col("label"), "UNICODE").asc(), F.col("group_key").asc()]


def gap_order() -> list[Column]:
    return [F.col("booking_date").asc(), F.col("id").asc()]


def reserve_movements(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    named = accounts.where("iban IS NOT NULL").select(H, F.col("iban").alias("counterparty_iban"), "label")
    moved = rows.where("flow = 'RESERVE' AND counterparty_iban IS NOT NULL").withColumn("month", month_of(F.col("booking_date")))
    sums = moved.groupBy(*BY, "counterparty_iban").agg(F.sum("amount_cents").alias("_sum"), F.count(F.lit(1)).alias("row_count"))
    return sums.join(named, [H, "counterparty_iban"], "left").select(*BY, "counterparty_iban", F.coalesce("label", "counterparty_iban").alias("label"), (-F.col("_sum")).alias("parked_cents"), "row_count")


def gap_rows(rows: DataFrame, links: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rows that keep a month from closing, each with the name of its gap."""
    flow = F.col("flow")
    gap = F.when(flow.isNull(), "uninterpreted").when(flow == "UNRESOLVED", "unresolved").when(F.col("matched"), "in-transit").otherwise("unmatched-internal")
    open_ = flow.isNull() | (flow == "UNRESOLVED") | ((flow == "INTERNAL") & (~F.col("matched") | F.col("in_transit")))
    named = accounts.select(H, F.col("id").alias("account_id"), F.col("label").alias("account_label"))
    return linked(rows, links).where(open_).join(named, [H, "account_id"]).select(*BY, "id", gap.alias("gap"), "booking_date", counterparty_text(F.col("counterparty_name"), F.col("description")).alias("text"), "account_label", "amount_cents")


def sections(income: DataFrame, spend: DataFrame, reserves: DataFrame) -> DataFrame:
    """Per household and month: section totals with the change against the month before, and rows of unresolved groups."""
    sides = income.withColumn("side", F.lit("income")).unionByName(spend.withColumn("side", F.lit("spend")))
    total = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("total_cents"))), F.lit(0)).cast("long")
    out = sides.groupBy(*BY).agg(total("income").alias("income_cents"), (-total("spend")).alias("spend_cents"), F.coalesce(F.sum(F.when(F.col("kind") == "unresolved", F.col("row_count"))), F.lit(0)).cast("long").alias("unresolved_rows"))
    net = reserves.groupBy(*BY).agg(F.sum("parked_cents").alias("net"))
    out = out.join(net, BY, "full").select(*BY, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("income_cents", "spend_cents", "unresolved_rows")), F.coalesce("net", F.lit(0)).cast("long").alias("reserves_cents"))
    last = Window.partitionBy(H).orderBy("month")
    near = F.lag("month").over(last) == shifted_month(F.col("month"), -1)
    delta = lambda c: (F.col(c) - F.when(near, F.lag(c).over(last)).otherwise(0)).alias(c.replace("_cents", "_delta_cents"))
    return out.select("*", delta("income_cents"), delta("spend_cents"))
