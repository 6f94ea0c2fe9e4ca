"""Merchants: rules in three tiers, resolution of distinct texts, the review of counted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.money import trimmed
from tallyloom.functions.text import counterparty_text, glob_to_regex, normalise_counterparty
from tallyloom.operators.joins import hashed_join
from tallyloom.staging import staged

H = "household_id"
TIERS = ("EXACT", "PREFIX", "PATTERN")
#: Letters of a literal between stars by which a glob is found.
GRAM = 8


def match_rules(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """(household_id, text, merchant_id, rule_id) for distinct normalised texts that a rule takes.

    Exact rules are an equi-join, prefix rules one by the texts' beginnings of the lengths that rules have. A glob is filed
    under its longest literal: its end, if that is the longest, or else the first GRAM letters of the longest one between
    its stars, which meet the texts' own runs of letters of that length. Globs of stars alone match all texts alike, so
    only the best one of a household takes part. No rule meets all texts of a household but that.
    Longest pattern, smallest pattern, smallest id win inside a tier; an exact rule beats a prefix, a prefix a glob. Empty
    texts and patterns match nothing.
    """
    keys = keys.where("text <> ''").select(H, "text").distinct()
    rules = rules.where("pattern <> ''").select(H, F.col("id").alias("rule_id"), "merchant_id", "kind", "pattern")
    exact = keys.join(rules.where("kind = 'EXACT'").withColumn("text", F.col("pattern")), [H, "text"])
    prefixes = rules.where("kind = 'PREFIX'").withColumn("size", F.length("pattern"))
    sizes = prefixes.groupBy(H).agg(F.collect_set("size").alias("sizes"))
    cut = keys.join(sizes, H).withColumn("size", F.explode("sizes")).where(F.length("text") >= F.col("size")).withColumn("pattern", F.expr("left(text, size)")).drop("sizes")
    prefix = cut.join(prefixes, [H, "size", "pattern"])
    globs = rules.where("kind = 'PATTERN'").withColumn("shape", glob_to_regex(F.col("pattern")))
    literals = F.filter(F.split("pattern", r"\*"), lambda x: x != "")
    longest = F.array_sort(F.transform(literals, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x"))))[0]["x"]
    ends = [F.struct(F.lit(side).alias("side"), F.substring_index("pattern", "*", n).alias("part")) for side, n in (("head", 1), ("tail", -1))]
    end = F.when(F.length(ends[0]["part"]) >= F.length(ends[1]["part"]), ends[0]).otherwise(ends[1])
    inner = F.struct(F.lit("in").alias("side"), F.left(longest, F.lit(GRAM)).alias("part"))
    globs = globs.withColumn("filed", F.when(F.size(literals) > 0, F.when(F.length(end["part"]) >= F.least(F.length(longest), F.lit(GRAM)), end).otherwise(inner)))
    narrow = globs.where("filed IS NOT NULL").select("*", "filed.*", F.length("filed.part").alias("size"))
    asked = narrow.groupBy(H).agg(F.collect_set(F.struct("side", "size")).alias("asked"))
    cut = keys.join(asked, H).select(H, "text", F.explode("asked").alias("a")).select(H, "text", "a.side", "a.size").where("length(text) >= size")
    runs = F.expr("array_distinct(transform(sequence(1, length(text) - size + 1), i -> substr(text, i, size)))")
    parts = F.when(F.col("side") == "head", F.array(F.expr("left(text, size)"))).when(F.col("side") == "tail", F.array(F.expr("right(text, size)"))).otherwise(runs)
    met = cut.withColumn("part", F.explode(parts)).join(narrow, [H, "side", "size", "part"]).where(F.expr("text rlike shape"))
    plain = globs.where("filed IS NULL").groupBy(H).agg(F.min(F.struct(-F.length("pattern"), "pattern", "rule_id", "merchant_id", "kind")).alias("b")).select(H, "b.pattern", "b.rule_id", "b.merchant_id", "b.kind")
    glob = met.select(H, "text", "merchant_id", "rule_id", "kind", "pattern").unionByName(keys.join(plain, H))
    cols = [H, "text", "merchant_id", "rule_id", "kind", "pattern"]
    every = exact.select(*cols).unionByName(prefix.select(*cols)).unionByName(glob.select(*cols))
    tier = F.array_position(F.array(*map(F.lit, TIERS)), F.col("kind"))
    best = every.groupBy(H, "text").agg(F.min(F.struct(tier, -F.length("pattern"), "pattern", "rule_id", "merchant_id")).alias("b"))
    return best.select(H, "text", F.col("b.merchant_id").alias("merchant_id"), F.col("b.rule_id").alias("rule_id"))


def resolve(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (with flow) and merchant_id: counted rows only; each distinct text is normalised and matched once."""
    raw = counterparty_text(F.col("counterparty_name"), F.col("description"))
    texts = rows.where("flow IN ('INCOME', 'SPEND')").select(H, raw.alias("raw_text")).distinct().withColumn("text", normalise_counterparty(F.col("raw_text")))
    texts = staged(texts, "texts")  # each of the joins below would find and normalise them anew
    found = texts.join(match_rules(texts, rules), [H, "text"], "left").select(H, F.col("raw_text").alias("_raw"), "merchant_id", F.col("text").alias("normal_text"))
    rows = rows.withColumn("_raw", F.when(F.col("flow").isin("INCOME", "SPEND"), raw))
    # written, so that the planner knows how small it is: all rows meet it
    return hashed_join(rows, staged(found, "found"), [H, "_raw"], "left", spread="id").drop("_raw")


def review(rows: DataFrame, merchants: DataFrame) -> DataFrame:
    """Per household and direction: groups by merchant, else by normalised text, with sums and counts."""
    named = merchants.select(H, F.col("id").alias("merchant_id"), F.col("name").alias("merchant_name"))
    rows = rows.where("flow IN ('INCOME', 'SPEND')").join(named, [H, "merchant_id"], "left")
    known = F.col("merchant_id").isNotNull()
    key = F.when(known, F.concat(F.lit("merchant:"), "merchant_id")).otherwise(F.concat(F.lit("text:"), "normal_text"))
    label = F.when(known, F.coalesce("merchant_name", F.lit(""))).otherwise(F.col("normal_text"))
    return rows.groupBy(H, "flow", key.alias("group_key")).agg(F.min(label).alias("label"), F.max(known.cast("int")).alias("resolved"), F.sum("amount_cents").alias("total_cents"), F.count(F.lit(1)).alias("row_count"))


def review_totals(groups: DataFrame) -> DataFrame:
    """Per household: the sums of both directions, and unresolved groups (groups, not rows)."""
    total = lambda flow: F.coalesce(F.sum(F.when(F.col("flow") == flow, F.col("total_cents"))), F.lit(0)).cast("long")
    return groups.groupBy(H).agg(total("INCOME").alias("income_cents"), total("SPEND").alias("spend_cents"), F.count_if(F.col("resolved") == 0).alias("unresolved_groups"))


def review_order() -> list[Column]:
    return [F.abs("total_cents").desc(), F.col("label").asc(), F.col("group_key").asc()]


def latest(declared: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of declarations with one key the newest: what writing them one after the other leaves."""
    by = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return declared.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def assigned(declared: DataFrame, merchants: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merchants and rules after declarations (household_id, at, merchant_name, counterparty_text), one after the other by
    `at`, then name, and the declarations that say nothing, with `problem`.

    A merchant is the one of that name (trimmed), else a new one; its rule is the exact one of the normalised text, which
    moves to the merchant of the newest declaration. New ids are digests of what they stand for, so a rerun makes the same.
    """
    said = declared.withColumns({"name": trimmed(F.col("merchant_name")), "pattern": normalise_counterparty(F.col("counterparty_text"))})
    problem = F.when(F.coalesce("name", F.lit("")) == "", "empty-merchant-name").when(F.coalesce("pattern", F.lit("")) == "", "empty-counterparty")
    said = staged(said.withColumn("problem", problem), "assigned")
    good = said.where("problem IS NULL")
    digest = lambda mark, *c: F.concat(F.lit(mark), F.sha2(F.to_json(F.array(*c)).cast("binary"), 256))
    names = good.select(H, "name").distinct().join(merchants.select(H, "name"), [H, "name"], "left_anti")
    merchants = merchants.select(H, "id", "name").unionByName(names.select(H, digest("m:", H, "name").alias("id"), "name"))
    one = merchants.groupBy(H, "name").agg(F.min("id").alias("merchant_id"))
    newest = latest(good.withColumn("turn", F.struct("at", "name")), [H, "pattern"], "turn").join(one, [H, "name"]).select(H, "pattern", "merchant_id")
    kept = rules.select(H, "id", "merchant_id", "kind", "pattern")
    changed = newest.withColumn("kind", F.lit("EXACT")).withColumnRenamed("merchant_id", "_to")
    after = kept.join(changed, [H, "kind", "pattern"], "full")
    rules = after.select(H, F.coalesce("id", digest("r:", H, "kind", "pattern")).alias("id"), F.coalesce("_to", "merchant_id").alias("merchant_id"), "kind", "pattern")
    return merchants, rules, said.where("problem IS NOT NULL").select(*declared.columns, "problem")


def tagged(merchant_tags: DataFrame, declared: DataFrame, merchants: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags of merchants after declarations (household_id, merchant_id, tag_id, is_primary, at), one after the other by
    `at`, then tag, and the declarations whose merchant or tag is not the household's.

    A promotion demotes the merchant's other tags, also if it is taken back later; so a merchant has one primary at most.
    """
    of = lambda df, name: df.select(H, F.col("id").alias(name), F.lit(True).alias(f"_{name}")).distinct()
    known = declared.join(of(merchants, "merchant_id"), [H, "merchant_id"], "left").join(of(tags, "tag_id"), [H, "tag_id"], "left")
    ours = F.col("_merchant_id").isNotNull() & F.col("_tag_id").isNotNull()
    cols = [H, "merchant_id", "tag_id", "is_primary"]
    before = merchant_tags.select(*cols, F.struct(F.lit(False).alias("new"), F.lit(None).cast(declared.schema["at"].dataType).alias("at"), "tag_id").alias("turn"))
    after = known.where(ours).select(*cols, F.struct(F.lit(True).alias("new"), "at", "tag_id").alias("turn"))
    last = before.unionByName(after).groupBy(H, "merchant_id", "tag_id").agg(F.max(F.struct("turn", "is_primary")).alias("last"), F.max(F.when(F.col("is_primary"), F.col("turn"))).alias("promoted"))
    top = F.max("promoted").over(Window.partitionBy(H, "merchant_id"))
    rows = last.withColumn("top", top).select(H, "merchant_id", "tag_id", (F.col("last.is_primary") & F.col("last.turn").eqNullSafe(F.col("top"))).alias("is_primary"))
    return rows, known.where(~ours).select(*declared.columns)
