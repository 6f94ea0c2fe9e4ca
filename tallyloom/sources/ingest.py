"""Ingest of parsed statements: account resolution, the import log, append-only facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.operators.dedup import align_reparse, ingest_report, new_rows, with_keys
from tallyloom.operators.joins import sent_if_few
from tallyloom.sources.delimited import failures, parsed, statements
from tallyloom.sources.profile import recognised
from tallyloom.sources.snapshots import PARTS, Snapshot, part_of
from tallyloom.staging import staged

H = "household_id"


def resolve_accounts(files: DataFrame, accounts: DataFrame) -> DataFrame:
    """files (household_id, file_id, account_iban, bound_account) with account_id: by the file's IBAN where it has one,
    else the account bound to its profile; null means the user must be asked."""
    by_iban = accounts.where("iban IS NOT NULL").select(H, F.col("iban").alias("account_iban"), F.col("id").alias("by_iban"))
    joined = files.join(by_iban, [H, "account_iban"], "left")
    return joined.select(*files.columns, F.when(F.col("account_iban").isNotNull(), F.col("by_iban")).otherwise(F.col("bound_account")).alias("account_id"))


def uploaded(files: DataFrame, specs: DataFrame, stored: DataFrame, accounts: DataFrame) -> DataFrame:
    """What becomes of each file: (household_id, file_id, reason, profile_id, account_id, n_rows, cents).

    specs: the inferred profile of each file; stored: the profiles that are known (id, account_id, created_at, spec). A file
    is recognised by its profile, parsed whole or not at all, and its account is the one that it names, else its profile's.
    What is a row a file is merged, as it is many rows, however few bytes they take on disk.
    """
    rows, bad = statements(files.join(specs.hint("merge"), [H, "file_id"]))
    whole = rows.groupBy(H, "file_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("amount_cents").alias("cents"), F.min("account_iban").alias("account_iban"))
    known = recognised(specs, stored).select(H, "file_id", "profile_id", "bound_account")
    placed = resolve_accounts(whole.join(known.hint("merge"), [H, "file_id"]), accounts)
    out = files.select(H, "file_id").join(bad.select(H, "file_id", "reason").hint("merge"), [H, "file_id"], "left").join(placed.hint("merge"), [H, "file_id"], "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(H, "file_id", "reason", "profile_id", "account_id", count("n_rows"), count("cents"))


def import_states(events: DataFrame) -> DataFrame:
    """Latest state of each import from a log (household_id, import_id, at, status) in which later rows win, as far as the
    state before allows the step; FAILED and INTERPRETED files are not ingested again."""
    allowed = F.create_map(*(F.lit(x) for pair in {"PARSED>INGESTED": True, "AWAITING_DECLARATION>INGESTED": True, "AWAITING_DECLARATION>FAILED": True, "INGESTED>INTERPRETED": True, "INTERPRETED>INGESTED": True}.items() for x in pair))
    path = F.transform(F.array_sort(F.collect_list(F.struct("at", "status"))), lambda s: s["status"])
    step = lambda now, nxt: F.when(now.isNull() | F.coalesce(allowed[F.concat(now, F.lit(">"), nxt)], F.lit(False)), nxt).otherwise(now)
    return events.groupBy(H, "import_id").agg(path.alias("path")).select(H, "import_id", F.aggregate("path", F.lit(None).cast("string"), step).alias("status"))


def fix_profile(files: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored facts parsed anew under corrected profiles: the facts to write in place of those of the same id, and the
    profiles that are refused. A profile is rewritten whole or not at all.

    files: household_id, profile_id, import_order, import_id, content, spec (the corrected one); stored: household_id,
    profile_id, import_id, account_id, id, raw_line, dedup_key. Files without stored facts are passed over. A refused
    profile has one row: household_id, profile_id, import_id, reason, id: its first file that does not parse, and the
    stored fact of the failing line, if it is one. Ids, imports, accounts and raw lines stay as they are. An import with
    facts of two accounts fails the run.
    """
    key = [H, "import_id"]
    account = F.when(F.min("account_id") == F.max("account_id"), F.min("account_id")).otherwise(F.raise_error(F.concat(F.lit("facts of two accounts in import "), F.col("import_id"))))
    # what is a row a file or a line is merged, as it is many rows, however few bytes they take on disk
    held = files.join(stored.groupBy(*key).agg(account.alias("account_id")).hint("merge"), key).withColumn("file_id", F.col("import_id"))
    # parsed once, as all that follows reads the rows again
    rows = staged(parsed(held, ("profile_id", "import_order", "account_id")), "parsed")
    bad = failures(held, rows).where("reason IS NOT NULL").select(H, F.col("file_id").alias("import_id"), "reason", "raw_line")
    bad = staged(bad, "bad")  # few or many, as is known once they are written
    lines = stored.join(sent_if_few(bad.select(*key)), key, "left_semi").groupBy(*key, "raw_line").agg(F.min("id").alias("id"))
    bad = sent_if_few(bad).join(held.select(*key, "profile_id", "import_order"), key).join(lines.hint("merge"), [*key, "raw_line"], "left")
    first = F.min(F.struct("import_order", "import_id", "reason", "id")).alias("b")
    refused = staged(bad.groupBy(H, "profile_id").agg(first).select(H, "profile_id", "b.import_id", "b.reason", "b.id"), "refused")
    without = sent_if_few(refused.select(H, "profile_id"))
    of = held.select(*key, "profile_id", "import_order").join(without, [H, "profile_id"], "left_anti")
    # a file that fails is one of a refused profile, so the rows that are left are those of whole files
    anew = rows.withColumnRenamed("file_id", "import_id").drop("problem").join(without, [H, "profile_id"], "left_anti")
    keyed = staged(with_keys(anew).select(H, "profile_id", "import_id", "line_no", "raw_line", "dedup_key"), "keyed")
    old = stored.select(*key, "id", "raw_line", "dedup_key").join(of.hint("merge"), key)
    spots = align_reparse(old, keyed)
    return spots.join(anew.drop("import_order").hint("merge"), [H, "profile_id", "import_id", "line_no"]), refused


def reopened(rewritten: DataFrame, states: DataFrame) -> DataFrame:
    """States (household_id, import_id, status) to log with rewritten facts: interpreted imports wait for it again."""
    hit = states.where("status = 'INTERPRETED'").join(rewritten.select(H, "import_id").distinct(), [H, "import_id"], "left_semi")
    return hit.select(H, "import_id", F.lit("INGESTED").alias("status"))


def ingest(rows: DataFrame, stored: DataFrame, natural: bool = True) -> tuple[DataFrame, DataFrame]:
    """New facts of a batch of parsed rows, and what each import added and already knew."""
    keyed = with_keys(rows, natural)
    added = new_rows(keyed, stored)
    return added, ingest_report(rows, added)


#: Columns of stored facts, of their imports' states and of the profiles that files are read by.
STORED = {
    "facts": "household_id string, period string, id string, import_id string, account_id string, profile_id string, line_no long, booking_date date, value_date date, amount_cents long, description string, counterparty_iban string, counterparty_name string, reference string, statement_number string, sequence_number string, raw_line string, dedup_key string",
    "states": "household_id string, period string, import_id string, status string",
    "profiles": "household_id string, period string, profile_id string, spec string",
}


def fact_store(spark: SparkSession, root: str, parts: int = PARTS) -> Snapshot:
    return Snapshot(spark, root, {n: StructType.fromDDL(s) for n, s in STORED.items()}, parts)


def _stored(rows: DataFrame, name: str, period: Column) -> DataFrame:
    """rows with the columns of a stored table, null where they have none."""
    rows = rows.withColumn("period", period)
    fields = StructType.fromDDL(STORED[name])
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def put_facts(store: Snapshot, facts: DataFrame, states: DataFrame, profiles: DataFrame) -> int:
    """A first version: facts by the year of their day, states (household_id, import_id, status), profiles (household_id,
    profile_id, spec as a struct)."""
    year = F.date_format("booking_date", "yyyy")
    specs = profiles.withColumn("spec", F.to_json("spec"))
    return store.commit({"facts": (_stored(facts, "facts", year), None), "states": (_stored(states, "states", F.lit("all")), None), "profiles": (_stored(specs, "profiles", F.lit("all")), None)})


def rewrite(store: Snapshot, files: DataFrame) -> tuple[int, DataFrame]:
    """Corrected profiles over their stored facts, in one switch: facts rewritten under their ids, imports that were
    interpreted open again, specs replaced. A profile with a file that no longer parses is refused whole (second value);
    a failure before the switch leaves everything as it was.

    files: household_id, profile_id, import_order, import_id, content, spec (the corrected one), of all households touched.
    """
    homes = files.select(H).distinct()
    stored = staged(store.read("facts", households=homes).join(files.select(H, "profile_id", "import_id").distinct(), [H, "profile_id", "import_id"], "left_semi").select(H, "profile_id", "import_id", "account_id", "id", "raw_line", "dedup_key", "period"), "facts")
    rewritten, refused = fix_profile(files, stored.drop("period"))
    rewritten = staged(rewritten, "rewritten")
    # what is read by a splice is read several times
    gone = staged(stored.join(rewritten.select(H, "id"), [H, "id"], "left_semi").select(H, "id", "period"), "gone")
    facts = store.splice("facts", _stored(rewritten, "facts", F.date_format("booking_date", "yyyy")), [H, "id"], gone)
    opened = staged(reopened(rewritten, store.read("states", households=homes)), "opened")
    states = store.splice("states", _stored(opened, "states", F.lit("all")), [H, "import_id"], opened.withColumn("period", F.lit("all")))
    fixed = files.select(H, "profile_id", F.to_json("spec").alias("spec")).distinct().join(refused, [H, "profile_id"], "left_anti")
    fixed = staged(_stored(fixed, "profiles", F.lit("all")), "fixed")
    return store.commit({"facts": facts, "states": states, "profiles": store.splice("profiles", fixed, [H, "profile_id"], fixed)}), refused


def append(facts: DataFrame, path: str, parts: int = PARTS) -> None:
    """Facts are only ever added; one writer at a time, partitioned by a hash of the household and by month."""
    placed = facts.withColumns({"part": part_of(F.col(H), parts), "month": F.date_format("booking_date", "yyyy-MM")})
    placed.write.mode("append").partitionBy("part", "month").parquet(path)


def stored_keys(spark: SparkSession, path: str, rows: DataFrame, parts: int = PARTS) -> DataFrame:
    """(household_id, dedup_key) of the appended facts in the parts that rows fall into; other parts are not opened."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    empty = spark.createDataFrame([], "household_id string, dedup_key string")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return empty
    touched = [r.part for r in rows.select(part_of(F.col(H), parts).alias("part")).distinct().collect()]  # at most `parts`
    if not touched:
        return empty
    schema = "household_id string, dedup_key string, part int, month string"
    return spark.read.schema(schema).parquet(path).where(F.col("part").isin(touched)).select(H, "dedup_key")
