"""Deduplication keys with occurrence ordinals, idempotent ingest, re-parse alignment."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import counterparty_text, key_text
from tallyloom.operators.numbering import numbered
from tallyloom.staging import staged

H = "household_id"


def content_tuple() -> Column:
    name = key_text(counterparty_text(F.col("counterparty_name"), F.col("description")))
    return F.to_json(F.array(F.col("account_id"), F.col("booking_date").cast("string"), F.col("amount_cents").cast("string"), name, F.coalesce("reference", F.lit(""))))


def with_keys(rows: DataFrame, natural: Column | bool = True, file: str = "import_id", line: str = "line_no", ranges: int | None = None) -> DataFrame:
    """rows with dedup_key: the natural key where the profile has one and both numbers stand, else a content hash with
    the 0-based ordinal of the row among equal ones of its file. Rows with natural keys do not count in ordinals and are
    not sorted. Of the others only those are numbered whose content comes up again in their file, as found by a short hash
    (two contents of one hash are numbered apart all the same); in ranges, so that a file of equal rows is not one task's.
    """
    by_number = F.lit(natural) if isinstance(natural, bool) else natural
    by_number = F.coalesce(by_number & F.col("statement_number").isNotNull() & F.col("sequence_number").isNotNull(), F.lit(False))
    known = rows.where(by_number).withColumn("dedup_key", F.concat_ws(":", F.lit("nat"), "account_id", "statement_number", "sequence_number"))
    hashed = rows.where(~by_number).withColumn("_hash", F.sha2(content_tuple().cast("binary"), 256))
    hashed = hashed.withColumn("_short", F.xxhash64(H, F.col(file), "_hash"))
    often = staged(hashed.groupBy("_short").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_short"), "often")
    alone, twins = (hashed.join(often, "_short", how).drop("_short") for how in ("left_anti", "left_semi"))
    nth = numbered(twins, [H, file, "_hash"], [line], "_nth", ranges).unionByName(alone.withColumn("_nth", F.lit(1).cast("long")))
    key = F.concat(F.lit("h:"), "_hash", F.lit("#"), (F.col("_nth") - 1).cast("string"))
    return known.unionByName(nth.withColumn("dedup_key", key).drop("_hash", "_nth"))


def new_rows(rows: DataFrame, stored: DataFrame, line: str = "line_no") -> DataFrame:
    """Rows whose key is not stored; of rows with one key the first of the batch. Ingesting them twice adds nothing."""
    nth = F.row_number().over(Window.partitionBy(H, "dedup_key").orderBy("import_id", line))
    own = rows.withColumn("_n", nth).where("_n = 1").drop("_n")
    return own.join(stored.select(H, "dedup_key"), [H, "dedup_key"], "left_anti")


def ingest_report(rows: DataFrame, added: DataFrame) -> DataFrame:
    """Per import: rows added, and rows known already."""
    all_ = rows.groupBy(H, "import_id").agg(F.count(F.lit(1)).alias("_all"))
    some = added.groupBy(H, "import_id").agg(F.count(F.lit(1)).alias("_added"))
    n = F.coalesce("_added", F.lit(0)).cast("long")
    return all_.join(some, [H, "import_id"], "left").select(H, "import_id", n.alias("rows_added"), (F.col("_all") - n).alias("rows_known"))


def _ordinal(key: Column) -> Column:
    """The ordinal of a content key, -1 for a natural key."""
    return F.when(key.startswith("h:") & key.rlike("#[0-9]+$"), F.substring_index(key, "#", -1).cast("long")).otherwise(F.lit(-1).cast("long"))


def _base(key: Column) -> Column:
    """A content key without its ordinal; a natural key as it is."""
    return F.when(key.startswith("h:"), F.regexp_replace(key, "#[0-9]+$", "")).otherwise(key)


def align_reparse(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """(household_id, profile_id, id, import_id, line_no, dedup_key): which line of a file, parsed anew, each stored row is.

    stored: household_id, profile_id, import_order, import_id, id, raw_line, dedup_key. parsed: the same files anew, with
    line_no and dedup_key. Twins (equal raw lines) keep their order; a key that an earlier import or twin took is passed
    over, and where none is left the next free ordinal is used. Only rows that are alike under the new profile can take
    each other's keys, so these are one group, not the profile; a row without such takes its line as it is. A stored row whose line is not in its file fails the run.
    """
    group, names = [H, "profile_id", "_base"], [H, "profile_id", "id", "import_id", "line_no", "dedup_key"]
    shape = "household_id string, profile_id string, id string, import_id string, line_no long, dedup_key string"
    schema = pa.schema([(n, pa.int64() if n == "line_no" else pa.string()) for n in names])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a group's files follow each other, in a file its raw lines, of each first the lines and then the stored rows; what
        # is kept is the lines of one raw line, and which ordinals of the group are taken: all below `floor`, and `above`
        at = raw_at = None
        floor, above, beyond = 0, set(), {}
        spots, keys, turn = array("q"), array("q"), 0
        for b in batches:
            out = []
            for *of, place, imported, first, raw, line, n, stored_id in zip(*(b.column(c).to_pylist() for c in (*group, "import_order", "import_id", "_at", "raw_line", "line_no", "_nth", "id"))):
                if of != at:
                    at, raw_at, floor, above, beyond = of, None, 0, set(), {}
                if (place, imported, first, raw) != raw_at:
                    raw_at, spots, keys, turn = (place, imported, first, raw), array("q"), array("q"), 0
                if stored_id is None:
                    spots.append(line)
                    keys.append(n)
                    continue
                while turn < len(keys) and (0 <= keys[turn] < floor or keys[turn] in above):
                    turn += 1
                if turn < len(keys):
                    n, line = keys[turn], spots[turn]
                    turn += 1
                else:
                    n, line = keys[0], spots[0]
                    if n < 0:
                        raise ValueError(f"natural key {of[-1]} is taken")
                    # of a file's first key, the ordinal before which none is free; none ever becomes free again
                    n, key = max(floor, beyond.get(n, n)), n
                    while n in above:
                        n += 1
                    beyond[key] = n + 1
                above.add(n)
                while floor in above:
                    above.remove(floor)
                    floor += 1
                out.append((*of[:2], stored_id, imported, line, of[-1] if n < 0 else f"{of[-1]}#{n}"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    parsed = parsed.select(H, "profile_id", "import_id", "line_no", "raw_line", "dedup_key", _base(F.col("dedup_key")).alias("_base"))
    line = [H, "profile_id", "import_id", "raw_line"]
    first = parsed.groupBy(*line, "_base").agg(F.min(F.struct("line_no", "dedup_key")).alias("_first"))
    stored = stored.select(*line, "import_order", "id", "dedup_key").join(first.hint("merge"), line, "left")
    stored = stored.withColumn("_base", F.coalesce("_base", F.raise_error(F.concat(F.lit("no such line in its file: row "), F.col("id")))))
    stored = staged(stored.withColumn("_short", F.xxhash64(*group)), "stored")
    # groups of one row, as far as a short hash tells; the walk does the same for those that share one
    often = staged(stored.groupBy("_short").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_short"), "often")
    alone = stored.join(often, "_short", "left_anti").select(H, "profile_id", "id", "import_id", "_first.line_no", "_first.dedup_key")
    twins = stored.join(often, "_short", "left_semi").drop("_first", "_short")
    asked = twins.groupBy(*group, "import_order", "import_id", "raw_line").agg(F.min("id").alias("_at"))
    nothing = lambda kind: F.lit(None).cast(kind)
    nth = _ordinal(F.col("dedup_key")).alias("_nth")
    olds = twins.join(asked, [*group, "import_order", "import_id", "raw_line"]).select(*group, "import_order", "import_id", "_at", "raw_line", F.lit(1).alias("_kind"), nothing("long").alias("line_no"), _base(F.col("dedup_key")).alias("_was"), nth, "id")
    news = parsed.join(asked, [*group, "import_id", "raw_line"]).select(*group, "import_order", "import_id", "_at", "raw_line", F.lit(0).alias("_kind"), "line_no", nothing("string").alias("_was"), nth, nothing("string").alias("id"))
    order = [*group, "import_order", "import_id", "_at", "raw_line", "_kind", "line_no", "_was", "_nth", "id"]
    walked = news.unionByName(olds).repartition(*group).sortWithinPartitions(*order).mapInArrow(align, shape)
    return alone.unionByName(walked)
