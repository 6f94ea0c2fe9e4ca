"""Numbers in ranges against one window a group."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import dedup
from tallyloom.operators.numbering import numbered

ROW = "household_id string, account_id string, import_id string, line_no long, booking_date date, amount_cents long, description string, counterparty_name string, reference string, statement_number string, sequence_number string"


def test_numbers_equal_those_of_a_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 9 + ["a", "b", None]), rng.choice([None, "x", "É", "e", "z"]), n) for n in range(4000)]
    df = spark.createDataFrame(rows, "g string, label string, id long")
    order = [F.collate(F.col("label"), "UNICODE").desc_nulls_last(), F.col("id").asc()]
    want = df.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("long"))
    for ranges in (None, 1, 7):
        assert sorted(map(str, numbered(df, ["g"], order, ranges=ranges).collect())) == sorted(map(str, want.collect()))
    assert numbered(df.limit(0), ["g"], ["id"]).count() == 0


def test_a_large_group_is_in_many_tasks(spark):
    df = spark.range(200_000).select(F.lit("hot").alias("g"), F.col("id"))
    found = numbered(df, ["g"], ["id"], ranges=8)
    assert found.agg(F.max("place"), F.sum("place"), F.count_distinct("place")).first()[:] == (200_000, 200_000 * 200_001 // 2, 200_000)
    assert found.where("place <> id + 1").count() == 0
    # the group is sorted by (group, range): no range holds more than a fraction of it
    assert "_range" in found._jdf.queryExecution().executedPlan().toString()
    sizes = [r["count"] for r in df.repartitionByRange(8, "g", "id").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 60_000


def test_a_file_of_equal_rows(spark):
    one = "'h' household_id, 'a' account_id, 'f' import_id, id line_no, date'2026-08-01' booking_date, 100L amount_cents, 'x' description, cast(null as string) counterparty_name, cast(null as string) reference"
    hashed = spark.range(50_000).selectExpr(*one.split(", "), "cast(null as string) statement_number", "cast(null as string) sequence_number")
    natural = spark.range(50_000, 50_500).selectExpr(*one.split(", "), "cast(id as string) statement_number", "'1' sequence_number")
    keyed = dedup.with_keys(hashed.unionByName(natural), ranges=6)
    nth = F.substring_index("dedup_key", "#", -1).try_cast("long")
    assert keyed.where("line_no < 50000").where(nth != F.col("line_no")).count() == 0
    assert keyed.where("dedup_key LIKE 'nat:%'").count() == 500 and keyed.select("dedup_key").distinct().count() == 50_500
    assert keyed.columns == [*hashed.columns, "dedup_key"]


def test_only_rows_that_come_up_again_are_numbered(spark, monkeypatch):
    met = []

    def counted(df, *a, **k):
        met.append(sorted(r.line_no for r in df.collect()))
        return numbered(df, *a, **k)

    monkeypatch.setattr(dedup, "numbered", counted)
    rows = [("h", "a", "f", n, dt.date(2026, 8, 1), 5, "same" if n in (3, 7, 8) else f"t{n}") for n in range(10)] + [("h", "a", "g", 3, dt.date(2026, 8, 1), 5, "same")]
    rows = spark.createDataFrame(rows, "household_id string, account_id string, import_id string, line_no long, booking_date date, amount_cents long, description string")
    nothing = {c: F.lit(None).cast("string") for c in ("counterparty_name", "reference", "statement_number", "sequence_number")}
    keyed = dedup.with_keys(rows.withColumns(nothing)).collect()
    assert met == [[3, 7, 8]]
    assert {(r.import_id, r.line_no): int(r.dedup_key.rpartition("#")[2]) for r in keyed} == {(f, n): {7: 1, 8: 2}.get(n, 0) for f, n in [("f", n) for n in range(10)] + [("g", 3)]}


def test_twins_are_aligned_as_a_stream(spark):
    """Against the walk in plain Python; a group's rows come to a task in their order, never as one frame."""
    rng = random.Random(5)
    stored, parsed, want = [], [], {}
    for h in ("g", "h"):
        taken = set()
        for f in range(6):
            raws = [rng.choice("AB") for _ in range(rng.randint(1, 7))]
            lines = [(n + 1, raw, f"h:{h}y#{n}") for n, raw in enumerate(raws)]
            parsed += [(h, "p", f"f{f}", n, raw, k) for n, raw, k in lines]
            rows = [(f"{f}-{i:02}", raw, f"h:old{raw}#{rng.randint(0, 20)}") for i, raw in enumerate(raws + rng.choices(raws, k=rng.randint(0, 2)))]
            rng.shuffle(rows)
            stored += [(h, "p", f, f"f{f}", i, raw, k) for i, raw, k in rows]
            for raw in sorted({r[1] for r in rows}, key=lambda raw: min(i for i, w, _ in rows if w == raw)):
                at = [(n, int(k.rpartition("#")[2])) for n, w, k in lines if w == raw]
                free = iter(at)
                for i, _, k in sorted((r for r in rows if r[1] == raw), key=lambda r: (int(r[2].rpartition("#")[2]), r[0])):
                    spot = next((x for x in free if x[1] not in taken), None)
                    if spot is None:
                        spot = at[0][0], next(x for x in range(at[0][1], 1000) if x not in taken)
                    taken.add(spot[1])
                    want[h, i] = spot[0], f"h:{h}y#{spot[1]}"
    old = spark.createDataFrame(stored, "household_id string, profile_id string, import_order int, import_id string, id string, raw_line string, dedup_key string")
    anew = spark.createDataFrame(parsed, "household_id string, profile_id string, import_id string, line_no long, raw_line string, dedup_key string")
    found = dedup.align_reparse(old, anew)
    assert "FlatMapCoGroups" not in found._jdf.queryExecution().toString()
    assert {(r.household_id, r.id): (r.line_no, r.dedup_key) for r in found.collect()} == want
