"""Conversation repair against a search over all edits."""

import hashlib
import random

from plain import plain_damaged, plain_repair
from pyspark.sql import functions as F

from tallyloom.llm import conversations

CONV = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def made(rng, n_convs, longest=9):
    texts = ["Yes.", "No!", "why", "", " \n", "Go on?", "a. b", None, "and then "]
    roles = ["user", "assistant", "system", "tool", "", None, "uploader"]
    for c in range(n_convs):
        for _ in range(rng.randint(1, longest)):
            yield c, rng.choice([None, *range(6)]), rng.choice(roles[:3] * 4 + roles), rng.choice(texts)


def by_conv(rows):
    out = {}
    for c, *rest in rows:
        out.setdefault(c, []).append(tuple(rest))
    return out


def test_repair_is_the_cheapest_and_the_first_in_order(spark):
    rows = list(made(random.Random(5), 300)) + [(None, 1, "user", "Hi."), (None, 2, "user", "Hi."), (9_007_199_254_740_993, 1, "assistant", "Hi.")]
    found = {r.conv_id: tuple(r)[1:] for r in conversations.report(spark.createDataFrame(rows, CONV)).collect()}
    shown = lambda v: " " if v is None else v
    want = {c: plain_repair([(t, shown(r), shown(x)) for t, r, x in some]) for c, some in by_conv(rows).items()}
    assert found == want


def test_damage_and_conversations_without_rows(spark):
    rows = [(c, t, r, x) for c in range(400) for t, r, x in [(0, "user", "Why?"), (1, "assistant", "So. It is!")]]
    rows += [(1000 + c, 0, "user", "One.") for c in range(60)]
    data = spark.createDataFrame(rows, CONV)
    found = {r.conv_id: tuple(r)[1:] for r in conversations.report(conversations.damaged(data), there="there").collect()}
    want = {c: plain_repair(plain_damaged(c, some)) for c, some in by_conv(rows).items()}
    assert found == want
    assert (0, 0, 0, 0, 0, 0, "", EMPTY) in found.values()


def test_texts_of_the_repair_and_its_digest(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "cut"), (1, 2, "user", "Hello?"), (1, 3, "assistant", ""), (2, None, "system", "Be kind."), (2, 1, "user", "Hi.")]
    data = spark.createDataFrame(rows, CONV)
    turns = conversations.repair(data).orderBy("conv_id", "place").collect()
    for r in conversations.report(data).collect():
        mine = [t for t in turns if t.conv_id == r.conv_id]
        assert "".join(t.edit for t in mine) == r.audit and [t.place for t in mine] == list(range(len(mine)))
        lines = "\n".join(f"{t.role}:{t.text}" for t in mine if t.role is not None)
        assert hashlib.sha256(lines.encode()).hexdigest() == r.repaired_sha256
    assert [(t.edit, t.role) for t in turns if t.conv_id == 2] == [("K", "system"), ("K", "user"), ("I", "assistant")]
    assert all(t.turn is None for t in turns if t.edit == "I")


def test_giant_conversation_spills_its_backpointers(spark):
    rng = random.Random(2)
    n = 20_000
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), f"{t}{rng.choice(['.', ''])}") for t in range(n)]
    data = spark.createDataFrame(rows, CONV).repartition(5)
    spilled, held = (conversations.report(data, block=b).collect() for b in (512, 1 << 22))
    assert spilled == held and len(spilled[0].audit) >= n
    back = conversations.Backpointers(spark.conf.get("spark.checkpoint.dir") + "/back-test", 10)
    for i in range(37):
        back.add(i)
    assert len(back.files) == 3 and list(back.read()) == list(range(36, -1, -1)) and not back.files


def test_empty_table_and_clashing_columns(spark):
    data = spark.createDataFrame([(1, 0, "user", "Hi.", "x", 3)], CONV + ", key string, place int")
    assert conversations.report(data).select("audit").collect()[0].audit == "KI"
    assert conversations.report(data.where("conv_id < 0")).count() == 0
    assert conversations.report(conversations.damaged(data.withColumn("harm", F.lit(1)).withColumn("there", F.lit(2))), there="there").count() == 1
    long_text = spark.createDataFrame([(1, 0, "user", "word. " * 300_000)], CONV)
    assert conversations.report(long_text).collect()[0].truncated == 0
