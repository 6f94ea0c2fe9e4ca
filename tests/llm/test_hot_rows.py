"""Rows that repeat very often, and stray quotes in tags."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import html_extract, quality, sharding

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_slots_of_a_record_that_repeats(spark):
    docs = spark.createDataFrame([(1, "hot", "en", "s", 3)], DOC).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(2500)))).drop("n")
    docs = docs.unionByName(spark.createDataFrame([(i, f"t{i}", "en", "s", 2) for i in range(2, 60)], DOC))
    whole, cut = (sharding.assign(docs, [1.0] * 3, [1.0] * 4, piece=p).select("doc_id", "shard", "slot", "grown_shard").collect() for p in (1 << 20, 100))
    assert sorted(map(tuple, whole)) == sorted(map(tuple, cut)) and len(cut) == 2558
    for s in range(3):
        slots = sorted(r.slot for r in cut if r.shard == s)
        assert slots == list(range(len(slots)))


def test_fit_brings_one_row_for_a_label_to_the_driver(spark, monkeypatch):
    came = []
    monkeypatch.setattr(quality, "boost", lambda x, y: came.append(len(y)))
    kept = [i for i in range(40) if quality.crc_remainder(i)]
    docs = spark.createDataFrame([(kept[0], f"a{n % 3}", "en", "s", 2) for n in range(900)] + [(i, "b c", "en", "s", 3) for i in kept] + [(kept[1], None, "en", "s", 0)], DOC)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    quality.fit(docs, labels)
    quality.fit(docs, labels, rows=5)
    assert came == [len(kept), 5]


@pytest.mark.parametrize("tag", ["<p title='don't'>", '<p data-x"y>', "<p data-x'y>", "<p \"'>", "<p a=\"x>y\" b='\">'>", "<p a = \"it's\">", "<p a=b'c\"d>", "<p class=>", "<p =x>"])
def test_stray_quotes_in_a_tag_lose_no_text(tag):
    rest = "Third, it's \"here\" to stay, isn't it?"
    page = html_extract.parse(f"<body><p>First one.</p>{tag}Second one.</p><p>{rest}</p></body>")
    assert [t for t in page.text if t] == ["First one.", "Second one.", rest]


def test_random_tags_end_where_a_plain_reader_ends_them():
    rng = random.Random(8)

    def plain(tag):
        """Length of the attribute part: quotes open values only behind the sign of equality."""
        i, n = 0, len(tag)
        while i < n and tag[i] != ">":
            if tag[i] == "=":
                i += 1
                while i < n and tag[i].isspace():
                    i += 1
                if i < n and tag[i] in "\"'" and tag.find(tag[i], i + 1) >= 0:
                    i = tag.find(tag[i], i + 1) + 1
                elif i < n and tag[i] not in "\"'>":
                    while i < n and tag[i] not in ">" and not tag[i].isspace():
                        i += 1
            else:
                i += 1
        return i

    for _ in range(3000):
        attrs = " " + "".join(rng.choice("ab= \"'>/") for _ in range(rng.randint(0, 14)))
        m = html_extract._TAG.match("<p" + attrs)
        assert len(m[3]) == plain(attrs), attrs
