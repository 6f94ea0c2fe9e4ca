"""Spelling variants against a comparison through all deletions and replacements."""

import collections
import random
import re
import zlib

from tallyloom.llm import variants


def plain_near(words):
    at, near = collections.defaultdict(set), {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            at[w[:i] + "\0" + w[i + 1 :]].add(w)
            shorter = w[:i] + w[i + 1 :]
            if shorter in near:
                near[w].add(shorter)
                near[shorter].add(w)
    for some in at.values():
        for w in some:
            near[w] |= some - {w}
    return near


def plain_rows(counts):
    near, form, out = plain_near(counts), {}, {}
    for w in counts:
        if near[w] and counts[best := min(near[w], key=lambda x: (-counts[x], x))] >= 2 * counts[w]:
            form[w] = best
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None)
    return out


def found(spark, counts, **sizes):
    rows = variants.grouped(spark.createDataFrame(list(counts.items()), "word string, n long"), **sizes).collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_near_words_and_forms(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("aeàtz") for _ in range(rng.randint(5, 7))) for _ in range(900)} | {"x" * 5, "x" * 6, "x" * 7, "y" * 4000, "y" * 4001, "ÿ×÷þø"}
    counts = {w: rng.choice([3, 3, 4, 8, 20, 100, 1000]) for w in sorted(words)}
    want = plain_rows(counts)
    assert found(spark, counts) == want
    # cells cut in many pieces; chains of several forms exist
    assert found(spark, counts, piece=200) == want
    assert any(r is not None and r != w[1] for w in want.values() for r in [w[0]])


def test_words_of_texts_and_their_damage(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["Haus-Maus", "ÀÉtude", "naïve9naïve", "the", "banana", "bananas", "BANANA", "x²y"]) for _ in range(200)) for _ in range(60)] + [None, "", "  ", "9 8"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "banana banana"), (5, texts[5])], "doc_id long, text string")
    counts = collections.Counter()
    for i, t in docs.collect():
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    want = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    assert {r.word: r.n for r in variants.vocabulary(variants.damaged_runs(docs)).collect()} == want
    assert found(spark, want) == plain_rows(want)


def test_one_edit_and_empty_tables(spark):
    def near(a, b):
        return bool(variants.one_edit(variants._letters([a], len(a)), variants._letters([b], len(b)))[0])

    assert near("abcde", "abxde") and not near("abcde", "abcde") and not near("abcde", "xbcdx")
    assert near("aaaa", "aaaaa") and near("bcde", "abcde") and near("abcd", "abcde") and not near("abcd", "bcdxa")
    assert variants.grouped(spark.createDataFrame([], "word string, n long")).count() == 0
    assert found(spark, {"alone": 5}) == {"alone": (None, "alone", 5, 0, None)}
