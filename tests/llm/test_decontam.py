"""Decontamination against a plain version that compares every document with every item, and its recall on changed copies."""

import random

import regex

from tallyloom.llm import decontam

MARK = "¤"


def leaks(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return decontam.leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()


# ---- the plain version


def tokens(text):
    t = regex.sub(decontam.NAMED, r"\1" + MARK, (text or "").translate({ord(c): " " for c in "#@¤_"}))
    t = regex.sub(r"(?<=[0-9])(?=\p{L})", " ", regex.sub(r"(?<=[0-9])[.,:](?=[0-9])", "_", t))
    return [w for w in regex.split(r"[^\p{L}\p{N}_#@¤]+", t.lower()) if w]


def template(raw):
    out = []
    for w in raw:
        number = "0" <= w[0] <= "9" or w in decontam.NUMBER_WORDS
        unit = w in decontam.UNITS and out and out[-1] == "#"
        out.append(MARK if w[0] == MARK else "#" if number else "@" if unit else w)
    return out


def kept_windows(readings, length):
    """(verbatim, at, tokens) of the windows of an item that count."""
    each = []
    for raw in readings:
        form, bare = template(raw), [w.replace(MARK, "") for w in raw]
        for at in range(len(raw) - length + 1):
            each.append((at, form[at : at + length], bare[at : at + length], sum(w not in "#@¤" for w in form[at : at + length])))
    poor = 2 * max(n for *_, n in each) < length
    for at, form, bare, n in each:
        if 2 * n < length:
            yield True, at, bare
        if 2 * n >= length or (poor and n > 0):
            yield False, at, form


def slots(z):
    return {(x["dt"], x["ir"].replace(MARK, ""), x["dr"].replace(MARK, "")) for x in z if x["dt"] in "#@¤"}


def consistent(z):
    return len({s[:2] for s in slots(z)}) == len(slots(z))


def held_runs(z, hit):
    start = 0
    for end in range(len(z) + 1):
        if end < len(z) and hit[end]:
            continue
        run, start = z[start:end], end + 1
        if len(run) < decontam.SHORTEST:
            continue
        literal = [i for i, x in enumerate(run) if x["dt"] not in "#@¤"]
        if not consistent(run) and literal:
            run = run[literal[0] : literal[-1] + 1]
        firm = sum(x["dt"] not in "#@¤" or x["dr"].replace(MARK, "") == x["ir"].replace(MARK, "") for x in run)
        if len(run) >= decontam.SHORTEST and consistent(run) and 2 * firm >= len(run):
            yield run


def plain(text, item):
    """(matched, n_tokens, n_slots) if the text contains the item."""
    doc, own, inner = tokens(text), tokens(item), tokens("x: " + (item or ""))[1:]
    n = len(own)
    if n < decontam.SHORTEST or not doc:
        return None
    length = min(n, decontam.WINDOW)
    form, bare = template(doc), [w.replace(MARK, "") for w in doc]
    shifts = {d - at for verbatim, at, w in kept_windows([own, inner], length) for d in range(len(doc) - length + 1) if (bare if verbatim else form)[d : d + length] == w}
    best, copy, last = [], [], None
    for shift in [*sorted(shifts), None]:
        if copy and (shift is None or shift - last > n):
            spans = [(x["k"], x["k"] + s) for s, _, runs in copy for run in runs for x in run]
            covered = min(len({a for a, _ in spans}), len({b for _, b in spans}))
            longest = max((len(run) for _, _, runs in copy for run in runs), default=0)
            found = [w for _, w, _ in copy if w]
            if covered >= decontam.COVERED * n or longest >= decontam.RUN:
                found.append((covered, sum(len(slots(run)) for _, _, runs in copy for run in runs)))
            best += [(m, n, s) for m, s in [max(found)]] if found else []
            copy = []
        if shift is None:
            break
        z = [{"k": k, "dr": doc[k + shift], "dt": form[k + shift], "ir": own[k], "it": template(own)[k], "inner": template(inner)[k]} for k in range(n) if 0 <= k + shift < len(doc)]
        hit = [x["dt"] in (x["it"], x["inner"]) for x in z]
        same = [x for x, h in zip(z, hit) if h]
        whole = (len(same), len(slots(same))) if consistent(same) and len(same) >= decontam.COVERED * n else None
        copy.append((shift, whole, list(held_runs(z, hit))))
        last = shift
    return max(best) if best else None


def test_leaks_against_a_plain_comparison_of_all_pairs(spark):
    rng = random.Random(31)
    words = "red old tree and walks with under green five km hours 3 4 17 2.5 Tom Sue Anna 40km".split()

    def sentence(n):
        return " ".join(rng.choice(words) + rng.choice(["", "", "", "", ",", "."]) for _ in range(n))

    items = [sentence(rng.randint(2, 34)) for _ in range(40)] + ["", None, "1 2 3 4 5 6 7", "Tom Sue Anna Tom Sue"]
    items.append(items[0])
    texts = [None, "", "red"]
    for _ in range(70):
        body = [sentence(rng.randint(0, 30))]
        for item in rng.sample(items[:40], 2):
            part = item.split()
            for _ in range(rng.randint(0, 4)):
                part[rng.randrange(len(part))] = rng.choice([*words, ""])
            body += [" ".join(part[rng.choice([0, 0, rng.randrange(len(part))]) :]), sentence(rng.randint(0, 12))]
        texts.append(" ".join(body))
    texts.append(texts[5])
    true = {(d, i): found for d, text in enumerate(texts) for i, item in enumerate(items) if (found := plain(text, item))}
    assert len(true) > 60
    assert {(r.doc_id, r.item_id): (r.matched, r.n_tokens, r.n_slots) for r in leaks(spark, texts, items)} == true


# ---- recall


def made_item(rng, word):
    names, values = rng.sample(["Peter", "Susan", "Maria", "Ahmed", "Ingrid", "Paolo"], 2), rng.sample(range(3, 400), 3)
    body = [word() for _ in range(rng.randint(14, 40))]
    for k, said in enumerate([names[0], f"{values[0]} km", names[1], f"{values[1]} hours", str(values[2]), names[0]]):
        body.insert(2 + k * len(body) // 6, said)
    return " ".join(body) + "?", names, values


def test_recall_on_verbatim_reparameterised_and_edited_copies(spark):
    rng = random.Random(32)
    lexicon = ["".join(rng.choice("aeioutnrslmkd") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    word = lambda: rng.choice(lexicon)
    made = [made_item(rng, word) for _ in range(80)]

    def renewed(item, names, values):
        new = dict(zip(names, ["Olga", "Bruno"])) | {str(v): str(1000 + v) for v in values}
        return regex.sub(r"[A-Za-z]+|[0-9]+", lambda m: new.get(m[0], m[0]), item)

    def edited(item, rate):
        out = []
        for w in item.split():
            kind = rng.choice("drix") if rng.random() < rate else "k"
            out += {"d": [], "r": [word()], "i": [word(), w], "x": [w, word()], "k": [w]}[kind]
        return " ".join(out)

    kinds = {"verbatim": lambda m: m[0], "reparameterised": lambda m: renewed(*m), "a tenth of the words edited": lambda m: edited(m[0], 0.1), "both": lambda m: edited(renewed(*m), 0.1)}
    noise = lambda: " ".join(word() for _ in range(60)) + "."
    texts = [f"{noise()} {change(m)} {noise()}" for change in kinds.values() for m in made] + [noise() for _ in range(80)]
    found = {(r.doc_id, r.item_id) for r in leaks(spark, texts, [m[0] for m in made])}
    true = {k: {(at * 80 + i, i) for i in range(80)} for at, k in enumerate(kinds)}
    recall = {k: len(found & t) / 80 for k, t in true.items()}
    print(recall)
    assert recall["verbatim"] == recall["reparameterised"] == 1
    assert min(recall.values()) >= 0.9, recall
    assert found <= set().union(*true.values())


def test_a_long_document_of_one_template_meets_all_its_items(spark):
    """100 sentences of one template in 20,000 tokens, 100 items of that template: each item is in it with other numbers."""
    said = lambda a, b: f"the basket of Anna holds {a} red apples and {b} green pears today"
    between = lambda n: " ".join(f"w{chr(97 + n % 26)}{chr(97 + n // 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(187))
    long = " ".join(f"{said(n + 5, n + 500)} {between(n)}" for n in range(100))
    docs = spark.createDataFrame([(1, long), (2, between(3)), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(n, said(3 * n + 1000, 7 * n + 2000)) for n in range(100)], "item_id long, text string")
    got = decontam.leaks(docs, items)
    assert sorted((r.doc_id, r.item_id, r.matched) for r in got.collect()) == [(1, n, 13) for n in range(100)]
