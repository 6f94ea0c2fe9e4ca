"""Personal data by weak supervision, with DataFrame functions only.

Base spans are what four patterns find, leftmost and not overlapping, less those that fail a check (octets, Luhn, digit
counts); they always stay. Beside them, candidate spans of other kinds come from wide patterns that also find much else:
names, IBANs, national numbers, dates of birth, street addresses, phones without a country code, and long numbers and
dotted quads that are near misses of base kinds: these failed a base check, so they are known to be false and only teach,
as base spans are known to be true; the check that made them known has no vote on them. Labelers of three sorts vote on each candidate and on each base span: a
strict pattern, a gazetteer, and the words before it (CONTEXT code points of spans.py, 30), each saying yes, no or
nothing. Expectation-maximisation estimates from the votes what each labeler says of true and of false spans and how
common true spans are among the candidates of a kind (RAREST at least: whether a kind is rarer, its candidates cannot
tell, and a rare kind must still be found where the words before it are clear). A final classifier over features of the span is fitted to the posteriors by a few Newton
steps around the log-odds of the votes, and candidates it accepts are added. So a vote that the corpus never shows keeps
the weight its labeler earned: words like "lives at" that stand before none of a million false spans are strong evidence
for the first true one.

Both work on the distinct vote-and-feature patterns with their counts: at most kinds x 3^labelers x 2^2 rows, so neither a
hot group nor the size of the corpus changes what the driver sees. Texts are searched once: the candidates with their
votes go to the shared folder, where the estimate and the result read them. The gazetteers of names are parameters
(module values that may be set to larger ones; they are looked up by hash).

Positions are code points, end exclusive. Null and empty texts have no spans. Repeated rows each get a row, and a table
without any candidate simply has none accepted; a table without rows gives none. Ties: a span whose score is exactly
that of ACCEPT is added. Long texts are searched whole, in proportion to their length and spans.
Columns of docs stay, but for those named like a result, which are replaced. Patterns are possessive where that changes
no match, so that a long run of digits or dots is walked once and needs no stack.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import Store
from tallyloom.llm.spans import NO_SPANS, apart_from, let, match_spans

#: The base patterns. \\G or a lookbehind lets a match start only where the leftmost one can.
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this cannot hold a match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
KINDS = list(BASE)

NAME = r"\p{Lu}\p{Ll}{1,20}"
WIDE = {
    "name": rf"(?<![\p{{L}}\p{{N}}]){NAME}(?:[ -]{NAME}){{1,2}}(?![\p{{L}}\p{{N}}])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "national": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "birth": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4})(?![0-9/.-])",
    "address": r"(?<![\p{L}\p{N}])[0-9]{1,5} \p{Lu}[\p{L}]{1,20}(?: \p{Lu}[\p{L}]{1,20}){0,2}(?![\p{L}\p{N}])",
    "local_phone": r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "number": r"(?<![0-9-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9-])",
    "quad": r"(?<![0-9.])[0-9]++(?:\.[0-9]++){3}(?![0-9.])",
}
#: Kinds whose strict pattern only says no: any date may be one of birth. Kinds that a base check has rejected.
ONLY_NO = ("birth",)
NEAR_MISSES = ("number", "quad")
#: No match of a wide pattern is shorter.
SHORTEST = 4
#: What must stand in a text for a kind to be looked for, the strict patterns, the words before a span.
HINT = {
    "name": rf"{NAME}[ -]{NAME}",
    "iban": r"[A-Z]{2}[0-9]{2}[ A-Z0-9]{11}",
    "national": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "birth": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9][/.][0-9]{4}",
    "address": r"[0-9] \p{Lu}",
    "local_phone": r"[0-9]{3}[ .-][0-9]{4}",
    "number": r"[0-9][0-9 -]{11}",
    "quad": r"[0-9]\.[0-9]+\.",
}
STRICT = {
    "iban": r"^(?:BE[0-9]{2}( ?[0-9]{4}){3}|DE[0-9]{2}( ?[0-9]{4}){4} ?[0-9]{2}|FR[0-9]{2}( ?[0-9A-Z]{4}){5} ?[0-9A-Z]{3}|ES[0-9]{2}( ?[0-9]{4}){5}|NL[0-9]{2} ?[A-Z]{4}( ?[0-9]{4}){2} ?[0-9]{2}|GB[0-9]{2} ?[A-Z]{4}( ?[0-9]{4}){3} ?[0-9]{2})$",
    "national": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "birth": r"^(?:(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[/.](?:0?[1-9]|1[0-2])[/.](?:19|20)[0-9]{2})$",
    "address": r"(?i) (?:street|st|avenue|ave|road|rd|lane|drive|boulevard|square|court|way|terrace|place|close|crescent|rue|platz|strasse|stra\u00dfe|weg|calle|avenida|plaza)$",
    "local_phone": r"^\(?[2-9][0-9]{2}\)?[ .-]?[2-9][0-9]{2}[.-][0-9]{4}$",
}
CONTEXT = {
    "name": r"(?i)(?:\bmr|\bmrs|\bms|\bdr|\bprof|\bname(?: is)?|\bsincerely|\bregards|\bherr|\bfrau|\bmonsieur|\bmadame|\bseñora?|\bcontact|\bsigned)[.:,]?\s*$",
    "iban": r"(?i)(?:iban|account|konto|compte|cuenta)[^\n]{0,12}$",
    "national": r"(?i)(?:ssn|social security|national|id)[^\n]{0,12}$",
    "birth": r"(?i)(?:born|birth|dob|né|née|geboren|nacid[oa])[^\n]{0,12}$",
    "address": r"(?i)(?:address|lives? at|resid\w+ at|ship to)[^\n]{0,12}$",
    "local_phone": r"(?i)(?:tel|phone|call|fax|mobile|cell|reach)[^\n]{0,12}$",
    "number": r"(?i)(?:card|visa|credit|debit|amex|karte|carte|tarjeta)[^\n]{0,12}$",
    "quad": r"(?i)(?:\bip|host|server|client|address)[^\n]{0,12}$",
    "email": r"(?i)(?:mail|contact|write|reach|address)[^\n]{0,12}$",
    "ip": r"(?i)(?:\bip|host|server|client|address)[^\n]{0,12}$",
    "card": r"(?i)(?:card|visa|credit|debit|amex|karte|carte|tarjeta)[^\n]{0,12}$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell|reach)[^\n]{0,12}$",
}
AGAINST = {
    "name": r"[.!?\n]\s*$|^\s*$",
    "iban": r"(?i)(?:order|serial|part|model|ref)[^\n]{0,12}$",
    "national": r"(?i)(?:isbn|part|serial|order|phone|tel|fax)[^\n]{0,12}$",
    "birth": r"(?i)(?:published|updated|release|version|due|on|since)\s*$",
    "address": r"(?i)(?:page|chapter|section|version|vol)[^\n]{0,12}$",
    "local_phone": r"(?i)(?:part|order|serial|ref|model)[^\n]{0,12}$",
    "number": r"(?i)(?:order|serial|part|ref|id|isbn|invoice|tracking)[^\n]{0,12}$",
    "quad": r"(?i)(?:version|release|section|v)\s*$",
    "email": r"(?i)(?:example|such as)\s*$",
    "ip": r"(?i)(?:version|release|section|v)\s*$",
    "card": r"(?i)(?:order|serial|part|ref|id|isbn|invoice|tracking)[^\n]{0,12}$",
    "phone": r"(?i)(?:part|order|serial|ref|model)[^\n]{0,12}$",
}
#: Common given names and family names; whoever has larger lists sets them here.
GIVEN = (
    "adam alan albert alex alexander alice amanda amy ana andrea andrew angela anna anne anthony antonio arthur barbara benjamin bernd brian bruno camille carlos carmen carol catherine charles charlotte christian christine claire claudia daniel "
    "david deborah dennis diana diego dieter donald edward elena elizabeth emily emma eric eva fabian felix fernando florian francis frank françois gabriel george gerard gloria hans heinz helen helga henry hugo ingrid isabel jacob jacques james "
    "jan jane jason javier jean jennifer jessica joan john jonathan jorge joseph josé juan julia julien jürgen karen karl katharina kevin klaus laura linda lisa louis lucas lucía luis manuel marco margaret maria marie mario mark martin mary "
    "matthew michael miguel monika nancy nicolas nicole oliver olivier pablo patricia paul pedro peter petra philip pierre rachel rebecca richard robert ruth samuel sandra sara sarah simon sofia sophie stefan stephen steven susan thomas ursula walter william wolfgang"
).split()
FAMILY = (
    "smith johnson williams brown jones miller davis garcia rodriguez wilson martinez anderson taylor thomas hernandez moore martin jackson thompson white lopez lee gonzalez harris clark lewis robinson walker perez hall young allen sanchez wright "
    "king scott green baker adams nelson hill ramirez campbell mitchell roberts carter phillips evans turner torres parker collins edwards müller schmidt schneider fischer weber meyer wagner becker schulz hoffmann schäfer koch bauer richter klein "
    "wolf schröder neumann schwarz zimmermann braun krüger hofmann lange werner bernard dubois durand moreau laurent simon michel lefebvre leroy roux fournier girard bonnet dupont lambert fontaine rousseau fernández gómez díaz ruiz álvarez moreno muñoz romero navarro torres"
).split()
#: A gazetteer's pattern for the kinds that it says something on; names are looked up word by word.
GAZETTEER = {
    "name": None,
    "iban": r"^(?:AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM)",
    "address": r"(?iu) (?:main|oak|park|elm|maple|church|high|station|king|queen|mill|school|cedar|pine|lake|hill|washington|bahnhof|haupt|garten|kirch|gare|église|mayor)\b",
    "number": r"^(?:4|5[1-5]|3[47]|6(?:011|5)|2[2-7])",
    "card": r"^(?:4|5[1-5]|3[47]|6(?:011|5)|2[2-7])",
    "email": r"(?i)\.(?:com|org|net|edu|gov|io|info|de|fr|es|uk|be|nl|it|ch|at|eu)$",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
}
LABELERS = ("strict", "gazetteer", "context")
#: Labelers that look at every kind, so that their silence is an outcome too; the others are silent by the span's kind.
HEARD = ("context",)
EM_ROUNDS, NEWTON_ROUNDS, ACCEPT = 25, 8, 0.5
#: The share of true spans among a kind's candidates: as held before any is seen, and the least.
PRIOR, RAREST = 0.3, 0.02
#: Pseudo-counts of each labeler's no, silence and yes on true and on false spans: right more often than not.
HELD = {1: {-1: 0.5, 0: 4.5, 1: 5.0}, 0: {-1: 3.0, 0: 6.5, 1: 0.5}}
HELD_OF_KIND = {1: {-1: 1.5, 1: 8.5}, 0: {-1: 8.5, 1: 1.5}}
FEATURES = ("one", "form_yes", "form_no", "listed_yes", "listed_no", "before_yes", "before_no", "digits", "long", *(k for k in WIDE if k not in NEAR_MISSES))


def _luhn(digits: Column) -> Column:
    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    each = F.transform(F.split(F.reverse(digits), ""), weigh)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(value: Column) -> Column:
    return F.translate(value, " -().+", "")


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: F.ltrim(p, F.lit("0")).rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
    "card": lambda v: F.when(F.length(_digits(v)).between(14, 19), _luhn(_digits(v))).otherwise(False),
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
}
VOTED = "cast(array() as array<struct<kind:string,start:int,end:int,votes:array<int>,x:array<double>>>)"


def base_spans(text: Column) -> dict[str, Column]:
    """Per kind the spans that pass its check."""
    out = {}
    for kind, pattern in BASE.items():
        there = text.contains(NEEDS[kind]) if NEEDS[kind] else text.rlike("[0-9][0-9 -]{12}")
        out[kind] = F.when(there, F.filter(match_spans(text, pattern), _passes(kind))).otherwise(F.expr(NO_SPANS))
    return out


def _passes(kind: str):
    return lambda s: VALID[kind](s["value"])


def _listed(value: Column, kind: str) -> Column | None:
    """What the gazetteer says: for names, that one of the words is a given name or the last a family name."""
    if kind == "name":
        words = F.split(F.lower(value), "[ -]")
        return F.exists(words, lambda w: w.isin(GIVEN)) | F.element_at(words, -1).isin(FAMILY)
    return value.rlike(GAZETTEER[kind]) if kind in GAZETTEER else None


def _voted(s: Column, kind: str) -> Column:
    """A span with the votes of the labelers and the features of the classifier."""
    value, before = s["value"], s["before"]
    yes, no, none = before.rlike(CONTEXT[kind]), before.rlike(AGAINST[kind]), F.lit(0)
    known = kind in BASE or kind in NEAR_MISSES
    strict = None if known or kind not in STRICT else value.rlike(STRICT[kind])
    listed = _listed(value, kind)
    says = lambda c: none if c is None else F.when(c, 1).otherwise(-1)
    form = F.when(strict, 0).otherwise(-1) if kind in ONLY_NO else says(strict)
    votes = F.array(form, says(listed), F.when(yes, 1).when(no, -1).otherwise(0))

    def with_features(v: Column) -> Column:
        each = [F.lit(True), *(v[j] == said for j in range(len(LABELERS)) for said in (1, -1)), value.rlike("[0-9]"), F.length(value) > 14, *(F.lit(kind == k) for k in FEATURES if k in WIDE)]
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), v.alias("votes"), F.array(*(c.cast("double") for c in each)).alias("x"))

    return let(votes, with_features)


def _with_votes(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: _voted(s, kind))


def candidates(text: Column) -> Column:
    """All spans of the wide patterns, with votes and features."""
    found = [F.when(text.rlike(HINT[k]), _with_votes(match_spans(text, p, SHORTEST), k)) for k, p in WIDE.items()]
    return F.concat(*(F.coalesce(f, F.expr(VOTED)) for f in found))


def outcomes(patterns: list[tuple]) -> tuple[dict[str, float], list[dict[int, list[float]]]]:
    """EM over (votes, count) or (votes, count, truth, kind): each kind's prior, and per labeler and vote
    [P(vote | false), P(vote | true)].

    A vote is -1, 0 or 1; truth is 1 or 0 where it is known, else -1. The silence of a labeler in HEARD is an outcome
    like the others; that of another is no evidence, as it is the span's kind that makes it silent. Pseudo-counts of a
    few spans hold that labelers are right more often than not, which tells the two classes apart.
    """
    rows = [(votes, c, *(rest or (-1, ""))) for votes, c, *rest in patterns]
    held = [HELD if name in HEARD else HELD_OF_KIND for name in LABELERS]

    def shares(counts: list[dict[int, list[float]]]) -> list[dict[int, list[float]]]:
        whole = [[sum(v[k] for v in by.values()) for k in (0, 1)] for by in counts]
        return [{v: [x / w for x, w in zip(each, sums)] for v, each in by.items()} for by, sums in zip(counts, whole)]

    start = lambda: [{v: [h[0][v], h[1][v]] for v in h[0]} for h in held]
    n = {kind: sum(c for _, c, t, k in rows if k == kind and t < 0) for kind in {k for *_, k in rows}}
    prior, says = dict.fromkeys(n, PRIOR), shares(start())
    for _ in range(EM_ROUNDS):
        true, counts = dict.fromkeys(n, 0.0), start()
        for votes, c, truth, kind in rows:
            q = _posterior(votes, prior[kind], says, truth)
            true[kind] += c * q * (truth < 0)
            for by, v in zip(counts, votes):
                if v in by:
                    by[v][0] += c * (1 - q)
                    by[v][1] += c * q
        prior = {k: min(0.95, max(RAREST, (true[k] + 10 * PRIOR) / (n[k] + 10))) for k in n}
        says = shares(counts)
    return prior, says


def _log_odds(votes: tuple[int, ...], p: float, says: list[dict[int, list[float]]]) -> float:
    return math.log(p / (1 - p)) + sum(math.log(by[v][1] / by[v][0]) for by, v in zip(says, votes) if v in by)


def _posterior(votes: tuple[int, ...], p: float, says: list[dict[int, list[float]]], truth: int = -1) -> float:
    return float(truth) if truth >= 0 else 1 / (1 + math.exp(-max(-50.0, min(50.0, _log_odds(votes, p, says)))))


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[float], list[float]]:
    """Of spans of one kind the prior, and per labeler P(yes | true) and P(yes | false) where it does not stay silent."""
    prior, says = outcomes(patterns)
    share = lambda by, k: by[1][k] / (by[1][k] + by[-1][k])
    return prior.get("", PRIOR), [share(by, 1) for by in says], [share(by, 0) for by in says]


def evidence(prior: dict[str, float], says: list[dict[int, list[float]]]) -> list[float]:
    """The log-odds of the votes as weights of FEATURES."""
    silent = [math.log(by[0][1] / by[0][0]) if 0 in by else 0.0 for by in says]
    weights = dict.fromkeys(FEATURES, 0.0) | {"one": sum(silent)}
    for name, by, quiet in zip(("form", "listed", "before"), says, silent):
        weights |= {f"{name}_{said}": math.log(by[v][1] / by[v][0]) - quiet for said, v in (("yes", 1), ("no", -1))}
    for kind in FEATURES:
        if kind in WIDE:
            p = prior.get(kind, PRIOR)
            weights[kind] = math.log(p / (1 - p))
    return list(weights.values())


def classifier(rows: list[tuple[tuple[float, ...], float, float]], centre: list[float]) -> list[float]:
    """Weights of a logistic regression on (features, count, mean posterior) rows, held to the centre by a ridge."""
    d, w = len(FEATURES), list(centre)
    for _ in range(NEWTON_ROUNDS if rows else 0):
        grad, hess = [m - x for x, m in zip(w, centre)], [[1.0 * (i == j) for j in range(d)] for i in range(d)]
        for x, c, q in rows:
            z = sum(a * b for a, b in zip(w, x))
            m = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            for i in range(d):
                grad[i] += c * (q - m) * x[i]
                for j in range(d):
                    hess[i][j] += c * max(m * (1 - m), 1e-6) * x[i] * x[j]
        w = [max(-12.0, min(12.0, a + b)) for a, b in zip(w, _solved(hess, grad))]
    return w


def _solved(m: list[list[float]], v: list[float]) -> list[float]:
    n, a = len(v), [[*r, x] for r, x in zip(m, v)]
    for i in range(n):
        k = max(range(i, n), key=lambda r: abs(a[r][i]))
        a[i], a[k] = a[k], a[i]
        for r in range(n):
            if r != i:
                f = a[r][i] / a[i][i]
                a[r] = [x - f * y for x, y in zip(a[r], a[i])]
    return [a[i][n] / a[i][i] for i in range(n)]


def _clear(wide: Column, base: Column) -> Column:
    """Wide spans that overlap no base span, by their starts."""
    keyed = F.array_sort(F.transform(wide, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s.alias("s"))))
    return F.transform(apart_from(keyed, base), lambda k: k["s"])


def searched(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`row` (the columns of docs, or those in keep), `base` and `wide`: spans with their votes and features.

    A wide span that overlaps a base span is left out.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = F.concat(*(_with_votes(c, k) for k, c in base_spans(t).items()))
    # spans ride beside the row, so that no column of it can be in their way
    both = docs.select(F.struct(*(docs.columns if keep is None else keep)).alias("row"), base.alias("base"), candidates(t).alias("wide"))
    return both.select("row", "base", _clear(F.col("wide"), F.col("base")).alias("wide"))


def _tallied(found: DataFrame) -> DataFrame:
    marked = lambda name: F.transform(name, lambda s: F.struct(F.lit(name == "base").alias("base"), s["kind"].alias("kind"), s["votes"].alias("votes"), s["x"].alias("x")))
    return found.select(F.explode(F.concat(marked("base"), marked("wide"))).alias("s")).groupBy("s.base", "s.kind", "s.votes", "s.x").count()


def tally(docs: DataFrame, text: str = "text") -> DataFrame:
    """(base, kind, votes, x, count): how often each pattern of votes and features stands on base spans and others."""
    return _tallied(searched(docs, text, []))


def _fitted(tallied: DataFrame) -> list[float]:
    rows = tallied.collect()  # at most 12 kinds x 3^3 x 2^2 rows
    each = sorted((tuple(r["votes"]), r["count"], 1 if r["base"] else 0 if r["kind"] in NEAR_MISSES else -1, r["kind"], tuple(r["x"])) for r in rows)
    prior, says = outcomes([r[:4] for r in each])
    # known spans teach what the labelers are worth; what the classifier decides are the others
    open_ = [(x, float(c), _posterior(votes, prior[kind], says)) for votes, c, truth, kind, x in each if truth < 0]
    return classifier(open_, evidence(prior, says))


def fit(docs: DataFrame, text: str = "text") -> list[float]:
    """Weights of the span classifier, from the votes on every span of docs; its input is one row per vote pattern."""
    return _fitted(tally(docs, text))


def find(docs: DataFrame, weights: list[float] | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone, `base` and `spans` (arrays of kind, start, end; by start, then kind as listed).

    An added span that overlaps a base span is left out; of two added ones that overlap both stay. keep names the columns
    of docs that the result carries (all). Without weights they are fitted on docs; then the kept columns and the spans
    are written to the shared folder once, and a caller who does not want the texts back should leave them out of keep.
    """
    columns = docs.columns if keep is None else keep
    found = searched(docs, text, columns)
    if weights is None:
        found = Store(docs.sparkSession, "pii").put(found, "spans")
        weights = _fitted(_tallied(found))
    slim = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    score = lambda s: sum((F.lit(w) * s["x"][i] for i, w in enumerate(weights)), F.lit(0.0))
    order = [*KINDS, *WIDE]
    rank = lambda s: F.array_position(F.array(*map(F.lit, order)), s["kind"]).cast("int")
    sort = lambda spans: slim(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], rank(s).alias("rank"), s["end"], s["kind"]))))
    accepted = F.filter("wide", lambda s: ~s["kind"].isin(*NEAR_MISSES) & (score(s) >= math.log(ACCEPT / (1 - ACCEPT))))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    made = {f"n_{k}": count(k) for k in KINDS} | {"base": sort(slim(F.col("base"))), "spans": sort(F.concat(slim(F.col("base")), slim(accepted)))}
    found = found.select(F.col("row").alias("_row"), F.struct(*(v.alias(n) for n, v in made.items())).alias("_made"))
    return found.select(*(F.col("_row")[c].alias(c) for c in columns if c not in made), *(F.col("_made")[n].alias(n) for n in made))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
