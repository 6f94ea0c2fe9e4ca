"""Statements from positioned text runs: lines, the current-account layout, the balance gate.

Items: household_id, file_id, page, x, y, width, text. Extracting them from bytes is a plug-in: `items_from_bytes` takes
any function from bytes to pages of runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.constants import INDENT, LINE_Y_TOLERANCE, WORD_GAP
from tallyloom.functions.dates import parse_date
from tallyloom.functions.money import WS, parse_cents
from tallyloom.functions.text import first_foreign_iban
from tallyloom.staging import staged

H = ["household_id", "file_id"]
#: The layout's texts.
LAYOUT, VERSION = "current-account-nl", 1
FINGERPRINT, BALANCE, ANNEX = "Belfius Bank NV", "SALDO OP ", "BIJLAGE BIJ VERRICHTING"
PAGE_MARKER = r"^(?:BLZ\.\s*:\s*\d+/\d+|\d{2}-\d{2}-\d{4}\s+\d+/\d+)$"
AMOUNT = r"[+-]\s?(?:\d{1,3}(?:\.\d{3})+|\d+),\d{2}"
BAND = r"^-{2,}\s*([A-Z]{2}\d{2}(?:\s\d{4}){3})(?:\s+BIC:\s*[A-Z0-9]+)?\s*-{2,}$"
BALANCE_LINE = rf"^SALDO OP (\d{{2}}-\d{{2}}-\d{{4}})(?:\s+\d{{2}}:\d{{2}})?\s+EUR\s*({AMOUNT})$"
START = rf"^(\d{{4}})\s(\d{{2}}-\d{{2}}-\d{{4}})\s\(VAL\.\s(\d{{2}}-\d{{2}}-\d{{4}})\)\s+({AMOUNT})$"


@dataclass(frozen=True)
class Layout:
    """How a kind of statement is known and read. A file has it if some line holds the fingerprint and some line begins with
    the balance's words. `band` has the own IBAN, `balance_line` the day and amount, `start` the number, booking day, value
    day and amount of a transaction as groups. `natural`: statement and sequence numbers tell rows apart for good."""

    id: str
    version: int
    fingerprint: str
    balance: str
    annex: str
    page_marker: str
    band: str
    balance_line: str
    start: str
    natural: bool = True


#: In the order in which files are tried.
REGISTRY = (Layout(LAYOUT, VERSION, FINGERPRINT, BALANCE, ANNEX, PAGE_MARKER, BAND, BALANCE_LINE, START),)


def _by_layout(registry: Sequence[Layout], value: Callable[[Layout], Column]) -> Column:
    """What the row's layout says; null where it has none."""
    return F.coalesce(*(F.when(F.col("layout") == r.id, value(r)) for r in registry))


#: What an extractor's failure is told as: it could not be loaded at all, or not read this file.
UNAVAILABLE, FAILED = "module-unavailable", "extraction-failed"
#: Runs after which a batch of small files goes back to Spark.
BATCH = 10_000


def items_from_bytes(files: DataFrame, extract: Callable[[bytes], Iterable[Iterable[tuple[float, float, float, str]]]]) -> tuple[DataFrame, DataFrame]:
    """Items of files (household_id, file_id, content binary) by an extractor that yields, per page, (x, y, width, text), and
    the files that it fails on (household_id, file_id, reason, error: the exception's name).

    A file fails whole: runs of pages before the failure are dropped. A file without content fails too. One without any
    run has neither items nor a failure. Files are read once; what they hold is written before it is told apart.
    """
    kinds = [(n, pa.string()) for n in ("household_id", "file_id")] + [("page", pa.int32())] + [(n, pa.float64()) for n in ("x", "y", "width")] + [(n, pa.string()) for n in ("text", "reason", "error")]
    schema = pa.schema(kinds)

    def read(h: str, f: str, content: bytes | None) -> list[tuple]:
        try:
            if content is None:
                raise ValueError("no content")
            return [(h, f, p, *map(float, run[:3]), run[3], None, None) for p, runs in enumerate(extract(content)) for run in runs]
        except Exception as e:  # an extractor may raise anything; the kind is kept
            return [(h, f, *[None] * 5, UNAVAILABLE if isinstance(e, ImportError) else FAILED, type(e).__name__)]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # small files share a batch, as one for each would cost more than reading it
        rows: list[tuple] = []
        for b in batches:
            for at in zip(*(b.column(c).to_pylist() for c in ("household_id", "file_id", "content"))):
                rows += read(*at)
                if len(rows) >= BATCH:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    told = files.select("household_id", "file_id", "content").mapInArrow(run, "household_id string, file_id string, page int, x double, y double, width double, text string, reason string, error string")
    told = staged(told, "items")
    return told.where("reason IS NULL").drop("reason", "error"), told.where("reason IS NOT NULL").select(*H, "reason", "error")


def lines(items: DataFrame) -> DataFrame:
    """(.., page, line_no, text, x): runs whose baseline is within the tolerance of the line's first run, left to right.

    A line begins at the run that lies too far from the first run of the line before, not from its neighbour, so the
    grouping is a walk; one page is one group, however long the file. Pages come to Python as rows with arrays of runs, many
    in a batch, as a call and a frame for each page would cost more than the walk.
    """
    schema = pa.schema([("household_id", pa.string()), ("file_id", pa.string()), ("page", pa.int32()), ("line_no", pa.int32()), ("text", pa.string()), ("x", pa.float64())])

    def on_page(runs: list[tuple]) -> list[tuple]:
        groups: list[list] = []
        anchor = None
        # highest first, then left to right; runs without a place come last
        for y, x, w, t in sorted((r for r in runs if r[3].strip()), key=lambda r: (r[0] != r[0], -r[0], r[1] != r[1], r[1])):
            if anchor is None or abs(anchor - y) > LINE_Y_TOLERANCE:
                groups.append([])
                anchor = y
            groups[-1].append((x, w, t))
        out = []
        for g in groups:
            g.sort(key=lambda r: r[0])
            text, end = "", None
            for x, w, t in g:
                text += (" " if end is not None and x - end > WORD_GAP else "") + t
                end = x + w
            if text := " ".join(text.split()):
                out.append((len(out), text, g[0][0]))
        return out

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(c).flatten().to_pylist() for c in ("ys", "xs", "widths", "texts")]
            at, found = 0, []
            for h, f, p, n in zip(*(b.column(c).to_pylist() for c in (*H, "page", "n"))):
                found += [(h, f, p, *line) for line in on_page(list(zip(*(c[at : at + n] for c in columns))))]
                at += n
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)

    number = lambda c: F.coalesce(c, F.lit(float("nan"))).alias(c)
    runs = items.where("text IS NOT NULL").select(*H, "page", F.struct(number("y"), number("x"), number("width"), "text").alias("run"))
    pages = runs.groupBy(*H, "page").agg(F.collect_list("run").alias("runs"))
    arrays = [F.col(f"runs.{c}").alias(f"{c}s") for c in ("y", "x", "width", "text")]
    return pages.select(*H, "page", F.size("runs").alias("n"), *arrays).mapInArrow(walk, "household_id string, file_id string, page int, line_no int, text string, x double")


def _fitting(found: DataFrame, registry: Sequence[Layout]) -> DataFrame:
    """(household_id, file_id, fits): the layouts whose marks a file has, in their order."""
    has = [F.bool_or(F.col("text").contains(r.fingerprint)) & F.bool_or(F.col("text").startswith(r.balance)) for r in registry]
    return found.groupBy(*H).agg(F.array_compact(F.array(*(F.when(h, F.lit(r.id)) for h, r in zip(has, registry)))).alias("fits"))


def layouts(found: DataFrame, registry: Sequence[Layout] = REGISTRY) -> DataFrame:
    """(household_id, file_id, template_id, template_version) of the first registered layout whose marks a file has."""
    of = _fitting(found, registry).select(*H, F.try_element_at("fits", F.lit(1)).alias("layout"))
    return of.select(*H, F.col("layout").alias("template_id"), _by_layout(registry, lambda r: F.lit(r.version)).alias("template_version"))


def stale(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Of files with a layout, those whose household stored that layout in another version only (household_id, template_id,
    template_version): they are not parsed by a layout that the user never declared."""
    same = stored.select("household_id", "template_id", "template_version").distinct().withColumn("_same", F.lit(True))
    other = stored.select("household_id", "template_id").distinct()
    known = found.where("template_id IS NOT NULL").join(other, ["household_id", "template_id"], "left_semi")
    return known.join(same, ["household_id", "template_id", "template_version"], "left").where("_same IS NULL").select(*found.columns)


def statements(found: DataFrame, asked: DataFrame | None = None, registry: Sequence[Layout] = REGISTRY) -> tuple[DataFrame, DataFrame]:
    """Rows of the files that parse whole and whose balances agree, and the others with a reason. found: `lines`.

    asked (household_id, file_id, template_id, template_version), if given, is the layout that each file's profile names: a
    file without one, with an unknown one or with another version than the one registered fails, and one without the marks
    of the layout named is not read by another. Without it a file is read by the first layout whose marks it has.
    """
    says = lambda value: _by_layout(registry, value)
    fits = _fitting(found, registry)
    if asked is None:
        read_by = fits.select(*H, F.try_element_at("fits", F.lit(1)).alias("layout"), F.lit(None).cast("string").alias("gate"))
    else:
        named = asked.select(*H, F.col("template_id").alias("layout"), F.col("template_version").alias("_version"))
        gate = F.when(~F.coalesce(F.col("layout").isin([r.id for r in registry]), F.lit(False)), "unknown-template").when(~F.col("_version").eqNullSafe(says(lambda r: F.lit(r.version))), "template-version")
        read_by = fits.join(named, H, "left").select(*H, F.when(F.array_contains("fits", F.col("layout")), F.col("layout")).alias("layout"), gate.alias("gate"))
    read_by = staged(read_by, "layouts")
    found = found.join(read_by.drop("gate"), H)
    page = Window.partitionBy(*H, "page")
    marked = found.withColumn("marker", F.min(F.when(says(lambda r: F.col("text").rlike(r.page_marker)), F.col("line_no"))).over(page))
    lost = marked.where("marker IS NULL").groupBy(*H).agg(F.min("page").alias("page")).select(*H, F.struct("page", F.lit(-1).alias("line_no"), F.lit("page-marker").alias("reason")).alias("e"))
    body = marked.where("line_no > marker")
    body = body.withColumn("annex", F.coalesce(F.first(says(lambda r: F.col("text").startswith(r.annex))).over(page.orderBy("line_no")), F.lit(False))).where("NOT annex").withColumn("margin", F.min("x").over(page))
    t = F.col("text")
    kind = F.when(F.col("x") >= F.col("margin") + INDENT, "indented").when(says(lambda r: t.rlike(r.band)), "band").when(says(lambda r: t.rlike(r.balance_line)), "balance").when(says(lambda r: t.rlike(r.start)), "start").otherwise("other")
    body = body.withColumn("kind", kind)
    so_far = page.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    body = body.withColumn("last", F.last(F.when(F.col("kind").isin("band", "balance", "start"), F.col("kind")), ignorenulls=True).over(so_far))
    begins = F.when(F.col("kind") == "start", says(lambda r: F.regexp_extract("text", r.start, 1)).try_cast("int"))
    body = body.withColumns({"begins": begins, "nth": F.count(begins).over(so_far), "above": F.last(begins, ignorenulls=True).over(page.orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))})
    body = staged(body.drop("margin", "marker", "annex"), "body")  # read by each of the summaries below
    # blocks and sequence numbers run on over pages: a scan of one row a page carries both
    each = body.groupBy(*H, "page").agg(F.count("begins").alias("starts"), F.max_by("begins", F.when(F.col("begins").isNotNull(), F.col("line_no"))).alias("ends_with"))
    pages = Window.partitionBy(*H).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    carried = each.select(*H, "page", F.coalesce(F.sum("starts").over(pages), F.lit(0)).alias("before"), F.last("ends_with", ignorenulls=True).over(pages).alias("carried"))
    body = body.join(carried, [*H, "page"]).withColumns({"block": F.col("before") + F.col("nth"), "gap": F.col("begins") - F.coalesce("above", "carried")})
    stray = body.where("kind = 'other' AND last = 'start'").groupBy(*H).agg(F.min(F.struct("page", "line_no", F.lit("unrecognized-line").alias("reason"))).alias("e"))
    blocks = body.where("last = 'start' AND kind IN ('start', 'indented')").groupBy(*H, "layout", "block").agg(
        F.max(F.when(F.col("kind") == "start", t)).alias("start"),
        F.max("gap").alias("gap"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "indented", F.struct("page", "line_no", "text")))), lambda s: s["text"]).alias("said"),
    )
    part = lambda n: says(lambda r: F.regexp_extract("start", r.start, n))
    dash = lambda c: F.translate(c, "-", "/")
    blocks = blocks.select(*H, "layout", "block", "gap", "start", "said", part(1).alias("sequence_number"), parse_date(dash(part(2)), "DD/MM/YYYY").alias("booking_date"), parse_date(dash(part(3)), "DD/MM/YYYY").alias("value_date"), parse_cents(part(4), "comma").alias("amount_cents"))
    bands = body.where("kind = 'band'").groupBy(*H, F.regexp_replace(says(lambda r: F.regexp_extract("text", r.band, 1)), f"{WS}", "").alias("iban")).agg(F.min(F.struct("page", "line_no")).alias("at"))
    own = bands.groupBy(*H).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "iban"))), lambda s: s["iban"]).alias("account_ibans"))
    cents = parse_cents(says(lambda r: F.regexp_extract("text", r.balance_line, 2)), "comma")
    place = F.struct("page", "line_no")
    balances = body.where("kind = 'balance'").groupBy(*H).agg(F.count(F.lit(1)).alias("n_balances"), F.min_by(cents, place).alias("opening_cents"), F.max_by(cents, place).alias("closing_cents"))
    sums = blocks.groupBy(*H).agg(F.sum("amount_cents").alias("moved"), F.bool_or(F.coalesce(F.col("gap") != 1, F.lit(False))).alias("broken"), F.bool_or(F.col("booking_date").isNull() | F.col("value_date").isNull()).alias("undated"))
    state = found.select(*H).distinct()
    for other in (sums, own, balances, read_by, lost.withColumnRenamed("e", "lost"), stray.withColumnRenamed("e", "stray")):
        state = state.join(other, H, "left")
    first = F.least(F.col("lost"), F.col("stray"))  # the earlier of the two; null only if there is neither
    reason = (
        F.when(F.col("gate").isNotNull(), F.col("gate"))
        .when(F.col("layout").isNull(), "layout-unsupported")
        .when(first.isNotNull(), first["reason"])
        .when(F.col("broken"), "sequence-order")
        .when(F.col("account_ibans").isNull(), "no-account-iban")
        .when(F.coalesce("n_balances", F.lit(0)) < 2, "no-balance-lines")
        .when(F.col("undated"), "transaction-date")
        .when(F.col("opening_cents") + F.coalesce("moved", F.lit(0)) != F.col("closing_cents"), "balance-mismatch")
    )
    state = state.withColumn("reason", reason)
    said = F.array_join("said", " ")
    rows = blocks.join(state.where("reason IS NULL").select(*H, "account_ibans"), H).select(
        *H, F.col("block").cast("long").alias("line_no"), "booking_date", "value_date", "amount_cents", said.alias("description"), F.concat_ws("\n", "start", "said").alias("raw_line"),
        first_foreign_iban(said, F.col("account_ibans")).alias("counterparty_iban"), F.date_format("booking_date", "yyyy").alias("statement_number"), "sequence_number", F.try_element_at("account_ibans", F.lit(1)).alias("account_iban"), says(lambda r: F.lit(r.natural)).alias("natural_key"),
    )
    return rows, state.where("reason IS NOT NULL").select(*H, "reason")
