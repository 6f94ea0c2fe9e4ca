"""Registered queries over the test tables, each with the SQL that DuckDB runs beside it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import dates, money, text
from tallyloom.operators import dedup, ledger, merchants
from tallyloom.operators.numbering import numbered
from tallyloom.plans import incremental, month
from tallyloom.plans.interpret import Interpretation, interpret, interpretation_summary, matched_sides, window_facts
from tallyloom.plans.testbed import Ledger, plain_sql
from tallyloom.sources import delimited, ingest, positioned, profile
from tallyloom.staging import shared_folder, staged

H = "household_id"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# ---- the same semantics in SQL, for comparison only

_FLOWS = r"""
ring AS (SELECT *, CASE WHEN role = 'RESERVE' AND iban IS NOT NULL THEN 'reserve' WHEN role = 'RESERVE' THEN NULL WHEN iban IS NULL THEN 'card' ELSE 'pot' END AS ring FROM acct),
potf AS (SELECT f.*, a.iban AS own_iban, a.ring = 'card' AS is_card FROM facts f JOIN ring a ON a.household_id = f.household_id AND a.id = f.account_id WHERE a.role = 'POT'),
cardimp AS (SELECT household_id, import_id, min(account_id) AS account_id, CAST(sum(CASE WHEN amount_cents < 0 THEN -amount_cents ELSE 0 END) AS BIGINT) AS settlement_total_cents, max(booking_date) AS period_end FROM potf WHERE is_card GROUP BY 1, 2),
rkey AS (SELECT *, CASE WHEN counterparty_iban IS NOT NULL THEN 'iban:' || replace(upper(counterparty_iban), ' ', '') ELSE 'text:' || trim(regexp_replace(upper(coalesce(counterparty_name, description)), '\s+', ' ', 'g')) END AS refund_key FROM potf),
outkeys AS (SELECT DISTINCT household_id, refund_key FROM rkey WHERE amount_cents < 0),
setcand AS (SELECT d.household_id, d.id AS debit_id, d.account_id AS debit_account, -d.amount_cents AS cents, d.booking_date AS debit_date, c.import_id AS card_import_id, c.account_id AS card_account, c.period_end, abs(datediff('day', c.period_end, d.booking_date)) AS distance
  FROM potf d JOIN cardimp c ON c.household_id = d.household_id AND c.settlement_total_cents = -d.amount_cents
  WHERE d.amount_cents < 0 AND regexp_matches(d.description, 'MASTERCARD\s+AFREKENING\s+NUMMER', 'i') AND c.account_id <> d.account_id AND c.settlement_total_cents > 0 AND abs(datediff('day', c.period_end, d.booking_date)) <= 45),
flows0 AS (SELECT r.*,
    EXISTS (SELECT 1 FROM ring a WHERE a.household_id = r.household_id AND a.iban = r.counterparty_iban AND a.ring = 'reserve') AS to_reserve,
    EXISTS (SELECT 1 FROM ring a WHERE a.household_id = r.household_id AND a.iban = r.counterparty_iban AND a.ring = 'pot') AS to_pot,
    r.amount_cents > 0 AND r.is_card AND regexp_matches(r.description, 'DOMICILIERING\s+VIA\s+JE\s+BANK', 'i') AS mirror0,
    r.amount_cents < 0 AND regexp_matches(r.description, 'MASTERCARD\s+AFREKENING\s+NUMMER', 'i') AS debit0,
    r.id IN (SELECT debit_id FROM setcand) AS has_import, (r.household_id, r.refund_key) IN (SELECT (household_id, refund_key) FROM outkeys) AS paid_before,
    regexp_matches(r.description, 'GELDOPNAME|GELDAFHALING|CASH\s+WITHDRAWAL', 'i') AS says_cash FROM rkey r),
flows AS (SELECT *, CASE WHEN to_reserve THEN 'RESERVE' WHEN to_pot OR mirror0 OR (debit0 AND has_import) THEN 'INTERNAL' WHEN amount_cents < 0 THEN 'SPEND' WHEN amount_cents > 0 AND paid_before THEN 'SPEND' WHEN amount_cents > 0 THEN 'INCOME' ELSE 'UNRESOLVED' END AS flow,
    NOT to_reserve AND NOT to_pot AND NOT debit0 AND amount_cents < 0 AND says_cash AS is_cash, NOT to_reserve AND NOT to_pot AND mirror0 AS mirror_credit, NOT to_reserve AND NOT to_pot AND debit0 AND has_import AS pattern_debit FROM flows0)
"""


def _walk(name: str, edges: str, part: str, left: str, right: str, order: str) -> str:
    """A recursive walk over the edges of each component in order, with the list of ends used so far."""
    return f"""
{name}_e AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS rk FROM {edges}),
{name}_w AS (
  SELECT {part}, 0::BIGINT AS rk, []::VARCHAR[] AS used, NULL::VARCHAR AS l, NULL::VARCHAR AS r FROM {name}_e WHERE rk = 1
  UNION ALL
  SELECT {', '.join('e.' + p.strip() for p in part.split(','))}, e.rk,
    CASE WHEN list_contains(w.used, 'l' || e.{left}) OR list_contains(w.used, 'r' || e.{right}) THEN w.used ELSE list_concat(w.used, ['l' || e.{left}, 'r' || e.{right}]) END,
    CASE WHEN list_contains(w.used, 'l' || e.{left}) OR list_contains(w.used, 'r' || e.{right}) THEN NULL ELSE e.{left} END,
    CASE WHEN list_contains(w.used, 'l' || e.{left}) OR list_contains(w.used, 'r' || e.{right}) THEN NULL ELSE e.{right} END
  FROM {name}_w w JOIN {name}_e e ON {' AND '.join(f'e.{p.strip()} = w.{p.strip()}' for p in part.split(','))} AND e.rk = w.rk + 1),
{name} AS (SELECT {part}, l AS {left}, r AS {right} FROM {name}_w WHERE l IS NOT NULL)"""


_SETTLED = _walk("alloc", "setcand", "household_id, cents", "debit_id", "card_import_id", "distance, debit_id, card_import_id")
_MIRRORS = (
    """
settled AS (SELECT a.*, s.card_account, s.debit_date FROM alloc a JOIN setcand s USING (household_id, debit_id, card_import_id)),
mircand AS (SELECT s.household_id, s.card_account, s.cents, s.debit_id, c.id AS credit_id, abs(datediff('day', s.debit_date, c.booking_date)) AS distance FROM settled s JOIN flows c ON c.household_id = s.household_id AND c.account_id = s.card_account AND c.amount_cents = s.cents AND c.mirror_credit WHERE abs(datediff('day', s.debit_date, c.booking_date)) <= 4),"""
    + _walk("mirrors", "mircand", "household_id, card_account, cents", "debit_id", "credit_id", "debit_id, distance, credit_id")
)
_ROWS0 = """
flows2 AS (SELECT f.* EXCLUDE (flow), CASE WHEN f.pattern_debit AND f.id NOT IN (SELECT debit_id FROM alloc) THEN 'SPEND' ELSE f.flow END AS flow FROM flows f),
legs AS (SELECT * FROM flows2 WHERE flow = 'INTERNAL' AND NOT pattern_debit AND NOT mirror_credit),
tracand AS (SELECT o.household_id, -o.amount_cents AS cents, o.own_iban AS from_iban, o.counterparty_iban AS to_iban, o.id AS out_id, i.id AS in_id, o.account_id AS out_account, i.account_id AS in_account, o.booking_date AS out_date, i.booking_date AS in_date, abs(datediff('day', o.booking_date, i.booking_date)) AS distance
  FROM legs o JOIN legs i ON i.household_id = o.household_id AND i.amount_cents = -o.amount_cents AND i.own_iban = o.counterparty_iban AND i.counterparty_iban = o.own_iban
  WHERE o.amount_cents < 0 AND i.amount_cents > 0 AND o.account_id <> i.account_id AND abs(datediff('day', o.booking_date, i.booking_date)) <= 4)"""
_PAIRS = _walk("pairs", "tracand", "household_id, cents, from_iban, to_iban", "out_id", "in_id", "distance, out_id, in_id")
_ROWS = """
links AS (SELECT s.household_id, s.debit_id AS outgoing_id, m.credit_id AS incoming_id, s.card_import_id FROM settled s LEFT JOIN mirrors m ON m.household_id = s.household_id AND m.debit_id = s.debit_id UNION ALL SELECT household_id, out_id, in_id, NULL FROM pairs),
sides AS (SELECT household_id, outgoing_id AS id, incoming_id AS partner_id FROM links WHERE incoming_id IS NOT NULL UNION ALL SELECT household_id, incoming_id, outgoing_id FROM links WHERE incoming_id IS NOT NULL),
interp AS (SELECT f.*, strftime(booking_date, '%Y-%m') AS month, s.id IS NOT NULL AS matched, coalesce(strftime(p.pday, '%Y-%m') <> strftime(booking_date, '%Y-%m'), false) AS in_transit, f.flow = 'INTERNAL' AND s.id IS NULL AS is_unmatched
  FROM flows2 f LEFT JOIN sides s ON s.household_id = f.household_id AND s.id = f.id LEFT JOIN (SELECT household_id AS ph, id AS pid, booking_date AS pday FROM flows2) p ON p.ph = f.household_id AND p.pid = s.partner_id)"""
_NORMAL = "trim(regexp_replace(regexp_replace({0}, 'BETALING MET DEBETKAART |BANCONTACT', '', 'g'), ' 9000 GENT$', ''))"
_MERCH = f"""
ntexts AS (SELECT DISTINCT household_id, coalesce(counterparty_name, description) AS raw, {_NORMAL.format('coalesce(counterparty_name, description)')} AS text FROM interp WHERE flow IN ('INCOME', 'SPEND')),
nmatch AS (SELECT t.household_id, t.text, r.id AS rule_id, r.merchant_id, row_number() OVER (PARTITION BY t.household_id, t.text ORDER BY CASE r.kind WHEN 'EXACT' THEN 1 WHEN 'PREFIX' THEN 2 ELSE 3 END, length(r.pattern) DESC, r.pattern, r.id) AS rn
  FROM (SELECT DISTINCT household_id, text FROM ntexts) t JOIN rules r ON r.household_id = t.household_id
  WHERE (r.kind = 'EXACT' AND t.text = r.pattern) OR (r.kind = 'PREFIX' AND starts_with(t.text, r.pattern)) OR (r.kind = 'PATTERN' AND t.text GLOB r.pattern)),
ruled AS (SELECT household_id, text, merchant_id, rule_id FROM nmatch WHERE rn = 1),
resolved AS (SELECT i.*, u.merchant_id, t.text AS normal_text, m.name AS merchant_name, g.name AS primary_tag
  FROM interp i LEFT JOIN ntexts t ON t.household_id = i.household_id AND i.flow IN ('INCOME', 'SPEND') AND t.raw = coalesce(i.counterparty_name, i.description)
  LEFT JOIN ruled u ON u.household_id = i.household_id AND u.text = t.text LEFT JOIN merchants m ON m.household_id = i.household_id AND m.id = u.merchant_id
  LEFT JOIN merchant_tags mt ON mt.household_id = i.household_id AND mt.merchant_id = u.merchant_id AND mt.is_primary LEFT JOIN tags g ON g.household_id = i.household_id AND g.id = mt.tag_id)"""
_FOLD = """
counted AS (SELECT household_id, month, flow, merchant_id, merchant_name, primary_tag, coalesce(counterparty_name, description) AS counterparty_text, normal_text, says_cash AS is_cash, CAST(sum(amount_cents) AS BIGINT) AS total_cents, count(*) AS row_count FROM resolved WHERE flow IN ('INCOME', 'SPEND') GROUP BY ALL),
fold0 AS (SELECT household_id, month, flow, CASE WHEN is_cash THEN 'cash' WHEN flow = 'SPEND' AND merchant_id IS NOT NULL AND primary_tag IS NOT NULL THEN 'tag:' || primary_tag WHEN merchant_id IS NOT NULL THEN 'merchant:' || merchant_id ELSE 'text:' || normal_text END AS group_key,
  CASE WHEN is_cash THEN 'cash' WHEN flow = 'SPEND' AND merchant_id IS NOT NULL AND primary_tag IS NOT NULL THEN 'tag' WHEN merchant_id IS NOT NULL THEN 'merchant' ELSE 'unresolved' END AS kind,
  CASE WHEN is_cash THEN '' WHEN flow = 'SPEND' AND merchant_id IS NOT NULL AND primary_tag IS NOT NULL THEN primary_tag WHEN merchant_id IS NOT NULL THEN merchant_name ELSE normal_text END AS label, total_cents, row_count FROM counted),
fold AS (SELECT household_id, month, flow, group_key, kind, min(label) AS label, CAST(sum(total_cents) AS BIGINT) AS total_cents, CAST(sum(row_count) AS BIGINT) AS row_count FROM fold0 GROUP BY 1, 2, 3, 4, 5),
moved AS (SELECT f.household_id, f.month, f.counterparty_iban, coalesce(a.label, f.counterparty_iban) AS label, CAST(-sum(amount_cents) AS BIGINT) AS parked_cents, count(*) AS row_count FROM interp f LEFT JOIN acct a ON a.household_id = f.household_id AND a.iban = f.counterparty_iban WHERE f.flow = 'RESERVE' GROUP BY 1, 2, 3, 4)"""
_CHAIN = {"facts": "", "flows": _FLOWS, "alloc": _SETTLED, "mirrors": _MIRRORS, "legs": _ROWS0, "pairs": _PAIRS, "interp": _ROWS, "merch": _MERCH, "fold": _FOLD}


def _sql(upto: str, select: str) -> str:
    names = list(_CHAIN)
    parts = [plain_sql(), *(_CHAIN[n] for n in names[1 : names.index(upto) + 1])]
    return "WITH RECURSIVE " + ",".join(parts) + "\n" + select.lstrip()


def query(name: str, upto: str | None = None, sql: str | None = None):
    """Registers a query; with `sql` also what DuckDB compares it with (behind the ledger's text up to a step, if named)."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql if upto is None else _sql(upto, sql)
        return f

    return add


def _interpreted(spark: SparkSession, d: str, rules: bool = False) -> tuple[Ledger, Interpretation]:
    book = Ledger(spark, d)
    return book, interpret(book.facts_once, book.accounts, book.rules if rules else None)


_FIGURES = """SELECT household_id, month, income_cents, spend_cents, net_to_reserves_cents, change_in_pot_cents, unresolved_cents, unresolved_count, unmatched_internal_cents, unmatched_internal_count, in_transit_cents, in_transit_count, uninterpreted_count, row_count,
 change_in_pot_cents - (income_cents - spend_cents - net_to_reserves_cents) AS difference_cents, change_in_pot_cents - (income_cents - spend_cents - net_to_reserves_cents) = 0 AND unmatched_internal_count + unresolved_count + in_transit_count + uninterpreted_count = 0 AS reconciles FROM (
 SELECT household_id, month, CAST(coalesce(sum(amount_cents) FILTER (flow = 'INCOME'), 0) AS BIGINT) AS income_cents, CAST(-coalesce(sum(amount_cents) FILTER (flow = 'SPEND'), 0) AS BIGINT) AS spend_cents, CAST(-coalesce(sum(amount_cents) FILTER (flow = 'RESERVE'), 0) AS BIGINT) AS net_to_reserves_cents,
  CAST(coalesce(sum(amount_cents) FILTER (flow IS NOT NULL), 0) AS BIGINT) AS change_in_pot_cents, CAST(coalesce(sum(amount_cents) FILTER (flow = 'UNRESOLVED'), 0) AS BIGINT) AS unresolved_cents, count(*) FILTER (flow = 'UNRESOLVED') AS unresolved_count,
  CAST(coalesce(sum(amount_cents) FILTER (is_unmatched), 0) AS BIGINT) AS unmatched_internal_cents, count(*) FILTER (is_unmatched) AS unmatched_internal_count, CAST(coalesce(sum(amount_cents) FILTER (flow = 'INTERNAL' AND in_transit), 0) AS BIGINT) AS in_transit_cents, count(*) FILTER (flow = 'INTERNAL' AND in_transit) AS in_transit_count,
  count(*) FILTER (flow IS NULL) AS uninterpreted_count, count(*) FILTER (flow IS NOT NULL) AS row_count FROM interp GROUP BY 1, 2)"""


@query("month_figures", "interp", _FIGURES)
def month_figures(spark: SparkSession, d: str) -> DataFrame:
    _, found = _interpreted(spark, d)
    return month.figures(found.rows, found.links)


@query("ring_derivation", "flows", "SELECT household_id, id, ring FROM ring")
def ring_derivation(spark: SparkSession, d: str) -> DataFrame:
    return ledger.rings(Ledger(spark, d).accounts).select(H, "id", "ring")


@query("classify_flow", "flows", "SELECT household_id, id, flow, is_cash, mirror_credit, pattern_debit FROM flows")
def classify_flow(spark: SparkSession, d: str) -> DataFrame:
    book = Ledger(spark, d)
    return ledger.classify(book.facts, book.accounts).select(H, "id", "flow", "is_cash", "mirror_credit", "pattern_debit")


@query("flow_counts", "flows", "SELECT flow, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS cents FROM flows GROUP BY 1")
def flow_counts(spark: SparkSession, d: str) -> DataFrame:
    book = Ledger(spark, d)
    return ledger.classify(book.facts, book.accounts).groupBy("flow").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_cents").alias("cents"))


@query("outgoing_keys", "flows", "SELECT household_id, refund_key FROM outkeys")
def outgoing_keys(spark: SparkSession, d: str) -> DataFrame:
    book = Ledger(spark, d)
    return ledger.outgoing_keys(book.facts, book.accounts)


@query("card_import_summary", "flows", "SELECT household_id, import_id, account_id, settlement_total_cents, period_end FROM cardimp")
def card_import_summary(spark: SparkSession, d: str) -> DataFrame:
    book = Ledger(spark, d)
    return ledger.card_imports(book.facts, book.accounts)


@query("import_periods", "facts", "SELECT household_id, import_id, min(booking_date) AS period_start, max(booking_date) AS period_end FROM facts GROUP BY 1, 2")
def import_periods(spark: SparkSession, d: str) -> DataFrame:
    return ledger.import_periods(Ledger(spark, d).facts)


@query("settlement_candidates", "flows", "SELECT household_id, debit_id, card_import_id, cents, CAST(distance AS INT) AS distance FROM setcand")
def settlement_candidates(spark: SparkSession, d: str) -> DataFrame:
    book = Ledger(spark, d)
    return ledger.settlement_candidates(book.facts, book.accounts).select(H, "debit_id", "card_import_id", "cents", "distance")


@query("settlement_allocation", "alloc", "SELECT household_id, debit_id, card_import_id FROM alloc")
def settlement_allocation(spark: SparkSession, d: str) -> DataFrame:
    book = Ledger(spark, d)
    return ledger.allocate_settlements(ledger.classify(book.facts, book.accounts), book.facts, book.accounts).select(H, "debit_id", "card_import_id")


@query("mirror_assignment", "mirrors", "SELECT household_id, debit_id, credit_id FROM mirrors")
def mirror_assignment(spark: SparkSession, d: str) -> DataFrame:
    book = Ledger(spark, d)
    flows = staged(ledger.classify(book.facts, book.accounts), "flows")
    return ledger.assign_mirrors(flows, ledger.allocate_settlements(flows, book.facts, book.accounts))


@query("best_settlement", "flows", "SELECT household_id, debit_id, card_import_id FROM (SELECT *, row_number() OVER (PARTITION BY household_id, debit_id ORDER BY distance, card_import_id) AS n FROM setcand) WHERE n = 1")
def best_settlement(spark: SparkSession, d: str) -> DataFrame:
    book = Ledger(spark, d)
    return ledger.settlement_candidates(book.facts, book.accounts).groupBy(H, "debit_id").agg(F.min(F.struct("distance", "card_import_id"))["card_import_id"].alias("card_import_id"))


@query("transfer_candidates", "legs", "SELECT household_id, out_id, in_id, cents, CAST(distance AS INT) AS distance FROM tracand")
def transfer_candidates(spark: SparkSession, d: str) -> DataFrame:
    book = Ledger(spark, d)
    legs = ledger.classify(book.facts, book.accounts).where("flow = 'INTERNAL' AND NOT pattern_debit AND NOT mirror_credit")
    return ledger.transfer_candidates(legs).select(H, "out_id", "in_id", "cents", "distance")


@query("transfer_pairs", "pairs", "SELECT household_id, out_id, in_id FROM pairs")
def transfer_pairs(spark: SparkSession, d: str) -> DataFrame:
    book = Ledger(spark, d)
    legs = ledger.classify(book.facts, book.accounts).where("flow = 'INTERNAL' AND NOT pattern_debit AND NOT mirror_credit")
    return ledger.match_transfers(legs)


@query("unmatched_internal", "interp", "SELECT household_id, id FROM interp WHERE is_unmatched")
def unmatched_internal(spark: SparkSession, d: str) -> DataFrame:
    return _interpreted(spark, d)[1].rows.where("is_unmatched").select(H, "id")


@query("links", "interp", "SELECT * FROM links")
def links(spark: SparkSession, d: str) -> DataFrame:
    return _interpreted(spark, d)[1].links


@query("reconcile", "interp", "SELECT household_id, income_cents, spend_cents, net_to_reserves_cents, change_in_pot_cents, unresolved_gap_cents, unmatched_internal_gap_cents, change_in_pot_cents - (income_cents - spend_cents - net_to_reserves_cents) AS difference_cents, change_in_pot_cents = income_cents - spend_cents - net_to_reserves_cents AS reconciles FROM (SELECT household_id, CAST(coalesce(sum(amount_cents) FILTER (flow = 'INCOME'), 0) AS BIGINT) AS income_cents, CAST(-coalesce(sum(amount_cents) FILTER (flow = 'SPEND'), 0) AS BIGINT) AS spend_cents, CAST(-coalesce(sum(amount_cents) FILTER (flow = 'RESERVE'), 0) AS BIGINT) AS net_to_reserves_cents, CAST(sum(amount_cents) AS BIGINT) AS change_in_pot_cents, CAST(coalesce(sum(amount_cents) FILTER (flow = 'UNRESOLVED'), 0) AS BIGINT) AS unresolved_gap_cents, CAST(coalesce(sum(amount_cents) FILTER (is_unmatched), 0) AS BIGINT) AS unmatched_internal_gap_cents FROM interp GROUP BY 1)")
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    return ledger.reconcile(_interpreted(spark, d)[1].rows, [H])


@query("interpretation_summary", "interp", "SELECT i.household_id, count(*) AS n_rows, count(*) FILTER (is_unmatched) AS n_unmatched, count(*) FILTER (flow = 'UNRESOLVED') AS n_unresolved, count(*) FILTER (is_cash) AS n_cash, (SELECT count(*) FROM links l WHERE l.household_id = i.household_id AND card_import_id IS NULL) AS n_pairs, (SELECT count(*) FROM links l WHERE l.household_id = i.household_id AND card_import_id IS NOT NULL) AS n_settlements FROM interp i GROUP BY 1")
def summary(spark: SparkSession, d: str) -> DataFrame:
    return interpretation_summary(_interpreted(spark, d)[1])


@query("interpretation_window", "flows", "SELECT p.household_id, p.id FROM potf p JOIN (SELECT household_id, min(booking_date) - 49 AS since, max(booking_date) + 49 AS until FROM facts WHERE right(import_id, 7) = '1997-03' GROUP BY 1) s ON s.household_id = p.household_id WHERE p.is_card OR p.booking_date BETWEEN s.since AND s.until")
def interpretation_window(spark: SparkSession, d: str) -> DataFrame:
    book = Ledger(spark, d)
    some = book.facts.where(F.expr("right(import_id, 7)") == "1997-03").select(H, "import_id").distinct()
    return window_facts(book.facts, book.accounts, some).select(H, "id")


#: Of the imports of the last month of each quarter, those of accounts with an even number come after the rest.
_LATE = "right(import_id, 2) IN ('03', '06', '09', '12') AND substr(account_id, 10, 1) IN ('0', '2', '4', '6', '8')"


def _spliced(spark: SparkSession, d: str) -> incremental.Snapshot:
    """The stored interpretation of all but the late imports, into which these are then spliced."""
    book = Ledger(spark, d)
    late = F.expr(_LATE)
    store = incremental.stored_interpretation(spark, parts=4)
    incremental.recompute(store, book.facts.where(~late), book.accounts, book.rules)
    some = staged(book.facts.where(late).select(H, "import_id").distinct(), "late")
    incremental.reinterpret(store, book.facts, book.accounts, some, book.rules)
    return store


@query("spliced_interpretation", "merch", "SELECT r.household_id, r.id, strftime(r.booking_date, '%Y') AS period, r.flow, r.is_cash, r.is_unmatched, r.merchant_id, s.partner_id, l.card_import_id FROM resolved r LEFT JOIN sides s ON s.household_id = r.household_id AND s.id = r.id LEFT JOIN links l ON l.household_id = r.household_id AND l.outgoing_id = r.id")
def spliced_interpretation(spark: SparkSession, d: str) -> DataFrame:
    """Equal to interpreting everything at once, links included."""
    store = _spliced(spark, d)
    links = store.read("links")
    paid = links.select(H, F.col("outgoing_id").alias("id"), "card_import_id")
    rows = store.read("rows").join(matched_sides(links), [H, "id"], "left").join(paid, [H, "id"], "left")
    return rows.select(H, "id", "period", "flow", "is_cash", "is_unmatched", "merchant_id", "partner_id", "card_import_id")


@query("rule_resolution", "merch", "SELECT household_id, text, merchant_id, rule_id FROM ruled")
def rule_resolution(spark: SparkSession, d: str) -> DataFrame:
    book, found = _interpreted(spark, d)
    raw = text.counterparty_text(F.col("counterparty_name"), F.col("description"))
    # written, as a filter on what is normalised would else be moved before the distinct, onto all rows
    texts = staged(found.rows.where("flow IN ('INCOME', 'SPEND')").select(H, raw.alias("raw")).distinct(), "raw").select(H, text.normalise_counterparty(F.col("raw")).alias("text"))
    return merchants.match_rules(texts, book.rules)


_GLOBS = """SELECT household_id, id, merchant_id, 'PATTERN' AS kind, CASE CAST(right(id, 2) AS INT) % 5 WHEN 0 THEN concat('*', bare, '*') WHEN 1 THEN concat('*', left(bare, 3), '*', right(bare, 1), '*') WHEN 2 THEN concat('*', substr(bare, 2, 20)) WHEN 3 THEN concat(left(bare, 2), '*', right(bare, 3)) ELSE concat('*', repeat('*', CAST(right(id, 1) AS INT) % 3)) END AS pattern
 FROM (SELECT *, replace(pattern, '*', '') AS bare FROM {rules})"""


@query("glob_resolution", "merch", f", g AS ({_GLOBS.format(rules='rules')}), m AS (SELECT t.household_id, t.text, r.id AS rule_id, r.merchant_id, row_number() OVER (PARTITION BY t.household_id, t.text ORDER BY length(r.pattern) DESC, r.pattern, r.id) AS rn FROM (SELECT DISTINCT household_id, text FROM ntexts) t JOIN g r ON r.household_id = t.household_id AND t.text GLOB r.pattern) SELECT household_id, text, merchant_id, rule_id FROM m WHERE rn = 1")
def glob_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The texts of all counted rows under globs with stars on both ends, between, and alone."""
    book, found = _interpreted(spark, d)
    raw = text.counterparty_text(F.col("counterparty_name"), F.col("description"))
    # written, as a filter on what is normalised would else be moved before the distinct, onto all rows
    texts = staged(found.rows.where("flow IN ('INCOME', 'SPEND')").select(H, raw.alias("raw")).distinct(), "raw").select(H, text.normalise_counterparty(F.col("raw")).alias("text"))
    return merchants.match_rules(texts, spark.sql(_GLOBS.format(rules="{rules}"), rules=book.rules))


#: A name in the dress of each pattern that the normaliser takes off.
_DRESSED = {
    0: ("DEBITMASTERCARD-BETALING VIA Google Pay - ", ""), 1: ("BANCONTACT-AANKOOP ", ""), 2: ("", " 1.012,50 EUR KAART NR 1234 XXXX XXXX 5678"), 3: ("", " CARTE N\u00b0 1234.XXXX.XXXX.5678 - JAN JANSEN"),
    4: ("", " <BE>"), 5: ("BETALING MET KBC-DEBETKAART ", ""), 6: ("", " VIA BANCONTACT"), 7: ("", " MAESTRO"), 8: ("Contactloos ", ""), 9: ("", " XXXX 1234"), 10: ("", " USD 12.50 KOERS 1.08"),
    11: ("12/03/2024 ", " 10:15"), 12: ("", " 12-03"), 13: ("", " 9000 GENT"), 14: ("", " contactless -,;"), 15: ("  ", "  "), 16: ("", " ANTWERPEN LUIK"), 17: ("", " ****99"),
}


@query("dressed_texts", None, f"SELECT o_orderkey AS k, upper(p_name) || ' NO' || CAST(o_orderkey % 1000 AS VARCHAR) AS text, true AS stays FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)")
def dressed_texts(spark: SparkSession, d: str) -> DataFrame:
    """The name of a part of each order in one of the dresses, normalised, and whether that is itself normal: once is enough."""
    orders, parts = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "part"))
    keyed = orders.select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % parts.count()).alias("p_partkey"))
    dress = F.element_at(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _DRESSED.values())), (F.col("k") % len(_DRESSED) + 1).cast("int"))
    said = keyed.join(parts.select("p_partkey", "p_name"), "p_partkey").select("k", F.concat(dress["a"], "p_name", F.lit(" no"), (F.col("k") % 1000).cast("string"), dress["b"]).alias("said"))
    once = staged(said.select("k", text.normalise_counterparty(F.col("said")).alias("text")), "once")
    return once.select("k", "text", (text.normalise_counterparty(F.col("text")) == F.col("text")).alias("stays"))


@query("resolved_rows", "merch", "SELECT household_id, id, flow, merchant_id, normal_text FROM resolved")
def resolved_rows(spark: SparkSession, d: str) -> DataFrame:
    return _interpreted(spark, d, rules=True)[1].rows.select(H, "id", "flow", "merchant_id", "normal_text")


_REVIEW = "SELECT household_id, flow, CASE WHEN merchant_id IS NOT NULL THEN 'merchant:' || merchant_id ELSE 'text:' || normal_text END AS group_key, min(CASE WHEN merchant_id IS NOT NULL THEN merchant_name ELSE normal_text END) AS label, CAST(max(CASE WHEN merchant_id IS NOT NULL THEN 1 ELSE 0 END) AS INT) AS resolved, CAST(sum(amount_cents) AS BIGINT) AS total_cents, count(*) AS row_count FROM resolved WHERE flow IN ('INCOME', 'SPEND') GROUP BY 1, 2, 3"


@query("merchant_review", "merch", _REVIEW)
def merchant_review(spark: SparkSession, d: str) -> DataFrame:
    book, found = _interpreted(spark, d, rules=True)
    return merchants.review(found.rows, book.merchants)


@query("review_totals", "merch", f"SELECT household_id, CAST(coalesce(sum(total_cents) FILTER (flow = 'INCOME'), 0) AS BIGINT) AS income_cents, CAST(coalesce(sum(total_cents) FILTER (flow = 'SPEND'), 0) AS BIGINT) AS spend_cents, count(*) FILTER (resolved = 0) AS unresolved_groups FROM ({_REVIEW}) GROUP BY 1")
def review_totals(spark: SparkSession, d: str) -> DataFrame:
    book, found = _interpreted(spark, d, rules=True)
    return merchants.review_totals(merchants.review(found.rows, book.merchants))


def _counted(spark: SparkSession, d: str, flow: str) -> DataFrame:
    book, found = _interpreted(spark, d, rules=True)
    return month.counted_groups(found.rows, book.merchants, book.merchant_tags, book.tags, flow)


@query("counted_groups", "fold", "SELECT household_id, month, merchant_id, merchant_name, primary_tag, counterparty_text, is_cash, total_cents, row_count FROM counted WHERE flow = 'SPEND'")
def counted_groups(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d, "SPEND").select(H, "month", "merchant_id", "merchant_name", "primary_tag", "counterparty_text", "is_cash", "total_cents", "row_count")


_DELTA = "SELECT f.household_id, f.month, f.group_key, f.kind, f.label, f.total_cents, f.row_count, abs(f.total_cents) - abs(coalesce(b.total_cents, 0)) AS delta_cents FROM fold f LEFT JOIN fold b ON b.household_id = f.household_id AND b.flow = f.flow AND b.group_key = f.group_key AND b.kind = f.kind AND b.month = strftime(CAST(f.month || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m') WHERE f.flow = "


@query("spend_groups", "fold", _DELTA + "'SPEND'")
def spend_groups(spark: SparkSession, d: str) -> DataFrame:
    return month.with_deltas(month.folded(_counted(spark, d, "SPEND"), use_tags=True))


@query("income_groups", "fold", _DELTA + "'INCOME'")
def income_groups(spark: SparkSession, d: str) -> DataFrame:
    return month.with_deltas(month.folded(_counted(spark, d, "INCOME"), use_tags=False))


@query("reserve_movements", "fold", "SELECT * FROM moved")
def reserve_movements(spark: SparkSession, d: str) -> DataFrame:
    book, found = _interpreted(spark, d)
    return month.reserve_movements(found.rows, book.accounts)


@query("gap_rows", "interp", "SELECT i.household_id, i.month, i.id, CASE WHEN flow IS NULL THEN 'uninterpreted' WHEN flow = 'UNRESOLVED' THEN 'unresolved' WHEN matched THEN 'in-transit' ELSE 'unmatched-internal' END AS gap, i.booking_date, coalesce(counterparty_name, description) AS text, a.label AS account_label, amount_cents FROM interp i JOIN acct a ON a.household_id = i.household_id AND a.id = i.account_id WHERE flow IS NULL OR flow = 'UNRESOLVED' OR (flow = 'INTERNAL' AND (NOT matched OR in_transit))")
def gap_rows(spark: SparkSession, d: str) -> DataFrame:
    book, found = _interpreted(spark, d)
    return month.gap_rows(found.rows, found.links, book.accounts)


@query("month_sections", "fold", """, s AS (SELECT coalesce(f.household_id, m.household_id) AS household_id, coalesce(f.month, m.month) AS month, coalesce(i, 0) AS income_cents, coalesce(p, 0) AS spend_cents, coalesce(u, 0) AS unresolved_rows, coalesce(n, 0) AS reserves_cents
 FROM (SELECT household_id, month, CAST(coalesce(sum(total_cents) FILTER (flow = 'INCOME'), 0) AS BIGINT) AS i, CAST(-coalesce(sum(total_cents) FILTER (flow = 'SPEND'), 0) AS BIGINT) AS p, CAST(coalesce(sum(row_count) FILTER (kind = 'unresolved'), 0) AS BIGINT) AS u FROM fold GROUP BY 1, 2) f
 FULL JOIN (SELECT household_id, month, CAST(sum(parked_cents) AS BIGINT) AS n FROM moved GROUP BY 1, 2) m ON m.household_id = f.household_id AND m.month = f.month)
 SELECT s.*, s.income_cents - coalesce(b.income_cents, 0) AS income_delta_cents, s.spend_cents - coalesce(b.spend_cents, 0) AS spend_delta_cents FROM s LEFT JOIN s b ON b.household_id = s.household_id AND b.month = strftime(CAST(s.month || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m')""")
def month_sections(spark: SparkSession, d: str) -> DataFrame:
    book, found = _interpreted(spark, d, rules=True)
    groups = [month.folded(month.counted_groups(found.rows, book.merchants, book.merchant_tags, book.tags, f), f == "SPEND") for f in ("INCOME", "SPEND")]
    return month.sections(*groups, month.reserve_movements(found.rows, book.accounts))


# ---- statement files, built from the ledger's facts and read back


def _statement_lines(book: Ledger) -> DataFrame:
    """One line of delimited text per fact on an account with an IBAN, in the layout of a current-account export."""
    own = book.accounts.where("iban IS NOT NULL AND role = 'POT'").select(H, F.col("id").alias("account_id"), "iban")
    day = F.date_format("booking_date", "dd/MM/yyyy")
    said = F.when(F.length("description") % 3 == 0, F.concat(F.lit('"'), "description", F.lit('"'))).otherwise(F.col("description"))
    cells = (F.substring("import_id", -7, 4), F.substring("id", 2, 12), day, day, F.col("iban"), F.coalesce("counterparty_iban", F.lit("")), F.coalesce("counterparty_name", F.lit("")), said, money.display(F.col("amount_cents")))
    return book.facts.join(own, [H, "account_id"]).select(H, F.concat_ws("-", "account_id", F.year("booking_date")).alias("file_id"), "id", F.concat_ws(";", *cells).alias("line"))


HEADER = "Export;;;;;;;;\r\nAfschrift;Volgnummer;Boekingsdatum;Valutadatum;Rekening;Rekening tegenpartij;Naam tegenpartij;Omschrijving;Bedrag"


def statement_files(book: Ledger) -> DataFrame:
    """(household_id, file_id, content): the lines of each account and year under a preamble and a header, in the order of
    ids; staged, as whoever reads files reads them more than once."""
    body = _statement_lines(book).groupBy(H, "file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda s: s["line"]), "\r\n").alias("body"))
    return staged(body.select(H, "file_id", F.concat(F.lit(HEADER + "\r\n"), "body", F.lit("\r\n")).cast("binary").alias("content")), "files")


_FILE = "f.account_id || '-' || CAST(year(f.booking_date) AS VARCHAR)"
_PARSED = f"SELECT f.household_id, {_FILE} AS file_id, row_number() OVER (PARTITION BY f.household_id, f.account_id, year(f.booking_date) ORDER BY f.id) + 2 AS line_no, booking_date, amount_cents, f.description, counterparty_iban, counterparty_name, a.iban AS account_iban, left(right(f.import_id, 7), 4) AS statement_number, substr(f.id, 2, 12) AS sequence_number FROM facts f JOIN acct a ON a.household_id = f.household_id AND a.id = f.account_id AND a.iban IS NOT NULL AND a.role = 'POT'"


@query("parse_statements", "facts", _PARSED)
def parse_statements(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = delimited.statements(_with_spec(statement_files(Ledger(spark, d))))
    return rows.select(H, "file_id", "line_no", "booking_date", "amount_cents", "description", "counterparty_iban", "counterparty_name", "account_iban", "statement_number", "sequence_number")


def _with_spec(files: DataFrame) -> DataFrame:
    spec = {"kind": "delimited", "delimiter": ";", "encoding": "utf-8", "header_row_index": 1, "date_format": "DD/MM/YYYY", "decimal_style": "comma", "amount": {"kind": "signed", "column": 8}, "columns": {"booking_date": 2, "description": 7, "value_date": 3, "counterparty_name": 6, "counterparty_iban": 5, "account_iban": 4, "statement_number": 0, "sequence_number": 1}}
    import json

    return files.withColumn("spec", F.from_json(F.lit(json.dumps(spec)), delimited.SPEC))


@query("inferred_profiles", "facts", f"SELECT DISTINCT f.household_id, {_FILE} AS file_id, ';' AS delimiter, 1 AS header_row_index, 'DD/MM/YYYY' AS date_format, 'comma' AS decimal_style, 'signed' AS amount_kind, 8 AS amount_column, 2 AS booking_date, 3 AS value_date, 4 AS account_iban, 7 AS description FROM facts f JOIN acct a ON a.household_id = f.household_id AND a.id = f.account_id AND a.iban IS NOT NULL AND a.role = 'POT'")
def inferred_profiles(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("spec")
    c = s["columns"]
    return profile.infer(statement_files(Ledger(spark, d))).select(H, "file_id", s["delimiter"].alias("delimiter"), s["header_row_index"].alias("header_row_index"), s["date_format"].alias("date_format"), s["decimal_style"].alias("decimal_style"), s["amount"]["kind"].alias("amount_kind"), s["amount"]["column"].alias("amount_column"), c["booking_date"].alias("booking_date"), c["value_date"].alias("value_date"), c["account_iban"].alias("account_iban"), c["description"].alias("description"))


@query("own_ibans", "facts", f"SELECT DISTINCT f.household_id, {_FILE} AS file_id, a.iban AS account_ibans FROM facts f JOIN acct a ON a.household_id = f.household_id AND a.id = f.account_id AND a.iban IS NOT NULL AND a.role = 'POT'")
def own_ibans(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = delimited.statements(_with_spec(statement_files(Ledger(spark, d))))
    return delimited.own_ibans(rows).select(H, "file_id", F.array_join("account_ibans", ",").alias("account_ibans"))


@query("statement_preview", "facts", f"SELECT household_id, file_id, line_no, amount_cents FROM ({_PARSED}) WHERE line_no <= 7")
def statement_preview(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = delimited.statements(_with_spec(statement_files(Ledger(spark, d))))
    return delimited.preview(rows).select(H, "file_id", "line_no", "amount_cents")


def _fact_lines(book: Ledger) -> DataFrame:
    """Facts as parsed rows that have content keys: few texts and rounded amounts, so that there are twins."""
    return book.facts.select(H, "account_id", "import_id", F.col("id").alias("line_no"), "booking_date", (F.col("amount_cents") - F.col("amount_cents") % 100000).alias("amount_cents"), "description", "counterparty_name", F.lit(None).cast("string").alias("reference"), F.when(F.col("id").startswith("P"), F.substring("id", 2, 12)).alias("statement_number"), F.when(F.col("id").startswith("P"), F.lit("1")).alias("sequence_number"))


_KEYED = "SELECT *, CASE WHEN nat THEN 'nat:' || account_id || ':' || statement_number || ':1' ELSE 'h:' || sha256(tuple) || '#' || CAST(row_number() OVER (PARTITION BY household_id, import_id, nat, CASE WHEN nat THEN NULL ELSE tuple END ORDER BY id) - 1 AS VARCHAR) END AS dedup_key FROM (SELECT household_id, account_id, import_id, id, substr(id, 2, 12) AS statement_number, id LIKE 'P%' AS nat, '[\"' || account_id || '\",\"' || CAST(booking_date AS VARCHAR) || '\",\"' || CAST(amount_cents - amount_cents % 100000 AS VARCHAR) || '\",\"' || upper(coalesce(counterparty_name, description)) || '\",\"\"]' AS tuple FROM facts)"


@query("dedup_keys", "facts", f"SELECT household_id, import_id, id AS line_no, dedup_key FROM ({_KEYED})")
def dedup_keys(spark: SparkSession, d: str) -> DataFrame:
    return dedup.with_keys(_fact_lines(Ledger(spark, d))).select(H, "import_id", "line_no", "dedup_key")


@query("ingest_report", "facts", f", k AS ({_KEYED}), old AS (SELECT DISTINCT household_id, dedup_key FROM k WHERE right(id, 1) IN ('0', '1', '2')), fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY household_id, dedup_key ORDER BY import_id, id) AS n FROM k) x WHERE n = 1 AND (household_id, dedup_key) NOT IN (SELECT (household_id, dedup_key) FROM old)) SELECT k.household_id, k.import_id, count(f.id) AS rows_added, count(*) - count(f.id) AS rows_known FROM k LEFT JOIN fresh f ON f.household_id = k.household_id AND f.id = k.id GROUP BY 1, 2")
def ingest_report(spark: SparkSession, d: str) -> DataFrame:
    rows = _fact_lines(Ledger(spark, d))
    keyed = dedup.with_keys(rows).select(H, "import_id", "line_no", "dedup_key")
    old = keyed.where(F.expr("right(line_no, 1) IN ('0', '1', '2')")).select(H, "dedup_key").distinct()
    return dedup.ingest_report(rows, dedup.new_rows(keyed, old))


@query("amount_round_trip", "facts", "SELECT household_id, id, amount_cents, amount_cents AS parsed_cents, CASE WHEN amount_cents >= 0 THEN amount_cents ELSE -1 END AS unsigned_cents FROM facts")
def amount_round_trip(spark: SparkSession, d: str) -> DataFrame:
    shown = money.display(F.col("amount_cents"))
    facts = Ledger(spark, d).facts.withColumn("shown", F.when(F.col("amount_cents") % 2 == 0, F.concat(F.lit("EUR "), shown)).otherwise(F.concat(shown, F.lit(" €"))))
    return facts.select(H, "id", "amount_cents", money.parse_cents(F.col("shown"), "comma").alias("parsed_cents"), F.coalesce(money.parse_unsigned_cents(F.col("shown"), "comma"), F.lit(-1)).cast("long").alias("unsigned_cents"))


@query("amount_display", "facts", "SELECT id, CASE WHEN amount_cents < 0 THEN '-' ELSE '' END || replace(format('{:,}', abs(amount_cents) // 100), ',', '.') || ',' || lpad(CAST(abs(amount_cents) % 100 AS VARCHAR), 2, '0') AS shown FROM facts")
def amount_display(spark: SparkSession, d: str) -> DataFrame:
    return Ledger(spark, d).facts.select("id", money.display(F.col("amount_cents")).alias("shown"))


@query("date_parsing", "facts", "SELECT id, booking_date AS a, booking_date AS b, CASE WHEN year(booking_date) >= 2000 THEN booking_date ELSE booking_date + INTERVAL 100 YEAR END::DATE AS c, NULL::DATE AS bad FROM facts")
def date_parsing(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("booking_date")
    return Ledger(spark, d).facts.select("id", dates.parse_date(F.date_format(day, "dd/MM/yyyy"), "DD/MM/YYYY").alias("a"), dates.parse_date(F.concat(F.lit(" "), day.cast("string")), "YYYY-MM-DD").alias("b"), dates.parse_date(F.date_format(day, "dd.MM.yy"), "DD.MM.YY").alias("c"), dates.parse_date(F.date_format(day, "d/M/y"), "YYYY-MM-DD").alias("bad"))


@query("months", "facts", "SELECT DISTINCT strftime(booking_date, '%Y-%m') AS month, strftime(date_trunc('month', booking_date) - INTERVAL 1 MONTH, '%Y-%m') AS previous, day(last_day(booking_date)) AS days, CASE WHEN strftime(booking_date, '%Y-%m') <= '1998-06' THEN strftime(booking_date, '%Y-%m') ELSE '1998-06' END AS asked FROM facts")
def months(spark: SparkSession, d: str) -> DataFrame:
    m = Ledger(spark, d).facts.select(dates.month_of(F.col("booking_date")).alias("month")).distinct()
    return m.select("month", dates.shifted_month(F.col("month"), -1).alias("previous"), F.dayofmonth(F.last_day(dates.month_start(F.col("month")))).cast("long").alias("days"), dates.asked_month(F.col("month"), F.lit("1998-06")).alias("asked"))


@query("latest_declarations", "facts", "SELECT household_id, kind, pattern, max(id) AS id FROM rules GROUP BY 1, 2, 3")
def latest_declarations(spark: SparkSession, d: str) -> DataFrame:
    return merchants.latest(Ledger(spark, d).rules, [H, "kind", "pattern"], "id").select(H, "kind", "pattern", "id")


@query("merchant_assignments", "facts", f""", said AS (SELECT household_id, id, CASE abs(amount_cents) % 3 WHEN 0 THEN 'Merchant ' || household_id || '-M1' ELSE 'Place ' || CAST(abs(amount_cents) % 7 AS VARCHAR) END AS name, {_NORMAL.format('coalesce(counterparty_name, description)')} AS pattern FROM facts WHERE abs(amount_cents) % 3 <> 2),
 newest AS (SELECT household_id, 'EXACT' AS kind, pattern, arg_max(name, id) AS name FROM said GROUP BY 1, 2, 3)
 SELECT coalesce(r.household_id, n.household_id) AS household_id, coalesce(r.kind, n.kind) AS kind, coalesce(r.pattern, n.pattern) AS pattern, coalesce(n.name, 'Merchant ' || r.merchant_id) AS merchant_name FROM rules r FULL JOIN newest n ON n.household_id = r.household_id AND n.kind = r.kind AND n.pattern = r.pattern""")
def merchant_assignments(spark: SparkSession, d: str) -> DataFrame:
    """Every fact's text given to a merchant by name, a third of them to a blank one."""
    book = Ledger(spark, d)
    name = F.when(F.expr("abs(amount_cents) % 3 = 0"), F.concat(F.lit(" Merchant "), H, F.lit("-M1 "))).when(F.expr("abs(amount_cents) % 3 = 1"), F.concat(F.lit("Place "), F.expr("abs(amount_cents) % 7"))).otherwise(" ")
    declared = book.facts.select(H, F.col("id").alias("at"), name.alias("merchant_name"), text.counterparty_text(F.col("counterparty_name"), F.col("description")).alias("counterparty_text"))
    named, rules, _ = merchants.assigned(declared, book.merchants, book.rules)
    return rules.join(named.select(H, F.col("id").alias("merchant_id"), F.col("name").alias("merchant_name")), [H, "merchant_id"]).select(H, "kind", "pattern", "merchant_name")


@query("merchant_tagging", "facts", """, ev AS (SELECT household_id, merchant_id, tag_id, is_primary, '' AS turn FROM merchant_tags UNION ALL SELECT household_id, merchant_id, household_id || '-' || CAST(CAST(right(id, 2) AS INT) // 5 % 5 AS VARCHAR), CAST(right(id, 2) AS INT) % 3 = 0, id FROM rules),
 own AS (SELECT e.* FROM ev e JOIN tags t ON t.household_id = e.household_id AND t.id = e.tag_id),
 last AS (SELECT household_id, merchant_id, tag_id, arg_max(is_primary, turn) AS said, max(turn) AS turn FROM own GROUP BY 1, 2, 3)
 SELECT l.household_id, l.merchant_id, l.tag_id, l.said AND NOT EXISTS (SELECT 1 FROM own o WHERE o.household_id = l.household_id AND o.merchant_id = l.merchant_id AND o.is_primary AND o.turn > l.turn) AS is_primary FROM last l""")
def merchant_tagging(spark: SparkSession, d: str) -> DataFrame:
    """A tag for the merchant of each rule, in the order of the rules; tags the household does not have are left out."""
    book = Ledger(spark, d)
    tag = F.concat(F.col(H), F.lit("-"), F.expr("CAST(right(id, 2) AS INT) div 5 % 5"))
    declared = book.rules.select(H, "merchant_id", tag.alias("tag_id"), F.expr("CAST(right(id, 2) AS INT) % 3 = 0").alias("is_primary"), F.col("id").alias("at"))
    return merchants.tagged(book.merchant_tags, declared, book.merchants, book.tags)[0]


@query("import_states", "facts", "SELECT household_id, import_id, CASE WHEN length(import_id) % 2 = 0 AND NOT bool_or(id LIKE 'S%') THEN 'FAILED' ELSE 'INTERPRETED' END AS status FROM facts GROUP BY household_id, import_id")
def import_states(spark: SparkSession, d: str) -> DataFrame:
    """A log of what happened to each import; steps that the state before does not allow are without effect."""
    each = Ledger(spark, d).facts.groupBy(H, "import_id").agg(F.bool_or(F.col("id").startswith("S")).alias("s"))
    failed = (F.length("import_id") % 2 == 0) & ~F.col("s")
    path = F.when(failed, F.array(*map(F.lit, ("AWAITING_DECLARATION", "FAILED", "INGESTED", "INTERPRETED")))).otherwise(F.array(*map(F.lit, ("PARSED", "INGESTED", "FAILED", "INTERPRETED", "AWAITING_DECLARATION"))))
    return ingest.import_states(each.select(H, "import_id", F.posexplode(path).alias("at", "status")))


#: What the kinds of events stand for in a log of imports.
_LOGGED = {"signup": "PARSED", "view": "AWAITING_DECLARATION", "click": "INGESTED", "purchase": "INTERPRETED", "error": "FAILED"}
_STEPS = "'PARSED>INGESTED', 'AWAITING_DECLARATION>INGESTED', 'AWAITING_DECLARATION>FAILED', 'INGESTED>INTERPRETED', 'INTERPRETED>INGESTED'"


@query("import_log", None, f"""SELECT household_id, import_id, list_reduce(list(status ORDER BY ts, event_id), lambda now, nxt: CASE WHEN now || '>' || nxt IN ({_STEPS}) THEN nxt ELSE now END) AS status
 FROM (SELECT ts, event_id, CAST(user_id AS VARCHAR) AS household_id, CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS import_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _LOGGED.items())} END AS status FROM events) GROUP BY ALL""")
def import_log(spark: SparkSession, d: str) -> DataFrame:
    """The events as a log, one import a user and day, in whatever order the kinds come."""
    status = F.create_map(*(F.lit(x) for pair in _LOGGED.items() for x in pair))[F.col("event_type")]
    user = F.col("user_id").cast("string")
    log = spark.read.parquet(f"{d}/events.parquet").select(user.alias(H), F.concat_ws("-", user, F.col("ts").cast("date")).alias("import_id"), F.struct("ts", "event_id").alias("at"), status.alias("status"))
    return ingest.import_states(log)


@query("refund_keys", "flows", "SELECT household_id, id, refund_key FROM rkey")
def refund_keys(spark: SparkSession, d: str) -> DataFrame:
    book = Ledger(spark, d)
    return ledger.pot_facts(book.facts, book.accounts).select(H, "id", text.refund_key(F.col("counterparty_iban"), F.col("counterparty_name"), F.col("description")).alias("refund_key"))


@query("masked_cards", "facts", "SELECT id, 'KAART NR **** ' || right(lpad(CAST(abs(amount_cents) AS VARCHAR), 12, '0'), 4) AS masked FROM facts")
def masked_cards(spark: SparkSession, d: str) -> DataFrame:
    n = F.lpad(F.abs("amount_cents").cast("string"), 12, "0")
    number = F.concat_ws(" ", F.lit("KAART NR 6703"), F.substring(n, 1, 4), F.substring(n, 5, 4), F.substring(n, 9, 4))
    return Ledger(spark, d).facts.select("id", text.masked_cards(number).alias("masked"))


@query("foreign_ibans", "flows", "SELECT f.household_id, f.id, CASE WHEN f.counterparty_iban <> f.own_iban THEN f.counterparty_iban END AS found FROM potf f")
def foreign_ibans(spark: SparkSession, d: str) -> DataFrame:
    book = Ledger(spark, d)
    said = F.concat_ws(" ", F.lit("VAN"), "own_iban", F.lit("NAAR"), F.regexp_replace(F.coalesce("counterparty_iban", F.lit("")), "(.{4})", "$1 "), F.lit("REF"))
    return ledger.pot_facts(book.facts, book.accounts).select(H, "id", text.first_foreign_iban(said, F.array(F.coalesce("own_iban", F.lit("")))).alias("found"))


@query("file_routing", None, "SELECT doc_id, false AS positioned, text IS NULL OR text = '' AS is_empty, 'utf-8' AS encoding FROM documents")
def file_routing(spark: SparkSession, d: str) -> DataFrame:
    content = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", delimited.is_positioned(content).alias("positioned"), (F.octet_length(content) == 0).alias("is_empty"), delimited.encoding_of(content).alias("encoding"))


_NARROW = r"regexp_replace(coalesce(text, ''), '[^\x{00}-\x{FF}]', '?', 'g')"
#: Bytes, each as the letter of its number, that are UTF-8.
_AS_UTF8 = r"^([\x{00}-\x{7F}]|[\x{C2}-\x{DF}][\x{80}-\x{BF}]|\x{E0}[\x{A0}-\x{BF}][\x{80}-\x{BF}]|[\x{E1}-\x{EC}\x{EE}\x{EF}][\x{80}-\x{BF}]{2}|\x{ED}[\x{80}-\x{9F}][\x{80}-\x{BF}])*$"


@query("file_forms", None, f"SELECT doc_id, doc_id % 5 = 1 OR doc_id % 5 <> 3 AND starts_with(coalesce(text, ''), '%PDF-') AS positioned, coalesce(text, '') = '' AND doc_id % 5 NOT IN (1, 3, 4) AS is_empty, CASE WHEN doc_id % 5 = 2 AND NOT regexp_full_match({_NARROW}, '{_AS_UTF8}') THEN 'windows-1252' WHEN doc_id % 5 = 4 THEN 'windows-1252' ELSE 'utf-8' END AS encoding FROM documents")
def file_forms(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of five forms: as they are, behind the mark of positioned files, in an old encoding, behind a byte
    order mark, and with a byte at the end that is no UTF-8."""
    said, form = F.coalesce("text", F.lit("")), F.pmod("doc_id", F.lit(5))
    plain = said.cast("binary")
    old = F.encode(F.regexp_replace(said, r"[^\x00-\xFF]", "?"), "iso-8859-1")
    content = F.when(form == 1, F.concat(F.lit(b"%PDF-"), plain)).when(form == 2, old).when(form == 3, F.concat(F.lit(b"\xef\xbb\xbf"), plain)).when(form == 4, F.concat(plain, F.lit(b"\xff"))).otherwise(plain)
    files = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", content.alias("content"))
    return files.select("doc_id", delimited.is_positioned(F.col("content")).alias("positioned"), (F.octet_length("content") == 0).alias("is_empty"), delimited.encoding_of(F.col("content")).alias("encoding"))


@query("document_lines", None, r"SELECT doc_id, CAST(len(string_split(kept, chr(10))) AS BIGINT) AS n_lines FROM (SELECT doc_id, regexp_replace(text, '(\r?\n|\r$)+$', '') AS kept FROM documents) WHERE kept <> ''")
def document_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.lit("H").alias(H), F.col("doc_id").cast("string").alias("file_id"), "text")
    return delimited.lines(docs).groupBy(F.col("file_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_lines"))


#: Summer time of the zone: from the last Sunday of March to that of October, 01:00 UTC.
_LOCAL = """SELECT CAST(ts + CASE WHEN ts >= march + INTERVAL 1 HOUR AND ts < october + INTERVAL 1 HOUR THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END AS DATE) AS day, count(*) AS n_events FROM (
 SELECT CAST(ts AS TIMESTAMP) AS ts, make_date(year(ts), 3, 31) - CAST(dayofweek(make_date(year(ts), 3, 31)) AS INT) AS march, make_date(year(ts), 10, 31) - CAST(dayofweek(make_date(year(ts), 10, 31)) AS INT) AS october FROM events) GROUP BY 1"""


@query("local_days", None, _LOCAL)
def local_days(spark: SparkSession, d: str) -> DataFrame:
    """Events per local day of a zone with summer time."""
    return spark.read.parquet(f"{d}/events.parquet").groupBy(dates.local_day(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n_events"))


# ---- orders of presentation, as the place of each row


def _placed(df: DataFrame, by: list[str], order: list, name: str = "place") -> DataFrame:
    return numbered(df, by, order, name)


@query("group_places", "fold", "SELECT household_id, month, group_key, row_number() OVER (PARTITION BY household_id, month ORDER BY abs(total_cents) DESC, label, group_key) AS place FROM fold WHERE flow = 'SPEND'")
def group_places(spark: SparkSession, d: str) -> DataFrame:
    groups = month.folded(_counted(spark, d, "SPEND"), use_tags=True)
    return _placed(groups, [H, "month"], month.group_order()).select(H, "month", "group_key", "place")


@query("review_places", "merch", f"SELECT household_id, flow, group_key, row_number() OVER (PARTITION BY household_id, flow ORDER BY abs(total_cents) DESC, label, group_key) AS place FROM ({_REVIEW})")
def review_places(spark: SparkSession, d: str) -> DataFrame:
    book, found = _interpreted(spark, d, rules=True)
    return _placed(merchants.review(found.rows, book.merchants), [H, "flow"], merchants.review_order()).select(H, "flow", "group_key", "place")


@query("gap_places", "interp", "SELECT household_id, month, id, row_number() OVER (PARTITION BY household_id, month ORDER BY booking_date, id) AS place FROM interp WHERE flow IS NULL OR flow = 'UNRESOLVED' OR (flow = 'INTERNAL' AND (NOT matched OR in_transit))")
def gap_places(spark: SparkSession, d: str) -> DataFrame:
    book, found = _interpreted(spark, d)
    return _placed(month.gap_rows(found.rows, found.links, book.accounts), [H, "month"], month.gap_order()).select(H, "month", "id", "place")


@query("pair_places", "pairs", "SELECT household_id, out_id, in_id, row_number() OVER (PARTITION BY household_id ORDER BY out_id, in_id) AS place FROM pairs")
def pair_places(spark: SparkSession, d: str) -> DataFrame:
    return _placed(transfer_pairs(spark, d), [H], ["out_id", "in_id"])


@query("declaration_places", "facts", "SELECT household_id, 'merchant' AS kind, id, row_number() OVER (PARTITION BY household_id ORDER BY name, id) AS place FROM merchants UNION ALL SELECT household_id, 'rule', id, row_number() OVER (PARTITION BY household_id ORDER BY id) FROM rules UNION ALL SELECT household_id, 'tag', id, row_number() OVER (PARTITION BY household_id ORDER BY name, id) FROM tags UNION ALL SELECT household_id, 'import', import_id, row_number() OVER (PARTITION BY household_id ORDER BY since DESC, import_id) FROM (SELECT household_id, import_id, min(booking_date) AS since FROM facts GROUP BY 1, 2)")
def declaration_places(spark: SparkSession, d: str) -> DataFrame:
    book = Ledger(spark, d)
    imports = book.facts.groupBy(H, F.col("import_id").alias("id")).agg(F.min("booking_date").alias("since"))
    lists = {"merchant": (book.merchants, ["name", "id"]), "rule": (book.rules.drop("kind"), ["id"]), "tag": (book.tags, ["name", "id"]), "import": (imports, [F.desc("since"), "id"])}
    placed = [_placed(df, [H], order).select(H, F.lit(kind).alias("kind"), "id", "place") for kind, (df, order) in lists.items()]
    return reduce(DataFrame.unionByName, placed)


@query("households_with_facts", "facts", "SELECT DISTINCT household_id, household_id IN (SELECT household_id FROM facts) AS has_facts FROM acct")
def households_with_facts(spark: SparkSession, d: str) -> DataFrame:
    """The probe whether there is any fact: a semi join finds one of each household."""
    book = Ledger(spark, d)
    some = book.facts.select(H).distinct().withColumn("_some", F.lit(True))
    return book.accounts.select(H).distinct().join(some, H, "left").select(H, F.coalesce("_some", F.lit(False)).alias("has_facts"))


# ---- uploads: recognition, accounts, layouts, in several forms of file

_UPLOAD = """up AS (SELECT household_id, 'U' || id AS file_id, id, k % 5 AS form, booking_date, amount_cents, iban FROM (SELECT f.household_id, f.id, f.booking_date, f.amount_cents, a.iban, a.k FROM facts f JOIN acct a ON a.household_id = f.household_id AND a.id = f.account_id AND a.iban IS NOT NULL AND a.role = 'POT' WHERE f.id LIKE 'T%'))"""


def _uploads(book: Ledger) -> DataFrame:
    """A small file for each fact of a current account, in five forms: signed with a statement number, with an indicator,
    with two amount columns, the first in an old encoding, and one that names two own accounts."""
    own = book.accounts.where("iban IS NOT NULL AND role = 'POT'").select(H, F.col("id").alias("account_id"), "iban", (F.col("k") % 5).alias("form"))
    facts = book.facts.where("id LIKE 'T%'").join(own, [H, "account_id"])
    day = lambda form: F.date_format("booking_date", form)
    cents, shown = F.col("amount_cents"), money.display(F.abs("amount_cents"))
    plain = F.format_string("%d.%02d", F.expr("abs(amount_cents) div 100"), F.abs("amount_cents") % 100)
    head = "Afschrift;Volgnummer;Datum;Rekening;Naam;Omschrijving;Bedrag"
    signed = lambda iban: F.concat_ws(";", F.lit("1"), F.lit("7"), day("dd/MM/yyyy"), iban, F.lit("Zo\u00eb"), F.lit("CAF\u00c9"), money.display(cents))
    one = F.concat_ws("\n", F.lit("Export"), F.lit(head), signed(F.col("iban")))
    marked = F.concat_ws("\n", F.lit("Kaart"), F.lit("Datum;Omschrijving;Bedrag;DC"), F.concat_ws(";", day("dd.MM.yy"), F.lit("SHOP"), shown, F.when(cents < 0, "D").otherwise("C")), F.concat_ws(";", day("dd.MM.yy"), F.lit("FEE"), F.lit("1,00"), F.lit("D")))
    pair = F.concat_ws("\n", F.lit("Date,Details,Debit,Credit,Account"), F.concat_ws(",", day("yyyy-MM-dd"), F.lit("food"), F.when(cents < 0, plain).otherwise(""), F.when(cents < 0, "").otherwise(plain), F.col("iban")), F.concat_ws(",", day("yyyy-MM-dd"), F.lit("fee"), F.lit("1.00"), F.lit(""), F.col("iban")))
    mixed = F.concat_ws("\n", one, signed(F.lit("BE00000000000000")))
    text = F.when(F.col("form") == 1, marked.cast("binary")).when(F.col("form") == 2, pair.cast("binary")).when(F.col("form") == 3, F.encode(one, "iso-8859-1")).when(F.col("form") == 4, mixed.cast("binary")).otherwise(one.cast("binary"))
    return staged(facts.select(H, F.concat(F.lit("U"), "id").alias("file_id"), text.alias("content")), "uploads")


@query("upload_profiles", "facts", f", {_UPLOAD} SELECT household_id, file_id, CASE WHEN form = 2 THEN ',' ELSE ';' END AS delimiter, CASE WHEN form = 3 THEN 'windows-1252' ELSE 'utf-8' END AS encoding, CASE form WHEN 1 THEN 'DD.MM.YY' WHEN 2 THEN 'YYYY-MM-DD' ELSE 'DD/MM/YYYY' END AS date_format, CASE form WHEN 1 THEN 'indicator' WHEN 2 THEN 'debitCredit' ELSE 'signed' END AS amount_kind, CASE WHEN form = 2 THEN 0 ELSE 1 END AS header_row_index FROM up")
def upload_profiles(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("spec")
    return profile.infer(_uploads(Ledger(spark, d))).select(H, "file_id", s["delimiter"].alias("delimiter"), s["encoding"].alias("encoding"), s["date_format"].alias("date_format"), s["amount"]["kind"].alias("amount_kind"), s["header_row_index"].alias("header_row_index"))


@query("uploads", "facts", f", {_UPLOAD} SELECT household_id, file_id, CASE WHEN form = 4 THEN 'mixed-accounts' END AS reason, CASE WHEN form <> 4 THEN 'P' || CAST(CASE WHEN form = 3 THEN 3 ELSE form END AS VARCHAR) END AS profile_id, CASE WHEN form = 4 THEN NULL WHEN form = 1 THEN 'CARD' ELSE 'A-' || iban END AS account_id, CASE WHEN form = 4 THEN 0 WHEN form IN (1, 2) THEN 2 ELSE 1 END AS n_rows, CASE WHEN form = 4 THEN 0 WHEN form IN (1, 2) THEN amount_cents - 100 ELSE amount_cents END AS cents FROM up")
def uploads(spark: SparkSession, d: str) -> DataFrame:
    """Files as users send them: profile inferred and recognised, rows parsed, account resolved, mixed files failed."""
    book = Ledger(spark, d)
    files = _uploads(book)
    found = staged(profile.infer(files).where("reason IS NULL").drop("reason"), "specs")
    form = F.when(F.col("spec.amount.kind") == "indicator", 1).when(F.col("spec.amount.kind") == "debitCredit", 2).when(F.col("spec.encoding") == "windows-1252", 3).otherwise(0)
    stored = found.groupBy(H, "spec").agg(F.min("file_id").alias("_first")).select(H, "spec", F.concat(F.lit("P"), form).alias("id"), F.when(form == 1, "CARD").alias("account_id"), F.lit(1).alias("created_at"))
    accounts = book.accounts.where("iban IS NOT NULL AND role = 'POT'").select(H, F.concat(F.lit("A-"), "iban").alias("id"), "iban")
    return ingest.uploaded(files, found, stored, accounts)


@query("reparsed_profiles", "facts", f", {_UPLOAD} SELECT household_id, 'P' || CAST(form AS VARCHAR) AS profile_id, CASE WHEN form = 2 THEN 'row-amount' END AS reason, CASE WHEN form = 2 THEN 0 ELSE count(*) END AS n_imports, CASE form WHEN 2 THEN 0 WHEN 1 THEN 2 * count(*) ELSE count(*) END AS n_rows, CAST(CASE form WHEN 2 THEN 0 WHEN 1 THEN sum(amount_cents - 100) ELSE sum(amount_cents) END AS BIGINT) AS cents FROM up WHERE form < 4 GROUP BY household_id, form")
def reparsed_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Stored files parsed anew with commas in amounts: the profile of two amount columns, which has dots, is refused."""
    files = _uploads(Ledger(spark, d))
    kind = F.when(F.col("spec.amount.kind") == "indicator", "P1").when(F.col("spec.amount.kind") == "debitCredit", "P2").when(F.col("spec.encoding") == "windows-1252", "P3").otherwise("P0")
    specs = staged(profile.infer(files).where("reason IS NULL").select(H, "file_id", "spec", kind.alias("profile_id")), "specs")
    # specs are as many rows as there are files, however few bytes they take on disk
    rows, _ = delimited.statements(files.join(specs.hint("merge"), [H, "file_id"]))
    known = staged(rows.join(specs.select(H, "file_id", "profile_id").hint("merge"), [H, "file_id"]), "known")
    row_id = F.concat_ws("-", "file_id", "line_no")
    stored = known.select(H, "profile_id", F.col("file_id").alias("import_id"), F.concat(F.lit("A-"), "file_id").alias("account_id"), row_id.alias("id"), "raw_line", F.concat(F.lit("h:"), row_id, F.lit("#0")).alias("dedup_key"))
    given = files.join(specs.hint("merge"), [H, "file_id"]).select(H, "profile_id", F.col("file_id").alias("import_order"), F.col("file_id").alias("import_id"), "content", F.col("spec").withField("decimal_style", F.lit("comma")).alias("spec"))
    rewritten, refused = ingest.fix_profile(given, stored)
    done = rewritten.groupBy(H, "profile_id").agg(F.count_distinct("import_id").alias("n_imports"), F.count(F.lit(1)).alias("n_rows"), F.sum("amount_cents").alias("cents"))
    none = F.lit(0).cast("long")
    return done.select(H, "profile_id", F.lit(None).cast("string").alias("reason"), "n_imports", "n_rows", "cents").unionByName(refused.select(H, "profile_id", "reason", none.alias("n_imports"), none.alias("n_rows"), none.alias("cents")))


@query("reparsed_twins", "facts", """, r AS (SELECT household_id, import_id, id, abs(amount_cents) % 3 AS raw, row_number() OVER (PARTITION BY household_id, import_id ORDER BY id) AS line_no FROM facts),
 t AS (SELECT *, row_number() OVER (PARTITION BY household_id, raw ORDER BY import_id, id DESC) - 1 AS g, list(line_no) OVER (PARTITION BY household_id, import_id, raw ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS spots FROM r)
 SELECT household_id, id, coalesce(spots[g + 1], spots[1]) AS line_no, 'h:' || household_id || '-' || raw || '#' || g AS dedup_key FROM t""")
def reparsed_twins(spark: SparkSession, d: str) -> DataFrame:
    """Facts that share three lines a household, parsed anew: twins were numbered from the last to the first, and the same
    keys come up in each of their files, so each takes the next that no earlier file or twin has."""
    raw = F.concat(F.lit("L"), F.abs("amount_cents") % 3)
    rows = Ledger(spark, d).facts.select(H, F.lit("P").alias("profile_id"), "import_id", "id", raw.alias("raw_line"))
    rows = rows.withColumn("line_no", F.row_number().over(Window.partitionBy(H, "import_id").orderBy("id")).cast("long"))
    twins = Window.partitionBy(H, "import_id", "raw_line")
    was, now = (F.row_number().over(twins.orderBy(by)) - 1 for by in (F.desc("id"), F.col("line_no")))
    key = lambda kind, n: F.concat(F.lit("h:"), kind, F.lit("#"), n)
    rows = staged(rows.withColumns({"was": was, "now": now}), "twins")
    stored = rows.select(H, "profile_id", F.col("import_id").alias("import_order"), "import_id", "id", "raw_line", key(F.concat(F.lit("old"), "raw_line"), F.col("was")).alias("dedup_key"))
    parsed = rows.select(H, "profile_id", "import_id", "line_no", "raw_line", key(F.concat(F.col(H), F.lit("-"), F.substring("raw_line", 2, 1)), F.col("now")).alias("dedup_key"))
    return dedup.align_reparse(stored, parsed).select(H, "id", "line_no", "dedup_key")


_FIXED = f"SELECT p.household_id, p.file_id || ':' || CAST(line_no AS VARCHAR) AS id, p.file_id AS import_id, booking_date, amount_cents, CASE WHEN CAST(right(p.household_id, 3) AS INT) % 5 = 0 THEN account_iban ELSE description END AS description, CASE WHEN CAST(right(p.household_id, 3) AS INT) % 5 = 0 THEN 'INTERPRETED' ELSE 'INGESTED' END AS status, CAST(CASE WHEN CAST(right(p.household_id, 3) AS INT) % 5 = 0 THEN 4 ELSE 7 END AS BIGINT) AS said FROM ({_PARSED}) p"


@query("rewritten_facts", "facts", _FIXED)
def rewritten_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts after the switch: read first with their own IBAN as description, then under the corrected profile. A fifth of
    the households sends one with dots in amounts, which their files refuse, and keeps what it had."""
    home = F.substring(H, -3, 3).cast("int") % 5
    files = _with_spec(statement_files(Ledger(spark, d)))
    # the files' numbers repeat, so rows have content keys
    described = lambda n: F.col("spec").withField("columns.description", F.lit(n)).withField("columns.sequence_number", F.lit(None).cast("int"))
    wrong = files.withColumn("spec", described(4))
    rows, _ = delimited.statements(wrong)
    row = F.concat_ws(":", "file_id", "line_no")
    facts = rows.select("*", row.alias("id"), F.col("file_id").alias("import_id"), F.col("account_iban").alias("account_id"), F.lit("P").alias("profile_id"), F.concat(F.lit("h:"), row, F.lit("#0")).alias("dedup_key"))
    facts = staged(facts, "facts")
    store = ingest.fact_store(spark, f"{shared_folder(spark)}/facts-{uuid.uuid4().hex}", parts=4)
    states = facts.select(H, "import_id").distinct().withColumn("status", F.lit("INTERPRETED"))
    ingest.put_facts(store, facts, states, wrong.select(H, F.lit("P").alias("profile_id"), "spec").distinct())
    given = files.select(H, F.lit("P").alias("profile_id"), F.col("file_id").alias("import_order"), F.col("file_id").alias("import_id"), "content", F.when(home == 0, described(7).withField("decimal_style", F.lit("dot"))).otherwise(described(7)).alias("spec"))
    ingest.rewrite(store, given)
    said = store.read("profiles").select(H, F.get_json_object("spec", "$.columns.description").cast("long").alias("said"))
    found = store.read("facts").join(store.read("states").select(H, "import_id", "status"), [H, "import_id"]).join(said, H)
    return found.select(H, "id", "import_id", "booking_date", "amount_cents", "description", "status", "said")


@query("stale_layouts", "facts", "SELECT DISTINCT f.household_id, f.account_id AS file_id FROM facts f JOIN acct a ON a.household_id = f.household_id AND a.id = f.account_id WHERE CAST(right(f.household_id, 3) AS INT) % 3 = 1")
def stale_layouts(spark: SparkSession, d: str) -> DataFrame:
    """Files of households that stored the layout in another version, in this one, or not at all."""
    book = Ledger(spark, d)
    files = book.facts.select(H, F.col("account_id").alias("file_id")).distinct()
    found = files.withColumns({"template_id": F.lit(positioned.LAYOUT), "template_version": F.lit(positioned.VERSION)})
    kind = F.substring(H, -3, 3).cast("int") % 3
    stored = files.select(H).distinct().where(kind < 2).select(H, F.lit(positioned.LAYOUT).alias("template_id"), (F.lit(positioned.VERSION) + kind).alias("template_version"))
    return positioned.stale(found, stored).select(H, "file_id")


STATEMENT_ROWS = 9_999


def statement_items(book: Ledger) -> DataFrame:
    """Positioned text of statements, 20 transactions to a page, as runs of words: one statement for each current account,
    year and STATEMENT_ROWS transactions, as a layout numbers them with four digits."""
    own = book.accounts.where("iban IS NOT NULL AND role = 'POT'").select(H, F.col("id").alias("account_id"), "iban")
    by = Window.partitionBy(H, "account_id", F.year("booking_date")).orderBy("booking_date", "id")
    rows = book.facts.join(own, [H, "account_id"]).withColumn("n", F.row_number().over(by) - 1)
    rows = rows.withColumn("file_id", F.concat_ws("-", "account_id", F.year("booking_date"), F.floor(F.col("n") / STATEMENT_ROWS))).withColumn("n", F.col("n") % STATEMENT_ROWS + 1)
    # numbered once: the runs and what stands around them are made of the same rows
    rows = staged(rows.select(H, "file_id", "iban", "n", "booking_date", "amount_cents", "counterparty_iban", "description"), "statement-rows")
    signed = F.concat(F.when(F.col("amount_cents") < 0, "-").otherwise("+"), F.lit(" "), F.regexp_replace(money.display(F.col("amount_cents")), "^-", ""))
    day = F.date_format("booking_date", "dd-MM-yyyy")
    page, top = F.floor((F.col("n") - 1) / 20).cast("int"), 700.0 - ((F.col("n") - 1) % 20) * 30
    run = lambda y, x, t, w=50.0: F.struct(y.cast("double").alias("y"), F.lit(float(x)).alias("x"), F.lit(w).alias("width"), t.alias("text"))
    body = F.array(run(top, 40, F.concat(F.lpad(F.col("n").cast("string"), 4, "0"), F.lit(" "), day), 90.0), run(top + 1.5, 140, F.concat(F.lit("(VAL. "), day, F.lit(")"))), run(top - 0.5, 300, signed), run(top - 12, 60, F.concat(F.coalesce("counterparty_iban", F.lit("geen")), F.lit(" "), "description")))
    items = rows.select(H, "file_id", page.alias("page"), F.explode(body).alias("i")).select(H, "file_id", "page", "i.*")
    whole = staged(rows.groupBy(H, "file_id", "iban").agg(F.sum("amount_cents").alias("moved"), F.max(page).alias("last")), "statements")
    closing = F.concat(F.when(F.col("moved") + 100000 < 0, "-").otherwise("+"), F.lit(" "), F.regexp_replace(money.display(F.col("moved") + 100000), "^-", ""))
    spaced = F.rtrim(F.regexp_replace("iban", "(.{4})", "$1 "))
    one = lambda y, x, t: run(F.lit(float(y)), x, t)
    heads = whole.select(H, "file_id", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("page")).select(H, "file_id", "page", F.explode(F.array(one(800, 40, F.lit("Belfius Bank NV")), one(780, 40, F.concat(F.lit("BLZ. : "), (F.col("page") + 1).cast("string"), F.lit("/9"))))).alias("i")).select(H, "file_id", "page", "i.*")
    ends = whole.select(H, "file_id", F.lit(0).alias("page"), F.explode(F.array(one(770, 40, F.concat(F.lit("-- "), spaced, F.lit(" BIC: GKCCBEBB --"))), one(760, 40, F.lit("SALDO OP 01-01-2000 EUR + 1.000,00")))).alias("i")).select(H, "file_id", "page", "i.*")
    last = whole.select(H, "file_id", F.col("last").alias("page"), one(50, 40, F.concat(F.lit("SALDO OP 31-12-2000 EUR "), closing)).alias("i")).select(H, "file_id", "page", "i.*")
    return items.unionByName(heads).unionByName(ends).unionByName(last)


_NUMBERED = "(row_number() OVER (PARTITION BY f.household_id, f.account_id, year(f.booking_date) ORDER BY booking_date, f.id) - 1)"


@query("positioned_statements", "facts", f"SELECT f.household_id, {_FILE} || '-' || CAST({_NUMBERED} // {STATEMENT_ROWS} AS VARCHAR) AS file_id, {_NUMBERED} % {STATEMENT_ROWS} + 1 AS line_no, booking_date, amount_cents, coalesce(counterparty_iban, 'geen') || ' ' || description AS description, CASE WHEN counterparty_iban <> a.iban THEN counterparty_iban END AS counterparty_iban, a.iban AS account_iban FROM facts f JOIN acct a ON a.household_id = f.household_id AND a.id = f.account_id AND a.iban IS NOT NULL AND a.role = 'POT'")
def positioned_statements(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = positioned.statements(staged(positioned.lines(statement_items(Ledger(spark, d))), "lines"))
    return rows.select(H, "file_id", "line_no", "booking_date", "amount_cents", "description", "counterparty_iban", "account_iban")


def _pages(content: bytes) -> list[list[tuple]]:
    """A stand-in for an extractor: pages as lists of runs in JSON."""
    if content.startswith(b"%PDF-LOCKED"):
        raise PermissionError("locked")
    if content.startswith(b"%PDF-NEEDS"):
        raise ModuleNotFoundError("no such reader")
    runs: dict[int, list[tuple]] = {}
    for r in json.loads(content[5:]):
        runs.setdefault(r["page"], []).append((r["x"], r["y"], r["width"], r["text"]))
    return [runs[p] for p in sorted(runs)]


@query("extracted_files", "facts", f"SELECT household_id, file_id, CASE k % 5 WHEN 1 THEN 'extraction-failed' WHEN 2 THEN 'module-unavailable' WHEN 3 THEN 'extraction-failed' END AS reason, CASE k % 5 WHEN 1 THEN 'PermissionError' WHEN 2 THEN 'ModuleNotFoundError' WHEN 3 THEN 'JSONDecodeError' END AS error, CASE WHEN k % 5 IN (0, 4) THEN (n + 19) // 20 ELSE 0 END AS n_pages, CASE WHEN k % 5 IN (0, 4) THEN 4 * n + 2 * ((n + 19) // 20) + 3 ELSE 0 END AS n_runs FROM (SELECT household_id, file_id, CAST(substr(file_id, 2, 9) AS INT) // 10 AS k, count(*) AS n FROM (SELECT f.household_id, {_FILE} || '-' || CAST({_NUMBERED} // {STATEMENT_ROWS} AS VARCHAR) AS file_id FROM facts f JOIN acct a ON a.household_id = f.household_id AND a.id = f.account_id AND a.iban IS NOT NULL AND a.role = 'POT') GROUP BY 1, 2)")
def extracted_files(spark: SparkSession, d: str) -> DataFrame:
    """All statements as bytes, read again by an extractor: a fifth each is locked, needs a reader that is not there, and is
    cut off in the middle."""
    kind = F.floor(F.substring("file_id", 2, 9).cast("int") / 10) % 5
    whole = F.concat(F.lit("%PDF-"), F.to_json(F.collect_list(F.struct("page", "x", "y", "width", "text"))))
    files = statement_items(Ledger(spark, d)).groupBy(H, "file_id").agg(whole.alias("content"))
    content = F.when(kind == 1, F.concat(F.lit("%PDF-LOCKED"), "content")).when(kind == 2, "%PDF-NEEDS").when(kind == 3, F.left("content", F.floor(F.length("content") / 2).cast("int"))).otherwise(F.col("content"))
    files = staged(files.select(H, "file_id", F.encode(content, "utf-8").alias("content")), "bytes")
    items, bad = positioned.items_from_bytes(files.where(delimited.is_positioned(F.col("content"))), _pages)
    read = items.groupBy(H, "file_id").agg(F.count_distinct("page").alias("n_pages"), F.count(F.lit(1)).alias("n_runs"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return files.select(H, "file_id").join(bad, [H, "file_id"], "left").join(read, [H, "file_id"], "left").select(H, "file_id", "reason", "error", zero("n_pages"), zero("n_runs"))


#: An invented layout beside the registered one: statements of savings, whose numbers begin anew and tell no rows apart.
SAVINGS = positioned.Layout("savings-nl", 3, "Rekenuittreksel Sparen", "STAND OP ", "BIJLAGE", r"^PAGINA \d+/\d+$", positioned.BAND, positioned.BALANCE_LINE.replace("SALDO", "STAND"), positioned.START, natural=False)


@query("template_gates", "facts", f"SELECT household_id, file_id, CASE k % 5 WHEN 1 THEN 'unknown-template' WHEN 2 THEN 'template-version' WHEN 3 THEN 'layout-unsupported' END AS reason, CASE WHEN k % 5 IN (0, 4) THEN n ELSE 0 END AS n_rows, k % 5 = 0 AS natural_key FROM (SELECT household_id, file_id, CAST(substr(file_id, 2, 9) AS INT) // 10 AS k, count(*) AS n FROM (SELECT f.household_id, {_FILE} || '-' || CAST({_NUMBERED} // {STATEMENT_ROWS} AS VARCHAR) AS file_id FROM facts f JOIN acct a ON a.household_id = f.household_id AND a.id = f.account_id AND a.iban IS NOT NULL AND a.role = 'POT') GROUP BY 1, 2)")
def template_gates(spark: SparkSession, d: str) -> DataFrame:
    """All statements under two layouts: a fifth each asks for the one it has, for one that nobody knows, for another
    version, for the other layout, and is in the second layout and asks for that."""
    items = statement_items(Ledger(spark, d))
    kind = F.floor(F.substring("file_id", 2, 9).cast("int") / 10) % 5
    said = F.replace(F.replace(F.replace("text", F.lit(positioned.FINGERPRINT), F.lit(SAVINGS.fingerprint)), F.lit("BLZ. : "), F.lit("PAGINA ")), F.lit("SALDO OP"), F.lit("STAND OP"))
    items = items.withColumn("text", F.when(kind == 4, said).otherwise(F.col("text")))
    found = staged(positioned.lines(items), "lines")
    files = found.select(H, "file_id").distinct()
    name = F.when(kind == 1, "nobody-knows").when(kind >= 3, SAVINGS.id).otherwise(positioned.LAYOUT)
    version = F.when(kind == 2, positioned.VERSION + 1).when(kind >= 3, SAVINGS.version).otherwise(positioned.VERSION)
    asked = files.withColumns({"template_id": name, "template_version": version})
    rows, bad = positioned.statements(found, asked, (*positioned.REGISTRY, SAVINGS))
    whole = rows.groupBy(H, "file_id").agg(F.count(F.lit(1)).alias("n_rows"), F.bool_and("natural_key").alias("natural_key"))
    return files.join(bad, [H, "file_id"], "left").join(whole, [H, "file_id"], "left").select(H, "file_id", "reason", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), F.coalesce("natural_key", F.lit(False)).alias("natural_key"))


_SPECS = """SELECT s_suppkey AS k, CASE s_suppkey % 9 WHEN 7 THEN '|' WHEN 8 THEN ',' ELSE ';' END AS delimiter, CASE s_suppkey % 7 WHEN 3 THEN 'latin' ELSE 'utf-8' END AS encoding, CAST(s_suppkey % 11 - 1 AS INT) AS header_row_index,
 CASE s_suppkey % 3 WHEN 0 THEN 'signed' WHEN 1 THEN 'debitCredit' ELSE 'indicator' END AS amount_kind, CAST(s_suppkey % 8 - 1 AS INT) AS a, CAST(s_nationkey % 9 - 1 AS INT) AS b, CASE s_nationkey % 4 WHEN 0 THEN 'd' ELSE 'C' END AS mark, CAST(s_nationkey % 10 - 1 AS INT) AS said, CAST(s_nationkey % 6 - 1 AS INT) AS value_date FROM {supplier}"""


@query("spec_checks", None, f"SELECT k, CASE WHEN delimiter NOT IN (';', ',') THEN 'delimiter' WHEN encoding NOT IN ('utf-8', 'windows-1252') THEN 'encoding' WHEN header_row_index < 0 THEN 'header_row_index' WHEN a < 0 OR amount_kind <> 'signed' AND b < 0 THEN 'amount' WHEN amount_kind = 'indicator' AND upper(mark) = 'D' THEN 'indicator' WHEN said < 0 OR value_date < 0 THEN 'columns' END AS problem FROM ({_SPECS.format(supplier='supplier')})")
def spec_checks(spark: SparkSession, d: str) -> DataFrame:
    """A profile for each supplier, written as JSON, many of them with one thing or another wrong."""
    raw = spark.sql(_SPECS, supplier=spark.read.parquet(f"{d}/supplier.parquet"))
    only = lambda kind, column: F.when(F.col("amount_kind") == kind, F.col(column))
    amount = F.struct(F.col("amount_kind").alias("kind"), F.when(F.col("amount_kind") != "debitCredit", F.col("a")).alias("column"), only("debitCredit", "a").alias("debit_column"), only("debitCredit", "b").alias("credit_column"), only("indicator", "b").alias("indicator_column"), F.lit("D").alias("debit_value"), F.col("mark").alias("credit_value"))
    columns = F.struct(F.lit(0).alias("booking_date"), F.col("said").alias("description"), "value_date")
    spec = F.to_json(F.struct("delimiter", "encoding", "header_row_index", F.lit("DD/MM/YYYY").alias("date_format"), F.lit("comma").alias("decimal_style"), amount.alias("amount"), columns.alias("columns")))
    return profile.spec_problems(raw.select("k", spec.alias("spec"))).select("k", "problem")
