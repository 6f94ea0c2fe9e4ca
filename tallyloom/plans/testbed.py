"""A ledger over the star-schema test tables, as one text of SQL that Spark and DuckDB both read.

Households are nations, accounts customers, facts orders; transfers have their second leg on the household's next account,
card statements are settled by a debit and mirrored by a credit. Amounts, days and texts are chosen so that candidates are
contested, lie on both sides of the windows, and every flow and gap occurs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tallyloom.staging import staged

TABLES = ("customer", "orders", "supplier")
_PAD = lambda x, n: f"lpad(cast({x} as string), {n}, '0')"

LEDGER = f"""
acct AS (
  SELECT concat('H', {_PAD('c_nationkey', 3)}) AS household_id, concat('A', {_PAD('c_custkey', 9)}) AS id,
    CASE WHEN c_custkey % 10 = 0 THEN 'RESERVE' ELSE 'POT' END AS role,
    CASE WHEN c_custkey % 10 = 1 THEN NULL ELSE concat('BE', {_PAD('c_custkey', 14)}) END AS iban, c_name AS label, c_custkey AS k
  FROM {{customer}}),
pots AS (
  SELECT household_id, id, iban, coalesce(lead(id) OVER (PARTITION BY household_id ORDER BY k), min(id) OVER (PARTITION BY household_id)) AS next_id
  FROM acct WHERE role = 'POT' AND iban IS NOT NULL),
saves AS (SELECT household_id, min(iban) AS reserve_iban FROM acct WHERE role = 'RESERVE' GROUP BY household_id),
payers AS (SELECT household_id, min(id) AS payer FROM pots GROUP BY household_id),
ord AS (
  SELECT o_orderkey AS ok, a.household_id, a.id AS account_id, a.iban AS own, a.role = 'POT' AND a.iban IS NULL AS card, cast(round(o_totalprice * 100) AS bigint) AS cents,
    cast(o_orderdate AS date) AS day, o_orderkey % 8 AS kind, p.next_id, n.iban AS next_iban, s.reserve_iban
  FROM {{orders}} JOIN acct a ON o_custkey = a.k
  LEFT JOIN pots p ON p.household_id = a.household_id AND p.id = a.id
  LEFT JOIN pots n ON n.household_id = a.household_id AND n.id = p.next_id
  LEFT JOIN saves s ON s.household_id = a.household_id),
main AS (
  SELECT household_id, concat('T', {_PAD('ok', 12)}) AS id, account_id, concat(account_id, '-', substr(cast(day AS string), 1, 7)) AS import_id, day AS booking_date,
    CASE WHEN card THEN -cents WHEN kind = 0 THEN cents WHEN kind = 1 THEN -cents WHEN kind = 2 THEN -((cents % 5 + 1) * 10000) WHEN kind = 3 AND ok % 16 = 3 THEN -cents WHEN kind = 3 THEN cents
      WHEN kind = 4 THEN -((cents % 9 + 1) * 2000) WHEN kind = 5 THEN cents WHEN kind = 6 THEN -cents ELSE 0 END AS amount_cents,
    CASE WHEN card THEN concat('CARD ITEM ', cast(ok % 17 AS string)) WHEN kind = 0 THEN 'SALARY' WHEN kind = 1 THEN concat('BETALING MET DEBETKAART SHOP ', cast(ok % 19 AS string), ' 9000 GENT')
      WHEN kind = 2 THEN 'OWN TRANSFER' WHEN kind = 3 THEN 'SAVINGS' WHEN kind = 4 THEN 'GELDOPNAME BANCONTACT' WHEN kind = 5 THEN 'TERUGBETALING' WHEN kind = 6 THEN 'AANKOOP' ELSE 'NIHIL' END AS description,
    CASE WHEN card THEN NULL WHEN kind = 2 THEN next_iban WHEN kind = 3 THEN reserve_iban WHEN kind = 0 AND ok % 3 = 0 THEN concat('NL', {_PAD('ok % 97', 14)}) ELSE NULL END AS counterparty_iban,
    CASE WHEN card THEN NULL WHEN kind = 0 THEN concat('EMPLOYER ', cast(ok % 7 AS string)) WHEN kind = 5 THEN concat('SHOP ', cast(ok % 11 AS string)) WHEN kind = 6 THEN concat('SHOP ', cast(ok % 13 AS string)) ELSE NULL END AS counterparty_name
  FROM ord),
partner AS (
  SELECT household_id, concat('P', {_PAD('ok', 12)}) AS id, next_id AS account_id, day + cast(floor(ok / 8) % 6 AS int) AS booking_date, (cents % 5 + 1) * 10000 AS amount_cents, own AS counterparty_iban
  FROM ord WHERE NOT card AND kind = 2 AND next_id <> account_id AND ok % 5 <> 0),
bills AS (
  SELECT o.household_id, o.account_id, concat(o.account_id, '-', substr(cast(o.day AS string), 1, 7)) AS import_id, p.payer, cast(sum(o.cents) AS bigint) AS total, max(o.day) AS last_day
  FROM ord o JOIN payers p ON p.household_id = o.household_id WHERE o.card GROUP BY o.household_id, o.account_id, concat(o.account_id, '-', substr(cast(o.day AS string), 1, 7)), p.payer),
debits AS (SELECT *, last_day + cast(total % 60 AS int) AS paid FROM bills WHERE total % 7 <> 0),
facts AS (
  SELECT * FROM main
  UNION ALL SELECT household_id, id, account_id, concat(account_id, '-', substr(cast(booking_date AS string), 1, 7)), booking_date, amount_cents, 'OWN TRANSFER', counterparty_iban, NULL FROM partner
  UNION ALL SELECT household_id, concat('S', import_id), payer, concat(payer, '-', substr(cast(paid AS string), 1, 7)), paid, -total, 'MASTERCARD AFREKENING NUMMER 1', NULL, NULL FROM debits
  UNION ALL SELECT household_id, concat('M', import_id), account_id, concat(import_id, '-M'), paid + cast(total % 6 AS int), total, 'DOMICILIERING VIA JE BANK', NULL, NULL FROM debits WHERE total % 5 <> 0),
rules AS (
  SELECT concat('H', {_PAD('s_nationkey', 3)}) AS household_id, concat('R', {_PAD('s_suppkey', 6)}) AS id, concat('H', {_PAD('s_nationkey', 3)}, '-M', cast(s_suppkey % 5 AS string)) AS merchant_id,
    CASE WHEN s_suppkey % 3 = 0 THEN 'EXACT' WHEN s_suppkey % 3 = 1 THEN 'PREFIX' ELSE 'PATTERN' END AS kind,
    CASE WHEN s_suppkey % 3 = 0 THEN concat('SHOP ', cast(s_suppkey % 19 AS string)) WHEN s_suppkey % 3 = 1 THEN concat('SHOP ', cast(s_suppkey % 2 AS string))
      WHEN s_suppkey % 2 = 0 THEN concat('*LOYER ', cast(s_suppkey % 7 AS string)) ELSE concat('CARD*', cast(s_suppkey % 10 AS string)) END AS pattern
  FROM {{supplier}}),
merchants AS (SELECT DISTINCT household_id, merchant_id AS id, concat('Merchant ', merchant_id) AS name FROM rules),
tags AS (SELECT DISTINCT household_id, concat(household_id, '-', right(merchant_id, 1)) AS id, concat('Tag ', cast(ascii(right(merchant_id, 1)) % 3 AS string)) AS name FROM rules),
merchant_tags AS (SELECT DISTINCT household_id, merchant_id, concat(household_id, '-', right(merchant_id, 1)) AS tag_id, right(merchant_id, 1) <> '4' AS is_primary FROM rules)
"""


#: The part `ord` in two steps: what accounts say of each other is joined once an account, not once an order.
OWNERS = """SELECT a.k, a.household_id, a.id AS account_id, a.iban AS own, a.role = 'POT' AND a.iban IS NULL AS card, p.next_id, n.iban AS next_iban, s.reserve_iban
  FROM acct a LEFT JOIN pots p ON p.household_id = a.household_id AND p.id = a.id
  LEFT JOIN pots n ON n.household_id = a.household_id AND n.id = p.next_id
  LEFT JOIN saves s ON s.household_id = a.household_id"""
ORD = """SELECT o_orderkey AS ok, w.household_id, w.account_id, w.own, w.card, cast(round(o_totalprice * 100) AS bigint) AS cents, cast(o_orderdate AS date) AS day, o_orderkey % 8 AS kind, w.next_id, w.next_iban, w.reserve_iban
  FROM {orders} JOIN {owners} w ON o_custkey = w.k"""


def plain_sql() -> str:
    """The text with the tables' own names, for DuckDB."""
    return re.sub(r"\{(\w+)\}", r"\1", LEDGER)


@dataclass
class Ledger:
    spark: SparkSession
    sf_dir: str

    def _tables(self) -> dict[str, DataFrame]:
        return {t: self.spark.read.parquet(f"{self.sf_dir}/{t}.parquet") for t in TABLES}

    def _made(self, select: str, **given: DataFrame) -> DataFrame:
        """A part of the text that is given is not made anew."""
        text = LEDGER
        for part in given:
            text = re.sub(rf"\n{part} AS \(.*?\),\n(?=\w+ AS \()", f"\n{part} AS (SELECT * FROM {{{part}}}),\n", text, flags=re.DOTALL)
        return self.spark.sql(f"WITH {text} {select}", **self._tables(), **given)

    def _get(self, name: str) -> DataFrame:
        """Staged, as every step of the lineage reads it again."""
        return staged(self._made(f"SELECT * FROM {name}"), name)

    @cached_property
    def orders(self) -> DataFrame:
        """The part `ord`, which four others read."""
        owners = staged(self._made(OWNERS), "owners")
        return staged(self.spark.sql(ORD, orders=self._tables()["orders"], owners=owners), "ord")

    @cached_property
    def facts(self) -> DataFrame:
        return staged(self.facts_once, "facts")

    @cached_property
    def facts_once(self) -> DataFrame:
        """The facts, not written: for what reads them once."""
        return self._made("SELECT * FROM facts", ord=self.orders)

    @cached_property
    def accounts(self) -> DataFrame:
        return self._get("acct")

    @cached_property
    def rules(self) -> DataFrame:
        return self._get("rules")

    @cached_property
    def merchants(self) -> DataFrame:
        return self._get("merchants")

    @cached_property
    def tags(self) -> DataFrame:
        return self._get("tags")

    @cached_property
    def merchant_tags(self) -> DataFrame:
        return self._get("merchant_tags")
