"""Delimited statement files: routing, decoding, lines, fields, rows; one bad row fails its whole file.

Files: household_id, file_id, content (binary), spec (struct SPEC). Line numbers are physical, from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.dates import parse_date_as
from tallyloom.functions.money import parse_cents, parse_unsigned_cents, trimmed

SPEC = (
    "struct<kind:string,delimiter:string,encoding:string,header_row_index:int,date_format:string,decimal_style:string,"
    "amount:struct<kind:string,column:int,debit_column:int,credit_column:int,indicator_column:int,debit_value:string,credit_value:string>,"
    "columns:struct<booking_date:int,description:int,value_date:int,counterparty_name:int,counterparty_iban:int,account_iban:int,reference:int,statement_number:int,sequence_number:int>>"
)
ROLES = ("counterparty_name", "counterparty_iban", "account_iban", "reference", "statement_number", "sequence_number")


def is_positioned(content: Column) -> Column:
    """Whether the first five bytes are those of a PDF; everything else is delimited text."""
    return F.coalesce(F.hex(F.substring(content, 1, 5)) == "255044462D", F.lit(False))


def encoding_of(content: Column) -> Column:
    return F.when(F.is_valid_utf8(content.cast("string")), "utf-8").otherwise("windows-1252")


#: What windows-1252 says of the bytes that ISO 8859-1 has as controls; its five undefined bytes stay controls.
_CONTROLS = "".join(chr(i) for i in range(0x80, 0xA0) if bytes([i]).decode("cp1252", "ignore"))
_SIGNS = _CONTROLS.encode("latin-1").decode("cp1252")


def decoded(files: DataFrame) -> DataFrame:
    """files with `text`, without a mark of byte order."""
    utf8 = F.col("content").cast("string")
    text = F.when(utf8.startswith("\ufeff"), F.substring(utf8, 2, 2**31 - 1)).otherwise(utf8)
    old = F.translate(F.decode("content", "ISO-8859-1"), _CONTROLS, _SIGNS)
    return files.withColumn("text", F.when(F.is_valid_utf8(utf8), text).otherwise(old))


def by_file(files: DataFrame) -> DataFrame:
    """files dealt by their key, before their lines are taken apart: whatever is grouped or joined by file after that
    stays where it is, so a file's lines and cells are never shuffled."""
    return files.repartition("household_id", "file_id")


def lines(files: DataFrame) -> DataFrame:
    """One row per physical line, without the carriage return; empty lines at the end are none."""
    kept = F.regexp_replace("text", r"(?=[\r\n])(?:\r?\n|\r$)+\z", "")
    n = F.when(kept == "", 0).otherwise(F.length(kept) - F.length(F.replace(kept, F.lit("\n"))) + 1)
    each = files.select(*[c for c in files.columns if c not in ("content", "text")], F.posexplode(F.slice(F.split("text", "\n", -1), F.lit(1), n)).alias("index", "line"))
    ends = F.col("line").endswith("\r")
    return each.withColumn("line", F.when(ends, F.regexp_replace("line", "\r$", "")).otherwise(F.col("line")))


def fields(line: Column, delimiter: Column) -> Column:
    """Cells of a line. A quote opens on an empty cell only, a doubled one is a quote, text behind a closing one is added,
    an open one takes the rest. Lines without a quote are simply split."""
    other = F.concat(F.lit(r"[^\Q"), delimiter, F.lit(r"\E]*+"))
    quoted = r'"[^"]*+(?:""[^"]*+)*+'
    pattern = F.concat(F.lit(r"\Q"), delimiter, F.lit(rf'\E({quoted}(?:"'), other, F.lit(")?+|"), other, F.lit(")"))
    part = lambda cell, n: F.regexp_extract(cell, rf'(?s)^({quoted})(?:"(.*))?\z', n)
    whole = lambda cell: F.concat(F.replace(F.substring(part(cell, 1), 2, 2**31 - 1), F.lit('""'), F.lit('"')), part(cell, 2))
    cells = F.regexp_extract_all(F.concat(delimiter, line), pattern, F.lit(1))
    slow = F.transform(cells, lambda c: F.when(c.startswith('"'), whole(c)).otherwise(c))
    return F.when(line.contains('"'), slow).otherwise(F.split(line, delimiter, -1))


def _cell(cells: Column, at: Column) -> Column:
    return F.when(at.isNotNull(), trimmed(F.coalesce(F.try_element_at(cells, at + 1), F.lit(""))))


def parsed(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Data lines as rows with `problem` (null, date, amount, missing-column or indicator), over all files at once. `keep`
    names columns of the files that their rows carry on."""
    spec, cells = F.col("spec"), F.col("cells")
    rows = lines(by_file(decoded(files).drop("content"))).where((F.col("index") > spec["header_row_index"]) & (trimmed(F.col("line")) != ""))
    rows = rows.withColumn("cells", fields(F.col("line"), spec["delimiter"]))
    at, amount, style = spec["columns"], spec["amount"], spec["decimal_style"]
    rows = rows.withColumns({"_debit": _cell(cells, amount["debit_column"]), "_credit": _cell(cells, amount["credit_column"]), "_amount": _cell(cells, amount["column"])})
    debit, credit = F.col("_debit"), F.col("_credit")
    marker = F.upper(_cell(cells, amount["indicator_column"]))
    rows = rows.withColumn("_size", parse_unsigned_cents(F.col("_amount"), style))
    size, signed = F.col("_size"), parse_cents(F.col("_amount"), style)
    pair = F.when((debit != "") & (credit != ""), None).when(debit != "", -parse_unsigned_cents(debit, style)).when(credit != "", parse_unsigned_cents(credit, style))
    marked = F.when(marker == F.upper(amount["debit_value"]), -size).when(marker == F.upper(amount["credit_value"]), size)
    cents = F.when(amount["kind"] == "signed", signed).when(amount["kind"] == "debitCredit", pair).otherwise(marked)
    booked = parse_date_as(_cell(cells, at["booking_date"]), spec["date_format"])
    rows = rows.withColumns({"booking_date": booked, "amount_cents": cents})
    problem = (
        F.when(F.col("booking_date").isNull(), "date")
        .when(F.col("amount_cents").isNotNull(), None)
        .when((amount["kind"] == "debitCredit") & (debit == "") & (credit == ""), "missing-column")
        .when((amount["kind"] == "indicator") & size.isNotNull(), "indicator")
        .otherwise("amount")
    )
    texts = {r: F.nullif(_cell(cells, at[r]), F.lit("")) for r in ROLES}
    return rows.select("household_id", "file_id", (F.col("index") + 1).cast("long").alias("line_no"), F.col("line").alias("raw_line"), "booking_date", "amount_cents", F.coalesce(_cell(cells, at["description"]), F.lit("")).alias("description"), F.when(at["value_date"].isNotNull(), parse_date_as(_cell(cells, at["value_date"]), spec["date_format"])).alias("value_date"), *(c.alias(r) for r, c in texts.items()), problem.alias("problem"), *keep)


def statements(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the files that parse whole, and the others with their first problem (line, kind), or 'empty-file', or
    'mixed-accounts' where rows name more than one own IBAN."""
    rows = parsed(files)
    state = failures(files, rows)
    good = rows.join(state.where("reason IS NULL").select("household_id", "file_id").hint("merge"), ["household_id", "file_id"], "left_semi").drop("problem")
    return good, state.where("reason IS NOT NULL")


def failures(files: DataFrame, rows: DataFrame) -> DataFrame:
    """(household_id, file_id, reason, line_no, raw_line) of all files, from their rows as `parsed`; whole ones have no reason."""
    first = F.min_by(F.when(F.col("problem").isNotNull(), F.struct("line_no", "problem", "raw_line")), F.when(F.col("problem").isNotNull(), F.col("line_no")))
    state = rows.groupBy("household_id", "file_id").agg(first.alias("bad"), F.count(F.lit(1)).alias("n"), (F.min("account_iban") < F.max("account_iban")).alias("mixed"))
    state = files.select("household_id", "file_id").join(state.hint("merge"), ["household_id", "file_id"], "left")
    reason = F.when(F.col("n").isNull(), "empty-file").when(F.col("bad").isNotNull(), F.concat(F.lit("row-"), F.col("bad.problem"))).when(F.col("mixed"), "mixed-accounts")
    return state.select("household_id", "file_id", reason.alias("reason"), F.col("bad.line_no").alias("line_no"), F.col("bad.raw_line").alias("raw_line"))


def own_ibans(rows: DataFrame) -> DataFrame:
    """Distinct own IBANs of a file in the order in which they first occur."""
    first = rows.where("account_iban IS NOT NULL").groupBy("household_id", "file_id", "account_iban").agg(F.min("line_no").alias("line_no"))
    return first.groupBy("household_id", "file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "account_iban"))), lambda s: s["account_iban"]).alias("account_ibans"))


def preview(rows: DataFrame, n: int = 5) -> DataFrame:
    """The first n rows of each file."""
    from pyspark.sql import Window

    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("household_id", "file_id").orderBy("line_no"))).where(F.col("_n") <= n).drop("_n")
