"""Counterparty texts: keys, the descriptor normaliser, masking, globs. All are expressions over built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.constants import CITIES
from tallyloom.functions.binding import let
from tallyloom.functions.money import WS

#: Borders of ASCII words: Java's \b takes letters with accents as word characters, the rules do not.
_B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

#: The patterns of card descriptors, in upper case.
LABEL = rf"(?:KAART(?:{WS}+NR\.?)?|(?:CARTE|CARD){WS}+(?:N°|NO|NR)\.?)"
RAIL = rf"^(?:DEBITMASTERCARD-BETALING|BANCONTACT-AANKOOP){_B}(?:{WS}+VIA{WS}+(?:GOOGLE|APPLE|SAMSUNG|GARMIN|FITBIT){WS}+PAY{_B})?(?:{WS}*-)?"
CARD_TAIL = rf"({_B}{LABEL}){WS}+(?:[0-9X]{{4}}(?:{WS}|[.-])*){{3}}[0-9X]{{4}}(?:{WS}*-{WS}*[A-Z][A-Z'-]+(?:{WS}+[A-Z][A-Z'-]+)*{WS}*$)?"
AMOUNT_BEFORE_LABEL = rf"(?:^|{WS})[0-9]{{1,3}}(?:(?:\.|{WS})[0-9]{{3}})*,[0-9]{{2}}{WS}+(?:EUR|USD|GBP|CHF)(?={WS}+{LABEL}(?![A-Z]))"
COUNTRY = rf"{WS}*<[A-Z]{{1,3}}>{WS}*"
NOISE = (
    rf"{_B}BETALING MET (?:[A-Z]+-)?(?:DEBET|KREDIET)?KAART{_B}",
    rf"{_B}(?:VIA )?BANCONTACT{_B}",
    rf"{_B}MAESTRO{_B}",
    rf"{_B}CONTACTLOOS{_B}",
    rf"{_B}CONTACTLESS{_B}",
    rf"(?:X{{4,}}|\*{{4,}}){WS}?[0-9]{{2,6}}{_B}",
    rf"{_B}[A-Z]{{3}} [0-9]+(?:[.,][0-9]+)? KOERS [0-9]+(?:[.,][0-9]+)?{_B}",
    rf"{_B}[0-9]{{1,2}}[-/.][0-9]{{1,2}}[-/.][0-9]{{2,4}}{_B}",
    rf"{_B}(?:0[1-9]|[12][0-9]|3[01])[-/.](?:0[1-9]|1[0-2]){_B}",
    rf"{_B}[0-9]{{1,2}}:[0-9]{{2}}(?::[0-9]{{2}})?{_B}",
)
POSTAL = rf"(?<![0-9]{{4}} ){_B}[1-9][0-9]{{3}} (?=[A-Z][A-Z'-]+{_B})"
IBAN_IN_TEXT = rf"{_B}([A-Z]{{2}}[0-9]{{2}}(?:{WS}?[0-9]{{4}}){{3}}){_B}"


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def key_text(text: Column) -> Column:
    """The frozen recipe of deduplication keys; kept apart from the normaliser, which may change."""
    return F.trim(F.regexp_replace(F.upper(text), f"{WS}+", " "))


def counterparty_text(name: Column, description: Column) -> Column:
    """Null falls back, an empty name does not."""
    return F.coalesce(name, description)


def refund_key(iban: Column, name: Column, description: Column) -> Column:
    by_iban = F.concat(F.lit("iban:"), F.regexp_replace(F.upper(iban), f"{WS}+", ""))
    return F.when(iban.isNotNull(), by_iban).otherwise(F.concat(F.lit("text:"), key_text(counterparty_text(name, description))))


def _stripped(upper: Column) -> Column:
    t = F.regexp_replace(upper, RAIL, " ")
    for pattern in (AMOUNT_BEFORE_LABEL, CARD_TAIL, COUNTRY, *NOISE):
        t = F.regexp_replace(t, pattern, " ")
    t = collapsed(F.regexp_replace(t, POSTAL, ""))

    def dashes(t: Column) -> Column:
        without = collapsed(F.array_join(F.filter(F.split(t, " "), lambda w: w != "-"), " "))
        return F.when(upper.rlike(CARD_TAIL), without).otherwise(F.regexp_replace(t, rf"({WS}-)(?:{WS}-)+(?={WS})", "$1"))

    # trailing city words go while a word stays: one pattern instead of a loop
    t = F.regexp_replace(let(t, dashes), rf"(?<=[^ ])(?: (?:{'|'.join(CITIES)}))+$", "")
    return collapsed(F.regexp_replace(t, rf"^(?:{WS}|[,;:.-])+|(?:{WS}|[,;:.-])+$", ""))


def normalise_counterparty(text: Column) -> Column:
    """A stable name for the counterparty of a descriptor; never empty unless the text is.

    Call it on distinct texts (`merchants.resolve` does): the patterns are many.
    """

    def floor(upper: Column) -> Column:
        bare = collapsed(F.regexp_replace(upper, CARD_TAIL, "$1"))
        last = lambda b: let(_stripped(b), lambda s: F.when(s != "", s).when(b == "", upper).otherwise(b))
        return let(_stripped(upper), lambda s: F.when(s != "", s).otherwise(let(bare, last)))

    return let(collapsed(F.upper(text)), floor)


def glob_to_regex(glob: Column) -> Column:
    """`*` is any run of characters, everything else is itself, the whole text must match."""
    return F.concat(F.lit(r"(?s)^\Q"), F.replace(F.replace(glob, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit("*"), F.lit(r"\E.*\Q")), F.lit(r"\E$"))


MASKABLE = rf"({_B}{LABEL}{WS}+)(?:[0-9X]{{4}}(?:{WS}|[.-])*){{3}}([0-9X]{{4}}){_B}"


def masked_cards(text: Column) -> Column:
    """For display only: the label, four stars, the last group."""
    return F.regexp_replace(text, MASKABLE, "$1**** $2")


def first_foreign_iban(text: Column, own: Column) -> Column:
    """The first IBAN in a text that is none of the own ones (compact), or null."""
    found = F.transform(F.regexp_extract_all(text, F.lit(IBAN_IN_TEXT), F.lit(1)), lambda i: F.regexp_replace(i, f"{WS}", ""))
    return F.try_element_at(F.filter(found, lambda i: ~F.array_contains(own, i)), F.lit(1))
