"""Fixed values of the ledger rules."""

TRANSFER_DAYS = 4
SETTLEMENT_DAYS = 45
PADDING_DAYS = SETTLEMENT_DAYS + TRANSFER_DAYS
SETTLEMENT_DEBIT = r"MASTERCARD\s+AFREKENING\s+NUMMER"
SETTLEMENT_CREDIT = r"DOMICILIERING\s+VIA\s+JE\s+BANK"
CASH = r"(GELDOPNAME)|(GELDAFHALING)|(CASH\s+WITHDRAWAL)"
FLOWS = ("INCOME", "SPEND", "INTERNAL", "RESERVE", "UNRESOLVED")
LINE_Y_TOLERANCE, WORD_GAP, INDENT = 2.0, 1.0, 6.0
#: City names that a descriptor may end with.
CITIES = (
    "AALST ANTWERPEN BRUGGE BRUSSEL BRUSSELS CHARLEROI GENK GENT HALLE HASSELT KORTRIJK LEUVEN LIEGE LONDON LUIK MECHELEN NAMEN NAMUR OOSTENDE ROESELARE SEATTLE TURNHOUT"
).split()
