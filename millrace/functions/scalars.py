"""Time, text and amount functions used by loads, merges and queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.schemas import MONEY, OUTGOING_TYPES


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- time ---------------------------------------------------------------

def latency_ms(start, end) -> Column:
    """Millisecond boundaries crossed between two timestamps (0.9 ms to 1.1 ms is 1)."""
    return F.unix_millis(_c(end).cast("timestamp")) - F.unix_millis(_c(start).cast("timestamp"))


def ms_precision(ts) -> Column:
    """Cut a timestamp to whole milliseconds, zone-less."""
    return F.date_trunc("MILLISECOND", _c(ts)).cast("timestamp_ntz")


def utc_now() -> Column:
    return F.localtimestamp()


def iso_text(ts) -> Column:
    """ISO-8601 text with milliseconds; null stays null."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS")


def utc_date(ts) -> Column:
    return F.to_date(_c(ts))


def seconds_from_ms(ms) -> Column:
    return F.round(_c(ms) / 1000, 1)


# -- null, blank and text -------------------------------------------------

def full_name(first, last) -> Column:
    """First and last name with a space; null when either is null."""
    return F.concat(_c(first), F.lit(" "), _c(last))


def blank_if_null(c) -> Column:
    return F.coalesce(_c(c), F.lit(""))


def null_if_blank(c) -> Column:
    return F.nullif(_c(c), F.lit(""))


def null_if_zero(c) -> Column:
    return F.nullif(_c(c), F.lit(0))


def trimmed_key(c) -> Column:
    return F.trim(blank_if_null(c))


def is_true_text(c) -> Column:
    return F.coalesce(_c(c) == "true", F.lit(False))


def cut_text(c, n: int) -> Column:
    return F.substring(_c(c), 1, n)


def first_name_of(name) -> Column:
    return F.split(_c(name), " ", 2)[0]


def last_name_of(name) -> Column:
    """Everything after the first blank; ``Smith`` when there is none."""
    return F.coalesce(F.get(F.split(_c(name), " ", 2), F.lit(1)), F.lit("Smith"))


def address_parts(line) -> dict[str, Column]:
    """Split ``City, ST 12345`` at its last comma.

    Without a comma all three parts fall back; a short tail has zip ``00000``.
    """
    line = _c(line)
    has_comma = line.contains(",")
    tail = F.trim(F.regexp_extract(line, "([^,]*)$", 1))
    city = F.trim(F.regexp_extract(line, "^(.*),", 1))
    zip_code = F.when(F.length(tail) > 3, tail.substr(F.lit(4), F.length(tail))).otherwise("00000")
    # The fallback address.
    return {
        "city": F.when(has_comma, cut_text(city, 50)).otherwise("Anytown"),
        "state": F.when(has_comma, cut_text(tail, 2)).otherwise("CA"),
        "zip": F.when(has_comma, cut_text(zip_code, 10)).otherwise("90210"),
    }


def first_word(c) -> Column:
    return F.split_part(_c(c), F.lit(" "), F.lit(1))


# -- amounts --------------------------------------------------------------

def clamp(c, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(_c(c), F.lit(high)))


def interest_amount(balance) -> Column:
    """One ten-thousandth of the balance, at least one cent."""
    daily = F.round(_c(balance) * F.lit("0.0001").cast("decimal(6,4)"), 2).cast(MONEY)
    return F.greatest(F.lit("0.01").cast(MONEY), daily)


def signed_amount(txn_type, magnitude) -> Column:
    """Outgoing types are negative, all others positive."""
    magnitude = _c(magnitude)
    return F.when(_c(txn_type).isin(*OUTGOING_TYPES), -magnitude).otherwise(magnitude)


def txn_description(txn_type, detail) -> Column:
    """Ledger text by type; ``detail`` is the shop, deposit kind or fee kind."""
    txn_type, detail = _c(txn_type), _c(detail)
    # Description texts.
    text = (
        F.when(txn_type == "DEBIT", F.concat(F.lit("POS Purchase - "), detail))
        .when(txn_type.isin("DEPOSIT", "FEE"), detail)
        .when(txn_type == "WITHDRAWAL", "ATM Withdrawal")
        .when(txn_type == "INTEREST", "Interest Payment")
        .when(txn_type.isin("TRANSFER_IN", "TRANSFER_OUT"), "Internal Account Transfer")
    )
    return cut_text(text, 200)


def txn_merchant(txn_type, detail, house_name: str = "House Bank") -> Column:
    """Counterparty by type: the shop, the first word of a deposit kind, the
    cash machine, or the bank itself."""
    txn_type, detail = _c(txn_type), _c(detail)
    name = (
        F.when(txn_type == "DEBIT", detail)
        .when(txn_type == "DEPOSIT", first_word(detail))
        .when(txn_type == "WITHDRAWAL", "ATM")
        .when(txn_type.isin("FEE", "INTEREST", "TRANSFER_IN", "TRANSFER_OUT"), house_name)
    )
    return cut_text(name, 100)


def rounded(c, digits: int = 0) -> Column:
    """Half away from zero."""
    return F.round(_c(c), digits)
