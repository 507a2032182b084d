"""Display columns: bands, labels, ages, currency text and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.scalars import _c


def latency_band(ms) -> Column:
    """Bands at 1, 3 and 6 seconds."""
    ms = _c(ms)
    return (
        F.when(ms < 1000, "under_1s")
        .when(ms < 3000, "1s_to_3s")
        .when(ms < 6000, "3s_to_6s")
        .when(ms >= 6000, "over_6s")
    )


def _seconds_text(ms: Column, digits: int) -> Column:
    scaled = F.round(ms.cast("decimal(20,3)") / 1000, digits)
    return F.concat(scaled.cast(f"decimal(20,{digits})").cast("string"), F.lit("s"))


def latency_label(ms, missing: str = "—", long_form: bool = False) -> Column:
    """``850ms`` below a second, then seconds with one decimal.

    From ten seconds on the short form has no decimal; ``long_form`` keeps it.
    """
    ms = _c(ms)
    label = F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
    if not long_form:
        label = label.when(ms >= 10000, _seconds_text(ms, 0))
    return F.when(ms.isNull(), missing).otherwise(label.otherwise(_seconds_text(ms, 1)))


def age_label(ts, as_of, clock_after_hour: bool = False) -> Column:
    """``5s ago``, ``3m ago``, ``2h ago``; never negative, seconds rounded.

    ``clock_after_hour`` shows the time of day instead of hours.
    """
    millis = F.unix_millis(_c(as_of).cast("timestamp")) - F.unix_millis(_c(ts).cast("timestamp"))
    secs = F.greatest(F.lit(0), F.round(millis.cast("decimal(20,0)") / 1000, 0)).cast("long")
    late = (
        F.date_format(_c(ts), "HH:mm:ss")
        if clock_after_hour
        else F.concat(F.floor(secs / 3600).cast("string"), F.lit("h ago"))
    )
    return (
        F.when(secs.isNull(), "—")
        .when(secs < 60, F.concat(secs.cast("string"), F.lit("s ago")))
        .when(secs < 3600, F.concat(F.floor(secs / 60).cast("string"), F.lit("m ago")))
        .otherwise(late)
    )


def currency_text(amount, keep_sign: bool = False, plus: bool = True) -> Column:
    """``+$1,234.50``. Negative amounts show a minus only with ``keep_sign``."""
    amount = _c(amount)
    minus = "-" if keep_sign else ""
    sign = F.when(amount >= 0, "+" if plus else "").otherwise(minus)
    return F.concat(sign, F.lit("$"), F.format_number(F.abs(amount), 2))


def account_label(account_id) -> Column:
    """``ACC-0007``: padded to four digits, longer ids are never cut."""
    text = _c(account_id).cast("string")
    return F.concat(F.lit("ACC-"), F.lpad(text, F.greatest(F.lit(4), F.length(text)), F.lit("0")))


def clock_text(ts) -> Column:
    """Time of day with milliseconds; blank for null."""
    return F.coalesce(F.date_format(_c(ts), "HH:mm:ss.SSS"), F.lit(""))


def amount_class(amount) -> Column:
    return F.when(_c(amount) >= 0, "credit").otherwise("debit")


def txn_group(txn_type) -> Column:
    """Display group of a transaction type."""
    txn_type = _c(txn_type)
    return (
        F.when(txn_type.isin("DEPOSIT", "TRANSFER_IN"), "credit")
        .when(txn_type.isin("DEBIT", "WITHDRAWAL"), "debit")
        .when(txn_type == "TRANSFER_OUT", "transfer-out")
        .when(txn_type == "FEE", "fee")
        .when(txn_type == "INTEREST", "interest")
        .otherwise("other")
    )


def is_active(status) -> Column:
    return F.coalesce(_c(status) == "ACTIVE", F.lit(False))
