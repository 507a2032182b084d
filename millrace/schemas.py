"""Table contracts: column types, keys, domains, lengths and insert defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
NTZ = T.TimestampNTZType()
TEXT = T.StringType()
ID = T.LongType()

# The allowed codes of the three coded columns.
ACCOUNT_TYPES = ("CHECKING", "SAVINGS", "LOAN", "MONEY_MARKET")
ACCOUNT_STATUSES = ("ACTIVE", "FROZEN", "CLOSED")
TXN_TYPES = ("DEBIT", "DEPOSIT", "WITHDRAWAL", "TRANSFER_IN", "TRANSFER_OUT", "FEE", "INTEREST")

# Transaction types that take money out of an account, and
# account types that may not go below zero.
OUTGOING_TYPES = ("DEBIT", "WITHDRAWAL", "FEE", "TRANSFER_OUT")
DEPOSIT_ACCOUNT_TYPES = ("CHECKING", "SAVINGS", "MONEY_MARKET")

MEMBER_KEYS = ("ssn_last4", "last_name")
MEMBER_ATTRIBUTES = ("first_name", "email", "phone", "street", "city", "state", "zip")


@dataclass(frozen=True)
class Contract:
    """What a table promises. Spark's Parquet catalog has no constraints, so
    ``operators.quality`` checks them as queries."""

    name: str
    schema: T.StructType
    primary_key: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    max_length: dict[str, int] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)


def _struct(*columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


_PROFILE_LENGTHS = {
    "first_name": 50, "last_name": 50, "email": 100, "phone": 20,
    "street": 100, "city": 50, "state": 2, "zip": 10,
}

CUSTOMERS = Contract(
    "customers",
    _struct(
        ("customer_id", ID), ("ssn_last4", TEXT), ("first_name", TEXT), ("last_name", TEXT),
        ("email", TEXT), ("phone", TEXT), ("street", TEXT), ("city", TEXT), ("state", TEXT),
        ("zip", TEXT), ("updated_at", NTZ),
    ),
    primary_key=("customer_id",),
    not_null=("customer_id", "ssn_last4", "first_name", "last_name", "email"),
    max_length={"ssn_last4": 4, **_PROFILE_LENGTHS},
)

ACCOUNTS = Contract(
    "accounts",
    _struct(
        ("account_id", ID), ("customer_id", ID), ("account_type", TEXT), ("balance", MONEY),
        ("status", TEXT), ("updated_at", NTZ), ("source_updated_at", NTZ),
    ),
    primary_key=("account_id",),
    not_null=("account_id", "customer_id", "account_type", "balance", "status"),
    domains={"account_type": ACCOUNT_TYPES, "status": ACCOUNT_STATUSES},
    max_length={"account_type": 20, "status": 10},
    defaults={"balance": "0.00", "status": "ACTIVE"},
)

TRANSACTIONS = Contract(
    "transactions",
    _struct(
        ("txn_id", ID), ("account_id", ID), ("txn_type", TEXT), ("amount", MONEY),
        ("description", TEXT), ("merchant", TEXT), ("balance_after", MONEY),
        ("txn_ts", NTZ), ("source_write_ts", NTZ),
    ),
    primary_key=("txn_id",),
    not_null=("txn_id", "account_id", "txn_type", "amount", "balance_after"),
    domains={"txn_type": TXN_TYPES},
    max_length={"txn_type": 20, "description": 200, "merchant": 100},
)

LANDING = Contract(
    "transactions_landing",
    T.StructType(TRANSACTIONS.schema.fields + [T.StructField("ingest_ts", NTZ)]),
)

MEMBER_UPDATES = Contract(
    "member_updates",
    _struct(
        ("update_id", ID), ("ssn_last4", TEXT), ("last_name", TEXT),
        *[(c, TEXT) for c in MEMBER_ATTRIBUTES],
        ("operation", TEXT), ("source_ts", NTZ), ("updated_at", NTZ),
    ),
    primary_key=("update_id",),
    not_null=("update_id", "ssn_last4", "last_name", "operation"),
    max_length={"ssn_last4": 4, **_PROFILE_LENGTHS, "operation": 10},
    defaults={"operation": "upsert"},
)

CUSTOMERS_CURRENT = Contract(
    "customers_current",
    _struct(
        ("customer_id", ID), ("first_name", TEXT), ("last_name", TEXT), ("email", TEXT),
        ("phone", TEXT), ("street", TEXT), ("city", TEXT), ("state", TEXT), ("zip", TEXT),
        ("updated_at", NTZ), ("source_updated_at", NTZ),
    ),
    primary_key=("customer_id",),
    not_null=("customer_id",),
    max_length=_PROFILE_LENGTHS,
)

MEMBERS = Contract(
    "members",
    _struct(
        ("member_id", ID), ("ssn_last4", TEXT), ("last_name", TEXT),
        *[(c, TEXT) for c in MEMBER_ATTRIBUTES],
        ("source_system", TEXT), ("updated_at", NTZ), ("source_updated_at", NTZ),
    ),
    primary_key=("member_id",),
    not_null=("member_id", "ssn_last4", "last_name"),
    max_length={"ssn_last4": 4, **_PROFILE_LENGTHS, "source_system": 30},
    defaults={"source_system": "CORE"},
)

CONTRACTS = {
    c.name: c
    for c in (CUSTOMERS, ACCOUNTS, TRANSACTIONS, LANDING, MEMBER_UPDATES, CUSTOMERS_CURRENT, MEMBERS)
}
