"""Errors of the table store."""


class StoreError(ValueError):
    """A request that the catalog can't take: a duplicate name, an unknown column, an invalid definition."""


class UnknownTable(StoreError, LookupError):
    """A write, or a strict read, names a table that isn't there."""


class ConstraintError(StoreError):
    """Rows break a not-null, rule, unique or relationship constraint."""


class TransactionError(RuntimeError):
    """A transaction is begun twice, is over, or lost a race."""


class LockError(OSError):
    """Another writer holds the database."""
