"""The engine through Python's database API (PEP 249): connections, cursors, transactions, and what tables and columns there are."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from docloom.operators.access import AccessError
from docloom.plans.syntax import SqlError
from docloom.session import BoundError, ConflictError, ConstraintError, Engine, Written

apilevel, threadsafety, paramstyle = "2.0", 1, "qmark"


class Error(Exception):
    """Whatever goes wrong below."""


class InterfaceError(Error):
    """A cursor or connection used in a wrong state."""


class DatabaseError(Error):
    """An error of the engine."""


class ProgrammingError(DatabaseError):
    """A statement that is wrong, or that the user may not run."""


class IntegrityError(DatabaseError):
    """Documents that break a schema or a unique constraint."""


class OperationalError(DatabaseError):
    """Another writer was first, or Spark failed."""


# The errors of the engine, the narrower ones first.
KINDS = [((SqlError, AccessError), ProgrammingError), ((ConstraintError,), IntegrityError), ((ConflictError, BoundError, PySparkException), OperationalError), ((ValueError,), DatabaseError)]


def connect(spark: SparkSession, path: str | None = None, *, autocommit: bool = True, **options: Any) -> Connection:
    """options are those of Engine, such as user and password."""
    return Connection(_run(lambda: Engine(spark, path, **options)), autocommit)


def _run(do):
    try:
        return do()
    except tuple(k for kinds, _ in KINDS for k in kinds) as x:
        raise next(error for kinds, error in KINDS if isinstance(x, kinds))(str(x)) from x


class Connection:
    """Without autocommit, the first statement opens a transaction, which commit() or rollback() ends."""

    def __init__(self, engine: Engine, autocommit: bool = True):
        self.engine, self.autocommit, self.open = engine, autocommit, True

    def cursor(self) -> Cursor:
        if not self.open:
            raise InterfaceError("the connection is closed")
        return Cursor(self)

    def commit(self) -> None:
        if self.engine.pending is not None:
            _run(lambda: self.engine.transaction("COMMIT"))

    def rollback(self) -> None:
        if self.engine.pending is not None:
            self.engine.transaction("ROLLBACK")

    def close(self) -> None:
        self.rollback()
        self.open = False

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, kind, *_) -> None:
        self.rollback() if kind else self.commit()

    def tables(self) -> list[tuple[str, str]]:
        """(name, kind) of what can be queried: TABLE (registered rows), COLLECTION or VIEW."""
        e = self.engine
        kept = [n for n in (e.rights.log.files.names(e.path) if e.path else []) if not n.startswith("_")]
        return sorted({(n, "COLLECTION") for n in kept} | {(n, "COLLECTION" if c.store else "TABLE") for n, c in e.collections.items()} | {(n, "VIEW") for n in e.views})

    def columns(self, table: str) -> list[tuple[str, str, bool]]:
        """(name, type, whether it may be null), id and document columns included."""
        c = self.engine.collections.get(table)
        required = {f.name for f in c.schema.fields if f.required} if c else set()
        schema = _run(lambda: self.engine.sql(f"SELECT * FROM {table}")).schema
        return [(f.name, f.dataType.simpleString(), f.name not in required) for f in schema]


class Cursor:
    """Rows come from Spark a partition at a time, so a large result does not have to fit the driver."""

    arraysize = 100

    def __init__(self, connection: Connection):
        self.connection, self.rowcount, self.description, self._rows = connection, -1, None, None

    def execute(self, text: str, parameters: Sequence = ()) -> Cursor:
        e = self.connection.engine
        if not self.connection.open:
            raise InterfaceError("the connection is closed")
        if not self.connection.autocommit and e.pending is None:
            e.transaction("BEGIN")
        out = _run(lambda: e.sql(text, parameters))
        self.rowcount, self.description, self._rows = -1, None, None
        if isinstance(out, Written):
            self.rowcount, out = out.rows, out.returned
        if isinstance(out, DataFrame):
            self.description = [(f.name, f.dataType.simpleString(), None, None, None, None, f.nullable) for f in out.schema]
            self._rows = _run(out.toLocalIterator)
        return self

    def executemany(self, text: str, sets: Sequence[Sequence]) -> Cursor:
        """The statement for each set of parameters, in one transaction."""
        own = self.connection.engine.pending is None
        if own:
            self.connection.engine.transaction("BEGIN")
        try:
            n = sum(self.execute(text, p).rowcount for p in sets)
        except Error:
            if own:
                self.connection.rollback()
            raise
        if own and self.connection.autocommit:
            self.connection.commit()
        self.rowcount = n
        return self

    def _next(self, n: int | None) -> list[tuple]:
        if self._rows is None:
            raise InterfaceError("there is no result")
        return _run(lambda: [tuple(r) for r in islice(self._rows, n)])

    def fetchone(self) -> tuple | None:
        return next(iter(self._next(1)), None)

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        return self._next(size or self.arraysize)

    def fetchall(self) -> list[tuple]:
        return self._next(None)

    def typed(self, kind: type) -> Iterator[Any]:
        """The rest of the rows as objects of a class whose arguments are named like the columns."""
        names = [d[0] for d in self.description or ()]
        while rows := self._next(self.arraysize):
            yield from (kind(**dict(zip(names, r))) for r in rows)

    def __iter__(self) -> Iterator[tuple]:
        return iter(self.fetchone, None)

    def close(self) -> None:
        self._rows = None

    def setinputsizes(self, sizes: Sequence) -> None:
        """Nothing to do: types come from the values."""

    def setoutputsize(self, size: int, column: int | None = None) -> None:
        """Nothing to do."""
