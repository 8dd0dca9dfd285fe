from dataclasses import dataclass

import pytest

from docloom import dbapi


@dataclass
class Person:
    k: int
    name: str


@pytest.fixture
def path(spark, tmp_path):
    with dbapi.connect(spark, str(tmp_path)) as c:
        cur = c.cursor()
        cur.execute("CREATE TABLE t (k BIGINT NOT NULL UNIQUE, name VARCHAR)")
        assert cur.executemany("INSERT INTO t (k, name) VALUES (?, ?)", [(1, "Ann"), (2, "Bob"), (3, "Cid")]).rowcount == 3
    return str(tmp_path)


def test_cursors(spark, path):
    c = dbapi.connect(spark, path)
    cur = c.cursor().execute("SELECT k, name FROM t WHERE k >= ? ORDER BY k", [1])
    assert [d[:2] for d in cur.description] == [("k", "bigint"), ("name", "string")]
    assert cur.fetchone() == (1, "Ann") and cur.fetchmany(1) == [(2, "Bob")] and list(cur) == [(3, "Cid")] and cur.fetchone() is None
    assert list(cur.execute("SELECT k, name FROM t WHERE k < 3 ORDER BY k").typed(Person)) == [Person(1, "Ann"), Person(2, "Bob")]
    cur.execute("UPDATE t SET name = 'x' WHERE k > 1 RETURNING name")
    assert cur.rowcount == 2 and cur.fetchall() == [("x",), ("x",)]
    assert cur.execute("DELETE FROM t WHERE k = 3").rowcount == 1
    with pytest.raises(dbapi.InterfaceError):
        cur.fetchone()
    assert ("t", "COLLECTION") in c.tables() and ("k", "bigint", False) in c.columns("t")
    assert len(c.engine.collection("t").store.commits) == 3  # the inserts were one transaction


def test_errors(spark, path):
    cur = dbapi.connect(spark, path).cursor()
    for text, error in (("SELEC", dbapi.ProgrammingError), ("SELECT nope.x FROM nowhere.at AT VERSION 'v'", dbapi.DatabaseError), ("INSERT INTO t (k) VALUES (1)", dbapi.IntegrityError), ("SELECT k FROM t AT VERSION 'none'", dbapi.DatabaseError)):
        with pytest.raises(error):
            cur.execute(text)


def test_transactions(spark, path):
    one, two = dbapi.connect(spark, path, autocommit=False), dbapi.connect(spark, path)
    count = lambda c: c.cursor().execute("SELECT COUNT(*) FROM t").fetchone()[0]
    one.cursor().execute("DELETE FROM t WHERE k = 1")
    assert (count(one), count(two)) == (2, 3)
    one.rollback()
    assert count(one) == 3
    one.cursor().execute("DELETE FROM t WHERE k = 1")
    two.cursor().execute("UPDATE t SET name = 'y' WHERE k = 1")
    with pytest.raises(dbapi.OperationalError):
        one.commit()
    one.close()
    with pytest.raises(dbapi.InterfaceError):
        one.cursor()
