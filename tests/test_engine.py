import pytest
from pyspark.sql import functions as F

from twintongue.errors import AlreadyExists, ConstraintViolation, EngineError, ParseError, TransactionError, TriggerAbort, UnknownName
from twintongue.plans.engine import Done, Engine
from twintongue.plans.text import statements
from twintongue.sources import files
from twintongue.streaming.inserts import stream_into


def fill(engine, script):
    for s in statements(script):
        engine.sql(s)


def test_values_and_results(engine, rows):
    fill(engine, "CREATE TABLE t (id INT, val INT, name TEXT)")
    assert engine.sql("INSERT INTO t VALUES (1, 10, 'alice'), (2, 20, 'it''s; fine'), (3, 30, NULL)") == Done("INSERT", 3)
    assert rows(engine.sql("SELECT id FROM t WHERE val > 10 AND (name IS NULL OR name LIKE '%fine')")) == [(2,), (3,)]
    assert engine.sql("UPDATE t SET val = val + 1, id = val WHERE id = 1") == Done("UPDATE", 1)
    assert rows(engine.sql("SELECT id, val FROM t WHERE name = 'alice'")) == [(10, 11)]
    assert engine.sql("DELETE FROM t WHERE val IS NULL") == Done("DELETE", 0)
    assert engine.sql("DELETE FROM t") == Done("DELETE", 3)
    assert rows(engine.sql("SELECT count(*), sum(val) FROM t")) == [(0, None)]


def test_repeated_rows_stay_apart(engine, rows):
    fill(engine, "CREATE TABLE d (a INT, b INT); INSERT INTO d VALUES (1, 1), (1, 1), (2, 2); DELETE FROM d WHERE a = 2; UPDATE d SET b = 5")
    assert rows(engine.sql("SELECT * FROM d")) == [(1, 5), (1, 5)]


def test_a_failed_statement_changes_nothing(engine, rows):
    fill(engine, "CREATE TABLE p (id INT PRIMARY KEY, v TEXT UNIQUE); INSERT INTO p VALUES (1, 'a'), (2, NULL), (3, NULL)")
    for bad in ("INSERT INTO p VALUES (4, 'b'), (1, 'c')", "INSERT INTO p VALUES (5, 'a')", "UPDATE p SET id = 9", "INSERT INTO p VALUES (NULL, 'z')", "UPDATE p SET v = 'a' WHERE id > 1"):
        with pytest.raises(ConstraintViolation):
            engine.sql(bad)
    assert rows(engine.sql("SELECT id FROM p")) == [(1,), (2,), (3,)]
    assert engine.sql("UPDATE p SET id = id + 1").rows == 3


def test_table_level_keys_and_self_reference(engine, rows):
    fill(engine, "CREATE TABLE n (id INT, up INT, PRIMARY KEY (id), FOREIGN KEY (up) REFERENCES n (id) ON DELETE CASCADE)")
    fill(engine, "INSERT INTO n VALUES (1, NULL), (2, 1); INSERT INTO n VALUES (3, 2), (4, 3), (5, NULL); DELETE FROM n WHERE id = 2")
    with pytest.raises(ConstraintViolation):
        engine.sql("INSERT INTO n VALUES (7, 8)")
    assert rows(engine.sql("SELECT id FROM n")) == [(1,), (5,)]


def test_errors(engine):
    engine.sql("CREATE TABLE t (a INT)")
    for text, error in (
        ("CREATE TABLE t (a INT)", AlreadyExists), ("DROP TABLE nothing", UnknownName), ("INSERT INTO nothing VALUES (1)", UnknownName), ("INSERT INTO t VALUES (1, 2)", ParseError), ("CREATE TABLE u (a BLOB)", ParseError),
        ("ALTER TABLE t DROP COLUMN b", UnknownName), ("COMMIT", TransactionError), ("ROLLBACK", TransactionError), ("SAVEPOINT s", TransactionError), ("CALL nothing()", UnknownName), ("UPDATE t SET b = 1", UnknownName),
        ("NONSENSE", ParseError), ("SELECT 1; SELECT 2", ParseError), ("CREATE TRIGGER x BEFORE INSERT ON t EXECUTE FUNCTION none()", UnknownName), ("RELEASE s", EngineError), ("CREATE TABLE t2 (a INT) garbage", ParseError),
    ):
        with pytest.raises(error):
            engine.sql(text)
    engine.sql("CREATE PROCEDURE p (x INT) AS BEGIN INSERT INTO t VALUES (x) END")
    with pytest.raises(ParseError):
        engine.sql("CALL p (1, 2)")


def test_transactions_restore_definitions(engine, rows):
    fill(engine, "CREATE TABLE t (a INT); BEGIN; CREATE TABLE u (a INT); INSERT INTO t VALUES (1); CREATE TRIGGER x BEFORE INSERT ON t FOR EACH ROW RAISE ERROR 'no'; ROLLBACK; INSERT INTO t VALUES (2)")
    assert rows(engine.sql("SELECT * FROM t")) == [(2,)]
    with pytest.raises(UnknownName):
        engine.table("u")


def test_trigger_excluding_old_and_python(engine, rows):
    fill(engine, "CREATE TABLE t (id INT, v INT); INSERT INTO t VALUES (1, 1), (2, 2)")
    fill(engine, "CREATE FUNCTION once() RETURNS TRIGGER AS 'IF EXISTS EXCLUDING OLD (SELECT 1 FROM t WHERE id = NEW.id) THEN RAISE ERROR ''twice''' LANGUAGE sql; CREATE TRIGGER o BEFORE UPDATE ON t EXECUTE FUNCTION once()")
    assert engine.sql("UPDATE t SET id = 1, v = 9 WHERE id = 1").rows == 1
    with pytest.raises(TriggerAbort, match="twice"):
        engine.sql("UPDATE t SET id = 2 WHERE id = 1")
    engine.register_trigger("double", lambda batch: batch.withColumn("n_v", batch.n_v * 2))
    engine.sql("CREATE TRIGGER d BEFORE INSERT ON t EXECUTE FUNCTION double()")
    engine.sql("INSERT INTO t VALUES (7, 7)")
    assert rows(engine.sql("SELECT v FROM t WHERE id = 7")) == [(14,)]
    engine.sql("DROP TRIGGER d")
    engine.sql("INSERT INTO t VALUES (8, 8)")
    assert rows(engine.sql("SELECT v FROM t WHERE id = 8")) == [(8,)]


def test_recursion_as_set_and_bag(engine, rows):
    fill(engine, "CREATE TABLE e (a INT, b INT); INSERT INTO e VALUES (1, 2), (2, 3), (3, 1), (3, 4)")
    assert engine.sql("WITH RECURSIVE r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT * FROM r").count() == 12
    assert rows(engine.sql("WITH RECURSIVE n AS (SELECT 1 AS k UNION ALL SELECT k + 1 FROM n WHERE k < 4), m AS (SELECT k * 10 AS t FROM n) SELECT sum(t) FROM m")) == [(100,)]
    engine.most_rounds = 4
    with pytest.raises(EngineError):
        engine.sql("WITH RECURSIVE n AS (SELECT 1 AS k UNION ALL SELECT k + 1 FROM n) SELECT * FROM n").count()


def test_script_and_views(engine, rows):
    results = engine.run_script("""
-- @sql
CREATE TABLE edge (src INT, dst INT);
INSERT INTO edge VALUES (1, 2), (2, 3);
-- @datalog
-- a comment
path(X, Y) :- edge(X, Y).
path(X, Z) :- path(X, Y), edge(Y, Z).
?- path(1, X).
-- @sql
CREATE VIEW far (a, b) AS SELECT col0, col1 FROM path WHERE col1 - col0 > 1;
SELECT * FROM far;
""")
    assert rows(results[2]) == [(2,), (3,)] and rows(results[-1]) == [(1, 3)]


def test_files(engine, spark, rows, tmp_path):
    (tmp_path / "in.csv").write_text("int,float,bool,text,none\n42,3.14,true,hello,\n7,,false,,\n")
    df = files.read_csv(spark, str(tmp_path / "in.csv"))
    assert rows(df) == [(42, 3.14, True, "hello", None), (7, None, False, None, None)]
    assert rows(files.read_csv(spark, str(tmp_path / "in.csv"), header=False).select("col0")) == [("42",), ("7",), ("int",)]
    (tmp_path / "in.json").write_text('[{"b": 1, "a": "x", "n": {"k": 1}, "l": [1]}, {"a": "y", "c": 5}]')
    got = files.read_json(spark, str(tmp_path / "in.json"))
    assert got.columns == ["b", "a", "n", "l"] and rows(got) == [(1, "x", None, None), (None, "y", None, None)]
    engine.sql("CREATE TABLE t (a TEXT, b INT DEFAULT 3, k INT)")
    files.import_table(engine, "t", got.select("a", "l"))
    assert rows(engine.sql("SELECT * FROM t")) == [("x", 3, None), ("y", 3, None)]
    files.export_table(engine, "t", str(tmp_path / "out"), "json")
    assert '{"a":"x","b":3,"k":null}' in "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))


def test_stream(engine, spark, rows, tmp_path):
    spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long").write.parquet(str(tmp_path / "in"))
    engine.sql("CREATE TABLE edge (src INT PRIMARY KEY, dst INT)")
    stream = spark.readStream.schema("src long, dst long").parquet(str(tmp_path / "in"))
    q = stream_into(engine, stream, "edge", str(tmp_path / "ck"), program="path(X, Y) :- edge(X, Y). path(X, Z) :- path(X, Y), edge(Y, Z).")
    q.awaitTermination()
    assert rows(engine.sql("SELECT * FROM path")) == [(1, 2), (1, 3), (2, 3)]
    refused = []
    spark.createDataFrame([(1, 9)], "src long, dst long").write.mode("append").parquet(str(tmp_path / "in"))
    stream_into(engine, stream, "edge", str(tmp_path / "ck2"), rejected=lambda batch, e: refused.append(str(e))).awaitTermination()
    assert refused and engine.sql("SELECT * FROM edge").count() == 2


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs_against_networks(engine, rows, seed):
    import random

    rng = random.Random(seed)
    edges = sorted({(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(rng.randint(3, 18))})
    reach = set(edges)
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in edges if b == c}
        if more == reach:
            break
        reach = more
    facts = " ".join(f"edge({a}, {b})." for a, b in edges)
    assert set(rows(engine.datalog(facts + " p(X, Y) :- edge(X, Y). p(X, Z) :- p(X, Y), p(Y, Z). ?- p(X, Y)."))) == reach
    apart = {(a, b) for a, _ in edges for _, b in edges if (a, b) not in reach}
    assert set(rows(engine.datalog("from(X) :- edge(X, _). to(Y) :- edge(_, Y). q(X, Y) :- from(X), to(Y), not p(X, Y). ?- q(X, Y)."))) == apart


def test_names_end_with_their_tables(spark):
    spark.range(3).createOrReplaceTempView("mine")
    e, other = Engine(spark), Engine(spark)
    e.sql("CREATE TABLE mine (a INT)")
    e.sql("INSERT INTO mine VALUES (7)")
    assert [r.a for r in e.sql("SELECT a FROM mine").collect()] == [7]
    assert spark.table("mine").count() == 3
    spark.catalog.dropTempView("mine")
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        other.sql("SELECT a FROM mine")
    e.sql("BEGIN")
    e.sql("CREATE TABLE gone (a INT)")
    e.sql("SELECT * FROM gone").collect()
    e.sql("ROLLBACK")
    e.sql("DROP TABLE mine")
    for name in ("mine", "gone"):
        with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
            e.sql(f"SELECT * FROM {name}")


def test_cached_frames_stay_cached(spark):
    df = spark.range(5).withColumn("b", F.col("id") * 3).cache()
    e = Engine(spark).register("cached_rows", df)
    assert e.sql("SELECT max(b) AS m FROM cached_rows").first().m == 12
    assert df.storageLevel.useMemory and spark._jsparkSession.sharedState().cacheManager().lookupCachedData(df._jdf).isDefined()
    df.unpersist()


def test_the_dialect_in_statements(spark):
    e = Engine(spark)
    e.sql("CREATE TABLE t (a INT, b INT, s VARCHAR)")
    e.sql("INSERT INTO t VALUES (7, 2, ' x '), (-7, 0, NULL)")
    got = e.sql("SELECT a, a / b AS q, a % b AS m, a / 2.0 AS f, concat('<', s, '>') AS c, trim(s) AS u FROM t ORDER BY a DESC").collect()
    assert [tuple(r) for r in got] == [(7, 3, 1, 3.5, "< x >", "x"), (-7, None, None, -3.5, "<>", None)]
    got = e.sql("""SELECT json_extract('{"k": [1, 2]}', 'k') AS x, json_type('{"k": 1}', '$.k') AS y, json_valid('{') AS z, 7 / 2 AS w""").first()
    assert tuple(got) == ("[1,2]", "number", False, 3)


def test_subqueries_in_changes(spark):
    e = Engine(spark)
    for text in ("CREATE TABLE t (id INT, v INT)", "CREATE TABLE o (k INT, w INT)", "INSERT INTO t VALUES (1, 10), (2, 20), (3, 30)", "INSERT INTO o VALUES (1, 5), (3, 9)"):
        e.sql(text)
    assert e.sql("UPDATE t SET v = v / 4 + (SELECT max(w) FROM o) WHERE id IN (SELECT k FROM o)").rows == 2
    assert sorted(map(tuple, e.table("t").collect())) == [(1, 11), (2, 20), (3, 16)]
    assert e.sql("DELETE FROM t WHERE EXISTS (SELECT 1 FROM o WHERE o.k = t.id AND w > 5)").rows == 1
    assert sorted(r.id for r in e.table("t").collect()) == [1, 2]


def test_changes_leave_other_rows(engine, rows):
    engine.sql("CREATE TABLE left_alone (id INT, v INT)")
    engine.sql("INSERT INTO left_alone VALUES (1, 5), (1, 5), (2, NULL), (3, 9), (3, 9)")
    engine.sql("DELETE FROM left_alone WHERE v > 6")
    assert rows(engine.sql("SELECT id, v FROM left_alone ORDER BY id")) == [(1, 5), (1, 5), (2, None)]
    engine.sql("UPDATE left_alone SET v = 7 WHERE v = 5 AND rand() >= 0")
    assert rows(engine.sql("SELECT id, v FROM left_alone ORDER BY id")) == [(1, 7), (1, 7), (2, None)]
    engine.sql("DELETE FROM left_alone WHERE v < (SELECT max(v) + 1 FROM left_alone)")
    assert rows(engine.sql("SELECT id, v FROM left_alone")) == [(2, None)]
