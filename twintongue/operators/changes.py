"""Definitions, changes, constraints, triggers, procedures and transactions as queries.

Each runs a script on small tables made from region and nation and returns the final
state, which the oracle states as a SELECT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..errors import ConstraintViolation, EngineError, TriggerAbort, TriggerDepth
from ..plans.text import statements
from .base import engine_on

MAKE = "CREATE TABLE t (id INT PRIMARY KEY, name TEXT, grp INT); INSERT INTO t SELECT n_nationkey, n_name, n_regionkey FROM nation; "
STATE = "SELECT id, name, grp FROM t"
_NATION = "CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS grp FROM nation"


def _script(text: str, refused: tuple[str, type[EngineError]] | None = None):
    """The result of the last statement; refused: a statement before it that must fail, and how."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = engine_on(spark, sf_dir, "nation", "region")
        *before, last = statements(text)
        for s in before:
            engine.sql(s)
        if refused:
            try:
                engine.sql(refused[0])
            except refused[1]:
                pass
            else:
                raise AssertionError(f"not refused: {refused[0]}")
        return engine.sql(last)

    return run


DEPTS = """CREATE TABLE dept (id INT PRIMARY KEY, name TEXT); INSERT INTO dept SELECT r_regionkey, r_name FROM region;
CREATE TABLE emp (id INT PRIMARY KEY, dept_id INT {default} REFERENCES dept(id) {actions}, name TEXT); INSERT INTO emp SELECT n_nationkey, n_regionkey, n_name FROM nation; """
EMP = "SELECT id, dept_id, name FROM emp"
_EMP = "SELECT CAST(n_nationkey AS BIGINT) AS id, {dept} AS dept_id, n_name AS name FROM nation"


def _depts(actions: str, default: str = "") -> str:
    return DEPTS.format(actions=actions, default=default)


LOG = "CREATE TABLE log (what TEXT, id INT); "


def procedure_call(spark, sf_dir):
    engine = engine_on(spark, sf_dir, "nation")
    engine.sql("CREATE TABLE rec (id INT, name TEXT)")
    engine.sql("CREATE PROCEDURE add_rec (rec_id INT, rec_name TEXT) AS BEGIN INSERT INTO rec (id, name) VALUES (rec_id, rec_name); UPDATE rec SET name = upper(name) WHERE id = rec_id END")
    engine.sql("CALL add_rec (1, 'alice')")
    engine.sql("EXEC add_rec (2, 'bob')")
    return engine.sql("SELECT id, name FROM rec")


def procedure_select(spark, sf_dir):
    engine = engine_on(spark, sf_dir, "nation")
    engine.sql("CREATE PROCEDURE of_region (r INT) AS BEGIN SELECT n_name FROM nation WHERE n_regionkey = r END")
    return engine.sql("CALL of_region (2)")


def dropped(spark, sf_dir):
    """Everything that can be dropped, dropped; then each use is an error."""
    engine = engine_on(spark, sf_dir, "nation")
    made = {
        "TABLE": ("CREATE TABLE x (a INT)", "SELECT * FROM x"), "VIEW": ("CREATE VIEW v AS SELECT 1 AS a", "DROP VIEW v"), "INDEX": ("CREATE INDEX i ON nation (n_name)", "DROP INDEX i"),
        "FUNCTION": ("CREATE FUNCTION f() RETURNS TRIGGER AS 'RETURN NEW' LANGUAGE sql", "DROP FUNCTION f"), "PROCEDURE": ("CREATE PROCEDURE p AS BEGIN SELECT 1 AS a END", "CALL p"),
    }
    rows = []
    for kind, (create, use) in made.items():
        engine.sql(create)
        engine.sql(f"DROP {kind} {create.split()[2].rstrip('()')}")
        try:
            engine.sql(use)
            rows.append((kind, False))
        except Exception:  # noqa: BLE001  an analysis error of Spark's for the table
            rows.append((kind, True))
    return spark.createDataFrame(rows, "kind string, gone boolean")


def trigger_depth(spark, sf_dir):
    engine = engine_on(spark, sf_dir)
    for k in range(6):
        engine.sql(f"CREATE TABLE c{k} (id INT)")
    for k in range(5):
        engine.sql(f"CREATE FUNCTION f{k}() RETURNS TRIGGER AS 'INSERT INTO c{k + 1} VALUES (NEW.id)' LANGUAGE sql")
        engine.sql(f"CREATE TRIGGER g{k} AFTER INSERT ON c{k} EXECUTE FUNCTION f{k}()")
    try:
        engine.sql("INSERT INTO c0 VALUES (1)")
        got = False
    except TriggerDepth:
        got = True
    return spark.createDataFrame([(got, engine.table("c0").count())], "refused boolean, n long")


#: key: (query, oracle SQL)
QUERIES = {
    "insert_values": (_script(MAKE + "INSERT INTO t VALUES (100, 'a', 1), (101, NULL, 2); INSERT INTO t (name, id) VALUES ('b', 102);" + STATE), f"SELECT {_NATION} UNION ALL SELECT * FROM (VALUES (100, 'a', 1), (101, NULL, 2), (102, 'b', NULL)) x"),
    "update": (_script(MAKE + "UPDATE t SET grp = grp + 10, name = lower(name) WHERE id >= 20; UPDATE t SET grp = id, id = id + 1000 WHERE id = 3;" + STATE), "SELECT CASE WHEN n_nationkey = 3 THEN 1003 ELSE n_nationkey END::BIGINT AS id, CASE WHEN n_nationkey >= 20 THEN lower(n_name) ELSE n_name END AS name, CASE WHEN n_nationkey >= 20 THEN n_regionkey + 10 WHEN n_nationkey = 3 THEN 3 ELSE n_regionkey END::BIGINT AS grp FROM nation"),
    "delete": (_script(MAKE + "DELETE FROM t WHERE grp = 2 OR name IS NULL;" + STATE), f"SELECT {_NATION} WHERE n_regionkey <> 2"),
    "create_table": (_script("CREATE TABLE k (a INT, b FLOAT, c TEXT DEFAULT 'd', e BOOL, f DATE, g TIME, h TIMESTAMP, i VARCHAR); INSERT INTO k (a, b, e, f, g) VALUES (1, 2, TRUE, DATE '2024-01-31', '12:30:00'); SELECT a, b, c, e, CAST(f AS STRING) AS f, g, h IS NULL AS h, i FROM k"), "SELECT CAST(1 AS BIGINT) AS a, CAST(2 AS DOUBLE) AS b, 'd' AS c, TRUE AS e, '2024-01-31' AS f, '12:30:00' AS g, TRUE AS h, CAST(NULL AS VARCHAR) AS i"),
    "drop_table": (dropped, "SELECT kind, TRUE AS gone FROM (VALUES ('TABLE'), ('VIEW'), ('INDEX'), ('FUNCTION'), ('PROCEDURE')) x(kind)"),
    "alter_add": (_script(MAKE + "ALTER TABLE t ADD COLUMN score INT DEFAULT 7; INSERT INTO t (id) VALUES (200); SELECT id, score FROM t"), "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(7 AS BIGINT) AS score FROM nation UNION ALL SELECT 200, 7"),
    "alter_drop": (_script(MAKE + "ALTER TABLE t DROP COLUMN grp; SELECT * FROM t"), "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation"),
    "alter_rename_col": (_script(MAKE + "ALTER TABLE t RENAME COLUMN grp TO region; SELECT id, region FROM t"), "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS region FROM nation"),
    "alter_rename_table": (_script(MAKE + "ALTER TABLE t RENAME TO u; SELECT id, name FROM u"), "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation"),
    "create_index": (_script(MAKE + "CREATE INDEX i ON t (name, grp); DROP INDEX i; CREATE INDEX i ON t (grp); SELECT id FROM t WHERE grp = 1"), "SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation WHERE n_regionkey = 1"),
    "create_view": (_script("CREATE VIEW v (k, label) AS SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1; CREATE VIEW w AS SELECT k FROM v WHERE k > 2; SELECT v.k, v.label FROM v JOIN w ON v.k = w.k"), "SELECT n_nationkey AS k, n_name AS label FROM nation WHERE n_regionkey = 1 AND n_nationkey > 2"),
    "scan_view": (_script("CREATE VIEW v AS SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey; SELECT * FROM v WHERE n > 1"), "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey HAVING count(*) > 1"),
    "drop_view": (_script("CREATE VIEW v AS SELECT 1 AS a; DROP VIEW v; CREATE VIEW v AS SELECT 2 AS a; SELECT a FROM v"), "SELECT 2 AS a"),
    "uniq_check": (_script(MAKE + STATE, ("INSERT INTO t VALUES (300, 'x', 1), (300, 'y', 2)", ConstraintViolation)), f"SELECT {_NATION}"),
    "uniq_check_existing": (_script(MAKE + STATE, ("INSERT INTO t VALUES (500, 'new', 1), (3, 'old', 2)", ConstraintViolation)), f"SELECT {_NATION}"),
    "not_null_check": (_script(MAKE + STATE, ("INSERT INTO t VALUES (NULL, 'x', 1)", ConstraintViolation)), f"SELECT {_NATION}"),
    "fk_check": (_script(_depts("") + EMP, ("INSERT INTO emp VALUES (900, 77, 'nobody')", ConstraintViolation)), _EMP.format(dept="CAST(n_regionkey AS BIGINT)")),
    "fk_on_delete": (_script(_depts("ON DELETE CASCADE") + "DELETE FROM dept WHERE id = 2;" + EMP), _EMP.format(dept="CAST(n_regionkey AS BIGINT)") + " WHERE n_regionkey <> 2"),
    "fk_set_null": (_script(_depts("ON DELETE SET NULL") + "DELETE FROM dept WHERE id = 2;" + EMP), _EMP.format(dept="CAST(NULLIF(n_regionkey, 2) AS BIGINT)")),
    "fk_set_default": (_script(_depts("ON DELETE SET DEFAULT", "DEFAULT 0") + "DELETE FROM dept WHERE id = 2;" + EMP), _EMP.format(dept="CAST(CASE WHEN n_regionkey = 2 THEN 0 ELSE n_regionkey END AS BIGINT)")),
    "fk_restrict": (_script(_depts("ON DELETE RESTRICT") + EMP, ("DELETE FROM dept WHERE id = 2", ConstraintViolation)), _EMP.format(dept="CAST(n_regionkey AS BIGINT)")),
    "fk_on_update": (_script(_depts("ON UPDATE CASCADE") + "UPDATE dept SET id = 50 WHERE id = 2;" + EMP), _EMP.format(dept="CAST(CASE WHEN n_regionkey = 2 THEN 50 ELSE n_regionkey END AS BIGINT)")),
    "fk_deep_cascade": (
        _script(_depts("ON DELETE CASCADE") + "CREATE TABLE task (id INT, emp_id INT REFERENCES emp(id) ON DELETE CASCADE); INSERT INTO task SELECT n_nationkey + 100, n_nationkey FROM nation; DELETE FROM dept WHERE id < 2; SELECT id, emp_id FROM task"),
        "SELECT CAST(n_nationkey + 100 AS BIGINT) AS id, CAST(n_nationkey AS BIGINT) AS emp_id FROM nation WHERE n_regionkey >= 2",
    ),
    "trigger_before": (_script(MAKE + "CREATE TRIGGER up BEFORE INSERT OR UPDATE ON t FOR EACH ROW SET name = upper(NEW.name); INSERT INTO t VALUES (400, 'low', 1); UPDATE t SET name = 'abc' WHERE id = 1;" + STATE), f"SELECT * REPLACE (CASE WHEN id = 1 THEN 'ABC' ELSE name END AS name) FROM (SELECT {_NATION}) UNION ALL SELECT 400, 'LOW', 1"),
    "trigger_inline": (_script(MAKE + "CREATE TRIGGER b_trig BEFORE INSERT ON t FOR EACH ROW SET grp = 9; CREATE TRIGGER a_trig BEFORE INSERT ON t FOR EACH ROW SET grp = 8, SET name = 'fixed'; INSERT INTO t VALUES (400, 'x', 1); SELECT * FROM t WHERE id = 400"), "SELECT CAST(400 AS BIGINT) AS id, 'fixed' AS name, CAST(9 AS BIGINT) AS grp"),
    "trigger_raise": (_script(MAKE + "CREATE TRIGGER no BEFORE DELETE ON t FOR EACH ROW RAISE ERROR 'kept';" + STATE, ("DELETE FROM t WHERE id = 1", TriggerAbort)), f"SELECT {_NATION}"),
    "trigger_after": (
        _script(MAKE + LOG + "CREATE FUNCTION note() RETURNS TRIGGER AS 'INSERT INTO log VALUES (''gone'', OLD.id); SET NEW.id = 5' LANGUAGE sql; CREATE TRIGGER n AFTER DELETE ON t EXECUTE FUNCTION note(); DELETE FROM t WHERE grp = 3; SELECT what, id FROM log".replace("; SET NEW.id = 5", "")),
        "SELECT 'gone' AS what, CAST(n_nationkey AS BIGINT) AS id FROM nation WHERE n_regionkey = 3",
    ),
    "trigger_fn": (
        _script(MAKE + LOG + "CREATE FUNCTION guard() RETURNS TRIGGER AS 'IF NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey = NEW.grp) THEN RAISE ERROR ''no region''; SET NEW.name = concat(NEW.name, ''!''); INSERT INTO log VALUES (NEW.name, NEW.id); RETURN NEW' LANGUAGE sql; CREATE TRIGGER g BEFORE INSERT ON t EXECUTE FUNCTION guard(); INSERT INTO t VALUES (600, 'ok', 1); SELECT t.id, t.name, log.what FROM t JOIN log ON t.id = log.id", ("INSERT INTO t VALUES (601, 'bad', 99)", TriggerAbort)),
        "SELECT CAST(600 AS BIGINT) AS id, 'ok!' AS name, 'ok!' AS what",
    ),
    "trigger_return_null": (_script(MAKE + "CREATE FUNCTION skip() RETURNS TRIGGER AS 'RETURN NULL' LANGUAGE sql; CREATE TRIGGER s BEFORE INSERT ON t EXECUTE FUNCTION skip(); INSERT INTO t VALUES (700, 'no', 1);" + STATE), f"SELECT {_NATION}"),
    "trigger_update_other": (
        _script(MAKE + "CREATE TABLE sums (grp INT, n INT); INSERT INTO sums SELECT n_regionkey, 0 FROM nation GROUP BY n_regionkey; CREATE FUNCTION bump() RETURNS TRIGGER AS 'UPDATE sums SET n = n + 1 WHERE sums.grp = NEW.grp; DELETE FROM sums WHERE sums.grp = 4' LANGUAGE sql; CREATE TRIGGER b AFTER INSERT ON t EXECUTE FUNCTION bump(); INSERT INTO t VALUES (800, 'x', 1); SELECT grp, n FROM sums".replace("sums.grp = NEW", "grp = NEW").replace("sums.grp = 4", "grp = 4")),
        "SELECT DISTINCT CAST(n_regionkey AS BIGINT) AS grp, CAST(CASE WHEN n_regionkey = 1 THEN 1 ELSE 0 END AS BIGINT) AS n FROM nation WHERE n_regionkey <> 4",
    ),
    "trigger_depth": (trigger_depth, "SELECT TRUE AS refused, CAST(0 AS BIGINT) AS n"),
    "procedure_call": (procedure_call, "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'ALICE'), (2, 'BOB')) x(id, name)"),
    "procedure_create": (procedure_select, "SELECT n_name FROM nation WHERE n_regionkey = 2"),
    "txn_commit": (_script(MAKE + "BEGIN; DELETE FROM t WHERE id = 0; COMMIT;" + STATE), f"SELECT {_NATION} WHERE n_nationkey <> 0"),
    "txn_rollback": (_script(MAKE + "BEGIN TRANSACTION; DELETE FROM t; INSERT INTO t VALUES (1, 'x', 1); ROLLBACK;" + STATE), f"SELECT {_NATION}"),
    "txn_begin_nested": (_script(MAKE + "BEGIN;" + STATE, ("BEGIN", EngineError)), f"SELECT {_NATION}"),
    "savepoint": (_script(MAKE + "BEGIN; DELETE FROM t WHERE id = 0; SAVEPOINT a; DELETE FROM t WHERE id = 1; SAVEPOINT b; DELETE FROM t WHERE id = 2; ROLLBACK TO a; COMMIT;" + STATE), f"SELECT {_NATION} WHERE n_nationkey <> 0"),
    "release": (_script(MAKE + "BEGIN; SAVEPOINT a; DELETE FROM t WHERE id = 0; RELEASE SAVEPOINT a; COMMIT;" + STATE), f"SELECT {_NATION} WHERE n_nationkey <> 0"),
    "rollback_to": (_script(MAKE + "BEGIN; SAVEPOINT a; DELETE FROM t; ROLLBACK TO SAVEPOINT a; DELETE FROM t WHERE id = 5; ROLLBACK TO a; COMMIT;" + STATE), f"SELECT {_NATION}"),
}
