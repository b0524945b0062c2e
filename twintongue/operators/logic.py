"""Datalog programs as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConstraintViolation, NotStratified, UnsafeRule
from .base import engine_on

TREE = "SELECT c_custkey AS src, c_custkey DIV 2 AS dst FROM customer WHERE c_custkey > 0"
CYCLE = "SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst FROM nation"
PATH = "path(X, Y) :- edge(X, Y). path(X, Z) :- path(X, Y), edge(Y, Z). "


def _engine(spark: SparkSession, sf_dir: str, *names: str, edge: str | None = None):
    engine = engine_on(spark, sf_dir, *names)
    return engine.register("edge", engine.sql(edge)) if edge else engine


def _answer(text: str, *names: str, columns: list[str], edge: str | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _engine(spark, sf_dir, *names, edge=edge).datalog(text).toDF(*columns)

    return run


def dl_constraint(spark, sf_dir):
    engine = _engine(spark, sf_dir, "supplier")
    try:
        engine.datalog("bad(K) :- supplier(K, _, _, B), B < 0. :- bad(K).")
        n = 0
    except ConstraintViolation as e:
        n = e.count
    return spark.createDataFrame([(n,)], "violations long")


def _refused(text: str, error: type[Exception]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = _engine(spark, sf_dir, "nation")
        try:
            engine.datalog(text)
            got = False
        except error:
            got = True
        return spark.createDataFrame([(got,)], "refused boolean")

    return run


def dl_ground_query(spark, sf_dir):
    engine = _engine(spark, sf_dir, "nation", edge=CYCLE)
    yes, no = (engine.datalog(f"{PATH} ?- path({q}).").count() for q in ("0, 3", "0, 1"))
    return spark.createDataFrame([(yes, no)], "yes long, no long")


def dl_materialise(spark, sf_dir):
    engine = _engine(spark, sf_dir, "nation", edge=CYCLE)
    engine.datalog(PATH)
    return engine.sql("SELECT n.n_name, count(*) AS n FROM path JOIN nation n ON n.n_nationkey = col0 GROUP BY n.n_name")


def dl_no_query(spark, sf_dir):
    engine = _engine(spark, sf_dir, "nation")
    done = engine.datalog("big(K) :- nation(K, _, R), R > 2.")
    return engine.sql("SELECT col0 AS k FROM big").withColumn("command", F.lit(done.command))


def dl_fact(spark, sf_dir):
    engine = _engine(spark, sf_dir)
    engine.sql("CREATE TABLE likes (who TEXT, what TEXT)")
    engine.sql("CREATE TRIGGER loud BEFORE INSERT ON likes FOR EACH ROW SET what = upper(NEW.what)")
    engine.datalog('likes(ann, tea). likes(bob, "coffee"). likes(ann, tea).')
    return engine.sql("SELECT who, what FROM likes")


def dl_stats(spark, sf_dir):
    engine = _engine(spark, sf_dir, edge="SELECT id AS src, id + 1 AS dst FROM range(20)")
    engine.datalog(PATH)
    n = engine.sql("SELECT count(*) AS n FROM path").first()["n"]
    return spark.createDataFrame([(n, engine.stats.rounds <= 21, engine.stats.applications > 0)], "facts long, few_rounds boolean, applied boolean")


def dl_naive(spark, sf_dir):
    """All rules over all facts until nothing is new: the plain evaluator that the others are held against."""
    engine = _engine(spark, sf_dir, "nation", edge=CYCLE)
    edge = path = engine.table("edge").distinct()
    while True:
        step = path.select("src", F.col("dst").alias("mid")).join(edge.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
        more = path.union(step).distinct()
        if more.count() == path.count():
            return more.toDF("x", "y")
        path = more


def script(spark, sf_dir):
    engine = engine_on(spark, sf_dir, "nation")
    results = engine.run_script("""
-- @sql
CREATE TABLE edge (src INT, dst INT);
INSERT INTO edge SELECT n_nationkey, n_nationkey + 5 FROM nation WHERE n_nationkey < 20;
-- @datalog
path(X, Y) :- edge(X, Y).
path(X, Z) :- path(X, Y), edge(Y, Z).
-- @sql
SELECT col0 AS a, col1 AS b FROM path;
""")
    return results[-1]


_REACH = "WITH RECURSIVE e AS ({e}), p AS (SELECT src, dst FROM e UNION SELECT p.src, e.dst FROM p JOIN e ON p.dst = e.src) "
_TREE, _CYCLE = _REACH.format(e="SELECT c_custkey AS src, c_custkey // 2 AS dst FROM customer WHERE c_custkey > 0"), _REACH.format(e=CYCLE)

#: key: (query, oracle SQL or None)
QUERIES = {
    "dl_recursion": (_answer(PATH + "?- path(X, Y).", "customer", columns=["x", "y"], edge=TREE), _TREE + "SELECT src AS x, dst AS y FROM p"),
    "dl_semi_naive": (_answer("path(X, Y) :- edge(X, Y). path(X, Z) :- path(X, Y), path(Y, Z). ?- path(X, Y).", "nation", columns=["x", "y"], edge=CYCLE), _CYCLE + "SELECT src AS x, dst AS y FROM p"),
    "dl_naive": (dl_naive, _CYCLE + "SELECT src AS x, dst AS y FROM p"),
    "dl_delta_scan": (_answer(PATH + "?- path(0, Y).", "nation", columns=["y"], edge=CYCLE), _CYCLE + "SELECT dst AS y FROM p WHERE src = 0"),
    "dl_scan": (_answer("?- nation(K, N, 2).", "nation", columns=["k", "n"]), "SELECT n_nationkey AS k, n_name AS n FROM nation WHERE n_regionkey = 2"),
    "dl_const": (_answer("?- nation(7, N, R).", "nation", columns=["n", "r"]), "SELECT n_name AS n, n_regionkey AS r FROM nation WHERE n_nationkey = 7"),
    "dl_parse": (_answer('/* names */ hit(N) :- nation(K, N, _), % a comment\n K >= 1 + 2 * 3, N != "x\\ny". ?- hit(N).', "nation", columns=["n"]), "SELECT n_name AS n FROM nation WHERE n_nationkey >= 7"),
    "dl_edb": (_answer("?- region(K, N).", "region", columns=["k", "n"]), "SELECT r_regionkey AS k, r_name AS n FROM region"),
    "dl_rule": (_answer("in_region(N, R) :- nation(_, N, K), region(K, R). ?- in_region(N, R).", "nation", "region", columns=["n", "r"]), "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "dl_join": (_answer("?- customer(C, _N, K, _B, _S), nation(K, Name, R), region(R, _Rn), C < 100.", "customer", "nation", "region", columns=["c", "k", "name", "r"]), "SELECT c_custkey AS c, n_nationkey AS k, n_name AS name, r_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey < 100"),
    "dl_repeat_var": (_answer("?- edge(X, X).", "customer", columns=["x"], edge="SELECT c_custkey % 50 AS src, c_custkey % 7 AS dst FROM customer"), "SELECT DISTINCT c_custkey % 50 AS x FROM customer WHERE c_custkey % 50 = c_custkey % 7"),
    "dl_anon": (_answer("?- nation(_, _Name, R).", "nation", columns=["r"]), "SELECT DISTINCT n_regionkey AS r FROM nation"),
    "dl_head_const": (_answer("tag(K, found) :- nation(K, _, 1). ?- tag(K, T).", "nation", columns=["k", "t"]), "SELECT n_nationkey AS k, 'found' AS t FROM nation WHERE n_regionkey = 1"),
    "dl_multi_rule": (_answer("key(K) :- nation(K, _, _). key(K) :- region(K, _). key(K) :- supplier(K, _, _, _), K < 40. ?- key(K).", "nation", "region", "supplier", columns=["k"]), "SELECT DISTINCT k FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation UNION SELECT r_regionkey FROM region UNION SELECT s_suppkey FROM supplier WHERE s_suppkey < 40)"),
    "dl_negation": (_answer("buyer(C) :- orders(_, C, _, _, _, _). idle(C, N) :- customer(C, N, _, _, _), not buyer(C). ?- idle(C, N).", "customer", "orders", columns=["c", "n"]), "SELECT c_custkey AS c, c_name AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "dl_stratify": (_answer(PATH + "node(X) :- edge(X, _). apart(X, Y) :- node(X), node(Y), not path(X, Y). ?- apart(X, Y).", "nation", columns=["x", "y"], edge=CYCLE), _CYCLE + "SELECT DISTINCT a.src AS x, b.src AS y FROM e a, e b WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.src = a.src AND p.dst = b.src)"),
    "dl_stratify_error": (_refused("p(K) :- nation(K, _, _), not q(K). q(K) :- nation(K, _, _), p(K).", NotStratified), "SELECT TRUE AS refused"),
    "dl_safety": (_refused("p(K, X) :- nation(K, _, _).", UnsafeRule), "SELECT TRUE AS refused"),
    "dl_compare": (_answer("?- part(K, _A, _B, _C, S, _P), S >= 10, S < 15, =<(K, 500), S != 12.", "part", columns=["k", "s"]), "SELECT p_partkey AS k, p_size AS s FROM part WHERE p_size >= 10 AND p_size < 15 AND p_partkey <= 500 AND p_size <> 12"),
    "dl_arith": (_answer("v(K, S * 2 + 1, S / 4, mod(S, 7)) :- part(K, _, _, _, S, _). ?- v(K, A, B, C).", "part", columns=["k", "a", "b", "c"]), "SELECT p_partkey AS k, CAST(p_size * 2 + 1 AS BIGINT) AS a, CAST(p_size // 4 AS BIGINT) AS b, CAST(p_size % 7 AS BIGINT) AS c FROM part"),
    "dl_builtin_true_fail": (_answer("p(K) :- nation(K, _, _), true. p(K) :- region(K, _), fail. ?- p(K), K > 20.", "nation", "region", columns=["k"]), "SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 20"),
    "dl_constraint": (dl_constraint, "SELECT count(*) AS violations FROM supplier WHERE s_acctbal < 0"),
    "dl_query": (_answer("?- region(K, _N). ?- nation(K, N, R).", "nation", "region", columns=["k", "n", "r"]), "SELECT n_nationkey AS k, n_name AS n, n_regionkey AS r FROM nation"),
    "dl_ground_query": (dl_ground_query, "SELECT CAST(1 AS BIGINT) AS yes, CAST(0 AS BIGINT) AS no"),
    "dl_conj_query": (_answer("hot(1). hot(3). ?- nation(K, N, R), hot(R), not region(K, _), K < 20.", "nation", "region", columns=["k", "n", "r"]), "SELECT n_nationkey AS k, n_name AS n, n_regionkey AS r FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey NOT IN (SELECT r_regionkey FROM region) AND n_nationkey < 20"),
    "dl_materialise": (dl_materialise, _CYCLE + "SELECT n_name, count(*) AS n FROM p JOIN nation ON n_nationkey = src GROUP BY n_name"),
    "dl_compound": (_answer("boxed(pair(K, N)) :- nation(K, N, 3). ?- boxed(pair(A, B)).", "nation", columns=["a", "b"]), "SELECT CAST(n_nationkey AS VARCHAR) AS a, n_name AS b FROM nation WHERE n_regionkey = 3"),
    "dl_mutual": (_answer("even(0). even(Y) :- odd(X), edge(X, Y). odd(Y) :- even(X), edge(X, Y). ?- odd(X).", columns=["x"], edge="SELECT id AS src, id + 1 AS dst FROM range(15)"), "SELECT CAST(x AS BIGINT) AS x FROM range(1, 16, 2) t(x)"),
    "dl_stats": (dl_stats, "SELECT CAST(210 AS BIGINT) AS facts, TRUE AS few_rounds, TRUE AS applied"),
    "dl_no_query": (dl_no_query, "SELECT n_nationkey AS k, 'DATALOG' AS command FROM nation WHERE n_regionkey > 2"),
    "dl_fact": (dl_fact, "SELECT * FROM (VALUES ('ann', 'TEA'), ('bob', 'COFFEE')) t(who, what)"),
    "script": (script, "WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(n_nationkey + 5 AS BIGINT) AS b FROM nation WHERE n_nationkey < 20), p AS (SELECT a, b FROM e UNION SELECT p.a, e.b FROM p JOIN e ON p.b = e.a) SELECT a, b FROM p"),
}
