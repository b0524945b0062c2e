import pytest

from twintongue.errors import ConstraintViolation, NotStratified, ParseError, TooManyRounds, UnknownName, UnsafeRule

CHAIN = "edge(1, 2). edge(2, 3). edge(3, 4). edge(4, 5). "
PATH = "path(X, Y) :- edge(X, Y). path(X, Z) :- path(X, Y), edge(Y, Z). "


def table(engine, name, columns, values):
    engine.sql(f"CREATE TABLE {name} ({columns})")
    engine.sql(f"INSERT INTO {name} VALUES {values}")


def test_closure_becomes_a_table(engine, rows):
    table(engine, "edge", "src INT, dst INT", "(1, 2), (2, 3), (3, 4), (4, 5)")
    assert rows(engine.datalog(PATH + "?- path(1, X).")) == [(2,), (3,), (4,), (5,)]
    assert engine.sql("SELECT col0, col1 FROM path").count() == 10
    assert rows(engine.sql("SELECT count(*) FROM path WHERE col0 = 2")) == [(3,)]


def test_ancestors_and_ground_queries(engine, rows):
    table(engine, "parent", "parent TEXT, child TEXT", "('john', 'mary'), ('mary', 'jane'), ('jane', 'bob')")
    rules = "ancestor(X, Y) :- parent(X, Y). ancestor(X, Z) :- parent(X, Y), ancestor(Y, Z). "
    assert rows(engine.datalog(rules + "?- ancestor(john, Y).")) == [("bob",), ("jane",), ("mary",)]
    assert engine.datalog('?- ancestor("john", bob).').count() == 1
    assert engine.datalog("?- ancestor(bob, john).").count() == 0
    assert engine.datalog("?- ancestor(john, bob).").columns == []


def test_negation_and_recursion(engine, rows):
    table(engine, "edge", "src TEXT, dst TEXT", "('a', 'b'), ('b', 'c'), ('c', 'd'), ('a', 'x'), ('x', 'y')")
    table(engine, "blocked", "node TEXT", "('x'), ('y')")
    text = "safe(X, Y) :- edge(X, Y), not blocked(Y). safe(X, Z) :- safe(X, Y), edge(Y, Z), not blocked(Z). ?- safe(a, Y)."
    assert rows(engine.datalog(text)) == [("b",), ("c",), ("d",)]


def test_comparisons_siblings_anonymous(engine, rows):
    table(engine, "parent", "p INT, c INT", "(1, 2), (2, 3), (2, 4), (3, 5)")
    assert rows(engine.datalog("sib(X, Y) :- parent(P, X), parent(P, Y), X != Y. ?- sib(X, Y).")) == [(3, 4), (4, 3)]
    assert rows(engine.datalog("?- parent(X, _), X >= 2.")) == [(2,), (3,)]
    assert rows(engine.datalog("?- parent(_P, X), <(X, 4).")) == [(2,), (3,)]
    table(engine, "s", "name TEXT, v INT", "('alice', 85), ('bob', 70), ('charlie', 85)")
    assert rows(engine.datalog("?- s(N, 85).")) == [("alice",), ("charlie",)]
    assert rows(engine.datalog('?- s(N, V), N != "bob", V > 80.')) == [("alice", 85), ("charlie", 85)]


def test_arithmetic(engine, rows):
    table(engine, "n", "v INT", "(7), (8), (0)")
    assert rows(engine.datalog("h(X, X / 2 + 1) :- n(X), X * 2 > 10. ?- h(A, B).")) == [(7, 4), (8, 5)]
    assert rows(engine.datalog("?- n(X), mod(X, 2) = 1.")) == [(7,)]
    assert rows(engine.datalog("q(X, 56 / X) :- n(X). ?- q(X, Y).")) == [(7, 8), (8, 7)]


def test_mutual_and_nonlinear_recursion(engine, rows):
    assert rows(engine.datalog("num(0). num(1). num(2). num(3). succ(0, 1). succ(1, 2). succ(2, 3). even(0). even(Y) :- odd(X), succ(X, Y). odd(Y) :- even(X), succ(X, Y). ?- odd(X).")) == [(1,), (3,)]
    assert engine.datalog(CHAIN + "p(X, Y) :- edge(X, Y). p(X, Z) :- p(X, Y), p(Y, Z). ?- p(X, Y).").count() == 10
    assert engine.stats.rounds <= 5


def test_cycle_nulls_repeats(engine, rows):
    table(engine, "e", "a INT, b INT", "(1, 2), (2, 1), (2, NULL), (NULL, 3)")
    assert set(rows(engine.datalog("r(X, Y) :- e(X, Y). r(X, Z) :- r(X, Y), e(Y, Z). ?- r(1, X)."))) == {(1,), (2,), (None,), (3,)}
    assert rows(engine.datalog("loop(X) :- r(X, X). ?- loop(X).")) == [(1,), (2,)]
    assert rows(engine.datalog("?- e(null, X).")) == [(3,)]


def test_compound_terms(engine, rows):
    got = engine.datalog("at(point(1, 2), a). at(point(3, f(x)), b). x(X, L) :- at(point(X, _), L). big(pair(L, L)) :- x(\"3\", L). ?- x(X, L).")
    assert rows(got) == [("1", "a"), ("3", "b")]
    assert rows(engine.datalog("?- big(pair(X, _)).")) == [("b",)]
    assert rows(engine.datalog("?- at(point(_, f(Y)), L).")) == [("x", "b")]
    assert rows(engine.sql("SELECT col0 FROM big")) == [('{"f":"pair","a":[{"t":"atom","v":"b"},{"t":"atom","v":"b"}]}',)]


def test_constraints_and_errors(engine):
    with pytest.raises(ConstraintViolation) as e:
        engine.datalog("unsafe(a). unsafe(b). unsafe(c). :- unsafe(X).")
    assert e.value.count == 3
    engine.datalog("ok(a). :- ok(X), not ok(X).")
    with pytest.raises(NotStratified):
        engine.datalog("b(1). p(X) :- b(X), not q(X). q(X) :- b(X), p(X).")
    for text in ("p(X, Y) :- b(X).", "p(X) :- b(X), not c(Y).", "p(X) :- b(X), Y > 1."):
        with pytest.raises(UnsafeRule):
            engine.datalog("b(1). c(1). " + text)
    with pytest.raises(ParseError):
        engine.datalog("p(X :- q(X).")
    with pytest.raises(UnknownName):
        engine.datalog("?- nothing(X).")
    engine.most_rounds = 5
    with pytest.raises(TooManyRounds):
        engine.datalog("n(0). n(X + 1) :- n(X).")


def test_true_fail_zero_arity(engine, rows):
    assert rows(engine.datalog("b(1). p(X) :- b(X), true. q(X) :- b(X), fail. done :- p(1). r(X) :- b(X), done. ?- r(X).")) == [(1,)]
    assert engine.datalog("?- q(X).").count() == 0


def test_facts_go_through_triggers(engine, rows):
    engine.sql("CREATE TABLE ev (id INT, status TEXT)")
    engine.sql("CREATE TRIGGER t BEFORE INSERT ON ev FOR EACH ROW SET status = 'processed'")
    assert engine.datalog('ev(1, "pending"). ev(2, "waiting").').command == "DATALOG"
    assert rows(engine.sql("SELECT * FROM ev")) == [(1, "processed"), (2, "processed")]


def test_duplicates_and_long_chain(engine, rows):
    table(engine, "items", "name TEXT", "('apple'), ('apple'), ('banana'), ('cherry')")
    assert engine.datalog("?- items(X).").count() == 3
    facts = " ".join(f"e(n{i}, n{i + 1})." for i in range(20))
    assert engine.datalog(facts + " p(X, Y) :- e(X, Y). p(X, Z) :- p(X, Y), e(Y, Z). ?- p(n0, X).").count() == 20
