import pytest
from pyspark.sql import functions as F

from strataform.functions.predicates import Conditions as P
from strataform.functions.predicates import compile_predicate
from strataform.operators import collection, sequence
from strataform.plans.errors import EngineError
from strataform.plans.ordinal import numbered, ordered
from strataform.plans.query import query


@pytest.fixture
def users(spark):
    return ordered(spark.createDataFrame([(0, 1, "Ada", 37.0, "admin"), (1, 2, "Grace", 17.0, "user"), (2, 3, "Edsger", 40.0, "blocked"), (3, 1, "Ada v2", 38.0, "admin")], "n long, id long, name string, age double, role string"), "n")


@pytest.fixture
def items(spark):
    rows = [(1, False, 20.0, "a", ["cold"]), (2, True, 90.0, "a", ["hot", "new"]), (3, True, 85.0, "b", ["hot"]), (4, True, 40.0, "b", []), (5, True, 99.0, "c", ["top"])]
    return ordered(spark.createDataFrame(rows, "id int, active boolean, score double, category string, tags array<string>"), "id")


def ids(rows, key="id"):
    return [r[key] for r in rows]


def test_predicates_are_two_valued(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (float("nan"),), (None,)], "x double")
    cases = [(P.gt("x", 2.0), 1), (P.not_(P.gt("x", 2.0)), 3), (P.eq("x", 1.0), 1), (P.eq("x", float("nan")), 0), (P.neq("x", 1.0), 3), (P.lt("x", 2.0), 1), (P.lt("x", float("nan")), 0), (P.eq("x", None), 1), (P.lte("x", 5.0), 2), (P.or_(P.gte("x", 5.0), P.eq("x", None)), 2)]
    for p, n in cases:
        assert df.where(compile_predicate(p, {"x": df.schema["x"].dataType})).count() == n, p


def test_eager_ignores_the_order_of_nodes(users):
    a = query(users).select("id", "role").unique("id").filter(lambda p: p.not_(p.eq("role", "blocked")))
    b = query(users).filter(lambda p: p.neq("role", "blocked")).unique("id").select("name").select("id", "role")
    for q in (a, b):
        assert {tuple(r) for r in q.run(users).collect()} == {(1, "admin"), (2, "user")}
    c = query(users).filter(lambda p: p.gt("age", 10.0)).filter(lambda p: p.neq("role", "blocked")).select("name").unique("id").order_by("age")
    assert ids(c.iterate(users), "name") == ["Grace", "Ada"]


def test_groups_and_keys(users):
    got = {r["role"]: ids(r["items"], "name") for r in query(users).filter(lambda p: p.neq("role", "blocked")).keyed("id").group_by("role").select("name").run(users).collect()}
    assert got == {"admin": ["Ada", "Ada v2"], "user": ["Grace"]}
    assert [(r["name"], r["_o0"]) for r in collection.keyed(users, "id").df.orderBy("_o0").collect()] == [("Ada v2", 0), ("Grace", 1), ("Edsger", 2)]


def test_mutation(users):
    gone = query(users).filter(lambda p: p.eq("role", "blocked")).delete().run(users)
    assert sorted(ids(gone.collect(), "n")) == [0, 1, 3]
    changed = query(users).filter(lambda p: p.gt("age", 18.0)).update(role="adult").run(users)
    assert {r["n"]: r["role"] for r in changed.collect()} == {0: "adult", 1: "user", 2: "adult", 3: "adult"}


def test_wrong_queries_are_refused(users):
    q = query(users)
    for wrong in (lambda: q.keyed("id").order_by("age").compile(), lambda: q.delete().compile(), lambda: q.filter(P.eq("id", 1)).select("id").delete().compile(), lambda: q.unique("nothing").compile(), lambda: q.take(0), lambda: q.take(1).count().compile(), lambda: q.params("a").filter(lambda p: p.eq("id", p.param("b")))):
        with pytest.raises(EngineError) as e:
            wrong()
        assert e.value.code == "INVALID_QUERY"


def test_aggregates(spark):
    o = ordered(spark.createDataFrame([(1, "ada", 100.0, "paid"), (2, "ada", 50.0, "pending"), (3, "grace", 200.0, "paid"), (4, "grace", 25.0, "paid")], "id int, customer string, total double, status string"), "id")
    q = query(o).filter(lambda p: p.eq("status", "paid"))
    assert [x.run(o).first()[0] for x in (q.sum("total"), q.count(), q.avg("total"), q.min("total"), q.max("total"))] == [325, 3, 325 / 3, 25, 200]
    none = query(o).filter(lambda p: p.eq("status", "none"))
    assert [x.run(o).first()[0] for x in (none.sum("total"), none.count(), none.avg("total"), none.min("total"), none.max("total"))] == [0, 0, None, None, None]
    assert query(o).unique("customer").count().run(o).first()[0] == 2


def test_sequences(items):
    q = query(items)
    assert [tuple(r) for r in q.filter(lambda p: p.eq("active", True)).select("id", "score").take(2).iterate(items)] == [(2, 90), (3, 85)]
    assert ids(q.flat_map("tags").iterate(items), "value") == ["cold", "hot", "new", "hot", "top"]
    assert ids(q.drop_while(lambda p: p.lt("score", 80.0)).take_while(lambda p: p.gte("score", 40.0)).iterate(items)) == [2, 3, 4, 5]
    assert ids(q.order_by("score", "desc").take(9).iterate(items)) == [5, 2, 3, 4, 1]
    assert ids(q.scan(lambda a, r: a + r["score"], initial=0.0).iterate(items), "value") == [20, 110, 195, 235, 334]
    assert q.take(1).explain()["early_termination"] and q.window(2).explain()["retained_state"] == ["window(n)"]


@pytest.mark.parametrize("block", [1, 2, 3, 1000])
def test_sequences_across_blocks(items, block):
    got = lambda o, f: [f(r) for r in o.df.orderBy("_o0").collect()]
    assert got(sequence.window(items, 3, block), lambda r: ids(r["items"])) == [[1, 2, 3], [2, 3, 4], [3, 4, 5]]
    assert got(sequence.pairwise(items, block), lambda r: (r["prev"]["id"], r["cur"]["id"])) == [(1, 2), (2, 3), (3, 4), (4, 5)]
    assert got(sequence.scan(items, "sum", "score", block=block), lambda r: r["value"]) == [20, 110, 195, 235, 334]
    assert got(sequence.scan(items, "min", "score", block=block), lambda r: r["value"]) == [20] * 5
    assert got(sequence.group_adjacent(items, "category", block), lambda r: ids(r["items"])) == [[1, 2], [3, 4], [5]]
    assert got(sequence.chunk(items, 2), lambda r: ids(r["items"])) == [[1, 2], [3, 4], [5]]


def test_numbers_follow_the_order_and_no_window_takes_all_rows(spark):
    o = ordered(spark.range(5000).select((F.lit(4999) - F.col("id")).alias("k")), "k")
    assert numbered(o).where("k <> _n").count() == 0
    assert sequence.take(o, 3).df.count() == 3 and sequence.drop(o, 4990).df.count() == 10
    plan = o.df.orderBy("_o0").limit(3)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_empty_collections(spark):
    o = ordered(spark.createDataFrame([], "id int, x double"), "id")
    for out in (sequence.window(o, 2), sequence.chunk(o, 2), sequence.pairwise(o), sequence.scan(o, "sum", "x"), sequence.group_adjacent(o, "x"), sequence.drop(o, 1), collection.first_by(o, "x")):
        assert out.df.count() == 0


def test_nan_rows_stand_alone(spark):
    nan = float("nan")
    o = ordered(spark.createDataFrame([(1, nan), (2, nan), (3, None), (4, None), (5, 1.0)], "id int, x double"), "id")
    assert [ids(r["items"]) for r in sequence.group_adjacent(o, "x").df.orderBy("_o0").collect()] == [[1], [2], [3, 4], [5]]
    assert collection.first_by(o, "x").df.count() == 3
