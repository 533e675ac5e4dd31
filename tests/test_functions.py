import pytest
from pyspark.sql import functions as F

from tidemark import functions as T
from tidemark.sources.connection import Connection, select


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_routing_of_known_keys(spark):
    keys = ["partitionKey", *(f"pk{i}" for i in range(1, 9))]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string").select("i", T.routed_number(F.col("k"), F.lit(16)).alias("n")).orderBy("i")
    assert [r.n for r in rows.collect()] == [2, 4, 14, 8, 11, 13, 7, 1, 0]


def test_partition_id(spark):
    assert one(spark, T.partition_id(F.lit(3), F.lit(5)), T.partition_id(F.lit(None).cast("long"), F.lit(1))) == ((3 << 16) + 5, None)
    with pytest.raises(Exception, match="out of range"):
        one(spark, T.partition_id(F.lit(3), F.lit(1 << 16)))


def test_nulls_and_rounding(spark):
    null = F.lit(None).cast("double")
    assert one(spark, T.greatest(F.lit(1.0), null), T.least(F.lit(1.0), null), T.greatest(F.lit(1), F.lit(2)), T.quotient(F.lit(1), F.lit(0))) == (None, None, 2, None)
    assert one(spark, *(T.to_integer(F.lit(x)) for x in (0.5, 1.5, 2.5, 0.25))) == (0, 2, 2, 0)


def test_paths(spark):
    rows = spark.createDataFrame([("a",), ("a/b/c",), ("/x",), ("",)], "p string").select(T.name_of(F.col("p")), T.parent_of(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [("a", None), ("c", "a/b"), ("x", ""), ("", None)]


def test_numbering_in_bulk_is_consecutive_by_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    rows = T.numbered_in_bulk(df, "k", 5, "n").collect()
    assert sorted((r.n, r.k) for r in rows) == [(i + 5, i) for i in range(1000)]
    assert T.numbered_in_bulk(df.limit(0), "k", 5, "n").count() == 0


def test_connection_and_parameters(spark):
    c = Connection.from_environment({"DB_TYPE": "postgresql", "DB_HOST": "h", "DB_NAME": "d"})
    assert c.url == "jdbc:postgresql://h:5432/d"
    with pytest.raises(ValueError):
        Connection.from_environment({"DB_TYPE": "other"})
    assert select(spark, "select :x as x", x="a' or 1=1").first().x == "a' or 1=1"


def test_tables_are_read_by_jdbc(spark):
    """A database in the session's own process; only its address is another one than from_environment gives."""
    from tidemark.sources.connection import Connection

    class Embedded(Connection):
        url = property(lambda self: f"jdbc:derby:memory:{self.name};create=true")

    assert Connection.from_environment({"DB_NAME": "jdbc_test"}).url == "jdbc:mysql://localhost:3306/jdbc_test"
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    where = Embedded("mysql", "", "", "jdbc_test", "app", "app")
    database = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(where.url, where.user, where.password)
    run = database.createStatement()
    run.execute("create table topics (id bigint, name varchar(20))")
    for i in range(10):
        run.execute(f"insert into topics values ({i}, 'topic {i}')")
    whole = where.read(spark, "topics")
    assert sorted((r.ID, r.NAME) for r in whole.collect()) == [(i, f"topic {i}") for i in range(10)]
    dealt = where.read(spark, "topics", ("ID", 0, 10, 3))
    assert dealt.rdd.getNumPartitions() == 3 and dealt.count() == 10
    database.close()
