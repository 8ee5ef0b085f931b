"""The star-schema model on the customers and orders of the golden cases."""

import pytest

from gridloom.plans.model import Model, Relationship, parse


@pytest.fixture(scope="module")
def model(spark):
    m = Model()
    m.add_table("Customers", spark.createDataFrame([(1, "Alice", "East"), (2, "Bob", "West"), (3, "Carol", "East")], "CustomerId int, Name string, Region string"))
    m.add_table("Orders", spark.createDataFrame([(100, 1, 10.0), (101, 1, 20.0), (102, 2, 5.0), (103, 3, 8.0)], "OrderId int, CustomerId int, Amount double"))
    m.add_relationship(Relationship("Orders", "CustomerId", "Customers", "CustomerId", referential=True), check=True)
    return m.add_measure("Total", "SUM(Orders[Amount])")


def value(m, text, *filters):
    return m.evaluate(text, list(filters)).first()[0]


def test_scalars(model):
    assert value(model, "[Total]") == 43.0 and value(model, "AVERAGEX(Orders, Orders[Amount] * 2)") == 21.5
    assert value(model, 'CALCULATE([Total], Customers[Region] = "East")') == 38.0 and value(model, "[total]", 'Customers[Name] = "Bob"') == 5.0
    assert value(model, 'CALCULATE(COUNTROWS(Customers), ALL(Customers[Region]))', 'Customers[Region] = "East"') == 3
    assert value(model, "DISTINCTCOUNT(Customers[Region])") == 2 and value(model, "COUNTROWS(VALUES(Customers[Region]))") == 2
    assert value(model, "TRUE() + 1") == 2 and value(model, "BLANK() = 0") is True and value(model, 'IF(ISBLANK(BLANK()), "b", "v")') == "b"
    assert value(model, "SUMX(FILTER(Orders, Orders[Amount] > 8), Orders[Amount])") == 30.0 and value(model, "MINX(Orders, Orders[Amount] + 1)") == 6.0
    assert value(model, 'VAR x = 2 RETURN x * [Total]') == 86.0 and value(model, "COUNTROWS({1, 2, 3})") == 3
    assert value(model, 'CONCATENATEX(Customers, Customers[Name], "|", Customers[Name], DESC)') == "Carol|Bob|Alice"
    assert value(model, "MAXX(Customers, [Total])") == 30.0
    assert value(model, 'SELECTEDVALUE(Customers[Region], "many")') == "many" and value(model, "HASONEVALUE(Customers[Region])", 'Customers[Name] = "Bob"') is True


def test_pivot_and_crosstab(model):
    got = model.pivot("Orders", [("Customers", "Region")], [("t", "[Total]"), ("all", "CALCULATE([Total], ALL(Customers))"), ("s", "ISINSCOPE(Customers[Region])")])
    assert sorted(map(tuple, got.collect())) == [("East", 38.0, 43.0, True), ("West", 5.0, 43.0, True)] and got.columns[0] == "Customers[Region]"
    x = model.crosstab("Orders", [("Customers", "Region")], [("Customers", "Name")], [("Total", "[Total]"), ("N", "COUNTROWS(Orders)")], ["Alice", "Bob"])
    assert "Alice - Total" in x.columns and {r[0]: r["Alice - Total"] for r in x.collect()} == {"East": 30.0, "West": None}


def test_calculated_columns(model, spark):
    m = Model()
    m.tables, m.relationships, m.measures = dict(model.tables), list(model.relationships), dict(model.measures)
    m.add_calculated_column("Orders", "Who", "RELATED(Customers[Name])").add_calculated_column("Customers", "N", "COUNTROWS(RELATEDTABLE(Orders))")
    m.add_calculated_column("Orders", "Below", "COUNTROWS(FILTER(Orders, Orders[Amount] < EARLIER(Orders[Amount])))").add_calculated_column("Orders", "T", "[Total]")
    assert sorted((r["OrderId"], r["Who"], r["Below"], r["T"]) for r in m.tables["Orders"].collect()) == [(100, "Alice", 2, 10.0), (101, "Alice", 3, 20.0), (102, "Bob", None, 5.0), (103, "Carol", 1, 8.0)]
    assert {r["Name"]: r["N"] for r in m.tables["Customers"].collect()} == {"Alice": 2, "Bob": 1, "Carol": 1}
    m.add_calculated_column("Orders", "L", "LOOKUPVALUE(Customers[Region], Customers[CustomerId], Orders[CustomerId])").add_calculated_column("Orders", "E", 'Orders[L] IN {"East"}')
    assert {r["OrderId"]: (r["L"], r["E"]) for r in m.tables["Orders"].collect()}[102] == ("West", False)


def test_unknown_member(spark):
    m = Model().add_table("C", spark.createDataFrame([(1, "East"), (2, "West")], "Id int, Region string")).add_table("O", spark.createDataFrame([(100, 1, 10.0), (101, 999, 7.0)], "OrderId int, Id int, Amount double"))
    m.add_relationship(Relationship("O", "Id", "C", "Id"))
    assert value(m, "COUNTROWS(VALUES(C[Region]))") == 3 and value(m, "DISTINCTCOUNT(C[Region])") == 3 and value(m, "DISTINCTCOUNTNOBLANK(C[Region])") == 2 and value(m, "COUNTROWS(ALLNOBLANKROW(C))") == 2
    assert sorted(map(str, map(tuple, m.pivot("O", [("C", "Region")], [("t", "SUM(O[Amount])")]).collect()))) == ["('East', 10.0)", "(None, 7.0)"]


def test_many_to_many_and_checks(spark):
    m = Model().add_table("D", spark.createDataFrame([(1, "A"), (1, "B"), (2, "C")], "Key int, Attr string")).add_table("F", spark.createDataFrame([(10, 1, 5.0), (11, 2, 7.0)], "Id int, Key int, Amount double"))
    with pytest.raises(ValueError):
        m.add_relationship(Relationship("F", "Key", "D", "Key"), check=True)
    m.add_relationship(Relationship("F", "Key", "D", "Key", many_to_many=True))
    assert value(m, "SUM(F[Amount])", 'D[Attr] = "A"') == 5.0 and value(m, "COUNTROWS(F)", 'D[Attr] = "A"') == 1
    assert sorted(map(tuple, m.pivot("F", [("D", "Attr")], [("t", "SUM(F[Amount])")]).collect())) == [("A", 5.0), ("B", 5.0), ("C", 7.0)]
    assert m.insert_rows("F", spark.createDataFrame([(12, 2, 1.0)], "Id int, Key int, Amount double")) and value(m, "SUM(F[Amount])") == 13.0


def test_parser():
    assert parse("1+2*3") == ("bin", "+", ("value", 1.0), ("bin", "*", ("value", 2.0), ("value", 3.0)))
    with pytest.raises(SyntaxError):
        parse("SUM(")


def test_calculated_columns_follow_their_dependencies(spark):
    m = Model().add_table("T", spark.createDataFrame([(1.0, 2.0, 20.0, 22.0)], "a0 double, A double, b0 double, B double"))
    m.define_calculated_column("T", "B", "[A] + [b0]").define_calculated_column("T", "A", "VAR x = T[a0] RETURN x + 1")
    m.insert_rows("T", spark.createDataFrame([(10.0, 20.0)], "a0 double, b0 double"))
    assert sorted(map(tuple, m.tables["T"].collect())) == [(1.0, 2.0, 20.0, 22.0), (10.0, 11.0, 20.0, 31.0)]
    for text in ("[B] + 1", "T[A]"):
        with pytest.raises(ValueError, match="dependency cycle.* T"):
            m.define_calculated_column("T", "A", text)
    with pytest.raises(TypeError):
        m.insert_rows("T", spark.createDataFrame([("x", 1.0)], "a0 string, b0 double"))
    with pytest.raises(KeyError):
        m.insert_rows("T", spark.createDataFrame([(1.0,)], "A double"))
    m.define_calculated_column("T", "B", "BOGUS()")
    with pytest.raises(Exception):
        m.insert_rows("T", spark.createDataFrame([(5.0, 5.0)], "a0 double, b0 double"))
    assert m.tables["T"].count() == 2
