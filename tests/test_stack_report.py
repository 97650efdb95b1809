"""The regression report builds its daily bars once, and positions meet orders that know their segment."""

from barloom.catalog import evaluation, modelling, tables


def test_daily_bars_are_built_once(spark, sf, monkeypatch):
    built, real = [], tables.bars_daily
    monkeypatch.setattr(tables, "bars_daily", lambda *a: built.append(1) or real(*a))
    assert modelling.stack_regression_report(spark, sf).count() == 2
    assert len(built) == 1
    daily = tables.bars(spark, sf, "1d")
    own, given = (evaluation.value_rows(spark, sf, d).drop("datetime") for d in (None, daily))
    assert own.count() == given.count() > 0 and own.exceptAll(given).count() == 0


def test_positions_take_part_in_one_join(spark, sf):
    joins = [line for line in tables.sales(spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 2
    li, od, cu = (tables.table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    plain = li.join(od, li.l_orderkey == od.o_orderkey).join(cu, od.o_custkey == cu.c_custkey).select(*tables.sales(spark, sf).columns)
    assert tables.sales(spark, sf).exceptAll(plain).count() == 0 and plain.count() == tables.sales(spark, sf).count()
    assert "l_orderkey" not in joins[1]
