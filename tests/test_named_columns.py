from faultline.plans import fixtures


def test_named_columns_have_the_same_rows(spark, sf):
    """Also where cues and hedges are not read, because no named column comes from them."""
    whole, named = fixtures.events(spark, sf), fixtures.events(spark, sf, *fixtures.MAPPED)
    assert named.columns == list(fixtures.MAPPED)
    rows = lambda df: sorted(map(str, df.select(*fixtures.MAPPED).collect()))
    assert rows(named) == rows(whole)


def test_names_of_developers_need_no_narrative(spark, sf):
    plan = fixtures.events(spark, sf, "slug", "developer_or_operator")._jdf.queryExecution().optimizedPlan().toString()
    assert "(?i)" not in plan
