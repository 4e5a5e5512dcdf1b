"""Cohort rules on hand-made edge rows (FIXTURES section 7)."""

from dataclasses import replace

from panelcast.operators import cohort
from panelcast.spec import ANALOGUE

S = replace(ANALOGUE, sum_cut=10.0, cover_cut=50.0, split_year=2000, fold_base=1990,
            drought_years=(1999,), nondrought_years=(2000, 2001), excluded_units=(9,))
SCHEMA = "unit long, year int, month int, wyear int, target_a double, cover double"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_null_target_drops_whole_group(spark):
    t = rows(spark, [(1, 2000, 1, 2000, 20.0, 60.0), (1, 2000, 2, 2000, None, 60.0),
                     (2, 2000, 1, 2000, 20.0, 60.0)])
    got = {r.unit for r in cohort.filter_sum_at_least(t, S).collect()}
    assert got == {2}


def test_sum_exactly_at_cut_is_kept(spark):
    t = rows(spark, [(1, 2000, 1, 2000, 4.0, 60.0), (1, 2000, 2, 2000, 6.0, 60.0),
                     (2, 2000, 1, 2000, 9.0, 60.0)])
    assert {r.unit for r in cohort.filter_sum_at_least(t, S).collect()} == {1}


def test_mean_exactly_at_cut_ge_and_lt(spark):
    t = rows(spark, [(1, 2000, 1, 2000, 20.0, 40.0), (1, 2000, 2, 2000, 20.0, 60.0)])
    assert cohort.filter_cover(t, S, forest=True).count() == 2
    assert cohort.filter_cover(t, S, forest=False).count() == 0


def test_null_key_is_its_own_group(spark):
    t = rows(spark, [(None, 2000, 1, 2000, 20.0, 60.0), (None, 2000, 2, 2000, 1.0, 60.0)])
    assert cohort.filter_sum_at_least(t, S).count() == 2


def test_exclude_units_keeps_null_unit(spark):
    t = rows(spark, [(9, 2000, 1, 2000, 1.0, 1.0), (None, 2000, 1, 2000, 1.0, 1.0),
                     (3, 2000, 1, 2000, 1.0, 1.0)])
    got = sorted(r.unit is None for r in cohort.exclude_units(t, S).collect())
    assert got == [False, True]


def test_split_partitions_cohort_and_years_disjoint(spark):
    t = rows(spark, [(1, 1999, m, 1999 + (m >= 10), 30.0, 60.0) for m in range(1, 13)] +
             [(1, 2001, m, 2001 + (m >= 10), 30.0, 60.0) for m in range(1, 13)])
    c = cohort.search_cohort(t, S)
    train, test = cohort.temporal_split(c, S)
    assert train.count() + test.count() == c.count()
    assert train.join(test, ["unit", "year", "month"]).count() == 0
    d = {(r.unit, r.year, r.month) for r in cohort.forest_cohort(t, S, drought=True).collect()}
    nd = {(r.unit, r.year, r.month) for r in cohort.forest_cohort(t, S, drought=False).collect()}
    assert d and nd and not d & nd
    assert {r.fold for r in c.collect()} == {9, 10, 11, 12}


def test_positive_filter_runs_before_mean(spark):
    # mean cover over positive rows only: the zero-target row (cover 0) must not count
    t = rows(spark, [(1, 2000, 1, 2000, 20.0, 60.0), (1, 2000, 2, 2000, 0.0, 0.0)])
    assert cohort.search_cohort(t, S).count() == 1


def test_cohort_matrix_matches_individual_cohorts(spark):
    from panelcast.sources.panel import panel
    p = panel(spark, "/root/testdata/sf0.001")
    spec = replace(ANALOGUE, sum_cut=100.0)
    m = {(r.cohort, r.target): r.n for r in cohort.cohort_matrix(p, spec, ["target_a"]).collect()}
    for forest in (True, False):
        for drought in (True, False):
            name = f"{'forest' if forest else 'nonforest'}_{'drought' if drought else 'nondrought'}"
            assert m[(name, "target_a")] == cohort.forest_cohort(p, spec, forest, drought).count()


def test_window_and_semi_plans_agree(spark):
    from panelcast.sources.panel import panel
    p = panel(spark, "/root/testdata/sf0.001")
    spec = replace(ANALOGUE, sum_cut=100.0)
    for fn in (cohort.filter_sum_at_least, cohort.filter_cover):
        a = sorted(fn(p, spec, how="window").select("unit", "year", "month").collect())
        b = sorted(fn(p, spec, how="semi").select("unit", "year", "month").collect())
        assert a == b and len(a) > 0
