"""The report's tests against numpy, and the sample of cohorts."""

import numpy as np
import pytest

from folioscope.operators import report, sampling, stats
from folioscope.plans import stages


@pytest.fixture(scope="module")
def papers(spark):
    rng = np.random.default_rng(8)
    year = rng.integers(2020, 2027, 200)
    t = rng.normal(size=200) + 0.1 * (year - 2020)
    g = 0.4 * t + rng.normal(size=200)
    cites = np.floor(np.exp(1 + 0.3 * t + rng.normal(size=200) * 0.5))
    rows = [(f"p{i}", int(y), float(a), float(b), int(c), int(i % 3)) for i, (y, a, b, c) in enumerate(zip(year, t, g, cites, strict=True))]
    d = spark.createDataFrame([*rows, ("none", None, 1.0, 1.0, 1, 0), ("odd", 2021, None, 1.0, 1, 0)], "id string, publication_year int, axis_t double, axis_g double, cited_by_count int, cluster int")
    return d, year.astype(float), t, g, cites


def fit(y, *xs):
    m = np.column_stack([np.ones(len(y)), *xs])
    b = np.linalg.lstsq(m, y, rcond=None)[0]
    return b, 1 - ((y - m @ b) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_hypotheses(papers):
    d, year, t, g, cites = papers
    got = {(r["hypothesis"], r["measure"]): r["value"] for r in report.hypotheses(d, "axis_t", "axis_g", "publication_year", "cited_by_count").collect()}
    b, r2 = fit(t, year)
    assert (got["H1", "intercept"], got["H1", "slope"], got["H1", "r2"], got["H1", "n"]) == pytest.approx((*b, r2, 200))
    assert got["H1", "pearson_r"] == pytest.approx(np.corrcoef(year, t)[0, 1]) and got["H1", "f2"] == pytest.approx(r2 / (1 - r2))
    new, old = t[year >= 2023], t[year < 2023]
    assert got["H1", "cohens_d"] == pytest.approx((new.mean() - old.mean()) / np.sqrt((new.var(ddof=1) + old.var(ddof=1)) / 2))
    b, r2 = fit(g, t, year)
    _, alone = fit(g, year)
    assert (got["H3", "beta_other"], got["H3", "beta_year"], got["H3", "r2"], got["H3", "r2_year_only"]) == pytest.approx((b[1], b[2], r2, alone))
    resid = [x - np.column_stack([np.ones(200), year]) @ fit(x, year)[0] for x in (t, g)]
    assert got["H3", "partial_r"] == pytest.approx(np.corrcoef(*resid)[0, 1]) and got["H3", "f2_other"] == pytest.approx((r2 - alone) / (1 - r2))
    b, r2 = fit(np.log1p(cites), t, g, year)
    assert [got["H4", f"beta_{x}"] for x in ("intercept", "t", "g", "year")] == pytest.approx(list(b)) and got["H4", "r2"] == pytest.approx(r2)
    assert got["H4", "rho_t"] == pytest.approx(stats.spearman(d.dropna(), "cited_by_count", "axis_t")[0])
    few = report.hypotheses(d.limit(20), "axis_t", "axis_g", "publication_year", "cited_by_count").where("hypothesis = 'H4'").collect()
    assert [r["measure"] for r in few] == ["n"]


def test_ratings(spark, papers):
    d = papers[0].dropna()
    form = d.selectExpr("id", "'confirmatory' AS sample_type", "CAST(least(5, greatest(1, round(3 + axis_t))) AS string) AS rater1_t", "CAST(least(5, greatest(1, round(3 + axis_t + 0.4 * axis_g))) AS int) AS rater2_t", "cited_by_count > 6 AS rater1_t_insufficient", "false AS rater2_t_insufficient")
    more = form.selectExpr("id", "'pilot' AS sample_type", "'1' AS rater1_t", "5 AS rater2_t", "false AS rater1_t_insufficient", "false AS rater2_t_insufficient")
    got = {r["measure"]: r["value"] for r in stages.validation({"axis_scores_enriched": d, "validation_form": form.union(more)})["validation_metrics"].collect()}
    sure = form.join(d.select("id", "axis_t"), "id").where("NOT rater1_t_insufficient").toPandas()
    a, b = sure["rater1_t"].astype(float), sure["rater2_t"].astype(float)
    human = (a + b) / 2
    assert got["n"] == len(sure) < 200
    assert got["weighted_kappa"] == pytest.approx(1 - ((a - b) ** 2).mean() / ((a.to_numpy()[:, None] - b.to_numpy()) ** 2).mean())
    assert got["spearman_r"] == pytest.approx(sure["axis_t"].rank().corr(human.rank()))
    scaled = 1 + 4 * (sure["axis_t"] - sure["axis_t"].min()) / (sure["axis_t"].max() - sure["axis_t"].min())
    assert got["mae"] == pytest.approx((scaled - human).abs().mean())
    low, high = scaled[human <= 2].to_numpy(), scaled[human >= 4].to_numpy()
    assert got["auc"] == pytest.approx(((high[:, None] > low) + 0.5 * (high[:, None] == low)).mean()) and got["decision"] == 2
    small = report.ratings(form.join(d.select("id", "axis_t"), "id").limit(9), "t", "axis_t", ("rater1_t", "rater2_t"))
    assert [tuple(r) for r in small.collect()] == [("t", "n", 9.0)]
    assert "validation_metrics" not in stages.validation({"axis_scores_enriched": d})


def test_statistics_have_hypotheses(papers):
    assert stages.statistics({"axis_scores_enriched": papers[0].dropna()})["hypotheses"].where("hypothesis = 'H4'").count() > 5


def test_cohorts(spark):
    rows = [(i, 2020 + i % 7, float(i * 7919 % 1000), float(i * 104729 % 997)) for i in range(900)] + [(2000 + i, 2030, None, 1.0) for i in range(4)] + [(3000, None, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "id int, year int, a double, b double")
    cohorts = [(2019.0, 2022.0, "2020-22", 10), (2022.0, 2023.0, "2023", 25), (2023.0, 2026.0, "2024-26", 40), (2029.0, 2030.0, "late", 55)]
    got = sampling.cohort_sample(d, cohorts, "year", ("a", "b"), "id", 130).collect()
    sizes = {c: sum(r["cohort"] == c for r in got) for *_, c, _ in cohorts}
    assert sizes == {"2020-22": 10, "2023": 25, "2024-26": 40, "late": 4}
    for label, low, high, per_cell in (("2020-22", 2020, 2022, 1), ("2024-26", 2024, 2026, 4)):
        pool = [r for r in rows if r[1] and low <= r[1] <= high]
        cuts = [np.quantile([r[k] for r in pool], [1 / 3, 2 / 3]) for k in (2, 3)]
        cell = lambda r: tuple(int(np.searchsorted(cuts[k], r[2 + k], side="left")) for k in (0, 1))  # noqa: B023, E731
        chosen = [cell(tuple(r)) for r in got if r["cohort"] == label]
        assert all(chosen.count((x, y)) >= per_cell for x in range(3) for y in range(3))
    assert sorted(r["id"] for r in got) == sorted(r["id"] for r in sampling.cohort_sample(d.repartition(5), cohorts, "year", ("a", "b"), "id", 130).collect())
    assert sampling.cohort_sample(d, cohorts, "year", ("a", "b"), "id", 7).count() == 7 and sampling.cohort_sample(d.where("false"), cohorts, "year", ("a", "b"), "id", 7).count() == 0
