"""Verdicts on the claims of the report, from one row of metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metrics that `verdicts` needs: correlations by band, shares in per cent, rates and a Jaccard index.
METRICS = """rho_e double, rho_e_bands array<double>, rho_r_bands array<double>, ratio_2023 double, pos_peak double, pos_last double, focal_2022 double, focal_2025 double,
    focal_before_2023 double, focal_category string, focal_category_pct double, top_decile double, least_cluster_decile double, journal_jaccard double, mature_cited double, zero_full double, zero_mature double"""


def _range(values: str) -> Column:
    return F.array_max(values) - F.array_min(values)


def _count(values: str, test) -> Column:
    return F.size(F.filter(values, test))


def verdicts(metrics: DataFrame) -> DataFrame:
    """claim and verdict (confirmed, partial or not_confirmed) for each row of metrics (see METRICS); a null metric confirms nothing."""
    governs = F.lower("focal_category").rlike("integrity|governance")
    tests: dict[str, tuple[Column, Column]] = {
        "C1": ((F.col("rho_e") > 0) & (_count("rho_e_bands", lambda x: x <= 0) >= 2), F.lit(False)),
        "C2": ((_count("rho_r_bands", lambda x: x > 0) >= 2) & (_range("rho_r_bands") < _range("rho_e_bands")), F.lit(False)),
        "C3": (F.col("ratio_2023") >= 1.5, F.lit(False)),
        "C4": ((F.col("pos_last") < F.col("pos_peak")) & (F.col("focal_2025") > F.col("focal_2022")), F.lit(False)),
        "C5": (F.col("focal_before_2023") < 5, F.lit(False)),
        "C6": (governs & (F.col("focal_category_pct") >= 40), (F.col("focal_category_pct") > 30) & (F.col("focal_category_pct") < 40)),
        "C7": ((F.col("top_decile") >= 60) & (F.col("least_cluster_decile") >= 50), F.lit(False)),
        "C8": (F.col("journal_jaccard") < 0.20, F.lit(False)),
        "C9": (F.col("mature_cited") >= 85, F.lit(False)),
        "Q1": (F.col("zero_full") - F.col("zero_mature") >= 0.4 * F.col("zero_full"), F.lit(False)),
    }
    word = lambda yes, partly: F.when(yes, "confirmed").when(partly, "partial").otherwise("not_confirmed")
    rows = F.array(*(F.struct(F.lit(k).alias("claim"), word(*t).alias("verdict")) for k, t in tests.items()))
    return metrics.select(F.explode(rows).alias("v")).select("v.*")
