"""Published results that can be recomputed from published inputs."""

from pyspark.sql import functions as F

from pluvia import fixed_values as fv
from pluvia.functions.classify import band, risk_score
from pluvia.plans.vulnerability import heat_table, vulnerability_index

ZONES = [
    ("G1", 652.25, 7.4156, 20.8507, 61.7031, 2.1398, 113.71, 4581.5, 2.6555),
    ("G2", 635.3, 4.24, 19.9285, 47.5209, 0.7497, 763.9, 7308.81, 2.1551),
    ("G3", 601.79, 3.1524, 25.5631, 41.557, 0.639, 345.3, 14617.78, 2.5753),
    ("G4", 585.54, 3.3474, 7.828, 39.6359, 1.2211, 1292.76, 20104.43, 2.2724),
]
SCHEMA = (
    "zone string, elevation_mean_m double, slope_mean_deg double, built_up_pct double, vegetation_pct double, water_cover_pct double, "
    "distance_to_nearest_waterway_m double, distance_to_nearest_drainage_m double, rainfall_climatology_mm_day double"
)


def test_zone_index(rows):
    out = {r["zone"]: r for r in vulnerability_index(rows(SCHEMA, *ZONES)).collect()}
    assert [out[z]["vulnerability_score"] for z in ("G1", "G2", "G3", "G4")] == [44.69, 41.07, 80.62, 53.83]
    assert [out[z]["vulnerability_level"] for z in ("G1", "G2", "G3", "G4")] == ["LOW", "LOW", "HIGH", "MODERATE"]
    assert out["G1"]["top_contributors"] == (
        "close proximity to river/stream (+15.0 pts); high built-up percentage (+14.7 pts); "
        "strong historical rainfall exposure (+10.0 pts); permanent water bodies nearby (+5.0 pts)"
    )
    assert out["G3"]["top_contributors"] == (
        "high built-up percentage (+20.0 pts); close proximity to river/stream (+12.1 pts); "
        "low elevation (+11.3 pts); flat terrain with slow runoff (+10.0 pts)"
    )
    assert out["G4"]["contrib_waterway_exposure"] == 0.0 and out["G4"]["contrib_flatness"] == 9.54


def test_heat(rows):
    out = {r["zone"]: r["heat_score"] for r in heat_table(rows(SCHEMA, *ZONES)).collect()}
    assert out == {"G1": 44.06, "G2": 66.64, "G3": 96.52, "G4": 40.0}


def test_weighted_risk(rows):
    df = rows("a double, t double, v double", (85.31, 91.25, 53.83))
    s = risk_score(F.col("a"), F.col("t"), F.col("v"))
    r = df.select(s.alias("s"), band(s, fv.RISK_BANDS).alias("level")).first()
    assert (r["s"], r["level"]) == (79.22, "HIGH")


def test_constant_factor_fails(rows):
    import pytest

    same = [(z[0], *ZONES[0][1:]) for z in ZONES]
    with pytest.raises(Exception, match="constant"):
        vulnerability_index(rows(SCHEMA, *same)).collect()
