"""Golden rows for the canonical feature spec (hand-made, reference column names)."""

import pytest
from pyspark.sql import functions as F

from foldwise.operators import features as FE

# The reference table's raw column names.
NUMERIC = ["age", "daily_screen_time_hours", "social_media_hours", "gaming_hours", "work_study_hours",
           "sleep_hours", "notifications_per_day", "app_opens_per_day", "weekend_screen_time"]
CATEGORICAL = ["gender", "stress_level", "academic_work_impact"]
ROLES = {"daily": "daily_screen_time_hours", "social": "social_media_hours", "gaming": "gaming_hours",
         "work": "work_study_hours", "weekend": "weekend_screen_time", "sleep": "sleep_hours",
         "notif": "notifications_per_day", "opens": "app_opens_per_day"}
SCHEMA = ("id bigint, " + ", ".join(f"{c} double" for c in NUMERIC) + ", "
          + ", ".join(f"{c} string" for c in CATEGORICAL) + ", addicted_label int")
FULL = [20.0, 8.0, 3.0, 1.0, 2.0, 7.0, 100.0, 50.0, 9.0, "F", "High", "Yes", 1]


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(0, *FULL)]
    for i in range(12):  # each raw column missing in turn
        r = list(FULL)
        r[i] = None
        rows.append((i + 1, *r))
    rows.append((13, *([None] * 12), 0))  # everything missing
    zero = list(FULL)
    zero[1] = 0.0  # zero daily screen time -> every share is NULL, not an error
    zero[6] = 0.0  # zero notifications -> opens / notifications is NULL
    rows.append((14, *zero))
    df = spark.createDataFrame(rows, SCHEMA)
    out = FE.build_features(df, "id", "addicted_label", NUMERIC, CATEGORICAL, ROLES)
    return {r.id: r.asDict() for r in out.collect()}, out.columns


def test_44_columns_in_order(golden):
    _, cols = golden
    feats = cols[2:]
    assert len(feats) == 44
    assert feats[:12] == NUMERIC + CATEGORICAL
    assert feats[-2:] == ["other_screen_time", "other_screen_time_isna"]


def test_full_row_values(golden):
    r = golden[0][0]
    assert r["social_media_share"] == pytest.approx(3 / 8)
    assert r["entertainment_share"] == pytest.approx(4 / 8)
    assert r["sleep_awake_share"] == pytest.approx(7 / 15)
    assert r["weekend_extra_screen"] == pytest.approx(1.0)
    assert r["total_active_hours"] == pytest.approx(6.0)
    assert r["other_screen_time"] == pytest.approx(2.0) and r["other_screen_time_isna"] == 0
    assert r["missing_count_total"] == 0


def test_each_missing_column(golden):
    rows = golden[0]
    for i, c in enumerate(NUMERIC + CATEGORICAL):
        r = rows[i + 1]
        assert r[f"{c}_isna"] == 1
        assert r["missing_count_total"] == 1
        assert r["missing_count_numeric"] == (1 if c in NUMERIC else 0)
    assert rows[3]["other_screen_time"] is None and rows[3]["other_screen_time_isna"] == 1
    assert rows[13]["missing_count_total"] == 12


def test_zero_denominators_give_null(golden):
    r = golden[0][14]
    for c in ["social_media_share", "gaming_share", "weekend_weekday_ratio", "notifications_per_screen_hour",
              "engagement_intensity", "app_opens_per_notification"]:
        assert r[c] is None
    assert r["screen_sleep_ratio"] == 0.0


def test_row_stats_match_pandas(spark):
    import pandas as pd
    pdf = pd.DataFrame({"a": [1.0, None, 3.0, 2.0], "b": [2.0, 2.0, None, 2.0], "c": [9.0, 1.0, 0.0, 2.0],
                        "d": [4.0, 5.0, 6.0, 2.0]})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).reset_index(), "index long, a double, "
                               "b double, c double, d double")
    got = FE.row_stats(df, ["a", "b", "c", "d"], keep=["index"]).toPandas().set_index("index").sort_index()
    filled = pdf.fillna(0)
    assert list(got["row_num_mean"].round(9)) == list(filled.mean(axis=1).round(9))
    assert list(got["row_num_std"].round(9)) == list(filled.std(axis=1).round(9))
    assert list(got["row_num_skew"].round(9)) == list(filled.skew(axis=1).round(9))


def test_hash_sample_is_deterministic(spark):
    df = spark.range(10000).withColumnRenamed("id", "id")
    a = FE.hash_sample(df, "id", 7, 0.15).count()
    b = FE.hash_sample(df.repartition(7), "id", 7, 0.15).count()
    assert a == b and 1300 < a < 1700
