"""Explicit schemas; nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "timestamp": T.TimestampType()}


def _schema(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(","))])


RUN_LOG = _schema(
    """run_id bigint, encoder string, family string, granularity string, notebook string, augmentation string, target string, seed int, fold int, split string, rmse double, mae double, r2 double,
    band_f1_macro double, band_qwk double, band_confusion_matrix string, screening_f1 double, screening_auc double, screening_confusion_matrix string, selected_model string, selected_params string,
    encoder_model string, search string, config_json string, logged_at timestamp, notes string"""
)
PREDICTIONS = _schema("participant string, y_true double, y_pred double, encoder string, target string, seed int, search string, family string, augmentation string, granularity string")
SCORES = _schema("participant string, phq9_total double, gad7_total double")
ANSWERS = _schema("row_id bigint, participant string, question string, text string, recorded_at timestamp, received_at timestamp")
_ROUND = T.StructType([T.StructField("round", T.IntegerType()), T.StructField("patient_input", T.StringType())])
SESSIONS = T.MapType(T.StringType(), T.StructType([T.StructField("rounds", T.ArrayType(_ROUND))]))
VALENCE_NORMS = _schema("Word string, ValenceMean double, ArousalMean double")
EMOTION_NORMS = _schema("Word string, Few_Raters string, Dominant_POS string, Happiness_Mean double, Disgust_Mean double, Anger_Mean double, Fear_Mean double, Sadness_Mean double")
