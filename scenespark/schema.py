"""Schemas of the tables that operators exchange and sinks write."""

from pyspark.sql import types as T

FRAME = T.StructType([
    T.StructField("stream_id", T.IntegerType()),
    T.StructField("source_idx", T.LongType()),
    T.StructField("analyzed_idx", T.IntegerType()),
    T.StructField("timestamp_sec", T.DoubleType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("sharpness", T.DoubleType()),
])
SAMPLED_FRAME = T.StructType([*FRAME.fields, T.StructField("sim_to_shot_mean", T.DoubleType()), T.StructField("is_shot_start", T.BooleanType()), T.StructField("segment_id", T.IntegerType())])
SEGMENT = T.StructType([
    T.StructField("segment_id", T.IntegerType()),
    T.StructField("start_sec", T.DoubleType()),
    T.StructField("end_sec", T.DoubleType()),
    T.StructField("duration_sec", T.DoubleType()),
    T.StructField("num_frames", T.LongType()),
])
PICK_CSV = T.StructType([
    T.StructField("stream_id", T.IntegerType()),
    T.StructField("pick_id", T.IntegerType()),
    T.StructField("segment_id", T.IntegerType()),
    T.StructField("timestamp_sec", T.DoubleType()),
    T.StructField("sharpness", T.DoubleType()),
    T.StructField("representativeness", T.DoubleType()),
    T.StructField("composite_score", T.DoubleType()),
    T.StructField("rank_in_segment", T.IntegerType()),
    T.StructField("saved_path", T.StringType()),
])
