"""Plain tables read as corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.plans.corpus import Corpus, with_index


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> Corpus:
    """Events of a user: seconds, event type, value / 500 as likelihood."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    events = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    rows = with_index(events, "user_id", "ts", "event_id")
    rows = rows.select(F.col("user_id").alias("annotation"), "obs_index", (micros / F.lit(1e6)).alias("extent_time"), F.col("event_type").alias("payload_value"), (F.col("value") / 500).alias("confidence_confidence"))
    return Corpus.build(rows, "tag_open", "time", "likelihood", media="user:")


def intervals(spark: SparkSession, sf_dir: str) -> Corpus:
    """Line items of an order: ship day, quantity as days, return flag, discount as likelihood."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_returnflag", "l_discount", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = with_index(items, "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("double")
    rows = rows.select(F.col("l_orderkey").alias("annotation"), "obs_index", day.alias("extent_time"), F.col("l_quantity").alias("extent_duration"), F.col("l_returnflag").alias("payload_value"), F.col("l_discount").alias("confidence_confidence"))
    return Corpus.build(rows, "segment_open", "time_interval", "likelihood", media="order:")


def boxes(spark: SparkSession, sf_dir: str) -> Corpus:
    """Parts of a brand: key and size as time, price and size as frequency range."""
    part = read(spark, sf_dir, "part")
    rows = with_index(part, "p_brand", "p_partkey")
    size = F.col("p_size").cast("double")
    rows = rows.select(F.col("p_brand").alias("annotation"), "obs_index", F.col("p_partkey").cast("double").alias("extent_time"), size.alias("extent_duration"), F.col("p_retailprice").alias("extent_freq_min"), (F.col("p_retailprice") + size).alias("extent_freq_max"), F.col("p_type").alias("payload_value"))
    return Corpus.build(rows, "tag_open", "time_frequency_box", media="brand:")


def pixels(spark: SparkSession, sf_dir: str) -> Corpus:
    """Parts of a brand: key and size across, price and size down."""
    part = read(spark, sf_dir, "part")
    rows = with_index(part, "p_brand", "p_partkey")
    size = F.col("p_size").cast("double")
    rows = rows.select(F.col("p_brand").alias("annotation"), "obs_index", F.col("p_partkey").cast("double").alias("extent_x"), F.col("p_retailprice").alias("extent_y"), size.alias("extent_width"), size.alias("extent_height"), F.col("p_type").alias("payload_value"))
    return Corpus.build(rows, "tag_open", "pixel_box", media="brand:")


def ticks(spark: SparkSession, sf_dir: str) -> Corpus:
    """Parts of a brand: key and size as MIDI ticks."""
    rows = with_index(read(spark, sf_dir, "part"), "p_brand", "p_partkey")
    rows = rows.select(F.col("p_brand").alias("annotation"), "obs_index", F.col("p_partkey").cast("double").alias("extent_tick"), F.col("p_size").cast("double").alias("extent_duration"), F.col("p_type").alias("payload_value"))
    return Corpus.build(rows, "lyrics", "midi_interval", media="brand:")


def quarters(spark: SparkSession, sf_dir: str) -> Corpus:
    """Parts of a brand: a quarter of the key and a third of the size as places in a score."""
    fraction = lambda n, d: F.struct(n.cast("long").alias("num"), F.lit(d).cast("long").alias("den"))
    rows = with_index(read(spark, sf_dir, "part"), "p_brand", "p_partkey")
    rows = rows.select(F.col("p_brand").alias("annotation"), "obs_index", fraction(F.col("p_partkey"), 4).alias("extent_quarter"), fraction(F.col("p_size"), 3).alias("extent_duration"), F.col("p_type").alias("payload_value"))
    return Corpus.build(rows, "lyrics", "score_interval", media="brand:")


def segment_labels(spark: SparkSession, sf_dir: str) -> Corpus:
    """Customers without extent: the market segment as a tag."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("annotation"), F.lit(0).cast("long").alias("obs_index"), F.col("c_mktsegment").alias("payload_value"))
    return Corpus.build(rows, "tag_open", media="customer:")


def texts(spark: SparkSession, sf_dir: str) -> Corpus:
    """Documents as lyrics without extent."""
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("annotation"), F.lit(0).cast("long").alias("obs_index"), F.col("text").alias("payload_value"))
    return Corpus.build(rows, "lyrics", media="document:")


def segments(spark: SparkSession, sf_dir: str) -> Corpus:
    """Turns of a conversation: role as label, parity as level, a second each."""
    rows = with_index(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    rows = rows.select(F.col("conv_id").alias("annotation"), "obs_index", F.col("turn").cast("double").alias("extent_time"), F.lit(1.0).alias("extent_duration"), F.col("role").alias("payload_label"), (F.col("turn") % 2).alias("payload_level"))
    return Corpus.build(rows, "multi_segment", "time_interval", media="conversation:")


def contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as pitch contours: (annotation, obs_index, extent_time, frequency, voicing)."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("annotation"), F.posexplode("embedding").alias("i", "x"))
    x = F.col("x").cast("double")
    return rows.select("annotation", F.col("i").cast("long").alias("obs_index"), (F.col("i") * F.lit(0.1)).alias("extent_time"), (F.lit(440.0) * (F.lit(1.0) + x)).alias("frequency"), (x >= 0).alias("voicing"))
