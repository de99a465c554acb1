"""Measurement tables derived from the general test tables, so that every query reads given data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _sql(spark: SparkSession, sf_dir: str, table: str, query: str) -> DataFrame:
    return spark.sql(query, t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def psd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned spectra: campaign, record_idx, sensor_id, src_row, ts_ms, start_freq_hz, end_freq_hz, n_bins, pxx_db."""
    return _sql(
        spark,
        sf_dir,
        "embeddings",
        """select concat('c', vec_id div 125) campaign, (vec_id % 125) div 5 record_idx, concat('Node', vec_id % 5 + 1) sensor_id, vec_id src_row,
           ((vec_id % 125) div 5) * 120000 + (vec_id * 37) % 200 ts_ms, 88e6D start_freq_hz, 108e6D end_freq_hz,
           size(embedding) n_bins, transform(embedding, x -> -60D + 20D * double(x)) pxx_db from {t}""",
    )


def events_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular series: campaign, sensor_id, src_row, ts_ms, value."""
    return _sql(
        spark,
        sf_dir,
        "events",
        "select concat('c', user_id % 10) campaign, event_type sensor_id, event_id src_row, unix_micros(cast(ts as timestamp)) div 1000 ts_ms, value from {t}",
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-format values: campaign, sensor_id, value."""
    return _sql(spark, sf_dir, "lineitem", "select l_returnflag campaign, concat('Node', l_suppkey % 8 + 1) sensor_id, double(l_extendedprice) / 1000 value from {t}")


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acquisition settings: config_id, role and the seven features of a campaign's configuration."""
    return _sql(
        spark,
        sf_dir,
        "part",
        """select p_partkey config_id, if(p_partkey % 2 = 0, 'train', 'test') role, 88e6D + 1e5D * p_size central_freq_hz, double(10e6 + 1e4 * (p_partkey % 7)) span_hz,
           1000D * (1 + p_size % 5) rbw_hz, double(p_retailprice) lna_gain_db, double(p_partkey % 11) vga_gain_db, double(60 + p_partkey % 3) acquisition_interval_s, double(p_size % 2) antenna_amp from {t}""",
    )


FEATURES = ("central_freq_hz", "span_hz", "rbw_hz", "lna_gain_db", "vga_gain_db", "acquisition_interval_s", "antenna_amp")

#: The same tables for DuckDB.
PSD_SQL = """psd as (select 'c' || (vec_id // 125) as campaign, (vec_id % 125) // 5 as record_idx, 'Node' || (vec_id % 5 + 1) as sensor_id, vec_id as src_row,
  ((vec_id % 125) // 5) * 120000 + (vec_id * 37) % 200 as ts_ms, 88e6::double as start_freq_hz, 108e6::double as end_freq_hz,
  len(embedding)::int as n_bins, list_transform(embedding, lambda x: -60.0::double + 20.0::double * x::double) as pxx_db from embeddings)"""
EV_SQL = "ev as (select 'c' || (user_id % 10) as campaign, event_type as sensor_id, event_id as src_row, epoch_us(ts) // 1000 as ts_ms, value from events)"
CELLS_SQL = "cells as (select l_returnflag as campaign, 'Node' || (l_suppkey % 8 + 1) as sensor_id, l_extendedprice::double / 1000 as value from lineitem)"
CONFIG_SQL = """configs as (select p_partkey as config_id, case when p_partkey % 2 = 0 then 'train' else 'test' end as role, 88e6::double + 1e5::double * p_size as central_freq_hz,
  (10e6 + 1e4 * (p_partkey % 7))::double as span_hz, 1000.0::double * (1 + p_size % 5) as rbw_hz, p_retailprice::double as lna_gain_db, (p_partkey % 11)::double as vga_gain_db,
  (60 + p_partkey % 3)::double as acquisition_interval_s, (p_size % 2)::double as antenna_amp from part)"""
