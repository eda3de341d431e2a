"""Record table derived from the generic `events` table.

The same text runs on Spark SQL and on the checking engine. Coordinates are combined as integers and divided once, so
both engines produce the same doubles. `event_id < 33` forms a strip of edge cases (borders shared by two clusters).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RECORDS_SQL = """
SELECT event_id AS id,
 CAST(CASE WHEN event_id < 12 THEN 14000000 + 700*CAST(floor(event_id/4) AS BIGINT)
      WHEN event_id < 20 THEN 14100000 WHEN event_id < 22 THEN 14100700 WHEN event_id < 23 THEN 14101400
      WHEN event_id < 25 THEN 14102100 WHEN event_id < 33 THEN 14102800
      WHEN k >= 95 THEN 13500000 + 2000*(event_id % 100)
      ELSE 12900000 + 15000*site + 300*(k % 5) END AS DOUBLE) / 1e6 AS latitude,
 CAST(CASE WHEN event_id < 33 THEN 77500000
      WHEN k >= 95 THEN 77900000 + 2000*(CAST(floor(event_id/100) AS BIGINT) % 100)
      ELSE 77500000 + 11000*((site*5) % 13) + 300*(CAST(floor(k/5) AS BIGINT) % 4) END AS DOUBLE) / 1e6 AS longitude,
 DATE '2023-11-10' + CAST((event_id*37 + user_id*11) % 151 AS INTEGER) AS created_date,
 CAST(hour(ts) AS INTEGER) AS created_hour,
 CAST((event_id*37 + user_id*11) % 151 AS DOUBLE) + CAST(hour(ts) AS DOUBLE)/24e0 AS days_since_start,
 CASE WHEN event_type IN ('click','view','purchase') THEN 1 ELSE 0 END AS parking_related_violation_count,
 CASE WHEN event_type IN ('click','view','purchase') THEN 0 ELSE 1 END AS non_parking_violation_count,
 event_type AS primary_violation,
 concat('class_', CAST(k % 6 AS STRING)) AS vehicle_class,
 CASE WHEN user_id % 7 = 6 THEN 'Unknown' ELSE concat('Station ', CAST(user_id % 7 AS STRING)) END AS police_station_clean,
 CASE WHEN k % 3 = 0 THEN 'No Junction'
      WHEN k % 3 = 1 THEN concat('BTP', CAST(100+site AS STRING), ' - Market ', CAST(site AS STRING), ' Junction')
      ELSE concat('Street ', CAST(k % 11 AS STRING), ' Junction') END AS junction_name_clean,
 CASE WHEN k % 17 = 0 THEN NULL ELSE concat('Street ', CAST(k % 11 AS STRING)) END AS location_first_segment,
 concat('Street ', CAST(k % 11 AS STRING), ', Block ', CAST(site AS STRING)) AS location_clean
FROM (SELECT event_id, user_id, ts, event_type,
             CAST(regexp_extract(props,'[0-9]+',0) AS BIGINT) AS k, user_id % 13 AS site FROM {events}) e
"""


def records_from_events(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Records with the columns of `schemas.RECORDS` that a source delivers; cleaning adds the rest."""
    return spark.sql(RECORDS_SQL, events=events)
