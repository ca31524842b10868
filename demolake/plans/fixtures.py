"""Robot-demonstration tables derived from the driver's tables, as SQL that Spark and DuckDB both run.

Coordinates are multiples of 1/1024, so that sums and means are exact in any order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "frames": """SELECT user_id AS episode_index, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index,
  event_id AS idx, ts, event_type AS task, value FROM events""",
    "points": """SELECT l_suppkey AS episode_index, CAST(l_linenumber AS BIGINT) AS frame_index, l_orderkey AS ok, l_partkey AS pk,
  (CAST(round(l_extendedprice * 1e2) AS BIGINT) % 1638) / 1024e0 - 796875e-6 AS x,
  ((l_partkey * 7919 + l_orderkey * 104729) % 1638) / 1024e0 - 796875e-6 AS y,
  ((l_orderkey * 31 + l_partkey * 17) % 1024) / 1024e0 AS z,
  (l_orderkey % 256) / 256e0 AS r, (l_partkey % 256) / 256e0 AS g, ((l_orderkey + l_partkey) % 256) / 256e0 AS b,
  CAST(l_partkey % 5 AS INT) AS label,
  CAST(row_number() OVER (PARTITION BY l_suppkey, l_linenumber
    ORDER BY l_orderkey, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax) AS BIGINT) AS point_id FROM lineitem""",
    "grip": """SELECT episode_index, frame_index, ((episode_index * 37 + frame_index * 101) % 1024) / 1024e0 - 5e-1 AS ex,
  ((episode_index * 53 + frame_index * 211) % 1024) / 1024e0 - 5e-1 AS ey,
  ((episode_index * 71 + frame_index * 307) % 512) / 1024e0 AS ez
  FROM (SELECT DISTINCT l_suppkey AS episode_index, CAST(l_linenumber AS BIGINT) AS frame_index FROM lineitem) k""",
    "targets": """SELECT episode_index AS source_episode, frame_index, s.set_name,
  ((episode_index * 37 + s.k * 101) % 1024) / 1024e0 - 5e-1
    + (CASE WHEN episode_index % 3 = 0 THEN 0 ELSE frame_index END) / 1024e0 AS x,
  ((episode_index * 53 + s.k * 211) % 1024) / 1024e0 - 5e-1 AS y, ((episode_index * 71 + s.k * 307) % 512) / 1024e0 AS z
  FROM frames CROSS JOIN (SELECT 'target' AS set_name, 1 AS k UNION ALL SELECT 'distractor', 2) s
  WHERE episode_index % 3 <> 0 OR frame_index = 0""",
    "epmap": """SELECT DISTINCT episode_index, episode_index + 1 AS source_episode FROM frames WHERE episode_index % 7 <> 0""",
    "detections": """SELECT episode_index, frame_index, CAST(idx % 3 AS INT) AS view_id,
  CASE WHEN idx % 11 = 0 THEN NULL ELSE ((idx * 13) % 1024) / 1024e0 - 5e-1 END AS x,
  ((idx * 29) % 1024) / 1024e0 - 5e-1 AS y, ((idx * 43) % 512) / 1024e0 AS z FROM frames WHERE frame_index % 8 = 0""",
    "lifts": """SELECT k.episode_index, k.frame_index, q.query_id, v.view_name,
  ((k.episode_index * 37 + k.frame_index * 101 + q.query_id * 17 + v.view_no * 3) % 128) / 1024e0 AS x,
  ((k.episode_index * 53 + k.frame_index * 211 + q.query_id * 29 + v.view_no * 5) % 128) / 1024e0 AS y,
  ((k.episode_index * 71 + k.frame_index * 307 + q.query_id * 31 + v.view_no * 7) % 128) / 1024e0 AS z,
  CAST((k.frame_index * 13 + v.view_no * 7 + q.query_id) % 5 AS BIGINT) AS n_support
  FROM (SELECT episode_index, frame_index FROM frames WHERE frame_index % 8 = 0) k
  CROSS JOIN (SELECT 0 AS query_id UNION ALL SELECT 1) q
  CROSS JOIN (SELECT 'left' AS view_name, 0 AS view_no UNION ALL SELECT 'right', 1 UNION ALL SELECT 'wrist', 2) v
  WHERE (k.episode_index + k.frame_index + q.query_id * 3 + v.view_no * 5) % 7 > 2""",
    "trials": """SELECT CASE CAST(o_custkey % 3 AS INT) WHEN 0 THEN 'od' WHEN 1 THEN 'ppcs' ELSE 'tom' END AS task,
  CASE WHEN o_custkey % 4 < 2 THEN 'uniform' ELSE 'eef' END AS sampling, CAST(2048 * (1 + o_custkey % 2) AS INT) AS npoints,
  CAST(10000 * (1 + o_orderkey % 5) AS INT) AS step, CAST(o_orderkey % 3 AS INT) AS seed, o_orderkey AS trial,
  o_totalprice > 15e4 AS success FROM orders""",
    "records": """SELECT concat('ckpt-', CAST(10000 * (1 + o_custkey % 4) AS VARCHAR(10))) AS checkpoint, o_orderpriority AS task,
  CAST(o_custkey % 5 AS INT) AS variation, CAST(10 + o_orderkey % 7 AS INT) AS num_episodes,
  (o_orderkey % 8) / 8e0 AS sr, o_orderkey AS line FROM orders""",
    "pixels": """SELECT l_suppkey AS episode_index, CAST(l_linenumber AS BIGINT) AS frame_index, CAST(l_partkey % 3 AS INT) AS view_id,
  CAST(l_orderkey % 64 AS INT) AS u, CAST(l_partkey % 48 AS INT) AS v, CAST(l_orderkey % 256 AS INT) AS r,
  CAST((l_orderkey + l_partkey) % 256 AS INT) AS g, CAST(l_partkey % 256 AS INT) AS b, l_orderkey AS ok, l_linenumber AS ln FROM lineitem""",
    "cams": """SELECT n_nationkey AS cam_id, CAST(n_nationkey % 3 AS INT) AS view_id, 64e0 AS fx, 64e0 AS fy, 32e0 AS cx, 24e0 AS cy,
  n_nationkey / 32e0 AS tx, 25e-2 AS ty, 125e-2 AS tz FROM nation WHERE n_nationkey < 3""",
    "poses": """SELECT vec_id, CAST(element_at(embedding, 1) AS DOUBLE) AS q1, CAST(element_at(embedding, 2) AS DOUBLE) AS q2,
  CAST(element_at(embedding, 3) AS DOUBLE) AS q3, CAST(element_at(embedding, 4) AS DOUBLE) AS q4 FROM embeddings""",
    "runs": """SELECT CAST(c_custkey % 6 AS INT) AS config, CAST(CASE WHEN c_custkey % 4 < 2 THEN 50 ELSE 250 END AS BIGINT) AS steps,
  CASE WHEN c_custkey % 4 < 2 THEN 64e0 ELSE 160e0 END + (c_custkey % 6) * 8e0 AS seconds, c_custkey AS run FROM customer""",
    "all_runs": """SELECT CAST(c_custkey % 6 AS INT) AS config, CAST(CASE WHEN c_custkey % 12 < 6 THEN 50 ELSE 250 END AS BIGINT) AS steps,
  CASE WHEN c_custkey % 12 < 6 THEN 64e0 + (c_custkey % 6) * 4e0 ELSE 160e0 + (c_custkey % 6) * 8e0 END + c_custkey % 5 AS seconds, c_custkey AS run FROM customer""",
    "calib": """SELECT CAST(o_orderkey AS BIGINT) AS episode_index, concat('cam', CAST(o_custkey % 3 AS VARCHAR(4))) AS view_name,
  (o_orderkey % 4) / 1024e0 AS m1, 1e0 AS m2, (o_custkey % 2) / 64e0 AS m3 FROM orders""",
}


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or one of the views above."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    args = {n: table(spark, sf_dir, n) for n in _needs(sql)}
    return spark.sql(re.sub(r"\b(FROM|JOIN)\s+(\w+)", r"\1 {\2}", sql), **args)


def with_views(sql: str) -> str:
    """DuckDB SQL with the views it names put before it."""
    found: list[str] = []

    def add(text: str) -> None:
        for n in VIEWS:
            if n not in found and re.search(rf"\b{n}\b", text):
                add(VIEWS[n])
                found.append(n) if n not in found else None

    add(sql)
    views = [f"{n} AS ({VIEWS[n].replace('element_at(', 'list_extract(')})" for n in found]
    body = sql.strip()
    rest = body[4:] if body.upper().startswith("WITH") else None
    if not views:
        return body
    return "WITH " + ",\n".join(views) + (",\n" + rest if rest else "\n" + body)
