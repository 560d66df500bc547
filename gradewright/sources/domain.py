"""Domain tables over the driver's tables, and the same as common table expressions for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parameters of the views, ours: an observation needs a value of SEEN, six policies, three final frames.
SEEN, POLICIES, FINAL = 3, 6, 3
SUBJECT, OBJECT, EFFECTOR = "click", "view", "purchase"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rollout_id, policy, role, t, x, y, vis: one exchange on rollout_id serves every later step of a rollout."""
    seen = F.col("value") >= SEEN
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("rollout_id"), F.concat(F.lit("p"), (F.col("user_id") % POLICIES).cast("string")).alias("policy"),
        F.col("event_type").alias("role"), "ts", "event_id", F.when(seen, F.col("value")).alias("x"),
        F.when(seen, F.get_json_object("props", "$.k").cast("double")).alias("y"),
        F.when(seen, 0.5 + 0.5 * F.least(F.lit(1.0), F.col("value") / 100)).otherwise(0.0).alias("vis"))
    e = e.repartition("rollout_id")
    role = Window.partitionBy("rollout_id", "role")
    e = e.withColumn("t", F.row_number().over(role.orderBy("ts", "event_id")) - 1).withColumn("n", F.count("*").over(role))
    e = e.withColumn("len", F.min("n").over(Window.partitionBy("rollout_id")))
    return e.filter("t < len").select("rollout_id", "policy", "role", "t", "x", "y", "vis")


def frames(tracks: DataFrame) -> DataFrame:
    """One row a frame: the pivot of subject (s), object (o) and effector (g), with no join."""
    cols = [F.max(F.when(F.col("role") == role, F.col(c))).alias(p + c[0])
            for p, role in (("s", SUBJECT), ("o", OBJECT), ("g", EFFECTOR)) for c in ("x", "y", "vis")]
    return tracks.groupBy("rollout_id", "policy", "t").agg(*cols)


def final_window(frames: DataFrame, k: int = FINAL) -> DataFrame:
    """The last max(1, k) frames, counted from the longest track."""
    w = Window.partitionBy("rollout_id")
    return frames.withColumn("frames_", F.max("t").over(w) + 1).filter(F.col("t") >= F.col("frames_") - max(1, k)).drop("frames_")


def bindings(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("rollout_id", "policy", "role").agg(
        (F.count("x") > 0).alias("bound"), (F.count("x") / F.count("*")).alias("quality")).withColumn(
        "required", F.col("role").isin(SUBJECT, OBJECT))


def regions(tracks: DataFrame) -> DataFrame:
    """The static box of each rollout's object over time (exclusive upper ends), and its area in distinct points."""
    o = tracks.filter(F.col("role") == OBJECT)
    return o.groupBy("rollout_id").agg(
        F.floor(F.min("x")).alias("x0"), F.floor(F.min("y")).alias("y0"), (F.floor(F.max("x")) + 1).alias("x1"), (F.floor(F.max("y")) + 1).alias("y1"),
        F.countDistinct(F.when(F.col("x").isNotNull(), F.struct(F.floor("x").alias("a"), F.floor("y").alias("b")))).alias("area"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rollout_id, policy, t, ax, ay: the effector's own steps (0 where unknown); those of odd rollouts are turned round, to contradict the video."""
    f = frames(tracks(spark, sf_dir))
    w = Window.partitionBy("rollout_id").orderBy("t")
    sign = F.when(F.col("rollout_id") % 2 == 1, -1.0).otherwise(1.0)
    step = lambda c: F.coalesce(sign * (F.col(c) - F.lag(c).over(w)), F.lit(0.0))
    return f.select("rollout_id", "policy", "t", step("gx").alias("ax"), step("gy").alias("ay"))


def golds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("rollout_id")).agg(F.max("quality").alias("q")).select("rollout_id", (F.col("q") == 1).alias("success"))


def signal_cal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("value", (F.col("event_type") == "error").alias("broken"))


def frame_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode_id, t, emb, is_success, is_demo: eight vectors an episode, even episodes are demos."""
    e = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 8").alias("episode_id"), (F.col("vec_id") % 8).alias("t"), F.col("embedding").alias("emb"), "label")
    w = Window.partitionBy("episode_id")
    return e.withColumn("is_success", F.min_by("label", "t").over(w) < 5).withColumn("is_demo", F.col("episode_id") % 2 == 0).drop("label")


def hyp(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


CTES = f"""
ev AS (SELECT user_id AS rollout_id, 'p' || (user_id % {POLICIES}) AS policy, event_type AS role,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS t,
  CASE WHEN value >= {SEEN} THEN value END AS x, CASE WHEN value >= {SEEN} THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS y,
  CASE WHEN value >= {SEEN} THEN 0.5::DOUBLE + 0.5::DOUBLE * least(1.0::DOUBLE, value / 100) ELSE 0::DOUBLE END AS vis FROM events),
lens AS (SELECT rollout_id, min(n) AS len FROM (SELECT rollout_id, role, count(*) AS n FROM ev GROUP BY ALL) GROUP BY 1),
tracks AS (SELECT ev.* FROM ev JOIN lens USING (rollout_id) WHERE t < len),
frames AS (SELECT rollout_id, policy, t,
  max(x) FILTER (role = 'click') AS sx, max(y) FILTER (role = 'click') AS sy, max(vis) FILTER (role = 'click') AS sv,
  max(x) FILTER (role = 'view') AS ox, max(y) FILTER (role = 'view') AS oy, max(vis) FILTER (role = 'view') AS ov,
  max(x) FILTER (role = 'purchase') AS gx, max(y) FILTER (role = 'purchase') AS gy, max(vis) FILTER (role = 'purchase') AS gv
  FROM tracks GROUP BY ALL),
fin AS (SELECT * FROM (SELECT *, max(t) OVER (PARTITION BY rollout_id) + 1 AS T_ FROM frames) WHERE t >= T_ - {FINAL}),
bindings AS (SELECT rollout_id, policy, role, count(x) > 0 AS bound, count(x)::DOUBLE / count(*) AS quality, role IN ('click', 'view') AS required FROM tracks GROUP BY ALL),
regions AS (SELECT rollout_id, floor(min(x))::BIGINT AS x0, floor(min(y))::BIGINT AS y0, floor(max(x))::BIGINT + 1 AS x1, floor(max(y))::BIGINT + 1 AS y1,
  count(DISTINCT CASE WHEN x IS NOT NULL THEN (floor(x), floor(y)) END) AS area FROM tracks WHERE role = 'view' GROUP BY 1),
actions AS (SELECT rollout_id, policy, t, coalesce(s * (gx - lag(gx) OVER w), 0) AS ax, coalesce(s * (gy - lag(gy) OVER w), 0) AS ay FROM (SELECT *, CASE WHEN rollout_id % 2 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS s FROM frames) WINDOW w AS (PARTITION BY rollout_id ORDER BY t)),
golds AS (SELECT doc_id AS rollout_id, max(quality) = 1 AS success FROM labels GROUP BY 1),
signal_cal AS (SELECT value, event_type = 'error' AS broken FROM events),
frame_emb AS (SELECT vec_id // 8 AS episode_id, vec_id % 8 AS t, embedding AS emb, first_value(label) OVER (PARTITION BY vec_id // 8 ORDER BY vec_id) < 5 AS is_success, (vec_id // 8) % 2 = 0 AS is_demo FROM embeddings)
"""
