"""The given tables as the engine's inputs, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages")

_NAMED = """
SELECT doc_id, n_chars, text, source AS dataset,
  CASE lang WHEN 'en' THEN 'image' WHEN 'de' THEN 'video' ELSE 'frame' END AS dtype,
  CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS label,
  CASE WHEN doc_id % 3 = 0 THEN 'real' ELSE 'fake' END AS class_dir,
  CASE WHEN lang <> 'en' THEN NULL WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS source_split,
  CASE WHEN doc_id % 2 = 0 THEN 'id' || CAST(doc_id % 97 AS STRING) ELSE lpad(CAST(doc_id % 1000 AS STRING), 3, '0') END AS head,
  CASE WHEN doc_id % 2 = 0 THEN '_id' || CAST(doc_id % 13 AS STRING) || '_' || CAST(doc_id AS STRING) ELSE '_' || CAST(doc_id AS STRING) END AS tail
FROM {documents}
"""

BINDINGS: dict[str, str] = {
    "named": _NAMED,
    "media": """
SELECT doc_id, n_chars, label, dtype, dataset, source_split, path,
  CASE dtype WHEN 'image' THEN path WHEN 'video' THEN head ELSE head || tail END AS identity
FROM (SELECT *, CASE dtype
    WHEN 'image' THEN 'data/images/' || dataset || '/' || source_split || '/' || class_dir || '/' || head || tail || '.png'
    WHEN 'video' THEN 'data/videos/' || dataset || '/' || class_dir || '/' || head || tail || '.mp4'
    ELSE 'data/preprocessed_frames/' || dataset || '/' || class_dir || '/' || head || tail END AS path
  FROM {named}) AS x
""",
    "listing": """
SELECT path, CAST(n_chars AS BIGINT) AS length FROM (
  SELECT n_chars, 'data/images/' || dataset || '/'
    || CASE WHEN doc_id % 23 = 0 THEN '.cache' WHEN doc_id % 7 = 0 THEN 'TRAIN' WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END
    || '/' || CASE WHEN doc_id % 29 = 0 THEN 'FAKE' ELSE class_dir END || '/' || head || tail
    || CASE WHEN doc_id % 19 = 0 THEN '.txt' WHEN doc_id % 11 = 0 THEN '.PNG' ELSE '.jpg' END AS path
  FROM {named} WHERE dtype = 'image'
  UNION ALL
  SELECT n_chars, 'data/videos/' || dataset || CASE WHEN CAST(substr(dataset, 4) AS INT) % 2 = 0 THEN '/' || class_dir ELSE '/deep/' || class_dir || '/c23' END
    || '/' || head || tail || CASE WHEN doc_id % 19 = 0 THEN '.json' WHEN doc_id % 11 = 0 THEN '.MOV' ELSE '.mp4' END
  FROM {named} WHERE dtype = 'video'
  UNION ALL
  SELECT n_chars, CASE WHEN doc_id % 2 = 0
      THEN 'data/preprocessed_frames/' || dataset || '/' || CASE WHEN doc_id % 31 = 0 THEN 'other' WHEN doc_id % 3 = 0 THEN 'YouTube-real' ELSE 'Celeb-fake' END
      ELSE 'data/video-frames/' || class_dir || '/' || dataset END
    || '/' || head || tail || '/' || lpad(CAST(i AS STRING), 6, '0') || '.jpg'
  FROM {named} CROSS JOIN (VALUES (0), (1), (2), (3)) AS f(i) WHERE dtype = 'frame' AND i <= doc_id % 4
) AS x
""",
    "catalogue": """
SELECT kind, dataset, CASE WHEN kind = 'images' THEN 'split_class' WHEN CAST(substr(dataset, 4) AS INT) % 2 = 0 THEN 'flat_class' ELSE 'deep_nested' END AS structure, class_dir, label
FROM (SELECT DISTINCT source AS dataset FROM {documents}) AS d
CROSS JOIN (VALUES ('images'), ('videos')) AS k(kind) CROSS JOIN (VALUES ('fake', 0), ('real', 1)) AS c(class_dir, label)
""",
    "folders": """
SELECT path, dataset, label, CAST(1 + doc_id % 4 AS BIGINT) + n_chars % 50 AS frames FROM {media} WHERE dtype = 'frame'
""",
    "videos": """
SELECT *, CASE WHEN fps > 0 THEN CAST(frame_count AS DOUBLE) / fps ELSE CAST(0 AS DOUBLE) END AS duration_sec FROM (
  SELECT path, dataset, label, doc_id, CAST(n_chars AS BIGINT) AS frame_count, doc_id % 29 <> 0 AS opened,
    CASE WHEN doc_id % 17 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(25 AS DOUBLE) END AS fps FROM {media}) AS x
""",
    "results": """
SELECT path, label, dtype, dataset, doc_id % 31 <> 0 AS ok, CASE WHEN doc_id % 31 = 0 THEN 'OSError: image file is truncated' END AS error FROM {media}
""",
    "labelled": """
SELECT m.* FROM {media} AS m JOIN (SELECT DISTINCT doc_id AS known FROM {labels}) AS l ON m.doc_id = l.known
""",
    "predictions": """
SELECT path, dataset, run, label, CASE WHEN n_chars % 37 >= 19 THEN 1 ELSE 0 END AS pred_label,
  CASE WHEN doc_id % 41 = 0 THEN CAST('NaN' AS DOUBLE) WHEN doc_id % 43 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(n_chars % 37 AS DOUBLE) / CAST(37 AS DOUBLE) END AS prob_real
FROM (SELECT m.path, m.dataset, m.n_chars, m.doc_id, m.dtype AS run, CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS label FROM {media} AS m JOIN {labels} AS l ON m.doc_id = l.doc_id) AS x
""",
    "predictions_large": """
SELECT l_linestatus AS run, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, CASE WHEN l_discount >= CAST('0.05' AS DOUBLE) THEN 1 ELSE 0 END AS pred_label,
  l_discount * CAST(10 AS DOUBLE) AS prob_real FROM {lineitem}
""",
    "history": """
SELECT run, CAST(epoch AS INT) AS epoch, val_f1 FROM (
  SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, abs(value) / (CAST(1 AS DOUBLE) + abs(value)) AS val_f1 FROM {events}) AS x
""",
    "manifest": """
SELECT 'RUN ' || CAST(p_partkey AS STRING) || '/' || p_brand AS run_name, 'EXP-' || CAST(p_partkey % 700 AS STRING) AS experiment_no,
  CASE WHEN p_size % 2 = 0 THEN 'image' ELSE 'video' END AS protocol,
  CASE p_partkey % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'spatial' WHEN 2 THEN 'temporal' ELSE 'spatiotemporal' END AS category,
  CASE p_partkey % 5 WHEN 0 THEN 'ConvNeXt' WHEN 1 THEN 'Swin' WHEN 2 THEN 'ViT' WHEN 3 THEN '' ELSE 'Plain' END AS family,
  CASE p_partkey % 3 WHEN 0 THEN 'convnext_base' WHEN 1 THEN 'swin_base' ELSE 'resnet' END AS model_name,
  CASE WHEN p_partkey % 9 < 4 THEN 'none' WHEN p_partkey % 9 < 8 THEN 'weighted_ce' ELSE 'focal' END AS loss_mode,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / CAST(51 AS DOUBLE) END AS test_f1,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_retailprice / CAST(2500 AS DOUBLE) END AS best_val_f1,
  CAST((p_size * 7) % 50 AS DOUBLE) / CAST(50 AS DOUBLE) AS test_acc, CAST(p_size AS DOUBLE) / CAST(60 AS DOUBLE) AS best_val_acc,
  CAST(100 + p_size AS BIGINT) AS test_real_samples, CAST(300 + p_partkey % 50 AS BIGINT) AS test_fake_samples
FROM {part}
""",
    "bad_media": """
SELECT event_id, ts, CAST(user_id AS STRING) || '/' || event_type AS path, event_type AS stage, props AS detail FROM {events}
""",
    "clips_in": "SELECT CAST(o_orderkey AS STRING) AS path, CAST(floor(o_totalprice) AS BIGINT) % 500 AS frame_count, o_orderkey AS k FROM {orders}",
    "saved_frames": """
SELECT path AS source_path, CASE k % 6 WHEN 0 THEN CAST(16 AS BIGINT) WHEN 1 THEN CAST(0 AS BIGINT) WHEN 2 THEN CAST(floor(expected / CAST(2 AS DOUBLE)) AS BIGINT) ELSE expected END AS saved
FROM (SELECT *, CAST(ceil(frame_count / CAST(5 AS DOUBLE)) AS BIGINT) AS expected FROM {clips_in}) AS x
""",
    "extraction_manifest": """
SELECT path AS source_path, CASE WHEN k % 7 = 0 THEN frame_count + 1 ELSE frame_count END AS source_frame_count, CAST(5 AS INT) AS frame_stride,
  CAST(CASE WHEN k % 11 = 0 THEN 30 END AS INT) AS max_frames, CAST(ceil(frame_count / CAST(5 AS DOUBLE)) AS INT) AS saved_frame_count
FROM {clips_in} WHERE k % 5 <> 0
""",
}


def names_in(sql: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", sql)


def with_bindings(sql: str) -> str:
    """DuckDB SQL with the bindings that it names in braces as common table expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in BINDINGS and name not in order:
            for n in names_in(BINDINGS[name]):
                visit(n)
            order.append(name)

    for n in names_in(sql):
        visit(n)
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    if not order:
        return plain(sql)
    ctes = ", ".join(f"{n} AS ({plain(BINDINGS[n]).strip()})" for n in order)
    return f"WITH {ctes} {plain(sql)}"


class Bound:
    """bound.media and so on: the binding over the tables of one folder, built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in BINDINGS and name not in TABLES):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                sql = BINDINGS[name]
                self._made[name] = self.spark.sql(sql, **{n: getattr(self, n) for n in set(names_in(sql))})
        return self._made[name]
