"""The operators with SQL against it, on the given tables and on small ones that hold links, repeats, nulls and blanks."""

import duckdb
import pytest

from reelgauge.llm.queries import ORACLE_SQL, QUERIES

TABLE = {"op8_jaccard_join": "documents", "op9_quality_rules": "documents", "op10_embedding_dedup": "embeddings", "op12_collocations": "documents"}
BASE = " ".join(f"w{i}" for i in range(40))
TEXTS = [
    (1, BASE), (2, BASE.upper()), (3, BASE + " end"), (4, "w0 " + BASE.replace("w20", "x")), (5, None), (6, ""), (7, " \t\n"), (8, "a b"), (9, "A  b"), (None, BASE), (10, BASE), (10, "other words of the same id"),
    (11, "the rain of spain\n" * 6), (12, "# $ % & | < > * " * 5), (13, "one two three four five six seven eight the " * 9), (14, "and the of é\x1f\x85 " * 12 + "\x0bq"), (15, BASE), (16, "\n".join(["the same line of words"] * 3 + [f"the line {i} of many others here" for i in range(9)])),
]
VECTORS = [
    (1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (3, [1.0, 0.45], 1), (4, [1.0, 0.1], 2), (5, [0.0, 0.0], 1), (6, None, 1), (7, [float("nan"), 1.0], 1), (8, [1.0, None], 1), (9, [1.0, 0.0], None), (None, [1.0, 0.0], 1),
    (11, [-1.0, 0.0], 1), (1, [0.0, 1.0], 1), (12, [2.0, 0.0], 1), (13, [1.0, 0.0, 0.0], 1), (14, [float("inf"), 1.0], 1), (12, [1.0, 0.0], 1), (20, [1.0, 0.3], 1), (21, [], 1),
]


def written(spark, folder, name):
    rows, schema = ([(*r, None) for r in TEXTS], "doc_id long, text string, lang string") if name == "documents" else (VECTORS, "vec_id long, embedding array<float>, label int")
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return folder, f"{folder}/{name}.parquet/*.parquet"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("given", [True, False])
def test_query_equals_its_sql(spark, sf_dir, tmp_path, name, given):
    folder, files = (sf_dir, f"{sf_dir}/{TABLE[name]}.parquet") if given else written(spark, str(tmp_path), TABLE[name])
    df = QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {TABLE[name]} AS SELECT * FROM '{files}'")
    cursor = con.execute(ORACLE_SQL[name])
    assert [c[0] for c in cursor.description] == df.columns
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, cursor.fetchall()))
