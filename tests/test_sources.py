import json

import pytest
from pyspark.sql import functions as F

from quillmap.operators import pairs as P
from quillmap.sources import newspapers as N
from quillmap.sources import tables as T
from quillmap.streaming import ingest


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a one.md").write_text("# T\nbody ž", encoding="utf-8")
    (tmp_path / "a one_metadata.json").write_text(json.dumps({"identifier": ["x", {"k": 1}], "date": "1900 01 02"}))
    (tmp_path / "b.md").write_text("no sidecar")
    return str(tmp_path)


def test_scan(spark, folder):
    found, skipped = N.scan(spark, folder)
    row = found.first()
    assert (found.count(), row["stem"], row["content"]) == (1, "a one", "# T\nbody ž")
    assert [r["stem"] for r in skipped.collect()] == ["b"]
    assert N.metadata_field(found, "$.date").first()["value"] == "1900 01 02"
    assert N.metadata_field(found, "$.identifier[1].k", "int").first()["value"] == 1


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([("m", "s", 1.5, None)], "model_id string, chunking_strategy string, x double, y string")
    T.write_csv(df, str(tmp_path / "one"))
    back = T.read_csv(spark, [str(tmp_path / "one")], ["x"])
    assert back.first().asDict() == {"model_id": "m", "chunking_strategy": "s", "x": "1.5", "y": None}
    with pytest.raises(ValueError, match="lacks the columns a, z"):
        T.read_csv(spark, [str(tmp_path / "one")], ["z", "a"])
    with pytest.raises(ValueError):
        T.write_csv(df.where("false"), str(tmp_path / "none"))
    (tmp_path / "bom.csv").write_text("﻿model_id,chunking_strategy,x\nm,s,1\nm,s,2\n", encoding="utf-8")
    with pytest.raises(ValueError, match="duplicate keys"):
        T.read_summary(spark, str(tmp_path / "bom.csv"))


def test_histogram_files(spark, tmp_path):
    """Files with the columns that such files have, and similarity files without the run's name."""
    head = "embedding_run_id,embedding_run_name,model_id,distribution,bin_index,bin_left,bin_right,bin_center,density,pair_count,log_x"
    (tmp_path / "new.csv").write_text(f"{head}\nr,,m,Positive,0,0.5,1.0,0.75,2.0,7,0\n")
    row = ("r", "", "m", "Positive", 0, 0.5, 1.0, 0.75, 2.0, 7, False)
    assert [tuple(r) for r in T.read_histogram(spark, str(tmp_path / "new.csv"), "similarity").collect()] == [row]
    (tmp_path / "old.csv").write_text(head.replace("embedding_run_name,", "") + "\nr,m,Positive,0,0.5,1.0,0.75,2.0,7,1\n")
    assert [tuple(r) for r in T.read_histogram(spark, str(tmp_path / "old.csv"), "similarity").collect()] == [(*row[:-1], True)]
    with pytest.raises(ValueError):
        T.read_histogram(spark, str(tmp_path / "new.csv"))


def test_json_is_put_in_place_at_once(tmp_path):
    T.write_json(str(tmp_path / "deep" / "r.json"), {"b": 1, "a": [1]})
    assert json.loads((tmp_path / "deep" / "r.json").read_text()) == {"b": 1, "a": [1]}
    assert not list((tmp_path / "deep").glob("*.tmp"))


def test_store_replaces_runs_as_a_whole(spark, tmp_path):
    store = T.Store(spark, str(tmp_path))
    rows = lambda run, n: spark.createDataFrame([(run, k, k > 0) for k in range(n)], "embedding_run_id string, chunk_id int, is_valid boolean")
    store.write("embeddings", rows("a", 3).unionByName(rows("b", 2)))
    store.write("embeddings", rows("b", 4))
    assert store.read("embeddings").count() == 7 and store.valid_embeddings(["b"]).count() == 3


def test_stream(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("stream")
    q = ingest.start(ingest.newspaper_stream(spark, folder), str(out / "articles"), str(out / "state"))
    q.awaitTermination()
    rows = spark.read.parquet(str(out / "articles")).collect()
    assert sorted((r["title"] or "", r["content"]) for r in rows) == [("", "no sidecar"), ("T", "body ž")]
    assert all(r["article_id"].startswith("article_") and not r["is_valid"] for r in rows)
