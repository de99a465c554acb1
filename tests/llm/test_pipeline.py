import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")
from spectrafleet.llm import quality  # noqa: E402
from spectrafleet.llm.encoding import Encoder  # noqa: E402
from spectrafleet.llm.queries import quality_model, tokenizer_path  # noqa: E402
from tests.llm.test_near_copies import alike_groups, slow_hits  # noqa: E402

SF = "/root/testdata/sf0.001"


def first_of_each_group(ids, rows):
    of = alike_groups([(i, rows[i]) for i in ids])
    return [i for k, i in enumerate(ids) if of[k] == k]


def test_run_matches_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    model = quality_model(spark, docs, SF)
    scores, _ = model.score(list(rows.values()))
    keep = [i for i, s in zip(rows, scores, strict=True) if s >= quality.THRESHOLD]
    keep = first_of_each_group(sorted(keep), rows)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = {i: rows[i] for i in keep}
    clean = [i for i in keep if not slow_hits(words[i], items)[1]]
    tokenizer = Encoder.load(str(tokenizer_path("word_bpe_49k.json"))).tokenizer
    want = []
    for i in clean:
        ids = tokenizer.encode(rows[i], add_special_tokens=False).ids
        want.append((i, len(ids), np.array(ids, "<u4").tobytes(), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert 20 < len(want) < len(rows)


@pytest.mark.parametrize("at", range(4))
def test_filtering_stages_keep_the_columns_and_take_empty_tables(spark, at):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = pipeline.STAGES[at][1]
    out = stage(spark, docs.limit(0), SF)
    assert out.count() == 0
    if at < 3:
        assert out.dtypes == docs.dtypes


def test_stages_take_clashing_columns_and_null_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    more = spark.createDataFrame([(None, item), (None, "no id and no text of the benchmark"), (7, None), (7, "")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(more)
    for c in ("score", "_score", "_passages", "n_passages", "digest", "node", "keep", "row", "fp", "_its_key"):
        docs = docs.withColumn(c, F.lit(c))
    for _, stage in pipeline.STAGES[:3]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        assert out.filter("_score <> '_score' or digest <> 'digest' or _its_key <> '_its_key'").count() == 0
    texts = {r["text"] for r in pipeline.STAGES[2][1](spark, docs, SF).filter("doc_id is null").collect()}
    assert texts == {"no id and no text of the benchmark"}
