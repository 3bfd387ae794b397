from lexivec.operators import vocab
from lexivec.streaming.vocabulary import running_vocabulary


def test_stream_counts_like_a_stored_corpus(spark, docs, tmp_path):
    stored = str(tmp_path / "docs")
    docs.repartition(3).write.parquet(stored)
    seen = {}

    def keep(batch, _):
        seen.update({r["word"]: r["freq"] for r in batch.collect()})

    for _ in range(2):  # the second run finds nothing new
        arriving = spark.readStream.schema(docs.schema).parquet(stored)
        assert running_vocabulary(arriving, "docs", keep).awaitTermination(120)
    assert seen == {r["word"]: r["freq"] for r in vocab.word_freq(docs).collect()}
