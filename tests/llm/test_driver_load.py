"""What the pipeline's stages ask of the driver: plans of few exchanges, one copy of a model."""

from weftbase.llm import langid, mixing


def test_the_mix_is_made_in_small_plans(spark, sf_dir, capsys):
    rows = mixing.taken_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    capsys.readouterr()
    rows.explain()
    assert 0 < capsys.readouterr().out.count("Exchange ") <= 4


def test_the_language_model_is_sent_once(spark, sf_dir, monkeypatch):
    import corpus_pipeline

    sent, send = [], type(spark.sparkContext).broadcast

    def counted(context, value):
        sent.append(type(value))
        return send(context, value)

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", counted)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, sf_dir)
    assert 0 < kept.count() <= docs.count()
    assert sent == [langid.Model]
