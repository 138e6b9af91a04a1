"""Training and scoring in one query read the same stored bars: the ticks are aggregated for both at once."""

from checks import model_queries as Q


def test_scoring_reads_the_bars_of_the_training(spark, bars, monkeypatch):
    seen, given = spark.sparkContext.accumulator(0), {}

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    def score(rows, model, start, settings):
        given.update(rows=sorted(map(str, rows.collect())), model=model)
        return spark.createDataFrame([("X", "2020-01-01", 0.5, "BUY", ["a"])], "symbol string, ts string, score double, signal string, factors array<string>")

    made = bars[0].mapInPandas(count, bars[0].schema)
    monkeypatch.setattr(Q, "_TRAINED", {})
    monkeypatch.setattr(Q, "bars", lambda s, d: made)
    monkeypatch.setattr(Q.stages, "training_rows", lambda clean, settings: {"rows": clean, "names": []})
    monkeypatch.setattr(Q.stages, "fitted", lambda rows, names, settings: {"model": "the model", "test": rows})
    monkeypatch.setattr(Q.stages, "score_and_explain", score)
    assert Q.QUERIES["score_and_explain"](spark, "nowhere").count() == 1
    assert given["model"] == "the model" and given["rows"] == sorted(map(str, bars[0].collect()))
    assert seen.value == 690
