from tapeloom.operators import hooks, runs


def test_detector(spark, rows):
    def odd(text):
        if "?" in text:
            raise ValueError(text)
        return "en" if "the" in text else ""

    df = spark.createDataFrame([(1, "the bell"), (2, "?"), (3, None), (4, "x")], "pos long, text string")
    assert rows(hooks.detected(df, odd)) == [(1, "en"), (2, "undetected"), (3, "undetected"), (4, "undetected")]


def test_transcriber(spark, rows):
    files = spark.createDataFrame([("a", bytearray(b"xy")), ("b", None)], "path string, content binary")
    assert rows(hooks.transcribed(files, lambda: lambda c: str(len(c)))) == [("a", "2"), ("b", None)]


def test_trials_and_best(spark):
    grid = spark.createDataFrame([(0, 1e-3, 4), (1, 1e-4, 8), (2, 1e-4, 8)], "trial_id int, learning_rate double, batch_size int")
    assert runs.best_trial(hooks.tried(grid, lambda rate, size: rate * size)).first().trial_id == 1


def test_parameters(spark):
    params = spark.createDataFrame([("w", [3, 4]), ("b", [4]), ("s", [])], "name string, shape array<int>")
    assert tuple(hooks.parameter_counts(params).first()) == (3, 17)
