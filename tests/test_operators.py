"""Edge fixtures: tiny inputs with results worked out by hand, and properties against plain Python."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import text as X
from tapeloom.functions import vectors as V
from tapeloom.operators import dedup, profile, quality, runs, scan, segment, training
from tapeloom.plans.filtering import only_keys
from tapeloom.plans.prefix import numbered
from tapeloom.sources import files, logs, settings
from tapeloom.streaming import lines as streams


def lined(spark, *lines):
    return spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "pos long, line_no long, line string")


def listed(spark, *words):
    return quality.dictionary(spark.createDataFrame([(w,) for w in words], "word string"))


def test_blocks_of_texts_and_of_lines_are_the_same(spark, rows):
    draw = random.Random(2)
    texts = [(i, "\n".join(draw.choice(["", "", "", "a", " b"]) for _ in range(draw.randint(1, 40)))) for i in range(60)] + [(100, ""), (101, "\n\n\n"), (102, "x" * 9000 + "\n" * 9000)]
    whole = spark.createDataFrame(texts + [(103, None)], "pos long, text string").withColumn("key", F.lit(1)).repartition(5)
    for operator in (segment.block_starts, segment.block_assign, segment.block_split, segment.separator_check, segment.single_lines):
        assert rows(operator(whole)) == rows(operator(scan.lines(whole.where("text IS NOT NULL")))), operator
    assert "Exchange" not in segment.block_split(spark.createDataFrame(texts, "pos long, text string"))._jdf.queryExecution().executedPlan().toString()


def test_blank_runs(spark, rows):
    got = rows(segment.block_split(lined(spark, "A", "", "", "B", "", "", "", "C", "", "", "", "", "D")))
    assert [(b, n) for _, b, _, n in got] == [(0, 1), (1, 1), (2, 1), (3, 0), (4, 1)]


def test_cumulative_and_consecutive(spark, rows):
    table = lined(spark, "", "", "", "A", "", "B", "", "C")
    assert rows(segment.block_starts(table)) == [(0, 4), (0, 8)]
    assert max(r[1] for r in rows(segment.block_split(table))) == 1
    assert [r[3] for r in rows(segment.block_assign(table))] == ["A", "B", "C"]


def test_literal_split(spark, rows):
    df = spark.createDataFrame([(1, "\n\n\nA\n\n\nB"), (2, "A\n\n\n\nB")], "pos long, text string")
    assert rows(segment.block_literal(df)) == [(1, 1, "A"), (1, 2, "B"), (2, 1, "\nB")]


def test_separator_check(spark, rows):
    table = lined(spark, " a", "", "b", "", "", "c", "", "", " d", "", "", "", "e")
    assert rows(segment.separator_check(table)) == [(0, 2, "a"), (0, 5, "b")]


def test_single_lines(spark, rows):
    assert rows(segment.single_lines(lined(spark, "a", "", "b", "c", "", "d"))) == [(0, 1)]


def test_newlines(spark):
    df = spark.createDataFrame([("x\r\n\r\n y\n",), ("x\n",), ("",)], "t string")
    got = df.select(X.lines("t"), X.shown_lines("t")).collect()
    assert got[0][0] == ["x", "", " y", ""] and got[1][0] == ["x", ""] and got[1][1] == ["x"] and got[2][1] == []


def test_dedup_order_and_slice(spark, rows):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["a", "b", "a", "", "c", "d"])], "pos long, text string")
    kept = dedup.first_of_each(df.where("text <> ''"), "text", ["pos"])
    indexed = numbered(kept, "pos", ["pos"])
    assert [r[0] for r in sorted(rows(indexed), key=lambda r: r[1])] == ["a", "b", "c", "d"]
    assert indexed.where("idx <= 2").count() == 3


def test_copies(spark, rows):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, "x"), (4, "x"), (5, None)], "id long, text string")
    assert rows(dedup.copies(df, "id")) == [(1, 3), (1, 4)]


def test_histogram(spark, rows):
    frame = lambda *v: spark.createDataFrame([(x,) for x in v], "x long")
    assert rows(profile.histogram(frame(10, 30), "x")) == [(0, 15, 1), (1, 25, 0)]
    assert [r[2] for r in rows(profile.histogram(frame(10, 34), "x"))] == [1, 0, 1]
    assert rows(profile.histogram(frame(5), "x")) == [] == rows(profile.histogram(frame(), "x"))


def test_max_quirk(spark):
    df = spark.createDataFrame([(0, 9), (1, 7), (2, 5)], "pos long, x long")
    assert profile.most_quirk(df, "pos", "x").first()[0] == 0 and profile.stats(df, "x").first()["most"] == 9


def test_index_lines(spark):
    df = spark.createDataFrame([("1) 4 - a",), ("junk",), ("5) 28 - d",), (None,)], "row_text string")
    assert [r[0] for r in df.select(X.index_line("row_text")).collect()] == [4, None, 28, None]


def test_paths(spark):
    df = spark.createDataFrame([(p,) for p in ("a/b.mp3", "a/b.c.mp3", "a/.x", "a/b", "x.y.", "a/b/c/d.mp3")], "p string")
    assert [r[0] for r in df.select(X.stem("p")).collect()] == ["b", "b.c", ".x", "b", "x.y.", "d"]
    assert df.select(X.rerooted("p")).collect()[5][0] == "c/d.mp3.txt"


def test_durations(spark):
    values = [0.5, 1.5, 59.5, 3661.2, 86399.6, 90061.0, 172800.0]
    said = ["0:00:00", "0:00:02", "0:01:00", "1:01:01", "1 day, 0:00:00", "1 day, 1:01:01", "2 days, 0:00:00"]
    df = spark.createDataFrame([(v,) for v in values], "x double").select(X.duration("x").alias("s"))
    assert [r[0] for r in df.collect()] == said
    assert [r[0] for r in df.select(X.seconds("s")).collect()] == [0, 2, 60, 3661, 86400, 90061, 172800]


@pytest.mark.parametrize("n, share, wanted", [(10, 1 - 2 * 0.15, 7), (90, 1 - 2 * 0.15, 62), (90, 0.8, 72), (90, 0.85, 76)])
def test_split_sizes(spark, n, share, wanted):
    df = spark.range(n).select(F.col("id").alias("idx"))
    assert training.split_in_order(df, [("train", share)], "rest", n).where("split = 'train'").count() == wanted


def test_shuffled_is_a_permutation(spark):
    got = training.shuffled(spark.range(1000).select(F.col("id").alias("pos")), "pos").orderBy("pos").collect()
    assert sorted(r.idx for r in got) == list(range(1000)) and [r.idx for r in got] != list(range(1000))


def test_early_stop(spark):
    log = spark.createDataFrame([(1, e, 1.0, x, None, None) for e, x in enumerate([5.0, 4.0, 4.0, 3.0, 3.0, 3.0, 2.0], 1)], "run_id long, epoch int, train_loss double, valid_loss double, train_time string, valid_time string")
    got = runs.early_stopping(runs.run_log(log.union(log)), patience=2).orderBy("epoch").collect()
    assert [r.epoch for r in got if r.improved] == [1, 2, 4] and got[-1].epoch == 6 and got[-1].stopped


def test_batch_means(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 8.0)], "idx long, x double")
    assert profile.batch_means(df, "idx", "x", 2).first()[0] == 5.0


def test_padding(spark):
    df = spark.createDataFrame([([5, 6, 7],), ([1, 2, 3, 4, 5],), ([],)], "ids array<int>")
    got = df.select(V.padded(F.col("ids"), 4, 0), V.attention(F.col("ids"), 4)).collect()
    assert [tuple(r) for r in got] == [([5, 6, 7, 0], [1, 1, 1, 0]), ([1, 2, 3, 4], [1, 1, 1, 1]), ([0] * 4, [0] * 4)]
    assert spark.createDataFrame([([7, 0, 0],)], "i array<int>").select(V.labels(F.col("i"), 0)).first()[0] == [7, -100, -100]


def test_dictionary(spark, rows):
    table = lined(spark, " Hello, wrld!", " -- hello", "wrld", "")
    hello, none = listed(spark, "Hello", "hello", None), listed(spark)
    assert rows(quality.unknown_words(table, hello)) == [(0, 1, "wrld"), (0, 2, "")]
    assert rows(quality.unknown_rows(table, hello)) == [(0, 0, 1), (0, 2, 1)]
    texts = spark.createDataFrame([(1, ""), (2, "Hello hello"), (3, "wrld")], "pos long, text string")
    assert rows(quality.all_words_known(texts, hello)) == [(1, True), (2, True), (3, False)]
    assert rows(quality.all_words_known(texts, none)) == [(1, True), (2, False), (3, False)]


def test_dictionaries_of_any_size(spark, rows):
    """300,000 words: more than are sent to every task, so words are joined; the same results as with the list sent."""
    large = quality.dictionary(spark.range(300_000).select(F.concat(F.lit("word"), F.col("id").cast("string")).alias("word")))
    texts = spark.createDataFrame([(1, ""), (2, "Word7 and word299999 word7"), (3, "word5"), (3, "word6 x"), (4, None)], "pos long, text string")
    assert rows(quality.all_words_known(texts.where("text IS NOT NULL"), large)) == [(1, True), (2, False), (3, False), (3, False)]
    numbers = {r.w: r.id for r in training.numbered_words(large).where("w IN ('word0', 'word1', 'word7', 'word299999')").collect()}
    names = sorted(f"word{i}" for i in range(300_000))
    assert numbers == {w: names.index(w) + 2 for w in numbers}
    got = {(r.pos, tuple(r.ids)) for r in training.ids(texts, large).collect()}
    at = lambda w: names.index(w) + 2
    assert got == {(1, ()), (2, (at("word7"), 1, at("word299999"), at("word7"))), (3, (at("word5"),)), (3, (at("word6"), 1))}
    assert rows(training.decoded(training.ids(texts, large), large, "ids")) == [(1, ""), (2, "word7 word299999 word7"), (3, "word5"), (3, "word6")]


def test_ids_both_ways(spark, rows, monkeypatch):
    words, texts = listed(spark, "b", "a", "c"), spark.createDataFrame([(1, "A b x c"), (2, ""), (3, "z z"), (5, None)], "pos long, text string")
    said = rows(training.ids(texts, words)), rows(training.ids(texts, words, 2)), rows(training.decoded(training.ids(texts, words), words, "ids"))
    assert said == ([(1, [2, 3, 1, 4]), (2, []), (3, [1, 1])], [(1, [2, 3]), (2, []), (3, [1, 1])], [(1, "a b c"), (2, ""), (3, "")])
    monkeypatch.setattr("tapeloom.plans.filtering.MOST_SENT", 1)
    assert said == (rows(training.ids(texts, words)), rows(training.ids(texts, words, 2)), rows(training.decoded(training.ids(texts, words), words, "ids")))


def test_masking(spark):
    words, texts = listed(spark, *"abcdefghij"), spark.createDataFrame([(i, "a b c d e f g h i j " * 20) for i in range(20)] + [(99, "")], "pos long, text string")
    got = training.masked(texts, words).collect()
    whole = [x for r in got for x in zip(r.input_ids, r.labels, [2, 3, 4, 5, 6, 7, 8, 9, 10, 11] * 20)]
    hidden = [x for x in whole if x[1] != training.IGNORED]
    assert len(got) == 20 and 0.12 < len(hidden) / len(whole) < 0.18 and all(label == was for _, label, was in hidden)
    assert all(i == was for i, label, was in whole if label == training.IGNORED) and 0.7 < sum(i == 12 for i, _, _ in hidden) / len(hidden) < 0.9


def test_decoding_cut(spark):
    df = spark.createDataFrame([(1, [0.0, 2.0, 1.0, 2.0]), (2, []), (3, None)], "id long, v array<double>")
    got = [tuple(r) for r in runs.decoding_cut(df, "id", "v", k=3, p=0.5).orderBy("token").collect()]
    assert [r[:2] for r in got] == [(1, 1), (1, 3)] and got[0][2] == got[1][2] == pytest.approx(0.4223, abs=1e-4)
    assert [tuple(r) for r in runs.answers(df, "id", "v", {1: "one"}, "?").orderBy("id").collect()] == [(1, "one"), (2, "?"), (3, "?")]


def test_resume_points(spark):
    log = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0), (1, 3, None), (2, 1, None)], "run_id long, epoch int, valid_loss double")
    assert [tuple(r) for r in runs.resume_points(log).orderBy("run_id").collect()] == [(1, 2, 3, 1.0), (2, None, 0, None)]


def test_first_words(spark):
    table = lined(spark, " a b c d e f", " a b c d e g", "a b c d e").where(F.col("line").startswith(" "))
    assert dedup.repeated_keys(table.select(X.first_words("line").alias("k")), "k").count() == 2


@pytest.mark.parametrize("seed, hot", [(0, 200), (1, 200), (2, 200), (3, 2), (4, 1)])
def test_near_copies_lose_nothing(spark, seed, hot, monkeypatch):
    """All pairs of random line lists, compared by difflib one by one, with few and with many lines held to be hot."""
    monkeypatch.setattr(dedup, "HOT_MARK", hot)
    draw = random.Random(seed)
    base = [[draw.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(draw.randint(5, 14))] for _ in range(12)]
    texts = {}
    for lines in base:
        for _ in range(4):
            changed = list(lines)
            for _ in range(draw.randint(0, 3)):
                at = draw.randrange(len(changed))
                changed[at : at + 1] = draw.choice([[], ["new"], [changed[at], "more"]])
            texts[len(texts)] = "\n".join(changed)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    first = {}
    for k, t in texts.items():
        first.setdefault(t, k)
    wanted = set()
    for x, a in first.items():
        for y, b in first.items():
            p, q = x.splitlines(), y.splitlines()
            if a < b and len(p) + len(q) > 6 and any(0 < len(list(difflib.unified_diff(u, v, lineterm=""))) < 10 for u, v in ((p, q), (q, p))):
                wanted.add((a, b))
    assert {(r.a, r.b) for r in dedup.near_copies(df).collect()} == wanted


def test_corpus_starts_follow_the_order(spark):
    df = spark.createDataFrame([(25_000, "x"), (3, "a\nb"), (12_000, "")], "pos long, text string")
    assert [tuple(r) for r in scan.corpus_starts(df).orderBy("pos").collect()] == [(3, 0, 2), (12_000, 4, 1), (25_000, 7, 1)]


def test_results_do_not_depend_on_partitions(spark, rows):
    df = spark.createDataFrame([(i, f"line {i % 7}\nother {i % 5}") for i in range(60)], "pos long, text string")
    assert rows(training.training_set(df)) == rows(training.training_set(df.repartition(9)))


def test_only_keys_both_ways(spark, monkeypatch):
    df, keys = spark.range(100), spark.range(10)
    few = only_keys(df, keys, "id").count()
    monkeypatch.setattr("tapeloom.plans.filtering.MOST_SENT", 3)
    assert few == only_keys(df, keys, "id").count() == 10


def test_empty_tables(spark):
    texts = spark.createDataFrame([], "pos long, text string")
    table = scan.lines(texts)
    for df in (training.training_set(texts), scan.corpus_starts(texts), segment.block_split(table), dedup.near_copies(texts, "pos"), dedup.short_links(texts, "pos"), training.encoded(texts, listed(spark, "a")), training.masked(texts, listed(spark)), segment.single_lines(table), segment.block_assign(texts)):
        assert df.count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_bytes(b"x\r\n\r\n y\n")
    (tmp_path / "in" / "b.md").write_text("no")
    (tmp_path / "in" / "deep" / "s.mp3").write_bytes(b"123")
    assert [r.line for r in files.file_lines(spark, str(tmp_path / "in" / "a.txt")).orderBy("line_no").collect()] == ["x", "", " y", ""]
    assert files.document_map(spark, str(tmp_path / "in")).count() == 1
    assert [r.size_bytes for r in files.found(spark, str(tmp_path / "in")).collect()] == [3]
    blocks = spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "pos long, text string")
    files.write_corpus(blocks, str(tmp_path / "out"))
    said = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert said == "a\n\n\nb\n\n\n"
    files.write_blocks(spark.createDataFrame([(1, "n", "old"), (2, "n", "new\n\nline")], "pos long, name string, text string"), str(tmp_path / "blocks"))
    assert "".join(p.read_text() for p in (tmp_path / "blocks").glob("name=n/part-*")) == "new\nline\n"
    assert files.without(blocks, blocks.where("pos = 1"), "pos").count() == 2


def test_named_files(spark, tmp_path):
    rows = [(1, "a/n", "old"), (2, "a/n", "new\r\n\r\nline"), (3, "m", "x"), (4, None, "y"), (5, "z", None)]
    blocks = spark.createDataFrame(rows, "pos long, name string, text string")
    for _ in range(2):  # a file is replaced
        files.write_named(blocks, str(tmp_path / "last"))
    assert {str(p.relative_to(tmp_path / "last")): p.read_text() for p in (tmp_path / "last").rglob("*") if p.is_file()} == {"a/n.txt": "new\nline\n", "m.txt": "x\n"}
    files.write_named(blocks, f"file://{tmp_path}/all", keep="all")
    assert (tmp_path / "all" / "a" / "n.txt").read_text() == "old\nnew\n\nline\n"
    with pytest.raises(Exception, match="leads out"):
        files.write_named(blocks.withColumn("name", F.lit("../x")), str(tmp_path / "last"))
    files.write_named(blocks.limit(0), str(tmp_path / "none"))
    seen = files.existing(spark.createDataFrame([("a/n.txt",), ("q",), (None,)], "path string"), "path", str(tmp_path / "last"))
    assert [tuple(r) for r in seen.collect()] == [("a/n.txt", True), ("q", False), (None, False)]


def test_index_manifest_and_csv(spark, tmp_path):
    files.write_index(spark.createDataFrame([(2, 9, "b"), (1, 4, "a"), (3, None, "c")], "n long, start_line long, path string"), str(tmp_path / "index"))
    files.write_manifest(spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "path string"), str(tmp_path / "manifest"))
    said = lambda d: "".join(p.read_text() for p in sorted((tmp_path / d).glob("part-*")))
    assert said("index") == "1) 4 - a\n2) 9 - b\n" and said("manifest") == "a\nb\n"
    (tmp_path / "t.csv").write_text('name,text\nx,"one\ntwo"\ny,\n')
    assert [tuple(r) for r in files.table_of_text(spark, str(tmp_path / "t.csv"), "name string, text string").collect()] == [("x", "one\ntwo"), ("y", None)]


def test_logs(spark, tmp_path):
    made = logs.logger("a run", str(tmp_path / "deep" / "run.log"), console=50)
    made.info("begun")
    log = spark.createDataFrame([(1, 2, 0.5, None), (1, 1, 1.0, 2.0), (2, 1, 3.0, 3.0)], "run_id long, epoch int, train_loss double, valid_loss double")
    assert logs.report(log, 1) == ["epoch 1: average training loss 1.00, validation loss 2.00000", "epoch 2: average training loss 0.50, validation loss none"]
    assert (tmp_path / "deep" / "run.log").read_text().endswith("INFO begun\n")


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("a:\n  lr: 1e-5\n  n: 3\n  s: text\n")
    assert settings.load(str(tmp_path / "c.yaml")) == {"a": {"lr": 1e-5, "n": 3, "s": "text"}}


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "a\nb")], "pos long, text string").write.parquet(str(tmp_path / "in"))
    query = streams.arriving_lines(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("arrived").count() == 2


def test_staged_tables_can_be_released(spark):
    from tapeloom.plans import stage

    stage.release(spark)
    df = stage.staged(spark.range(5), "x")
    assert df.count() == 5 and stage.release(spark) == 1 and stage.release(spark) == 0
