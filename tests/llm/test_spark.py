"""The operators on small tables: nulls, empty and long texts, repeated rows, clashing columns, empty tables; queries against their SQL."""

import os
import random

import pytest
from oracle import DATA, connect, plain
from pyspark.sql import functions as F

from tapeloom.llm import components, leaks, mixing, near, overlap, packing, pieces, registry, repetition, sentences, splits, subjects, words

WORDS = "ash bell cloud dream edge flame garden heron island journey kettle lantern meadow needle ocean pebble question river stone thread".split()


def talk(seed, n=60):
    draw = random.Random(seed)
    return " ".join(f"{draw.choice(WORDS)}{draw.randrange(40)}" for _ in range(n))


def edited(text, seed, k):
    draw, w = random.Random(seed), text.split()
    for _ in range(k):
        w[draw.randrange(len(w))] = f"changed{draw.randrange(99)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def texts(spark):
    """Copies, edits, unrelated talks, NULL, empty, blank and very long texts, repeated rows, and columns named as the operators name theirs."""
    rows = [(i, talk(i), "train", "a") for i in range(12)]
    rows += [(20, talk(0), "test", "a"), (21, edited(talk(1), 1, 2), "Val", None), (22, edited(talk(2), 2, 3), "train", "b"), (23, talk(0), "train", "b")]
    rows += [(30, None, "test", "a"), (31, "", "test", "a"), (32, " \n ", "train", None), (33, "w " * 30_000, "train", "a"), (None, talk(3), "test", "a"), (34, talk(4), None, "a")]
    rows += rows[:3]
    made = spark.createDataFrame(rows, "pos long, text string, split string, source string")
    return made.withColumns({c: F.lit(1) for c in ("id", "a", "b", "key", "size", "part", "bin", "word", "total", "eval", "rep", "n")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "pos long, text string, split string, source string, doc_id long, mp3_file_list string, lang string")


def test_near_copies(texts):
    members, links = near.similar(texts, "pos", "text", near.text_features, 0.5, 2)
    kept = {r.pos: r.text for r in texts.select("pos", "text").distinct().collect() if r.pos is not None and r.text}
    sets = {p: near.text_features(t) for p, t in kept.items()}
    wanted = {(a, b) for a in sets for b in sets if a < b and (c := words.common(sets[a], sets[b])) and c >= 0.5 * (len(sets[a]) + len(sets[b]) - c)}
    assert {tuple(r) for r in near.pairs_of(members, links).collect()} == wanted and (0, 20) in wanted and (1, 21) in wanted
    classes = {r.pos: r for r in near.classes_of(members, links).collect()}
    assert classes[23].class_id == classes[20].class_id == 0 and classes[21].class_id == 1 and classes[1].links == 1 and classes[5].links == 0


def test_hot_keys_are_refined(texts, monkeypatch):
    before = {tuple(r) for r in near.pairs_of(*near.similar(texts, "pos", "text", near.text_features, 0.5, 2)).collect()}
    monkeypatch.setattr(near, "HOT_KEY", 1)
    assert {tuple(r) for r in near.pairs_of(*near.similar(texts, "pos", "text", near.text_features, 0.5, 2)).collect()} == before


def brute_force_pairs(texts, features_of, threshold):
    sets = [(i, features_of(t)) for i, t in texts]
    return {(min(a, b), max(a, b)) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if a != b and (c := words.common(x, y)) and c >= threshold * (len(x) + len(y) - c)}


def test_hot_keys_lose_no_pair(spark, monkeypatch):
    """A passage that all rows share, a family of edits, names of one pattern: the keys they share are hot, the pairs those of brute force."""
    monkeypatch.setattr(near, "HOT_KEY", 20)
    common = talk(900, 80)
    said = [(i, common + " " + talk(i, 60 + i % 50)) for i in range(90)] + [(200 + i, edited(talk(901, 120), i, 5)) for i in range(70)]
    members, links = near.similar(spark.createDataFrame(said, "pos long, text string").repartition(3), "pos", "text", near.text_features, 0.5, 2)
    wanted = brute_force_pairs(said, near.text_features, 0.5)
    assert {tuple(r) for r in near.pairs_of(members, links).collect()} == wanted and len(wanted) > 500
    names = [(i, f"a/{'07 the bell and the river'[: 12 + i % 12]} of {talk(i, 1)[:3]}{WORDS[i % 20]}.mp3") for i in range(150)]
    members, links = near.similar(spark.createDataFrame(names, "pos long, path string"), "pos", "path", near.name_features, 0.7, 4)
    wanted = brute_force_pairs(names, near.name_features, 0.7)
    assert {tuple(r) for r in near.pairs_of(members, links).collect()} == wanted and wanted


def test_unlike_names_with_a_common_key_are_not_paired(spark, monkeypatch):
    """Names of one number and pattern share keys by chance; sketches part them, by keys and by rarest features, and lose no pair."""
    draw = random.Random(5)
    names = [(i, f"a/07 - On {' And '.join(draw.choice(WORDS) for _ in range(3))} In {draw.choice(WORDS)}.mp3") for i in range(600)]
    names += [(1000 + i, p.replace(" On ", " Off ")) for i, p in names[:20]]
    df, wanted = spark.createDataFrame(names, "pos long, path string"), brute_force_pairs(names, near.name_features, 0.7)
    rows = df.withColumnsRenamed({"pos": "id", "path": "text"})
    with_sketches, without = (near._by_rare(rows, near.name_features, 0.7, sketch).count() for sketch in (4, 0))
    assert len(wanted) <= with_sketches < without / 2
    kept = {}
    monkeypatch.setattr(near, "staged", lambda d, name, staged=near.staged: kept.setdefault(name, staged(d, name)))
    members, links = near.similar(df, "pos", "path", near.name_features, 0.7, 4, 4)
    assert {tuple(r) for r in near.pairs_of(members, links).collect()} == wanted and wanted
    few = kept.pop("pairs").count()
    kept.clear()
    near.similar(df, "pos", "path", near.name_features, 0.7, 4)
    assert few < kept["pairs"].count() / 2


def test_rarest_features_miss_no_pair(spark):
    draw = random.Random(8)
    said = [(i, edited(talk(i % 25, 40 + i % 25), i, draw.randrange(8)) + (" " + talk(700, 30) if i % 3 else "")) for i in range(140)]
    got = {tuple(r) for r in near._by_rare(spark.createDataFrame(said, "id long, text string"), near.text_features, 0.5).collect()}
    assert got >= brute_force_pairs(said, near.text_features, 0.5)


def test_components(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(3, 3), (None, 4), (100, 101), (101, 102), (102, 100)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            top[max(find(u), find(v))] = min(find(u), find(v))
    got = {r.vertex: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in list(top)}
    chain = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert components.components(chain).select("component").distinct().collect() == [(0,)]


def test_overlaps(texts):
    got = {(r.eval_pos, r.train_pos) for r in overlap.overlaps(texts).collect()}
    assert got == {(20, 0), (20, 23), (21, 1)}
    per = overlap.per_split_and_source(texts, overlap.overlaps(texts)).where("source = 'a' AND split = 'test'").first()
    assert (per.records, per.overlapping, per.pairs) == (4, 1, 2)


def against_all_runs(table):
    """The pairs by the definition, each evaluation record against each training record."""
    kept = {(r.pos, r.split == "train"): words.run_set(r.text) for r in table.collect()}
    return {(a, b) for (a, train), x in kept.items() if not train for (b, other), y in kept.items() if other and words.common(x, y) >= 0.6 * len(x) - 1e-9}


def test_overlaps_of_repetitive_records(spark):
    said = []
    for i in range(12):
        said += [(i, " ".join([talk(300 + i, 40)] * 20), "test"), (100 + i, " ".join([talk(300 + i, 40)] * 20), "train")]
        said += [(200 + i, " ".join([talk(400 + i, 40)] * 12), "test"), (300 + i, talk(400 + i, 40) + " " + talk(500 + i, 200), "train")]
    table = spark.createDataFrame(said, "pos long, text string, split string")
    wanted = against_all_runs(table)
    assert {(r.eval_pos, r.train_pos) for r in overlap.overlaps(table).collect()} == wanted and len(wanted) == 24


def test_overlaps_of_short_records(spark):
    said = []
    for i in range(40):
        short = talk(600 + i, 20 + i % 11)
        said += [(i, short, "test"), (100 + i, talk(700 + i, 30) + " " + short + " " + talk(800 + i, 30), "train"), (200 + i, edited(short, i, 1), "train")]
        said += [(300 + i, talk(900 + i, 25), "test"), (400 + i, talk(1000 + i) + " " + " ".join(talk(900 + i, 25).split()[4:21]) + " " + talk(1100 + i), "train")]
    table = spark.createDataFrame(said, "pos long, text string, split string")
    wanted = against_all_runs(table)
    assert {(r.eval_pos, r.train_pos) for r in overlap.overlaps(table).collect()} == wanted and len(wanted) > 100


def test_common_runs_have_all_holders(spark, monkeypatch):
    monkeypatch.setattr(overlap, "_HOLDERS", 2)
    table = spark.createDataFrame([(0, talk(1, 30), "test")] + [(i, talk(1, 30) + " " + talk(i, 9), "train") for i in range(1, 8)], "pos long, text string, split string")
    assert {(r.eval_pos, r.train_pos) for r in overlap.overlaps(table).collect()} == {(0, i) for i in range(1, 8)}


def test_pairs_are_counted_without_being_listed(spark):
    said = [(i, talk(i % 5, 40), "test" if i % 3 == 0 else "train") for i in range(40)] + [(i, talk(i % 5, 40) + " and more", "train") for i in range(10)] + [(50, talk(1, 40), "test"), (50, talk(1, 40), "train")]
    table = spark.createDataFrame(said, "pos long, text string, split string")
    wanted = {r.eval_pos: r["count"] for r in overlap.overlaps(table).groupBy("eval_pos").count().collect()}
    assert {r.eval_pos: r.pairs for r in overlap.pair_counts(table).collect()} == wanted and max(wanted.values()) > 5


def test_packing(texts, monkeypatch):
    monkeypatch.setattr(packing, "PART_ITEMS", 4)
    got = packing.samples(texts).toPandas()
    assert set(got.id) == {r.pos for r in texts.where("pos IS NOT NULL").select("pos").collect()}
    assert got.groupby("container")["size"].sum().max() <= 768 and sorted(got.container.unique()) == list(range(got.container.max() + 1))
    assert set(got[got.piece > 0].id) == {33} and got[got.id == 33]["size"].sum() == 30_000 and (got[got.id != 33].groupby("id").size() == 1).all()
    assert (got.groupby("container").place.max() + 1 == got.groupby("container").size()).all()


def test_repetition(texts):
    got = {r.pos: r for r in repetition.judged(texts).collect()}
    assert got[33].repetitive and sum(r.repetitive for r in got.values()) == 1 and got[30].n_words == 0 and None not in got


def test_no_repetitive_text_is_lost(spark):
    """Texts near the threshold, of which the sample that the list is learned from has none."""
    said = []
    for i in range(200):
        base = talk(i, 200).split()
        again = 0 if i < 100 else 56 + i % 50  # runs of a repeated stretch: its words less four
        said.append((i, " ".join(base + base[: again + 4] if again else base)))
    table = spark.createDataFrame(said, "pos long, text string")
    wanted = {i for i, t in said if (w := t.split()) and (n := len(w) - 4) - len({tuple(w[j : j + 5]) for j in range(n)}) >= 0.25 * n}
    for sample in (1, 10, 20_000):
        assert {r.pos for r in repetition.judged(table, sample=sample).where("repetitive").collect()} == wanted
    assert 20 < len(wanted) < 100


def test_sentences_and_pieces(spark, texts):
    long = ("A sentence that goes on for a while, as they do. " * 100).strip()
    table = spark.createDataFrame([(1, long), (1, long), (2, "Short. Text."), (3, None), (4, "x" * 4001 + ". End."), (5, "It starts\n" + "and goes on, line by line\n" * 100 + "to an end. Next one."), (None, long)], "pos long, text string")
    found = sentences.sentences(table, "pos", "text").toPandas()
    assert (found.groupby("pos").size().to_dict()) == {1: 100, 2: 2, 4: 2, 5: 2}
    cut = pieces.pieces(table, "pos", "text").orderBy("pos", "n").toPandas()
    assert set(cut.pos) == {1, 4, 5} and (cut.end_at - cut.start_at).max() <= 2000
    assert set(cut[cut.pos == 1].cut_at) == {"none", "sentence"}
    assert sorted(tuple(r) for r in pieces.oversized(table, "pos", "text").collect()) == [(4, 0), (5, 0)]


def test_leaks(spark, texts):
    docs = texts.withColumn("doc_id", F.col("pos"))
    items = spark.createDataFrame([(1, " ".join(talk(5).split()[10:40])), (2, talk(77, 30)), (3, None), (4, "too short"), (1, " ".join(talk(5).split()[10:40]))], "item_id long, text string")
    got = leaks.leaks(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.runs_shared) for r in got] == [(5, 1, 1.0)]


def test_leaks_of_many_items(texts, monkeypatch):
    docs = texts.withColumn("doc_id", F.col("pos"))
    items = texts.select(F.col("pos").alias("item_id"), "text").where("item_id < 8")
    whole = {tuple(r) for r in leaks.leaks(docs, items).collect()}
    monkeypatch.setattr(leaks, "FILTER_BITS", 8)  # a filter that lets nearly all through
    assert {tuple(r) for r in leaks.leaks(docs, items).collect()} == whole and len(whole) > 8


def test_leaks_of_items_that_repeat_themselves(spark):
    refrain, verse = talk(1, 8), talk(2, 20)
    items = spark.createDataFrame([(1, " ".join(["round and round it goes"] * 40)), (2, " ".join([refrain] * 30) + " " + verse), (3, " ".join([talk(3, 20)] * 4) + " " + talk(4, 20))], "item_id long, text string")
    docs = spark.createDataFrame([(10, talk(5) + " " + " ".join(["round and round it goes"] * 40)), (11, talk(6) + " " + verse), (12, talk(3, 20) + " " + talk(7)), (13, talk(8))], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in leaks.leaks(docs, items).collect()}
    assert set(got) == {(10, 1), (11, 2), (12, 3)}
    assert got[10, 1].runs_shared == got[10, 1].tiled == 1.0 and got[11, 2].runs_shared == pytest.approx(16 / 28) and got[11, 2].tiled < 0.25


def test_mixing(spark, texts):
    docs = texts.withColumn("doc_id", F.col("pos")).withColumn("source", F.when(F.col("source") == "a", " A").otherwise(F.col("source")))
    mix = spark.createDataFrame([("a", 0.2, 1), ("b", 0.8, 2), (None, 0.1, 1), ("none", 0.0, 3)], "source string, target_share double, max_repeats int")
    used, shares = mixing.mixed(docs, mix)
    uses, got = used.toPandas(), {r.source: r for r in shares.collect()}
    assert not got["b"].reaches and got["a"].reaches and (uses[uses.source == "b"].uses == 2).all() and uses.uses.max() <= 2
    assert uses.doc_id.is_unique and 30 in set(uses.doc_id) and sum(r.share for r in got.values()) == pytest.approx(1.0)


def test_subjects(spark):
    about = {"law": "The jury met. The verdict was read. The plaintiff left. ", "music": "The sonata ends. The cello rests. A ballad begins. "}
    docs = [(i, about["law" if i % 2 else "music"] * (1 + i % 3) + talk(i, 10)) for i in range(40)] + [(50, talk(9)), (51, "The jury met. " + talk(8)), (52, None), (None, about["law"])]
    found = subjects.subjects_of(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame([("law", "Law"), ("music", "Music"), (None, None)], "subject string, title string"),
        spark.createDataFrame([(1, " LAW"), (2, "music"), (3, None), (None, "law"), (4, "nonsense")], "doc_id long, subject string"),
    )
    assert {(r.doc_id, r.subject) for r in found.collect()} == {(i, "law" if i % 2 else "music") for i in range(40)}


def subjects_found(spark, docs, labels):
    about = spark.createDataFrame([("law",), ("music",)], "subject string")
    return {(r.doc_id, r.subject) for r in subjects.subjects_of(spark.createDataFrame(docs, "doc_id long, text string"), about, labels).collect()}


def test_subjects_learn_from_all_labels(spark):
    """24,000 labels: those that come last by hash count like the others."""
    labels = spark.range(24_000).select(F.col("id").alias("doc_id"), F.lit("law").alias("subject"))
    last = [r.doc_id for r in labels.orderBy(F.xxhash64("doc_id").desc()).limit(10).collect()]
    docs = [(i, "The zamkor rose. The zamkor fell. ") for i in [*last, 50_000]] + [(30_000 + i, "A sonata ends. A cello rests. ") for i in range(10)]
    assert subjects_found(spark, docs, labels) == {(i, "law") for i in [*last, 50_000]} | {(30_000 + i, "music") for i in range(10)}


def test_subjects_keep_all_terms(spark):
    """700 words that tell a subject, all as surely: the last by name count like the others."""
    told = [f"zam{i:03d}" for i in range(700)]
    docs = [(i, "The jury met. The verdict was read. The plaintiff left. " + " ".join(told[j % 700] for j in range(35 * i, 35 * i + 35)) + ".") for i in range(100)]
    docs += [(500, "A zam698 rose. A zam699 fell. " * 3), (501, "The sonata ends. The cello rests. " * 3)]
    assert {(500, "law"), (501, "music")} <= subjects_found(spark, docs, spark.createDataFrame([], "doc_id long, subject string"))


def test_subjects_of_many_labels_and_names(spark, monkeypatch):
    """Label and subject tables too large to send are joined by key; 10,500 subjects."""
    said = {"law": "The jury met. The verdict was read. The plaintiff left. ", "music": "The sonata ends. The cello rests. A ballad begins. "}
    docs = [(i, said["law" if i % 2 else "music"] * (1 + i % 3) + talk(i, 10)) for i in range(40)]
    labels = spark.createDataFrame([(1, "Law"), (2, "music "), (3, None)], "doc_id long, subject string")
    about = spark.createDataFrame([("law",), ("music",)] + [(f"zam {i}",) for i in range(10_500)], "subject string")
    monkeypatch.setattr("tapeloom.plans.filtering.MOST_SENT", 1)
    found = subjects.subjects_of(spark.createDataFrame(docs, "doc_id long, text string"), about, labels)
    assert {(r.doc_id, r.subject) for r in found.collect()} == {(i, "law" if i % 2 else "music") for i in range(40)}


def test_thresholds_by_running_sums(spark):
    draw = random.Random(6)
    rows = [(s, draw.uniform(0.01, 30), draw.random() < share) for s, n, share in (("law", 400, 0.7), ("music", 49, 0.5), ("sport", 50, 0.2)) for _ in range(n)]
    rows = [(s, x, y or x > 20) for s, x, y in rows]
    names = ["law", "music", "sport", "none"]
    got = lambda some: subjects.thresholds_of(spark.createDataFrame(some, "subject string, score double, told boolean"), names)
    assert got(rows) == subjects.thresholds(rows, names) and got(rows[:49]) == dict.fromkeys(names, 0.0) == got([])
    assert got([("law", 1.0, i % 2 == 0) for i in range(80)]) == dict.fromkeys(names, 1.0)


def test_splits(spark, none):
    records = spark.createDataFrame([(i, [i % 50]) for i in range(1000)] + [(2000, [1, 2]), (2001, [2, 3]), (2002, []), (2003, None), (0, [0]), (None, [5])], "id long, entities array<long>")
    groups = {r.id: r.component for r in splits.grouped(records).collect()}
    assert groups[3] == groups[2] == groups[2001] == 1 and groups[4] == 4 and 2002 not in groups
    got = {r.pos: r.split for r in splits.split_records(records).collect()}
    assert len(got) == 1004 and len({got[1], got[2], got[3], got[2000]}) == 1
    share = sum(s == "train" for s in got.values()) / len(got)
    assert 0.75 < share < 0.85 and {"train", "validation", "test"} == set(got.values())


def test_split_of_singles(spark):
    groups = spark.range(20_000).select(F.col("id").cast("string").alias("name"), F.lit(1).cast("long").alias("weight"))
    got = {r.split: r["count"] for r in splits.split_groups(groups).groupBy("split").count().collect()}
    assert abs(got["train"] - 16_000) < 10 and abs(got["test"] - 2000) < 10


def test_speakers(spark):
    speakers = spark.createDataFrame([(3, "Mirka Kessborn", "BJX"), (5, "Faro Quelleck", "BNX")], "speaker_id long, name string, shelf_code string")
    transcripts = spark.createDataFrame([(1, "x"), (2, "This is Faro Quelleck speaking. x"), (3, None), (2, "This is Faro Quelleck speaking. x")], "pos long, text string")
    manifest = spark.createDataFrame([(1, "a/b/Kessborn, Mirka/1.mp3"), (1, None), (9, "a/b/Faro Quelleck/1.mp3"), (2, "")], "pos long, mp3_file_list string")
    got = {r.id: r.entities for r in splits.known_speakers(transcripts, manifest, speakers).collect()}
    assert got == {1: [3], 2: [5], 3: []}


def test_announcements_are_learned(spark):
    speakers = [(i, f"{first} {last}", None) for i, (first, last) in enumerate((a, b) for a in ("Mirka", "Faro", "Jorun") for b in ("Kessborn", "Quelleck", "Zandwick"))]
    said = [(i, f"Welcome to the programme with {speakers[i % 9][1]}, as ever. {talk(i, 9)}") for i in range(60)]
    said += [(100 + i, f"As {speakers[(i * 5 + 1) % 9][1]} used to say, {talk(i, 9)}") for i in range(60)]
    paths = [(p, f"a/b/{speakers[p % 9][1]}/{p}.mp3") for p, _ in said if p % 2]
    made = splits.known_speakers(spark.createDataFrame(said, "pos long, text string"), spark.createDataFrame(paths, "pos long, mp3_file_list string"), spark.createDataFrame(speakers, "speaker_id long, name string, shelf_code string"))
    got = {r.id: r.entities for r in made.collect()}
    assert all(got[p] == [p % 9] for p, _ in said if p < 100 or p % 2) and all(got[p] == [] for p, _ in said if p >= 100 and p % 2 == 0)


def test_empty_tables(spark, none):
    members, links = near.similar(none, "pos", "text", near.text_features, 0.5, 2)
    items = none.select(F.col("pos").alias("item_id"), "text")
    mix = spark.createDataFrame([], "source string, target_share double, max_repeats int")
    about = spark.createDataFrame([], "subject string, title string")
    labels = spark.createDataFrame([], "doc_id long, subject string")
    speakers = spark.createDataFrame([], "speaker_id long, name string, shelf_code string")
    known = splits.known_speakers(none, none, speakers)
    for df in (
        near.pairs_of(members, links),
        near.classes_of(members, links),
        overlap.overlaps(none),
        packing.samples(none),
        repetition.judged(none),
        sentences.sentences(none, "pos", "text"),
        pieces.pieces(none, "pos", "text"),
        leaks.leaks(none, items),
        *mixing.mixed(none, mix),
        subjects.subjects_of(none, about, labels),
        splits.grouped(known),
        splits.split_records(known),
    ):
        assert df.count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries(spark, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    if name in registry.oracle_sql():
        wanted = connect().execute(registry.oracle_sql()[name]).df()
        assert plain(got) == plain(wanted)
    else:
        assert len(got.columns)
