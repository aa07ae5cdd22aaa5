"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import leaks, mixing, near, overlap, packing, pieces, repetition, sentences, splits, subjects
from tapeloom.sources.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def _wide(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(table(spark, sf_dir, name))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts that the packing had to cut."""
    return packing.samples(_wide(spark, sf_dir, "output_final")).where("piece > 0").select(F.col("id").alias("pos")).distinct()


def p1_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample number and order for every transcript, or piece of one."""
    return packing.samples(_wide(spark, sf_dir, "output_final")).withColumnRenamed("id", "pos")


def p1_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the samples are, beside the proven least number of them."""
    return packing.summary(packing.samples(_wide(spark, sf_dir, "output_final")))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.word_counts(_wide(spark, sf_dir, "output_final"), "pos", "text")


def p1_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be packed: transcripts, words, and the samples they need by volume."""
    return packing.volume(_sizes(spark, sf_dir))


def p1_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each part its samples beside the bound that certifies them."""
    return packing.certificates(_sizes(spark, sf_dir))


def _speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.known_speakers(_wide(spark, sf_dir, "output_final"), _wide(spark, sf_dir, "mp3_file_list"), table(spark, sf_dir, "speakers"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts with a known speaker, and the smallest speaker of that speaker's group."""
    return splits.grouped(_speakers(spark, sf_dir)).select(F.col("id").alias("pos"), F.col("component").alias("group_speaker_id"))


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One split for every transcript."""
    return splits.split_records(_speakers(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of transcripts with half of their runs in common, and of paths with 0.7 of their name pieces."""
    texts = near.pairs_of(*near.similar(_wide(spark, sf_dir, "output_final"), "pos", "text", near.text_features, 0.5, 2))
    paths = near.pairs_of(*near.similar(_wide(spark, sf_dir, "mp3_file_list"), "pos", "mp3_file_list", near.name_features, 0.7, 4, 2))
    return texts.withColumn("field", F.lit("text")).unionByName(paths.withColumn("field", F.lit("path"))).select("field", "pos_a", "pos_b")


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each transcript of at least 20 words with the class of its near-copies and its number of links."""
    return near.classes_of(*near.similar(_wide(spark, sf_dir, "output_final"), "pos", "text", near.text_features, 0.5, 2))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts that say the same over and over."""
    return repetition.judged(_wide(spark, sf_dir, "output_final")).where("repetitive").select("pos")


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated share of every transcript, and the rule of the list that fired."""
    return repetition.judged(_wide(spark, sf_dir, "output_final"))


def p4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each rule of the list, the transcripts it fired on and how many of them are repetitive."""
    return repetition.by_rule(repetition.judged(_wide(spark, sf_dir, "output_final")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an evaluation and a training transcript that share 0.6 of the former's runs."""
    found = overlap.overlaps(_wide(spark, sf_dir, "output_final"))
    return found.select(F.least("eval_pos", "train_pos").alias("pos_a"), F.greatest("eval_pos", "train_pos").alias("pos_b")).distinct()


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlaps of every evaluation split and source."""
    rows = _wide(spark, sf_dir, "output_final")
    return overlap.per_split_and_source(rows, overlap.pair_counts(rows))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of more than 2,000 characters, which no cut can avoid."""
    return pieces.oversized(_wide(spark, sf_dir, "output_final"), "pos", "text")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every long transcript, in order, with their offsets."""
    return pieces.pieces(_wide(spark, sf_dir, "output_final"), "pos", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every transcript by its start."""
    return sentences.sentences(_wide(spark, sf_dir, "output_final"), "pos", "text").select("pos", "start_at")


def p7_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every transcript in order, with its offsets."""
    return sentences.sentences(_wide(spark, sf_dir, "output_final"), "pos", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain at least 0.4 of an item's runs."""
    found = leaks.leaks(_wide(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.where(F.col("runs_shared") >= leaks.SHARE - 1e-9).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items that leaked into them, with the share that tiles cover."""
    return leaks.leaks(_wide(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cannot reach their share."""
    _, shares = mixing.mixed(_wide(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return shares.where("NOT reaches").select("source")


def p9_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used."""
    return mixing.mixed(_wide(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached."""
    return mixing.mixed(_wide(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subjects_of(_wide(spark, sf_dir, "documents"), table(spark, sf_dir, "subjects"), table(spark, sf_dir, "doc_labels"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one or two subjects each document is mainly about."""
    return _subjects(spark, sf_dir).select("doc_id", "subject")


def p10_makeup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by subject."""
    return subjects.makeup(_subjects(spark, sf_dir), _wide(spark, sf_dir, "documents"))


_QUERIES = (p1_found, p1_samples, p1_fill, p1_volume, p1_bounds, p2_found, p2_splits, p3_found, p3_classes, p4_found, p4_shares, p4_rules, p5_found, p5_counts, p6_found, p6_pieces, p7_found, p7_sentences, p8_found, p8_leaks, p9_found, p9_uses, p9_shares, p10_found, p10_makeup)


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in _QUERIES}


#: Runs of five words by record, as the SQL of several queries begins.
_WORD = "[\\p{L}\\p{M}\\p{Nd}]+"
_RUNS = (
    "w AS (SELECT pos, split, regexp_extract_all(lower(text), '" + _WORD + "') AS w FROM (SELECT DISTINCT pos, text, split FROM output_final WHERE pos IS NOT NULL AND text IS NOT NULL)), "
    "every AS (SELECT pos, split, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS run, len(w) AS n_words FROM w WHERE len(w) >= 20), "
    "r AS (SELECT DISTINCT pos, split, run FROM every), n AS (SELECT pos, count(*) AS n FROM r GROUP BY pos)"
)
_NAMES = (
    "f AS (SELECT DISTINCT pos, regexp_extract(mp3_file_list, '[^/]*$') AS f FROM mp3_file_list WHERE pos IS NOT NULL AND mp3_file_list <> ''), "
    "s AS (SELECT pos, CASE WHEN contains(f, '.') THEN regexp_replace(f, '\\.[^.]*$', '') ELSE f END AS f FROM f), "
    "g AS (SELECT pos, regexp_replace(lower(f), '[^a-z0-9]', '', 'g') AS p, list_sort(list_distinct(list_transform(regexp_extract_all(f, '[0-9]+'), lambda x: CAST(x AS HUGEINT)))) AS nums FROM s), "
    "t3 AS (SELECT DISTINCT pos, nums, unnest(list_transform(range(1, len(p) - 1), lambda i: p[i:i + 2])) AS piece FROM g), n3 AS (SELECT pos, count(*) AS n FROM t3 GROUP BY pos)"
)
_SPLITS = "c AS (SELECT pos, run, CASE WHEN lower(trim(split)) = 'train' THEN 'train' WHEN lower(trim(split)) IN ('val', 'validation', 'test') THEN 'eval' END AS part FROM r)"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": "SELECT DISTINCT pos FROM output_final WHERE pos IS NOT NULL AND len(regexp_extract_all(text, '[^\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+')) > 768",
        "p1_volume": "WITH s AS (SELECT pos, max(coalesce(len(regexp_extract_all(text, '[^\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+')), 0)) AS n FROM output_final WHERE pos IS NOT NULL GROUP BY pos) "
        "SELECT count(*) AS items, CAST(coalesce(sum(n), 0) AS BIGINT) AS words, CAST(ceil(coalesce(sum(n), 0) / 768) AS BIGINT) AS volume_bound FROM s",
        # The sources that fall short do so by tokens, words or characters alike.
        "p9_found": "WITH d AS (SELECT doc_id, lower(trim(source)) AS s, max(coalesce(len(text), 0)) AS n FROM documents WHERE doc_id IS NOT NULL AND trim(source) <> '' GROUP BY 1, 2), "
        "h AS (SELECT s, sum(n) AS n FROM d GROUP BY s) SELECT m.source FROM mix_targets m LEFT JOIN h ON h.s = lower(trim(m.source)) "
        "WHERE m.target_share IS NOT NULL AND coalesce(h.n, 0) * m.max_repeats < m.target_share * (SELECT sum(n) FROM h)",
        "p3_found": f"WITH {_RUNS}, {_NAMES} "
        "SELECT 'text' AS field, a.pos AS pos_a, b.pos AS pos_b FROM r a JOIN r b ON a.run = b.run AND a.pos < b.pos JOIN n x ON x.pos = a.pos JOIN n y ON y.pos = b.pos GROUP BY a.pos, b.pos, x.n, y.n HAVING count(*) >= 0.5 * (x.n + y.n - count(*)) "
        "UNION ALL SELECT 'path', a.pos, b.pos FROM t3 a JOIN t3 b ON a.piece = b.piece AND a.nums = b.nums AND a.pos < b.pos JOIN n3 x ON x.pos = a.pos JOIN n3 y ON y.pos = b.pos GROUP BY a.pos, b.pos, x.n, y.n HAVING count(*) >= 0.7 * (x.n + y.n - count(*))",
        "p4_found": f"WITH {_RUNS} SELECT pos FROM every WHERE n_words >= 30 GROUP BY pos HAVING count(*) - count(DISTINCT run) >= 0.25 * count(*)",
        "p5_found": f"WITH {_RUNS}, {_SPLITS} SELECT DISTINCT least(a.pos, b.pos) AS pos_a, greatest(a.pos, b.pos) AS pos_b FROM (SELECT a.pos, b.pos AS other, count(*) AS k FROM c a JOIN c b ON a.run = b.run "
        "AND a.part = 'eval' AND b.part = 'train' GROUP BY 1, 2) p JOIN n ON n.pos = p.pos JOIN (SELECT pos FROM n) a ON a.pos = p.pos JOIN (SELECT pos FROM n) b ON b.pos = p.other WHERE k >= 0.6 * n.n",
        "p3_classes": f"WITH RECURSIVE {_RUNS}, h AS (SELECT pos, md5(string_agg(run, '|' ORDER BY run)) AS h FROM r GROUP BY pos), m AS (SELECT pos, min(pos) OVER (PARTITION BY h) AS rep FROM h), "
        "q AS (SELECT r.pos, r.run FROM r JOIN m ON m.pos = r.pos AND m.rep = r.pos), l AS (SELECT a.pos AS a, b.pos AS b FROM q a JOIN q b ON a.run = b.run AND a.pos < b.pos JOIN n x ON x.pos = a.pos JOIN n y ON y.pos = b.pos "
        "GROUP BY a.pos, b.pos, x.n, y.n HAVING count(*) >= 0.5 * (x.n + y.n - count(*))), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), "
        "c AS (SELECT DISTINCT rep AS v, rep AS label FROM m UNION SELECT e.b, c.label FROM c JOIN e ON e.a = c.v WHERE c.label < e.b), k AS (SELECT v, min(label) AS label FROM c GROUP BY v), d AS (SELECT a, count(*) AS n FROM e GROUP BY a) "
        "SELECT m.pos, k.label AS class_id, coalesce(d.n, 0) AS links FROM m JOIN k ON k.v = m.rep LEFT JOIN d ON d.a = m.rep",
        "p5_counts": f"WITH {_RUNS}, {_SPLITS}, p AS (SELECT p.pos AS eval_pos, count(DISTINCT other) AS pairs FROM (SELECT a.pos, b.pos AS other, count(*) AS k FROM c a JOIN c b ON a.run = b.run "
        "AND a.part = 'eval' AND b.part = 'train' GROUP BY 1, 2) p JOIN n ON n.pos = p.pos WHERE k >= 0.6 * n.n AND p.pos <> other GROUP BY 1), "
        "s AS (SELECT DISTINCT pos AS eval_pos, CASE lower(trim(split)) WHEN 'val' THEN 'validation' ELSE lower(trim(split)) END AS split, source FROM output_final) "
        "SELECT s.split, s.source, count(*) AS records, count(p.pairs) AS overlapping, CAST(coalesce(sum(p.pairs), 0) AS BIGINT) AS pairs FROM s LEFT JOIN p USING (eval_pos) WHERE s.split IN ('validation', 'test') GROUP BY 1, 2",
        "p8_found": f"WITH dw AS (SELECT DISTINCT doc_id AS id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL), "
        f"iw AS (SELECT DISTINCT item_id AS id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL), "
        "dr AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS run FROM dw), "
        "ir AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS run FROM iw), n AS (SELECT id, count(*) AS n FROM ir GROUP BY id) "
        "SELECT dr.id AS doc_id, ir.id AS item_id FROM dr JOIN ir USING (run) JOIN n ON n.id = ir.id GROUP BY dr.id, ir.id, n.n HAVING count(*) >= 0.4 * n.n",
    }
