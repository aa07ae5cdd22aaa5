"""The queries outside the optional subpackage, by name, and for each that SQL can express the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions import text as X
from tapeloom.functions import vectors as V
from tapeloom.operators import dedup, profile, quality, runs, scan, segment, training
from tapeloom.plans.prefix import numbered
from tapeloom.plans.stage import staged
from tapeloom.sources import tokenizers
from tapeloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: What many statements begin with: texts, their lines, their places in one corpus, tokens, manifest and dictionary.
_T = "t AS (SELECT DISTINCT pos, text, lang, source FROM output_final WHERE pos IS NOT NULL AND text IS NOT NULL)"
_L = _T + ", ls AS (SELECT pos, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS l FROM t), lines AS (SELECT pos, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM ls)"
_C = _L + ", starts AS (SELECT pos, CAST(sum(len(l) + 2) OVER (ORDER BY pos) - len(l) - 2 AS BIGINT) AS start_line, len(l) AS n_lines FROM ls)"
_TOKEN = "[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]"
_K = _T + f", k AS (SELECT pos, regexp_extract_all(text, '{_TOKEN}') AS w FROM t)"
_M = "m AS (SELECT DISTINCT pos, mp3_file_list AS path, size_bytes FROM mp3_file_list WHERE pos IS NOT NULL AND mp3_file_list <> '')"
_D = "d AS (SELECT DISTINCT lower(word) AS w FROM dictionary WHERE word IS NOT NULL)"
_N = _L + ", nl AS (SELECT pos, len(l) AS x FROM ls)"
_R = (
    "r AS (SELECT run_id, epoch, train_loss, valid_loss, train_time, valid_time FROM (SELECT *, row_number() OVER (PARTITION BY run_id, epoch ORDER BY "
    "valid_loss NULLS LAST, train_loss NULLS LAST, train_time, valid_time) AS rn FROM run_log WHERE run_id IS NOT NULL AND epoch IS NOT NULL) WHERE rn = 1)"
)
_I = _T + ", i AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS idx, count(*) OVER () AS n FROM t)"
_S = _L.replace("AS l FROM t)", "AS l FROM t), ls AS (SELECT pos, string_split(array_to_string(list_transform(l, lambda x, i: x || repeat(chr(10), (i - 1) % 4)), chr(10)), chr(10)) AS l FROM ls0)", 1).replace("ls AS (SELECT pos, string_split(regexp", "ls0 AS (SELECT pos, string_split(regexp", 1)
_B = _S + ", b AS (SELECT *, sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY pos ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS cum FROM lines WHERE line_no >= 1)"
_U = (
    _D + ", " + _K.replace("regexp_extract_all(text,", "regexp_extract_all(lower(text),") + ", v AS (SELECT w, row_number() OVER (ORDER BY w) + 1 AS id FROM d), "
    "f AS (SELECT pos, unnest(w) AS w, generate_subscripts(w, 1) AS place FROM k), a AS (SELECT f.pos, f.place, coalesce(v.id, 1) AS id FROM f LEFT JOIN v ON f.w = v.w), e AS (SELECT * FROM a WHERE place <= 768)"
)


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return scan.transcripts(table(spark, d, "output_final"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return scan.lines(_texts(spark, d))


def _spaced(spark: SparkSession, d: str) -> DataFrame:
    """The texts with 0 to 3 blank lines after each of their lines in turn: what the separators' operators need and the tables lack."""
    spread = F.transform(X.lines("text"), lambda line, i: F.concat(line, F.repeat(F.lit("\n"), F.pmod(i, F.lit(4)))))
    return _texts(spark, d).select("pos", F.array_join(spread, "\n").alias("text"))


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    return scan.manifest(table(spark, d, "mp3_file_list"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("pos", F.size(X.lines("text")).cast("long").alias("x"))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("pos", X.tokens("text").alias("w")).withColumn("n", F.size("w").cast("long"))


def _words(spark: SparkSession, d: str) -> DataFrame:
    return quality.dictionary(table(spark, d, "dictionary"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    return runs.run_log(table(spark, d, "run_log"))


# Scans and sinks


@_query(f"WITH {_L} SELECT pos, line_no, line FROM lines")
def scan_lines(spark, d):
    return _lines(spark, d)


@_query("SELECT doc_id, CAST(len(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) AS BIGINT) AS n_lines, CAST(length(text) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
def scan_docs(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(X.lines("text")).cast("long").alias("n_lines"), F.length("text").cast("long").alias("n"))


@_query(f"WITH {_M} SELECT pos, path FROM m WHERE path LIKE '%.mp3'")
def filter_suffix(spark, d):
    return _manifest(spark, d).where(F.col("path").endswith(".mp3")).select("pos", "path")


@_query(f"WITH {_C} SELECT pos, start_line, n_lines FROM starts")
def corpus_concat(spark, d):
    return scan.corpus_starts(_texts(spark, d))


@_query(f"WITH {_M} SELECT regexp_replace(regexp_extract(path, '[^/]*$'), '^(.+)\\.[^.]+$', '\\1') AS stem, max(pos) AS pos FROM m GROUP BY 1")
def stem_last_wins(spark, d):
    return _manifest(spark, d).groupBy(X.stem("path").alias("stem")).agg(F.max("pos").alias("pos"))


# Filters


@_query(f"WITH {_L} SELECT pos, line_no, line FROM lines WHERE line <> ''")
def filter_nonempty(spark, d):
    return _lines(spark, d).where("line <> ''")


@_query(f"WITH {_L} SELECT pos, line_no, line FROM lines WHERE regexp_matches(line, '\\S')")
def filter_nonblank(spark, d):
    return _lines(spark, d).where(F.col("line").rlike(r"\S"))


@_query(f"WITH {_K} SELECT pos, CAST(len(w) AS BIGINT) AS n FROM k WHERE len(w) < 768")
def filter_max_tokens(spark, d):
    return _tokens(spark, d).where("n < 768").select("pos", "n")


@_query(f"WITH {_C} SELECT lines.pos, start_line + line_no + 1 AS line_number FROM lines JOIN starts USING (pos) WHERE start_line + line_no BETWEEN 501 AND 6001 AND contains(lower(line), 'mountain')")
def keyword_range(spark, d):
    """Lines 500 to 6000 of the whole corpus that hold a word, as a range of line numbers is what this operator takes."""
    at = _lines(spark, d).join(scan.corpus_starts(_texts(spark, d)), "pos").withColumn("at", F.col("start_line") + F.col("line_no"))
    return at.where(F.col("at").between(501, 6001) & F.lower("line").contains("mountain")).select("pos", (F.col("at") + 1).alias("line_number"))


@_query(f"WITH {_L} SELECT pos, line_no, line FROM lines WHERE regexp_matches(line, '[^\\x00-\\x7F]')")
def non_ascii_lines(spark, d):
    return _lines(spark, d).where(X.has_non_ascii("line"))


@_query(f"WITH {_K} SELECT pos, CAST(len(w) AS BIGINT) AS n, array_to_string(w[1:10], ' ') AS first FROM k WHERE len(w) > 1000")
def long_docs(spark, d):
    return _tokens(spark, d).where("n > 1000").select("pos", "n", F.array_join(F.slice("w", 1, 10), " ").alias("first"))


@_query(f"WITH {_K} SELECT pos, CAST(len(w) AS BIGINT) AS n FROM k WHERE len(w) > 100")
def length_gt_100(spark, d):
    return _tokens(spark, d).where("n > 100").select("pos", "n")


@_query(f"WITH {_T}, {_D}, x AS (SELECT pos, unnest(regexp_extract_all(lower(text), '\\S+')) AS w FROM t) SELECT pos, pos NOT IN (SELECT pos FROM x WHERE w NOT IN (SELECT w FROM d)) AS known FROM t")
def all_words_known(spark, d):
    return quality.all_words_known(_texts(spark, d), _words(spark, d))


@_query(
    f"WITH {_L}, {_D}, x AS (SELECT pos, line_no, unnest(regexp_extract_all(lower(line), '{_TOKEN}')) AS w FROM lines) "
    "SELECT pos, line_no, count(*) AS n_unknown FROM x WHERE regexp_full_match(w, '\\p{L}+') AND w NOT IN (SELECT w FROM d) GROUP BY 1, 2"
)
def has_unknown_word(spark, d):
    return quality.unknown_rows(_lines(spark, d), _words(spark, d))


@_query(
    f"WITH {_L}, {_D}, x AS (SELECT pos, line_no, unnest(a) AS w, generate_subscripts(a, 1) AS place FROM (SELECT pos, line_no, list_transform(regexp_extract_all(line, '\\S+'), "
    "lambda y: lower(translate(y, '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', ''))) AS a FROM lines WHERE line LIKE ' %')) "
    "SELECT pos, line_no + 1 AS line_number, string_agg(w, ' ' ORDER BY place) AS words FROM x WHERE w NOT IN (SELECT w FROM d) GROUP BY 1, 2"
)
def unknown_words(spark, d):
    return quality.unknown_words(_lines(spark, d), _words(spark, d))


@_query(f"WITH {_T} SELECT pos, coalesce(lang, 'undetected') AS lang FROM t WHERE lang IS NULL OR lang <> 'en'")
def non_english(spark, d):
    return quality.not_english(_texts(spark, d))


# Projections


@_query(f"WITH {_T} SELECT pos, md5(regexp_replace(text, '([.?!]) ', '\\1' || chr(10), 'g')) AS digest FROM t")
def sentence_split(spark, d):
    return _texts(spark, d).select("pos", F.md5(X.sentence_lines("text")).alias("digest"))


@_query(f"WITH {_K} SELECT pos, CAST(len(w) AS BIGINT) AS n, md5(array_to_string(w, ' ')) AS digest FROM k")
def tokenize(spark, d):
    return _tokens(spark, d).select("pos", "n", F.md5(F.array_join("w", " ")).alias("digest"))


@_query(f"WITH {_T} SELECT pos, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS n FROM t")
def ws_tokens(spark, d):
    return _texts(spark, d).select("pos", F.size(X.blank_separated("text")).cast("long").alias("n"))


@_query(f"WITH {_T} SELECT pos, md5(lower(text)) AS digest FROM t")
def lower_text(spark, d):
    return _texts(spark, d).select("pos", F.md5(F.lower("text")).alias("digest"))


@_query(f"WITH {_T} SELECT pos, md5(translate(text, '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', '')) AS digest FROM t")
def strip_punct(spark, d):
    return _texts(spark, d).select("pos", F.md5(X.without_punctuation("text")).alias("digest"))


@_query(f"WITH {_K} SELECT pos, CAST(len(list_filter(w, lambda x: regexp_full_match(x, '\\p{{L}}+'))) AS BIGINT) AS n FROM k")
def alpha_tokens(spark, d):
    return _tokens(spark, d).select("pos", F.size(F.filter("w", X.is_alphabetic)).cast("long").alias("n"))


_INDEX = "SELECT DISTINCT n, start_line, path FROM block_index WHERE n IS NOT NULL"


@_query(f"SELECT n, n || ') ' || start_line || ' - ' || path AS row_text FROM ({_INDEX}) WHERE start_line IS NOT NULL AND path IS NOT NULL")
def index_rows(spark, d):
    rows = table(spark, d, "block_index").where("n IS NOT NULL AND start_line IS NOT NULL AND path IS NOT NULL").distinct()
    return rows.select("n", X.index_row(F.col("n"), F.col("start_line"), F.col("path")).alias("row_text"))


@_query(f"SELECT n, CASE WHEN path IS NULL THEN NULL ELSE start_line END AS line FROM ({_INDEX})")
def parse_index_line(spark, d):
    """The numbers that index rows were written with, read back; rows that could not be written are NULL."""
    rows = table(spark, d, "block_index").where("n IS NOT NULL").distinct().select("n", X.index_row(F.col("n"), F.col("start_line"), F.col("path")).alias("row_text"))
    return rows.select("n", X.index_line("row_text").alias("line"))


@_query(f"WITH {_M} SELECT pos, array_to_string(string_split(path, '/')[3:], '/') || '.txt' AS name FROM m")
def path_reroot(spark, d):
    return _manifest(spark, d).select("pos", X.rerooted("path").alias("name"))


@_query(f"WITH {_M} SELECT pos, regexp_replace(regexp_extract(path, '[^/]*$'), '^(.+)\\.[^.]+$', '\\1') AS stem FROM m")
def path_stem(spark, d):
    return _manifest(spark, d).select("pos", X.stem("path").alias("stem"))


_CLOCK = "(s % 86400) // 3600 || ':' || lpad(CAST((s % 3600) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0')"
_DAYS = f"CASE WHEN s // 86400 = 0 THEN '' WHEN s // 86400 = 1 THEN '1 day, ' ELSE (s // 86400) || ' days, ' END || {_CLOCK}"


@_query(f"SELECT o_orderkey, {_DAYS} AS took FROM (SELECT o_orderkey, CAST(round_even(o_totalprice, 0) AS BIGINT) AS s FROM orders)")
def format_duration(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.duration("o_totalprice").alias("took"))


_SECONDS = "coalesce(TRY_CAST(regexp_extract(c, '^(\\d+) days?, ', 1) AS BIGINT), 0) * 86400 + CAST(regexp_extract(c, '(\\d+):\\d\\d:\\d\\d$', 1) AS BIGINT) * 3600 + CAST(regexp_extract(c, ':(\\d\\d):', 1) AS BIGINT) * 60 + CAST(regexp_extract(c, ':(\\d\\d)$', 1) AS BIGINT)"


@_query(f"WITH {_R}, x AS (SELECT run_id, CAST(sum({_SECONDS.replace('(c,', '(train_time,')}) AS BIGINT) AS s FROM r WHERE train_time IS NOT NULL GROUP BY run_id) SELECT run_id, {_DAYS} AS took FROM x")
def run_durations(spark, d):
    """The whole training time of each run, read from and written in the log's notation."""
    return _log(spark, d).where("train_time IS NOT NULL").groupBy("run_id").agg(F.sum(X.seconds("train_time")).alias("s")).select("run_id", X.duration("s").alias("took"))


@_query(f"WITH {_T} SELECT pos, md5('<|startoftext|>' || text || '<|endoftext|>') AS digest FROM t")
def wrap_tokens(spark, d):
    return _texts(spark, d).select("pos", F.md5(X.wrapped("text")).alias("digest"))


@_query(
    f"WITH {_U}, s AS (SELECT pos, CAST(sum(id) AS BIGINT) AS id_sum, CAST(sum(id * place) AS BIGINT) AS placed_sum, count(*) AS n_ids FROM e GROUP BY pos) "
    "SELECT t.pos, 768 AS length, coalesce(id_sum, 0) AS id_sum, coalesce(placed_sum, 0) AS placed_sum, coalesce(n_ids, 0) AS mask_sum FROM t LEFT JOIN s USING (pos)"
)
def pad_mask(spark, d):
    """Fixed-length samples: their length, the sum of the ids, with and without their places, and of the attention mask."""
    made = training.encoded(_texts(spark, d), _words(spark, d))
    placed = F.zip_with("input_ids", F.sequence(F.lit(1), F.lit(training.LENGTH)), lambda x, i: x.cast("long") * i)
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return made.select("pos", F.size("input_ids").alias("length"), add("input_ids").alias("id_sum"), add(placed).alias("placed_sum"), add("attention_mask").alias("mask_sum"))


@_query(f"WITH {_U} SELECT t.pos, CAST(768 - coalesce(c.n, 0) AS BIGINT) AS n_ignored FROM t LEFT JOIN (SELECT pos, count(*) AS n FROM e GROUP BY pos) c USING (pos)")
def label_mask(spark, d):
    made = training.encoded(_texts(spark, d), _words(spark, d))
    return made.select("pos", F.size(F.filter("labels", lambda x: x == training.IGNORED)).cast("long").alias("n_ignored"))


@_query(f"WITH {_U} SELECT t.pos, CAST(coalesce(c.s, 0) AS BIGINT) AS label_sum, CAST(768 - coalesce(c.n, 0) AS BIGINT) AS n_padding FROM t LEFT JOIN (SELECT pos, sum(id) AS s, count(*) AS n FROM e GROUP BY pos) c USING (pos)")
def padded_labels(spark, d):
    """Labels that are the ids as they are: padding counts."""
    labels = training.encoded(_texts(spark, d), _words(spark, d)).select("pos", "padded_labels")
    add = F.aggregate("padded_labels", F.lit(0).cast("long"), lambda a, x: a + x)
    return labels.select("pos", add.alias("label_sum"), F.size(F.filter("padded_labels", lambda x: x == training.PAD)).cast("long").alias("n_padding"))


@_query(f"WITH {_U} SELECT t.pos, coalesce(c.text, '') AS text FROM t LEFT JOIN (SELECT a.pos, string_agg(v.w, ' ' ORDER BY a.place) AS text FROM a JOIN v ON a.id = v.id GROUP BY a.pos) c USING (pos)")
def decode_ids(spark, d):
    """The words of whole texts back from their ids."""
    words = _words(spark, d)
    return training.decoded(training.ids(_texts(spark, d), words), words, "ids")


@_query()
def encode_gpt2(spark, d):
    """Fixed-length samples by the public byte-pair vocabulary."""
    made = training.gpt2_encoded(_texts(spark, d), tokenizers.FOLDER)
    return made.select("pos", "n_ids", F.size("input_ids").alias("length"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"))


_DRAWN = "CAST('0x' || substr(md5('42|' || pos || '|' || (place - 1)), {}, 8) AS BIGINT)"


@_query(
    f"WITH {_U}, c AS (SELECT count(*) AS k FROM d), h AS (SELECT pos, place, id, k, {_DRAWN.format(1)} % 10000 < 1500 AS hidden, {_DRAWN.format(9)} % 10 AS kind, {_DRAWN.format(17)} % k + 2 AS other FROM a, c), "
    "g AS (SELECT pos, place, CASE WHEN NOT hidden THEN id WHEN kind < 8 THEN k + 2 WHEN kind = 8 THEN other ELSE id END AS id, CASE WHEN hidden THEN id ELSE -100 END AS label, hidden FROM h) "
    "SELECT pos, count(*) AS n, count(*) FILTER (WHERE hidden) AS n_masked, CAST(sum(id * place) AS BIGINT) AS id_sum, CAST(sum(label * place) AS BIGINT) AS label_sum FROM g GROUP BY pos"
)
def mlm_mask(spark, d):
    """Samples for masked training: how many ids, how many hidden, and sums of the ids and labels by place."""
    made = training.masked(_texts(spark, d), _words(spark, d))
    placed = lambda c: F.aggregate(F.transform(c, lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    hidden = F.size(F.filter("labels", lambda x: x != training.IGNORED)).cast("long")
    return made.select("pos", F.size("input_ids").cast("long").alias("n"), hidden.alias("n_masked"), placed("input_ids").alias("id_sum"), placed("labels").alias("label_sum"))


@_query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS class_id FROM embeddings")
def argmax_vector(spark, d):
    return table(spark, d, "embeddings").select("vec_id", V.argmax("embedding").alias("class_id"))


_ANSWERS = {0: "greeting", 1: "farewell", 2: "thanks"}


@_query("SELECT vec_id, CASE label WHEN 0 THEN 'greeting' WHEN 1 THEN 'farewell' WHEN 2 THEN 'thanks' ELSE 'unknown' END AS answer FROM embeddings")
def map_default(spark, d):
    return table(spark, d, "embeddings").select("vec_id", V.looked_up("label", _ANSWERS, "unknown").alias("answer"))


@_query("SELECT doc_id, CASE WHEN length(s) < 5 THEN lpad(s, 5, ' ') ELSE s END AS said FROM (SELECT doc_id, format('{:,}', n_chars) AS s FROM documents WHERE n_chars IS NOT NULL)")
def number_format(spark, d):
    return table(spark, d, "documents").where("n_chars IS NOT NULL").select("doc_id", X.grouped_number("n_chars").alias("said"))


@_query("SELECT l_orderkey, l_linenumber, format('{:.2f}', l_extendedprice) AS two, format('{:.5f}', l_discount) AS five FROM lineitem")
def decimal_format(spark, d):
    """Numbers with two and with five decimals."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.decimals("l_extendedprice", 2).alias("two"), X.decimals("l_discount", 5).alias("five"))


@_query("SELECT vec_id, CASE list_position(embedding, list_max(embedding)) - 1 WHEN 0 THEN 'greeting' WHEN 1 THEN 'farewell' WHEN 2 THEN 'thanks' ELSE 'unknown' END AS answer FROM embeddings")
def chat_answer(spark, d):
    """The answer that belongs to the likeliest class of a vector of logits."""
    return runs.answers(table(spark, d, "embeddings"), "vec_id", "embedding", _ANSWERS, "unknown")


@_query("SELECT doc_id, coalesce(strftime(recorded_at, '%m-%d-%YT%H-%M-%S'), 'undated') AS name FROM documents WHERE doc_id IS NOT NULL")
def stamped_names(spark, d):
    """Names by time, as runs are named."""
    return table(spark, d, "documents").where("doc_id IS NOT NULL").select("doc_id", F.coalesce(X.stamped("recorded_at"), F.lit("undated")).alias("name"))


@_query("SELECT doc_id, text, lang, source FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL")
def drop_missing(spark, d):
    """Rows without a NULL in any of the columns asked for."""
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source").na.drop()


# Joins


@_query(f"WITH {_M}, x AS ({_INDEX}) SELECT m.pos, x.start_line, m.path FROM m JOIN x ON x.n - 1 = m.pos")
def positional_join(spark, d):
    blocks = table(spark, d, "block_index").where("n IS NOT NULL").distinct().select((F.col("n") - 1).alias("pos"), "start_line")
    return blocks.join(_manifest(spark, d).select("pos", "path"), "pos").select("pos", "start_line", "path")


@_query(f"WITH {_M}, x AS ({_INDEX}) SELECT x.n, x.start_line FROM x WHERE NOT EXISTS (SELECT 1 FROM m WHERE x.n - 1 = m.pos)")
def positional_overflow(spark, d):
    """Blocks that no path belongs to."""
    blocks = table(spark, d, "block_index").where("n IS NOT NULL").distinct().withColumn("pos", F.col("n") - 1)
    return blocks.join(_manifest(spark, d).select("pos"), "pos", "left_anti").select("n", "start_line")


_SORTED = "p AS (SELECT path, max(pos) AS old_idx FROM m GROUP BY path), o AS (SELECT path, old_idx, row_number() OVER (ORDER BY path) - 1 AS new_idx FROM p)"


@_query(f"WITH {_M}, {_SORTED} SELECT path, old_idx, new_idx FROM o")
def sort_remap(spark, d):
    return profile.ranked(_manifest(spark, d).groupBy("path").agg(F.max("pos").alias("old_idx")), ["path"], "new_idx").select("path", "old_idx", "new_idx")


@_query(f"WITH {_M}, {_SORTED}, {_T} SELECT o.new_idx, t.pos, md5(t.text) AS digest FROM o JOIN t ON t.pos = o.old_idx")
def reorder_blocks(spark, d):
    """The texts in the order of their sorted paths."""
    order = profile.ranked(_manifest(spark, d).groupBy("path").agg(F.max("pos").alias("pos")), ["path"], "new_idx")
    return order.join(_texts(spark, d).select("pos", F.md5("text").alias("digest")), "pos").select("new_idx", "pos", "digest")


# Copies


_DOCS = "SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL"


@_query(f"SELECT kept, removed FROM (SELECT min(doc_id) OVER (PARTITION BY text) AS kept, doc_id AS removed FROM ({_DOCS})) WHERE kept <> removed")
def exact_dup_pairs(spark, d):
    return dedup.copies(table(spark, d, "documents"), "doc_id")


@_query(f"SELECT min(doc_id) AS doc_id FROM ({_DOCS}) GROUP BY text")
def exact_dedup(spark, d):
    rows = table(spark, d, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.groupBy(F.md5("text").alias("m"), F.length("text").alias("n")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@_query(
    f"WITH {_L}, w AS (SELECT pos, line_no + 1 AS line_number, array_to_string(regexp_extract_all(line, '\\S+')[1:5], ' ') AS key FROM lines WHERE line LIKE ' %') "
    "SELECT pos, line_number, key, n FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM w) WHERE n > 1"
)
def dup_first_words(spark, d):
    rows = _lines(spark, d).where(F.col("line").startswith(" ")).select("pos", (F.col("line_no") + 1).alias("line_number"), X.first_words("line").alias("key"))
    return dedup.repeated_keys(rows, "key").select("pos", "line_number", "key", "n")


@_query(f"WITH {_L} SELECT line, pos, line_no FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY pos, line_no) AS rn FROM lines WHERE line <> '') WHERE rn = 1")
def dedup_lines(spark, d):
    return dedup.first_of_each(_lines(spark, d).where("line <> ''"), "line", ["pos", "line_no"])


_LISTED = (
    "f AS (SELECT text, min(pos) AS id FROM output_final WHERE pos IS NOT NULL AND text IS NOT NULL GROUP BY text), g AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), "
    "'[\\x{0b}\\x{0c}\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}]', chr(10), 'g'), '\\n\\z', '') AS s, text = '' AS none FROM f), "
    "h AS (SELECT id, CASE WHEN none THEN [] ELSE string_split(s, chr(10)) END AS l FROM g)"
)


@_query(f"WITH {_LISTED}, n AS (SELECT id, len(l) AS n FROM h WHERE len(l) <= 6) SELECT a.id, a.n AS n_lines, count(b.id) AS links FROM n a LEFT JOIN n b ON a.id <> b.id AND a.n + b.n <= 6 GROUP BY 1, 2")
def near_dup_short(spark, d):
    return dedup.short_links(table(spark, d, "output_final"), "pos")


@_query(
    f"WITH {_LISTED}, x AS (SELECT id, len(l) AS n, unnest(l) AS line FROM h), c AS (SELECT id, n, line, count(*) AS k FROM x GROUP BY 1, 2, 3), "
    "p AS (SELECT a.id AS a, b.id AS b, a.n + b.n - 2 * CAST(sum(least(a.k, b.k)) AS BIGINT) AS apart FROM c a JOIN c b ON a.line = b.line AND a.id < b.id AND a.n + b.n > 6 GROUP BY a.id, b.id, a.n, b.n) "
    "SELECT a, b, apart FROM p WHERE apart <= 6"
)
def near_dup_candidates(spark, d):
    return dedup.near_candidates(table(spark, d, "output_final"), "pos")


@_query()
def near_dup(spark, d):
    """Pairs of texts, over 6 lines together, whose unified difference is under ten lines; near_dup_short counts all others."""
    return dedup.near_copies(table(spark, d, "output_final"), "pos")


# Aggregations


@_query(f"WITH {_L} SELECT (SELECT count(*) FROM t) AS texts, (SELECT count(*) FROM lines) AS line_rows")
def row_count(spark, d):
    counted = _counts(spark, d)
    return counted.agg(F.count("*").alias("texts"), F.coalesce(F.sum("x"), F.lit(0)).cast("long").alias("line_rows"))


@_query(f"WITH {_N} SELECT count(x) AS n, min(x) AS least, max(x) AS most, round(avg(x), 6) AS mean, CAST(sum(x) AS BIGINT) AS total FROM nl")
def line_count_stats(spark, d):
    return profile.stats(_counts(spark, d), "x").withColumn("mean", F.round("mean", 6))


@_query(f"WITH {_N}, q AS (SELECT x, min(x) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM nl) SELECT coalesce(max(x) FILTER (WHERE x >= m), 0) AS most FROM q")
def line_count_max_quirk(spark, d):
    return profile.most_quirk(_counts(spark, d), "pos", "x")


@_query(f"WITH {_N} SELECT x, count(*) AS n FROM nl GROUP BY x")
def line_count_dist(spark, d):
    return profile.distribution(_counts(spark, d), "x")


@_query(
    f"WITH {_N}, e AS (SELECT min(x) AS lo, max(x) AS hi FROM nl), b AS (SELECT lo, unnest(range(0, CAST(ceil((hi - lo) / 10.0) AS BIGINT))) AS bin FROM e) "
    "SELECT b.bin, (2 * b.lo + 20 * b.bin + 10) // 2 AS label, (SELECT count(*) FROM nl WHERE (x - b.lo) // 10 = b.bin) AS n FROM b"
)
def line_count_hist(spark, d):
    return profile.histogram(_counts(spark, d), "x")


@_query(f"WITH {_K} SELECT round(avg(CASE WHEN len(w) > 768 THEN 1.0 ELSE 0.0 END), 9) AS long_share, round(avg(len(w)), 6) AS mean FROM k")
def length_profile(spark, d):
    return _tokens(spark, d).agg(F.round(F.avg((F.col("n") > 768).cast("double")), 9).alias("long_share"), F.round(F.avg("n"), 6).alias("mean"))


@_query(f"WITH {_M} SELECT pos, path, size_bytes FROM m WHERE size_bytes IS NOT NULL ORDER BY size_bytes, pos, path LIMIT 1")
def argmin_size(spark, d):
    least = F.min(F.struct("size_bytes", "pos", "path")).alias("s")
    return _manifest(spark, d).where("size_bytes IS NOT NULL").agg(least).where("s IS NOT NULL").select("s.pos", "s.path", "s.size_bytes")


_STEPS = "s AS (SELECT run_id, epoch, valid_loss, row_number() OVER (ORDER BY run_id, epoch) - 1 AS idx FROM r WHERE valid_loss IS NOT NULL)"


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return numbered(_log(spark, d).where("valid_loss IS NOT NULL").select("run_id", "epoch", "valid_loss"), "run_id", ["run_id", "epoch"])


@_query(f"WITH {_R}, {_STEPS} SELECT round(avg(m), 6) AS mean FROM (SELECT avg(valid_loss) AS m FROM s GROUP BY idx // 4)")
def mean_of_batch_means(spark, d):
    return profile.batch_means(_steps(spark, d), "idx", "valid_loss", 4).withColumn("mean", F.round("mean", 6))


@_query("SELECT trial_id, learning_rate, batch_size, val_loss FROM trials WHERE val_loss IS NOT NULL AND NOT isnan(val_loss) ORDER BY val_loss, trial_id, learning_rate, batch_size LIMIT 1")
def best_trial(spark, d):
    return runs.best_trial(table(spark, d, "trials"))


@_query(f"WITH {_K} SELECT count(DISTINCT x) AS n FROM (SELECT unnest(w) AS x FROM k)")
def vocab_size(spark, d):
    return _tokens(spark, d).select(F.explode("w").alias("x")).groupBy("x").agg(F.lit(1).alias("one")).agg(F.count("*").alias("n"))


# Segmentation


@_query(f"WITH {_B} SELECT pos, line_no + 2 AS start_line FROM b WHERE line = '' AND cum % 2 = 0")
def block_starts(spark, d):
    return segment.block_starts(_spaced(spark, d))


@_query(f"WITH {_B} SELECT pos, CAST(cum // 2 AS BIGINT) AS block_no, line_no, line FROM b WHERE line <> '' AND cum >= 2")
def block_assign(spark, d):
    return segment.block_assign(_spaced(spark, d))


@_query(
    f"WITH {_S}, a AS (SELECT *, sum(CASE WHEN line <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY pos ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS g FROM lines), "
    "s AS (SELECT *, CASE WHEN line = '' AND row_number() OVER (PARTITION BY pos, g, line = '' ORDER BY line_no) % 2 = 0 THEN 1 ELSE 0 END AS sep FROM a), "
    "k AS (SELECT *, coalesce(sum(sep) OVER (PARTITION BY pos ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block_no FROM s) "
    "SELECT pos, CAST(block_no AS BIGINT) AS block_no, count(*) AS n_lines, count(*) FILTER (WHERE line <> '') AS n_text FROM k GROUP BY 1, 2"
)
def block_split(spark, d):
    return segment.block_split(_spaced(spark, d))


@_query(f"WITH {_S}, c AS (SELECT pos, string_split(array_to_string(l, chr(10)), chr(10) || chr(10) || chr(10)) AS a FROM ls), x AS (SELECT pos, unnest(a) AS block, generate_subscripts(a, 1) - 1 AS block_no FROM c) SELECT pos, block_no, block FROM x WHERE block_no >= 1")
def block_literal_split(spark, d):
    return segment.block_literal(_spaced(spark, d))


@_query(f"WITH x AS ({_INDEX}), y AS (SELECT n, start_line, lead(start_line) OVER (ORDER BY n, start_line NULLS FIRST, path NULLS FIRST) - start_line AS gap FROM x) SELECT n, gap FROM y WHERE gap < 10")
def small_gaps(spark, d):
    """Neighbouring index rows whose line numbers are under ten apart, the wrong way round included."""
    rows = staged(numbered(table(spark, d, "block_index").where("n IS NOT NULL").distinct(), "n", ["n", "start_line", "path"]), "index")
    after = rows.select((F.col("idx") - 1).alias("idx"), F.col("start_line").alias("next_line"))
    return rows.join(after, "idx").withColumn("gap", F.col("next_line") - F.col("start_line")).where("gap < 10").select("n", "gap")


@_query(
    f"WITH {_S}, a AS (SELECT *, line_no - coalesce(max(CASE WHEN line <> '' THEN line_no END) OVER (PARTITION BY pos ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) - 1 AS blanks FROM lines) "
    "SELECT pos, line_no, CASE WHEN blanks = 1 THEN 'a' ELSE 'b' END AS flag FROM a WHERE line <> '' AND (blanks = 1 OR (blanks = 2 AND line NOT LIKE ' %'))"
)
def separator_check(spark, d):
    return segment.separator_check(_spaced(spark, d))


@_query(f"WITH {_S}, a AS (SELECT *, coalesce(lag(line) OVER w, '') AS p, lead(line) OVER w AS q FROM lines WINDOW w AS (PARTITION BY pos ORDER BY line_no)) SELECT pos, line_no + 1 AS line_number FROM a WHERE line <> '' AND p = '' AND q = ''")
def single_line_paras(spark, d):
    return segment.single_lines(_spaced(spark, d))


# Order, splits and batches


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    return numbered(_texts(spark, d).select("pos"), "pos", ["pos"])


@_query(f"WITH {_T} SELECT pos, md5(text) AS digest FROM t ORDER BY pos LIMIT 5")
def head_n(spark, d):
    return _texts(spark, d).select("pos", F.md5("text").alias("digest")).orderBy("pos").limit(5)


@_query(f"WITH {_T} SELECT pos, md5(text) AS digest FROM t WHERE pos = 3")
def row_at(spark, d):
    return _texts(spark, d).where("pos = 3").select("pos", F.md5("text").alias("digest"))


@_query(f"WITH {_I} SELECT pos, idx FROM i WHERE idx <= 100")
def test_slice(spark, d):
    """Test mode keeps the rows up to a label, that one included."""
    return _indexed(spark, d).where("idx <= 100")


@_query(f"WITH {_T} SELECT pos FROM t ORDER BY pos DESC LIMIT 2")
def tail_n(spark, d):
    return _texts(spark, d).select("pos").orderBy(F.desc("pos")).limit(2)


def _split(spark: SparkSession, d: str, cuts: list[tuple[str, float]], last: str) -> DataFrame:
    rows = _indexed(spark, d)
    return training.split_in_order(rows, cuts, last, rows.count()).select("pos", "split")


@_query(f"WITH {_I} SELECT pos, CASE WHEN idx < CAST(floor(n * 0.8::DOUBLE) AS BIGINT) THEN 'train' ELSE 'validation' END AS split FROM i")
def split_80_20(spark, d):
    return _split(spark, d, [("train", 0.8)], "validation")


@_query(f"WITH {_I}, c AS (SELECT *, CAST(floor(n * 0.8::DOUBLE) AS BIGINT) AS a, CAST(floor(n * 0.1::DOUBLE) AS BIGINT) AS b FROM i) SELECT pos, CASE WHEN idx < a THEN 'train' WHEN idx < a + b THEN 'validation' ELSE 'test' END AS split FROM c")
def split_80_10_10(spark, d):
    rows = _indexed(spark, d)
    n = rows.count()
    a, b = int(n * 0.8), int(n * 0.1)
    return rows.select("pos", F.when(F.col("idx") < a, "train").when(F.col("idx") < a + b, "validation").otherwise("test").alias("split"))


@_query(f"WITH {_I} SELECT pos, CASE WHEN idx < CAST(floor(n * (1 - 2 * 0.15::DOUBLE)) AS BIGINT) THEN 'train' WHEN idx < CAST(floor(n * (1 - 0.15::DOUBLE)) AS BIGINT) THEN 'validation' ELSE 'test' END AS split FROM i")
def split_70_15_15(spark, d):
    return _split(spark, d, [("train", 1 - 2 * 0.15), ("validation", 1 - 0.15)], "test")


@_query(f"WITH {_T}, r AS (SELECT pos, row_number() OVER (ORDER BY md5('42|' || pos), pos) - 1 AS idx, count(*) OVER () AS n FROM t) SELECT pos, CASE WHEN idx < CAST(floor(n * 0.9::DOUBLE) AS BIGINT) THEN 'train' ELSE 'validation' END AS split FROM r")
def split_random(spark, d):
    """90 and 10 in a hundred, exactly, drawn by digest."""
    rows = training.shuffled(_texts(spark, d).select("pos"), "pos")
    return training.split_in_order(rows, [("train", 0.9)], "validation", rows.count()).select("pos", "split")


@_query(f"WITH {_R}, {_STEPS} SELECT run_id, epoch, idx FROM s WHERE idx % 100 = 0 AND idx <> 0")
def every_nth(spark, d):
    return _steps(spark, d).where("idx % 100 = 0 AND idx <> 0").select("run_id", "epoch", "idx")


@_query(f"WITH {_I} SELECT pos, idx // 2 AS batch_id FROM i")
def batch_ids(spark, d):
    return _indexed(spark, d).select("pos", F.floor(F.col("idx") / 2).alias("batch_id"))


@_query(
    f"WITH {_R}, s AS (SELECT run_id, epoch, row_number() OVER (PARTITION BY run_id ORDER BY epoch) - 1 AS step, count(*) OVER (PARTITION BY run_id) AS total FROM r) "
    "SELECT run_id, epoch, round(1e-5 * CASE WHEN step < 3 THEN step / 3.0::DOUBLE ELSE greatest(0.0::DOUBLE, (total - step)::DOUBLE / greatest(1, total - 3)) END, 12) AS lr FROM s"
)
def lr_schedule(spark, d):
    of_run = Window.partitionBy("run_id")
    steps = _log(spark, d).select("run_id", "epoch", (F.row_number().over(of_run.orderBy("epoch")) - 1).alias("step"), F.count("*").over(of_run).alias("total"))
    return runs.schedule(steps, 3).select("run_id", "epoch", F.round("lr", 12).alias("lr"))


# Runs


@_query(f"WITH {_R} SELECT * FROM r")
def run_log(spark, d):
    return _log(spark, d)


@_query(
    f"WITH {_R}, a AS (SELECT *, min(valid_loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS n FROM r), "
    "b AS (SELECT *, valid_loss IS NOT NULL AND (m IS NULL OR valid_loss < m) AS improved FROM a), "
    "c AS (SELECT *, n - coalesce(max(CASE WHEN improved THEN n END) OVER (PARTITION BY run_id ORDER BY epoch), 0) AS waited FROM b), "
    "e AS (SELECT *, waited >= 10 AS stopped, coalesce(sum(CASE WHEN waited >= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM c) "
    "SELECT run_id, epoch, valid_loss, improved, waited, stopped FROM e WHERE s = 0"
)
def early_stopping(spark, d):
    return runs.early_stopping(_log(spark, d))


@_query(f"WITH {_R} SELECT run_id, max(epoch) FILTER (WHERE valid_loss IS NOT NULL) AS last_epoch, coalesce(max(epoch) FILTER (WHERE valid_loss IS NOT NULL) + 1, 0) AS next_epoch, min(valid_loss) AS best_loss FROM r GROUP BY run_id")
def resume_points(spark, d):
    """Where each run goes on: after its last epoch with a validation loss, from the start if it has none."""
    return runs.resume_points(_log(spark, d))


@_query(
    "WITH f AS (SELECT vec_id, unnest(embedding)::DOUBLE AS logit, generate_subscripts(embedding, 1) - 1 AS token FROM embeddings), "
    "a AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token) AS r FROM f), "
    "b AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS e FROM a WHERE r <= 50), c AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS prob FROM b), "
    "g AS (SELECT *, coalesce(sum(prob) OVER (PARTITION BY vec_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) "
    "SELECT vec_id, token, round(prob, 6) AS prob FROM g WHERE before < 0.95"
)
def topk_topp(spark, d):
    return runs.decoding_cut(table(spark, d, "embeddings"), "vec_id", "embedding").withColumn("prob", F.round("prob", 6))


@_query(
    f"WITH {_L}, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY pos, line_no) AS rn FROM lines WHERE line <> '') WHERE rn = 1), "
    f"k AS (SELECT pos, line_no, CAST(len(regexp_extract_all(line, '{_TOKEN}')) AS BIGINT) AS n_tokens FROM u), "
    "i AS (SELECT *, row_number() OVER (ORDER BY pos, line_no) - 1 AS idx, count(*) OVER () AS n FROM k WHERE n_tokens < 768) "
    "SELECT pos, line_no, n_tokens, CASE WHEN idx < CAST(floor(n * 0.8::DOUBLE) AS BIGINT) THEN 'train' ELSE 'validation' END AS split FROM i"
)
def prepare_training_set(spark, d):
    return training.training_set(_texts(spark, d))
