"""The registered queries of the library and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import lexicon, routing, text as tx
from ..operators import store, text_signals as ts, verdicts
from ..operators.text_pass import read_texts
from ..sources import readers, shared
from ..streaming import rate_limit
from . import text_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def _round(column: Column | str, name: str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6).alias(name)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all signals, statistics, detected phrases, score and verdict."""
    return verdicts.add_verdict(ts.analyze_text(spread(read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")))).drop("text")


#: What a task should at least have to read, before a table is dealt out to more tasks.
TASK_BYTES = 32 << 20


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table that is too small to keep all cores busy as it is split, dealt out to all cores; those of others as they are.

    A small Parquet file is often one row group, which one task reads, however many splits are planned. The plan depends on the table's size here
    (one shuffle of a small table), the results don't.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * TASK_BYTES else rows


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.with_parts(spread(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")))


def _read_documents(spark: SparkSession, sf_dir: str, wanted: Sequence[str], *keep: str) -> DataFrame:
    """doc_id, the columns to keep, and what one pass over the texts says of the wanted names."""
    keep = ("doc_id", *keep)
    return read_texts(spread(read(spark, sf_dir, "documents").select(*dict.fromkeys((*keep, "text")))), wanted, keep=keep)


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


BASE = text_sql.base(text_sql.DOCUMENTS)
SCORED = text_sql.scored()
_STATS_SQL = ", ".join(f"round({c}, 6) AS {c}" if c in ("avg_sentence_len", "avg_word_len", "unique_ratio", "flesch_kincaid_grade", "gunning_fog_index") else f"CAST({c} AS BIGINT) AS {c}" for c in ts.STATS)


@query("text_stats", _with(BASE, f"SELECT k AS doc_id, {_STATS_SQL} FROM stats"))
def text_stats(spark, sf_dir):
    rounded = ("avg_sentence_len", "avg_word_len", "unique_ratio", "flesch_kincaid_grade", "gunning_fog_index")
    return _read_documents(spark, sf_dir, ts.STATS).select("doc_id", *[_round(n, n) if n in rounded else F.col(n) for n in ts.STATS])


@query("token_frequency", _with(BASE, "SELECT lw AS token, count(*) AS n, count(DISTINCT k) AS n_docs FROM tok GROUP BY lw"))
def token_frequency(spark, sf_dir):
    tokens = _read_documents(spark, sf_dir, ["token_counts"]).select("doc_id", F.explode("token_counts").alias("token", "c"))
    per_doc = tokens.groupBy("doc_id", "token").agg(F.sum("c").alias("c"))
    return per_doc.groupBy("token").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query("top_tokens", _with(BASE, """SELECT lang, token, n, CAST(rank AS BIGINT) AS rank FROM (
  SELECT lang, lw AS token, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, lw) AS rank
  FROM tok JOIN documents ON k = doc_id GROUP BY lang, lw) WHERE rank <= 20"""))  # fmt: skip
def top_tokens(spark, sf_dir):
    counts = _read_documents(spark, sf_dir, ["token_counts"], "lang").select("lang", F.explode("token_counts").alias("token", "c")).groupBy("lang", "token").agg(F.sum("c").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "token"))
    return counts.withColumn("rank", rank.cast("long")).where("rank <= 20")


@query("sentence_lengths", _with(BASE, "SELECT k AS doc_id, CAST(si - 1 AS BIGINT) AS pos, CAST(len(ws) AS BIGINT) AS n_words FROM sw"))
def sentence_lengths(spark, sf_dir):
    lengths = F.transform("_by_sentence", F.size)
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(lengths).alias("pos", "n_words")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("n_words").cast("long").alias("n_words"))


def _signal(name: str) -> None:
    sql = _with(BASE, f"SELECT k AS doc_id, round(x, 6) AS {name} FROM {name}")

    @query({"phrase_score": "phrase_score", "contractions_usage": "contraction_rate", "repetition_score": "repetition"}.get(name, name), sql)
    def one(spark, sf_dir):
        return _read_documents(spark, sf_dir, [name]).select("doc_id", _round(name, name))


for _name in lexicon.SIGNALS:
    _signal(_name)


#: Texts that hold phrases and contractions, which the generated documents lack.
EXAMPLES = (
    (1, "As an AI language model, I cannot provide medical advice. However, it's important to note that exercise is beneficial. Furthermore, a balanced diet is essential. In conclusion, consult a doctor. I hope this helps! Feel free to ask."),
    (2, "I'm sure you're right, but he's late and she's not. They don't know what's going on, we can't tell. It's fine, isn't it? Let's wait; there's time, and here's why: who's asking? Won't matter, wouldn't help."),
    (3, "Hello world. This is a test. One two three."),
    (4, "Let me know if you need a myriad of options. Thus, in order to utilize synergies, leverage the holistic paradigm shift. That being said, notwithstanding the plethora of caveats, it goes without saying."),
    (5, "!!! ??? ... ---"),
    (6, ""),
    (7, "Café naïve résumé — “quoted” text, it’s 2024 and COVID-19 affects B2B markets: a x 123 456 state-of-the-art."),
    (8, "The cat sat. The cat ran. The cat ate. The cat sat. The cat slept... The cat sat! agree tree syllable; the the THE and university beautiful."),
)
_EXAMPLES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{t.replace(chr(39), chr(39) * 2)}')" for i, t in EXAMPLES) + ") AS v(k, t)"
MIXED = f"{_EXAMPLES_SQL} UNION ALL SELECT 1000000 + doc_id, coalesce(text, '') FROM documents"


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = spark.createDataFrame(EXAMPLES, "item_id long, text string")
    return spread(examples.unionAll(read(spark, sf_dir, "documents").select((F.col("doc_id") + 1_000_000).alias("item_id"), "text")))


@query("phrase_hits", _with(text_sql.base(MIXED), "SELECT k AS item_id, CAST(ord AS BIGINT) AS ord, pattern FROM n JOIN phrases ON contains(low, pattern)"))
def phrase_hits(spark, sf_dir):
    order = F.create_map(*[F.lit(x) for i, _, pattern, _ in lexicon.PHRASES for x in (pattern, i)])
    found = read_texts(_mixed(spark, sf_dir), ["detected_phrases"], keep=["item_id"]).select("item_id", F.explode("detected_phrases").alias("pattern"))
    return found.select("item_id", F.element_at(order, F.col("pattern")).cast("long").alias("ord"), "pattern")


@query("signals_examples", _with(text_sql.base(MIXED), "SELECT phrase_score.k AS item_id, array_to_string(found, '|') AS found, " + ", ".join(f"round({n}.x, 6) AS {n}" for n in lexicon.SIGNALS) + f" FROM {text_sql.SIGNAL_JOINS}"))
def signals_examples(spark, sf_dir):
    rows = read_texts(_mixed(spark, sf_dir), [*lexicon.SIGNALS, "detected_phrases"], keep=["item_id"])
    return rows.select("item_id", F.array_join("detected_phrases", "|").alias("found"), *[_round(n, n) for n in lexicon.SIGNALS])


@query("ngram_entropy", _with(BASE, "SELECT k AS doc_id, CAST(size AS BIGINT) AS size, round(entropy, 6) AS entropy, kinds, repeated FROM gram_stats"))
def ngram_entropy(spark, sf_dir):
    both = F.array(*[F.struct(F.lit(n).cast("long").alias("size"), F.round(F.col(c).entropy, 6).alias("entropy"), F.col(c).kinds.alias("kinds"), F.col(c).repeated.alias("repeated")) for n, c in ((2, "bigrams"), (3, "trigrams"))])
    return _read_documents(spark, sf_dir, ["bigrams", "trigrams"]).select("doc_id", F.inline(both)).where("kinds > 0")


@query("syllables", _with(BASE, "SELECT lw AS word, CAST(min(syllables) AS BIGINT) AS syllables FROM syl GROUP BY lw"))
def syllables(spark, sf_dir):
    words = _read_documents(spark, sf_dir, ["token_counts"]).select(F.explode(F.map_keys("token_counts")).alias("word")).distinct()
    return words.select("word", tx.syllables(F.col("word")).cast("long").alias("syllables"))


@query("flesch_kincaid", _with(BASE, "SELECT k AS doc_id, round(flesch_kincaid_grade, 6) AS grade FROM stats"))
def flesch_kincaid(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", _round(tx.flesch_kincaid(F.coalesce("text", F.lit(""))), "grade"))


@query("gunning_fog", _with(BASE, "SELECT k AS doc_id, round(gunning_fog_index, 6) AS fog FROM stats"))
def gunning_fog(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", _round(tx.gunning_fog(F.coalesce("text", F.lit(""))), "fog"))


@query("signals_all", _with(BASE, "SELECT sentence_variance.k AS doc_id, " + ", ".join(f"round({n}.x, 6) AS {n}" for n in lexicon.SIGNALS) + f" FROM {text_sql.SIGNAL_JOINS}"))
def signals_all(spark, sf_dir):
    return _read_documents(spark, sf_dir, lexicon.SIGNALS).select("doc_id", *[_round(n, n) for n in lexicon.SIGNALS])


def scored_documents(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """doc_id, ai_score and the columns to keep."""
    signals = _read_documents(spark, sf_dir, lexicon.SIGNALS, *keep)
    return signals.select("doc_id", *keep, ts.weighted_score([F.col(n) for n in lexicon.SIGNALS], lexicon.preset_weights()).alias("ai_score"))


@query("score_default", _with(SCORED, "SELECT k AS doc_id, round(ai_score, 6) AS ai_score FROM scored"))
def score_default(spark, sf_dir):
    return scored_documents(spark, sf_dir).select("doc_id", _round("ai_score", "ai_score"))


@query("score_by_preset", _with(BASE, " UNION ALL ".join(f"SELECT sentence_variance.k AS doc_id, '{p}' AS preset, round({text_sql.score(w)}, 6) AS ai_score FROM {text_sql.SIGNAL_JOINS}" for p, w in lexicon.PRESETS.items())))
def score_by_preset(spark, sf_dir):
    signals = _read_documents(spark, sf_dir, lexicon.SIGNALS)
    own = [F.col(n) for n in lexicon.SIGNALS]
    rows = F.array(*[F.struct(F.lit(p).alias("preset"), F.round(ts.weighted_score(own, w), 6).alias("ai_score")) for p, w in lexicon.PRESETS.items()])
    return signals.select("doc_id", F.inline(rows))


_VERDICT = "ai_score < 0.5 AS human, round(abs(ai_score - 0.5) * 2, 6) AS confidence, CASE WHEN ai_score < 0.5 THEN 'human' ELSE 'ai' END AS verdict"


@query("verdict", _with(SCORED, f"SELECT k AS doc_id, round(ai_score, 6) AS ai_score, {_VERDICT} FROM scored"))
def verdict(spark, sf_dir):
    out = verdicts.add_verdict(scored_documents(spark, sf_dir))
    return out.select("doc_id", _round("ai_score", "ai_score"), "human", _round("confidence", "confidence"), "verdict")


@query("verdict_summary", _with(SCORED, "SELECT lang, count(*) AS total, count(*) FILTER (ai_score < 0.5) AS human_items, count(*) FILTER (ai_score >= 0.5) AS ai_items, round(avg(ai_score), 6) AS mean_score FROM scored JOIN documents ON k = doc_id GROUP BY lang"))
def verdict_summary(spark, sf_dir):
    out = verdicts.batch_summary(verdicts.add_verdict(scored_documents(spark, sf_dir, "lang")), ["lang"])
    return out.select("lang", "total", "human_items", "ai_items", _round("mean_score", "mean_score"))


BOUNDS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


@query("confidence_histogram", _with(SCORED, "SELECT le, count(*) FILTER (abs(ai_score - 0.5) * 2 <= bound) AS n FROM scored CROSS JOIN (VALUES " + ", ".join(f"('{b:g}', {b}::DOUBLE)" for b in BOUNDS) + ", ('+Inf', 'inf'::DOUBLE)) AS b(le, bound) GROUP BY le"))
def confidence_histogram(spark, sf_dir):
    return verdicts.histogram(verdicts.add_verdict(scored_documents(spark, sf_dir)), "confidence", BOUNDS)


_EVALUATION = """
e AS (SELECT source, quality = 0 AS positive, ai_score >= 0.5 AS said FROM scored JOIN documents d ON k = d.doc_id JOIN labels l ON l.doc_id = d.doc_id),
c AS (SELECT {by} count(*) FILTER (positive AND said) AS tp, count(*) FILTER (NOT positive AND NOT said) AS tn, count(*) FILTER (NOT positive AND said) AS fp, count(*) FILTER (positive AND NOT said) AS fn FROM e {group}),
m AS (SELECT *, CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn) / (tp + tn + fp + fn) * 100 ELSE 0 END AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) * 100 ELSE 0 END AS "precision", CASE WHEN tp + fn > 0 THEN tp / (tp + fn) * 100 ELSE 0 END AS recall FROM c)
SELECT {names} tp, tn, fp, fn, round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0 END, 6) AS f1 FROM m"""
_METRICS = ("accuracy", "precision", "recall", "f1")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, "ai").otherwise("human").alias("expected"))
    return verdicts.add_verdict(scored_documents(spark, sf_dir, "source").join(labels, "doc_id")).withColumnRenamed("verdict", "predicted")


@query("evaluate_labels", f"WITH {SCORED}, {_EVALUATION.format(by='', group='', names='')}")
def evaluate_labels(spark, sf_dir):
    out = verdicts.confusion(_labelled(spark, sf_dir))
    return out.select("tp", "tn", "fp", "fn", *[_round(m, m) for m in _METRICS])


@query("evaluate_by_source", f"WITH {SCORED}, {_EVALUATION.format(by='source, CAST(grouping(source) AS INTEGER) AS is_total,', group='GROUP BY ROLLUP (source)', names='source, is_total,')}")
def evaluate_by_source(spark, sf_dir):
    out = verdicts.confusion_rollup(_labelled(spark, sf_dir), "source")
    return out.select("source", "is_total", "tp", "tn", "fp", "fn", *[_round(m, m) for m in _METRICS])


@query("score_by_lang", _with(SCORED, "SELECT lang, count(*) AS n, round(avg(ai_score), 6) AS mean_score, round(min(ai_score), 6) AS min_score, round(max(ai_score), 6) AS max_score, round(stddev_pop(ai_score), 6) AS spread FROM scored JOIN documents ON k = doc_id GROUP BY lang"))
def score_by_lang(spark, sf_dir):
    s = scored_documents(spark, sf_dir, "lang").groupBy("lang")
    return s.agg(F.count(F.lit(1)).alias("n"), _round(F.avg("ai_score"), "mean_score"), _round(F.min("ai_score"), "min_score"), _round(F.max("ai_score"), "max_score"), _round(F.stddev_pop("ai_score"), "spread"))


@query("score_by_conversation_role", _with(text_sql.scored(text_sql.CONVERSATIONS), "SELECT role, count(*) AS n, round(avg(ai_score), 6) AS mean_score, count(*) FILTER (ai_score >= 0.5) AS ai_items FROM scored JOIN conversations ON k = conv_id * 100000 + turn GROUP BY role"))
def score_by_conversation_role(spark, sf_dir):
    scored = ts.analyze_text(read(spark, sf_dir, "conversations").select("role", "text"))
    return scored.groupBy("role").agg(F.count(F.lit(1)).alias("n"), _round(F.avg("ai_score"), "mean_score"), F.count_if(F.col("ai_score") >= 0.5).alias("ai_items"))


_OTHER = "CASE WHEN k % 3 = 0 THEN NULL ELSE (k % 100) / 100 END"


@query("detector_aggregate", _with(SCORED, f"SELECT k AS doc_id, round(CASE WHEN o IS NULL THEN ai_score ELSE (ai_score + o * 1.2::DOUBLE + o * o) / 3.2::DOUBLE END, 6) AS ai_score, CASE WHEN o IS NULL THEN 'local' ELSE 'custom,hive,local' END AS detectors FROM (SELECT *, {_OTHER} AS o FROM scored)"))
def detector_aggregate(spark, sf_dir):
    other = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 100 / 100)
    scores = scored_documents(spark, sf_dir).select("doc_id", F.inline(F.array(
        F.struct(F.lit("local").alias("detector"), F.col("ai_score").alias("score")), F.struct(F.lit("hive").alias("detector"), other.alias("score")), F.struct(F.lit("custom").alias("detector"), (other * other).alias("score")),
    )))
    out = verdicts.aggregate_detectors(scores, ["doc_id"])
    return out.select("doc_id", _round("ai_score", "ai_score"), F.array_join("detectors", ",").alias("detectors"))


def _extension_case(path: str) -> str:
    whens = " ".join(f"WHEN ext IN ({', '.join(repr(e) for e in listed)}) THEN '{kind}'" for kind, listed in routing.EXTENSIONS.items())
    return f"(SELECT CASE {whens} ELSE 'unknown' END FROM (SELECT lower(regexp_extract({path}, '(\\.[^./]*)$', 1)) AS ext))"


@query("content_type_by_url", f"SELECT page_id, {_extension_case('split_part(coalesce(url, chr(0)), chr(63), 1)')} AS content_type FROM pages")
def content_type_by_url(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", routing.type_of_url(F.col("url")).alias("content_type"))


#: Uploaded parts: name and MIME type.
_UPLOADS = (("a.png", "image/png"), ("b.txt", "application/octet-stream"), ("c.mp3", ""), ("d", "audio/mpeg"), ("e.pdf", "application/pdf"), ("f.jpg", "video/mp4; x=1"), ("g.WAV", None), ("", "text/html"))


@query("uploads", "SELECT filename, coalesce(CASE WHEN mime LIKE 'text/%' OR mime IN ('application/json', 'application/xml') THEN 'text' WHEN split_part(mime, '/', 1) IN ('image', 'audio', 'video') THEN split_part(mime, '/', 1) END, kind) AS content_type, CASE WHEN filename = '' THEN 'no content' END AS error FROM (SELECT filename, mime, "
       + _extension_case("filename") + " AS kind FROM (VALUES " + ", ".join(f"('{f}', " + ("NULL" if m is None else f"'{m}'") + ")" for f, m in _UPLOADS) + ") AS v(filename, mime))")
def uploads(spark, sf_dir):
    """Parts of uploads as items; the nameless one is empty."""
    rows = spark.createDataFrame([(f, m, bytearray(b"x" if f else b"")) for f, m in _UPLOADS], "filename string, mime string, data binary")
    return readers.uploads_as_items(rows).select("filename", "content_type", "error")


@query("fetched_pages", _with(text_sql.scored("SELECT page_id AS k, coalesce(html, '') AS t FROM pages"), "SELECT k AS page_id, CASE WHEN t <> '' THEN round(ai_score, 6) END AS ai_score, CASE WHEN t = '' THEN 'no content' END AS error FROM scored JOIN d USING (k)"))
def fetched_pages(spark, sf_dir):
    """Every page as a text that has been fetched from its URL, scored with its markup."""
    rows = read(spark, sf_dir, "pages").select("page_id", "url", F.lit(200).alias("status"), F.col("html").alias("body"))
    items = spread(readers.fetched_as_items(rows, "text").select("page_id", "text", "error"))
    scored = read_texts(items, lexicon.SIGNALS, keep=["page_id", "error"])
    score = ts.weighted_score([F.col(n) for n in lexicon.SIGNALS], lexicon.preset_weights())
    return scored.select("page_id", F.when(F.col("error").isNull(), F.round(score, 6)).alias("ai_score"), "error")


@query("content_hash", "SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", routing.content_hash(F.col("text")).alias("content_hash"))


@query("exact_duplicates", "SELECT sha256(coalesce(text, '')) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    hashed = read(spark, sf_dir, "documents").select("doc_id", routing.content_hash(F.col("text")).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("validate_input", """SELECT 'documents' AS origin, doc_id AS id, CASE WHEN coalesce(text, '') = '' THEN 'no content' WHEN strlen(text) < 10 THEN 'text too short' WHEN strlen(text) > 100000 THEN 'text too long' END AS error FROM documents
UNION ALL SELECT 'pages', page_id, CASE WHEN coalesce(url, '') = '' THEN 'no content' WHEN NOT regexp_matches(url, '^https?://') THEN 'invalid url' END FROM pages""")
def validate_input(spark, sf_dir):
    none = F.lit(None).cast("string")
    docs = read(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), routing.validation_error(F.col("text"), none).alias("error"))
    pages = read(spark, sf_dir, "pages").select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), routing.validation_error(none, F.col("url")).alias("error"))
    return docs.unionAll(pages)


@query("jobs_insert_lookup", _with(SCORED, f"SELECT substr(sha256(CAST(k AS VARCHAR) || chr(0) || sha256(t)), 1, 24) AS id, 'text' AS content_type, {_VERDICT.split(', CASE')[0]}, round(ai_score, 6) AS ai_score, 'local' AS detectors, sha256(t) AS content_hash FROM scored JOIN d USING (k) WHERE k % 10 = 3"))
def jobs_insert_lookup(spark, sf_dir):
    """Scored documents are inserted into a job table, which is then read: those with an id ending in 3 are looked up."""
    scored = scored_documents(spark, sf_dir, "text").withColumn("content_hash", routing.content_hash(F.col("text")))
    jobs = store.JobStore(spark, shared.new_table(spark, "jobs"))
    jobs.create(store.as_jobs(verdicts.add_verdict(scored), "doc_id"))
    wanted = read(spark, sf_dir, "documents").where("doc_id % 10 = 3").select(store.job_id(F.col("doc_id"), routing.content_hash(F.col("text"))).alias("id"))
    found = jobs.all().join(wanted, "id", "left_semi").withColumn("detectors", F.array_join("detectors", ","))
    return found.select("id", "content_type", "human", _round("confidence", "confidence"), _round("ai_score", "ai_score"), "detectors", "content_hash")


RATE_LIMIT, RATE_SECONDS = 3, 3600


@query("rate_limit", f"""
WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS client, event_id, epoch_us(ts) AS micros, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (
  SELECT client, event_id, micros, rn, micros AS window_start, CAST(1 AS BIGINT) AS place FROM e WHERE rn = 1
  UNION ALL
  SELECT e.client, e.event_id, e.micros, e.rn, CASE WHEN e.micros > r.window_start + {RATE_SECONDS * 1_000_000} THEN e.micros ELSE r.window_start END,
         CASE WHEN e.micros > r.window_start + {RATE_SECONDS * 1_000_000} THEN 1 ELSE r.place + 1 END
  FROM r JOIN e ON e.client = r.client AND e.rn = r.rn + 1)
SELECT client, event_id, micros, window_start, place, place <= {RATE_LIMIT} AS allowed, greatest(0, {RATE_LIMIT} - place) AS remaining FROM r""")
def rate_limit_events(spark, sf_dir):
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("client"), "event_id", "ts")
    return rate_limit.limit_requests(events, RATE_LIMIT, RATE_SECONDS)


_REQUESTS = (
    ("10.0.0.1, 10.0.0.2", "9.9.9.9", "1.2.3.4:80"), (" 10.0.0.3 ", None, "1.2.3.4:80"), (None, "9.9.9.9", "1.2.3.4:80"), (None, None, "1.2.3.4:8080"),
    ("", "", "[::1]:443"), (None, None, "localhost"),
)


@query("client_ip", "SELECT * FROM (VALUES (0, '10.0.0.1'), (1, '10.0.0.3'), (2, '9.9.9.9'), (3, '1.2.3.4'), (4, '::1'), (5, 'localhost')) AS v(request, ip)")
def client_ip(spark, sf_dir):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(_REQUESTS)], "request int, xff string, xri string, addr string")
    return rows.select("request", routing.client_ip(F.col("xff"), F.col("xri"), F.col("addr")).alias("ip"))


_MIMES = (("text/plain; charset=utf-8", "text"), ("application/json", "text"), ("image/svg+xml", "image"), ("TEXT/PLAIN", "text"), ("application/pdf", "unknown"), ("", "unknown"), ("audio/mpeg", "audio"), ("video/mp4", "video"), ("application/xml; q=1", "text"))


@query("mime_type", "SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{k}')" for m, k in _MIMES) + ") AS v(mime, content_type)")
def mime_type(spark, sf_dir):
    rows = spark.createDataFrame([(m,) for m, _ in _MIMES], "mime string")
    return rows.select("mime", routing.type_of_mime(F.col("mime")).alias("content_type"))


_MAGIC = (
    ("ffd8ffe000104a46", "image"), ("89504e470d0a1a0a", "image"), ("474946383961", "image"), ("524946460000000057454250", "image"), ("fffb9000", "audio"), ("49443304", "audio"),
    ("524946460000000057415645", "audio"), ("000000186674797069736f6d", "video"), ("ffd8", "unknown"), ("0000000000000000", "unknown"),
)


@query("magic_bytes", "SELECT * FROM (VALUES " + ", ".join(f"('{h}', '{k}')" for h, k in _MAGIC) + ") AS v(head, content_type)")
def magic_bytes(spark, sf_dir):
    rows = spark.createDataFrame([(h,) for h, _ in _MAGIC], "head string")
    return rows.select("head", routing.type_of_magic(F.unhex("head")).alias("content_type"))
