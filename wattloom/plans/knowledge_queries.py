"""Queries of the document, retrieval and text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.functions import text as tx
from wattloom.operators import documents as dc
from wattloom.operators import retrieval as rt
from wattloom.operators import temporal as tp
from wattloom.operators.joins import spread
from wattloom.operators.models import similarity_ratio
from wattloom.plans import temporal_queries as tq
from wattloom.plans.temporal_queries import days
from wattloom.session import checkpointed
from wattloom.sources.tables import table

K, POOL = 5, 20
ABOUT = {"gefcom": "electricity load of grid zones", "household": "household electricity consumption"}


def knowledge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The master table of all granularities of zones and houses."""
    daily = days(spark, sf_dir)
    house = table(spark, sf_dir, "household").where("house_id is not null")
    resampled = {g: tp.resample(house, "datetime", ["global_active_power"], f, ["house_id"]) for g, f in (("daily", "D"), ("weekly", "W"), ("monthly", "ME"))}
    zones = {"daily": daily, "weekly": tp.weekly_stats(daily), "monthly": tp.monthly_stats(daily), "seasonal": tp.seasonal_stats(daily)}
    parts = [dc.zone_documents(tp.valid_aggregates(frame), g) for g, frame in zones.items()]
    return dc.master_kb([*parts, *[dc.house_documents(frame, g, "global_active_power") for g, frame in resampled.items()]])


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text"))


def questions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "golden_queries").select(F.col("golden_id").alias("query_id"), F.col("user_query").alias("text"))


def master_kb(spark, sf_dir):
    return knowledge_base(spark, sf_dir).select("row_id", "dataset", "granularity", "zone_id", "year", "month", "season", "parent_id")


def parent_resolution(spark, sf_dir):
    """How many documents' parents are there, by dataset and granularity."""
    kb = knowledge_base(spark, sf_dir)
    ids = kb.select(F.col("row_id").alias("parent_id"), F.lit(1).alias("there"))
    linked = kb.where("parent_id <> ''").join(ids, "parent_id", "left")
    return linked.groupBy("dataset", "granularity").agg(F.count("*").alias("children"), F.count("there").alias("resolved"))


def kb_texts(spark, sf_dir):
    """The documents as they are indexed: header and summary."""
    return dc.enriched(knowledge_base(spark, sf_dir), ABOUT).select("row_id", "text")


def dedup_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "source", F.md5("text").alias("text_md5"))
    return dc.first_by(docs, ["text_md5"], [F.col("doc_id")])


def cleaned_documents(spark, sf_dir):
    return dc.cleaned_documents(table(spark, sf_dir, "documents"), "text", ["doc_id", "lang", "source", "dataset"]).select("doc_id", "lang", "source", "dataset")


def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tx.json_field("props", "k").alias("k"), tx.json_field("props", "none").alias("absent"))


def token_counts(spark, sf_dir):
    docs = documents_of(spark, sf_dir)
    return docs.select(F.col("row_id").alias("doc_id"), tx.word_count("text").alias("words"), F.size(F.array_distinct(tx.tokens("text"))).alias("distinct_words"))


def sentence_split(spark, sf_dir):
    docs = documents_of(spark, sf_dir)
    return docs.select(F.col("row_id").alias("doc_id"), F.size(tx.sentences("text", min_words=3)).alias("sentences"), F.size(tx.sentences("text", min_chars=10)).alias("claims"))


def refusal_filter(spark, sf_dir):
    return table(spark, sf_dir, "query_results").where(tx.valid_summary("answer")).select("result_id")


def paragraph_chunks(spark, sf_dir):
    return documents_of(spark, sf_dir).select(F.col("row_id").alias("doc_id"), F.size(tx.chunks("text")).alias("chunks"))


def dense_topk(spark, sf_dir):
    """Every vector whose id is divisible by 100 against all vectors."""
    v = table(spark, sf_dir, "embeddings")
    out = rt.dense_topk(v.where("vec_id % 100 = 0"), v, "vec_id", "vec_id", "embedding", 10)
    return out.select("query_id", "row_id", F.round("score", 6).alias("score"), "rank")


def dense_documents(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    q = questions_of(spark, sf_dir).select("query_id", rt.letter_vector("text").alias("payload"))
    return rt.block_topk(q, documents_of(spark, sf_dir).select("row_id", rt.letter_vector("text").alias("payload")), rt.dot_scorer, k)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("query_id", "row_id", F.round("score", 6).alias("score"), "rank")


def dense_text(spark, sf_dir):
    return _shown(dense_documents(spark, sf_dir, K))


def bm25_topk(spark, sf_dir):
    return _shown(rt.bm25_topk(questions_of(spark, sf_dir), documents_of(spark, sf_dir), K))


def rrf_fusion(spark, sf_dir):
    sparse = rt.bm25_topk(questions_of(spark, sf_dir), documents_of(spark, sf_dir), POOL)
    return _shown(rt.rrf(dense_documents(spark, sf_dir, POOL), sparse, K, POOL))


def ensemble_fusion(spark, sf_dir):
    sparse = rt.bm25_topk(questions_of(spark, sf_dir), documents_of(spark, sf_dir), POOL)
    return _shown(rt.ensemble(dense_documents(spark, sf_dir, POOL), sparse, K))


def reranked(spark, sf_dir):
    """4 k dense candidates, scored anew by the share of the question's words that a document has."""
    score = tx.overlap_share(F.array_distinct(tx.tokens("question")), F.array_distinct(tx.tokens("document")))
    out = rt.rerank(dense_documents(spark, sf_dir, 4 * K), questions_of(spark, sf_dir), documents_of(spark, sf_dir), score, K)
    return out.select("query_id", "row_id", F.round("rerank_score", 6).alias("score"), "rank")


def stand_in_expansion(question: Column) -> Column:
    """What a model would reply that only knows to leave out the short words of a question."""
    long = F.array_join(F.filter(F.split(question, r"\s+"), lambda w: F.length(w) >= 5), " ")
    return F.concat(F.lit("KEYWORD: "), F.coalesce(long, F.lit("")))


def variant_union(spark, sf_dir):
    """Keyword lists of a question and of its expansion, united."""
    variants = rt.query_variants(questions_of(spark, sf_dir), rt.reply_variants(stand_in_expansion(F.col("text"))))
    asked = variants.select(F.concat_ws("#", "query_id", "variant").alias("query_id"), "text")
    found = rt.bm25_topk(asked, documents_of(spark, sf_dir), K)
    parts = F.split("query_id", "#")
    found = found.select(parts[0].alias("query_id"), parts[1].cast("int").alias("variant"), "row_id", "rank")
    return rt.union_variants(found).select("query_id", "row_id", "position")


def hierarchical(spark, sf_dir):
    """Dense search over the knowledge base, with parents by id or by shared words."""
    kb = checkpointed(dc.enriched(knowledge_base(spark, sf_dir), ABOUT).select("row_id", "dataset", "granularity", "parent_id", "text"))
    q = questions_of(spark, sf_dir).select("query_id", rt.letter_vector("text").alias("payload"))
    children = checkpointed(rt.block_topk(q, kb.select("row_id", rt.letter_vector("text").alias("payload")), rt.dot_scorer, K))
    return rt.with_parents(children, kb, dc.PARENT)


def overlap_parent(spark, sf_dir):
    """For every hundredth document, the other document that shares most of its words."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    words = docs.select("doc_id", rt.marked_words("text").alias("payload")).where(F.size("payload") > 1)
    q = words.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    # the best two, since one of them may be the document itself
    out = rt.block_topk(q, words.withColumnRenamed("doc_id", "row_id"), rt.overlap_scorer, 2).where("query_id <> row_id")
    return rt.ranked(out, "score", 1).select("query_id", "row_id", F.round("score", 6).alias("score"))


def context_texts(spark, sf_dir):
    """The context that a prompt would get, from the retrieved documents, with evidence tags."""
    found = rt.bm25_topk(questions_of(spark, sf_dir), documents_of(spark, sf_dir), 3)
    tagged = dc.evidence_ids(found, "query_id", "rank").join(documents_of(spark, sf_dir), "row_id")
    line = F.concat(F.lit("["), F.col("evidence_id"), F.lit("] "), F.col("text"))
    return dc.context_text(tagged, "query_id", "rank", line)


def text_similarity(spark, sf_dir):
    """Similarity ratio of each answer with its reference, for results that have both."""
    golden = table(spark, sf_dir, "golden_queries").select(F.col("golden_id").alias("query_id"), "reference_answer")
    answers = table(spark, sf_dir, "query_results").where("answer is not null").join(golden, "query_id")
    return answers.select("result_id", F.round(similarity_ratio("answer", "reference_answer"), 4).alias("ratio"))


def route_pipelines(spark, sf_dir):
    golden = table(spark, sf_dir, "golden_queries").select(F.col("golden_id").alias("query_id"), "difficulty_level")
    results = table(spark, sf_dir, "query_results").select("result_id", "query_id").join(golden, "query_id", "left")
    target = F.when(F.col("difficulty_level") == "hard", "all").when(F.col("difficulty_level") == "medium", "hierarchical").otherwise("dense")
    return rt.routed(results.withColumn("target", target), "target").select("result_id", "pipeline")


def anti_resume(spark, sf_dir):
    """Runs that a resumed experiment still has to make: those of which no result has an answer yet."""
    runs = table(spark, sf_dir, "query_results").select("exp_id", "query_id", "answer").withColumn("run", F.concat_ws("|", "exp_id", "query_id"))
    done = runs.where(F.length(F.trim("answer")) > 0)
    return dc.pending(runs.select("run").distinct(), done, "run")


def context_selection(spark, sf_dir):
    golden = table(spark, sf_dir, "golden_queries").select(F.col("golden_id").alias("query_id"), F.col("dataset_source").alias("dataset"), F.col("granularity_target").alias("granularity"))
    kb = knowledge_base(spark, sf_dir)
    return dc.select_context(kb, golden.where("dataset is not null"), 3).select("query_id", "row_id", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        master_kb, parent_resolution, kb_texts, dedup_first, cleaned_documents, json_extract, token_counts, sentence_split, refusal_filter, paragraph_chunks,
        dense_topk, dense_text, bm25_topk, rrf_fusion, ensemble_fusion, reranked, variant_union, hierarchical, overlap_parent, context_texts, text_similarity,
        route_pipelines, anti_resume, context_selection,
    )
}

_TOKENS = r"list_filter(string_split_regex(lower(coalesce({t}, '')), '\s+'), lambda w: w <> '')"
_RAW_WORDS = r"list_filter(string_split_regex(coalesce({t}, ''), '\s+'), lambda w: w <> '')"
_SENTENCES = r"list_transform(string_split(regexp_replace(trim(coalesce({t}, ''), ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' '))"
_LETTERS = "[" + ", ".join(f"CAST(length(lower({{t}})) - length(replace(lower({{t}}), '{c}', '')) AS DOUBLE)" for c in "abcdefghijklmnopqrstuvwxyz") + "]"


def _letters(source: str, ident: str, name: str, text: str) -> str:
    return f"""(SELECT {name}, list_transform(c, lambda x: x / n) AS v FROM (SELECT {ident} AS {name}, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS n
      FROM (SELECT {ident}, {_LETTERS.format(t=text)} AS c FROM {source} WHERE {text} IS NOT NULL)) WHERE n > 0)"""


_DENSE = f"""dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM (
  SELECT query_id, row_id, round(list_dot_product(q.v, d.v), 9) AS score FROM {_letters('golden_queries', 'golden_id', 'query_id', 'user_query')} q, {_letters('documents', 'doc_id', 'row_id', 'text')} d))"""
_BM25 = f"""words AS (SELECT doc_id AS row_id, {_TOKENS.format(t='text')} AS w FROM documents),
stats AS (SELECT count(*) AS docs, avg(len(w)) AS avg_len FROM words),
having_ AS (SELECT term, count(*) AS having_n FROM (SELECT unnest(list_distinct(w)) AS term FROM words) GROUP BY term),
idf0 AS (SELECT term, ln(docs - having_n + 0.5) - ln(having_n + 0.5) AS idf FROM having_, stats),
idf AS (SELECT term, CASE WHEN idf < 0 THEN (SELECT 0.25 * avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0),
tf AS (SELECT row_id, n, term, count(*) AS tf FROM (SELECT row_id, len(w) AS n, unnest(w) AS term FROM words) GROUP BY 1, 2, 3),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_TOKENS.format(t='text')}) AS term FROM questions) GROUP BY 1, 2),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM (
  SELECT query_id, row_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * n / avg_len))), 9) AS score FROM tf JOIN asked USING (term) JOIN idf USING (term), stats GROUP BY 1, 2))"""
_QUESTIONS = "questions AS (SELECT golden_id AS query_id, user_query AS text FROM golden_queries)"
_SHOW = "SELECT query_id, row_id, round(score, 6) AS score, rank FROM {t} WHERE rank <= {k}"


def _fusion(score: str) -> str:
    return f"""WITH {_QUESTIONS}, {_BM25}, {_DENSE}, fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM (
      SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.row_id, s.row_id) AS row_id, round({score}, 9) AS score
      FROM (SELECT * FROM dense WHERE rank <= {POOL}) d FULL JOIN (SELECT * FROM sparse WHERE rank <= {POOL}) s ON d.query_id = s.query_id AND d.row_id = s.row_id)) """ + _SHOW.format(t="fused", k=K)


_THURSDAY = "CAST(date_trunc('week', make_date(iso_year, 1, 4)) + INTERVAL ((iso_week - 1) * 7 + 3) DAY AS DATE)"
_KB = tq._DAYS + tq._WEEKS + tq._MONTHS + f""", seasons AS (SELECT zone_id, CAST(year(date) AS INT) AS year, {tq._SEASON.format(m='month(date)')} AS season, avg(load_mean) AS m FROM days GROUP BY 1, 2, 3),
kb AS (
SELECT 'gefcom_daily_' || zone_id || '_' || CAST(date AS VARCHAR) AS row_id, 'gefcom' AS dataset, 'daily' AS granularity, zone_id, CAST(year(date) AS VARCHAR) AS year, CAST(month(date) AS VARCHAR) AS month, '' AS season,
  'gefcom_weekly_' || zone_id || '_W' || week(date) || '_' || isoyear(date) AS parent_id FROM days WHERE load_mean > 0
UNION ALL SELECT 'gefcom_weekly_' || zone_id || '_W' || iso_week || '_' || iso_year, 'gefcom', 'weekly', zone_id, '', '', '', 'gefcom_monthly_' || zone_id || '_' || monthname({_THURSDAY}) || '_' || year({_THURSDAY}) FROM weeks WHERE weekly_mean > 0
UNION ALL SELECT 'gefcom_monthly_' || zone_id || '_' || monthname(make_date(year, month, 1)) || '_' || year, 'gefcom', 'monthly', zone_id, CAST(year AS VARCHAR), CAST(month AS VARCHAR), '', '' FROM months WHERE monthly_mean > 0
UNION ALL SELECT 'gefcom_seasonal_' || zone_id || '_' || season || '_' || year, 'gefcom', 'seasonal', zone_id, CAST(year AS VARCHAR), '', season, '' FROM seasons WHERE m > 0
UNION ALL SELECT 'household_daily_' || house_id || '_' || period_start, 'household', 'daily', '', '', '', '', 'household_weekly_' || house_id || '_' || CAST(period_start + INTERVAL (7 - isodow(period_start)) DAY AS DATE) FROM {tq._resampled('D', ('global_active_power',))}
UNION ALL SELECT 'household_weekly_' || house_id || '_' || period_start, 'household', 'weekly', '', '', '', '', 'household_monthly_' || house_id || '_' || last_day(period_start) FROM {tq._resampled('W', ('global_active_power',))}
UNION ALL SELECT 'household_monthly_' || house_id || '_' || period_start, 'household', 'monthly', '', '', '', '', '' FROM {tq._resampled('ME', ('global_active_power',))})
"""
_REFUSED = " OR ".join("contains(lower(answer), '" + p.replace("'", "''") + "')" for p in tx.REFUSALS)
ORACLE_SQL = {
    "master_kb": _KB + "SELECT * FROM kb",
    "parent_resolution": _KB + "SELECT c.dataset, c.granularity, count(*) AS children, count(p.row_id) AS resolved FROM kb c LEFT JOIN kb p ON p.row_id = c.parent_id WHERE c.parent_id <> '' GROUP BY 1, 2",
    "dedup_first": "SELECT doc_id, source, text_md5 FROM (SELECT doc_id, source, md5(text) AS text_md5, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents WHERE text IS NOT NULL) WHERE rn = 1",
    "cleaned_documents": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(dataset, '') AS dataset FROM documents WHERE length(trim(text, ' ')) > 0",
    "json_extract": "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, coalesce(json_extract_string(props, '$.none'), '') AS absent FROM events",
    "token_counts": f"SELECT doc_id, CAST(len({_RAW_WORDS.format(t='text')}) AS INT) AS words, CAST(len(list_distinct({_TOKENS.format(t='text')})) AS INT) AS distinct_words FROM documents",
    "sentence_split": f"""SELECT doc_id, CAST(len(list_filter(s, lambda x: x <> '' AND len(list_filter(string_split_regex(x, '\\s+'), lambda w: w <> '')) >= 3)) AS INT) AS sentences,
      CAST(len(list_filter(s, lambda x: length(x) > 10)) AS INT) AS claims FROM (SELECT doc_id, {_SENTENCES.format(t='text')} AS s FROM documents)""",
    "refusal_filter": f"SELECT result_id FROM query_results WHERE len({_RAW_WORDS.format(t='answer')}) >= 30 AND NOT ({_REFUSED})",
    "paragraph_chunks": "SELECT doc_id, CAST(len(list_filter(string_split(coalesce(text, ''), chr(10) || chr(10)), lambda x: trim(x, ' ') <> '')) AS INT) AS chunks FROM documents",
    "dense_topk": """SELECT query_id, row_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM (
      SELECT q.vec_id AS query_id, d.vec_id AS row_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 9) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0)) WHERE rank <= 10""",
    "dense_text": f"WITH {_DENSE} " + _SHOW.format(t="dense", k=K),
    "bm25_topk": f"WITH {_QUESTIONS}, {_BM25} " + _SHOW.format(t="sparse", k=K),
    "rrf_fusion": _fusion(f"coalesce(1.0 / (60 + d.rank - 1), CAST(1 AS DOUBLE) / {60 + POOL}) + coalesce(1.0 / (60 + s.rank - 1), CAST(1 AS DOUBLE) / {60 + POOL})"),
    "ensemble_fusion": _fusion("coalesce(0.7 / (60 + d.rank), 0) + coalesce(0.3 / (60 + s.rank), 0)"),
    "reranked": f"""WITH {_DENSE}, scored AS (SELECT d.query_id, d.row_id, d.rank AS prior, round(len(list_intersect(list_distinct(q.w), list_distinct(t.w))) / greatest(len(list_distinct(q.w)), 1), 9) AS score
      FROM dense d JOIN (SELECT golden_id, {_TOKENS.format(t='user_query')} AS w FROM golden_queries) q ON q.golden_id = d.query_id JOIN (SELECT doc_id, {_TOKENS.format(t='text')} AS w FROM documents) t ON t.doc_id = d.row_id WHERE d.rank <= {4 * K})
      SELECT query_id, row_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prior) AS rank FROM scored) WHERE rank <= {K}""",
    "variant_union": f"""WITH questions AS (SELECT golden_id || '#0' AS query_id, user_query AS text FROM golden_queries UNION ALL SELECT golden_id || '#1', v FROM (SELECT golden_id, user_query, array_to_string(list_filter(string_split_regex(user_query, '\\s+'), lambda w: length(w) >= 5), ' ') AS v FROM golden_queries) WHERE v <> '' AND v <> user_query), {_BM25},
      found AS (SELECT split_part(query_id, '#', 1) AS q, CAST(split_part(query_id, '#', 2) AS INT) AS variant, row_id, rank FROM sparse WHERE rank <= {K}),
      firsts AS (SELECT *, row_number() OVER (PARTITION BY q, row_id ORDER BY variant, rank) AS rn FROM found)
      SELECT q AS query_id, row_id, row_number() OVER (PARTITION BY q ORDER BY variant, rank) AS position FROM firsts WHERE rn = 1""",
    "overlap_parent": f"""WITH w AS (SELECT doc_id, granularity, list_distinct({_TOKENS.format(t='text')}) AS w FROM documents WHERE text IS NOT NULL)
      SELECT query_id, row_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rn FROM (
        SELECT q.doc_id AS query_id, d.doc_id AS row_id, round(len(list_intersect(q.w, d.w)) / len(q.w), 9) AS score FROM w q, w d
        WHERE q.doc_id % 100 = 0 AND q.doc_id <> d.doc_id AND len(q.w) > 0 AND len(d.w) > 0)) WHERE rn = 1""",
    "context_texts": f"""WITH {_QUESTIONS}, {_BM25} SELECT query_id, string_agg('[E' || rank || '] ' || d.text, chr(10) || chr(10) ORDER BY rank) AS context
      FROM sparse s JOIN documents d ON d.doc_id = s.row_id WHERE rank <= 3 GROUP BY 1""",
    "context_selection": _KB + """, asked AS (SELECT golden_id AS query_id, dataset_source AS dataset, granularity_target AS granularity FROM golden_queries WHERE dataset_source IS NOT NULL),
      hashed AS (SELECT row_id, dataset, granularity, md5('42|' || row_id) AS h FROM kb),
      exact AS (SELECT a.query_id, k.row_id, row_number() OVER (PARTITION BY a.query_id ORDER BY h, k.row_id) AS rank FROM asked a JOIN hashed k ON k.dataset = a.dataset AND k.granularity = a.granularity),
      wide AS (SELECT a.query_id, k.row_id, row_number() OVER (PARTITION BY a.query_id ORDER BY h, k.row_id) AS rank FROM asked a JOIN hashed k ON k.dataset = a.dataset WHERE a.query_id NOT IN (SELECT query_id FROM exact))
      SELECT * FROM exact WHERE rank <= 3 UNION ALL SELECT * FROM wide WHERE rank <= 3""",
    "route_pipelines": """SELECT result_id, unnest(CASE WHEN difficulty_level = 'hard' THEN ['dense', 'hybrid', 'hierarchical'] WHEN difficulty_level = 'medium' THEN ['dense', 'hierarchical'] ELSE ['dense'] END) AS pipeline
      FROM query_results r LEFT JOIN golden_queries g ON g.golden_id = r.query_id""",
    "anti_resume": "SELECT DISTINCT concat_ws('|', exp_id, query_id) AS run FROM query_results WHERE concat_ws('|', exp_id, query_id) NOT IN (SELECT concat_ws('|', exp_id, query_id) FROM query_results WHERE length(trim(answer, ' ')) > 0)",
}
