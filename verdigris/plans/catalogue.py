"""The queries of the search engine, each with the SQL it is held against.

Each runs over its whole tables. Scores are rounded to six digits before they
are ranked, since the engines' logarithms differ in the last bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import analysis as A
from verdigris.functions.scoring import Bm25Scorer, ColumnScorer, QlScorer, Scorer
from verdigris.operators import index as I
from verdigris.operators import search as S
from verdigris.sources import plays, store
from verdigris.sources.scratch import fresh_path

QUERY = "the of that that and disgusting"
STOPWORDS = ("the", "of", "and", "to", "in", "that", "die", "der", "und", "de", "la", "que", "le")
DIGITS = 6
TOP = 10

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- SQL pieces ---------------------------------------------------------------

_PLURAL = """CASE WHEN regexp_matches(w, '(us|ss)$') THEN w
  WHEN w LIKE '%sses' THEN left(w, length(w) - 2)
  WHEN regexp_matches(w, 'ie[ds]$') THEN left(w, length(w) - 3) || CASE WHEN length(w) > 4 THEN 'i' ELSE 'ie' END
  WHEN regexp_matches(w, '[aeiou].*[^aeiou]s$') THEN left(w, length(w) - 1) ELSE w END"""
_EED = """CASE WHEN w LIKE '%eed' AND regexp_matches(left(w, length(w) - 3), '[aeiou].*[^aeiou]') THEN left(w, length(w) - 1)
  WHEN w LIKE '%eedly' AND regexp_matches(left(w, length(w) - 5), '[aeiou].*[^aeiou]') THEN left(w, length(w) - 3) END"""
_PART = """left(w, greatest(length(w) - CASE WHEN w LIKE '%ed' THEN 2 WHEN w LIKE '%ing' THEN 3 WHEN w LIKE '%edly' THEN 4 WHEN w LIKE '%ingly' THEN 5 END, 0))"""
_ED = f"""CASE WHEN NOT regexp_matches(w, '(ed|ing|edly|ingly)$') OR NOT regexp_matches({_PART}, '[aeiou]') THEN NULL
  WHEN regexp_matches({_PART}, '(at|bl|iz)$') THEN {_PART} || 'e'
  WHEN length({_PART}) >= 2 AND right({_PART}, 1) = left(right({_PART}, 2), 1) AND right({_PART}, 1) NOT IN ('l', 's', 'z') THEN left({_PART}, length({_PART}) - 1)
  WHEN length({_PART}) < 4 THEN {_PART} || 'e' ELSE {_PART} END"""


def _terms_sql(table: str = "documents", key: str = "doc_id", text: str = "text", lower: bool = False, stop: bool = False, where: str = "true", p: str = "") -> str:
    """CTEs {p}docs (doc_id, ts) and {p}terms (doc_id, pos, term)."""
    ts = f"regexp_extract_all(coalesce({text}, ''), '[A-Za-z0-9]+')"
    if lower:
        ts = f"list_transform({ts}, lambda t: lower(t))"
    if stop:
        ts = f"list_filter({ts}, lambda t: t NOT IN ({', '.join(repr(w) for w in STOPWORDS)}))"
    return f"""{p}docs AS (SELECT {key} AS doc_id, {ts} AS ts FROM {table} WHERE {where}),
{p}toks AS (SELECT doc_id, unnest(ts) AS w, unnest(range(len(ts)))::INTEGER AS pos FROM {p}docs),
{p}once AS (SELECT doc_id, pos, {_PLURAL} AS w FROM {p}toks),
{p}terms AS (SELECT doc_id, pos, coalesce({_EED}, {_ED}, w) AS term FROM {p}once)"""


def _index_sql(**options) -> str:
    return _terms_sql(**options) + """,
postings AS MATERIALIZED (SELECT term, doc_id, count(*) AS tf FROM terms GROUP BY term, doc_id),
term_stats AS MATERIALIZED (SELECT term, count(*) AS nd, sum(tf)::BIGINT AS cf FROM postings GROUP BY term),
doc_stats AS MATERIALIZED (SELECT doc_id, doc_id::VARCHAR AS slug, len(ts)::BIGINT AS num_terms FROM docs),
corpus AS (SELECT count(*) AS nc, coalesce(sum(num_terms), 0)::BIGINT AS dc, sum(num_terms)::DOUBLE / count(*) AS avdl FROM doc_stats)"""


def _search_sql(text: str = QUERY, queries: str | None = None, **options) -> str:
    """CTE frame: a row of statistics for every candidate and query term."""
    source = queries or f"(SELECT 0 AS qid, '{text}' AS qtext)"
    return _index_sql(**options) + ",\n" + _terms_sql(source, "qid", "qtext", options.get("lower", False), options.get("stop", False), p="q") + """,
asked AS (SELECT doc_id AS query_id, term, count(*) AS qf FROM qterms GROUP BY ALL),
known AS (SELECT * FROM asked JOIN term_stats USING (term)),
cand AS (SELECT DISTINCT query_id, doc_id FROM postings JOIN known USING (term)),
frame AS (SELECT c.query_id, c.doc_id, k.term, qf, coalesce(tf, 0) AS tf, cf, nd, nc, num_terms AS dl, dc, avdl
  FROM cand c JOIN known k USING (query_id) LEFT JOIN postings p ON p.doc_id = c.doc_id AND p.term = k.term JOIN doc_stats d ON d.doc_id = c.doc_id, corpus)"""


_QL = "CASE WHEN (tf + {mu} * cf / dc) / (dl + {mu}) = 0 THEN 0.0 ELSE log10((tf + {mu} * cf / dc) / (dl + {mu})) END"
_BM25 = "log10(1.0 / ((nd + 0.5) / (nc - nd + 0.5))) * ({k1} + 1) * tf / ({k1} * ((1 - {b}) + {b} * dl / avdl) + tf) * ({k2} + 1) * qf / ({k2} + qf)"


def _scored(contribution: str, text: str = QUERY, queries: str | None = None, **options) -> str:
    """CTE scored (query_id, doc_id, score)."""
    return _search_sql(text, queries, **options) + f",\nscored AS (SELECT query_id, doc_id, round(sum({contribution}), {DIGITS}) + 0.0 AS score FROM frame GROUP BY query_id, doc_id)"


def _ql(mu: str = "1500.0::DOUBLE") -> str:
    return _QL.format(mu=mu)


def _bm25(k1: float = 1.2, k2: float = 100.0, b: float = 0.75) -> str:
    return _BM25.format(k1=f"{k1}::DOUBLE", k2=f"{k2}::DOUBLE", b=f"{b}::DOUBLE")


def _one(contribution: str, text: str = QUERY, **options) -> str:
    return f"WITH {_scored(contribution, text, **options)}\nSELECT doc_id::VARCHAR AS slug, score FROM scored"


def _top(contribution: str) -> str:
    return f"WITH {_scored(contribution)}\nSELECT row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id::VARCHAR AS slug, score FROM scored ORDER BY rank LIMIT {TOP}"


def _batch(contribution: str, queries: str, key: str) -> str:
    return f"""WITH {_scored(contribution, queries=queries)}
SELECT {key}, rank, slug, score FROM (SELECT query_id, doc_id::VARCHAR AS slug, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored) WHERE rank <= {TOP}"""


# --- Spark pieces -------------------------------------------------------------


def docs(spark: SparkSession, sf: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def built(spark: SparkSession, sf: str, **analyzer) -> I.SearchIndex:
    return I.build_index(docs(spark, sf), analyzer=A.Analyzer(**analyzer))


def one(index: I.SearchIndex, scorer: Scorer, text: str = QUERY) -> DataFrame:
    return S.search_one(index, text, scorer, digits=DIGITS)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return topk_bm25(spark, sf)


# --- tokens and stems ---------------------------------------------------------


@query(f"WITH {_terms_sql()} SELECT w AS token, count(*) AS n FROM toks GROUP BY w")
def tokenize_counts(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select(F.explode(A.AlphanumericTokenizer().tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(f"WITH {_terms_sql(lower=True)} SELECT w AS token, count(*) AS n FROM toks GROUP BY w")
def tokenize_lower_counts(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select(F.explode(A.AlphanumericTokenizer(lowercase=True).tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT c AS ch, regexp_matches(c, '^[A-Za-z0-9]$') AS tokenizable FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> ''")
def tokenizable_characters(spark: SparkSession, sf: str) -> DataFrame:
    chars = docs(spark, sf).select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").distinct()
    return chars.select("ch", A.AlphanumericTokenizer.is_tokenizable(F.col("ch")).alias("tokenizable"))


@query(f"WITH {_terms_sql()} SELECT doc_id, pos, w AS token FROM toks")
def token_positions(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.posexplode(A.AlphanumericTokenizer().tokens(F.col("text"))).alias("pos", "token"))


@query(f"WITH {_terms_sql(stop=True)} SELECT doc_id, pos, w AS token FROM toks")
def stopword_filter_positions(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.posexplode(A.Analyzer(stopper=A.Stopper(STOPWORDS)).tokens(F.col("text"))).alias("pos", "token"))


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select(F.explode(A.AlphanumericTokenizer().tokens(F.col("text"))).alias("token")).distinct()


_DISTINCT = f"WITH {_terms_sql()}, d AS (SELECT DISTINCT w FROM toks)"


@query(f"{_DISTINCT} SELECT w AS token, {_PLURAL} AS stem FROM d")
def stem_1a(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf).select("token", A.plural(F.col("token")).alias("stem"))


@query(f"{_DISTINCT} SELECT w AS token, {_EED} AS stem FROM d WHERE w LIKE '%eed' OR w LIKE '%eedly'")
def stem_2_eed(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf).where(F.col("token").rlike("eed(ly)?$")).select("token", A.eed(F.col("token")).alias("stem"))


@query(f"{_DISTINCT} SELECT w AS token, {_ED} AS stem FROM d WHERE regexp_matches(w, '(ed|ing)(ly)?$')")
def stem_2_ed(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf).where(F.col("token").rlike("(ed|ing)(ly)?$")).select("token", A.participle(F.col("token")).alias("stem"))


@query(f"{_DISTINCT}, o AS (SELECT w AS token, {_PLURAL} AS w FROM d) SELECT token, coalesce({_EED}, {_ED}, w) AS stem FROM o")
def stem_full(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf).withColumn("stem", A.plural(F.col("token"))).withColumn("stem", A.verbal(F.col("stem")))


@query(f"{_DISTINCT} SELECT w AS token, regexp_matches(w, '[aeiou]') AS has_vowel, CASE WHEN regexp_matches(w, '[aeiou]') THEN length(regexp_extract(w, '^[^aeiou]*')) ELSE -1 END::INTEGER AS first_vowel FROM d")
def stem_vowels(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf).select("token", F.col("token").rlike("[aeiou]").alias("has_vowel"), (F.regexp_instr("token", F.lit("[aeiou]")) - 1).cast("int").alias("first_vowel"))


# --- index --------------------------------------------------------------------


@query(f"WITH {_index_sql()} SELECT * FROM postings")
def postings_tf(spark: SparkSession, sf: str) -> DataFrame:
    return built(spark, sf).counts.select("term", "doc_id", "tf")


@query(f"WITH {_index_sql()} SELECT term, doc_id, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions FROM terms GROUP BY term, doc_id")
def postings_positions(spark: SparkSession, sf: str) -> DataFrame:
    return built(spark, sf).postings.select("term", "doc_id", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


@query(f"WITH {_index_sql()} SELECT * FROM term_stats")
def term_stats(spark: SparkSession, sf: str) -> DataFrame:
    return built(spark, sf).term_stats.select("term", "nd", "cf")


@query(f"WITH {_index_sql()} SELECT * FROM doc_stats")
def doc_stats(spark: SparkSession, sf: str) -> DataFrame:
    return built(spark, sf).doc_stats


@query(f"WITH {_index_sql(stop=True)} SELECT * FROM doc_stats")
def doc_stats_stopped(spark: SparkSession, sf: str) -> DataFrame:
    return built(spark, sf, stopper=A.Stopper(STOPWORDS)).doc_stats


@query(f"WITH {_index_sql()} SELECT nc, dc, round(avdl, {DIGITS}) AS avdl FROM corpus")
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return built(spark, sf).corpus.select("nc", "dc", F.round("avdl", DIGITS).alias("avdl"))


@query(f"WITH {_index_sql()} SELECT count(*) AS n_terms FROM term_stats")
def vocabulary_size(spark: SparkSession, sf: str) -> DataFrame:
    return built(spark, sf).vocabulary.agg(F.count("*").alias("n_terms"))


@query(f"WITH {_index_sql(table='pages', key='page_id', text='html')} SELECT * FROM term_stats")
def index_pages(spark: SparkSession, sf: str) -> DataFrame:
    return I.build_index(docs(spark, sf, "pages"), "page_id", "html").term_stats.select("term", "nd", "cf")


@query(f"WITH {_index_sql(table='conversations', key='conv_id * 1000 + turn')} SELECT * FROM term_stats")
def index_conversations(spark: SparkSession, sf: str) -> DataFrame:
    turns = docs(spark, sf, "conversations").withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))
    return I.build_index(turns, "key").term_stats.select("term", "nd", "cf")


@query(f"WITH {_index_sql(table='part', key='p_partkey', text='p_name', lower=True)} SELECT * FROM term_stats")
def index_parts_lowercase(spark: SparkSession, sf: str) -> DataFrame:
    return I.build_index(docs(spark, sf, "part"), "p_partkey", "p_name", A.Analyzer(A.AlphanumericTokenizer(True))).term_stats.select("term", "nd", "cf")


# --- retrieval ----------------------------------------------------------------


def _frame_sql(tail: str, text: str = QUERY) -> str:
    return f"WITH {_scored('0', text)}\n{tail}"


def _asked(spark: SparkSession, text: str = QUERY) -> DataFrame:
    return spark.createDataFrame([(0, text)], "query_id int, text string")


@query(_frame_sql("SELECT term, qf FROM asked"))
def query_terms(spark: SparkSession, sf: str) -> DataFrame:
    return S.query_terms(built(spark, sf), _asked(spark)).select("term", "qf")


@query(_frame_sql("SELECT term, qf FROM known", QUERY + " zzzunheard qqqunheard"))
def oov_pruned_query(spark: SparkSession, sf: str) -> DataFrame:
    index = built(spark, sf)
    return S.known_terms(index, S.query_terms(index, _asked(spark, QUERY + " zzzunheard qqqunheard"))).select("term", "qf")


@query(_frame_sql("SELECT doc_id FROM cand"))
def candidates_or(spark: SparkSession, sf: str) -> DataFrame:
    index = built(spark, sf)
    return S.candidates(index, S.query_terms(index, _asked(spark))).select("doc_id")


@query(_frame_sql(f"SELECT doc_id, term, qf, tf, cf, nd, nc, dl, dc, round(avdl, {DIGITS}) AS avdl FROM frame"))
def score_frame(spark: SparkSession, sf: str) -> DataFrame:
    index = built(spark, sf)
    return S.score_frame(index, S.query_terms(index, _asked(spark))).select("doc_id", "term", "qf", "tf", "cf", "nd", "nc", "dl", "dc", F.round("avdl", DIGITS).alias("avdl"))


@query(_one(_ql()))
def ql_search(spark: SparkSession, sf: str) -> DataFrame:
    return one(built(spark, sf), QlScorer())


@query(_one(_ql("100.0::DOUBLE")))
def ql_search_mu(spark: SparkSession, sf: str) -> DataFrame:
    return one(built(spark, sf), QlScorer(mu=100))


@query(_one(_ql("0.0::DOUBLE")))
def ql_mu0_guard(spark: SparkSession, sf: str) -> DataFrame:
    return one(built(spark, sf), QlScorer(mu=0))


@query(_one(_ql()))
def ql_search_dense(spark: SparkSession, sf: str) -> DataFrame:
    return one(built(spark, sf), ColumnScorer(QlScorer().contribution))


@query(_one(_bm25()))
def bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    return one(built(spark, sf), Bm25Scorer())


@query(_one(_bm25(2.0, 10.0, 0.3)))
def bm25_params(spark: SparkSession, sf: str) -> DataFrame:
    return one(built(spark, sf), Bm25Scorer(k1=2.0, k2=10.0, b=0.3))


@query(_one(_bm25(), "the of"))
def bm25_negative_idf(spark: SparkSession, sf: str) -> DataFrame:
    return one(built(spark, sf), Bm25Scorer(), "the of")


@query(_one(_bm25(k2=1.0), "disgusting the the the the"))
def bm25_qf(spark: SparkSession, sf: str) -> DataFrame:
    return one(built(spark, sf), Bm25Scorer(k2=1.0), "disgusting the the the the")


@query(_one(_bm25(), lower=True, stop=True))
def bm25_lowercase_stopped(spark: SparkSession, sf: str) -> DataFrame:
    return one(built(spark, sf, tokenizer=A.AlphanumericTokenizer(True), stopper=A.Stopper(STOPWORDS)), Bm25Scorer())


@query(_top(_ql()))
def topk_ql(spark: SparkSession, sf: str) -> DataFrame:
    return S.search(built(spark, sf), _asked(spark), QlScorer(), TOP, digits=DIGITS).select("rank", "slug", "score")


@query(_top(_bm25()))
def topk_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return S.search(built(spark, sf), _asked(spark), Bm25Scorer(), TOP, digits=DIGITS).select("rank", "slug", "score")


@query(_batch(_ql(), "(SELECT item_id AS qid, text AS qtext FROM benchmark)", "query_id"))
def batch_search_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return S.search(built(spark, sf), docs(spark, sf, "benchmark"), QlScorer(), TOP, "item_id", digits=DIGITS)


@query(_batch(_bm25(), "(SELECT item_id AS qid, text AS qtext FROM benchmark)", "query_id"))
def batch_search_benchmark_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return S.search(built(spark, sf), docs(spark, sf, "benchmark"), Bm25Scorer(), TOP, "item_id", digits=DIGITS)


@query(_batch(_bm25(), "(SELECT conv_id * 1000 + turn AS qid, text AS qtext FROM conversations)", "query_id"))
def batch_search_conversations(spark: SparkSession, sf: str) -> DataFrame:
    asked = docs(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return S.search(built(spark, sf), asked, Bm25Scorer(), TOP, digits=DIGITS)


@query(_one("tf * log10((nc::DOUBLE + 1) / nd)"))
def custom_scorer(spark: SparkSession, sf: str) -> DataFrame:
    return one(built(spark, sf), ColumnScorer(lambda: F.col("tf") * F.log10((F.col("nc") + 1.0) / F.col("nd")), dense=False))


# --- change and storage -------------------------------------------------------

_GONE = "doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"


def _without_toxic(spark: SparkSession, sf: str) -> I.SearchIndex:
    toxic = docs(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("slug"))
    return I.remove_documents(built(spark, sf), toxic)


@query("SELECT slug, slug IN (SELECT doc_id::VARCHAR FROM documents) AS present FROM (SELECT (doc_id * 3)::VARCHAR AS slug FROM documents)")
def has_document(spark: SparkSession, sf: str) -> DataFrame:
    return built(spark, sf).has_documents(docs(spark, sf).select((F.col("doc_id") * 3).cast("string").alias("slug")))


@query(f"WITH {_index_sql(where=_GONE)} SELECT nc, dc FROM corpus")
def remove_then_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _without_toxic(spark, sf).corpus.select("nc", "dc")


@query(f"WITH {_index_sql(where=_GONE)} SELECT * FROM term_stats")
def remove_then_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _without_toxic(spark, sf).term_stats.select("term", "nd", "cf")


@query(_one(_bm25(), where=_GONE))
def remove_then_search(spark: SparkSession, sf: str) -> DataFrame:
    return one(_without_toxic(spark, sf), Bm25Scorer())


_REPLACED = "(SELECT d.doc_id, CASE WHEN b.item_id IS NULL THEN d.text ELSE b.text END AS text FROM documents d LEFT JOIN benchmark b ON d.doc_id = b.item_id)"


@query(_one(_ql(), table=_REPLACED))
def overwrite_then_search(spark: SparkSession, sf: str) -> DataFrame:
    return one(I.add_documents(built(spark, sf), docs(spark, sf, "benchmark"), "item_id", allow_overwrite=True), QlScorer())


_APPENDED = "(SELECT doc_id, text FROM documents UNION ALL SELECT 1000000000 + item_id, text FROM benchmark)"


@query(f"WITH {_index_sql(table=_APPENDED)} SELECT nc, dc FROM corpus")
def append_then_stats(spark: SparkSession, sf: str) -> DataFrame:
    more = docs(spark, sf, "benchmark").select((F.lit(1_000_000_000) + F.col("item_id")).alias("doc_id"), "text")
    return I.add_documents(built(spark, sf), more).corpus.select("nc", "dc")


@query("SELECT 0::BIGINT AS nc, 0::BIGINT AS dc, 0::BIGINT AS n_terms")
def clear_then_stats(spark: SparkSession, sf: str) -> DataFrame:
    index = I.clear(built(spark, sf))
    return index.corpus.select("nc", "dc").crossJoin(index.vocabulary.agg(F.count("*").alias("n_terms")))


@query(_one(_ql()))
def parquet_roundtrip_search(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark)
    store.save(built(spark, sf), path)
    return one(store.load(spark, path), QlScorer())


@query(f"WITH {_index_sql()} SELECT * FROM postings")
def json_roundtrip_postings(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{fresh_path(spark)}.json"
    store.export_json(built(spark, sf), path)
    return store.import_json(spark, path).postings.select("term", "doc_id", "tf")


# --- text splitting -----------------------------------------------------------
# Books are made of the documents' texts, with headings and markers put between
# their sentences, in the query and its SQL alike.

_STRIPPED = r"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"
#: A text with markers of all kinds: acts, scenes, prologues, epilogues, inductions.
_PLAY = """'Contents ' || lang || chr(10) || 'ACT I' || chr(10) || 'PROLOGUE.' || chr(10)
  || replace(replace(replace(text, ', ', chr(10) || 'SCENE IV. '), '.' || chr(10), '.' || chr(10) || 'ACT II EPILOGUE.' || chr(10)), 'in ', 'INDUCTION. ')"""
_BOOK = """'THE SONNETS, THE SONNETS' || source || text || 'THE END' || chr(10) || text || lang || '*** END OF THE PROJECT GUTENBERG EBOOK' || source"""
_SHELF = """'On this shelf' || chr(10) || 'FIRST PLAY' || chr(10) || text || 'SECOND PLAY' || chr(10) || source || 'THIRD PLAY' || lang || text"""
TITLES = ("FIRST PLAY", "SECOND PLAY", "THIRD PLAY")
_MARK = r"INDUCTION\.|(?:PRO|EPI)LOGUE\.\n|SCENE [1-9VXI]+\.?\s+|ACT [VI]+"


def _sections_sql(body: str) -> str:
    """CTE found (title, pos, act, name, text) of ``body`` over documents."""
    return rf"""WITH plays AS (SELECT doc_id::VARCHAR AS title, {body} AS t FROM documents WHERE text IS NOT NULL),
cut AS (SELECT title, unnest(regexp_extract_all(t, '{_MARK}')) AS mark, unnest(regexp_split_to_array(t, '{_MARK}')[2:]) AS text, unnest(range(1, len(regexp_extract_all(t, '{_MARK}')) + 1))::INTEGER AS pos FROM plays),
headed AS (SELECT *, CASE WHEN mark LIKE 'ACT%' THEN regexp_extract(mark, 'ACT ([IV]+)', 1) END AS heading FROM cut),
acted AS (SELECT *, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY title ORDER BY pos ROWS UNBOUNDED PRECEDING), '') AS act FROM headed),
found AS (SELECT title, pos, act, CASE WHEN mark LIKE 'SCENE%' THEN regexp_extract(mark, 'SCENE ([IVX1-9]+)', 1) ELSE regexp_extract(mark, '^([A-Z]+)', 1) END AS name, text FROM acted WHERE heading IS NULL)"""


_AFTER = f"substr({_PLAY}, strpos({_PLAY}, 'PROLOGUE.'))"


def _plays(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("title"), F.expr(_PLAY).alias("text"))


@query(f"{_sections_sql(_PLAY)} SELECT * FROM found")
def etl_sections(spark: SparkSession, sf: str) -> DataFrame:
    return plays.sections(_plays(spark, sf))


@query(f"{_sections_sql(_AFTER)} SELECT * FROM found")
def etl_parse_plays(spark: SparkSession, sf: str) -> DataFrame:
    return plays.parse_plays(_plays(spark, sf))


@query(f"""{_sections_sql(_AFTER)} SELECT title, act, name, text, title AS folder,
  CASE WHEN act <> '' AND name <> '' THEN 'ACT-' || act || '-SCENE-' || name WHEN name <> '' THEN name ELSE title END || '.txt' AS file FROM found
  QUALIFY row_number() OVER (PARTITION BY folder, file ORDER BY pos DESC) = 1""")
def etl_paths(spark: SparkSession, sf: str) -> DataFrame:
    return plays.paths(plays.parse_plays(_plays(spark, sf))).select("title", "act", "name", "text", "folder", "file")


@query(f"""SELECT unnest(regexp_extract_all(t, '[0-9]+'))::INTEGER AS number, {_STRIPPED.format(x="unnest(regexp_split_to_array(t, '[0-9]+')[2:])")} AS text
  FROM (SELECT replace(regexp_replace(text, '[0-9]', '', 'g'), chr(10), chr(10) || doc_id || chr(10)) AS t FROM documents WHERE text IS NOT NULL)""")
def etl_sonnets(spark: SparkSession, sf: str) -> DataFrame:
    numbered = docs(spark, sf).where("text IS NOT NULL").select(F.expr("replace(regexp_replace(text, '[0-9]', ''), chr(10), chr(10) || doc_id || chr(10))").alias("sonnets"))
    return plays.parse_sonnets(numbered)


@query("SELECT source || text AS sonnets, text || lang AS plays FROM documents WHERE text IS NOT NULL")
def etl_split_book(spark: SparkSession, sf: str) -> DataFrame:
    return plays.split_book(docs(spark, sf).where("text IS NOT NULL").select(F.expr(_BOOK).alias("text")))


@query("""SELECT unnest(['FIRST PLAY', 'SECOND PLAY', 'THIRD PLAY']) AS title,
  unnest(['FIRST PLAY' || chr(10) || text, 'SECOND PLAY' || chr(10) || source, 'THIRD PLAY' || lang || text]) AS text FROM documents WHERE text IS NOT NULL""")
def etl_slice_plays(spark: SparkSession, sf: str) -> DataFrame:
    shelf = docs(spark, sf).where("text IS NOT NULL").select(F.expr(_SHELF).alias("plays"))
    return plays.slice_plays(shelf, spark.createDataFrame(list(enumerate(TITLES)), "idx int, title string"))
