"""Every query of the engine by name, and its SQL twin."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.hashing import fnv1a, hex8
from textloom.operators import chunking, evaluation, index, nearest, package, questions, ranking, service
from textloom.plans import oracle as O
from textloom.sources import blocks, pdf

QUERIES = {}
SQL = {}
#: SQL that is too slow for whole tables; tests compare it on the smallest.
SLOW_SQL = {}


def registered(name: str, sql: str | None = None, *needs: str):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = O.query(sql, *needs)
        return f

    return put


def _docs(s: SparkSession, d: str) -> DataFrame:
    return _spread(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))


def _spread(df: DataFrame) -> DataFrame:
    """A table of a few files dealt to all cores; tables with more parts than cores stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def _chunks(s: SparkSession, d: str, hashed: bool = False) -> DataFrame:
    return chunking.chunks(blocks.txt_blocks(_docs(s, d)), hashed=hashed)


def _index(s: SparkSession, d: str) -> index.Index:
    # tokens are made once and read by every table of the index
    return index.build_index(_chunks(s, d)).cached()


def _scores_index(s: SparkSession, d: str) -> index.Index:
    """The index without texts and pages, for queries that return scores only."""
    return index.index_of(index.chunk_stats(index.tokenized(_chunks(s, d))).drop("page", "text").cache())


def _asked(s: SparkSession, d: str) -> DataFrame:
    return ranking.questions_of(s.read.parquet(f"{d}/benchmark.parquet"), "item_id", "text")


def _ranked(s: SparkSession, d: str) -> tuple[index.Index, DataFrame, DataFrame]:
    i, q = _index(s, d), _asked(s, d)
    return i, q, ranking.top_k(i, q)


def _decisions(s: SparkSession, d: str) -> DataFrame:
    return ranking.decide(*_ranked(s, d))


def _benchmark(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/benchmark.parquet")


# --- sources


@registered("txt_blocks", "SELECT * FROM blocks", "blocks")
def txt_blocks(s, d):
    return blocks.txt_blocks(_docs(s, d))


@registered("csv_blocks", "SELECT * FROM csv", "csv")
def csv_blocks(s, d):
    return blocks.csv_blocks(_docs(s, d))


@registered("json_blocks", "SELECT * FROM json", "json")
def json_blocks(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    text = F.concat(F.lit('{"note": "'), "event_type", F.lit(" of user "), F.col("user_id").cast("string"), F.lit('", "short": "ab", "props": '), "props", F.lit(', "esc": "a\\"b \\n c"}'))
    return blocks.json_blocks(e.select(F.col("event_id").alias("doc_id"), text.alias("text")))


@registered("pdf_blocks", f"""SELECT CAST(item_id AS VARCHAR) AS doc_id, 0 AS block_no, {O.trim("replace(text, chr(10), ' ' || chr(10))")} AS text, 1 AS page, 1 AS total_streams, 1 AS text_streams,
  0 AS failed_inflate, 0 AS failed_decode, 0 AS used_fallback FROM benchmark""")
def pdf_blocks(s, d):
    make = F.udf(lambda t: pdf.synthetic([t]), "binary")  # a test's files; the reader itself works on batches
    return pdf.pdf_blocks(s.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), make("text").alias("content")))


@registered("doc_fulltext", "SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY block_no) AS text FROM blocks GROUP BY doc_id", "blocks")
def doc_fulltext(s, d):
    return blocks.full_text(blocks.txt_blocks(_docs(s, d)))


@registered("gold_load", """SELECT item_id AS doc_id, unnest([0, 1])::INTEGER AS n, unnest([text, 'outra']) AS question, unnest([CAST(item_id % 7 AS INTEGER), -1]) AS page FROM benchmark""")
def gold_load(s, d):
    item = F.struct((F.col("item_id") % 7).cast("int").alias("pagina_esperada"), F.col("text").alias("pergunta"))
    other = F.struct(F.lit(None).cast("int").alias("pagina_esperada"), F.lit("outra").alias("pergunta"))
    files = _benchmark(s, d).select(F.col("item_id").alias("doc_id"), F.to_json(F.struct(F.array(item, other).alias("perguntas"))).alias("text"))
    return blocks.gold_questions(files)


# --- chunks and text


@registered("word_count", f"SELECT doc_id, CAST(len({O.split_words('text')}) AS INTEGER) AS n_words FROM documents")
def word_count(s, d):
    return _docs(s, d).select("doc_id", T.word_count(F.col("text")).alias("n_words"))


@registered("word_stream", "SELECT * FROM words", "words")
def word_stream(s, d):
    return chunking.word_stream(blocks.txt_blocks(_docs(s, d)))


@registered("chunks", "SELECT * FROM chunks", "chunks")
def chunks(s, d):
    return _chunks(s, d)


@registered("chunk_hash", "SELECT chunk_id, hash FROM hashed", "hashed")
def chunk_hash(s, d):
    return _chunks(s, d, True).select("chunk_id", "hash")


@registered("chunk_crc", """SELECT chunk_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(text), '..'), lambda b: CAST('0x' || b AS BIGINT))),
  lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INTEGER) + 1])), 4294967295) AS crc FROM chunks, crc_table""", "chunks", "crc_table")
def chunk_crc(s, d):
    return _chunks(s, d).select("chunk_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


@registered("fold_accents", f"SELECT doc_id, {O.fold('text')} AS folded FROM documents")
def fold_accents(s, d):
    return _docs(s, d).select("doc_id", T.fold(F.col("text")).alias("folded"))


@registered("tokens", f"SELECT doc_id, {O.raw_tokens('text')} AS toks FROM documents")
def tokens(s, d):
    return _docs(s, d).select("doc_id", T.raw_tokens(F.col("text")).alias("toks"))


@registered("token_filter", f"SELECT doc_id, {O.kept(O.raw_tokens('text'))} AS toks FROM documents")
def token_filter(s, d):
    return _docs(s, d).select("doc_id", F.filter(T.raw_tokens(F.col("text")), T.keeps_token).alias("toks"))


@registered("stopword_rate", f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_filter(t, lambda w: w IN ({O._STOP}))) AS INTEGER) AS n_stop FROM (SELECT doc_id, {O.raw_tokens('text')} AS t FROM documents)")
def stopword_rate(s, d):
    return _docs(s, d).withColumn("t", T.raw_tokens(F.col("text"))).select("doc_id", F.size("t").alias("n_tokens"), F.size(F.filter("t", lambda w: w.isin(*T.STOP_WORDS))).alias("n_stop"))


@registered("stems", f"SELECT doc_id, {O.tokens('text')} AS toks FROM documents")
def stems(s, d):
    return _docs(s, d).select("doc_id", T.tokens(F.col("text")).alias("toks"))


@registered("embed_buckets", "SELECT chunk_id, bucket, round(w, 9) AS w FROM vectors_raw", "vectors_raw")
def embed_buckets(s, d):
    # the steps of a vector one by one, as columns
    rows = index.tokenized(_chunks(s, d))
    counts = rows.select("chunk_id", F.inline(index.grams(F.col("toks")))).groupBy("chunk_id", "gram").agg(F.sum("weight").alias("weight"))
    put = counts.withColumn("bucket", (fnv1a("gram") % index.DIM).cast("int")).groupBy("chunk_id", "bucket").agg(F.sum("weight").alias("v"))
    return put.select("chunk_id", "bucket", F.round(1 + F.log("v"), 9).alias("w"))


@registered("embed_norm", "SELECT chunk_id, count(*) AS n, round(sum(w * w), 6) AS norm FROM vectors GROUP BY chunk_id", "vectors")
def embed_norm(s, d):
    v = index.embed(index.tokenized(_chunks(s, d)), "chunk_id")
    return v.groupBy("chunk_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("w") * F.col("w")), 6).alias("norm"))


_VEC = "list_transform(embedding, lambda x: x::DOUBLE)"


@registered("vec_normalize", f"SELECT vec_id, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6)) AS unit FROM (SELECT vec_id, {_VEC} AS v FROM embeddings)")
def vec_normalize(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet")
    # a small negative number rounds to -0.0, as in SQL
    rounded = lambda x: F.when(x < 0, -F.round(-x, 6)).otherwise(F.round(x, 6))
    return e.select("vec_id", F.transform(index.l2_normalize(F.col("embedding")), rounded).alias("unit"))


@registered("cosine_pairs", f"SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])), 6) AS cos FROM (SELECT vec_id, {_VEC} AS v FROM embeddings) a JOIN (SELECT vec_id, {_VEC} AS v FROM embeddings) b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    b = e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("eb"))
    pairs = e.join(b, b["b"] == e["vec_id"] + 1)
    return pairs.select(F.col("vec_id").alias("a"), "b", F.round(index.cosine(F.col("embedding"), F.col("eb")), 6).alias("cos"))


@registered("query_embed", "SELECT q_id, bucket, round(w, 9) AS w FROM qvec", "qvec")
def query_embed(s, d):
    return index.embed(_asked(s, d), "q_id").withColumn("w", F.round("w", 9))


@registered("embeddings_dense", """SELECT q_id, list(round(coalesce(w, 0.0::DOUBLE), 6) ORDER BY k) AS embedding FROM (SELECT q_id, k FROM asked, range(384) r(k))
  LEFT JOIN (SELECT q_id, bucket AS k, w FROM qvec) USING (q_id, k) GROUP BY q_id""", "asked", "qvec")
def embeddings_dense(s, d):
    return _asked(s, d).select("q_id", F.transform(index.vector(F.col("toks")), lambda x: F.round(x, 6)).alias("embedding"))


@registered("chunk_valid", "SELECT chunk_id, doc_len, valid FROM stats", "stats")
def chunk_valid(s, d):
    return index.chunk_stats(index.tokenized(_chunks(s, d))).select("chunk_id", "doc_len", "valid")


@registered("sentences", "SELECT * FROM sentences", "sentences")
def sentences(s, d):
    return questions.sentence_rows(_chunks(s, d, True))


@registered("cap_words", r"SELECT doc_id, CAST(count(*) AS BIGINT) AS n_words, CAST(count(*) FILTER (WHERE regexp_matches(word, '^([A-Z0-9]|[^\x00-\x7F])')) AS BIGINT) AS n_capital FROM words GROUP BY doc_id", "words")
def cap_words(s, d):
    w = chunking.word_stream(blocks.txt_blocks(_docs(s, d)))
    return w.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.count(F.when(T.is_capital(F.col("word")), 1)).alias("n_capital"))


@registered("shorten", f"SELECT doc_id, {O.shorten('text', 160)} AS short FROM documents")
def shorten(s, d):
    return _docs(s, d).select("doc_id", T.shorten(F.col("text"), 160).alias("short"))


@registered("render", "SELECT item_id, 'Escolha: ' || text || ' (folha ' || item_id || ') {{outro}}' AS rendered FROM benchmark")
def render(s, d):
    return _benchmark(s, d).select("item_id", T.render("Escolha: {{trecho}} (folha {{pagina}}) {{outro}}", trecho=F.col("text"), pagina=F.col("item_id")).alias("rendered"))


# --- index and ranking


@registered("index_postings", "SELECT * FROM postings", "postings")
def index_postings(s, d):
    return index.postings(index.tokenized(_chunks(s, d)))


@registered("index_stats", "SELECT n, round(avgdl, 6) AS avgdl FROM corpus", "corpus")
def index_stats(s, d):
    return index.corpus_stats(index.chunk_stats(index.tokenized(_chunks(s, d)))).select("n", F.round("avgdl", 6).alias("avgdl"))


@registered("idf", "SELECT term, df, round(idf, 9) AS idf FROM terms", "terms")
def idf(s, d):
    return _index(s, d).terms.withColumn("idf", F.round("idf", 9))


@registered("bm25_candidates", "SELECT q_id, chunk_id, matched FROM bm25", "bm25")
def bm25_candidates(s, d):
    return ranking.bm25(_scores_index(s, d), _asked(s, d)).select("q_id", "chunk_id", "matched")


@registered("bm25", "SELECT q_id, chunk_id, round(raw, 6) AS raw FROM bm25", "bm25")
def bm25(s, d):
    return ranking.bm25(_scores_index(s, d), _asked(s, d)).select("q_id", "chunk_id", ranking.six_digits("raw"))


@registered("cosine_sparse", "SELECT q_id, chunk_id, round(cos, 6) AS cos FROM cos", "cos")
def cosine_sparse(s, d):
    return ranking.cosines(_scores_index(s, d), _asked(s, d)).withColumn("cos", ranking.six_digits("cos"))


@registered("hybrid_scores", "SELECT q_id, chunk_id, round(score, 6) AS score FROM scores", "scores")
def hybrid_scores(s, d):
    return ranking.hybrid_scores(_scores_index(s, d), _asked(s, d)).select("q_id", "chunk_id", ranking.six_digits("score"))


@registered("phrase_match", "SELECT q_id, chunk_id FROM scores WHERE phrase", "scores")
def phrase_match(s, d):
    return ranking.phrases(_scores_index(s, d), _asked(s, d)).select("q_id", "chunk_id")


@registered("phrase_boost", "SELECT q_id, count(*) AS n, round(max(score), 6) AS best FROM scores WHERE phrase GROUP BY q_id", "scores")
def phrase_boost(s, d):
    return ranking.phrases(_scores_index(s, d), _asked(s, d)).groupBy("q_id").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"))


@registered("hybrid_topk", "SELECT * FROM ranked", "ranked")
def hybrid_topk(s, d):
    return _ranked(s, d)[2]


@registered("rank_join_chunks", "SELECT q_id, rank, chunk_id, page, text FROM ranked JOIN stats USING (chunk_id)", "ranked", "stats")
def rank_join_chunks(s, d):
    i, _, r = _ranked(s, d)
    return r.join(i.stats.select("chunk_id", "page", "text"), "chunk_id").select("q_id", "rank", "chunk_id", "page", "text")


@registered("empty_query", "SELECT doc_id AS q_id, 0.0::DOUBLE AS score FROM documents WHERE len(" + O.tokens("text") + ") = 0")
def empty_query(s, d):
    # whole documents as questions; ranking scores those without tokens
    q = ranking.questions_of(_docs(s, d), "doc_id", "text").where(F.size("toks") == 0)
    return ranking.top_k(_index(s, d), q).where("rank = 1").select("q_id", "score")


@registered("query_dedup", "SELECT a.conv_id * 1000 + a.turn AS q_id, min(b.conv_id * 1000 + b.turn) AS asked FROM conversations a JOIN conversations b ON a.text = b.text GROUP BY a.conv_id, a.turn")
def query_dedup(s, d):
    q = s.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("q_id"), F.col("text").alias("question"))
    return ranking.distinct_questions(q)[1]


@registered("confidence", "SELECT q_id, round(1 / (1 + exp(-(score - 0.12::DOUBLE) * 12)), 4) AS confidence FROM ranked WHERE rank = 1", "ranked")
def confidence(s, d):
    r = _ranked(s, d)[2].where("rank = 1")
    return r.select("q_id", F.round(ranking.confidence(F.col("score")), 4).alias("confidence"))


@registered("confidence_clamped", "SELECT o_orderkey, round(1 / (1 + exp(-greatest(-20, least(20, (o_totalprice / 1000 - 100) * 4)))), 9) AS confidence FROM orders")
def confidence_clamped(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", F.round(ranking.confidence(F.col("o_totalprice") / 1000, 100.0, 4.0, evaluation.CLAMP), 9).alias("confidence"))


@registered("ask_decisions", "SELECT * FROM decisions", "decisions")
def ask_decisions(s, d):
    return _decisions(s, d)


@registered("refusals", "SELECT q_id, refused FROM decisions", "decisions")
def refusals(s, d):
    return _decisions(s, d).select("q_id", "refused")


@registered("citations", "SELECT q_id, citation FROM decisions", "decisions")
def citations(s, d):
    return _decisions(s, d).select("q_id", "citation")


@registered("answers", "SELECT q_id, answer FROM decisions", "decisions")
def answers(s, d):
    return _decisions(s, d).select("q_id", "answer")


@registered("chat_answers", "SELECT q_id, answer, confidence, page FROM decisions", "decisions")
def chat_answers(s, d):
    return _decisions(s, d).select("q_id", "answer", "confidence", "page")


@registered("decisions_json", "SELECT q_id, printf('%.4f', confidence) AS confidence, refused, page FROM decisions", "decisions")
def decisions_json(s, d):
    out = _decisions(s, d)
    j = F.to_json(F.struct("page", "refused", F.format_string("%.4f", "confidence").alias("confidence")))
    return out.select("q_id", F.from_json(j, "confidence string, refused boolean, page int").alias("j")).select("q_id", "j.*")


@registered("calib_precedence", """SELECT c_custkey, coalesce(nullif(f, 0), CASE WHEN c_nationkey % 2 = 0 THEN 0.2::DOUBLE END, 0.3::DOUBLE) AS threshold FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 0.5::DOUBLE ELSE 0 END AS f FROM customer)""")
def calib_precedence(s, d):
    c = s.read.parquet(f"{d}/customer.parquet")
    flag = F.when(F.col("c_custkey") % 3 == 0, 0.5).otherwise(0.0)
    pack = F.when(F.col("c_nationkey") % 2 == 0, 0.2)
    return c.select("c_custkey", F.coalesce(F.nullif(flag, F.lit(0.0)), pack, F.lit(ranking.THRESHOLD)).alias("threshold"))


@registered("gold_recall2", "SELECT count(*) AS n, CAST(sum(CASE WHEN NOT refused AND (page = q_id % 7 + 1 OR contains(answer, '[p.' || (q_id % 7 + 1) || ']')) THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM decisions", "decisions")
def gold_recall2(s, d):
    rows = _decisions(s, d).withColumn("expected", F.col("q_id") % 7 + 1)
    hit = ~F.col("refused") & ((F.col("page") == F.col("expected")) | F.contains("answer", F.concat(F.lit("[p."), F.col("expected").cast("string"), F.lit("]"))))
    return rows.agg(F.count("*").alias("n"), F.sum(hit.cast("int")).alias("hits"))


# --- questions


def _sentences(s, d):
    return questions.sentence_rows(_chunks(s, d, True))


def _questions(s, d):
    return questions.generate(_chunks(s, d, True).cache())


def _choice(s, d):
    rows = _sentences(s, d).cache()
    return questions.choice(rows, questions.entities(rows))


@registered("entities", "SELECT * FROM entities", "entities")
def entities(s, d):
    return questions.entities(_sentences(s, d))


@registered("questions_noul", "SELECT * FROM noul", "noul")
def questions_noul(s, d):
    return questions.noul(_sentences(s, d))


@registered("questions_choice", "SELECT chunk_id, hash, page, pos, entity, prompt, options FROM choice", "choice")
def questions_choice(s, d):
    return _choice(s, d).drop("unshuffled")


@registered("distractors", "SELECT chunk_id, pos, entity, unshuffled[2:] AS distractors FROM choice", "choice")
def distractors(s, d):
    return _choice(s, d).select("chunk_id", "pos", "entity", F.slice("unshuffled", 2, 3).alias("distractors"))


@registered("option_shuffle", "SELECT chunk_id, pos, CAST(list_position(options, entity) AS BIGINT) AS answer_at FROM choice", "choice")
def option_shuffle(s, d):
    return _choice(s, d).select("chunk_id", "pos", F.array_position("options", F.col("entity")).alias("answer_at"))


@registered("questions_score", "SELECT * FROM score_q", "score_q")
def questions_score(s, d):
    return questions.score(_chunks(s, d, True))


@registered("questions_all", "SELECT * FROM questions", "questions")
def questions_all(s, d):
    return _questions(s, d)


@registered("question_counts", "SELECT type, count(*) AS n FROM questions GROUP BY type", "questions")
def question_counts(s, d):
    return _questions(s, d).groupBy("type").agg(F.count("*").alias("n"))


@registered("question_fanout", "SELECT chunk_id, count(q_id) AS n FROM chunks LEFT JOIN questions USING (chunk_id) GROUP BY chunk_id", "questions", "chunks")
def question_fanout(s, d):
    return _questions(s, d).groupBy("chunk_id").agg(F.count("*").alias("n"))


# --- packages


@registered("inspect_stats", """SELECT n_chunks, chunk_bytes, count(*) AS n_questions, CAST(sum(CAST(type = 'choice' AS INTEGER)) AS BIGINT) AS n_choice, CAST(sum(CAST(type = 'score' AS INTEGER)) AS BIGINT) AS n_score,
  CAST(sum(CAST(type = 'noul' AS INTEGER)) AS BIGINT) AS n_noul FROM questions, (SELECT count(*) AS n_chunks, CAST(sum(strlen(text)) AS BIGINT) AS chunk_bytes FROM chunks) GROUP BY ALL""", "questions", "chunks")
def inspect_stats(s, d):
    c = _chunks(s, d, True).cache()
    return package.inspect(package.Package(c, questions.generate(c), None, None))


@registered("inspect_questions", "SELECT q_id, type, prompt FROM questions ORDER BY q_id LIMIT 10", "questions")
def inspect_questions(s, d):
    return _questions(s, d).orderBy("q_id").limit(10).select("q_id", "type", "prompt")


@registered("inspect_chunks", "SELECT chunk_id, hash, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM hashed ORDER BY chunk_id LIMIT 10", "hashed")
def inspect_chunks(s, d):
    preview = F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text"))
    return _chunks(s, d, True).orderBy("chunk_id").limit(10).select("chunk_id", "hash", preview.alias("preview"))


@registered("package_roundtrip")
def package_roundtrip(s, d):
    c = _chunks(s, d, True).cache()
    p = package.Package(c, questions.generate(c), index.embed(index.tokenized(c), "chunk_id"), package.meta(s, "documents", calibration=ranking.Calibration(0.2, 16.0, 0.85)))
    folder = (s.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()).rstrip("/")
    import uuid

    path = f"{folder}/package-{uuid.uuid4().hex}"
    package.save(p, path)
    back = package.load(s, path)
    return package.checksum(back.chunks).select(F.lit("chunks").alias("table"), "n", "crc").unionByName(package.checksum(back.questions).select(F.lit("questions").alias("table"), "n", "crc"))


@registered("coverage", """SELECT n_pages, n_blocks, n_chunks, n_chars, round(n_chars / n_pages, 6) AS chars_per_page, round((SELECT count(*) FROM questions) / n_chunks, 6) AS questions_per_chunk FROM
  (SELECT CAST(sum(p) AS BIGINT) AS n_pages, CAST(sum(b) AS BIGINT) AS n_blocks FROM (SELECT max(page) AS p, count(*) AS b FROM blocks GROUP BY doc_id)), (SELECT count(*) AS n_chunks, CAST(sum(strlen(text)) AS BIGINT) AS n_chars FROM chunks)""", "questions", "blocks", "chunks")
def coverage(s, d):
    b = blocks.txt_blocks(_docs(s, d))
    per = b.groupBy("doc_id").agg(F.max("page").alias("p"), F.count("*").alias("b")).agg(F.sum("p").alias("n_pages"), F.sum("b").alias("n_blocks"))
    c = chunking.chunks(b).cache()
    n = c.agg(F.count("*").alias("n_chunks"), F.sum(F.octet_length("text")).alias("n_chars"))
    q = questions.generate(c).agg(F.count("*").alias("q"))
    rows = per.crossJoin(n).crossJoin(q)  # one row each
    return rows.select("n_pages", "n_blocks", "n_chunks", "n_chars", F.round(F.col("n_chars") / F.col("n_pages"), 6).alias("chars_per_page"), F.round(F.col("q") / F.col("n_chunks"), 6).alias("questions_per_chunk"))


# --- evaluation


#: Share that the sampling queries take; evaluation and calibration take every question.
SHARE = 0.1


def _evaluated(s, d):
    c = _chunks(s, d, True).cache()
    i = index.build_index(c).cached()
    asked = questions.generate(c).cache()
    q = ranking.questions_of(asked, "q_id", "prompt", "chunk_id").withColumnRenamed("chunk_id", "made_from")
    return i, asked, q, nearest.best_chunks(i, q)  # score, confidence and page are the best chunk's


def _outcomes(s, d):
    i, asked, q, r = _evaluated(s, d)
    return evaluation.outcomes(ranking.decide(i, q, r), asked)


def _points(s, d):
    i, _, _, r = _evaluated(s, d)
    p = ranking.questions_of(evaluation.probes(s), "q_id", "question")
    best = lambda x, y: x.where("rank = 1").select("score", F.lit(y).alias("y"))
    # many questions share a score: points are counted, not listed
    return best(r, 1).unionByName(best(ranking.top_k(i, p, 1), 0))


@registered("sample_hash", "SELECT q_id FROM sampled", "sampled")
def sample_hash(s, d):
    return evaluation.sample_by_hash(_questions(s, d), SHARE).select("q_id")


@registered("sample_fy")
def sample_fy(s, d):
    # counted, cut into ranges and numbered: the ids are made once
    return evaluation.sample_by_shuffle(_questions(s, d).select("q_id").cache(), SHARE, 42)


@registered("eval_report", """SELECT count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, round(avg(hit), 6) AS fidelity, round(avg(confidence), 6) AS mean_confidence, round(abs(avg(confidence) - avg(hit)), 6) AS gap,
  CAST(sum(CAST(refused AS INTEGER)) AS BIGINT) AS refused_in_scope FROM outcomes""", "outcomes")
def eval_report(s, d):
    r = evaluation.report(_outcomes(s, d))
    return r.withColumns({c: F.round(c, 6) for c in ("fidelity", "mean_confidence", "gap")})


@registered("ece_bins", "SELECT bin, n, round(accuracy, 6) AS accuracy, round(mean_confidence, 6) AS mean_confidence FROM bins", "bins")
def ece_bins(s, d):
    return evaluation.ece_bins(_outcomes(s, d)).withColumns({c: F.round(c, 6) for c in ("accuracy", "mean_confidence")})


@registered("ece", "SELECT round(sum(n * abs(accuracy - mean_confidence)) / sum(n), 6) AS ece FROM bins", "bins")
def ece(s, d):
    return evaluation.ece(evaluation.ece_bins(_outcomes(s, d))).select(F.round("ece", 6).alias("ece"))


@registered("eval_by_type", "SELECT type, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits FROM outcomes GROUP BY type", "outcomes")
def eval_by_type(s, d):
    return evaluation.by_type(_outcomes(s, d))


@registered("probe_refusals", "SELECT count(*) AS n, CAST(sum(CAST(refused AS INTEGER)) AS BIGINT) AS refused FROM probe_decisions", "probe_decisions")
def probe_refusals(s, d):
    i = _index(s, d)
    q = ranking.questions_of(evaluation.probes(s), "q_id", "question")
    return ranking.decide(i, q, ranking.top_k(i, q)).agg(F.count("*").alias("n"), F.sum(F.col("refused").cast("int")).alias("refused"))


@registered("calib_points", "SELECT y, count(*) AS n, round(min(score), 6) AS least, round(max(score), 6) AS most FROM points GROUP BY y", "points")
def calib_points(s, d):
    return _points(s, d).groupBy("y").agg(F.count("*").alias("n"), F.round(F.min("score"), 6).alias("least"), F.round(F.max("score"), 6).alias("most"))


@registered("confusion", """SELECT round(tpr, 6) AS tpr, round(tnr, 6) AS tnr, round((tpr + tnr) / 2, 6) AS balanced, round(abs(mc - acc), 6) AS gap FROM (
  SELECT coalesce(sum(yes * y) / nullif(sum(y), 0), 1) AS tpr, coalesce(sum((1 - yes) * (1 - y)) / nullif(sum(1 - y), 0), 1) AS tnr, avg(c) AS mc, avg(CASE WHEN yes = y THEN 1.0::DOUBLE ELSE 0 END) AS acc FROM (
    SELECT *, CAST(c >= 0.3::DOUBLE AS INTEGER) AS yes FROM (SELECT y, 1 / (1 + exp(-greatest(-20, least(20, (score - 0.12::DOUBLE) * 12)))) AS c FROM points)))""", "points")
def confusion(s, d):
    return evaluation.confusion(_points(s, d)).select(*[F.round(c, 6).alias(c) for c in ("tpr", "tnr", "balanced", "gap")])


@registered("calib_grid", "SELECT * FROM grid", "grid")
def calib_grid(s, d):
    return evaluation.grid(s)


@registered("calibrate")
def calibrate(s, d):
    return evaluation.calibrate(_points(s, d))


SLOW_SQL["calibrate"] = O.query("""SELECT round(center, 6) AS center, round(slope, 6) AS slope, round(threshold, 6) AS threshold, round(tpr, 6) AS tpr, round(tnr, 6) AS tnr, round((tpr + tnr) / 2, 6) AS balanced, round(gap, 6) AS gap FROM (
  SELECT *, abs(mc - acc) AS gap FROM (
    SELECT ci, si, li, center, slope, threshold, sum(yes * y) / sum(y) AS tpr, sum((1 - yes) * (1 - y)) / sum(1 - y) AS tnr, avg(c) AS mc, avg(CASE WHEN yes = y THEN 1.0::DOUBLE ELSE 0 END) AS acc FROM (
      SELECT *, CAST(c >= threshold AS INTEGER) AS yes FROM (SELECT *, 1 / (1 + exp(-greatest(-20, least(20, (score - center) * slope)))) AS c FROM points, grid)) GROUP BY ALL))
  ORDER BY round((tpr + tnr) / 2, 9) DESC, round(gap, 9), ci, si, li LIMIT 1""", "points", "grid")


@registered("threshold_sweep", """SELECT threshold, CAST(count(*) FILTER (WHERE confidence >= threshold) AS BIGINT) AS responded, CAST(count(*) FILTER (WHERE page = expected) AS BIGINT) AS rank_ok,
  CAST(count(*) FILTER (WHERE confidence >= threshold AND page = expected) AS BIGINT) AS both_ok, CAST(count(*) FILTER (WHERE confidence < threshold AND page = expected) AS BIGINT) AS refused_rank_ok
  FROM outcomes, (SELECT unnest([0.30, 0.50, 0.70, 0.85, 0.89]::DOUBLE[]) AS threshold) GROUP BY threshold""", "outcomes")
def threshold_sweep(s, d):
    return evaluation.threshold_sweep(_outcomes(s, d))


# --- service


@registered("embedding_usage", f"SELECT CAST(sum(len({O.tokens('text')})) AS BIGINT) AS tokens FROM conversations")
def embedding_usage(s, d):
    return s.read.parquet(f"{d}/conversations.parquet").agg(F.sum(F.size(T.tokens(F.col("text")))).alias("tokens"))


@registered("last_prompt", "SELECT conv_id, arg_max(text, turn) AS prompt FROM conversations GROUP BY conv_id")
def last_prompt(s, d):
    return service.last_prompt(s.read.parquet(f"{d}/conversations.parquet"))


@registered("route_model", """SELECT event_id AS request_id, coalesce(nullif(CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END, ''), 'books') AS package_id,
  event_id % 4 = 0 OR event_type IN (SELECT event_type FROM (SELECT DISTINCT event_type FROM events) ORDER BY event_type LIMIT 2) AS found FROM events""")
def route_model(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    kinds = e.select("event_type").distinct().orderBy("event_type").limit(2)
    packages = kinds.select(F.col("event_type").alias("package_id")).unionByName(s.createDataFrame([("books",)], "package_id string"))
    requests = e.select(F.col("event_id").alias("request_id"), F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("event_type")).alias("model"))
    return service.route(requests, packages, "books")


@registered("sse_slices", """SELECT q_id, CAST(n AS INTEGER) AS n, array_to_string(w[n * 6 + 1:n * 6 + 6], ' ') || CASE WHEN n = 0 AND page IS NOT NULL THEN ' [p.' || page || ']' ELSE '' END AS part, (n + 1) * 6 >= len(w) AS last FROM (
  SELECT q_id, page, w, unnest(range((len(w) - 1) // 6 + 1)) AS n FROM (SELECT q_id, page, list_filter(string_split(answer, ' '), lambda x: x <> '') AS w FROM decisions) WHERE len(w) > 0)""", "decisions")
def sse_slices(s, d):
    return service.slices(_decisions(s, d))


@registered("jsonrpc_dispatch", """SELECT event_id AS line_id, CASE WHEN event_id % 11 = 0 THEN 'invalid' WHEN event_id % 3 = 0 THEN 'notification' ELSE m END AS kind, CASE WHEN event_id % 11 > 0 THEN t END AS tool,
  CAST(CASE WHEN event_id % 11 = 0 THEN -32700 WHEN event_id % 3 = 0 THEN NULL WHEN m = 'other' THEN -32601 WHEN m = 'tools/call' AND t = 'none' THEN -32602 END AS INTEGER) AS code
  FROM (SELECT event_id, ['initialize', 'ping', 'tools/list', 'tools/call', 'other'][event_id % 5 + 1] AS m, ['ask', 'none'][event_id % 2 + 1] AS t FROM events)""")
def jsonrpc_dispatch(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    method = F.element_at(F.array(*[F.lit(m) for m in ("initialize", "ping", "tools/list", "tools/call", "other")]), (F.col("event_id") % 5 + 1).cast("int"))
    tool = F.struct(F.element_at(F.array(F.lit("ask"), F.lit("none")), (F.col("event_id") % 2 + 1).cast("int")).alias("name"))
    line = F.when(F.col("event_id") % 11 == 0, "{bad").otherwise(F.to_json(F.struct(F.when(F.col("event_id") % 3 > 0, F.col("event_id")).alias("id"), method.alias("method"), tool.alias("params"))))
    return service.rpc_batch(e.select(F.col("event_id").alias("line_id"), line.alias("line")))


@registered("stream_ask", "SELECT * FROM decisions", "decisions")
def stream_ask(s, d):
    from textloom.streaming.ask import answer_stream

    import uuid

    folder = (s.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()).rstrip("/")
    path = f"{folder}/stream-{uuid.uuid4().hex}"
    stream = s.readStream.schema(_benchmark(s, d).schema).parquet(f"{d}/benchmark.parquet" if _is_folder(s, f"{d}/benchmark.parquet") else f"{d}/benchmark.parquet*")
    q = stream.select(F.col("item_id").alias("q_id"), F.col("text").alias("question"))
    answer_stream(_index(s, d), q, f"{path}/out", f"{path}/state").awaitTermination()
    return s.read.parquet(f"{path}/out").drop("batch")


def _is_folder(s: SparkSession, path: str) -> bool:
    p = s.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions for the benchmark's questions."""
    return _decisions(spark, sf_dir)
