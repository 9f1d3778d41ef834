"""The engine's queries as SQL for an independent engine: named parts and what each of them needs."""

from __future__ import annotations

from textloom.functions.text import FOLD_ONE, FOLD_RANGES, FOLD_TWO, STOP_WORDS
from textloom.operators.evaluation import PROBES
from textloom.operators.ranking import HEAD, REFUSAL
from textloom.sources.config import Templates

BLANKS = r"[ \t\n\x0B\f\r]"
PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, sql: str, *needs: str) -> None:
    PARTS[name] = (needs, sql)


def query(sql: str, *needs: str) -> str:
    done: list[str] = []

    def add(name: str) -> None:
        if name not in done:
            for n in PARTS[name][0]:
                add(n)
            done.append(name)

    for n in needs:
        add(n)
    parts = ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n][1]})" for n in done)
    return f"WITH {parts}\n{sql}" if done else sql


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANKS}+|{BLANKS}+$', '', 'g')"


def fold(x: str) -> str:
    out = f"translate({x}, {quoted(''.join(a for a, _ in FOLD_ONE))}, {quoted(''.join(b * len(a) for a, b in FOLD_ONE))})"
    for a, b in FOLD_TWO:
        out = f"replace({out}, {quoted(a)}, {quoted(b)})"
    for pattern, to in FOLD_RANGES:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"lower(regexp_replace({out}, '[^A-Za-z0-9]+', ' ', 'g'))"


def raw_tokens(x: str) -> str:
    return f"list_filter(string_split({fold(x)}, ' '), lambda w: w <> '')"


_RUN = "|".join(f"{c}{{5}}" for c in "abcdefghijklmnopqrstuvwxyz0123456789")
_STOP = ", ".join(quoted(w) for w in STOP_WORDS)


def kept(x: str) -> str:
    return f"list_filter({x}, lambda w: length(w) >= 2 AND length(w) <= 30 AND NOT regexp_matches(w, '{_RUN}') AND w NOT IN ({_STOP}))"


_STEM = """CASE WHEN length(w) > 7 AND suffix(w, 'mente') THEN w[:-6] WHEN length(w) > 3 AND suffix(w, 'oes') THEN w[:-4] || 'ao'
 WHEN length(w) > 4 AND regexp_matches(w, '[aeou]is$') THEN w[:-3] || 'l' WHEN length(w) > 3 AND suffix(w, 'ens') THEN w[:-2] || 'm'
 WHEN length(w) > 4 AND regexp_matches(w, '[^aeiou]es$') THEN w[:-3] WHEN length(w) > 3 AND regexp_matches(w, '[^s]s$') THEN w[:-2]
 WHEN length(w) > 4 AND regexp_matches(w, '[aei]r$') THEN w[:-2] WHEN length(w) > 6 AND suffix(w, 'ndo') THEN w[:-4]
 WHEN length(w) > 5 AND regexp_matches(w, '[ai]do$') THEN w[:-3] ELSE w END"""


def cut_stem(sql: str) -> str:
    """w[:-k-1] as substr, for the rules above."""
    import re

    return re.sub(r"w\[:-(\d)\]", lambda m: f"substr(w, 1, length(w) - {int(m[1]) - 1})", sql)


STEM = cut_stem(_STEM)


def stems(x: str) -> str:
    return f"list_transform({x}, lambda w: {STEM})"


def tokens(x: str) -> str:
    return stems(kept(raw_tokens(x)))


def fnv(x: str) -> str:
    return (
        f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(regexp_extract_all(hex({x}), '..'), lambda b: CAST('0x' || b AS BIGINT))), "
        "lambda h, b: (xor(h, b) * 16777619) & 4294967295)"
    )


def split_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{BLANKS}+'), lambda w: w <> '')"


def shorten(x: str, most: int) -> str:
    head = f"substr({x}, 1, {most})"
    at = f"(length({head}) - instr(reverse({head}), ' '))"
    return f"CASE WHEN length({x}) <= {most} THEN {x} WHEN instr({head}, ' ') > 0 AND {at} > {most // 2} THEN substr({head}, 1, {at}) ELSE {head} END"


def blocks_of(table: str) -> str:
    marked = f"regexp_replace(regexp_replace(text, '\\n([\\n\\r])', chr(10) || chr(30) || '\\1', 'g'), '\\n([\\n\\r])', chr(10) || chr(30) || '\\1', 'g')"
    return f"""
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INTEGER) AS block_no, text, CAST(page AS INTEGER) AS page FROM (
    SELECT doc_id, part, {trim('raw')} AS text,
      1 + floor(sum(length(raw) - length(replace(raw, chr(10), ''))) OVER (PARTITION BY doc_id ORDER BY part) / 50) AS page
    FROM (SELECT doc_id, unnest(range(len(p))) AS part, unnest(p) AS raw FROM (SELECT doc_id, string_split({marked}, chr(30)) AS p FROM {table})))
  WHERE text <> ''"""


part("blocks", blocks_of("documents"))
part("csv", rf"""
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INTEGER) AS block_no, text, CAST(1 + part // 60 AS INTEGER) AS page FROM (
    SELECT doc_id, part, {trim("array_to_string(list_transform(s, lambda x, i: CASE WHEN i % 2 = 1 THEN regexp_replace(x, '[;,\t]', ' | ', 'g') ELSE x END), '')")} AS text
    FROM (SELECT doc_id, part, string_split({trim('raw')}, '"') AS s FROM (
      SELECT doc_id, unnest(range(len(p))) AS part, unnest(p) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))))
  WHERE text <> ''""")
part("json_docs", """
  SELECT event_id AS doc_id, '{"note": "' || event_type || ' of user ' || user_id || '", "short": "ab", "props": ' || props || ', "esc": "a\\\\"b \\\\n c"}' AS text FROM events""".replace("\\\\", "\\"))
part("json", rf"""
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INTEGER) AS block_no, text, CAST(1 + part // 20 AS INTEGER) AS page FROM (
    SELECT doc_id, part, {trim('raw')} AS text FROM (
      SELECT doc_id, unnest(range(len(k))) AS part, unnest(k) AS raw FROM (
        SELECT doc_id, CASE WHEN len(k) > 0 THEN k ELSE [text] END AS k FROM (
          SELECT doc_id, text, list_filter(list_transform(regexp_extract_all(text, '"((?:[^"\\]|\\.)*)"', 1),
            lambda s: regexp_replace(replace(replace(s, '\n', chr(10)), '\t', chr(9)), '\\(.)', '\1', 'g')),
            lambda s: strlen(s) >= 3 AND (contains(s, ' ') OR strlen(s) >= 24)) AS k FROM json_docs))))
  WHERE text <> ''""", "json_docs")
part("words", f"""
  SELECT doc_id, block_no, CAST(pos AS INTEGER) AS pos, word, page FROM (
    SELECT doc_id, block_no, page, unnest(range(len(w))) AS pos, unnest(w) AS word FROM (SELECT *, {split_words('text')} AS w FROM blocks))""", "blocks")
part("chunks", f"""
  SELECT doc_id, CAST(c AS INTEGER) AS chunk_no, doc_id * 1048576 + c AS chunk_id, string_agg(word, ' ' ORDER BY k) AS text,
    arg_min(page, k) AS page_start, arg_max(page, k) AS page_end, CAST(count(*) AS INTEGER) AS n_words
  FROM (SELECT *, unnest(range(CAST(greatest(0, ceil((k - 179) / 150)) AS BIGINT), CAST(least(CASE WHEN n > 180 THEN ceil((n - 180) / 150) ELSE 0 END, k // 150) AS BIGINT) + 1)) AS c
    FROM (SELECT doc_id, word, page, row_number() OVER (PARTITION BY doc_id ORDER BY block_no, pos) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM words))
  GROUP BY doc_id, c""", "words")
part("hashed", f"SELECT *, lpad(lower(to_hex({fnv('text')})), 8, '0') AS hash FROM chunks", "chunks")
# the checksum's table: eight steps for each byte value
_STEP = "CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
_TABLE = "SELECT i, i AS x FROM range(256) r(i)"
for _ in range(8):
    _TABLE = f"SELECT i, {_STEP} AS x FROM ({_TABLE})"
part("crc_table", f"SELECT list(x ORDER BY i) AS t FROM ({_TABLE})")
part("toks", f"SELECT *, {tokens('text')} AS toks FROM chunks", "chunks")
part("stats", """
  SELECT chunk_id, CAST(len(toks) AS INTEGER) AS doc_len, page_start AS page, text, array_to_string(toks, ' ') AS tok_str,
    len(toks) >= 4 AND strlen(text) >= 20 AND 100 * strlen(regexp_replace(text, '[\\x00-@\\[-`{-\\x7F]', '', 'g')) >= 40 * strlen(text) AS valid FROM toks""", "toks")
part("corpus", "SELECT count(*) AS n, greatest(1.0::DOUBLE, coalesce(avg(doc_len), 0)) AS avgdl FROM stats", "stats")
part("postings", "SELECT term, chunk_id, doc_len, count(*) AS tf FROM (SELECT chunk_id, CAST(len(toks) AS INTEGER) AS doc_len, unnest(toks) AS term FROM toks) GROUP BY ALL", "toks")
part("terms", "SELECT term, df, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), corpus", "postings", "corpus")


def buckets(name: str, table: str, key: str, *needs: str) -> None:
    part(f"{name}_grams", f"""
  SELECT {key}, gram, sum(w) AS w FROM (
    SELECT {key}, unnest(toks) AS gram, 1.0::DOUBLE AS w FROM {table} UNION ALL
    SELECT {key}, unnest(list_transform(list_zip(toks[:-2], toks[2:]), lambda p: p[1] || ' ' || p[2])), 0.5::DOUBLE FROM {table} WHERE len(toks) > 1) GROUP BY ALL""".replace("toks[:-2]", "toks[1:len(toks) - 1]"), *needs)
    part(f"{name}_hashes", f"SELECT gram, CAST({fnv('gram')} % 384 AS INTEGER) AS bucket FROM (SELECT DISTINCT gram FROM {name}_grams)", f"{name}_grams")
    part(f"{name}_raw", f"SELECT {key}, bucket, 1 + ln(sum(w)) AS w FROM {name}_grams JOIN {name}_hashes USING (gram) GROUP BY {key}, bucket", f"{name}_hashes")
    part(name, f"SELECT {key}, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM {name}_raw", f"{name}_raw")


buckets("vectors", "toks", "chunk_id", "toks")


def ranking(p: str, questions: str, *needs: str) -> None:
    """Parts with prefix p that rank ``questions`` (q_id, question) and decide."""
    part(f"{p}asked", f"SELECT q_id, question, {tokens('question')} AS toks FROM ({questions})", *needs)
    part(f"{p}qterms", f"SELECT q_id, term, count(*) AS times FROM (SELECT q_id, unnest(toks) AS term FROM {p}asked) GROUP BY ALL", f"{p}asked")
    part(f"{p}bm25", f"""
  SELECT q_id, chunk_id, sum(times * idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * doc_len / avgdl))) AS raw, count(*) AS matched
  FROM {p}qterms JOIN postings USING (term) JOIN terms USING (term), corpus GROUP BY q_id, chunk_id""", f"{p}qterms", "postings", "terms", "corpus")
    buckets(f"{p}qvec", f"{p}asked", "q_id", f"{p}asked")
    part(f"{p}cos", f"SELECT q_id, chunk_id, sum(a.w * b.w) AS cos FROM {p}qvec a JOIN vectors b USING (bucket) GROUP BY q_id, chunk_id", f"{p}qvec", "vectors")
    part(f"{p}scores", f"""
  SELECT q_id, chunk_id, CASE WHEN NOT valid THEN 0.0::DOUBLE WHEN phrase THEN least(1.0::DOUBLE, s + 0.2::DOUBLE) ELSE s END AS score, phrase AND valid AS phrase FROM (
    SELECT q_id, chunk_id, valid, 0.6::DOUBLE * greatest(coalesce(cos, 0), 0) + 0.4::DOUBLE * coalesce(raw, 0) / (coalesce(raw, 0) + 8) AS s,
      len(toks) > 0 AND contains(' ' || tok_str || ' ', ' ' || array_to_string(toks, ' ') || ' ') AS phrase
    FROM {p}bm25 FULL JOIN {p}cos USING (q_id, chunk_id) JOIN stats USING (chunk_id) JOIN {p}asked USING (q_id))""", f"{p}bm25", f"{p}cos", "stats", f"{p}asked")
    part(f"{p}ranked", f"""
  SELECT q_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM (
      SELECT q_id, chunk_id, max(score) AS score FROM (
        SELECT q_id, chunk_id, score FROM {p}scores UNION ALL SELECT q_id, chunk_id, 0.0 FROM {p}asked, (SELECT chunk_id FROM stats ORDER BY chunk_id LIMIT 3)) GROUP BY q_id, chunk_id))
  WHERE rank <= 3""", f"{p}scores", "stats")
    part(f"{p}decisions", f"""
  SELECT q_id, question, score, round(conf, 4) AS confidence, page, conf < 0.3::DOUBLE AS refused,
    CASE WHEN conf < 0.3::DOUBLE THEN '' ELSE cite END AS citation,
    CASE WHEN conf < 0.3::DOUBLE THEN {quoted(REFUSAL)} ELSE {quoted(HEAD)} || page || CASE WHEN p2 IS NOT NULL AND p2 <> page THEN ', ' || p2 ELSE '' END || '): ' || cite END AS answer
  FROM (SELECT *, 1 / (1 + exp(-(score - 0.12::DOUBLE) * 12)) AS conf, '[p.' || page || '] ' || substr(t1, 1, 400) || coalesce(' [p.' || p2 || '] ' || substr(t2, 1, 400), '') AS cite FROM (
    SELECT q_id, max(score) FILTER (WHERE rank = 1) AS score, max(page) FILTER (WHERE rank = 1) AS page, max(page) FILTER (WHERE rank = 2) AS p2,
      max(text) FILTER (WHERE rank = 1) AS t1, max(text) FILTER (WHERE rank = 2) AS t2 FROM {p}ranked JOIN stats USING (chunk_id) GROUP BY q_id) JOIN {p}asked USING (q_id))""", f"{p}ranked", "stats", f"{p}asked")


ranking("", "SELECT item_id AS q_id, text AS question FROM benchmark")
part("probe_questions", "SELECT * FROM (VALUES " + ", ".join(f"({-k - 1}, {quoted(t)})" for k, t in enumerate(PROBES)) + ") v(q_id, question)")
ranking("probe_", "SELECT * FROM probe_questions", "probe_questions")

_T = Templates()
part("sentences", f"""
  SELECT chunk_id, hash, page_start AS page, CAST(unnest(range(len(s))) AS INTEGER) AS pos, unnest(s) AS sentence FROM (
    SELECT *, list_filter(list_transform(string_split(regexp_replace(text, '([.!?;])([ \\t\\n\\x0B\\f\\r"]|\\z)', '\\1' || chr(30) || '\\2', 'g'), chr(30)),
      lambda x: {trim('x')}), lambda x: strlen(x) >= 20) AS s FROM hashed)""", "hashed")
_CAP = r"'^([A-Z0-9]|[^\x00-\x7F])'"
part("entities", f"""
  SELECT chunk_id, pos, CAST(island AS BIGINT) AS island, string_agg(word, ' ' ORDER BY k) AS entity FROM (
    SELECT *, sum(CASE WHEN cap THEN 0 ELSE 1 END) OVER (PARTITION BY chunk_id, pos ORDER BY k) AS island FROM (
      SELECT *, regexp_matches(word, {_CAP}) AND strlen(word) >= 3 AS cap FROM (
        SELECT chunk_id, pos, unnest(range(len(w))) AS k, unnest(w) AS word FROM (
          SELECT chunk_id, pos, list_filter(regexp_split_to_array(translate(sentence, ',:()', '    '), '[ \\t\\r\\n"'']+'), lambda w: w <> '') AS w FROM sentences))))
  WHERE cap GROUP BY chunk_id, pos, island""", "sentences")
part("pool", "SELECT list(entity ORDER BY a) AS pool FROM (SELECT entity, min(struct_pack(c := chunk_id, p := pos, i := island)) AS a FROM entities GROUP BY entity ORDER BY a LIMIT 4)", "entities")
part("noul", f"""
  SELECT chunk_id, hash, page, pos, replace({quoted(_T.noul)}, '{{{{afirmacao}}}}', {shorten('sentence', 220)}) AS prompt, sentence AS claim FROM sentences WHERE pos < 5""", "sentences")
part("choice_base", f"""
  SELECT *, list_concat([entity], d, ['Alternativa ' || k || ' (nao consta no trecho)' FOR k IN range(len(d) + 2, 5)]) AS unshuffled,
    replace({quoted(_T.choice)}, '{{{{trecho}}}}', {shorten('sentence', 160)}) AS prompt, xor({fnv('hash')}, (pos * 2654435761) & 4294967295) AS h3 FROM (
    SELECT *, list_filter(pool, lambda e: e <> entity)[1:3] AS d FROM (
      SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) AS r FROM (
        SELECT *, list_filter(regexp_split_to_array(sentence, '[ \\t\\r\\n"''(),.:;]+'), lambda w: regexp_matches(w, {_CAP}) AND strlen(w) >= 4)[1] AS entity FROM sentences)
      WHERE entity IS NOT NULL), pool WHERE r <= 3)""", "sentences", "pool")
part("choice", """
  SELECT chunk_id, hash, page, pos, r, entity, prompt, unshuffled, list_transform(o1, lambda k: unshuffled[k + 1]) AS options FROM (
    SELECT *, list_transform(o2, lambda x, i: CASE WHEN i = 2 THEN o2[j1 + 1] WHEN i = j1 + 1 THEN o2[2] ELSE x END) AS o1 FROM (
      SELECT *, list_transform(o3, lambda x, i: CASE WHEN i = 3 THEN o3[j2 + 1] WHEN i = j2 + 1 THEN o3[3] ELSE x END) AS o2 FROM (
        SELECT *, list_transform([0, 1, 2, 3], lambda x, i: CASE WHEN i = 4 THEN j3 WHEN i = j3 + 1 THEN 3 ELSE x END) AS o3 FROM (
          SELECT *, h3 % 4 AS j3, h2 % 3 AS j2, ((h2 * 1664525 + 1013904223) & 4294967295) % 2 AS j1 FROM (
            SELECT *, (h3 * 1664525 + 1013904223) & 4294967295 AS h2 FROM choice_base)))))""", "choice_base")
part("score_q", f"""
  SELECT chunk_id, hash, page_start AS page, replace(replace(replace({quoted(_T.score)}, '{{{{trecho}}}}', {shorten('text', 160)}), '{{{{min}}}}', '0'), '{{{{max}}}}', '10') AS prompt,
    0.0::DOUBLE AS min, 10.0::DOUBLE AS max FROM hashed""", "hashed")
part("questions", """
  SELECT chunk_id * 256 + pos AS q_id, 'noul' AS type, prompt, NULL::VARCHAR[] AS options, NULL::DOUBLE AS min, NULL::DOUBLE AS max, claim, page, hash AS chunk_hash, chunk_id FROM noul UNION ALL
  SELECT chunk_id * 256 + 64 + r - 1, 'choice', prompt, options, NULL, NULL, NULL, page, hash, chunk_id FROM choice UNION ALL
  SELECT chunk_id * 256 + 128, 'score', prompt, NULL, min, max, NULL, page, hash, chunk_id FROM score_q""", "noul", "choice", "score_q")
part("sampled", """
  SELECT * EXCLUDE (h) FROM (SELECT *, md5('42/' || q_id) AS h FROM questions) ORDER BY h
  LIMIT (SELECT CAST(least(count(*), greatest(1, floor(count(*) * 0.1::DOUBLE + 0.5))) AS BIGINT) FROM questions)""", "questions")
ranking("eval_", "SELECT q_id, prompt AS question FROM questions", "questions")
part("outcomes", """
  SELECT d.*, type, s.page AS expected, CAST(NOT refused AND d.page = s.page AS INTEGER) AS hit FROM eval_decisions d JOIN questions s USING (q_id)""", "eval_decisions", "questions")
part("bins", """
  SELECT CAST(greatest(0, least(4, floor(confidence * 5))) AS INTEGER) AS bin, count(*) AS n, avg(hit) AS accuracy, avg(confidence) AS mean_confidence FROM outcomes GROUP BY bin""", "outcomes")
part("points", """
  SELECT score, 1 AS y FROM eval_ranked WHERE rank = 1 UNION ALL SELECT score, 0 FROM probe_ranked WHERE rank = 1""", "eval_ranked", "probe_ranked")
part("grid", """
  SELECT CAST(ci AS INTEGER) AS ci, CAST(si AS INTEGER) AS si, CAST(li AS INTEGER) AS li, 0.05::DOUBLE + 0.05::DOUBLE * ci AS center, 4.0::DOUBLE + 2.0::DOUBLE * si AS slope, 0.10::DOUBLE + 0.01::DOUBLE * li AS threshold
  FROM range(12) a(ci), range(14) b(si), range(81) c(li)""")
