"""Typed questions from chunks: claims to verify, choices with distractors, relevance scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.hashing import fnv1a, lcg
from textloom.functions.text import is_capital, render, sentences, shorten
from textloom.sources.config import Templates

# The filler of missing options and the multiplier that spreads a sentence's place.
FILLER = ("Alternativa ", " (nao consta no trecho)")
SPREAD = 2654435761
CLAIM, EXCERPT = 220, 160


def sentence_rows(chunks: DataFrame) -> DataFrame:
    """(chunk_id, hash, page, pos, sentence)."""
    return chunks.select("chunk_id", "hash", F.col("page_start").alias("page"), F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))


def entities(rows: DataFrame) -> DataFrame:
    """(chunk_id, pos, island, entity): runs of capitalised words of 3 bytes or more in each sentence."""
    ws = F.array_remove(F.split(F.translate("sentence", ",:()", "    "), "[ \t\r\n\"']+"), "")
    words = rows.select("chunk_id", "pos", F.posexplode(ws).alias("k", "word")).withColumn("cap", is_capital(F.col("word")) & (F.octet_length("word") >= 3))
    order = Window.partitionBy("chunk_id", "pos").orderBy("k")
    runs = words.withColumn("island", F.sum(F.when(F.col("cap"), 0).otherwise(1)).over(order)).where("cap")
    # a run lies between two breaks: the breaks before it tell it from others
    return runs.groupBy("chunk_id", "pos", "island").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("entity"))


def first_entities(found: DataFrame, n: int = 4) -> DataFrame:
    """(entity, at): the first n distinct entities of the package, by first occurrence."""
    return found.groupBy("entity").agg(F.min(F.struct("chunk_id", "pos", "island")).alias("at")).orderBy("at").limit(n)


def noul(rows: DataFrame, most: int = 5, templates: Templates = Templates()) -> DataFrame:
    few = rows.where(F.col("pos") < most)
    prompt = render(templates.noul, afirmacao=shorten(F.col("sentence"), CLAIM), pagina=F.col("page"))
    return few.select("chunk_id", "hash", "page", "pos", prompt.alias("prompt"), F.col("sentence").alias("claim"))


def local_entity(sentence: Column) -> Column:
    ws = F.split(sentence, "[ \t\r\n\"'(),.:;]+")
    return F.get(F.filter(ws, lambda w: is_capital(w) & (F.octet_length(w) >= 4)), F.lit(0))


def shuffle_options(options: Column, hashed: Column, pos: Column) -> Column:
    """Four options in an order that the chunk's hash and the sentence's place fix."""
    h3 = hashed.bitwiseXOR((pos.cast("long") * F.lit(SPREAD)).bitwiseAND(F.lit(0xFFFFFFFF)))
    h2 = lcg(h3)
    h1 = lcg(h2)

    def swap(at: Column, z: int, j: Column) -> Column:
        return F.transform(at, lambda x, i: F.when(i == z, F.get(at, j)).when(i == j, F.get(at, F.lit(z))).otherwise(x))

    order = F.array(*[F.lit(k) for k in range(4)])
    for z, h in ((3, h3), (2, h2), (1, h1)):
        order = swap(order, z, (h % (z + 1)).cast("int"))
    return F.transform(order, lambda k: F.get(options, k))


def choice(rows: DataFrame, found: DataFrame, most: int = 3, templates: Templates = Templates()) -> DataFrame:
    """The first sentences of a chunk with an entity of their own; distractors are the package's first others."""
    with_one = rows.withColumn("entity", local_entity(F.col("sentence"))).where("entity IS NOT NULL")
    order = Window.partitionBy("chunk_id").orderBy("pos")
    few = with_one.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")
    # four entities are enough for three that differ from any one: one small row for all
    firsts = first_entities(found).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "entity"))), lambda x: x["entity"]).alias("pool"))
    put = few.crossJoin(F.broadcast(firsts)).withColumn("h", fnv1a("hash"))
    others = F.slice(F.filter("pool", lambda e: e != F.col("entity")), 1, 3)
    fill = F.array(*[F.lit(f"{FILLER[0]}{k}{FILLER[1]}") for k in range(2, 5)])
    options = F.concat(F.array("entity"), others, F.slice(fill, F.size(others) + 1, F.lit(3) - F.size(others)))
    prompt = render(templates.choice, trecho=shorten(F.col("sentence"), EXCERPT), pagina=F.col("page"))
    put = put.withColumn("options", options)
    return put.select("chunk_id", "hash", "page", "pos", "entity", prompt.alias("prompt"), F.col("options").alias("unshuffled"), shuffle_options(F.col("options"), F.col("h"), F.col("pos")).alias("options"))


def score(chunks: DataFrame, most: int = 2, templates: Templates = Templates()) -> DataFrame:
    prompt = render(templates.score, trecho=shorten(F.col("text"), EXCERPT), min=F.lit("0"), max=F.lit("10"), pagina=F.col("page_start"))
    rows = chunks.select("chunk_id", "hash", F.col("page_start").alias("page"), prompt.alias("prompt"), F.lit(0.0).alias("min"), F.lit(10.0).alias("max"))
    return rows if most >= 1 else rows.limit(0)


def generate(chunks: DataFrame, max_choice: int = 3, max_score: int = 2, max_noul: int = 5, templates: Templates = Templates()) -> DataFrame:
    """(q_id, type, prompt, options, min, max, claim, page, chunk_hash, chunk_id); ids order as chunk, kind, place."""
    rows = sentence_rows(chunks)
    none = lambda t: F.lit(None).cast(t)

    def shape(df: DataFrame, kind: str, at: int, place: Column, options: Column, low: Column, high: Column, claim: Column) -> DataFrame:
        # 64 places a kind and chunk are far more than any limit asks for
        q = F.col("chunk_id") * 256 + at * 64 + place
        return df.select(q.alias("q_id"), F.lit(kind).alias("type"), "prompt", options.alias("options"), low.alias("min"), high.alias("max"), claim.alias("claim"), "page", F.col("hash").alias("chunk_hash"), "chunk_id")

    a = shape(noul(rows, max_noul, templates), "noul", 0, F.col("pos"), none("array<string>"), none("double"), none("double"), F.col("claim"))
    c = choice(rows, entities(rows), max_choice, templates)
    c = c.withColumn("nth", F.row_number().over(Window.partitionBy("chunk_id").orderBy("pos")) - 1)
    b = shape(c, "choice", 1, F.col("nth"), F.col("options"), none("double"), none("double"), none("string"))
    s = shape(score(chunks, max_score, templates), "score", 2, F.lit(0), none("array<string>"), F.col("min"), F.col("max"), none("string"))
    return a.unionByName(b).unionByName(s)
