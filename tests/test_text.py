import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.hashing import fnv1a, fnv1a_all, hex8, shuffled

CASES = [
    ("o de para com", []),
    ("Coracao e arvore", ["coracao", "arvore"]),
    ("coração cláusula", ["coracao", "clausula"]),
    ("profissionais acoes investidores", ["profissional", "acao", "investidor"]),
    ("falando assinado funcoes", ["fala", "assina", "funcao"]),
    ("rapidamente pais meses contratos anos falar", ["rapida", "pai", "mes", "contrato", "ano", "fala"]),
    ("homens bens", ["homenm", "benm"]),
    ("A" * 50, []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_tokens(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.tokens(F.col("t"))).first()[0] == want


def test_tables_hold_what_they_should():
    # literal values, so that a slip in a table can't pass by being in query and SQL alike
    assert {"nao", "voce", "etc", "quando", "seja"} <= set(T.STOP_WORDS) and "livro" not in T.STOP_WORDS
    assert [T.stem(w) for w in ("animais", "limoes", "cantando", "lentamente", "vendido", "mares", "comer", "passo")] == ["animal", "limao", "canta", "lenta", "vendi", "mar", "come", "passo"]


def test_folded_words(spark):
    got = spark.createDataFrame([("Ação PÊSSEGO über Ñandú Straße",)], "t string").select(T.fold(F.col("t"))).first()[0]
    assert got.split() == ["acao", "pessego", "uber", "nandu", "strasse"]


def test_stem_flag(spark):
    assert T.stem("homens", True) == "homem" and T.stem("homens") == "homenm"


def test_odd_characters(spark):
    got = spark.createDataFrame([("“x” º œuvre Straße Ægis É日本",)], "t string").select(T.raw_tokens(F.col("t"))).first()[0]
    assert "strasse" in got and "aegis" in got and all(c.isascii() for w in got for c in w)


def test_fnv(spark):
    assert [int(x) for x in fnv1a_all(["entropia", "capital", "capital brasil", "coração", "", None])] == [1027471897, 3776985003, 2217800100, 1169049191, 2166136261, 2166136261]
    df = spark.createDataFrame([("coração",)], "t string")
    assert df.select(hex8(fnv1a("t"))).first()[0] == f"{1169049191:08x}"


def test_shuffle():
    assert shuffled(10, 42) == [0, 4, 6, 5, 2, 8, 1, 9, 7, 3]


def test_sentences_and_cuts(spark):
    text = 'First sentence is long enough. Short. "Quoted one that ends here!" And 3.14 stays whole; fine then'
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(T.sentences(F.col("t"))).first()[0]
    assert got[0] == "First sentence is long enough." and '" And 3.14 stays whole;' in got
    assert df.select(T.shorten(F.col("t"), 18)).first()[0] == "First sentence is"
    assert df.select(T.render("{{a}} {{b}}", a=F.lit("$1"))).first()[0] == "$1 {{b}}"
