"""Text rules as columns: accent folding, tokens, stems, sentences and cuts.

All but the stemmer are built-in expressions. Single letters are folded by one ``translate``; only texts with other
characters take the regular expressions for them.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Common Portuguese words that carry no content, without accents.
STOP_WORDS = tuple(
    """
    a ao aos aquela aquelas aquele aqueles aquilo as ate com como da das de dela delas dele deles depois do dos e
    ela elas ele eles em entre era eram essa essas esse esses esta estamos estas estava estavam este estes estou eu
    foi foram ha isso isto ja lhe lhes mais mas me mesmo meu meus minha minhas muito na nao nas nem no nos nossa
    nossas nosso nossos num numa o os ou para pela pelas pelo pelos por qual quando que quem se seja sejam sem somos
    sou sua suas tambem te tem tendo tenha ter teu teus ti tinha tive tivemos tiver tiverao tu tua tuas um uma umas
    uns voce voces vos vosso vossos d s n sim sera serao ser estar estao porque pois entao assim onde cada outra
    outras outro outros toda todas todo todos muita muitas muitos pouca poucas pouco poucos tanto tanta seu seus min
    etc
    """.split()
)

# What letters fold to.
FOLD_ONE = (("ÀÁÂÃÄÅàáâãäå", "a"), ("Çç", "c"), ("ÈÉÊËèéêë", "e"), ("ÌÍÎÏìíîï", "i"), ("Ð", "d"), ("Ññ", "n"), ("ÒÓÔÕÖØòóôõöø", "o"), ("ÙÚÛÜùúûü", "u"), ("Ýýÿ", "y"), ("Þ", "t"))
FOLD_TWO = (("Æ", "ae"), ("æ", "ae"), ("ß", "ss"))
# Ranges of other characters and the letter that stands for them, before a space.
FOLD_RANGES = (
    (r"[\x{0080}-\x{00BF}\x{0100}-\x{017F}\x{0800}-\x{5FFF}]", "a "),
    (r"[\x{01C0}-\x{01FF}\x{7000}-\x{7FFF}]", "c "),
    (r"[\x{0200}-\x{02FF}\x{8000}-\x{BFFF}]", "e "),
    (r"[\x{0300}-\x{03FF}\x{C000}-\x{FFFF}]", "i "),
    (r"[\x{0440}-\x{047F}\x{40000}-\x{7FFFF}]", "n "),
    (r"[\x{0480}-\x{05BF}\x{80000}-\x{10FFFF}]", "o "),
    (r"[\x{0640}-\x{073F}]", "u "),
    (r"[\x{0740}-\x{077F}]", "y "),
)
BLANK = r"[ \t\n\x0B\f\r]+"
MIN_TOKEN, MAX_TOKEN, MAX_RUN = 2, 30, 5


def fold(text: Column) -> Column:
    """Lower-case text of [a-z0-9] and spaces."""
    t = F.translate(text, "".join(a for a, _ in FOLD_ONE), "".join(b * len(a) for a, b in FOLD_ONE))
    for a, b in FOLD_TWO:
        t = F.replace(t, F.lit(a), F.lit(b))
    rest = t
    for pattern, to in FOLD_RANGES:
        rest = F.regexp_replace(rest, pattern, to)
    t = F.when(t.rlike(r"[^\x00-\x7F]"), rest).otherwise(t)
    return F.lower(F.regexp_replace(t, "[^A-Za-z0-9]+", " "))


def raw_tokens(text: Column) -> Column:
    return F.array_remove(F.split(fold(text), " "), "")


def keeps_token(w: Column) -> Column:
    return (F.length(w) >= MIN_TOKEN) & (F.length(w) <= MAX_TOKEN) & ~w.rlike(r"(.)\1{%d}" % (MAX_RUN - 1)) & ~w.isin(*STOP_WORDS)


_VOWELS = frozenset("aeiou")


def stem(w: str, fix_ens: bool = False) -> str:
    """The first rule that fits; with ``fix_ens`` the ending -ens becomes -em."""
    n = len(w)
    if n > 7 and w.endswith("mente"):
        return w[:-5]
    if n > 3 and w.endswith("oes"):
        return w[:-3] + "ao"
    if n > 4 and w.endswith("is") and w[-3] in "aeou":
        return w[:-2] + "l"
    if n > 3 and w.endswith("ens"):
        return w[:-3] + "em" if fix_ens else w[:-1] + "m"
    if n > 4 and w.endswith("es") and w[-3] not in _VOWELS:
        return w[:-2]
    if n > 3 and w.endswith("s") and w[-2] != "s":
        return w[:-1]
    if n > 4 and w.endswith("r") and w[-2] in "aei":
        return w[:-1]
    if n > 6 and w.endswith("ndo"):
        return w[:-3]
    if n > 5 and w.endswith("do") and w[-3] in "ai":
        return w[:-2]
    return w


_STOPS = frozenset(STOP_WORDS)
_SAME = re.compile(r"(.)\1{%d}" % (MAX_RUN - 1))


class Stems(dict):
    """Stem of each folded word, None for words without content; forgets when it is full."""

    def __missing__(self, w: str) -> str | None:
        if len(self) > 400_000:
            self.clear()
        keeps = MIN_TOKEN <= len(w) <= MAX_TOKEN and w not in _STOPS and not _SAME.search(w)
        got = self[w] = stem(w) if keeps else None
        return got


_stems = Stems()


def stemmed(folded: str | None) -> list[str] | None:
    return None if folded is None else [s for s in map(_stems.__getitem__, folded.split()) if s]


@F.pandas_udf(ArrayType(StringType()))
def _tokens(folded: pd.Series) -> pd.Series:
    return folded.map(stemmed, na_action=None)


def tokens(text: Column) -> Column:
    """Stems of the tokens that carry content, in order: folding is built in, each word is stemmed once a worker."""
    return _tokens(fold(text))


def blank_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def word_count(text: Column) -> Column:
    return F.size(blank_words(text))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")


def sentences(text: Column) -> Column:
    """Trimmed sentences of at least 20 bytes; they end at . ! ? ; before white space, a quote or the end."""
    marked = F.regexp_replace(text, r"([.!?;])([ \t\n\x0B\f\r\"]|\z)", "$1\u001e$2")
    return F.filter(F.transform(F.split(marked, "\u001e"), trimmed), lambda s: F.octet_length(s) >= 20)


def is_capital(w: Column) -> Column:
    return w.rlike(r"^([A-Z0-9]|[^\x00-\x7F])")


def shorten(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut at the last space if that lies beyond the middle."""
    head = F.substring(text, 1, most)
    at = F.length(head) - F.locate(" ", F.reverse(head))
    return F.when(F.length(text) <= most, text).when((F.locate(" ", head) > 0) & (at > most // 2), F.substring(head, F.lit(1), at)).otherwise(head)


def render(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for key, value in values.items():
        out = F.replace(out, F.lit("{{" + key + "}}"), value.cast("string"))
    return out


def text_is_rich(text: Column, n_tokens: Column) -> Column:
    """Enough tokens, bytes and letters to answer from."""
    letters = F.octet_length(F.regexp_replace(text, r"[\x00-@\[-`{-\x7F]", ""))
    return (n_tokens >= 4) & (F.octet_length(text) >= 20) & (100 * letters >= 40 * F.octet_length(text))
