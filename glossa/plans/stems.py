"""Stems of the words of the documents, by morphological analyses that are made from the words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.operators import stemming as S
from glossa.operators.tokens import frequencies
from glossa.plans.catalog import query
from glossa.sources.store import new_folder, saved
from glossa.sources.tables import table

# Fixed values of the analyses that are made: tags of the first part, the second and the third.
FIRST = ("/N", "/Adj", "/V", "/N|Abbr", "/Supl", "/Prev", "/CmpdPfx", "/Num")
SECOND = ("/N", "_ImpfPtcp/Adj", "_Ger/N", "Nom", "Hyph:Hyph", "_Adjz:s/Adj", "/Adj", "_Caus/V")
THIRD = ("Pl", "/N", "_Adjz:i/Adj", "/V", "Hyph:Dash", "Acc", "/Adj|nat")


def analysis_of(word: Column, salt: int) -> Column:
    """An analysis of a word of three parts and an ending; parts and tags vary with the word's hash."""
    n = lambda m, k: F.pmod(F.xxhash64(word, F.lit(salt * 10 + k)), F.lit(m)).cast("int")
    pick = lambda tags, k: F.get(F.array(*map(F.lit, tags)), n(len(tags), k))
    letters = lambda part: F.transform(F.filter(F.split(part, ""), lambda c: c != ""), lambda c: F.concat(c, F.lit(":"), F.translate(c, "áéaö", "aéáő")))
    a, b = F.lit(1) + F.floor(F.length(word) / 2).cast("int"), F.lit(1) + n(3, 1)
    parts = [(F.substring(word, F.lit(1), a), pick(FIRST, 2)), (F.substring(word, a + 1, b), pick(SECOND, 3)), (F.substring(word, a + b + 1, F.length(word)), pick(THIRD, 4))]
    spelled = []
    for part, tag in parts:
        dash = F.startswith(tag, F.lit("Hyph"))
        spelled.append(F.concat(F.when(dash, F.array(F.lit("-:-"))).otherwise(letters(part)), F.array(F.concat(F.lit(":["), tag, F.lit("]")))))
    return F.array_join(F.concat(*spelled, F.array(F.lit(":[Nom]"))), " ")


#: Words of a task: their analyses take some seconds, however few bytes they are.
TASK_WORDS = 50_000


def counted_words(spark, d):
    """word, freq of the documents, counted once, written down and dealt to as many tasks as they need."""
    forms = saved(frequencies(table(spark, d, "documents")), new_folder(spark, "forms"))
    return forms.repartition(-(-forms.count() // TASK_WORDS) or 1, "word")


def analysed(spark, d, forms=None):
    """surf, analyses: two analyses of each distinct word; words in z have none."""
    forms = counted_words(spark, d) if forms is None else forms
    both = F.array(analysis_of(F.col("word"), 1), analysis_of(F.col("word"), 2))
    return forms.select(F.col("word").alias("surf"), F.when(F.startswith("word", F.lit("z")), F.array(F.lit("z:z?"))).otherwise(both).alias("analyses"))


@query("analysed_stems")
def analysed_stems(spark, d):
    """A stem dictionary by analyses: the shortest of the stems that a word's analyses give."""
    forms = counted_words(spark, d)
    frequent = forms.where("freq >= 5").select(F.col("word").alias("surf"))
    return S.stem_dictionary(S.candidates(analysed(spark, d, forms)), frequent, ["the"])
