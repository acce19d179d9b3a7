"""Tokens and lemmas. Morphology is a relation (lang, form, normal_form, form_rank, info); without one, a word is its own lemma."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RU, EN = "ru", "en"
#: The letters of each language, in lower case.
LETTERS = {RU: "[а-яё]+", EN: "[a-z]+"}
#: Tags of the closed word classes that are not indexed.
PARTICLE_TAGS = {RU: ("МЕЖД", "ПРЕДЛ", "СОЮЗ", "ЧАСТ"), EN: ("PREP", "ARTICLE", "CONJ")}


def tokens(text: Column, lang: str) -> Column:
    """Array of the language's words: lower-cased, every other character splits. Null gives null, blank an empty array."""
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS[lang]), F.lit(0))


def surface_words(text: Column) -> Column:
    """Array of words in either alphabet with their case kept, in text order."""
    return F.regexp_extract_all(text, F.lit("[а-яёА-ЯЁa-zA-Z]+"), F.lit(0))


def word_language(word: Column) -> Column:
    """ru for a word with any Russian letter, else en."""
    return F.when(F.lower(word).rlike("[а-яё]"), RU).otherwise(EN)


def is_particle(info: Column, lang: Column, faithful: bool = False) -> Column:
    """Whether an analysis is of a closed class. By default the tags alone are compared, word by word;
    ``faithful`` looks for the tag anywhere in the upper-cased analysis, which also drops ordinary words that contain it."""
    test = lambda k: (
        F.upper(info).rlike("|".join(PARTICLE_TAGS[k])) if faithful else F.arrays_overlap(F.split(F.upper(info), r"[\s,|]+"), F.array(*map(F.lit, PARTICLE_TAGS[k])))
    )
    return F.coalesce(F.when(lang == RU, test(RU)).otherwise(test(EN)), F.lit(False))


def token_rows(df: DataFrame, text: Column, *keys: str) -> DataFrame:
    """Rows (keys, lang, word): Russian words, then English ones."""
    none = F.array().cast("array<string>")
    both = F.concat(*(F.coalesce(tokens(text, lang), none) for lang in (RU, EN)))
    # a word of one alphabet tells its language: all Latin letters come before the Russian ones
    return df.select(*keys, F.explode(both).alias("word")).select(*keys, F.when(F.col("word") >= "а", RU).otherwise(EN).alias("lang"), "word")


def dictionary(raw: DataFrame, faithful: bool = False) -> DataFrame:
    """The dictionary as one row for each (lang, form): its normal forms by rank, and whether it is a particle.

    Repeated rows count once; a form is a particle if any of its analyses is.
    """
    return (
        raw.filter(F.col("form").isNotNull() & F.col("normal_form").isNotNull())
        .groupBy("lang", "form")
        .agg(
            F.array_sort(F.collect_set(F.struct(F.coalesce("form_rank", F.lit(0)).alias("r"), F.col("normal_form").alias("n")))).alias("_n"),
            F.max(is_particle(F.col("info"), F.col("lang"), faithful)).alias("particle"),
        )
        .select("lang", F.col("form").alias("word"), F.col("_n.n").alias("normal_forms"), "particle")
    )


def index_lemmas(words: DataFrame, dict_: DataFrame | None) -> DataFrame:
    """Adds ``lemma``: the word's first normal form, the word itself where the dictionary lacks it; particles drop out."""
    if dict_ is None:
        return words.withColumn("lemma", F.col("word"))
    return (
        words.join(dict_, ["lang", "word"], "left")
        .filter(~F.coalesce(F.col("particle"), F.lit(False)))
        .withColumn("lemma", F.coalesce(F.element_at("normal_forms", 1), F.col("word")))
        .drop("normal_forms", "particle")
    )


def query_lemmas(words: DataFrame, dict_: DataFrame | None) -> DataFrame:
    """Rows (word, lemma) of a query's words: all normal forms of each, particles left out, repeats merged."""
    if dict_ is None:
        return words.select("word", F.col("word").alias("lemma")).distinct()
    return (
        words.join(dict_, ["lang", "word"], "left")
        .filter(~F.coalesce(F.col("particle"), F.lit(False)))
        .select("word", F.explode(F.coalesce(F.col("normal_forms"), F.array("word"))).alias("lemma"))
        .distinct()
    )


def words_by_lemmas(df: DataFrame, text: Column, dict_: DataFrame | None, lemmas: list[str], *keys: str) -> DataFrame:
    """(keys, lemma, words): the words of a text, as they are written, of which a normal form is among the lemmas; by the first
    normal form, each spelling once, in the order of the text."""
    rows = df.select(*keys, F.posexplode(surface_words(text)).alias("_pos", "_w")).withColumns({"word": F.lower("_w"), "lang": word_language(F.col("_w"))})
    own = F.array("word")
    if dict_ is not None:
        rows = rows.join(dict_.select("lang", "word", "normal_forms"), ["lang", "word"], "left")
        own = F.coalesce("normal_forms", own)
    rows = rows.withColumn("_n", own).filter(F.arrays_overlap("_n", F.array(*map(F.lit, lemmas))))
    first = rows.groupBy(*keys, F.element_at("_n", 1).alias("lemma"), "_w").agg(F.min("_pos").alias("_pos"))
    ordered = F.array_sort(F.collect_list(F.struct("_pos", "_w")))
    return first.groupBy(*keys, "lemma").agg(F.transform(ordered, lambda x: x["_w"]).alias("words"))
