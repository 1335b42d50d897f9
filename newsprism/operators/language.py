"""Language of texts by letter trigrams of their words, learned from labelled texts.

Letter trigrams are counted once a distinct word, so what is joined with the model are distinct words, not
letters of the corpus.  A text's language is the one under which its words'
trigrams are likeliest; texts of fewer than SHORTEST characters have none.  JVM functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsprism.storage import stored

#: Fewest characters of a text whose language is told.
SHORTEST = 20
#: What is added to every count of a trigram.
SMOOTH = 0.5
#: Most words whose gains are sent to the texts.
SMALL = 1_000_000
LETTERS = r"[\p{L}\p{M}]+"


def trigrams_of(words: DataFrame) -> DataFrame:
    """(word, gram) of distinct words, the blanks around them included; repeats stay."""
    listed = F.regexp_extract_all(F.concat(F.lit(" "), "word", F.lit(" ")), F.lit(r"(?s)(?=(...))"), F.lit(1))
    return words.select("word", F.explode(listed).alias("gram"))


def train(labelled: DataFrame) -> DataFrame:
    """(language, gram, weight) of texts (id, text, language): log probabilities, and for each language
    a row without gram for trigrams that it lacks.  As many rows as there are trigrams in use."""
    known = labelled.where("language is not null and text is not null")
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0)))
    counted = known.select("language", words.alias("word")).groupBy("language", "word").agg(F.count("*").alias("n"))
    counted = stored(counted, "words")
    grams = trigrams_of(counted.select("word").distinct()).join(counted, "word").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    grams = stored(grams, "grams")
    kinds = grams.agg(F.countDistinct("gram").alias("kinds"))
    totals = grams.groupBy("language").agg(F.sum("n").alias("total")).crossJoin(F.broadcast(kinds))  # one row
    low = F.col("total") + SMOOTH * (F.col("kinds") + 1)
    seen = grams.join(totals, "language").select("language", "gram", F.log((F.col("n") + SMOOTH) / low).alias("weight"))
    return seen.union(totals.select("language", F.lit(None).cast("string"), F.log(SMOOTH / low)))


def detect(texts: DataFrame, model: DataFrame) -> DataFrame:
    """(id, language) of texts (id, text); null where a text is short or has no letters.  Ids are distinct.

    A word has one row with a gain for each language.  Up to SMALL words they are sent to the texts: a text's
    words then lie beside each other and are summed before anything is shuffled."""
    rest = model.where("gram is null").select("language", F.col("weight").alias("floor"))
    floors = {r.language: r.floor for r in rest.collect()}  # a row a language
    names = sorted(floors)
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0)))
    said = texts.where(F.length("text") >= SHORTEST).select("id", words.alias("word"))
    grams = trigrams_of(said.select("word").distinct()).groupBy("word", "gram").agg(F.count("*").alias("times"))
    # a word's score: the floor for each of its trigrams, and what known ones have above it
    above = model.where("gram is not null").groupBy("gram").agg(*(F.max(F.when(F.col("language") == n, F.col("weight") - floors[n])).alias(f"g{k}") for k, n in enumerate(names)))
    gain = [F.coalesce(F.sum(F.col(f"g{k}") * F.col("times")), F.lit(0.0)).alias(f"g{k}") for k in range(len(names))]
    gained = stored(grams.join(above, "gram").groupBy("word").agg(*gain), "gained")
    if gained.limit(SMALL + 1).count() <= SMALL:
        gained = F.broadcast(gained)
    else:
        said = said.groupBy("id", "word").agg(F.count("*").alias("n"))
    n = F.col("n") if "n" in said.columns else F.lit(1)
    sums = [F.sum(n * F.coalesce(f"g{k}", F.lit(0.0))).alias(f"g{k}") for k in range(len(names))]
    totals = said.join(gained, "word", "left").groupBy("id").agg(F.sum(n * F.length("word")).alias("letters"), *sums)
    scores = [F.struct((-(F.col("letters") * floors[name] + F.col(f"g{k}"))).alias("low"), F.lit(name).alias("language")) for k, name in enumerate(names)]
    found = totals.select("id", F.array_min(F.array(*scores))["language"].alias("language")) if names else totals.select("id", F.lit(None).cast("string").alias("language"))
    return texts.select("id").join(found, "id", "left")
