"""Phrases that stand whole in texts, of any number of words: an anchor join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def phrase_hits(texts: DataFrame, phrases: DataFrame, block: tuple[str, ...] = ()) -> DataFrame:
    """texts(text, words), phrases(phrase, words), both with the block's columns -> *block, text, phrase, once each.

    Each phrase is posted under its rarest word (by the texts that have it); a text meets it where that word stands, and the
    whole phrase is compared with the words around that place. No n-grams are made, so phrases have no length limit, and a
    frequent word joins only where a phrase has none rarer. Texts and phrases meet within a block only. Ids are unique in a
    block; null or empty word lists hit nothing; a phrase with a word that no text has is dropped early. The texts are read more
    than once, so their words must come in the same order each time.
    """
    on = [*block, "word"]
    asked = phrases.select(*block, "phrase", "words", F.posexplode("words").alias("at", "word"))
    places = texts.select(*block, "text", F.posexplode("words").alias("pos", "word")).join(asked.select(*on).distinct(), on, "left_semi")
    counts = places.groupBy(*on).agg(F.count_distinct("text").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "word")).alias("x")
    posted = asked.join(counts, on, "left").groupBy(*block, "phrase").agg(rarest, F.first("words").alias("words")).filter("x.n > 0")
    posted = posted.select(*block, F.col("x.word").alias("word"), "phrase", F.col("x.at").alias("at"), "words")
    reach = posted.groupBy(*on).agg(F.max("at").alias("left"), F.max(F.size("words") - F.col("at")).alias("right"))
    # places are gathered by text, so that a text's words travel once and only windows go on from there
    near = places.join(reach, on).groupBy(*block, "text").agg(F.collect_list(F.struct("pos", "word", "left", "right")).alias("near"))
    near = texts.select(*block, "text", F.col("words").alias("all")).join(near, [*block, "text"]).select(*block, "text", "all", F.explode("near").alias("x"))
    begin = F.greatest(F.col("x.pos") - F.col("x.left"), F.lit(0))
    windows = near.select(*block, "text", F.col("x.word").alias("word"), (F.col("x.pos") - begin).alias("pos"), F.slice("all", begin + 1, F.col("x.left") + F.col("x.right")).alias("window"))
    begins = F.col("pos") - F.col("at")
    whole = (begins >= 0) & (F.slice("window", F.greatest(begins, F.lit(0)) + 1, F.size("words")) == F.col("words"))
    return windows.join(posted, on).filter(whole).select(*block, "text", "phrase").distinct()
