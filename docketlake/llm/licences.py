"""Licence notices by a positional index of their rarest words. Built-in functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.llm.base import shared_folder
from docketlake.llm.licence_texts import PASSAGES, words

#: Phrases whose every place counts, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: (label, words, phrase that must stand in its place) of each passage of the common licences.
TEMPLATES = tuple((label, " ".join(words(text)), phrase) for label, text, phrase in PASSAGES)
#: What the index holds: the templates, then each base phrase as a notice that must stand whole.
NOTICES = TEMPLATES + tuple((label, phrase, phrase) for phrase, label in BASE)
VOCABULARY = tuple(sorted({w for _, _, p in NOTICES for w in p.split()}))


def spaced(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, with one space before, between and after; one space for none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def own_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_words, own, words): the phrase words that each file holds, and its text where they cover a whole phrase, else null.

    Every text is split once, here, into a table of the shared folder; only files that may hold a notice keep their words.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/licences-{uuid.uuid4().hex}"
    source = docs.select(F.col(id_col).alias("doc_id"), spaced(F.col(text_col)).alias("words"))
    own = F.array_intersect(F.split(F.trim("words"), " "), F.array(*map(F.lit, VOCABULARY)))
    rows = source.select("doc_id", (_spaces(F.col("words")) - 1).cast("long").alias("n_words"), own.alias("own"), "words")
    phrases = F.array(*[F.array(*map(F.lit, sorted(set(p.split())))) for p in sorted({p for _, _, p in NOTICES})])
    covered = F.exists(phrases, lambda p: F.forall(p, lambda w: F.array_contains("own", w)))
    rows = rows.withColumn("words", F.when(F.when(F.size("own") > 0, covered), F.col("words")))
    rows.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def document_frequencies(rows: DataFrame) -> dict[str, int]:
    """In how many rows each phrase word occurs: one number for each word of the mandatory phrases, over all rows of `own`."""
    held = rows.select(F.explode("own").alias("word"))
    return {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}


def _phrase_start(text: str, phrase: str) -> int:
    """The place of a notice's mandatory phrase in it, in words."""
    return f" {text} "[: f" {text} ".index(f" {phrase} ")].count(" ")


def postings(frequencies: dict[str, int]) -> dict[str, list[tuple[int, int, str, int]]]:
    """Rarest word of each mandatory phrase: (notice, its position, second rarest word, that one's position), of equals the first in the phrase.

    Words stand in the order of their rarity. A file with a counted notice holds its whole phrase, so these are the highest-IDF words that the file has of it.
    """
    out: dict[str, list[tuple[int, int, str, int]]] = {}
    for t, (_, text, phrase) in enumerate(NOTICES):
        order = phrase.split()
        rare = sorted(set(order), key=lambda w: (frequencies.get(w, 0), order.index(w)))[:2]
        (a, j), (b, k) = ((w, _phrase_start(text, phrase) + order.index(w)) for w in rare)
        out.setdefault(a, []).append((t, j, b, k))
    return dict(sorted(out.items(), key=lambda x: (frequencies.get(x[0], 0), x[0])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: float = 0.6) -> DataFrame:
    """(doc_id, n_words, base, base_labels, labels, score, templates), one row per input row.

    base: starts of the base phrases, ascending. templates: found notices as structs of template number,
    start and share of its words in place. A file's own phrase words are looked up in the index, the rarest first: under each stand the
    notices whose rarest phrase word it is, with its position and the next rarest word, which the file must hold as well. The places of both words in the
    file, less their positions in the notice, are intersected, and the notice is laid at each start that is left. A template counts if at least `min_share` of its words and the whole mandatory
    phrase stand in their places, a base phrase if all its words do. labels are those of both; score is 1 with
    a base phrase, else the best share, else 0.

    A null or empty text has no words, no labels and score 0; a null id stays null. Each row is scanned on its
    own (no shuffle but for the word frequencies, which are one number per phrase word over all rows and change only the
    order of lookups, never a result), so ties and repeated rows need no care. Texts are split once; those that cover no phrase are not read again. Time grows with the words of a
    text, and with n log n of the places it is looked up at. Other columns are not read. An empty table gives an empty result.
    """
    rows = own_words(docs, id_col, text_col)
    index = postings(document_frequencies(rows))
    entry = lambda w, t, j, v, k: F.struct(F.lit(t).alias("t"), F.lit(w).alias("w"), F.lit(j).alias("k"), F.lit(v).alias("w2"), F.lit(k).alias("k2"))
    posted = F.create_map(*[x for w, found in index.items() for x in (F.lit(w), F.array(*[entry(w, *f) for f in found]))])
    rarest = F.array_intersect(F.array(*map(F.lit, index)), "own")  # the file's own words, the rarest first
    looked = F.flatten(F.transform(rarest, lambda w: F.element_at(posted, w)))
    notices = F.filter(looked, lambda x: F.array_contains("own", x["w2"]))
    none = F.array().cast("array<string>")
    hit = rows.select("doc_id", "n_words", F.when(F.col("words").isNotNull(), notices).alias("notices"), F.when(F.col("words").isNotNull(), F.split(F.trim("words"), " ")).otherwise(none).alias("tokens"))
    hit = hit.withColumn("notices", F.coalesce("notices", F.filter(F.array(entry("", 0, 0, "", 0)), lambda x: F.lit(False))))
    hit = hit.withColumn("held", F.array_union(F.transform("notices", lambda x: x["w"]), F.transform("notices", lambda x: x["w2"])))
    hit = hit.withColumn("at", F.filter(F.transform("tokens", lambda w, i: F.when(F.array_contains("held", w), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull()))
    starts = lambda w, k: F.transform(F.filter("at", lambda a: a["w"] == w), lambda a: a["i"] - k)
    places = F.transform("notices", lambda x: F.transform(F.array_intersect(starts(x["w"], x["k"]), starts(x["w2"], x["k2"])), lambda s: F.struct(x["t"].alias("t"), s.alias("start"))))
    hit = hit.withColumn("places", F.sort_array(F.flatten(places)))
    texts = F.array(*[F.split(F.lit(t), " ") for _, t, _ in NOTICES])
    first = F.array(*[F.lit(_phrase_start(t, p)) for _, t, p in NOTICES])
    size = F.array(*[F.lit(len(p.split())) for _, _, p in NOTICES])

    def lay(c: Column) -> Column:
        same = F.transform(F.get(texts, c["t"]), lambda w, k: F.coalesce(F.when(c["start"] + k >= 0, F.get("tokens", c["start"] + k)) == w, F.lit(False)))
        phrase = F.slice(same, F.get(first, c["t"]) + 1, F.get(size, c["t"]))
        return F.struct(c["t"].alias("template"), c["start"].alias("start"), (F.size(F.filter(same, lambda x: x)) / F.size(same)).alias("share"), F.forall(phrase, lambda x: x).alias("verified"))

    hit = hit.withColumn("found", F.filter(F.transform("places", lay), lambda x: x["verified"] & (x["share"] >= min_share)))
    hit = hit.withColumn("templates", F.filter("found", lambda x: x["template"] < len(TEMPLATES))).withColumn("whole", F.filter("found", lambda x: x["template"] >= len(TEMPLATES)))
    names = F.array(*[F.lit(n) for n, _, _ in NOTICES])
    labels = lambda found: F.array_sort(F.array_distinct(F.transform(found, lambda x: F.get(names, x["template"]))))
    return hit.select(
        "doc_id",
        "n_words",
        F.array_sort(F.transform("whole", lambda x: x["start"].cast("long"))).alias("base"),
        labels("whole").alias("base_labels"),
        labels("found").alias("labels"),
        F.when(F.size("whole") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("templates", lambda x: x["share"])), F.lit(0.0))).alias("score"),
        "templates",
    )
