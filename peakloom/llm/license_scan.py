"""Operator 9: license scans by diagonal voting, in DataFrame functions only.

Every rolling word k-gram of a document is hashed and joined to the template table's k-grams (equal hash and
equal words); hashes outside the table's fixed, small set leave their array before it becomes rows. A match
votes for its diagonal, document word minus template word: an unbroken copy of a template lies on one diagonal,
and a copy with a word more or less goes on on a neighbouring one. A diagonal's votes are the template places
that it holds. Each diagonal is merged with those up to NEAR above it, never further, so that a phrase which is
said again and again does not run on; a place that several of them hold counts once. A span's score is the
share of the template's k-grams, as words, that it holds in their order (but for NEAR words), and labels it from
SHARE on. A phrase is verified when its diagonal holds every one of its k-grams: these then are its words,
consecutively.

The template table is made of the constants below and so is of fixed, small size: it is broadcast.

Cases: a null or empty text has no words, no places and score 0; overlapping places of a phrase all count;
each row gives a row of its own, also where rows are equal, share a doc_id or have none; other columns, however
named, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, texts

K = 3
NEAR = 3  # diagonals this close are one copy
SHARE = 0.6  # of a template's k-grams, for its label
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and the labels that their presence gives.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Opening words of well-known license texts and notices, and their labels.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-text",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-text",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-notice",
    "this work is licensed under a creative commons attribution": "cc-notice",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc-text",
    "licensed under the gnu general public license version": "gpl",
    "released under the mit license": "mit-notice",
    "this work is licensed under cc by": "cc-by",
}


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_array(text: Column) -> Column:
    """Words of a text, in order; none for null."""
    cut = F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAPS, -1)
    return F.filter(cut, lambda w: w != "")


def template_rows(phrases: dict[str, str], templates: dict[str, str], k: int = K) -> list[tuple]:
    """(gram, template, label, phrase, at, n_grams): one row a k-gram of a phrase or template."""
    rows = []
    for phrase, table in ((True, phrases), (False, templates)):
        for text, label in table.items():
            words = text.split(" ")
            if len(words) < k:
                raise ValueError(f"fewer than {k} words: {text}")
            rows += [(" ".join(words[i : i + k]), text, label, phrase, i, len(words) - k + 1) for i in range(len(words) - k + 1)]
    return rows


def license_votes(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, template, label, phrase, n_grams, diagonal, places, n_words); one row without template carries n_words.

    ``places`` are the template's places that the diagonal holds. ``row`` numbers the rows of ``docs``; it holds
    within one evaluation, so that the votes have to be materialized once.
    """
    known = template_rows(phrases or PHRASES, templates or TEMPLATES, k)
    table = docs.sparkSession.createDataFrame(known, "gram string, template string, label string, phrase boolean, at int, n_grams int").withColumn("hash", F.xxhash64("gram"))
    table_hashes = [r.hash for r in table.select("hash").distinct().collect()]  # of the constants above
    base = texts(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", word_array(F.col("text")).alias("words"))

    def gram(i: Column) -> Column:
        return F.concat_ws(" ", *[F.get(F.col("words"), i + j) for j in range(k)])

    rolling = F.transform("words", lambda w, i: F.struct(i.alias("place"), F.xxhash64(gram(i)).alias("hash")))
    held = F.transform(F.filter(rolling, lambda g: g["hash"].isin(table_hashes)), lambda g: F.struct(g["place"].alias("place"), g["hash"].alias("hash"), gram(g["place"]).alias("gram")))
    # place -1 is the document's own row, so that documents without a match stay
    own = F.array(F.struct(F.lit(-1).alias("place"), F.lit(0).cast("long").alias("hash"), F.lit("").alias("gram")))
    each = base.select("row", "doc_id", F.size("words").alias("n_words"), F.explode(F.concat(own, held)).alias("g")).select("row", "doc_id", "n_words", "g.*")
    each = each.withColumn("n_words", F.when(F.col("place") == -1, F.col("n_words")))
    voted = each.join(F.broadcast(table), ["hash", "gram"], "left").where(F.col("n_words").isNotNull() | F.col("template").isNotNull())
    return voted.groupBy("row", "doc_id", "template", "label", "phrase", "n_grams", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("places"), F.sum("n_words").alias("n_words"))


def license_spans(votes: DataFrame, near: int = NEAR) -> DataFrame:
    """(row, doc_id, template, label, phrase, start, score): merged diagonals; score = share of the template's k-grams.

    Of spans that start within ``near`` words of each other the best is listed, of equal ones the last.
    """
    matched = votes.where(F.col("template").isNotNull())
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    reach = F.collect_list(F.struct("diagonal", "places")).over(by.rangeBetween(0, near))
    held = F.filter(reach, lambda x: ~F.col("phrase") | (x["diagonal"] == F.col("diagonal")))
    n_held = F.size(F.array_distinct(F.flatten(F.transform(held, lambda x: x["places"]))))
    scored = matched.withColumn("score", n_held / F.col("n_grams"))
    rank = F.struct("score", "diagonal")
    best = F.col("phrase") | (rank == F.max(rank).over(by.rangeBetween(-near, near)))
    return scored.withColumn("best", best).where("best").select("row", "doc_id", "template", "label", "phrase", F.col("diagonal").alias("start"), "score")


def license_digests(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row.

    score is the largest share of a template's k-grams on merged diagonals, or 1 where a whole phrase stands; labels
    holds those of whole phrases and of templates with at least ``share``.
    """
    votes = materialize(license_votes(docs), "votes")
    spans = license_spans(votes).withColumn("base", F.col("phrase") & (F.col("score") == 1))
    found = spans.where(F.col("base") | ~F.col("phrase"))
    sizes = votes.where(F.col("n_words").isNotNull()).select("row", "doc_id", F.col("n_words").cast("long").alias("n_words"))
    one = found.select("row", "doc_id", F.lit(None).cast("long").alias("n_words"), "label", "base", "start", "score")
    rows = one.unionByName(sizes, allowMissingColumns=True)
    base = F.col("base") == True  # noqa: E712
    by_row = rows.groupBy("row", "doc_id").agg(
        F.sum("n_words").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(base | (F.col("score") >= share), F.col("label")))), ",").alias("labels"),
        F.round(F.coalesce(F.max("score"), F.lit(0.0)), 6).alias("score"),
    )
    return by_row.drop("row")
