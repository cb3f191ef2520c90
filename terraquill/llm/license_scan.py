"""License scan by diagonal voting, in DataFrame operations only.

All rolling three-word grams of every text are joined, by hash and then by their words, to the grams of
the license templates. A gram at word p of the text and word q of a template votes for the diagonal p - q. Votes on one
diagonal, at most ``MAX_HOLE`` places apart, form a run. From each run on, runs of neighbouring diagonals are merged where text and template both
go on: each begins after the last place of the one before, at most ``MAX_SHIFT`` diagonals from it, and within the
template's length times ``MAX_STRETCH``. So a word left out or put in doesn't cut a match, and repeated notices stay apart.

A span is verified by its grams: ``MIN_COVER`` of the template's, or ``MIN_RUN`` of a long template's with that density. Licenses that are worded alike are told
apart by the grams that only one of them has: of each template with another label that shares ``SIBLING`` of a template's grams, the
span must hold the template's own grams, all of up to ``FEW``, ``KEY_SHARE`` of more. A text of a sibling that is in no template thus has no label. Spans that overlap
compete: the one with most grams is kept, of equals the first, of these the first template. Kept spans give labels, score and the listed spans.

The three base phrases are templates like the others; on one diagonal with all of a phrase's grams, the
phrase's words stand consecutively, so such diagonals are exactly its places. They don't compete.

Defined cases: a null text is empty and has no words. Repeated rows each give the same row. Texts of fewer than three words match
nothing. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terraquill.llm.common import Scratch, lower_ascii

GRAM = 3
MAX_HOLE = 8
MAX_SHIFT = 3
MIN_COVER = 0.6
MIN_RUN = 24
MAX_STRETCH = 1.5
SIBLING, FEW, KEY_SHARE = 0.4, 4, 0.6

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases whose places are counted.
BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Public license texts and notices, as words of ``license_words``.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("lgpl-2", "licensed under the gnu lesser general public license version 2 1"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("gpl-2", "the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3", "the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2", "the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3", "the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3", "the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details"),
    ("lgpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nc-nd", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("all-rights-reserved", "all rights reserved"),
    ("mit", "spdx license identifier mit"),
    ("isc", "spdx license identifier isc"),
    ("apache-2", "spdx license identifier apache 2 0"),
    ("bsd", "spdx license identifier bsd 2 clause"),
    ("bsd-3", "spdx license identifier bsd 3 clause"),
    ("gpl-2", "spdx license identifier gpl 2 0"),
    ("gpl-3", "spdx license identifier gpl 3 0"),
    ("lgpl-2", "spdx license identifier lgpl 2 1"),
    ("lgpl-3", "spdx license identifier lgpl 3 0"),
    ("agpl-3", "spdx license identifier agpl 3 0"),
    ("mpl-2", "spdx license identifier mpl 2 0"),
    ("zlib", "spdx license identifier zlib"),
    ("unlicense", "spdx license identifier unlicense"),
)


def license_words(text: Column) -> Column:
    """Lower-cased words: runs of ASCII letters, digits and all characters outside ASCII."""
    return F.array_remove(F.split(lower_ascii(text), _GAP), "")


def grams(words: Column) -> Column:
    """Array of structs w0, w1, w2: the word at each place and its two successors (null past the end)."""
    n = F.greatest(F.size(words), F.lit(1))
    return F.arrays_zip(words.alias("w0"), F.slice(words, F.lit(2), n).alias("w1"), F.slice(words, F.lit(3), n).alias("w2"))


def template_grams(spark: SparkSession, base: tuple = BASE_PHRASES, templates: tuple = TEMPLATES) -> DataFrame:
    """The grams of all templates: template, label, is_base, n_grams, place and words."""
    rows = [
        F.struct(F.lit(k).alias("template"), F.lit(label).alias("label"), F.lit(k < len(base)).alias("is_base"), F.lit(text).alias("text"))
        for k, (label, text) in enumerate((*base, *templates))
    ]
    words = spark.range(1).select(F.inline(F.array(*rows))).withColumn("words", F.split("text", " "))
    return (
        words.select(
            "template", "label", "is_base", (F.size("words") - GRAM + 1).alias("n_grams"),
            F.posexplode(grams(F.col("words"))).alias("t_place", "t"),
        )
        .where("t.w2 is not null")
        .select("template", "label", "is_base", "n_grams", "t_place", "t", F.xxhash64("t.w0", "t.w1", "t.w2").alias("t_hash"))
    )


def requirements(base: tuple = BASE_PHRASES, templates: tuple = TEMPLATES) -> list[tuple[int, list[int], int]]:
    """(template, its places that a sibling's grams don't have, how many of them a span must hold), one for each sibling."""
    texts = [(label, text.split(" ")) for label, text in (*base, *templates)]
    sets = [[tuple(w[j : j + GRAM]) for j in range(len(w) - GRAM + 1)] for _, w in texts]
    found = []
    for k in range(len(base), len(texts)):
        for m in range(len(base), len(texts)):
            if texts[k][0] != texts[m][0]:
                own = [j for j, g in enumerate(sets[k]) if g not in set(sets[m])]
                if own and len(sets[k]) - len(own) >= SIBLING * len(sets[k]):
                    found.append((k, own, len(own) if len(own) <= FEW else math.ceil(KEY_SHARE * len(own))))
    return found


def required_places(spark: SparkSession) -> DataFrame:
    """(q_template, needs): for each template with siblings, the places and numbers of ``requirements``; a few dozen rows."""
    rows = [F.struct(F.lit(k).alias("q_template"), F.array(*map(F.lit, own)).alias("own"), F.lit(n).alias("need")) for k, own, n in requirements()]
    return spark.range(1).select(F.inline(F.array(*rows))).groupBy("q_template").agg(F.collect_list(F.struct("own", "need")).alias("needs"))


def diagonal_votes(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, text_key, template ..., diagonal, t_place): one row for each gram that a text shares with a template."""
    shared = (
        docs.select("doc_id", "text_key", F.posexplode(grams(license_words(F.col("text")))).alias("place", "g"))
        .where("g.w2 is not null")
        .withColumn("hash", F.xxhash64("g.w0", "g.w1", "g.w2"))
        .join(F.broadcast(templates), F.expr("hash = t_hash and g.w0 = t.w0 and g.w1 = t.w1 and g.w2 = t.w2"))
    )
    return shared.select(
        "doc_id", "text_key", "template", "label", "is_base", "n_grams", (F.col("place") - F.col("t_place")).alias("diagonal"), "t_place"
    ).distinct()


def runs(votes: DataFrame, key: list[str]) -> DataFrame:
    """Runs of votes on one diagonal: diagonal, first and last template place, start and end in the text, n (votes)."""
    along = Window.partitionBy(*key, "diagonal").orderBy("t_place")
    opens = F.coalesce(F.col("t_place") - F.lag("t_place").over(along) > MAX_HOLE, F.lit(True)).cast("int")
    placed = votes.withColumn("opens", opens).withColumn("run", F.sum("opens").over(along))
    first, last = F.min("t_place"), F.max("t_place")
    return placed.groupBy(*key, "diagonal", "run").agg(
        first.alias("first"), last.alias("last"), F.count("*").cast("int").alias("n"), F.collect_list("t_place").alias("places"),
        (F.col("diagonal") + first).alias("start"), (F.col("diagonal") + last + GRAM).alias("end"),
    )


def notices(votes: DataFrame, match: list[str]) -> DataFrame:
    """Verified spans of the templates: start, end, n (grams), cover, label."""
    key = [*match, "label", "n_grams"]
    longest = int(MAX_STRETCH * max(len(text.split(" ")) for _, text in TEMPLATES))
    ahead = Window.partitionBy(*match).orderBy("start").rangeBetween(0, longest)
    parts = F.collect_list(F.struct("first", "start", "last", "end", "n", "diagonal", "places")).over(ahead)
    merged = F.expr(
        f"""aggregate(
            filter(ahead, x -> x.end <= start + {MAX_STRETCH} * (n_grams + {GRAM - 1})),
            named_struct('last', last, 'end', end, 'n', n, 'diagonal', diagonal, 'places', places),
            (a, x) -> if(x.first > a.last and x.start > a.end - {GRAM} and abs(x.diagonal - a.diagonal) <= {MAX_SHIFT},
                named_struct('last', x.last, 'end', x.end, 'n', a.n + x.n, 'diagonal', x.diagonal, 'places', concat(a.places, x.places)), a))"""
    )
    words = F.col("end") - F.col("start") - (GRAM - 1)
    has_keys = F.coalesce(F.forall("needs", lambda r: F.size(F.array_intersect(F.col("places"), r["own"])) >= r["need"]), F.lit(True))
    return (
        runs(votes, key)
        .withColumn("ahead", F.array_sort(parts))
        .withColumn("m", merged)
        .select(*key, "start", F.col("m.end").alias("end"), F.col("m.n").alias("n"), F.col("m.places").alias("places"))
        .withColumn("cover", F.col("n") / F.col("n_grams"))
        .where((F.col("cover") >= MIN_COVER) | ((F.col("n") >= MIN_RUN) & (F.col("n") >= MIN_COVER * words)))
        .join(F.broadcast(required_places(votes.sparkSession)), F.col("template") == F.col("q_template"), "left")
        .where(has_keys)
        .drop("q_template", "needs", "places")
    )


def kept_spans(spans: DataFrame, document: list[str]) -> DataFrame:
    """Of spans that overlap, directly or by others, those kept in order of grams. One row for each island of them."""
    along = Window.partitionBy(*document).orderBy("start", "end", "template")
    before = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("opens", F.coalesce(F.col("start") >= before, F.lit(True)).cast("int")).withColumn("island", F.sum("opens").over(along))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("rank"), "start", "template", "end", "label", "cover")))
    walk = F.expr(
        """aggregate(ranked, slice(ranked, 1, 1), (kept, x) -> if(exists(kept, k -> k.start < x.end and x.start < k.end), kept, array_append(kept, x)))"""
    )
    return islands.groupBy(*document, "island").agg(ranked.alias("ranked")).select(*document, F.inline(walk)).select(*document, "start", "end", "label", "cover")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    scratch = Scratch(docs.sparkSession, "license_scan")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    votes = scratch.save(diagonal_votes(slim.where(F.col("text").isNotNull()), template_grams(docs.sparkSession)), "votes")
    document = ["doc_id", "text_key"]
    match = [*document, "template"]
    based = (
        votes.where("is_base").groupBy(*match, "label", "n_grams", "diagonal").agg(F.count("*").alias("n"))
        .where("n = n_grams")
        .select(*document, "label", F.col("diagonal").cast("long").alias("place"), F.lit(1.0).alias("cover"))
    )
    kept = kept_spans(notices(votes.where("not is_base"), match), document)
    found = based.unionByName(kept, allowMissingColumns=True)
    base = F.col("place").isNotNull()
    found = found.groupBy(F.col("doc_id").alias("f_id"), F.col("text_key").alias("f_key")).agg(
        F.count("place").alias("n_base"), F.min("place").alias("first_word"), F.max("place").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"),
        F.sort_array(F.collect_list(F.when(~base, F.struct("start", "end", "label", "cover")))).alias("spans"),
    )
    n_words = F.coalesce(F.regexp_count("text", F.lit(_WORD_ANY_CASE)), F.lit(0)).cast("long")
    same = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_key") == F.col("f_key"))
    return (
        slim.select("doc_id", "text_key", n_words.alias("n_words"))
        .join(found, same, "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
            F.coalesce("base_labels", F.lit("")).alias("base_labels"),
            F.coalesce("labels", F.lit("")).alias("labels"),
            F.coalesce("score", F.lit(0.0)).alias("score"),
            "spans",
        )
    )
