"""Sloppy phrase search, phrase statistics and severity cohorts.

A phrase of n terms occurs within slop s iff every term can be given its own position p so that the offsets
d = p - (index of the term in the phrase) differ by at most s. All positions of a document come from one row, so
the search is a map over documents: no shuffle, no pairs, and a frequent token costs only the rows it stands in.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import phrase_tokens, seeded_order, tokens_of
from .ranking import ranked, top_k


def tokenise(docs: DataFrame, id_col: str, text_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per token: (id, keep.., p, tok), p counting from 0."""
    return docs.select(id_col, *keep, F.posexplode(tokens_of(F.col(text_col))).alias("p", "tok"))


_SOUGHT = "array<struct<phrase:string,n:int,toks:array<string>,terms:array<struct<tok:string,q:int,again:boolean>>>>"


def _phrase_literals(phrases: Sequence[str]) -> Column:
    """The phrases as one literal array, parsed from one text; terms sorted so that repeats of a token follow each other."""
    rows = []
    for phrase in dict.fromkeys(phrases):
        toks = phrase_tokens(phrase)
        if not toks:
            raise ValueError(f"phrase without a token: {phrase!r}")
        terms = sorted((tok, q) for q, tok in enumerate(toks))
        repeats = [i > 0 and terms[i - 1][0] == tok for i, (tok, _) in enumerate(terms)]
        rows.append(
            {
                "phrase": phrase,
                "n": len(toks),
                "toks": list(dict.fromkeys(toks)),
                "terms": [{"tok": tok, "q": q, "again": again} for (tok, q), again in zip(terms, repeats)],
            }
        )
    return F.from_json(F.lit(json.dumps(rows)), _SOUGHT)


def _tightness(terms: Column, start: Column, entries: Column) -> Column:
    """Smallest width at which the window [start, start + width] holds the whole phrase; NULL if it never does.

    Each term takes its earliest free entry. Repeats of a token are visited in phrase order and take rising
    positions, which is the best assignment because their offset limits rise in the same order.
    """

    def place(state: Column, term: Column) -> Column:
        lowest = F.when(term.again, state.p + 1).otherwise(F.lit(0))
        free = F.filter(entries, lambda e: (e.q == term.q) & (e.p >= lowest))
        earliest = F.array_min(F.transform(free, lambda e: e.p))

        def widen(p: Column) -> Column:
            # A missing term gives a NULL width, which stays NULL to the end (greatest() alone would skip it).
            width = F.when(p.isNotNull() & state.width.isNotNull(), F.greatest(state.width, p - term.q - start))
            return F.struct(width.alias("width"), p.alias("p"))

        return F.get(F.transform(F.array(earliest), widen), F.lit(0))

    first = F.struct(F.lit(0).alias("width"), F.lit(-1).alias("p"))
    return F.aggregate(terms, first, place, lambda state: state.width)


def _times(array: str, value: int) -> Column:
    return F.size(F.filter(array, lambda element: element == value)).cast("double")


def phrase_search(
    docs: DataFrame, id_col: str, text_col: str, phrases: Sequence[str], slop: int = 4
) -> DataFrame:
    """Documents holding each phrase: (phrase, doc_id, windows, spread, score).

    ``id_col`` must be unique. ``windows`` counts the distinct window starts at which the phrase fits, ``spread``
    is the tightest of them (0 = the exact phrase) and ``score`` is the sum of 1 / (1 + spread) over them, added
    from spread 0 upwards so that it is the same number in every run.
    """
    vocabulary = sorted({tok for phrase in phrases for tok in phrase_tokens(phrase)})
    places = F.filter(
        F.transform(tokens_of(F.col(text_col)), lambda tok, p: F.struct(p.alias("p"), tok.alias("tok"))),
        lambda place: F.array_contains(F.from_json(F.lit(json.dumps(vocabulary)), "array<string>"), place.tok),
    )
    # Only the few distinct query tokens of a document are visited below; the text is gone from here on.
    present = docs.select(F.col(id_col).alias("doc_id"), places.alias("places")).select(
        "doc_id", "places", F.array_distinct("places.tok").alias("present")
    )
    # Each token's positions are gathered once per document, before the phrases multiply its rows.
    gathered = present.select(
        "doc_id",
        "present",
        F.map_from_arrays(
            "present",
            F.transform(
                "present",
                lambda tok: F.transform(F.filter("places", lambda place: place.tok == tok), lambda place: place.p),
            ),
        ).alias("positions"),
    )
    # explode_outer plus a test afterwards: explode would repeat this whole expression as a filter below.
    candidates = gathered.select(
        "doc_id",
        "positions",
        F.explode_outer(
            F.filter(
                _phrase_literals(phrases),
                lambda phrase: F.forall(phrase.toks, lambda tok: F.array_contains("present", tok)),
            )
        ).alias("sought"),
    ).filter(F.col("sought").isNotNull())
    return fitting_windows(candidates, slop)


def fitting_windows(candidates: DataFrame, slop: int) -> DataFrame:
    """The result of ``phrase_search`` from (doc_id, positions, sought) rows.

    ``positions`` maps at least the tokens of the phrase to their places in the document, ``sought`` is the phrase as
    ``_phrase_literals`` gives it, and the document holds all its tokens.
    """
    entries = F.array_sort(
        F.flatten(
            F.transform(
                "sought.terms",
                lambda term: F.transform(
                    F.element_at("positions", term.tok),
                    lambda p: F.struct((p - term.q).alias("d"), term.q.alias("q"), p.alias("p")),
                ),
            )
        )
    )
    n = F.col("sought.n")
    # A window can only fit where n entries stand within the slop: one comparison per entry discards nearly all.
    dense_starts = F.filter(
        F.sequence(F.lit(0), F.size("entries") - n),
        lambda i: (F.get("entries", i + n - 1).d - F.get("entries", i).d <= slop)
        & F.coalesce(F.get("entries", i - 1).d != F.get("entries", i).d, F.lit(True)),
    )
    # A term has at most one entry per offset, so a window holds at most n * (slop + 1) entries.
    windows = F.transform(
        dense_starts,
        lambda i: F.struct(
            F.get("entries", i).d.alias("start"),
            F.filter(
                F.slice("entries", i + 1, n * (slop + 1)),
                lambda e: e.d <= F.get("entries", i).d + slop,
            ).alias("entries"),
        ),
    )
    widths = F.filter(
        F.transform("windows", lambda w: _tightness(F.col("sought.terms"), w.start, w.entries)),
        lambda width: width.isNotNull(),
    )
    matched = (
        candidates.select("doc_id", "sought", entries.alias("entries"))
        .select("doc_id", "sought", windows.alias("windows"))
        .select("doc_id", F.col("sought.phrase").alias("phrase"), widths.alias("widths"))
        # The same barrier as above: keep the row only if a window fitted, without computing the widths twice.
        .select("doc_id", "phrase", F.explode_outer(F.array("widths")).alias("widths"))
        .filter(F.size("widths") > 0)
    )
    score = F.lit(0.0)
    for width in range(slop + 1):
        score = score + _times("widths", width) / F.lit(float(1 + width))
    return matched.select(
        "phrase",
        "doc_id",
        F.size("widths").cast("bigint").alias("windows"),
        F.array_min("widths").alias("spread"),
        score.alias("score"),
    )


# --- the catalogue and what is derived from the hits ------------------------------------------------------------


def catalogue_rows(texts: Mapping[tuple[str, str], str]) -> list[tuple[str, str, str]]:
    """(category, level, phrase) from blocks of lines; repeated lines collapse, the first keeps its place."""
    rows = [
        (category, level, line.strip())
        for (category, level), block in texts.items()
        for line in block.splitlines()
        if line.strip()
    ]
    return list(dict.fromkeys(rows))


def catalogue_frame(spark: SparkSession, rows: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(position, category, level, phrase) as a frame of literals."""
    literal = json.dumps([dict(zip(("position", "category", "level", "phrase"), (i, *row))) for i, row in enumerate(rows)])
    schema = "array<struct<position:int,category:string,level:string,phrase:string>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(literal), schema)))


def _by_relevance() -> list[Column]:
    return [F.col("score").desc(), F.col("doc_id").asc()]


def top_hits(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each phrase with their ``rank``: by score, ties by document."""
    return top_k(hits, ["phrase"], _by_relevance(), k, spread_by="doc_id")


def hit_summary(hits: DataFrame, seed: int) -> DataFrame:
    """(phrase, n_docs, first_doc, random_doc, last_doc) by rank, for phrases with a hit.

    Every value is a count, a minimum or a maximum, so hits are combined before they are shuffled and a phrase found
    in most documents is no burden.
    """
    place = F.struct((-F.col("score")).alias("_by"), F.col("doc_id"))
    draw = F.struct(seeded_order(F.col("doc_id"), seed).alias("_by"), F.col("doc_id"))
    return (
        hits.groupBy("phrase")
        .agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.min(place).alias("_first"),
            F.min(draw).alias("_random"),
            F.max(place).alias("_last"),
        )
        .select(
            "phrase",
            "n_docs",
            F.col("_first.doc_id").alias("first_doc"),
            F.col("_random.doc_id").alias("random_doc"),
            F.col("_last.doc_id").alias("last_doc"),
        )
    )


def phrase_stats(hits: DataFrame, catalogue: DataFrame, seed: int) -> DataFrame:
    """Count, first, random and last document per catalogue row; 0 where a phrase has no hit."""
    numbers = ["n_docs", "first_doc", "random_doc", "last_doc"]
    # Both sides have at most one row per catalogue phrase.
    joined = catalogue.join(hit_summary(hits, seed), "phrase", "left")
    return joined.select(*catalogue.columns, *[F.coalesce(F.col(name), F.lit(0)).alias(name) for name in numbers])


def ranked_hits(hits: DataFrame, bounds: Sequence[int] | None = None) -> DataFrame:
    """(phrase, score, doc_id, rank, n_docs) of all hits: the place in the phrase by score, ties by document.

    The hits are read twice: write them before if they are dear. A phrase that most documents hold is ranked by many
    tasks. ``bounds`` cut the
    ids of the documents into ranges (see ``value_bounds``); without them they come from a pass over the hits.
    """
    return ranked(hits.select("phrase", "score", "doc_id"), ["phrase"], "score", "doc_id", total="n_docs", bounds=bounds)


def peek_hits(hits: DataFrame, rank: int, parts: int = 64) -> DataFrame:
    """(phrase, rank, doc_id) of the hit at one rank and of the last hit of each phrase, in one pass.

    Each of ``parts`` slices of a phrase keeps its first ``rank`` hits, its last one and its size; the rest follows from
    what is kept.
    """
    backwards = [F.col("score").asc(), F.col("doc_id").desc()]
    piece = W.partitionBy("phrase", "_slice")
    sliced = hits.select("phrase", "score", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("_slice"))
    kept = sliced.select(
        "*",
        F.row_number().over(piece.orderBy(*_by_relevance())).alias("_n"),
        F.row_number().over(piece.orderBy(*backwards)).alias("_back"),
        F.count(F.lit(1)).over(piece).alias("_size"),
    ).filter((F.col("_n") <= rank) | (F.col("_back") == 1))
    whole = W.partitionBy("phrase")
    placed = kept.select(
        "phrase",
        "doc_id",
        F.row_number().over(whole.orderBy(*_by_relevance())).alias("_place"),
        F.row_number().over(whole.orderBy(*backwards)).alias("_back"),
        F.sum(F.when(F.col("_back") == 1, F.col("_size"))).over(whole).alias("_total"),
    )
    last = F.when(F.col("_back") == 1, F.col("_total"))
    at_rank = F.when(F.col("_place") == rank, F.lit(rank))
    return (
        placed.select("phrase", F.coalesce(last, at_rank).cast("int").alias("rank"), "doc_id")
        .filter(F.col("rank").isNotNull())
    )


def severity_ids(hits: DataFrame, catalogue: DataFrame, cohorts: Mapping[str, Sequence[str]]) -> DataFrame:
    """(cohort, doc_id): documents with a hit at any level of the cohort, all cohorts in one pass."""
    chosen = F.filter(
        F.array(
            *[
                F.struct(F.lit(name).alias("cohort"), F.array(*[F.lit(level) for level in levels]).alias("levels"))
                for name, levels in cohorts.items()
            ]
        ),
        lambda cohort: F.array_contains(cohort.levels, F.col("level")),
    )
    member = catalogue.select("phrase", F.explode(chosen).alias("_c")).select("phrase", "_c.cohort").distinct()
    # A frame of literals: at most one row per catalogue phrase and cohort.
    return hits.select("phrase", "doc_id").join(F.broadcast(member), "phrase").select("cohort", "doc_id").distinct()


def severity_cohorts(
    hits: DataFrame,
    catalogue: DataFrame,
    docs: DataFrame,
    id_col: str,
    cohorts: Mapping[str, Sequence[str]],
    columns: Sequence[str],
) -> DataFrame:
    """(cohort, columns..) of the documents in each severity cohort."""
    ids = severity_ids(hits, catalogue, cohorts).withColumnRenamed("doc_id", id_col)
    return docs.select(*columns).join(ids, id_col, "inner").select("cohort", *columns)


def phrase_json(
    hits: DataFrame, catalogue: DataFrame, part_size: int = 10_000, bounds: Sequence[int] | None = None
) -> DataFrame:
    """(category, level, phrase, part, ids): all documents of each catalogue phrase, in the order of their rank, as JSON.

    A list holds at most ``part_size`` documents, so no row grows with the corpus; a phrase with more has more parts,
    counted from 0. A phrase without a hit has one empty list.
    """
    part = F.floor((F.col("rank") - 1) / part_size).cast("int")
    lists = (
        ranked_hits(hits, bounds)
        .groupBy("phrase", part.alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))).alias("_ranked"))
        .select("phrase", "part", F.col("_ranked.doc_id").alias("ids"))
    )
    rows = catalogue.join(lists, "phrase", "left")
    ids = F.coalesce("ids", F.array().cast("array<bigint>"))
    return rows.select(
        "category", "level", "phrase", F.coalesce("part", F.lit(0)).alias("part"), F.to_json(ids).alias("ids")
    )


def report_lines(stats: DataFrame, catalogue: DataFrame, titles: Mapping[str, str]) -> DataFrame:
    """(ord, line): the statistics as a text report with a heading per category and level."""
    title = F.element_at(F.create_map(*[F.lit(x) for pair in titles.items() for x in pair]), F.col("category"))
    levels = catalogue.groupBy("category", "level").agg(F.min("position").alias("position"))
    sections = catalogue.groupBy("category").agg(F.min("position").alias("position"), F.max("position").alias("last"))

    def lines(df: DataFrame, rank: int, *texts: Column) -> DataFrame:
        return df.select(F.col("position"), F.lit(rank).alias("part"), F.posexplode(F.array(*texts)).alias("n", "line"))

    blank, stars = F.lit(""), F.lit("*" * 25)
    parts = [
        lines(sections, 0, F.coalesce(title, F.col("category")), blank),
        lines(levels, 1, stars, F.upper("level"), stars, blank),
        lines(
            stats,
            2,
            F.col("phrase"),
            F.concat(F.lit("Number of Documents "), F.col("n_docs").cast("string")),
            F.concat(F.lit("First "), F.col("first_doc").cast("string")),
            F.concat(F.lit("Random "), F.col("random_doc").cast("string")),
            F.concat(F.lit("Last "), F.col("last_doc").cast("string")),
            blank,
        ),
        lines(sections.select(F.col("last").alias("position")), 3, blank, F.lit("*" * 100)),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return every.select((F.col("position") * 100 + F.col("part") * 10 + F.col("n")).alias("ord"), "line")
