"""Crawled media: rights, ranking, candidates, review verdicts, dedupe and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxtable import rules
from voxtable.functions import urls
from voxtable.functions.text import contains_any, let, one_of, squish
from voxtable.operators.ordered import first_per, top_per


def license_status(text: Column, reject=rules.REJECT_MARKERS, reusable=rules.REUSABLE_MARKERS) -> Column:
    """'copyrighted', 'reusable' or null; reject markers win."""
    blob = squish(F.translate(F.lower(F.coalesce(text, F.lit(""))), "_", " "))
    return let(
        blob,
        lambda b: F.when(contains_any(b, reject), F.lit("copyrighted")).when(contains_any(b, reusable), F.lit("reusable")),
    )


def license_label(text: Column) -> Column:
    return F.substring(F.trim(F.coalesce(text, F.lit(""))), 1, 120)


def with_rights(media: DataFrame, blocked=rules.BLOCKED_HOSTS, reusable=rules.REUSABLE_HOSTS) -> DataFrame:
    """Add status, label, reason and source_domain by six ordered rules; the host lists ride along as literals."""
    facts = media.withColumns(
        {
            "_mh": urls.host(F.col("url")),
            "_ph": urls.host(F.col("page_url")),
            "_ls": license_status(F.col("license_hint")),
            "_ll": license_label(F.col("license_hint")),
        }
    ).withColumns(
        {
            "_mb": urls.host_in(F.col("_mh"), blocked),
            "_pb": urls.host_in(F.col("_ph"), blocked),
            "_ok": urls.host_in(F.col("_mh"), reusable) | urls.host_in(F.col("_ph"), reusable),
        }
    )
    branches = [
        (
            one_of(F.col("kind"), ["embed", "stream"]) & F.col("_mb"),
            "copyrighted",
            "embedded/streamed third-party media",
            "Blocked host for streams/embeds. A media URL is not a reuse license.",
        ),
        (
            F.col("_mb") | F.col("_pb"),
            "copyrighted",
            "news/stock/social host",
            "Host is treated as copyrighted news, social, or stock media.",
        ),
        (F.col("_ls").eqNullSafe("copyrighted"), "copyrighted", "", "Page license text is not reusable."),
        (F.col("_ok"), "reusable", "allowlisted reusable-media host", "Source is on the reusable-media allowlist."),
        (
            F.col("_ls").eqNullSafe("reusable"),
            "reusable",
            "",
            "Page advertised a Creative Commons / public-domain license.",
        ),
        (
            F.lit(True),
            "unknown",
            "no license found",
            "No reusable license detected. Unknown media is not downloaded.",
        ),
    ]
    status = label = reason = None
    for cond, st, lb, why in branches:
        a, b, c = F.lit(st), F.lit(lb), F.lit(why)
        status = F.when(cond, a) if status is None else status.when(cond, a)
        label = F.when(cond, b) if label is None else label.when(cond, b)
        reason = F.when(cond, c) if reason is None else reason.when(cond, c)
    return facts.select(
        *media.columns,
        status.alias("status"),
        F.when(F.col("_ll") != "", F.col("_ll")).otherwise(label).alias("label"),
        reason.alias("reason"),
        F.when(F.col("_mh") != "", F.col("_mh")).otherwise(F.col("_ph")).alias("source_domain"),
    )


def media_rank(query: Column) -> Column:
    """Rank of a media row with a rights status; query words longer than two letters add three each."""
    blob = F.lower(F.concat_ws(" ", "title", "url", "page_url"))
    hits = F.size(
        F.filter(F.split(squish(F.lower(query)), " "), lambda t: (F.length(t) > 2) & blob.contains(t))
    )
    by_kind = F.when(F.col("kind") == "video", 25).when(F.col("kind") == "image", 12).when(F.col("kind") == "download", 18).otherwise(0)
    by_via = F.when(one_of(F.col("via"), ["api", "download_link"]), 8).otherwise(0)
    return F.when(F.col("status") != "reusable", F.lit(0.0)).otherwise((40 + by_kind + by_via + 3 * hits).cast("double"))


def candidates(media: DataFrame, query: Column) -> DataFrame:
    """Media rows with rights, rank, title default and first action."""
    return with_rights(media).withColumns(
        {
            "rank": media_rank(query),
            "action": F.when(F.col("status") == "copyrighted", F.lit("blocked")).otherwise(F.lit("skipped")),
            "shown_title": F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("page_url")),
        }
    )


def select_downloads(cands: DataFrame, limit: int, *keys: str) -> DataFrame:
    """Reusable only, distinct url, videos first, then rank, then arrival; at most `limit` per key."""
    order = [F.col("kind") != "video", F.col("rank").desc(), F.col("ordinal")]
    usable = cands.filter(F.col("status") == "reusable")
    distinct = first_per(usable, [*keys, "url"], *order)
    return top_per(distinct, list(keys), limit, *order)


def review(cands: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Probe failure, then model verdict, then rule verdict decide each downloaded candidate.

    `cands` carries probe_ok, rule_keep, rule_score and is_downloaded; `verdicts` carries keep and score.
    """
    j = cands.join(first_per(verdicts, keys, "verdict_no").drop("verdict_no"), keys, "left")
    model_score = F.greatest(
        F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nullif(F.col("score"), F.lit(0.0)), F.when(F.col("keep"), F.lit(0.8)).otherwise(F.lit(0.2))))
    )
    keep = F.when(~F.col("probe_ok"), F.lit(False)).otherwise(F.coalesce(F.col("keep"), F.col("rule_keep")))
    score = (
        F.when(~F.col("probe_ok"), F.lit(0.0))
        .when(F.col("keep").isNotNull(), model_score)
        .otherwise(F.col("rule_score"))
    )
    source = (
        F.when(~F.col("probe_ok"), F.lit("probe")).when(F.col("keep").isNotNull(), F.lit("model")).otherwise(F.lit("rule"))
    )
    return j.select(
        *[c for c in cands.columns if c != "action"],
        keep.alias("verdict_keep"),
        score.alias("verdict_score"),
        source.alias("verdict_from"),
        F.when(~F.col("is_downloaded"), F.col("action"))
        .when(keep, F.lit("accepted"))
        .otherwise(F.lit("rejected"))
        .alias("action"),
    )


def hits_from_rows(rows: DataFrame, limit: int) -> DataFrame:
    """Search result rows to hits: unwrapped urls, search hosts dropped, texts clipped, `limit` per engine and query."""
    clean = rows.withColumn("url", urls.normalize(F.col("href"))).withColumn("host", urls.host(F.col("url")))
    clean = clean.filter((F.col("url") != "") & ~urls.host_in(F.col("host"), rules.SEARCH_HOSTS))
    title = F.trim(F.coalesce(F.col("title"), F.lit("")))
    shaped = clean.withColumns(
        {
            "title": F.substring(F.when(title == "", F.col("host")).otherwise(title), 1, 200),
            "snippet": F.substring(F.trim(F.coalesce(F.col("snippet"), F.lit(""))), 1, 280),
        }
    )
    return top_per(shaped, ["engine", "query"], limit, "ordinal")


def api_dump_media(dump: DataFrame, limit: int, max_bytes: int = 80_000_000) -> DataFrame:
    """Rows of a media API dump: no audio, size bounds, no copyrighted licences, `limit` per query."""
    mime = F.lower(F.coalesce(F.col("mime"), F.lit("")))
    size = F.coalesce(F.col("size"), F.lit(0))
    audio = mime.startswith("audio/") | one_of(mime, ["application/ogg", "application/x-ogg"])
    kept = dump.filter(
        (F.coalesce(F.col("url"), F.lit("")) != "")
        & ~audio
        & ((size == 0) | size.between(4000, max_bytes))
        & ~license_status(F.coalesce(F.nullif(F.col("license_hint"), F.lit("")), F.lit("wikimedia"))).eqNullSafe("copyrighted")
    ).withColumn(
        "kind", F.when(mime.startswith("video/") | (mime == "application/x-ogm"), F.lit("video")).otherwise(F.lit("image"))
    )
    return top_per(kept, ["query"], limit, "ordinal")


def pages_to_visit(hits: DataFrame, keys: list[str], pool: int = 12, final: int = 5) -> DataFrame:
    """First hit per raw authority in arrival order, then the first `pool`, then `final`."""
    per_host = first_per(hits.withColumn("netloc", F.split("url", "/").getItem(2)), [*keys, "netloc"], "ordinal")
    pooled = top_per(per_host, keys, pool, "ordinal", rank="pool_no")
    return top_per(pooled, keys, final, "ordinal", rank="visit_no")


def engine_gaps(queries: DataFrame, hits: DataFrame, per_query: int) -> DataFrame:
    """Queries that the API engines served fewer than min(2, per_query) hits for."""
    served = hits.groupBy("query").agg(F.count("*").alias("n")).filter(F.col("n") >= min(2, per_query))
    return queries.join(served, "query", "left_anti")


def unseen_engines(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """Engines (column engine) that were asked for and gave no hit at all; each is worth a warning."""
    return asked.join(hits.select("engine").distinct(), "engine", "left_anti")


def union_hits(hits: DataFrame, media: DataFrame) -> DataFrame:
    """Hits of all engines and the media that came with some of them, under one seen-set of addresses.

    `hits` (ordinal, url, ...) and `media` (ordinal of its hit, media_url): in order of
    ordinal, a hit in front of its media, the first row with an address stays. A hit
    whose media was seen before goes with it. Returns ordinal, part ('hit' or 'media'), url.
    """
    events = hits.select("ordinal", F.lit("hit").alias("part"), "url").unionByName(media.select("ordinal", F.lit("media").alias("part"), F.col("media_url").alias("url")))
    first = first_per(events, ["url"], "ordinal", "part")
    gone = media.select("ordinal").join(first.filter("part = 'media'"), "ordinal", "left_anti")
    return first.join(gone, "ordinal", "left_anti").select("ordinal", "part", "url")


#: Needles with a space that a candidate is held against at one time.
PIECE_NEEDLES = 256


def _words_holding(words: DataFrame, needles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _word, _in): the needles inside each of the words, met by the word's parts as long as some needle of the job."""
    sizes = needles.groupBy(*keys).agg(F.collect_set(F.length("_needle")).alias("_sizes"))
    word = F.col("_word")
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substr(word, i, n))
    parts = F.flatten(F.transform(F.filter("_sizes", lambda n: n <= F.length(word)), cut))
    parted = words.join(sizes, keys).select(*keys, "_word", F.explode(F.array_distinct(parts)).alias("_needle"))
    return parted.join(needles, [*keys, "_needle"]).groupBy(*keys, "_word").agg(F.collect_list("_needle").alias("_in"))


def _phrases_inside(rows: DataFrame, needles: DataFrame, keys: list[str], cand_id: str, piece: int) -> DataFrame:
    """(keys, cand_id, _hits) of needles with a space, dealt into sets of about `piece` by their hash."""
    parts = needles.groupBy(*keys).agg(F.ceil(F.count("*") / piece).alias("_parts"))
    sets = needles.join(parts, keys).groupBy(*keys, F.pmod(F.xxhash64("_needle"), F.col("_parts")).alias("_part")).agg(F.collect_list("_needle").alias("_needles"))
    inside = F.size(F.filter("_needles", lambda n: F.col("_blob").contains(n)))
    return rows.join(sets.drop("_part"), keys).select(*keys, cand_id, inside.alias("_hits"))


def relevance(cands: DataFrame, needles: DataFrame, keys: list[str], cand_id: str = "ordinal", piece: int = PIECE_NEEDLES) -> DataFrame:
    """Distinct needles of a job found anywhere in each candidate's text: score and keep flag.

    A needle without a space lies inside one word of the text. Each different word of
    a job is cut into its parts of the needles' lengths, which meet the needles in a
    join; candidates then meet their words. So no candidate is held against all needles
    of its job, and the work grows with the texts. Needles with a space are searched
    for set by set, in sets of about `piece`.
    """
    text = F.lower(F.concat_ws(" ", "title", "url", "file_name", "label"))
    wanted = needles.select(*keys, F.lower("needle").alias("_needle")).filter(F.length("_needle") > 2).distinct()
    spaced = F.col("_needle").contains(" ")
    rows = cands.select(*keys, cand_id, text.alias("_blob"))
    said = rows.groupBy(*keys, cand_id, F.unhex(F.md5("_blob")).alias("_text")).agg(F.first("_blob").alias("_blob"), F.count("*").alias("_rows"))
    said = said.select(*keys, cand_id, "_text", "_rows", F.explode(F.array_distinct(F.split("_blob", " "))).alias("_word")).filter(F.length("_word") > 2)
    holding = _words_holding(said.select(*keys, "_word").distinct(), wanted.filter(~spaced), keys)
    inside = F.size(F.array_distinct(F.flatten(F.collect_list("_in"))))
    met = said.join(holding, [*keys, "_word"]).groupBy(*keys, cand_id, "_text", "_rows").agg(inside.alias("_in"))
    hits = met.select(*keys, cand_id, (F.col("_in") * F.col("_rows")).alias("_hits"))
    hits = hits.unionByName(_phrases_inside(rows, wanted.filter(spaced), keys, cand_id, piece))
    found = hits.groupBy(*keys, cand_id).agg(F.sum("_hits").alias("_hits"))
    scored = cands.join(found, [*keys, cand_id], "left").withColumn("hits", F.coalesce("_hits", F.lit(0))).drop("_hits")
    return scored.withColumns(
        {
            "rule_score": F.when(F.col("probe_ok"), F.least(F.lit(1.0), (2 + 2 * F.col("hits")) / 10)).otherwise(0.0),
            "rule_keep": (F.col("status") == "reusable") & F.col("probe_ok") & (F.col("hits") >= 2),
        }
    )


# Words that carry no search intent.
QUERY_STOPWORDS = [
    "the", "and", "for", "that", "this", "with", "from", "have", "has",
    "was", "were", "are", "but", "not", "you", "your", "our", "their",
    "just", "about", "into", "over", "after", "before", "today", "aaj",
    "hai", "hain", "ka", "ki", "ke", "ne", "se", "mein", "me", "ko",
]


def fallback_queries(text: Column, year: int, max_queries: int) -> Column:
    """Query texts built from the first distinct content words of a transcript."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9.+-]{2,}"), F.lit(0))
    useful = F.filter(found, lambda w: ~one_of(F.lower(w), QUERY_STOPWORDS))

    def first_spelling(ws):
        # array_distinct keeps first occurrences; map each distinct key back to its first spelling
        return let(
            F.transform(ws, lambda w: F.lower(w)),
            lambda keys: F.transform(
                F.slice(F.array_distinct(keys), 1, 6), lambda k: F.get(ws, (F.array_position(keys, k) - 1).cast("int"))
            ),
        )

    core = F.array_join(let(useful, first_spelling), " ")
    core = F.when(core == "", F.substring(F.trim(text), 1, 80)).otherwise(core)
    tails = [str(year), "news", "Wikimedia Commons", "official"][: max(2, max_queries)]
    return let(core, lambda c: F.array(*[F.concat(c, F.lit(" " + t)) for t in tails]))
