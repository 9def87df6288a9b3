"""Benchmark decontamination over a distributed positional inverted index (DataFrame functions only).

1. token_index() stores a posting (term, doc, position) for every word of every training text, as segments: each task of the scan sorts its own
   postings by term and writes them, so nothing is shuffled and a lost task is written again. term and doc are 64-bit hashes, so a
   posting has a fixed width. An index serves any number of benchmarks.
2. Each window of WINDOW consecutive words of an item picks its RAREST rarest positions, by the index's counts, as anchors. A window with a term
   that no training text has is left out.
3. A posting at position p of the item's position j lies on the diagonal p - j, so intersecting the offset-adjusted lists of a window's
   anchors is grouping postings by (document, item, diagonal) and asking for all of them.
4. Only for what is left, the words of the document along the diagonal are compared with the item's
   words: exact phrase matches. near_matches() returns documents in which all of a window's anchors come
   within a given distance instead, in any order: proximity matches.

Equal hashes of different terms or documents only add candidates, which step 4 drops. What is shuffled are postings
of the rarest terms, whose number follows the benchmark's share of the corpus. Tables of fixed-width rows are
broadcast below a checked number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialise, maybe_broadcast, remove, shared_dir

WINDOW, RAREST = 10, 2
#: Rows of a few numbers each, up to which such a table is broadcast (some 50 MB).
BROADCAST_NUMBERS = 1_000_000
#: Candidate documents, and words of their items, up to which the candidates are broadcast.
BROADCAST_DOCS, BROADCAST_WORDS = 50_000, 4_000_000
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def tokens(text: Column) -> Column:
    """Words of a text: lower-cased A-Z, runs of ASCII letters and digits and of all other than ASCII; null has none."""
    words = F.split(lower_ascii(text), _GAP, -1)
    return F.coalesce(F.array_remove(words, ""), F.array().cast("array<string>"))


def _items(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item_key, item_id, words, width): distinct items that have words."""
    out = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item_id"), tokens(F.col(f"`{text_col}`").cast("string")).alias("words"))
    out = out.where("size(words) > 0").distinct()
    return out.select(F.xxhash64("item_id", "words").alias("item_key"), "item_id", "words", F.least(F.size("words"), F.lit(window)).alias("width"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, doc_id, key, text); rows with the same id and text have the same key."""
    text = F.col(f"`{text_col}`").cast("string")
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    return docs.select(doc, F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("key"), text.alias("text"))


def token_index(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the postings (term, doc, position) of all words of docs to the folder path, and returns them as read from there.

    Null and empty texts have none; repeated rows have theirs as often as they come. Give the table, and the same id_col and text_col, to
    phrase_matches() and near_matches() with any rows of docs.
    """
    every = _rows(docs, id_col, text_col).select("key", F.posexplode(tokens(F.col("text"))).alias("position", "word"))
    postings = every.select(F.xxhash64("word").alias("term"), F.col("key").alias("doc"), "position").sortWithinPartitions("term")
    postings.write.parquet(path)
    return docs.sparkSession.read.schema("term long, doc long, position int").parquet(path)


def _anchors(index: DataFrame, items: DataFrame, rarest: int, within: str) -> DataFrame:
    """(item_key, item_id, words, width, windows): windows of (start, anchors), whose terms all come in the texts."""
    places = materialise(items.select("item_key", F.posexplode("words").alias("place", "word")).select("item_key", "place", F.xxhash64("word").alias("term")), "places", within)
    terms = materialise(places.select("term").distinct(), "terms", within)
    known = index.join(maybe_broadcast(terms, BROADCAST_NUMBERS), "term").groupBy("term").agg(F.count(F.lit(1)).alias("times"))
    known = materialise(known, "counts", within)
    places = places.join(maybe_broadcast(known, BROADCAST_NUMBERS), "term", "left")
    # an item's places, rarest first, then for each window the first ones that it covers
    ranked = places.groupBy("item_key").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "place"))).alias("ranked"))
    out = items.join(ranked, "item_key")
    out = out.withColumn("windows", F.expr("transform(sequence(0, size(words) - width), s -> struct(s AS start, filter(ranked, x -> x.place >= s AND x.place < s + width) AS inside))"))
    return out.withColumn("windows", F.expr(f"transform(filter(windows, w -> w.inside[0].times > 0), w -> struct(w.start AS start, transform(slice(w.inside, 1, {rarest}), x -> x.place) AS anchors))")).drop("ranked")


def _hits(rows: DataFrame, items: DataFrame, index: DataFrame, rarest: int, within: str) -> tuple[DataFrame, DataFrame]:
    """Postings of anchors (doc, item_key, position, place), and the items with their windows."""
    items = materialise(_anchors(index, items, rarest, within), "windows", within)
    used = items.select("item_key", "words", F.explode(F.array_distinct(F.flatten(F.expr("transform(windows, w -> w.anchors)")))).alias("place"))
    used = materialise(used.select(F.expr("xxhash64(words[place])").alias("term"), "item_key", "place"), "anchors", within)
    return index.join(maybe_broadcast(used, BROADCAST_NUMBERS), "term").select("doc", "item_key", "position", "place"), items


def _small(found: DataFrame) -> DataFrame:
    """The candidates with a broadcast hint if they are known to be small; else the texts are shuffled to them."""
    rows, words = found.agg(F.count(F.lit(1)), F.sum(F.expr("aggregate(lines, 0L, (n, l) -> n + size(l.words))"))).first()
    return F.broadcast(found) if rows <= BROADCAST_DOCS and (words or 0) <= BROADCAST_WORDS else found


def phrase_matches(docs: DataFrame, items: DataFrame, *, index: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """Each row of docs as the struct doc, with n_words, n_hit and found, the sorted ids (as strings) of the items that have windows in it.

    A window are window consecutive words of an item, or all words of a shorter one. n_hit counts a document's
    words inside any occurrence of a window. Null and empty texts have no words; items without words are left out,
    repeated items count once, a null item id counts as ''. Repeated documents each get their row, also those without
    doc_id. Empty tables on either side give no matches. index is a token_index() of these or more rows; without it, one is
    stored in the shared folder until the candidates are known.
    """
    spark, rows = docs.sparkSession, _rows(docs, id_col, text_col)
    scratch = shared_dir(spark, "postings")
    index = token_index(docs, f"{scratch}/index", id_col=id_col, text_col=text_col) if index is None else index
    postings, items = _hits(rows, _items(items, item_id_col, item_text_col, window), index, rarest, scratch)
    lines = postings.groupBy("doc", "item_key", (F.col("position") - F.col("place")).alias("shift")).agg(F.collect_set("place").alias("places"))
    lines = lines.join(maybe_broadcast(items), "item_key").where("exists(windows, w -> forall(w.anchors, p -> array_contains(places, p)))")
    # an item's words once for all of its diagonals in a document
    lines = lines.groupBy("doc", "item_key").agg(F.collect_list("shift").alias("shifts")).join(maybe_broadcast(items), "item_key")
    found = lines.groupBy("doc").agg(F.collect_list(F.struct("item_id", "words", "width", "shifts")).alias("lines"))
    found = materialise(found, "candidates")
    remove(spark, scratch)
    out = rows.join(_small(found).withColumnRenamed("doc", "at"), F.col("key") == F.col("at"), "left")
    out = out.withColumn("own", tokens(F.col("text"))).withColumn("n_words", F.size("own").cast("long"))
    starts = """transform(lines, l -> struct(l.item_id AS item_id, l.width AS width, flatten(transform(l.shifts, d ->
        transform(filter(sequence(0, size(l.words) - l.width), s ->
            if(d + s >= 0, slice(own, d + s + 1, l.width) = slice(l.words, s + 1, l.width), false)), s -> d + s))) AS starts))"""
    out = out.withColumn("matches", F.expr(f"filter({starts}, l -> size(l.starts) > 0)"))
    spans = F.expr("array_sort(array_distinct(flatten(transform(matches, l -> transform(l.starts, s -> struct(s AS start, s + l.width AS end))))))")
    out = out.withColumn("spans", spans)
    hit = F.expr("aggregate(spans, struct(0 AS end, 0L AS n), (a, s) -> struct(greatest(a.end, s.end) AS end, a.n + greatest(0, s.end - greatest(a.end, s.start)) AS n), a -> a.n)")
    ids = F.expr("array_sort(array_distinct(transform(matches, l -> l.item_id)))")
    return out.select("doc", "n_words", F.coalesce(hit, F.lit(0)).cast("long").alias("n_hit"), F.coalesce(ids, F.array().cast("array<string>")).alias("found"), "spans")


def near_matches(docs: DataFrame, items: DataFrame, *, distance: int = 20, index: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """(doc_id, item_id, start): all anchors of one of the item's windows come within distance words of one another.

    start is the least position of the document from which they do. Nulls, empty tables and index as in phrase_matches().
    """
    spark, rows = docs.sparkSession, _rows(docs, id_col, text_col)
    scratch = shared_dir(spark, "postings")
    index = token_index(docs, f"{scratch}/index", id_col=id_col, text_col=text_col) if index is None else index
    postings, items = _hits(rows, _items(items, item_id_col, item_text_col, window), index, rarest, scratch)
    found = postings.groupBy("doc", "item_key").agg(F.collect_list(F.struct("position", "place")).alias("uses"))
    near = f"""transform(windows, w -> array_min(transform(filter(uses, u -> array_contains(w.anchors, u.place) AND
        forall(w.anchors, p -> exists(uses, v -> v.place = p AND v.position >= u.position AND v.position <= u.position + {distance}))), u -> u.position)))"""
    found = found.join(maybe_broadcast(items), "item_key").select("doc", "item_id", F.array_min(F.expr(near)).alias("start"))
    found = materialise(found.where("start IS NOT NULL").groupBy("doc", "item_id").agg(F.min("start").alias("start")), "near")
    remove(spark, scratch)
    return rows.join(found.withColumnRenamed("doc", "at"), F.col("key") == F.col("at")).groupBy("doc_id", "item_id").agg(F.min("start").alias("start"))


def contaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated. The arguments are phrase_matches()'s."""
    out = phrase_matches(docs, items, **how)
    return out.select(
        F.col(f"doc.`{how.get('id_col', 'doc_id')}`").alias("doc_id"), "n_words", "n_hit", F.size("found").cast("long").alias("n_items"),
        F.sha2(F.array_join("found", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of docs in which no window of an item comes."""
    return phrase_matches(docs, items, **how).where("n_hit = 0").select("doc.*")
