"""MinHash near-duplicate detection by fast similarity sketching, banding and exact verification.

Sketch (Dahlgaard, Knudsen, Thorup: "Fast Similarity Sketching", FOCS 2017): with t coordinates, round
i < t throws every shingle into one hashed bin with a value that starts with i; round i >= t throws all
shingles into bin i - t. A bin keeps the least value, and a document stops after the round that fills
its last bin. So every coordinate is filled after 2t rounds at the latest, in O(n + t log t) expected
time, and the share of equal coordinates of two sketches is an unbiased estimate of the Jaccard
similarity with Chernoff-type concentration.

Banding: 32 bands of 4 of the 128 coordinates; a pair at the threshold of 0.8 shares no band with
probability (1 - 0.8^4)^32 = 5e-8. Everything after that is exact:

1. Texts with equal shingle sets form one class (128-bit set fingerprints) and one node of the graph, so a group of
   exact copies costs one row.
2. In each bucket the member that meets the most others is the pivot. Only pairs with the pivot are
   verified on full shingle sets: a bucket of k members costs k - 1 pairs and not k^2 / 2.
3. What is left are pairs of members of one pivot's star, at least one of them not linked with the
   pivot, that lie in different components after step 2. Each such star's unlinked members are compared with
   all its members on full sets, as a matrix of exact intersection sizes (_Crowd): a star is dealt to tasks as pairs of parts of
   bounded size, and a task gives at most one link for each two components that it joins. So neither pairs nor texts
   of pairs are listed, however many members lie just below the threshold.
4. Components come from repeated hooking to the smallest neighbour, pointer jumping and contraction,
   all as joins of tables in the shared folder.

No bucket is capped. Tables in between are removed when the components are known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_texts, materialise, maybe_broadcast, mix64, remove, row_pieces, shared_dir, shingle_hashes, sorted_sets, trimmed

COORDINATES, BAND_ROWS, WIDTH, SIMILARITY = 128, 4, 5, 80
#: Shingles of the unlinked members, and of all members, that a part of a star has on average at most (a member counts as SMALL at least);
#: shingles, and postings, that are compared at a time.
LEFT, RIGHT, SMALL, PIECE, POSTINGS = 1 << 20, 1 << 22, 256, 1 << 18, 1 << 22
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def fast_sketch(h: np.ndarray, doc: np.ndarray, n_docs: int, t: int = COORDINATES) -> np.ndarray:
    """Sketches (n_docs x t) of the documents' distinct hashes; rows of documents without any stay at the maximum."""
    sketch = np.full(n_docs * t, _MAX, dtype=np.uint64)
    shaped = sketch.reshape(n_docs, t)
    open_docs = np.zeros(n_docs, dtype=bool)
    open_docs[doc] = True
    bits = (2 * t).bit_length()  # of the round number, which is below 2t
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            if not len(h):
                break
            v = mix64(h ^ (np.uint64(i + 1) * np.uint64(0x9E3779B97F4A7C15)))
            bins = (v % np.uint64(t)).astype(np.int64) if i < t else i - t
            np.minimum.at(sketch, doc * t + bins, (v >> np.uint64(bits)) | np.uint64(i) << np.uint64(64 - bits))
            at = np.flatnonzero(open_docs)
            full = at[(shaped[at] != _MAX).all(axis=1)]
            if len(full):
                open_docs[full] = False
                keep = open_docs[doc]
                h, doc = h[keep], doc[keep]
    return shaped


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for row, end, texts in doc_texts(column):
        texts = texts.lowered()
        first, last, doc = texts.words()
        h, d = shingle_hashes(texts.word_hashes(first, last), doc, end - row, width)
        yield row, end, *sorted_sets(h, d, end - row)


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, h, doc, at in _sets(batch.column(1), width):
                n, size = end - row, np.diff(at)
                with np.errstate(over="ignore"):
                    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix64(h ^ np.uint64(c)), dtype=np.uint64)]) for c in (0x1234567, 0x89ABCDE)]
                    prints = [(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums]
                    sketch = fast_sketch(h, doc, n).reshape(n, COORDINATES // BAND_ROWS, BAND_ROWS)
                    keys = np.broadcast_to(np.arange(1, COORDINATES // BAND_ROWS + 1, dtype=np.uint64), sketch.shape[:2])
                    for k in range(BAND_ROWS):
                        keys = mix64(keys ^ sketch[:, :, k])
                bands = np.where(size > 0, COORDINATES // BAND_ROWS, 0)
                flat = keys[size > 0].reshape(-1).view(np.int64)
                offsets = np.concatenate([[0], np.cumsum(bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), batch.column(2).slice(row, n), pa.array(size.astype(np.int64)), pa.array(prints[0]), pa.array(prints[1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    ["doc_id", "print", "n_shingles", "print_a", "print_b", "bands"],
                )

    return run


def _linked(both: int, a: int, b: int, similarity: int) -> bool:
    return both > 0 and 100 * both >= similarity * (a + b - both)


def _verify(width: int, similarity: int):
    """Of (pivot, member, text_m, text_p): whether the two are linked. Rows of a pivot come together, so its set is made once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            pivots, first, at = np.unique(np.asarray(table["pivot"]), return_index=True, return_inverse=True)
            sizes = np.asarray(pc.fill_null(pc.binary_length(table["text_m"]), 0), dtype=np.int64)
            owns = np.asarray(pc.fill_null(pc.binary_length(table["text_p"].take(pa.array(first))), 0), dtype=np.int64)
            for row, end in row_pieces(sizes + owns[at]):
                part = table.slice(row, end - row)
                used, of = np.unique(at[row:end], return_inverse=True)
                p = list(_whole(table["text_p"].take(pa.array(first[used])), width))
                linked = [_linked(len(np.intersect1d(m, p[k], assume_unique=True)), len(m), len(p[k]), similarity) for m, k in zip(_whole(part["text_m"], width), of, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part[c].combine_chunks() for c in ("pivot", "member")), pa.array(linked, pa.bool_())], ["pivot", "member", "linked"])

    return run


def _whole(column: pa.ChunkedArray, width: int) -> Iterator[np.ndarray]:
    for row, end, h, _, at in _sets(column, width):
        for i in range(end - row):
            yield h[at[i] : at[i + 1]]


def _members(width: int):
    """(member, size, hashes) of (member, text): full sets, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, h, _, at in _sets(batch.column(1), width):
                raw = [h[at[i] : at[i + 1]].tobytes() for i in range(end - row)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(np.diff(at).astype(np.int64)), pa.array(raw, pa.binary())], ["member", "size", "hashes"])

    return run


class _Crowd:
    """Members of a part of a star that others are compared with: exact intersection sizes of many sets at once.

    Hashes that an eighth of the members share are columns of a dense matrix, whose product with the others' gives their part of the sizes; all
    other hashes are looked up in a sorted list of postings.
    """

    def __init__(self, sets: list[np.ndarray], members: np.ndarray, components: np.ndarray):
        self.members, self.components = members, components
        self.sizes = np.array([len(x) for x in sets], np.int64)
        h, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(h, kind="stable")
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(h)))
        dense = count >= max(16, len(sets) // 8)
        self.column = np.where(dense, np.cumsum(dense) - 1, -1)
        of = np.repeat(np.arange(len(start)), count)
        self.matrix = np.zeros((len(sets), int(dense.sum())), np.float32)
        self.matrix[row[dense[of]], self.column[of[dense[of]]]] = 1
        self.hashes, self.start, self.count, self.row = h[start], start, count, row

    def common(self, sets: list[np.ndarray]) -> np.ndarray:
        """Intersection sizes (sets x members)."""
        n, h, row = len(self.sizes), np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        at, row = at[hit], row[hit]
        column = self.column[at]
        tall = column >= 0
        ones = np.zeros((len(sets), self.matrix.shape[1]), np.float32)
        ones[row[tall], column[tall]] = 1
        out = (ones @ self.matrix.T).astype(np.int64) if ones.shape[1] else np.zeros((len(sets), n), np.int64)
        at, row = at[~tall], row[~tall]
        for a, b in row_pieces(self.count[at], POSTINGS):
            count = self.count[at[a:b]]
            place = np.repeat(self.start[at[a:b]] - np.cumsum(count) + count, count) + np.arange(count.sum())
            out += np.bincount(np.repeat(row[a:b], count) * n + self.row[place], minlength=len(sets) * n).reshape(len(sets), n)
        return out

    def links(self, sets: list[np.ndarray], members: list[int], components: list[int], similarity: int) -> Iterator[tuple[int, int, int, int]]:
        """(member, member, component, component) of linked pairs of different components, one for each two components."""
        members, components = np.array(members, np.int64), np.array(components, np.int64)
        size = np.array([len(x) for x in sets], np.int64)[:, None]
        both = self.common(sets)
        ok = (both > 0) & (100 * both >= similarity * (size + self.sizes - both)) & (components[:, None] != self.components)
        i, j = np.nonzero(ok)
        _, one = np.unique(np.sort(np.stack([components[i], self.components[j]], axis=1), axis=1), axis=0, return_index=True)
        i, j = i[one], j[one]
        return zip(*(x.tolist() for x in (members[i], self.members[j], components[i], self.components[j])), strict=True)


def _compare(similarity: int):
    """Links of (pivot, low, high, side, member, component, hashes), sorted: for each key first the members of side 0 and 1, which the members of side 1 and 2 are compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left, crowd, joined = None, [], None, {}

        def root(x: int) -> int:
            while joined.get(x, x) != x:
                joined[x] = joined.get(joined[x], joined[x])
                x = joined[x]
            return x

        def pairs(rows: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            """Links between the crowd and rows, without those that join what is joined already."""
            least = max(1, len(crowd.members) // 16)  # bounds the matrix of a piece
            for at, end in row_pieces(np.array([max(least, len(r[2])) for r in rows], np.int64), PIECE):
                members, comps, sets = zip(*rows[at:end], strict=True)
                found = []
                for a, b, x, y in crowd.links(sets, members, comps, similarity):
                    x, y = root(x), root(y)
                    if x != y:
                        joined[max(x, y)] = min(x, y)
                        found.append((a, b))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        def close() -> Iterator[pa.RecordBatch]:
            """All members to compare with are there; those of side 1 are compared with one another."""
            nonlocal crowd
            if left and crowd is None:
                crowd = _Crowd([r[2] for r in left], np.array([r[0] for r in left], np.int64), np.array([r[1] for r in left], np.int64))
                yield from pairs([r[:3] for r in left if r[3] == 1])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            side, member, component, hashes = (batch.column(c) for c in range(3, 7))
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if keys[at] != key:
                    if key is not None:
                        yield from close()
                    key, left, crowd, joined = keys[at], [], None, {}
                right = []
                for i in range(at, end):
                    row = (member[i].as_py(), component[i].as_py(), np.frombuffer(hashes[i].as_py(), np.uint64))
                    if side[i].as_py() < 2:
                        left.append((*row, side[i].as_py()))
                    else:
                        right.append(row)
                if right:
                    yield from close()
                    if crowd is not None:
                        yield from pairs(right)
                at = end
        if key is not None:
            yield from close()

    return run


def connected_components(links: DataFrame, within: str | None = None) -> DataFrame:
    """(node, component) of the ends of links (a, b): the smallest node that can be reached.

    Each round hooks every node to its smallest neighbour, jumps once more and contracts the links, so
    the number of nodes that still have links at least halves. Tables go below the folder within, if it is given.
    """
    edges = materialise(links.where("a != b").select("a", "b").unionByName(links.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", within)
    labels = materialise(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct(), "labels", within)
    while not edges.isEmpty():
        up = materialise(edges.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p")), "parents", within)
        far = up.select(F.col("a").alias("p"), F.col("p").alias("q"))
        up = materialise(up.join(far, "p", "left").select("a", F.coalesce("q", "p").alias("p")), "parents", within)
        far = up.select(F.col("a").alias("component"), "p")
        labels = materialise(labels.join(far, "component", "left").select("node", F.coalesce("p", "component").alias("component")), "labels", within)
        edges = edges.join(up, "a").select(F.col("p").alias("a"), "b")
        edges = edges.join(up.select(F.col("a").alias("b"), F.col("p").alias("q")), "b").where("a != q").select("a", F.col("q").alias("b")).distinct()
        edges = materialise(edges, "edges", within)
    return labels


def _verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: int, within: str) -> DataFrame:
    """(pivot, member, linked). The member's text joins first, so that a hot pivot's rows are heavy and Spark splits its partition by size."""
    pairs = pairs.join(texts.select(F.col("node").alias("member"), F.col("text").alias("text_m")), "member")
    pairs = pairs.join(texts.select(F.col("node").alias("pivot"), F.col("text").alias("text_p")), "pivot")
    pairs = pairs.select("pivot", "member", "text_m", "text_p")
    return materialise(pairs.mapInArrow(trimmed(_verify(width, similarity)), "pivot long, member long, linked boolean"), "verified", within)


def _rest(done: DataFrame, labels: DataFrame, texts: DataFrame, width: int, similarity: int, within: str, left: int = LEFT, right: int = RIGHT) -> DataFrame:
    """Links (a, b) of step 3, as many as join the components that they join."""
    star = done.join(labels.withColumnRenamed("node", "member"), "member", "left").withColumn("component", F.coalesce("component", "member"))
    mixed = star.groupBy("pivot").agg(F.min("linked").alias("all_linked"), F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = materialise(mixed.where("NOT all_linked AND low != high").select("pivot"), "mixed", within)
    star = materialise(star.join(maybe_broadcast(mixed), "pivot", "left_semi"), "stars", within)
    wanted = star.select(F.col("member").alias("node")).distinct()
    sets = materialise(texts.join(wanted, "node", "left_semi").select("node", "text").mapInArrow(trimmed(_members(width)), "member long, size long, hashes binary"), "sets", within)
    sized = materialise(star.join(sets.select("member", "size"), "member"), "sized", within)
    weight = F.greatest("size", F.lit(SMALL))
    parts = sized.groupBy("pivot").agg(F.ceil(F.sum(F.when(~F.col("linked"), weight)) / left).alias("lows"), F.ceil(F.sum(weight) / right).alias("highs"))
    keyed = sized.join(maybe_broadcast(materialise(parts, "parts", within)), "pivot")
    # an unlinked member meets all parts of the others; a star of one part needs each member once
    own, other = F.pmod(F.xxhash64("member"), F.col("lows")), F.pmod(F.xxhash64("member", F.lit(7)), F.col("highs"))
    place = lambda low, high, side: F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"), F.lit(side).alias("side"))
    zero, none = F.lit(0), F.array().cast("array<struct<low:bigint,high:bigint,side:int>>")
    split = F.concat(
        F.when(F.col("linked"), none).otherwise(F.transform(F.sequence(zero.cast("long"), F.col("highs") - 1), lambda k: place(own, k, 0))),
        F.transform(F.sequence(zero.cast("long"), F.col("lows") - 1), lambda k: place(k, other, 2)),
    )
    places = F.when((F.col("lows") > 1) | (F.col("highs") > 1), split).otherwise(F.array(F.when(F.col("linked"), place(zero, zero, 2)).otherwise(place(zero, zero, 1))))
    keyed = keyed.select("pivot", "member", "component", F.explode(places).alias("at")).select("pivot", "at.*", "member", "component").join(sets.select("member", "hashes"), "member")
    keyed = keyed.select("pivot", "low", "high", "side", "member", "component", "hashes").repartition("pivot", "low", "high").sortWithinPartitions("pivot", "low", "high", "side")
    return materialise(keyed.mapInArrow(trimmed(_compare(similarity)), "a long, b long"), "rest", within)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, print, text); doc_id and print tell a row's document and text, rows with both the same are repeats."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), text.alias("text"))


def _same_row(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["print"] == b["print"])


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: int) -> DataFrame:
    """(doc_id, print, n_shingles, component, component_id) of each row: component is null without shingles, component_id the component's least doc_id."""
    spark, rows = docs.sparkSession, _rows(docs, id_col, text_col)
    scratch = shared_dir(spark, "near-dup")
    sets = rows.select("doc_id", "text", "print").mapInArrow(trimmed(_sketches(width)), "doc_id long, print long, n_shingles long, print_a long, print_b long, bands array<long>")
    sets = materialise(sets, "sketches", scratch)
    same = ["print_a", "print_b", "n_shingles"]
    full = sets.where("n_shingles > 0")
    classes = full.groupBy(*same).agg(F.min("doc_id").alias("rep")).withColumn("node", F.monotonically_increasing_id())  # fixed once written
    classes = materialise(classes, "classes", scratch)
    first = full.join(classes, same).where("doc_id <=> rep").select("node", "doc_id", "print", "bands")
    groups = first.select(F.explode("bands").alias("bucket"), F.col("node").alias("member")).distinct()
    size = groups.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = materialise(groups.join(materialise(size, "buckets", scratch), "bucket"), "groups", scratch)
    met = groups.select(F.col("member").alias("node")).distinct()
    chosen = first.join(met, "node", "left_semi").groupBy("node", "doc_id").agg(F.min("print").alias("print"))
    texts = rows.join(chosen, _same_row(rows, chosen)).select("node", "text")
    if not sets.groupBy("doc_id", "print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        texts = texts.dropDuplicates(["node"])  # repeated rows
    texts = materialise(texts, "texts", scratch)
    meets = materialise(groups.groupBy("member").agg(F.sum("n").alias("meets")), "meets", scratch)
    pivots = materialise(groups.join(meets, "member").groupBy("bucket").agg(F.max_by("member", "meets").alias("pivot")), "pivots", scratch)
    pairs = groups.join(pivots, "bucket").where("pivot != member").select("pivot", "member").distinct()
    done = _verified(pairs, texts, width, similarity, scratch)
    links = done.where("linked").select(F.col("pivot").alias("a"), F.col("member").alias("b"))
    labels = connected_components(links, scratch)
    rest = _rest(done, labels, texts, width, similarity, scratch)
    if not rest.isEmpty():
        labels = connected_components(links.unionByName(rest), scratch)
    labels = classes.join(labels, "node", "left").select(*same, "rep", F.coalesce("component", "node").alias("component"))
    least = labels.groupBy("component").agg(F.min("rep").alias("component_id"))
    member = full.drop("bands").join(labels.drop("rep").join(least, "component"), same).select("doc_id", "print", "n_shingles", "component", "component_id")
    none = sets.where("n_shingles = 0").select("doc_id", "print", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    out = materialise(member.unionByName(none), "components")
    remove(spark, scratch)
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A document's set are its distinct runs of width words (lower-cased A-Z, parted by ASCII white space);
    with fewer words, the whole sequence as one. Documents are linked if 100 * |A and B| >= similarity *
    |A or B|; component_id is the smallest doc_id that links reach, and kept says that it is the document's.

    Null and empty texts, and texts without words, have no shingles and are linked with nothing. Repeated
    rows each get a row, with the same component_id; rows of one doc_id with different texts are documents of their own. Rows without doc_id
    are linked as others are and take their component's least doc_id, or null, and are kept only in the second case. Ids must be
    integers or read as such. Other columns are ignored. An empty table gives none.
    """
    out = _components(docs, id_col, text_col, width, similarity).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """docs with one row of each component: the one of the least doc_id (rows without one come last), and of its texts the one of the least hash.

    Rows without shingles all stay, also repeated ones; of a kept row's repeats one stays. All columns stay as they are.
    """
    found = _components(docs, id_col, text_col, width, similarity)
    last = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "print")
    first = found.where("component IS NOT NULL").groupBy("component").agg(F.min(last).alias("k")).select("k.doc_id", "k.print")
    bare = found.where("component IS NULL").select("doc_id", "print").distinct()
    one, every = first.withColumn("once", F.lit(True)), bare.withColumn("once", F.lit(False))
    kept = materialise(one.unionByName(every), "kept").select(F.col("doc_id").alias("at_id"), F.col("print").alias("at_print"), "once")
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("print"))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("print") == F.col("at_print")))
    if not found.groupBy("doc_id", "print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():  # repeated rows
        rows = rows.where("NOT once").unionByName(rows.where("once").dropDuplicates(["doc_id", "print"]))
    return rows.select("doc.*")
