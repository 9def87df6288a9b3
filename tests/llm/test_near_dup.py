import random

import numpy as np
import pytest
from brute import near_dup

from lodestone.llm import near_dup as op


def rows(df):
    return {tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()}


def test_documents_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = rows(op.near_duplicates(docs, width=4))
    assert got == near_dup([(r.doc_id, r.text) for r in docs.collect()])


def test_graded_copies_chains_and_edge_cases(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocab) for _ in range(200)]
    data = [(0, None), (1, ""), (2, " \n"), (3, "a"), (4, "A"), (5, "a b"), (6, "É b"), (7, "é b")]
    for i in range(10, 150):  # copies at every distance of the same text, some of them only near one another
        w, n = list(base), rng.randrange(0, 30)
        for _ in range(n):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        data.append((i, " ".join(w)))
        if rng.random() < 0.3:
            w[rng.randrange(len(w))] = "z"
            data.append((i + 1000, " ".join(w)))
    chain = list(base)
    for i in range(300, 330):
        chain[rng.randrange(len(chain))] = f"c{i}"
        data.append((i, " ".join(chain)))
    for i in range(400, 430):  # the same truncated tail
        data.append((i, " ".join(base[: 140 - (i % 3)] + [f"t{i}"])))
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS rep", "1 AS bucket")
    assert rows(op.near_duplicates(df, width=4)) == near_dup(data)


def test_empty_repeated_and_unnamed_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert op.near_duplicates(none).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "q"), (2, "a b c d e g")], "doc_id long, text string")
    got = sorted((tuple(r) for r in op.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 1, None, True), (2, 2, 2, True)], key=str)
    assert sorted((r.doc_id or 0, r.text) for r in op.drop_near_duplicates(df).collect() if r.doc_id) == [(1, "a b c d e f"), (2, "a b c d e g")]


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 3000).astype(np.uint64)
    b = np.concatenate([a[:2400], rng.integers(0, 2**63, 600).astype(np.uint64)])
    h, doc = np.concatenate([a, b, a[:1]]), np.concatenate([np.zeros(3000, int), np.ones(3000, int), [2]])
    s = op.fast_sketch(h, doc, 4)
    assert (s[:3] != op._MAX).all() and (s[3] == op._MAX).all()
    assert abs((s[0] == s[1]).mean() - 2400 / 3600) < 0.15


def _star(spark, texts):
    """All texts around an unlinked pivot, and the links that are wanted."""
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    done = spark.createDataFrame([(-1, i, False) for i in range(len(texts))], "pivot long, member long, linked boolean")
    labels = spark.createDataFrame([], "node long, component long")
    return done, labels, nodes


def _groups(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[root(a)] = root(b)
    groups = {}
    for i in range(n):
        groups.setdefault(root(i), []).append(i)
    return sorted(map(tuple, groups.values()))


@pytest.mark.parametrize("parts", [(op.LEFT, op.RIGHT), (3000, 5000), (200, 300)])
def test_unlinked_members_of_a_star_meet_all_others(spark, tmp_path, parts):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocab) for _ in range(60)]
    texts = []
    for i in range(120):  # most pairs are just below or above the threshold
        w = list(base)
        for k in rng.sample(range(60), rng.choice([1, 1, 2, 6])):
            w[k] = f"x{i}_{k}"
        texts.append(" ".join(w))
    for common, a, b in ((4, 0, 1), (8, 0, 2), (10, 1, 1), (12, 0, 3), (16, 0, 4)) * 5:  # small sets
        w = [f"{rng.random()}" for _ in range(common + 4)]
        texts += [" ".join(w[: common + 4 - b]), " ".join(w)]
    done, labels, nodes = _star(spark, texts)
    want = near_dup(list(enumerate(texts)), 4, 80)
    got = [tuple(r) for r in op._rest(done, labels, nodes, 4, 80, f"file://{tmp_path}", *parts).collect()]
    by = {}
    for i, _, c, _ in want:
        by.setdefault(c, []).append(i)
    assert _groups(len(texts), got) == sorted(tuple(sorted(x)) for x in by.values()) and 5 < len(by) < len(texts)
    assert parts[0] != op.LEFT or len(got) < len(texts)  # one part: a forest


def test_sizes_of_intersections_are_exact():
    rng = np.random.default_rng(3)
    often = rng.integers(0, 2**63, 40).astype(np.uint64)
    sets = [np.unique(np.concatenate([often[rng.random(40) < 0.7], rng.integers(0, 3000, rng.integers(1, 60)).astype(np.uint64)])) for _ in range(150)]
    crowd = op._Crowd(sets[:100], np.arange(100), np.arange(100))
    assert crowd.matrix.shape[1] >= 30
    got = crowd.common(sets[100:])
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[:100]] for a in sets[100:]]).all()


def test_rows_of_one_id_and_without_id(spark):
    text, near, other = "a b c d e f g h i j k l m n o", "a b c d e f g h i j k l m n p", "q r s t u v w x y z a b"
    data = [(1, text), (1, other), (2, text), (None, text), (3, near), (None, "only here is this text now"), (4, None), (4, None), (5, ""), (1, text), (None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'x' AS _kept_id", "1 AS print", "2 AS doc", "3 AS once", "4 AS component")
    got = sorted(((r.doc_id, r.text) for r in op.drop_near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, text), (1, other), (None, "only here is this text now"), (4, None), (4, None), (5, ""), (None, None)], key=str)
    assert op.drop_near_duplicates(df).columns == df.columns and op.drop_near_duplicates(df.limit(0)).count() == 0
    kept = sorted(((r.doc_id, r.component_id, r.kept) for r in op.near_duplicates(df).where("n_shingles > 0").collect()), key=str)
    assert kept == sorted([(1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (None, 1, False), (3, 1, False), (None, None, True)], key=str)


def test_very_long_texts(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(5000)}" for _ in range(120_000)]
    change = [*words[:60_000], "x", *words[60_000:]]
    data = [(1, " ".join(words)), (2, " ".join(change)), (3, " ".join(reversed(words))), (4, "z" * 3_000_000)]
    assert rows(op.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), width=4)) == near_dup(data)


def test_tables_in_between_are_removed(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(op, "shared_dir", lambda _, what: made.append(tmp_path / what) or f"file://{tmp_path}/{what}")
    op.near_duplicates(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")).collect()
    assert len(made) == 1 and not made[0].exists()
