"""The operators against plain versions, and their handling of nulls, empty tables, ties and clashing columns."""

import base64
import math
import random
from array import array
from pathlib import Path

import brute
import numpy as np
import pytest

from lodestone.llm import chat, decontaminate, licenses, mixing, quality, queries, secrets, token_counts, token_output, tokenizer, toxicity

ODD = [(0, None), (1, ""), (2, " \n\t"), (3, "a"), (4, "x " * 30), (None, "É é ß 漢字 " * 9), (7, "b\x0bc\x1cd e"), (7, "b\x0bc\x1cd e"), (8, "long " + "wörd " * 30000)]


def table(spark, name, sf_dir):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def odd(spark, **more):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    for c in ("lang", "source", "n_words", "size", "key", "doc", "words", "print", "task", "slot", "position", "own", "base", "score"):
        df = df.selectExpr("*", f"cast(null AS string) AS {c}")
    return df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# --- decontamination
C5 = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_contamination(spark):
    d = "/root/testdata/sf0.01"
    docs, items = table(spark, "documents", d), table(spark, "benchmark", d)
    got = rows(decontaminate.contaminated(docs, items), *C5)
    want = brute.contaminated([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert set(got) == want and len(got) == docs.count() and any(x[-1] for x in want)


def test_contamination_edge_cases(spark):
    items = [(1, "one two"), (2, "a b c d e f g h i j k"), (2, "a b c d e f g h i j k"), (3, None), (4, "--"), (5, "a a a a a a a a a a a"), (6, "never seen here"), (10, "É ß")]
    docs = [*ODD[:6], (20, "a " * 25), (21, "x ONE-two one two"), (22, "a b c d e f g h i j a b c d e f g h i j k"), (23, "b c d e f g h i j k"), (24, "é ß É ß"), (24, "é ß É ß")]
    items_df = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS words", "2 AS width")
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS lines", "'y' AS at_id", "3 AS n_words")
    got = rows(decontaminate.contaminated(df, items_df), *C5)
    assert set(got) == brute.contaminated(docs, items) and len(got) == len(docs)
    left = decontaminate.without_contaminated(df, items_df)
    assert left.columns == df.columns and left.count() == sum(not x[-1] for x in got)
    assert decontaminate.contaminated(empty(spark), items_df).count() == 0
    assert not any(x[-1] for x in rows(decontaminate.contaminated(df, items_df.limit(0)), *C5))


def test_proximity(spark):
    df = spark.createDataFrame([(1, "p q x x r"), (2, "p x x x x x x x x q r"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(9, "q p r")], "item_id long, text string")
    assert rows(decontaminate.near_matches(df, items, distance=5), "doc_id", "item_id", "start") == [(1, "9", 0)]


def test_one_index_for_several_benchmarks(spark, tmp_path):
    df = spark.createDataFrame([(1, "P q x x r"), (2, "p x x x x x x x x q r"), (2, "p x x x x x x x x q r"), (3, None), (None, "q r")], "doc_id long, text string")
    index = decontaminate.token_index(df, str(tmp_path / "index"))
    assert index.columns == ["term", "doc", "position"] and index.count() == 29
    for text, hit, near in (("q r", {2, None}, {1, 2, None}), ("p q", {1}, {1}), ("x x", {1, 2}, {1, 2})):
        items = spark.createDataFrame([(9, text)], "item_id long, text string")
        got = rows(decontaminate.contaminated(df, items, index=index), "doc_id", "contaminated")
        assert len(got) == 5 and {x for x, c in got if c} == hit
        assert {x for x, _ in rows(decontaminate.near_matches(df, items, index=index, distance=5), "doc_id", "item_id")} == near
        # rows that are a part of the index's
        assert {x for x, c in rows(decontaminate.contaminated(df.where("doc_id = 1"), items, index=index), "doc_id", "contaminated") if c} == hit & {1}


# --- quality
C6 = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_counts(spark, sf_dir):
    rng = random.Random(3)
    extra = [(1000 + i, "".join(rng.choice("ab# \n\té") for _ in range(rng.randint(0, 400)))) for i in range(300)]
    docs = [(r.doc_id, r.text) for r in table(spark, "documents", sf_dir).collect()] + extra + ODD[:6]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'en' AS lang")
    assert set(rows(quality.quality_verdicts(df, labels(spark)), *C6)) == brute.quality(docs)


def test_quality_thresholds(spark):
    rng = random.Random(4)
    docs, marks = [], []
    for i in range(5200):
        bad = i % 4 == 0
        docs.append((i, " ".join(("w%d" % rng.randrange(10**6)) + ("#$%" if bad else "") for _ in range(30)), "en" if i < 5000 else "de"))
        marks.append((i, 0 if bad else 1, 0))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r.doc_id: r.kept for r in quality.quality_verdicts(df, labels(spark, marks)).collect()}
    good = [got[i] for i, q, _ in marks if q and i < 5000]
    assert sum(not x for x in good) <= quality.RISK * len(good)
    assert not any(got[i] for i, q, _ in marks if not q and i < 5000)
    kept = quality.keep_quality(df, labels(spark, marks))
    assert kept.columns == df.columns and kept.count() == sum(got.values())


def test_small_strata_get_cutoffs():
    for sizes in ({"en": 2013, "": 1289}, {"en": 1200, "": 0}, {"en": 9000, "de": 8000, "fr": 3000}):
        level = quality.levels(sizes)
        assert sum(level.values()) <= quality.DELTA / 5 + 1e-12
        assert level.keys() == {s for s, n in sizes.items() if n}
        assert all(quality.upper_bound(0, sizes[s], x) <= quality.RISK / 5 for s, x in level.items())
    assert quality.levels({"en": 1149, "": 1149}).keys() == {""} and quality.levels({"en": 1100}) == {}
    assert quality.own_strata({"en": 2076, "de": 1100, "": 233}) == ["en"]  # 1,100 can't be certified besides and stay pooled
    assert quality.own_strata({"en": 1100, "": 600}) == [] and quality.own_strata({"en": 1200}) == ["en"] and quality.own_strata({}) == []

    def hist(top, rest):
        return {(s, k): np.array([n - min(n, top), *[0] * (size - 2), min(n, top)]) for s, n in rest.items() for k, (_, size) in quality.SIGNALS.items()}

    got = quality.choose_cutoffs(hist(0, {"en": 2013, "": 1289}), hist(500, {"en": 400, "": 160}))
    assert got.keys() == {(s, k) for s in ("en", "") for k in quality.SIGNALS}
    alone = quality.choose_cutoffs(hist(0, {"en": 1200, "": 0}), hist(500, {"en": 400, "": 0}))
    assert alone.keys() == {("en", k) for k in quality.SIGNALS}


def test_quality_cutoffs_of_the_table(spark):
    d = "/root/testdata/sf0.1"
    docs, marks = table(spark, "documents", d), table(spark, "labels", d)
    got = quality.quality_verdicts(docs, marks).join(marks, "doc_id").where("NOT base_failed AND quality IS NOT NULL").collect()
    good, bad = [r.kept for r in got if r.quality], [r.kept for r in got if not r.quality]
    assert good.count(False) <= quality.RISK * len(good) and bad.count(False) > 0


def test_quality_edge_cases(spark):
    assert quality.quality_verdicts(empty(spark), labels(spark)).count() == 0
    assert quality.quality_verdicts(odd(spark), labels(spark, [(None, 1, 1), (3, None, None), (3, 1, 0)])).count() == len(ODD)
    kept = quality.keep_quality(odd(spark), labels(spark))
    assert kept.columns == odd(spark).columns


def test_binomial_bound():
    for errors, n, delta in ((0, 100, 0.05), (3, 200, 0.01), (10, 50, 0.001)):
        p = quality.upper_bound(errors, n, delta)
        tail = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(errors + 1))
        assert tail == pytest.approx(delta, rel=1e-6)


# --- mixing
def test_water_filling():
    got = mixing.water_fill([100, 10, 50, 0], [1, 2, 3, 1], 160)
    assert got[1] == 30 and got[3] == 0 and sum(got) == pytest.approx(160) and got[2] == pytest.approx(3 * got[0])
    assert mixing.water_fill([], [], 0) == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mixing(spark, sf):
    docs = table(spark, "documents", f"/root/testdata/{sf}")
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    texts = {r.doc_id: r for r in docs.collect()}
    assert got.keys() == texts.keys()
    by = {}
    for i, r in texts.items():
        assert got[i].size == len(brute.words(r.text))
        by.setdefault(r.source, []).append(got[i])
    names = sorted(by, key=lambda s: s.encode())
    want = mixing.water_fill([sum(x.size for x in by[s]) for s in names], [1 + i % 3 for i in range(len(names))], sum(x.size for x in got.values()))
    for s, t in zip(names, want, strict=True):
        assert all(x.target == pytest.approx(t) and x.taken <= 3 * x.size and x.source_size == sum(y.size for y in by[s]) for x in by[s])
        assert abs(sum(x.taken for x in by[s]) - t) <= 0.05 * t + 30
    assert {r.doc_id: r.taken for r in mixing.mix(docs.repartition(5)).collect()} == {i: r.taken for i, r in got.items()}
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed(docs).count() == sum(r.taken // r.size if r.size else 0 for r in got.values()) + sum(1 for r in mixing.mixed(docs).collect() if not brute.words(r.text))


def test_mixing_edge_cases(spark):
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0
    assert mixing.mix(odd(spark)).count() == len(ODD)
    assert mixing.mixed(odd(spark)).columns == odd(spark).columns


# --- token output
def test_permutation():
    for n in (1, 2, 3, 10, 97, 1000):
        slots = token_output.permute(np.arange(n), n)
        assert sorted(slots) == list(range(n))
    assert (token_output.permute(np.arange(1000), 1000) != np.arange(1000)).mean() > 0.9
    assert (token_output.permute(np.arange(1000), 1000, key=1) != token_output.permute(np.arange(1000), 1000, key=2)).any()


@pytest.fixture(scope="module")
def plain():
    import tiktoken

    with open(tokenizer.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_encoder(plain, spark, sf_dir):
    texts = [r.text for r in table(spark, "documents", sf_dir).collect()]
    rng = random.Random(8)
    texts += ["".join(rng.choice(" \n\t\r\x0b\x1c\x85\xa0 '’sdlvetrm12²½aAéÉß漢.,_-!—𝒳́ ") for _ in range(60)) for _ in range(3000)]
    encode = tokenizer.encoder().encode
    assert all(array("H", plain(t)).tobytes() == encode(t) for t in texts)


def _texts_of(order, folder, length):
    """{(doc_id): ids} and the padding, read from shards by the order table."""
    files = sorted(Path(folder).glob("shard-*.bin"))
    image = np.concatenate([token_output.read_shard(f.read_bytes(), length) for f in files])
    covered, texts = np.zeros(image.shape, bool), {}
    for r in sorted(order, key=lambda r: (str(r.doc_id), r.part)):
        assert not covered[r.slot, r.offset : r.offset + r.n_tokens].any()
        covered[r.slot, r.offset : r.offset + r.n_tokens] = True
        texts.setdefault(r.doc_id, []).extend(image[r.slot, r.offset : r.offset + r.n_tokens].tolist())
    return texts, image[~covered], len(image), files


@pytest.mark.parametrize(("length", "block"), [(64, 2048), (16, 3)])
def test_shards(spark, plain, sf_dir, tmp_path, monkeypatch, length, block):
    monkeypatch.setattr(token_output, "BLOCK", block)
    docs = table(spark, "documents", sf_dir).repartition(3)
    order = token_output.write_shards(docs, str(tmp_path), shard_size=100, length=length).collect()  # no scheme
    texts, padding, n, files = _texts_of(order, tmp_path, length)
    assert {r.slot for r in order} == set(range(n)) and len(files) == math.ceil(n / 100) and all(r.shard == r.slot // 100 for r in order)
    assert set(padding) <= {tokenizer.END_OF_TEXT} and len(padding) < 3 * length
    parts = {}
    for r in order:
        parts.setdefault(r.doc_id, []).append(r.part)
    assert all(sorted(p) == list(range(len(p))) for p in parts.values())
    assert texts == {r.doc_id: [*plain(r.text), tokenizer.END_OF_TEXT] for r in docs.collect()}
    data = files[0].read_bytes()
    assert (token_output.read_shard(data, length, 3) == token_output.read_shard(data, length)[3:]).all()


def test_shards_again_in_the_same_folder(spark, sf_dir, tmp_path):
    docs = table(spark, "documents", sf_dir)
    one, two = f"file://{tmp_path}/one", f"file://{tmp_path}/two"
    token_output.write_shards(docs, one, shard_size=100, length=64)
    (tmp_path / "one/.shard-00000000-7").write_bytes(b"left by a task that died")
    changed = docs.where("doc_id < 100").selectExpr("doc_id", "upper(text) AS text")
    for to in (one, two):
        token_output.write_shards(changed, to, shard_size=100, length=64, key=7)
    files = [{f.name: f.read_bytes() for f in (tmp_path / x).iterdir() if f.is_file()} for x in ("one", "two")]
    assert files[0] == files[1] and len(files[0]) > 1 and list((tmp_path / "one/manifest").glob("part-*"))


def test_shards_edge_cases(spark, tmp_path):
    assert token_output.write_shards(empty(spark), f"file://{tmp_path}/none").count() == 0
    order = token_output.write_shards(odd(spark), f"file://{tmp_path}/odd")
    assert order.where("part = 0").count() == len(ODD)


# --- token counts
def test_ledger(spark, plain, sf_dir, tmp_path):
    docs = table(spark, "documents", sf_dir)
    data = docs.collect()
    ledger = token_counts.TokenLedger(spark, f"file://{tmp_path}/ledger")
    assert ledger.totals().count() == 0
    assert ledger.commit("a", token_counts.inserted(docs)) and not ledger.commit("a", token_counts.inserted(docs))
    old = docs.where("doc_id < 50")
    assert ledger.commit("b", token_counts.revised(old, old.selectExpr("doc_id", "'new' AS source", "lang", "'hello world' AS text")))
    assert ledger.commit("c", docs.where("doc_id >= 150").selectExpr("-1 AS sign", "source", "lang", "text"))
    want = {}
    for r in data:
        if r.doc_id < 150:
            source, text = ("new", "hello world") if r.doc_id < 50 else (r.source, r.text)
            for name, n in (("byte_bpe_50k", len(plain(text))), ("white_space", len(brute.words(text)))):
                x = want.setdefault((source, r.lang, name), [0, 0, 0])
                x[0], x[1], x[2] = x[0] + 1, x[1] + n, x[2] + len(text)
    totals = lambda: {tuple(r)[:3]: list(r)[3:] for r in ledger.totals().collect()}
    assert totals() == want
    assert ledger.compact() and not ledger.compact() and totals() == want and ledger.committed() == ["a", "b", "c"]
    assert not ledger.commit("b", token_counts.inserted(docs)) and ledger.commit("d/e f", token_counts.deleted(docs.where("doc_id = 149"))) and totals() != want
    assert ledger.commit("undo", token_counts.inserted(docs.where("doc_id = 149"))) and totals() == want and "d/e f" in ledger.committed()


def test_ledger_of_two_drivers(spark, sf_dir, tmp_path, monkeypatch):
    docs = table(spark, "documents", sf_dir).limit(5)
    one, two = (token_counts.TokenLedger(spark, f"file://{tmp_path}") for _ in range(2))
    monkeypatch.setattr(two, "committed", lambda: [])  # it looked before the other one committed
    assert one.commit("a", token_counts.inserted(docs)) and not two.commit("a", token_counts.inserted(docs))
    assert {r.n_docs for r in one.totals().groupBy("tokenizer").sum("n_docs").toDF("tokenizer", "n_docs").collect()} == {5}
    assert len(list((tmp_path / "counts").iterdir())) == 1


def test_counts_of_the_table(spark, plain, sf_dir):
    want = {}
    for r in table(spark, "documents", sf_dir).collect():
        for name, n in (("byte_bpe_50k", len(plain(r.text))), ("white_space", len(brute.words(r.text)))):
            x = want.setdefault((r.source, r.lang, name), [0, 0, 0])
            x[0], x[1], x[2] = x[0] + 1, x[1] + n, x[2] + len(r.text)
    assert {tuple(r)[:3]: list(r)[3:] for r in queries.op2_token_counts(spark, sf_dir).collect()} == want


def test_counts_edge_cases(spark):
    assert token_counts.corpus_counts(empty(spark)).count() == 0
    assert {r.n_docs for r in token_counts.corpus_counts(odd(spark)).collect()} == {len(ODD)}


# --- secrets
C10 = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def test_secrets(spark):
    rng = random.Random(6)
    parts = ["password=", "Secret : ", "TOKEN='", "api_key=", "ApiKey= \"", "AKIA", "ABCDEF0123456789", "0123456789abcdef" * 2, "deadbeef", " ", "é", "\n", "x", ":", "ſecret=abcdef1", "toKen=abcdef1"]
    data = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(500)]
    data += [(r.doc_id, r.text) for r in table(spark, "documents", "/root/testdata/sf0.01").collect()] + ODD
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = rows(secrets.secret_digests(secrets.secret_spans(df)), *C10)
    want = sorted(((d, *brute.secrets(t)[0]) for d, t in data), key=str)
    assert sorted((x[:5] for x in got), key=str) == want
    spans = {d: set(brute.secrets(t)[1]) for d, t in data if d is not None and d >= 500}
    assert all(v <= set(s.split(",")) | {""} for d, *_, s in got if (v := spans.get(d)))


def test_random_strings_are_found(spark):
    rng = random.Random(7)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    prose = [(r.doc_id, r.text) for r in table(spark, "documents", "/root/testdata/sf0.01").collect()]
    prose = [(d, t) for d, t in prose if not brute.secrets(t)[1]]
    keys = [(10_000 + i, t + " " + "".join(rng.choice(b64) for _ in range(40)) + " end") for i, (_, t) in enumerate(prose[:60])]
    words = [(20_000 + i, "see averyveryverylongcamelCaseIdentifier1 and zzzzzzzzzzzzzzzzzzzzzzzz1111111") for i in range(20)]
    df = spark.createDataFrame(prose + keys + words, "doc_id long, text string")
    got = {d: s for d, s in rows(secrets.secret_digests(secrets.secret_spans(df)), "doc_id", "spans")}
    assert sum("random:" in got[d] for d, _ in keys) >= 54
    assert not any(got[d] for d, _ in words) and not any(got[d] for d, _ in prose)


def test_null_distribution_is_of_whole_texts():
    rng = random.Random(11)
    words = ["".join(rng.choice("etaoinshrdluETAOIN") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    texts = ["", "é 12", " ".join(words), " ".join(words[:30]), *words[:50]]
    alphabets = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    want = np.zeros((4, len(secrets.CLASSES), secrets.BINS), int)
    for t in texts:
        for f, alphabet in enumerate(alphabets):
            case = (str.lower, str.upper, str.lower, str)[f]
            letters = [alphabet.index(case(c)) for c in t if c.isascii() and c.isalpha() and case(c) in alphabet]
            for k, n in enumerate(secrets.CLASSES):
                for at in range(0, len(letters) - n + 1, n):
                    want[f, k, secrets._bin(secrets.randomness(letters[at : at + n], len(alphabet)))] += 1
    assert (secrets.prose_histogram(texts) == want).all() and want.sum() > 1000


def test_random_strings_among_many_paths_and_in_short_texts(spark):
    rng = random.Random(12)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    prose = [(r.doc_id, r.text) for r in table(spark, "documents", "/root/testdata/sf0.01").collect()]
    prose = [(d, t) for d, t in prose if not brute.secrets(t)[1]]
    many = [(d, t + " /var/lib/some/very/long/path/of/a/file1" * 3) for d, t in prose]  # 3 strings a document that aren't secrets
    short = [(d, " ".join(t.split())[:100]) for d, t in prose]
    for docs, length in ((many, 44), (short, 70)):
        keys = [(10_000 + i, t + " " + "".join(rng.choice(b64) for _ in range(length)) + " end") for i, (_, t) in enumerate(docs[:60])]
        df = spark.createDataFrame(docs + keys, "doc_id long, text string")
        got = {d: s for d, s in rows(secrets.secret_digests(secrets.secret_spans(df)), "doc_id", "spans")}
        assert sum("random:" in got[d] for d, _ in keys) >= 54
        assert not any(got[d] for d, _ in docs)


def test_random_strings_of_every_encoding(spark):
    rng = random.Random(13)
    prose = [(r.doc_id, r.text) for r in table(spark, "documents", "/root/testdata/sf0.01").collect()]
    prose = [(d, t) for d, t in prose if not brute.secrets(t)[1]]
    alphabets = {"HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz"}
    keys = [(10_000 * k + i, t + " " + "".join(rng.choice(a) for _ in range(40)) + " end") for k, a in enumerate(alphabets.values(), 1) for i, (_, t) in enumerate(prose[:40])]
    got = {d: s for d, s in rows(secrets.secret_digests(secrets.secret_spans(spark.createDataFrame(prose + keys, "doc_id long, text string"))), "doc_id", "spans")}
    for k in range(1, 4):
        assert sum("random:" in got[10_000 * k + i] for i in range(40)) >= 36
    assert not any(got[d] for d, _ in prose)


def test_secrets_edge_cases(spark):
    assert secrets.secret_spans(empty(spark)).count() == 0
    assert secrets.secret_spans(odd(spark)).count() == len(ODD)


# --- chats
C4 = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


def test_chats(spark, sf_dir):
    turns = table(spark, "conversations", sf_dir)
    got = rows(queries.op4_chat_formatting(spark, sf_dir), *C4)
    data = [(r.conv_id, r.turn, r.role, r.text) for r in turns.collect()]
    said = "</s>[INST] ok [/INST]"
    assert set(got) == brute.chat([*data, (-1, 0, "user", said), (-1, 1, "assistant", said)])


def test_chat_edge_cases(spark):
    data = [(1, 0, "user", "\\l<|end|>\\e\\"), (1, 1, "assistant", "<|role|>a<|text|>[b]\\b é漢"), (1, 1, "assistant", None), (1, None, None, "\n"), (2, 0, "<|text|>", "x"), (None, 0, "assistant", "y"), (1, 1, "assistant", None)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS pieces", "'z' AS formatted", "2 AS turns")
    got = rows(chat.chat_digests(chat.format_chats(df)), *C4)
    assert set(got) == brute.chat(data) and len(got) == 3
    assert chat.format_chats(df.limit(0)).count() == 0


def test_ties_go_by_texts_before_escaping_and_the_mask_tells_the_loss(spark):
    data = [(1, 0, "assistant", "=a"), (1, 0, "assistant", "<a"), (1, 0, "assistant", "\\a"), (1, 0, "assistant", "[a"), (1, 1, "user", "é<|end|>"), (1, 2, "assistant", "")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(df)
    r = chats.first()
    assert set(rows(chat.chat_digests(chats), *C4)) == brute.chat(data)
    assert [r.formatted[a:b] for a, b in r.loss_mask] == ["\\la", "=a", "\\ba", "\\ea", ""]
    from pyspark.sql import functions as F

    wrong = chats.withColumn("loss_mask", F.transform("loss_mask", lambda x: F.struct((x["start"] + 1).alias("start"), x["end"].alias("end"))))
    assert chat.read_back(wrong).first().loss_text is None


def test_a_very_long_chat(spark):
    data = [(1, i, "assistant" if i % 2 else "user", f"t{i} <" * 3) for i in range(4000)] + [(2, 0, "assistant", "é<[\\ " * 200_000)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    assert set(rows(chat.chat_digests(chat.format_chats(df)), *C4)) == brute.chat(data)


def test_content_parts(spark):
    part = "array<struct<kind:string,text:string,ref:string,amount:double>>"
    data = [(1, 0, "user", [("text", "see <b>", None, None), ("image", None, "a.png", 512.0 * 513), ("audio", None, "b.wav", 1.5), None, ("odd", "t", None, None)]), (1, 1, "assistant", [("document", None, "c.pdf", 3.0)]), (1, 2, "user", None)]
    df = spark.createDataFrame(data, f"conv_id long, turn long, role string, parts {part}")
    r = chat.format_chats(df, parts_col="parts").first()
    assert r.formatted == "<|role|>user<|text|>see \\lb><|image:1|><|audio:2|>t<|end|><|role|>assistant<|text|><|document:0|><|end|><|role|>user<|text|><|end|>"
    assert [tuple(a) for a in r.attachments] == [(0, 1, "image", "a.png", 170), (0, 2, "audio", "b.wav", 50), (1, 0, "document", "c.pdf", 1800)]
    assert r.attachment_tokens == 2020


# --- toxicity
def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, marks = table(spark, "documents", d), table(spark, "labels", d)
    got = toxicity.toxicity_scores(docs, marks).join(marks, "doc_id").where("held_out").collect()
    toxic, clean = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    assert len(got) > 500 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert np.mean([s >= 0.5 for s in toxic]) > 0.75 and np.mean([s < 0.5 for s in clean]) > 0.98  # 12 of 97 toxic labels are noise


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(2)
    y = (rng.random(4000) < 0.3).astype(int)
    votes = np.stack([rng.random(4000) < np.where(y, p, f) for p, f in ((0.9, 0.05), (0.7, 0.1), (0.5, 0.5))] + [np.zeros(4000)], axis=1).astype(float)
    votes[:, 3] = np.where(rng.random(4000) < 0.8, votes[:, 0], rng.random(4000) < 0.3)
    model = toxicity.label_model(votes, np.where(votes[:, 1] > 0, 0.9, 0.1))  # no label takes part
    q = toxicity.posterior(votes, model)
    assert ((q > 0.5) == y).mean() > 0.9
    assert model["rates"][1][0] == pytest.approx(0.9, abs=0.1) and model["covariance"][0, 3] > 5 * abs(model["covariance"][0, 1])
    assert model["prior"] == pytest.approx(0.3, abs=0.06) and model["shares"][0] < model["shares"][2]


def test_toxicity_edge_cases(spark):
    assert toxicity.toxicity_scores(empty(spark), labels(spark)).count() == 0
    got = toxicity.toxicity_scores(odd(spark), labels(spark, [(None, 1, 1), (3, 1, None), (4, 1, 1), (8, 1, 0)]))
    assert got.count() == len(ODD) and got.where("score IS NULL OR held_out IS NULL").count() == 0


# --- licenses
def test_licenses(spark):
    mit = "The MIT Licence\n" + licenses.MIT
    data = [(1, "Copyright (c) 2020 Some One\n\n" + licenses.MIT.replace(", ", " , ").upper()), (2, mit), (3, "some text\nReleased under the MIT Licence!\nmore"), (4, licenses.MIT[:-20]), (5, None), (5, None), (6, "Licensed under CC BY-NC 4.0.\nlicensed under  cc-by-nc 4.0\nReleased under the MIT License."), (7, "  "), (6, "Licensed under CC BY-NC 4.0.\nlicensed under  cc-by-nc 4.0\nReleased under the MIT License.")]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 AS digest", "2 AS license", "3 AS lines")
    got = sorted(rows(licenses.license_matches(df), "doc_id", "license", "n_license_lines", "line_licenses"))
    assert got == [(1, "MIT", 0, ""), (2, None, 0, ""), (3, None, 1, "MIT"), (4, None, 0, ""), (5, None, 0, ""), (5, None, 0, ""), (6, None, 3, "CC-BY-NC-4.0,MIT"), (6, None, 3, "CC-BY-NC-4.0,MIT"), (7, None, 0, "")]
    assert licenses.license_matches(empty(spark)).count() == 0
    assert licenses.license_matches(odd(spark)).count() == len(ODD)


def test_spellings_are_whole_words(spark):
    known = [("X", "The owner may fulfil, whilst per cent (licence) stands.\nSee https://x.y"), ("Y", "licences")]
    data = [(1, "the HOLDER may fulfill while percent license stands\n\nsee http x y"), (2, "the holder may fulfilled while percent license stands see http x y"), (3, "licenses"), (4, "Licences!")]
    for limit in (licenses.IN_SCAN, 0):
        got = {r.doc_id: r.license for r in licenses.license_matches(spark.createDataFrame(data, "doc_id long, text string"), known).collect()}
        assert got == {1: "X", 2: None, 3: None, 4: "Y"}
        licenses.IN_SCAN, limit = limit and 0, licenses.IN_SCAN
    licenses.IN_SCAN = 20_000


def test_licenses_match_brute_force(spark):
    from hashlib import sha256

    d = "/root/testdata/sf0.01"
    sha = lambda t: sha256(t.encode()).hexdigest()
    known = {}
    for name, text in sorted(licenses.KNOWN, reverse=True):
        known[sha(" ".join(licenses.plain_form(text)))] = name
    docs, want = table(spark, "documents", d), []
    for r in docs.collect():
        form = licenses.plain_form(r.text)
        lines = [known[x] for x in map(sha, form) if x in known]
        want.append((r.doc_id, sha(" ".join(form)), known.get(sha(" ".join(form))), len(lines), ",".join(sorted(set(lines)))))
    assert sorted(rows(licenses.license_matches(docs), "doc_id", "digest", "license", "n_license_lines", "line_licenses")) == sorted(want) and any(w[3] for w in want)


def test_license_catalogue(spark):
    ids = ["Apache-2.0", "Artistic-1.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib"]
    assert ids == sorted(p.stem for p in licenses.TEXTS.glob("*.txt"))
    data = [(i, "Copyright (c) 2021, Some One. All rights reserved.\n\n" + (licenses.TEXTS / f"{x}.txt").read_text()) for i, x in enumerate(ids)]
    said = [("Licensed under the BSD 3-Clause License", "BSD-3-Clause"), ("# SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"), ("This project is licensed under the Mozilla Public License 2.0.", "MPL-2.0")]
    data += [(100 + i, f"some code\n{x}\nmore") for i, (x, _) in enumerate(said)]
    got = {r.doc_id: r for r in licenses.license_matches(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [got[i].license for i in range(len(ids))] == ids
    assert [got[100 + i].line_licenses for i in range(len(said))] == [x for _, x in said]
