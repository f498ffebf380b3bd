"""Each operator on small tables against brute force, and on nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import html
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat, embeddings, jaccard, links, main_text, merkle, mixing, packing, quality, sharding, suffix_dedup, token_trees, toxicity, turn_repair
from tessera.llm.common import Scratch
from tessera.llm.links import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in red blue green stone river cloud house walks sings under over".split()


def words(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing"]) for _ in range(n))


def corpus(spark, extra=()):
    """Plain, empty, null, repeated and long texts; null sources; columns whose names an operator uses itself."""
    rng = random.Random(9)
    rows = [(i, words(rng, rng.randrange(1, 120)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "ä", None]), 1) for i in range(40)]
    rows += [(100, None, "en", "a", None), (101, "", "en", "a", 0), (102, " \n\t ", None, None, 3), (103, words(rng, 3000), "en", "b", 1), (104, rows[3][1], "en", "a", 1), (0, rows[0][1], *rows[0][2:]), (None, "no id here", "en", "a", 1)]
    df = spark.createDataFrame(rows + list(extra), DOCS)
    for name in ("id", "key", "block", "slot", "size", "group", "gram", "tile", "range", "words", "n", "path", "weight", "ratio", "edge"):
        df = df.withColumn(name, F.lit("mine"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def text_of(rows):
    return [(r.doc_id, r.text) for r in rows]


# 1: mixing


def expected_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values()) * share
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        weight = sum(w[s] for s in names if s not in full)
        over = {s for s in names if s not in full and weight and rest * w[s] / weight > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else rest * w[s] / weight for s in names}
        full |= over


def test_mixing_targets_and_taken(spark):
    docs = corpus(spark)
    mix = mixing.mix_sources(spark, docs, block_tokens=16)
    rows = mixing.taken_words(mix).collect()
    assert len(rows) == docs.count()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    targets = expected_targets(sizes)
    for source, target in targets.items():
        own = [r for r in rows if r.source == source]
        assert own[0].source_size == sizes[source] and own[0].target == pytest.approx(target)
        assert sum(r.taken for r in own) == pytest.approx(target, abs=1)
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    again = mixing.taken_words(mixing.mix_sources(spark, docs.repartition(7), block_tokens=16))
    key = lambda r: (str(r.doc_id), r["size"], r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again.collect()))


def test_mixing_schedule_is_even(spark):
    docs = spark.createDataFrame([(i, "w " * 50, "en", "ab"[i % 2], 1) for i in range(200)], DOCS)
    slots = [r.sid for r in mixing.mix_sources(spark, docs, block_tokens=50).pieces.select("slot", "sid", "block").distinct().orderBy("slot", "sid").collect()]
    share = slots.count(0) / len(slots)
    assert all(abs(slots[:n].count(0) - share * n) <= 8 for n in range(1, len(slots)))
    assert mixing.taken_words(mixing.mix_sources(spark, empty(spark))).count() == 0


# 2: toxicity


def test_toxicity_finds_expressions_and_leaves_the_rest(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        text = words(rng, 80).split()
        if toxic:
            for w in rng.sample(["vile", "nasty", "rotten", "hateful"], 3):
                text.insert(rng.randrange(len(text)), w)
        rows.append((i, " ".join(text), "en", "a", 1))
        labels.append((i, int(toxic)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "a", 1), (None, "x", "en", "a", 1)]
    labels += [(1, None), (None, 1), (5000, 1), (6, 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("cells", F.lit("mine"))
    out = toxicity.score_toxicity(spark, docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    truth = {i: t for i, t in labels if i is not None and t is not None and i < 600}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    blank = {r.doc_id: r.score for r in out}
    assert blank[1000] == blank[1001]


def test_toxicity_learns_nothing_from_held_out_labels(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = spark.createDataFrame([(i, "plain words here " + ("odd" if i in held else ""), "en", "a", 1) for i in range(400)], DOCS)
    scores = [toxicity.score_toxicity(spark, docs, spark.createDataFrame([(i, int(i in held and flip)) for i in range(400)], "doc_id long, toxic int")).orderBy("doc_id").collect() for flip in (0, 1)]
    assert scores[0] == scores[1]


def plain_kneser_ney(rows, strengths):
    """(P(v | u) of a class as a function, all words): dictionaries and nothing else, for (text, toxic)."""
    counts = [[{}, {}] for _ in range(2 + len(toxicity.STEMS))]
    pairs = set()
    for text, toxic in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
        held = set(zip([None, *w[:-1]], w, strict=True))
        pairs |= held
        for u, v in held:
            for table, item in zip(counts, [(u, v), v, *[v[:k] for k in toxicity.STEMS]], strict=True):
                table[toxic][item] = table[toxic].get(item, 0) + 1
    shared = [None, {}]
    for _, v in pairs:
        shared[1][v] = shared[1].get(v, 0) + 1
    for k in toxicity.STEMS:
        up = {}
        for item, n in shared[-1].items():
            up.setdefault(item[:k], 1)
            up[item[:k]] += n
        shared.append(up)
    root = sum(shared[-1].values()) + 1

    def discount(level, c):
        n = list(counts[level][c].values())
        return strengths[level] * (n.count(1) / (n.count(1) + 2 * n.count(2)) if 1 in n else 0.5)

    d = [[discount(level, c) for c in (0, 1)] for level in range(len(counts))]

    def lower(level, c, item):
        """P of a word or beginning; one that was never seen stands for all of its kind."""
        if level == len(counts):
            return 1.0
        table = counts[level][c]
        total = sum(table.values())
        left = sum(min(n, d[level][c]) for n in table.values()) / total
        short = item[: toxicity.STEMS[level - 1]] if level <= len(toxicity.STEMS) else ""
        above = shared[level + 1].get(short, 1) if level < len(toxicity.STEMS) + 1 else root
        return max(table.get(item, 0) - d[level][c], 0) / total + left * lower(level + 1, c, short) * shared[level].get(item, 1) / above

    def probability(c, u, v):
        own = {b: n for (a, b), n in counts[0][c].items() if a == u}
        total = sum(own.values())
        if not total:
            return lower(1, c, v)
        left = sum(min(n, d[0][c]) for n in own.values()) / total
        return max(own.get(v, 0) - d[0][c], 0) / total + left * lower(1, c, v)

    return probability, shared[1]


def test_toxicity_models_are_kneser_ney(spark):
    rng = random.Random(2)
    pool = [a + b for a in ("stonework", "riverside", "vilelypure", "cloudysky", "abacuses") for b in ("", "s", "ing", "ness", "nesses")]
    rare = [f"rare{chr(97 + i % 26)}{chr(97 + i // 26)}ly" for i in range(200)]
    texts = [(" ".join(rng.choice(rare if rng.random() < 0.1 else pool[: 15 if i % 3 else 25]) for _ in range(30)), int(i % 3 == 0)) for i in range(60)]
    strengths = (1.5, 1.0, 1.2, 0.8)
    probability, known = plain_kneser_ney(texts, strengths)
    labelled = spark.createDataFrame(texts, "text string, toxic int")
    scratch = Scratch(spark)
    model, adds = toxicity.fit_models(scratch, labelled, strengths)
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts[:8])] + [(100, "unseen stonewall vilelypures stonework ab"), (101, "")], "k int, text string")
    here, joined = (sorted(map(tuple, df.collect())) for df in (toxicity.compared_here(docs, model, adds, ["k"]), toxicity.compared_by_joins(scratch, docs, model, adds, ["k"])))
    assert [pytest.approx(r, abs=1e-5) for r in here] == joined
    for k, text in docs.collect():
        w = text.split()
        gaps = [np.log(probability(1, u, v) / probability(0, u, v)) for u, v in dict.fromkeys(zip([None, *w], w, strict=False))]
        top = sorted(gaps, reverse=True)
        want = (k, len(gaps), np.mean(gaps) if gaps else 0, sum(top[:3]) / 3, sum(top[:8]) / 8)
        assert next(r for r in here if r[0] == k) == pytest.approx(want, abs=1e-5)
    # One word never seen stands for all of them below each beginning of seven letters, of five, and below none: the chances of all words add up to one.
    never = {v[:7] + "~" for v in known} | {v[:5] + "~~~" for v in known} | {"~~~~~~~~"}
    for c in (0, 1):
        for u in (None, "stonework", "vilelypure"):
            assert sum(probability(c, u, v) for v in known) + sum(probability(c, u, v) for v in never) == pytest.approx(1, abs=1e-6)
    assert toxicity.fit_models(scratch, labelled.limit(0), strengths)[0].count() == 0


def test_toxicity_joins_a_model_that_is_too_large_to_send(spark):
    rows = [(i, f"plain words here {'vile rotten' if i % 2 else 'kind'} {i}", "en", "a", 1) for i in range(300)] + [(7, None, None, None, None), (8, "x " * 5000, "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    sent, joined = (sorted(toxicity.score_toxicity(spark, docs, labels, broadcast_model=n, keep=("doc_id", "n_chars")).collect(), key=str) for n in (10**6, 0))
    assert [(r.doc_id, pytest.approx(r.score, abs=1e-5), r.predicted) for r in sent] == [(r.doc_id, r.score, r.predicted) for r in joined]
    assert len(sent) == len(rows) and all(r.predicted == r.doc_id % 2 for r in sent if r.doc_id > 8 and r.held_out)


def test_toxicity_counts_all_but_the_rows_that_calibrate(spark, monkeypatch):
    counted = []
    fit = toxicity.fit_models
    monkeypatch.setattr(toxicity, "fit_models", lambda scratch, labelled, strengths: (counted.append(labelled.count()), fit(scratch, labelled, strengths))[1])
    docs = spark.createDataFrame([(i, f"plain words here {'vile' if i % 2 else 'kind'}", "en", "a", 1) for i in range(1200)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1200)], "doc_id long, toxic int")
    toxicity.score_toxicity(spark, docs, labels, calibration_rows=20)
    training = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(1200))
    assert training - 60 <= counted[0] < training


def test_toxicity_of_repeated_rows_labels_and_very_long_texts(spark):
    rows = [(i, f"plain words here {'vile rotten' if i % 2 else 'kind'} {i}", "en", "a", 1) for i in range(300)]
    rows += [(5, "plain words here kind", "en", "a", 1), (5, "plain words here kind", "en", "a", 1), (900, "plain " * 200_000 + "vile rotten", "en", "a", 1), (None, "vile rotten", "en", "a", 1)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(4, 1), (4, None)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(spark, spark.createDataFrame(rows, DOCS), labels, keep=("doc_id", "text")).collect()
    assert len(out) == len(rows) and len({r.score for r in out if r.text == "plain words here kind"}) == 1
    assert all(0 <= r.score <= 1 for r in out) and next(r for r in out if r.doc_id is None).held_out


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_toxicity(spark, corpus(spark), none).collect()} == {0.5}
    assert toxicity.score_toxicity(spark, empty(spark), none).count() == 0


# 3: token trees


@pytest.fixture(scope="module")
def counter():
    import public_tokenizers

    return token_trees.PieceCounter(token_trees.ranks_path(), public_tokenizers.PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab  \n\t's.É1中'l", max_size=300), st.lists(st.tuples(st.integers(0, 320), st.integers(0, 60), st.text(alphabet="a 's\n.1", max_size=30)), max_size=4))
def test_tree_follows_edits(counter, text, edits):
    tree = token_trees.TokenTree.build(text, counter, leaf=4)
    for at, removed, inserted in edits:
        text = text[:at] + inserted + text[min(len(text), at) + removed :] if at <= len(text) else text + inserted
        tree.edit(at, removed, inserted, counter, leaf=4)
        assert "".join(tree.leaves) == text and tree.leaf_sums()[0].tolist() == list(map(len, tree.leaves))
        assert tree.total == len(counter.encoding.encode_ordinary(text)) and tree.chars[1] == len(text)


def edited(text, edits):
    for at, removed, inserted in edits:
        at = min(at, len(text))
        text = text[:at] + inserted + text[at + removed :]
    return text


def test_three_batches_of_edits_on_stored_trees(spark, counter):
    rng = random.Random(6)
    texts = {r.doc_id: r.text or "" for r in corpus(spark).where("doc_id is not null").collect()}
    trees = token_trees.build_trees(corpus(spark).where("doc_id is not null").dropDuplicates(["doc_id"]))
    scratch = Scratch(spark)
    for version in range(1, 4):
        trees = scratch.cut(trees.select("doc_id", *token_trees.TREE))
        batch = {d: [(rng.randrange(len(t) + 40), rng.randrange(30), words(rng, rng.randrange(3))) for _ in range(rng.randrange(1, 4))] for d, t in texts.items() if d % 3 != version % 3}
        rows = [(d, k, *e) for d, own in batch.items() for k, e in enumerate(own)]
        edits = spark.createDataFrame(rows, "doc_id long, ordinal long, at long, removed long, inserted string")
        before = {d: len(counter.encoding.encode_ordinary(t)) for d, t in texts.items()}
        trees = token_trees.apply_edits(token_trees.with_edits(trees, edits))
        texts |= {d: edited(texts[d], own) for d, own in batch.items()}
        for r in trees.withColumn("text", token_trees.text_of()).collect():
            assert r.text == texts[r.doc_id] and r.tokens_before == before[r.doc_id]
            assert r.n_tokens == len(counter.encoding.encode_ordinary(r.text)) == sum(r.leaf_tokens)
            assert (r.reencoded > 0) == (r.doc_id in batch) or not r.text
            assert r.doc_id != 103 or r.reencoded < 0.05 * 3 * len(counter.pattern.findall(r.text))
    assert {r.version for r in trees.collect()} <= {1, 2, 3}


def test_reencoded_counts_all_that_is_encoded(counter):
    asked = []
    tree = token_trees.TokenTree.build(words(random.Random(1), 500), counter)
    plain = counter.counts
    counter.counts = lambda pieces: asked.append(len(pieces)) or plain(pieces)
    try:
        n = tree.edit(300, 5, words(random.Random(2), 6000), counter)
        n += tree.edit(40, 0, "x", counter)
    finally:
        del counter.counts
    assert n == sum(asked) and asked[1] < 200


def test_trees_of_edge_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (2, " "), (None, "a b")], "doc_id long, text string").withColumn("leaves", F.lit("mine")).withColumn("version", F.lit("mine"))
    trees = token_trees.build_trees(docs)
    assert sorted((str(r.doc_id), r.n_tokens, r.version) for r in trees.collect()) == [("1", 0, 0), ("1", 0, 0), ("2", 1, 0), ("None", 2, 0)]
    none = F.lit(None).cast(token_trees.EDIT)
    assert {r.version for r in token_trees.apply_edits(trees.withColumn("edits", none)).collect()} == {0}
    partly = F.array(F.struct(F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("removed"), F.lit(None).cast("string").alias("inserted")), F.lit(None).cast("struct<at:long,removed:long,inserted:string>"))
    assert sorted(r.n_tokens for r in token_trees.apply_edits(trees.withColumn("edits", partly)).collect()) == [0, 0, 1, 2]
    assert token_trees.apply_edits(token_trees.build_trees(docs.limit(0)).withColumn("edits", none)).count() == 0


# 4: quality


def counted(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), lines, len(covered)


def test_quality_counts(spark):
    extra = [(200, "a b c a b c\n a b c\n a b c\n\n\n#|x ü", "en", "a", 1), (201, "x x x x x", "en", "a", 1), (202, "one two", "en", "a", 1)]
    docs = corpus(spark, extra)
    got = quality.quality_verdicts(spark, docs).collect()
    want = sorted((str(i), *counted(t)) for i, t in text_of(docs.collect()))
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality.quality_verdicts(spark, empty(spark)).count() == 0


def test_quality_rejects_outliers_only(spark):
    rng = random.Random(3)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    rows = [(i, fresh(rng.randrange(60, 400)), "en", "a" if i % 3 else None, 1) for i in range(400)]
    rows += [(1000 + i, " ".join(f"{w} || ## <>" for w in fresh(100).split()), "en", "a", 1) for i in range(20)]
    out = {r.doc_id: r.kept for r in quality.quality_verdicts(spark, spark.createDataFrame(rows, DOCS)).collect()}
    assert sum(out[i] for i in range(400)) >= 399
    assert not any(out[1000 + i] for i in range(20))


def plain_mcd(x, h=0.75, starts=60, seed=0):
    """Least log determinant, mean and covariance by concentration steps from random starts, and nothing else."""
    rng, best = np.random.default_rng(seed), None
    size = int(np.ceil(h * len(x)))
    for _ in range(starts):
        inside = rng.permutation(len(x))[: x.shape[1] + 1 + rng.integers(size)]
        for _ in range(50):
            mean, cov = x[inside].mean(axis=0), np.cov(x[inside].T, bias=True)
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            following = np.sort(np.argsort(d)[:size])
            if len(following) == len(inside) and (following == np.sort(inside)).all():
                break
            inside = following
        logdet = np.linalg.slogdet(cov)[1]
        if best is None or logdet < best[0]:
            best = logdet, mean, cov
    return best


def test_concentration_equals_plain_estimates(spark):
    rng = np.random.default_rng(5)
    mixing = rng.normal(size=(5, 5)) * 2
    clouds = {
        "far": np.vstack([rng.normal(0, 1, (300, 5)), rng.normal(12, 0.3, (80, 5))]),
        "correlated": np.vstack([rng.normal(0, 1, (300, 5)) @ mixing, rng.normal(0, 1, (70, 5)) * 0.7 + 9]),
        "clean": rng.normal(0, 1, (200, 5)) * [2, 3, 4, 5, 6],
    }
    rows = spark.createDataFrame([(g, *map(float, v)) for g, x in clouds.items() for v in x], "group string, " + ", ".join(f"{c} double" for c in quality.NAMES))
    found = {r.group: r for r in quality.covariance_estimates(Scratch(spark), rows, accuracy=100_000).collect()}
    for g, x in clouds.items():
        logdet, mean, cov = plain_mcd(x)
        own = np.array([found[g][f"m{i}"] for i in range(5)])
        factor = np.array([[found[g][f"l{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
        assert found[g].logdet <= logdet + 0.05
        d = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        ours, plain = d(own, factor @ factor.T), d(mean, cov)
        far = lambda v: v / np.median(v) * quality.CHI2_MEDIAN > 80
        assert (far(ours) == far(plain)).mean() > 0.99


def test_statistics_that_do_not_vary_have_their_least_variance(spark):
    rows = spark.createDataFrame([("g", 1.0, 2.0, float(i % 7), 0.0, 0.0) for i in range(90)], "group string, " + ", ".join(f"{c} double" for c in quality.NAMES))
    estimate = quality.covariance_estimates(Scratch(spark), rows).first()
    assert [estimate[f"l{i}{i}"] for i in (0, 1, 3, 4)] == [quality.FEATURES[quality.NAMES[i]] for i in (0, 1, 3, 4)] and estimate.l22 > 1


# 5: suffix dedup


def without_repeats(texts):
    """Of (doc_id, bytes) in order: what is left, and the removed runs, one a row."""
    seen, out = set(), []
    for doc, b in texts:
        gone = bytearray(len(b))
        for j in range(len(b) - 99):
            if b[j : j + 100] in seen:
                gone[j : j + 100] = b"\1" * 100
            seen.add(b[j : j + 100])
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((doc, len(b), len(b) - len(kept), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def planted(seed):
    rng = random.Random(seed)
    passages = [words(rng, 40) + " é 中" for _ in range(4)]
    rows = []
    for i in range(60):
        text = words(rng, rng.randrange(0, 60))
        for p in rng.sample(passages, rng.randrange(3)):
            at = rng.randrange(len(text) + 1)
            text = text[:at] + p[rng.randrange(20) :] + text[at:]
        rows.append((i, text, "en", "a", 1))
    rows += [(100 + i, rows[i][1], "en", "a", 1) for i in range(8)]
    return rows + [(200, "ab" * 300, "en", "a", 1), (201, "ab" * 200, "en", "a", 1), (202, "x" * 99, "en", "a", 1), (203, "x" * 100, "en", "a", 1), (204, "x" * 250, "en", "a", 1), (205, "\0" * 220, "en", "a", 1), (206, None, "en", "a", 1)]


def removed(spark, rows, **sizes):
    out = suffix_dedup.remove_repeats(spark, spark.createDataFrame(rows, DOCS).repartition(5), **sizes)
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect())


def in_order(rows):
    """(doc_id, bytes); rows of one doc_id by the SHA-256 of their texts."""
    encoded = [(r[0], (r[1] or "").encode()) for r in rows]
    return sorted(encoded, key=lambda x: (x[0], hashlib.sha256(x[1]).hexdigest()))


@pytest.mark.parametrize(("seed", "hot"), [(1, 20_000), (2, 3), (3, 0)])
def test_suffix_dedup_equals_brute_force(spark, seed, hot):
    rows = planted(seed)
    assert removed(spark, rows, run_size=70, bin_size=40, hot_size=hot) == without_repeats(in_order(rows))


def test_suffix_dedup_of_repeated_ids(spark):
    rows = planted(4)
    shared = rows[0][1] + " and what follows " * 20
    rows += [(2, shared, "en", "a", 1), (2, shared[:-30] + "x" * 60, "en", "a", 1), (1, shared, "en", "a", 1), (300, None, "en", "a", 1), (300, shared, "en", "a", 1)]
    assert removed(spark, rows, run_size=70, bin_size=40) == without_repeats(in_order(rows))


def test_suffix_dedup_of_one_phrase_in_many_surroundings(spark):
    rng = random.Random(8)
    phrase = "whereas it has been agreed between the parties that "
    rows = [(i, words(rng, 30) + " " + phrase + words(rng, 30), "en", "a", 1) for i in range(120)] + [(200 + i, "start " + phrase * 4, "en", "a", 1) for i in range(6)]
    for hot in (0, 5, 20_000):
        assert removed(spark, rows, run_size=90, bin_size=50, hot_size=hot) == without_repeats(in_order(rows))


def test_suffix_dedup_of_long_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 700)
    rows = planted(5)
    held = {}
    for _, raw, firsts, starts in suffix_dedup._parts([(r[1] or "").encode() for r in rows]):
        _, text, start, _, count = suffix_dedup.find_tiles(raw, firsts, starts)
        held[len(held)] = int(count.sum())
    assert sum(held.values()) >= sum(max(0, len((r[1] or "").encode()) - 99) for r in rows)


def test_suffix_dedup_edges(spark):
    out = suffix_dedup.remove_repeats(spark, corpus(spark)).collect()
    assert len(out) == corpus(spark).count()
    twice = sorted(r.n_removed for r in out if r.doc_id == 0)
    assert twice == [0, max(r.n_bytes for r in out if r.doc_id == 0)] or max(r.n_bytes for r in out if r.doc_id == 0) < 100
    assert [r.n_removed for r in out if r.doc_id is None] == [0]
    assert suffix_dedup.remove_repeats(spark, empty(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=12), max_size=12), min_size=1, max_size=6))
def test_loser_tree_merges_front_coded_runs(runs):
    coded = [suffix_dedup.decode(*suffix_dedup.front_code(sorted(r))) if r else iter(()) for r in runs]
    got = list(suffix_dedup.merge_runs(coded))
    assert [k for _, k, _ in got] == sorted(k for r in runs for k in r)
    before = b""
    for shared, key, _ in got:
        assert key[:shared] == before[:shared] and (shared == min(len(key), len(before)) or key[shared] != before[shared])
        before = key


# 6: packing


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    docs = corpus(spark)
    pieces = packing.pack_documents(spark, docs, capacity=256).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = sorted(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for _, t in text_of(docs.collect()))
    by_place = sorted(pieces, key=lambda r: (r.sequence_id, r.offset))
    position, whole, current = 0, [], []
    for r in by_place:
        ids = np.frombuffer(r.ids, dtype="<u2")
        assert r.sequence_id * 256 + r.offset == position and len(ids) == r.length and r.offset + r.length <= 256
        assert zlib.crc32(ids.astype("<u4").tobytes()) == r.ids_crc32
        assert r.start == len(current)
        current += ids.tolist()
        position += r.length
        if len(current) == r.doc_tokens:
            whole.append(tuple(current))
            current = []
    assert sorted(whole) == want and not current
    assert packing.pack_documents(spark, empty(spark)).count() == 0


def test_packing_of_repeated_ids_and_long_texts(spark):
    rows = [(1, "a b c"), (1, "d e"), (1, "a b c"), (2, "word " * 9000), (None, "f")]
    pieces = packing.pack_documents(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = sorted((str(d), len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for d, t in rows)
    assert sorted((str(r.doc_id), r.doc_tokens) for r in pieces if r.start == 0) == want
    assert sum(r.length for r in pieces) == sum(n for _, n in want) and max(r.offset + r.length for r in pieces) <= 4096


def test_hilbert_key_walks_to_neighbours():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    order = np.argsort(packing.hilbert_key(side, 3))
    assert (np.abs(np.diff(side[order], axis=0)).sum(axis=1) == 1).all()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abZ.,;:!?'’ \n\t0129ÀéßİΣσςǰ̌K한가中ǅﬁ½²_- 　😀", max_size=60))
def test_word_encoder_equals_the_tokenizer(text):
    encoder = packing.worker_encoder(packing.tokenizer_path())
    assert encoder.encode([text], 2)[0] == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids + [2], dtype="<u2").tobytes()


# 7: embeddings


@pytest.mark.parametrize("whole", [0, 1024])
def test_near_vectors_equal_brute_force(spark, whole):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 32))
    near = base[:60] + rng.normal(size=(60, 32)) * 0.12
    rows = [(i, x.tolist()) for i, x in enumerate(np.vstack([base, near, base[:5], base[7:8] * 3]))]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 32), (n + 2, [float("nan")] * 32), (n + 3, [None] * 32), (n + 4, [1.0, 2.0]), (n + 5, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("mine")).withColumn("k1", F.lit("mine"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(spark, df, whole=whole).collect()}
    x = np.array([r[1] for r in rows[:n]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in np.flatnonzero(linked[i]))]) for i in range(n)]
    want = {i: (int(linked[i].sum()), label[i], label[i] == i) for i in range(n)} | {i: (0, i, True) for i in range(n, n + 6)}
    assert sum(got[i] == want[i] for i in want) / len(want) >= (1 if whole else 0.97)
    assert all(got[i] == want[i] for i in range(n, n + 6))
    assert embeddings.near_vectors(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("common", [0.0, 0.5, 0.7])
def test_near_vectors_that_share_a_direction(common):
    rng = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    direction = unit(rng.normal(size=64))
    x = unit(np.sqrt(common) * direction + np.sqrt(1 - common) * unit(rng.normal(size=(20_000, 64))))
    near, other = x[:3000], unit(rng.normal(size=(3000, 64)))
    other = unit(other - (other @ direction)[:, None] * direction)
    other = unit(other - (other * near).sum(axis=1, keepdims=True) * near)
    y = 0.905 * near + np.sqrt(1 - 0.905**2) * other
    tables, mean, rotations, most = embeddings.plan_for(x[:10_000], 20_000, 0.9, 0.995, 0.1)
    length = tables.length
    assert len(rotations) * (64 // length) <= 200
    a, b = embeddings._codes(near, mean, rotations), embeddings._codes(y, mean, rotations)
    same = (a == b)[:, :, : 64 // length * length].reshape(3000, -1, length).all(axis=2).any(axis=1)
    close = (a != b)[:, : embeddings.CUT_ROTATIONS].sum(axis=(1, 2)) <= most
    assert (same & close).mean() >= 0.99


def test_near_vectors_of_any_length_and_scale(spark):
    rows = [(0, [1.0] * 8), (1, [2.0] * 8), (2, [1.0, 2.0]), (3, [1.0, 2.1]), (4, [-1.0, 2.0]), (5, [3.0]), (6, [9.0]), (7, [-1.0])]
    rows += [(10, [1e-200, 2e-200, 0.0]), (11, [1e200, 2e200, 0.0]), (12, [0.0, 0.0, 5e-324]), (13, [0.0, 0.0, 1e308]), (20, [1.0] * 16), (20, [1.0] * 15 + [0.9]), (None, [1.0] * 16)]
    out = embeddings.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in out if r.vec_id is not None)
    assert got == [(0, 1, 0), (1, 1, 0), (2, 1, 2), (3, 1, 2), (4, 0, 4), (5, 1, 5), (6, 1, 5), (7, 0, 7), (10, 1, 10), (11, 1, 10), (12, 1, 12), (13, 1, 12), (20, 1, 20), (20, 1, 20)]
    small = [(i, [float(np.cos(i)), float(np.sin(i)), 0.1]) for i in range(60)]
    out = embeddings.near_vectors(spark, spark.createDataFrame(small, "vec_id long, embedding array<double>"), whole=0).collect()
    x = np.array([r[1] for r in small])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.9).sum(axis=1) - 1
    assert np.mean([r.n_links == want[r.vec_id] for r in out]) > 0.9


def test_tables_own_each_pair_once():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 2**63, size=(400, 2), dtype=np.uint64) & np.uint64(0x3F3F)
    tables = embeddings.Tables(16, 4, 2)
    i, j = next(links.pairs_within(np.array([400])))
    owners = np.zeros(len(i), dtype=int)
    shares = np.zeros(len(i), dtype=bool)
    for k in range(tables.n):
        same = tables.keys(codes[i], k) == tables.keys(codes[j], k)
        owners += same & tables.owned(codes[i] ^ codes[j], np.full(len(i), k))
        shares |= same
    assert (owners == shares).all()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 7), min_size=1, max_size=12), st.integers(1, 9))
def test_pairs_within_groups(sizes, most):
    got = sorted((int(a), int(b)) for i, j in links.pairs_within(np.array(sizes), most) for a, b in zip(i, j, strict=True))
    starts = np.cumsum([0, *sizes])
    assert got == sorted((a, b) for s, n in zip(starts, sizes) for a in range(s, s + n) for b in range(a + 1, s + n))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_forest_joins(edges):
    forest, label = links.Forest(31), list(range(31))
    for part in (edges[::2], edges[1::2]):
        forest.join(np.array([a for a, _ in part], dtype=int), np.array([b for _, b in part], dtype=int))
    for _ in range(31):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    roots = forest.roots(np.arange(31))
    assert all((roots[a] == roots[b]) == (label[a] == label[b]) for a in range(31) for b in range(31))


def test_hot_groups_are_dealt_in_blocks(spark):
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 100), (2, 101), (3, 200)], "key long, id long")
    dealt = links.deal_blocks(Scratch(spark), rows, 8).collect()
    assert max(sum((r.key, r.lo, r.hi) == k for r in dealt) for k in {(r.key, r.lo, r.hi) for r in dealt}) < 40
    met = set()
    for k in {(r.key, r.lo, r.hi) for r in dealt}:
        own = [r for r in dealt if (r.key, r.lo, r.hi) == k]
        met |= {(a.id, b.id) for a in own for b in own if a.id < b.id and (k[1] == k[2] or a.second != b.second)}
    assert {p for p in met if p[1] < 100} == {(a, b) for a in range(50) for b in range(a + 1, 50)} and (100, 101) in met


def test_rotations_are_orthogonal_and_balanced():
    sample = np.random.default_rng(1).normal(size=(2000, 16)) + 3
    mean, rotations = embeddings.learn_rotations(sample, 2)
    for r in rotations:
        assert np.allclose(r.T @ r, np.eye(16), atol=1e-8)
        assert np.abs(((sample - mean) @ r >= 0).mean(axis=0) - 0.5).max() < 0.08


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 101), (None, 3), (7, 7)]
    got = {r.id: r.component for r in connected_components(Scratch(spark), spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# 8: sharding


def test_sharding_versions_and_conflicts(spark, tmp_path):
    table = sharding.ShardedTable(spark, f"file://{tmp_path}/t", target_bytes=40_000, fan_in=3, base_bytes=2_000)
    everything = []
    for k in range(7):
        part = spark.createDataFrame([(100 * k + i, words(random.Random(k * 50 + i), 40), None, "a", 1) for i in range(50)], DOCS).coalesce(1)
        everything += part.collect()
        table.append(part)
        before = table.version()
        old = sorted(map(str, table.read(before).drop("_shard").collect()))
        table.compact()
        assert sorted(map(str, table.read().drop("_shard").collect())) == old == sorted(map(str, everything))
    shards = table.manifest()["shards"]
    assert len(shards) < 7 and all(s["bytes"] <= 80_000 for s in shards)
    assert not table._runs(shards)
    held = table.manifest()
    with pytest.raises(sharding.CommitConflict):
        table._commit(table.manifest(held["version"] - 1), part.schema, [])
    assert table.manifest() == held
    table.append(empty(spark))
    assert table.read().count() == len(everything)
    assert table.vacuum() > 0 and table.read().count() == len(everything)


def test_vacuum_leaves_what_a_writer_may_still_commit(spark, tmp_path):
    table, other = (sharding.ShardedTable(spark, f"file://{tmp_path}/t") for _ in range(2))
    table.append(spark.range(5))
    run = other._begin()
    shards = other._write(run, spark.range(5, 8))
    assert table.vacuum() == 0
    other._commit(other.manifest(), spark.range(1).schema, shards)
    other._end(run)
    assert sorted(r.id for r in table.read().collect()) == list(range(8))
    lost = other._begin()
    other._write(lost, spark.range(3))
    other._end(lost)  # a writer that died between its shards and its commit
    assert table.vacuum() == 0 and sharding.ShardedTable(spark, f"file://{tmp_path}/t", grace_seconds=-5).vacuum() > 0
    assert table.read().count() == 8
    with pytest.raises(FileNotFoundError):
        table._commit(table.manifest(), spark.range(1).schema, [{"path": "data/none/part.parquet", "bytes": 1, "run": "none"}])


def test_appends_of_two_writers_both_hold(spark, tmp_path, monkeypatch):
    table, other = (sharding.ShardedTable(spark, f"file://{tmp_path}/t") for _ in range(2))
    table.append(spark.range(2))
    seen = [table.manifest(), None]
    latest = sharding.ShardedTable.manifest
    other.append(spark.range(2, 4))
    monkeypatch.setattr(sharding.ShardedTable, "manifest", lambda self, version=None: seen.pop(0) or latest(self, version) if seen and version is None else latest(self, version))
    assert table.append(spark.range(4, 6)) == 3
    assert sorted(r.id for r in table.read().collect()) == list(range(6))


def test_shards_keep_a_clashing_column(spark, tmp_path):
    table = sharding.ShardedTable(spark, f"file://{tmp_path}/t")
    table.append(spark.createDataFrame([("a", None)], "doc_id string, _shard string"))
    row = table.read().first()
    assert row["__shard"] is None and row["_shard"].startswith("data/")
    named = spark.createDataFrame([("a", "x"), (None, "y"), ("c", None)], "doc_id string, text string")
    assert sum(p.count() for p in sharding.arrivals(named, 4)) == 3


def test_arrivals_cover_all_rows(spark):
    docs = corpus(spark)
    assert sum(p.count() for p in sharding.arrivals(docs, 5)) == docs.count()
    assert sharding.arrivals(empty(spark), 3)[0].count() == 0


# 9: chats


def maximal(rows):
    chats = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        chats.setdefault(conv, []).append((role, text))
    keep = set()
    for c, turns in chats.items():
        longer = any(len(o) > len(turns) and o[: len(turns)] == turns for o in chats.values())
        same = any(o == turns and k < c for k, o in chats.items())
        if not longer and not same:
            keep.add(c)
    return keep


def test_chat_snapshots(spark):
    rng = random.Random(6)
    rows = []
    for c in range(60):
        turns = [("user" if t % 2 == 0 else "assistant", f"m{rng.randrange(2)}") for t in range(rng.randrange(1, 6))]
        rows += [(c, t * 2, role, text) for t, (role, text) in enumerate(turns)]
    rows += [(90, 0, None, None), (91, 0, "", ""), (92, None, "user", "x<|im_end|>y"), (None, 0, "user", "lost"), (93, 0, "user", "long " * 5000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit("mine")).withColumn("block", F.lit("mine"))
    out = {r.conv_id: r for r in chat.render_chats(chat.collapse_snapshots(spark, turns, block=3)).collect()}
    assert set(out) == maximal(rows)
    assert "< |im_end|>" in out[92].chat and out[92].chat.count("<|im_end|>") == 1
    assert chat.render_chats(chat.collapse_snapshots(spark, turns.limit(0))).count() == 0


def test_a_repeated_turn_is_a_turn_of_its_own(spark):
    rows = [(1, 1, "user", "a"), (1, 1, "user", "a"), (2, 1, "user", "a"), (3, 5, "user", "a"), (3, 7, "user", "a")]
    out = chat.render_chats(chat.collapse_snapshots(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert [(r.conv_id, r.n_turns) for r in out] == [(1, 2)]


def test_chat_plan_has_few_exchanges(spark):
    df = chat.op9_chat_snapshots(spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") < 20


# 10: n-gram Jaccard join


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_join_equals_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(3, 90))]
        for _ in range(rng.randrange(1, 7)):
            near = list(base)
            for _ in range(rng.randrange(0, 3)):
                near[rng.randrange(len(near))] = f"w{rng.randrange(3000)}"
            rows.append((len(rows), " ".join(near), "en", "a", 1))
    hot = [f"h{k}" for k in range(200)]
    for k in range(150):
        near = list(hot)
        near[rng.randrange(200)] = f"z{k % 40}"
        rows.append((len(rows), " ".join(near), "en", "a", 1))
    rows += [(9000, None, "en", "a", 1), (9001, " ", "en", "a", 1), (9002, "one two", "en", "a", 1), (9003, "one  two", "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("id", F.lit("mine")).withColumn("path", F.lit("mine"))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_join(spark, docs, bucket=16).collect()}
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    links = {a: {b for b in sets if b != a and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])} for a in sets}
    label = {a: a for a in sets}
    for _ in range(20):
        label = {a: min([label[a], *(label[b] for b in links[a])]) for a in sets}
    assert got == {a: (label[a], len(links[a])) for a in sets}


def test_jaccard_runs_are_planned_for_all_levels(spark, monkeypatch):
    planned = []
    plain = jaccard.choose_paths
    monkeypatch.setattr(jaccard, "choose_paths", lambda rows, similarity, runs: planned.append(runs) or plain(rows, similarity, runs))
    jaccard.jaccard_join(spark, corpus(spark)).count()
    meets = 1.0
    for _ in range(3):
        meets = 1 - np.exp(-meets)
    assert (1 - meets) ** planned[0] <= 1 - 0.9999


def test_jaccard_of_repeated_ids_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(6000))
    rows = [(1, "a b c d e f g"), (1, "p q r s t u v"), (2, "p q r s t u v"), (3, long), (4, long + " tail"), (1, "a b c d e f g"), (5, "x")]
    out = jaccard.jaccard_join(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in out) == [(1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 3, 1), (4, 3, 1), (5, 5, 0)]


def test_jaccard_edges(spark):
    out = jaccard.jaccard_join(spark, corpus(spark)).collect()
    assert len(out) == corpus(spark).count()
    same = {r.doc_id: r for r in out}
    assert same[3].class_id == same[104].class_id == 3 and same[100].n_links == 0 and same[101].n_links == 0
    assert [r.class_id for r in out if r.doc_id is None] == [None]
    assert jaccard.jaccard_join(spark, empty(spark)).count() == 0


# 12: Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows):
    """The contract, told plainly: lists of digests, runs of three, proofs and folds by hand."""
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    hashed = lambda r, text: sha("".join(map(show, (r.doc_id, r.source, r.lang, r.n_chars, text))))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    def path(tree, at):
        for level in tree[:-1]:
            start = at - at % 3
            yield "".join(level[start:at]), "".join(level[at + 1 : start + 3])
            at //= 3

    by_source = {}
    for r in rows:
        cut = r.text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
        leaf = hashed(r, r.text)
        by_source.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf, hashed(r, r.text.replace("\n", "")) if cut else leaf))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([row[2] for row in sorted(by_source[s])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    for i, s in enumerate(names):
        for at, (known, doc_id, leaf, folded) in enumerate(sorted(by_source[s])):
            proof = ""
            for a, b in [*path(trees[s], at), *path(top, i)]:
                proof, folded = proof + a + b, sha(a + folded + b)
            yield doc_id if known else None, leaf, trees[s][-1][0], top[-1][0], sha(proof), folded, folded == top[-1][0]


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_equals_plain_lists(spark, monkeypatch, levels):
    """Buckets of 3, 9 and 2187 leaves, so that trees of several levels of buckets occur; odd rows and clashing columns."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BUCKET", merkle.RUN**levels)
    docs = corpus(spark, extra=[(i, f"line {i}\nnext {i}\n", "en", "hot", i) for i in range(200, 290)] + [(7, "x\n", "en", "", 1), (8, "x\ny", "en", f"{'s' * 9}", 1)])
    for name in ("pos", "bucket", "digest", "leaf", "place", "depth", "tampered", "row_index"):
        docs = docs.withColumn(name, F.lit("mine"))
    got = [tuple(r) for r in merkle.merkle_manifest(spark, docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_manifest(docs.collect())))
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_nothing_and_of_one(spark):
    assert merkle.merkle_manifest(spark, empty(spark)).count() == 0
    one = spark.createDataFrame([(4, None, None, None, None)], DOCS)
    row = merkle.merkle_manifest(spark, one).first()
    assert row.leaf == row.subroot == row.root == row.folded_root == sha("1:4----") and row.proof_sha256 == sha("") and row.verified


# 11: main text

PAGES = "page_id long, url string, html string"


def site(rng, host, n, template):
    """Pages of one host with the text that each must give."""
    for i in range(n):
        paragraphs = [f"{words(rng, rng.randrange(8, 60))} & <{i}>" for _ in range(rng.randrange(1, 6))]
        marked = "".join(f"<p>{html.escape(p)}</p>" if rng.random() < 0.7 else f"<p>{html.escape(p).replace(' ', chr(10) + ' ', 1)}" for p in paragraphs)
        yield f"https://{host}/{i}?q", template(rng, i, marked), "\n\n".join(paragraphs)


def labelled(rng, i, text):
    menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in WORDS)
    return (
        f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body class='has-sidebar'><header><h1>Site</h1></header><nav><ul>{menu}</ul></nav>"
        f"<div class='cookie-notice'><p>We use cookies, and this sentence about them is a long one.</p></div><div id='main'><div class='post post-{i}'>{text}<div class='ad'>Buy {i}</div><!-- x --></div>"
        f"<aside><p>{words(rng, 90)}</p></aside><form><p>Write to us about what you would like to read here</p></form><div id='comments'><p>{words(rng, 150)}</p></div></div><footer>end"
    )


def unlabelled(rng, i, text):
    """Names that say nothing; some pages have comments that are longer than the text; one box repeats within it."""
    comments = "".join(f"<div class='k{j}'><p>{words(rng, 40)}</p></div>" for j in range(rng.choice([0, 0, 0, 2, 9])))
    return f"<body><div class='z1'>{'<a href=/>x</a> ' * 9}</div><div class='z9'><div class='q7'>{text}<div class='w2'>Follow this and that site for more of it</div></div><div class='v3'>{comments}</div></div></body>"


def plain_article(rng, i, text):
    return f"<html><body><main><article>{text}</article><section class='comments'><article class='comment'><p>{words(rng, 80)}</p></article></section></main></body></html>"


def test_main_text_of_hosts(spark):
    rng = random.Random(4)
    rows = [r for host, n, t in (("a.example", 40, labelled), ("b.example:80", 60, unlabelled), ("C.example", 9, plain_article)) for r in site(rng, host, n, t)]
    df = spark.createDataFrame([(i, url, page) for i, (url, page, _) in enumerate(rows)], PAGES)
    for name in ("host", "path", "share", "winners", "furniture", "text", "n_chars"):
        df = df.withColumn(name, F.lit("mine"))
    got = {r.page_id: r for r in main_text.main_text(spark, df).collect()}
    assert {i: got[i].text for i in got} == {i: text for i, (_, _, text) in enumerate(rows)}
    assert all(r.n_chars == len(r.text) and r.url == rows[i][0] for i, r in got.items())


def test_main_text_of_odd_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    cases = [
        (None, None, ""), ("x", "", ""), (None, "only text &amp; more", "only text & more"), ("http://h/", "<p>one<p>two<br>three", "one\n\ntwo three"), ("http://h/", None, ""), ("http://i/", deep, "deep"),
        ("http://[", "<body><p>a <b>b</i> c</p></div> d", "a b c\n\nd"), ("http://j/", "<body><script>never closed", ""), ("http://j/", "<body><article>x" + " long" * 100_000, "x" + " long" * 100_000), ("http://k/", "<p title=don't>a < b</p><p>1<2", "a < b\n\n1<2"),
    ]
    df = spark.createDataFrame([(i, url, page) for i, (url, page, _) in enumerate(cases)] * 2, PAGES)
    got = main_text.main_text(spark, df).collect()
    assert sorted((r.page_id, r.text) for r in got) == sorted((i, text) for i, (_, _, text) in enumerate(cases) for _ in range(2))
    assert main_text.main_text(spark, spark.createDataFrame([], PAGES)).count() == 0


# 13: conversation repair

TURNS = "conv_id long, turn long, role string, text string"


def every_repair(letters):
    """All edits with up to two insertions between rows, their cost and roles: the contract, by trying."""
    ways = []
    for letter in letters:
        extra = 3 if letter.isupper() else 0
        edits = [("D", 4, "")]
        if letter != "d":
            edits += [("K", extra, letter.lower()), ("R", 3 + extra, "u"), ("R", 3 + extra, "a")]
        ways += [[("", 0, ""), *[("I" * k, 3 * k, r) for k in (1, 2) for r in map("".join, itertools.product("ua", repeat=k))]], edits]
    ways.append(ways[0] if ways else [("", 0, "")])
    for way in itertools.product(*ways):
        if re.fullmatch("(s?(ua)+)?", "".join(r for _, _, r in way)):
            yield sum(c for _, c, _ in way), "".join(e for e, _, _ in way)


@settings(max_examples=60, deadline=None)
@given(st.text("suaxdSUAX", max_size=3))
def test_cheapest_repair_by_trying(letters):
    assert turn_repair.Solver().solve(letters) == min(every_repair(letters))


@settings(max_examples=100, deadline=None)
@given(st.text("suaxdSUAX", max_size=90))
def test_halves_equal_steps(letters):
    """The recursion over halves against one over rows, for signatures too long to try all."""
    best = {0: (0, "")}
    for letter in letters:
        step = {}
        for (start, end), (cost, edits) in turn_repair.one_letter(letter).items():
            if start in best:
                way = (best[start][0] + cost, best[start][1] + edits)
                step[end] = min(step.get(end, way), way)
        best = step
    ends = {0: "", 1: "II", 2: "I", 3: ""}
    assert turn_repair.Solver().solve(letters) == min((c + 3 * len(ends[s]), e + ends[s]) for s, (c, e) in best.items())


def plain_repair(turns):
    """conv_id to its row, told plainly."""
    rows = {}
    for conv, turn, role, text in turns:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows.setdefault(conv, []).extend([(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1))
    for conv, own in rows.items():
        letters, seen, faults, own = "", set(), {"blank": 0, "duplicate": 0, "truncated": 0}, sorted(own)
        for _, _, role, text in own:
            said = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            letter = role[:1] if role[:1] and role[:1] in "sua" else "x"
            letters += "d" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        cost, audit = turn_repair.Solver().solve(letters)
        said, rest, state = [], list(own), "start"
        for edit in audit:
            _, _, role, text = rest.pop(0) if edit != "I" else (None, None, None, "")
            if edit == "D":
                continue
            role = role if edit == "K" else "assistant" if state == "u" else "user"
            state = role[0]
            said.append(f"{role}:{text}")
        assert not rest and re.fullmatch("(s?(ua)+)?", "".join(s[0] for s in said))
        turns_known = [t for known, t, _, _ in own if known]
        gaps = max(turns_known) - min(turns_known) + 1 - len(set(turns_known)) if turns_known else 0
        initials = [role[:1] for _, _, role, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        yield conv, gaps, *faults.values(), illegal, cost, audit, sha("\n".join(said))


def test_repair_equals_plain_loops(spark):
    """Short and long conversations, one with most rows, nulls, repeated rows and turns, other roles, clashing columns."""
    rng = random.Random(8)
    says = ["Yes.", "No!", "Well", " \n", "", None, "Why?  ", "So be it.\n", "ä ö."]
    roles = ["user", "assistant", "user", "assistant", "system", "bot", "", None, "User"]
    turns = [(c, rng.choice([t, t, t, t + 2, None]), rng.choice(roles), rng.choice(says)) for c in range(60) for t in range(rng.randrange(1, 9))]
    turns += [(1000, t, ("user", "assistant")[t % 2] if t % 7 else "system", rng.choice(says) or f"{t}.") for t in range(1500)]
    turns += [(None, t, "user", f"no id {t}.") for t in range(5)] + [(77, 1, "user", "Again.")] * 40
    dropped = next(c for c in range(2000, 3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    turns += [(dropped, 0, "user", "Gone.")]
    df = spark.createDataFrame(turns, TURNS).repartition(5)
    for name in ("key", "copies", "kind", "letters", "range", "due", "print", "first", "head", "audit"):
        df = df.withColumn(name, F.lit("mine"))
    got = [tuple(r) for r in turn_repair.repair_conversations(spark, df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_repair(turns)))
    assert (dropped, 0, 0, 0, 0, 0, 0, "", sha("")) in got
    assert turn_repair.repair_conversations(spark, spark.createDataFrame([], TURNS)).count() == 0


# 7 and 8: links through the query itself, and tables whose arrivals differ


def test_planted_links_through_the_query(spark, tmp_path):
    """Isolated pairs at and above the threshold, pairs below it, and a hot group of equal and of near vectors, by the dealt method at every size."""
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x)

    def near(x, cosine):
        other = unit(rng.normal(size=64))
        return cosine * x + np.sqrt(1 - cosine**2) * unit(other - (other @ x) * x)

    rows, links = [], 0
    for k in range(400):
        x = unit(rng.normal(size=64))
        cosine = [0.905, 0.93, 0.97, 0.85][k % 4]
        rows += [x, near(x, cosine)]
        links += cosine > 0.9
    hot = unit(rng.normal(size=64))
    rows += [hot] * 150 + [near(hot, 0.99) for _ in range(150)]
    table = spark.createDataFrame([(i, [float(v) for v in x], i % 3) for i, x in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in embeddings.op7_embedding_dedup(spark, str(tmp_path)).collect()}
    x = np.array(rows)
    want = x @ x.T >= 0.9
    np.fill_diagonal(want, False)
    found = sum(r.n_links for r in got.values())
    assert found <= want.sum() and found >= 0.99 * want.sum()
    isolated = sum(got[i].n_links == 1 for i in range(800) if want[i].sum() == 1)
    assert isolated >= 0.99 * 2 * links and all(got[i].n_links == 0 for i in range(800) if not want[i].any())
    assert len({got[i].component_id for i in range(800, 1100)}) == 1


def test_a_column_that_an_arrival_lacks_keeps_its_values(spark, tmp_path):
    table = sharding.ShardedTable(spark, f"{tmp_path}/t", fan_in=2)
    with_note = lambda low: spark.range(low, low + 4).selectExpr("id AS doc_id", "concat('n', id) AS note")
    without = spark.range(100, 104).selectExpr("id AS doc_id", "id * 2 AS more")
    for rows in (with_note(0), with_note(10), without, with_note(20)):
        table.append(rows)
        table.compact()
        table.vacuum()
    got = {r.doc_id: (r.note, r.more) for r in table.read().collect()}
    assert got == {**{k: (f"n{k}", None) for low in (0, 10, 20) for k in range(low, low + 4)}, **{k: (None, k * 2) for k in range(100, 104)}}
    before = table.version()
    for bad in ("id AS doc_id, id AS note", "id AS DOC_ID", "cast(id AS int) AS doc_id"):
        with pytest.raises(sharding.SchemaConflict):
            table.append(spark.range(3).selectExpr(*bad.split(", ")))
    assert table.version() == before and table.read().count() == 16


@pytest.mark.parametrize("work", ["append", "compact"])
def test_a_rename_whose_answer_is_lost_is_a_commit(spark, tmp_path, monkeypatch, work):
    table = sharding.ShardedTable(spark, f"{tmp_path}/t", fan_in=2)
    for k in range(3):
        table.append(spark.range(k * 5, k * 5 + 5).selectExpr("id AS doc_id"))
    publish = sharding.ShardedTable._publish

    def lost(self, draft, final):
        publish(self, draft, final)
        raise OSError("no answer")

    monkeypatch.setattr(sharding.ShardedTable, "_publish", lost)
    table.append(spark.range(15, 20).selectExpr("id AS doc_id")) if work == "append" else table.compact()
    assert sorted(r.doc_id for r in table.read().collect()) == list(range(20 if work == "append" else 15))


def test_an_edit_reads_its_leaves_at_once(counter):
    tried = []

    class Counted:
        findall = counter.pattern.findall

        def match(self, *where):
            tried.append(where)
            return counter.pattern.match(*where)

    seen = token_trees.PieceCounter.__new__(token_trees.PieceCounter)
    seen.__dict__ |= counter.__dict__
    seen.pattern = Counted()
    tree = token_trees.TokenTree.build("some words " * 300, counter)
    assert tree.edit(1500, 16, "[redacted]", seen) > 50 and len(tried) < 10


def test_edits_run_what_makes_the_trees_once(spark, counter):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    docs = corpus(spark).select("doc_id", "text")
    texts = [r.text or "" for r in docs.collect()]
    edit = F.struct(F.lit(1).alias("at"), F.lit(2).alias("removed"), F.lit(" x").alias("inserted"))
    edits = F.when(F.col("doc_id") % 3 == 0, F.array(edit)).when(F.col("doc_id") % 3 == 1, F.array().cast(token_trees.EDIT))
    trees = token_trees.build_trees(docs.mapInArrow(counted, docs.schema)).withColumn("edits", edits)
    out = token_trees.apply_edits(trees).withColumn("text", token_trees.text_of()).collect()
    assert reads.value == len(texts) == len(out)
    ids = [r.doc_id for r in docs.collect()]
    expected = [(d, edited(t, [(1, 2, " x")]) if d is not None and d % 3 == 0 else t, int(d is not None and d % 3 == 0)) for d, t in zip(ids, texts, strict=True)]
    assert sorted(map(str, expected)) == sorted(str((r.doc_id, r.text, r.version)) for r in out)
    for r in out:
        assert r.n_tokens == sum(r.leaf_tokens) == len(counter.encoding.encode_ordinary(r.text)) and sum(r.leaf_chars) == len(r.text) and r.reencoded >= 0
        assert r.version or (r.reencoded, r.tokens_before) == (0, r.n_tokens)


def test_counts_stay_right_as_what_is_known_turns_over():
    import public_tokenizers

    small = token_trees.PieceCounter(token_trees.ranks_path(), public_tokenizers.PATTERN, room=20)
    rng = random.Random(4)
    for _ in range(60):
        text = words(rng, 12) + f" {rng.randrange(10**9)} antidisestablishment{rng.randrange(50)}"
        pieces = small.pattern.findall(text)
        assert small.counts(pieces) == [len(small.encoding.encode_ordinary(p)) for p in pieces]
        assert max(len(small.known), len(small.known.older)) <= 20 + 40 and not getattr(small.known.older, "older", None)
    small.rest()
    assert all(len(p) <= 9 for p in small.known) and not small.known.older
