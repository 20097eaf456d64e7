"""Near duplicates, neighbours, quality rules, language-model scores and the pipeline against brute force and held-out rows."""

import importlib.util
import math
import re
import shutil
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyloom.llm import ann, lm_score, quality, queries, simhash

FOLDER = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[2]


def frame(spark, rows, ddl="doc_id long, text string"):
    return spark.createDataFrame(rows, ddl)


# ---- near duplicates


def brute_print(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + n]), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_groups(prints, radius=3):
    left, groups = set(prints), {}
    while left:
        todo = [left.pop()]
        group = set(todo)
        while todo:
            x = todo.pop()
            near = {y for y in left if bin(x ^ y).count("1") <= radius}
            left -= near
            group |= near
            todo += near
        groups.update(dict.fromkeys(group, min(group)))
    return groups


def test_components_by_brute_force(spark):
    rng = np.random.default_rng(3)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    base = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"], 400))
    docs += [(1000 + i, base + f" tail{i}") for i in range(30)] + [(2000 + i, t) for i, t in enumerate(["", " \n", None, "one", "One", "one two", "é É", "a\xa0b"])]
    docs += [docs[0], (None, docs[5][1]), (None, "nobody else says this at all")]
    prints = [brute_print(t) for _, t in docs]
    groups = brute_groups(prints)
    least = {}
    for (i, _), p in zip(docs, prints, strict=True):
        if i is not None:
            least[groups[p]] = min(least.get(groups[p], i), i)
    got = Counter(tuple(r) for r in simhash.near_duplicates(frame(spark, docs)).select("doc_id", "fingerprint", "component_id").collect())
    assert got == Counter((i, f"{p:016x}", least.get(groups[p])) for (i, _), p in zip(docs, prints, strict=True))


@pytest.mark.parametrize("block", [50, 100_000])
def test_links_span_the_groups_of_dense_and_sparse_prints(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "LEAF", 64)
    rng = np.random.default_rng(5)
    center = int(rng.integers(0, 1 << 62))
    near = {center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (60, 2))}
    chain = [center ^ ((1 << 64) - (1 << k)) & (1 << 64) - 1 for k in range(64, 0, -3)]
    prints = near | set(chain) | {int(x) for x in rng.integers(0, 1 << 63, 200, dtype=np.uint64)}
    rows = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    found = {int(np.int64(r.node).astype(np.uint64)): int(np.int64(r.root).astype(np.uint64)) for r in simhash.components(simhash.links(frame(spark, rows, "fp long"), 3)).collect()}
    groups = brute_groups(prints)
    for a in prints:
        for b in prints:
            assert (groups[a] == groups[b]) == (found.get(a, a) == found.get(b, b))
    forest = simhash.links(frame(spark, rows, "fp long"), 3).count()
    assert forest < 3 * len(prints)  # never all pairs


def brute_kept(docs, n=5):
    sets = {}
    for i, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {" ".join(words[k:k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()
    left, kept = sorted(sets), []
    while left:
        kept.append(left[0])
        todo = [left.pop(0)]
        while todo:
            a = sets[todo.pop()]
            near = [i for i in left if a == sets[i] or 5 * len(a & sets[i]) >= 4 * len(a | sets[i]) > 0]
            left = [i for i in left if i not in near]
            todo += near
    return kept


@pytest.mark.parametrize(("block", "held", "leaf"), [(65_536, 8_000_000, 1 << 18), (20, 3_000, 64)])
def test_the_stage_keeps_one_of_each_group_at_a_similarity_of_four_fifths(spark, monkeypatch, block, held, leaf):
    import corpus_pipeline

    for name, value in (("BLOCK", block), ("HELD", held), ("LEAF", leaf)):
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    for family in range(12):
        base = rng.choice(vocabulary, int(rng.integers(60, 400))).tolist()
        for _ in range(6):  # some pairs just above, some just below, some only through a third
            base = [w if rng.random() > rng.choice([0.005, 0.02, 0.03]) else str(rng.choice(vocabulary)) for w in base]
            docs.append((10_000 + len(docs), " ".join(base)))
    for n in range(4, 12):  # the smallest sets that can be similar without being equal
        base = rng.choice(vocabulary, n + 4).tolist()
        docs += [(20_000 + 10 * n + i, " ".join(words)) for i, words in enumerate((base, [*base, "end"], base[:-1], [*base[:-1], "other"]))]
    docs += [(30_000, ""), (30_001, None), (30_002, "One two"), (30_003, "one  TWO"), (30_004, "one")]
    kept = corpus_pipeline.near_duplicates(spark, frame(spark, docs), FOLDER)
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(docs)


def test_one_of_each_similar_group_stays(spark):
    rows = [(5, "same text here", 1), (3, "Same text here", 2), (3, "same TEXT here", 3), (3, "third text of this key", 8), (9, "other words altogether", 4), (None, "same text here", 5), (None, "lonely row of words", 6), (None, "lonely row of words", 7)]
    kept = simhash.keep_one(frame(spark, rows, "doc_id long, text string, _sid int")).collect()
    assert sorted((r.doc_id or 0, r.text.lower()) for r in kept) == [(0, "lonely row of words"), (3, "same text here"), (3, "third text of this key"), (9, "other words altogether")]
    assert {r._sid for r in kept} <= {2, 3, 8, 4, 6, 7}
    assert simhash.keep_one(frame(spark, [])).count() == 0
    clash = frame(spark, [(1, "a b c", 5, 6), (2, "A b c", 7, 8), (3, None, 9, 9)], "doc_id long, text string, kept_key int, sid int")
    assert sorted(tuple(r) for r in simhash.keep_one(clash).collect()) == [(1, "a b c", 5, 6), (3, None, 9, 9)]


def test_a_large_group_gives_a_forest_and_long_texts_are_whole(spark):
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(300):
        own = list(base)
        for k in rng.integers(0, 400, 3):
            own[k] = f"x{i}"
        docs.append((i, " ".join(own)))
    long = " ".join(f"v{i}" for i in range(60_000))
    docs += [(900, long), (901, long + " tail"), (902, long[: len(long) // 2])]
    keyed = frame(spark, docs, "doc_key long, doc_text string")
    sets = simhash.wide_prints(keyed, 5).withColumnRenamed("doc_key", "key")
    links = simhash.similar_links(sets, keyed, 5, (4, 5), simhash.WIDE_RADIUS)
    assert 300 <= links.count() <= 4 * 303
    kept = {r.doc_id for r in simhash.keep_one(frame(spark, docs)).collect()}
    assert kept == set(brute_kept(docs)) and {900, 902} <= kept and 901 not in kept


# ---- neighbours


def brute_nearest(rows, k):
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for i, v in rows:
        if i % 100 == 0:
            distance = np.sqrt(((vectors - v) ** 2).sum(1))
            out[i] = [(ids[j], distance[j]) for j in np.lexsort((ids, distance)) if ids[j] != i][:k]
    return out


def test_recall_and_exact_scores(spark, monkeypatch):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    expected = brute_nearest(rows, 10)
    for block in (ann.BLOCK, 64 * 100):
        monkeypatch.setattr(ann, "BLOCK", block)
        monkeypatch.setattr(ann, "QUERY_BLOCK", block // 50)
        got = {}
        for r in queries.op5_neighbours(spark, "/root/testdata/sf0.01").orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got.keys() == expected.keys() and all(len(v) == 10 for v in got.values())
        assert sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in got) >= 0.9 * 10 * len(got)
        true = {(q, i): s for q in expected for i, s in brute_nearest(rows, len(rows))[q]}
        assert all(abs(true[q, i] - s) < 1e-12 for q in got for i, s in got[q])


def test_ties_unusable_vectors_and_few_candidates(spark):
    rows = [(i, [1.0, 0.0]) for i in range(100, 90, -1)] + [(200, [0.5, 0.5]), (7, None), (8, [0.0, 0.0]), (9, [1.0, None]), (10, [float("nan"), 1.0]), (11, [float("inf"), 1.0]), (300, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (100, [1.0, 0.0])]
    table = frame(spark, [(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {100: [*range(91, 100), None], 200: [*range(91, 101)]}
    few = frame(spark, [(100, [1.0]), (5, [3.0]), (4, [3.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.nearest(few, F.col("vec_id") % 100 == 0).orderBy("rank").collect()] == [(100, 1, 4, 2.0), (100, 2, 5, 2.0)]
    assert ann.nearest(few.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# ---- quality


def test_held_out_labels_are_predicted(spark):
    folder = "/root/testdata/sf0.01"
    out = queries.op2_quality(spark, folder)
    known = out.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert out.count() == 1000 and {r.held_out for r in out.collect()} == {True, False}
    good, bad = ([r.score for r in known if r.quality == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert np.mean([r.predicted == r.quality for r in known]) > 0.9 and all(0 <= r.score <= 1 for r in known)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in known)


def test_rules_are_conjunctions_and_held_out_labels_are_never_read(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(120)
    labels = docs.select("doc_id", F.when(F.col("text").contains("|"), 0).otherwise(1).alias("quality"))
    rules = quality.train(docs, labels)
    assert all(1 <= len(r) <= 6 for r, _ in rules.weighted) and all(w for _, w in rules.weighted)
    turned = labels.withColumn("quality", F.when(quality.is_held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.train(docs, turned) == rules


def test_scores_without_labels_nulls_and_clashing_columns(spark):
    docs = frame(spark, [(1, None, "a"), (2, "", "b"), (None, "Some text.", "c"), (2, "", "b")], "doc_id long, text string, score string")
    labels = frame(spark, [(1, None), (2, 7), (None, 1)], "doc_id long, quality int")
    out = quality.add_score(docs, quality.train(docs, labels)).collect()
    assert len(out) == 4 and {r.score for r in out} == {0.5} and {r.predicted for r in out} == {1}
    assert quality.add_score(docs.limit(0), quality.train(docs.limit(0), labels.limit(0))).count() == 0


# ---- language model


@pytest.fixture(scope="module")
def scores(spark):
    return lm_score.score(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()


def test_base_scores_by_brute_force(spark, scores):
    texts = {r.doc_id: (r.text or "").encode().lower().split() + [b"\n"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    counts = Counter(w for i, words in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in words)
    total, types = sum(counts.values()), len(counts)
    assert len(scores) == len(texts)
    for r in scores:
        words = texts[r.doc_id]
        expected = sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in words)
        assert abs(r.base_score - expected) < 1e-6 * abs(expected)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in counts for w in words), total)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.score < 0


def test_the_mixed_model_beats_the_counts_on_held_out_texts(spark):
    held = lm_score.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def small_model(texts):
    settings = lm_score.Settings(table_bits=(12, 12, 13, 13), first_block=32, inertia=50.0)
    sequence = "\n".join(texts).encode()
    code = lm_score.huffman(np.bincount(np.frombuffer(sequence, np.uint8), minlength=256))
    counts, weights = lm_score.SlotCounts(settings.table_bits), lm_score.Weights()
    for _, units in lm_score.groups_of_texts(texts):
        counts.add(lm_score.decisions(units, code, settings.table_bits))
    tables = [lm_score.odds_bytes(c, s) for c, s in zip(counts.counts, lm_score.START, strict=True)]
    for _, units in lm_score.groups_of_texts(texts):
        weights.learn(lm_score.decisions(units, code, settings.table_bits), tables)
    return settings, code, tables, weights.weights


def test_next_bytes_have_probabilities_that_sum_to_one():
    settings, code, tables, weights = small_model(["the cat sat on the mat", "the dog sat on the log"] * 5)

    def probability(sequence):
        units = [(lm_score.END * lm_score.PAD, sequence)]
        return math.exp(lm_score.mixed(lm_score.decisions(units, code, settings.table_bits), tables, weights, settings)[0])

    for before in (b"the cat sat on the mat and the ", b"th", b"zz"):
        assert abs(sum(probability(before + bytes([b])) for b in range(256)) / probability(before) - 1) < 1e-3
    assert probability(b"the cat sat ") > 1e6 * probability(b"xq qqz jkw v")


def test_long_texts_go_in_segments_with_their_context(monkeypatch):
    words = [w.encode() for w in "the cat sat on the mat and then some more words follow here".split()] * 30
    whole = b" ".join(words) + b" \n"
    monkeypatch.setattr(lm_score, "SEGMENT", 100)
    units = list(lm_score.units_of(words))
    assert b"".join(own for _, own in units) == whole and max(len(own) for _, own in units) <= 100
    for (lead, own), (_, before) in zip(units[1:], units[:-1], strict=True):
        assert lead == lm_score.END * lm_score.PAD + before[before.rfind(b" ", 0, -1) + 1:] and own
    long_word = list(lm_score.units_of([b"x" * 1000]))
    assert b"".join(own for _, own in long_word) == b"x" * 1000 + b" \n"
    assert [own for _, own in lm_score.units_of([])] == [b"\n"]


def test_table_sums_at_several_levels(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "FAN_IN", 2)
    rows = [(0, 0, part, lm_score.packed(np.array([part, 1], np.uint32))) for part in range(7)]
    out = lm_score.summed(frame(spark, rows, lm_score.COUNT_ROWS), 7).collect()
    assert len(out) == 1 and lm_score.unpacked(out[0].counts).tolist() == [21, 7]


def test_scores_of_odd_tables(spark):
    docs = frame(spark, [(None, "only the held out", 1), (3, None, 2), (3, "", 3), (3, "word word", 4), (3, "word word", 5)], "doc_id long, text string, score int")
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.held_out) for r in lm_score.score(docs).collect())
    assert got == [(0, 5, 1, True), (3, 1, 1, False), (3, 1, 1, False), (3, 3, 3, False), (3, 3, 3, False)]
    assert lm_score.score(docs.limit(0)).count() == 0
    nothing_learnt = lm_score.score(docs.where("doc_id is null")).first()
    assert (nothing_learnt.n_known, nothing_learnt.train_tokens, nothing_learnt.base_score) == (0, 0, 0.0) and nothing_learnt.score < 0


# ---- pipeline


def test_stages_keep_columns_and_their_decisions_take_effect(spark):
    import corpus_pipeline
    from tallyloom.llm import decontaminate, secret_scan

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "benchmark_decontamination", "secret_scans", "pack"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").where("length(text) > 120").first().text
    secret = "token = f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    text = docs.where("length(text) > 800").first().text
    planted = [(90_001, " ".join(reversed(text.split())) + " " + item), (90_002, text[:700] + " " + secret), (90_003, text[:700] + " " + secret), (90_004, "a few plain words of a short but fine text.")]
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    docs = docs.unionByName(frame(spark, [(i, t, "en", "s", len(t)) for i, t in planted], ddl))
    scored = {r.doc_id: r.predicted for r in quality.add_score(docs, quality.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))).collect()}
    kept = docs
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before, kept = kept, spark.createDataFrame(stage(spark, kept, FOLDER).toPandas(), ddl)
        assert kept.columns == docs.columns, name
        ids = {r.doc_id for r in kept.collect()}
        if n == 0:
            assert ids == {i for i, p in scored.items() if p}
        if n == 1:
            assert sorted(ids) == brute_kept([(r.doc_id, r.text) for r in before.collect()]) and kept.count() == len(ids) and not {90_002, 90_003} <= ids
        if n == 2:
            hit = {r.doc_id for r in decontaminate.find_overlaps(before, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).where("size(hits) > 0").collect()}
            assert 90_001 in hit and ids == {r.doc_id for r in before.collect()} - hit
        if n == 3:
            assert ids == {r.doc_id for r in before.collect()} and 90_002 in ids
            assert all(r.n_chars == len(r.text) for r in kept.collect()) and secret_scan.scan(kept).where("n_assign + n_hex > 0").count() == 0
            assert kept.where("doc_id = 90002").first().text == text[:700] + " [SECRET]"
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, FOLDER)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.collect()}


def test_stages_keep_the_values_of_columns_named_like_their_own(spark):
    import corpus_pipeline

    names = ["score", "predicted", "n_words", "hits", "items", "spans", "masked", "n_assign", "base_spans", "stat_upper", "sid", "kept_key", "own_columns", "doc_text"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, FOLDER)
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names), name
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    odd = frame(spark, [(1, None, None, None, None), (1, "", "en", "s", 0), (None, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert {(r.doc_id, r.text) for r in stage(spark, odd, FOLDER).collect()} <= {(1, None), (1, ""), (None, "a b")}, name


def test_the_run_is_all_stages(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, FOLDER)
    assert out.count() > 0 and {"doc_id", "start", "length", "ids", "sequence_id"} <= set(out.columns)


def test_the_library_stands_without_these_folders(tmp_path):
    shutil.copytree(REPO / "tallyloom", tmp_path / "tallyloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q.startswith(('op', 'pipeline'))])"],
                          cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True)
    assert said.stdout.strip().endswith("[]")
    assert importlib.util.find_spec("corpus_pipeline")


def test_every_operator_has_a_registered_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
