"""SentencePiece, whitening and the Merkle manifest against the library, numpy and brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import harness
from tallyloom.llm import merkle, queries, sentence_pieces, whitening

FOLDER = "/root/testdata/sf0.001"
ODD = ["", None, " ", "  ", "   a", "a   ", "▁", "▁▁ a", "a▁b", "\n\n", "\t x", "\x00a\x00", "<s> </s> <unk> <0x41>", "日本語テキスト処理", "🙂🙂👩‍👩‍👧",
       "a" * 3000, " " * 50 + "x" + " " * 33, "é é", "�", "12345 678", "-----======", "abcabcabcabc" * 500, "The  theatre thé"]


def frame(spark, rows, ddl="doc_id long, text string"):
    return spark.createDataFrame(rows, ddl)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- SentencePiece


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_ids_and_texts_are_those_of_the_library(spark, library):
    rng = random.Random(1)
    vocabulary = [library.id_to_piece(i) for i in range(259, 32000)]
    texts = ODD + [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    for alphabet, n in (("abcdefghijklmnopqrstuvwxyz    éü.,-_\n\t012ABCX▁日本語🙂\x00", 300), ("ab ▁", 300), ("thea ins", 300)):
        texts += ["".join(rng.choices(alphabet, k=rng.randint(0, 200))) for _ in range(n)]
    texts += ["".join(rng.choices(vocabulary, k=rng.randint(0, 80))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "repeated"), (0, "repeated"), (None, "no id")]
    found = sentence_pieces.decode(sentence_pieces.encode(frame(spark, rows), decoded=True).withColumnRenamed("decoded", "first")).collect()
    want = {(i, t): library.encode(t or "") + [2] for i, t in rows}
    assert len(found) == len(rows)
    for r in found:
        assert r.ids == want[r.doc_id, r.text], r.text
        assert r.first == r.decoded == library.decode(r.ids)


def test_any_ids_are_decoded_as_the_library_does(library):
    model = sentence_pieces.model("piece_bpe_32k.model")
    rng = random.Random(2)
    parts = [lambda: rng.randrange(32000), lambda: rng.randrange(3, 259), lambda: rng.randrange(3), lambda: rng.choice([0x20, 0xE2, 0x96, 0x81, 0xC3, 0xA9, 0xF0, 0x9F]) + 3]
    for _ in range(5000):
        ids = [rng.choice(parts)() for _ in range(rng.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids), ids
    with pytest.raises(IndexError):
        model.decode([-1])


def test_a_full_cache_and_many_rounds_change_nothing(library, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "CACHE_BYTES", 500)
    monkeypatch.setattr(sentence_pieces, "ROUND_WORDS", 3)
    model = sentence_pieces.Model(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [t or "" for t in ODD]
    for _ in range(2):
        assert [np.frombuffer(x, "<i4").tolist() for x in model.encode(texts)] == library.encode(texts)
        assert model.known_bytes <= 500 + sum(200 + 5 * len(t) for t in texts)


def test_piece_columns_are_kept_or_replaced_and_empty_tables_give_none(spark):
    docs = frame(spark, [(1, "a b", "mine", [7])], "doc_id long, text string, decoded string, ids array<int>")
    row = sentence_pieces.encode(docs).first()
    assert row.decoded == "mine" and row.ids == [264, 287, 2]
    assert sentence_pieces.decode(docs).first().ids == [7]
    empty = frame(spark, [])
    assert sentence_pieces.encode(empty, decoded=True).columns == ["doc_id", "text", "ids", "decoded"]
    assert sentence_pieces.encode(empty).count() == 0
    gaps = frame(spark, [(None,), ([],), ([264, None, 287],)], "ids array<int>")
    assert [r.decoded for r in sentence_pieces.decode(gaps).collect()] == ["", "", "a b"]


def test_sentencepiece_query_covers_every_document(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op11_sentencepiece(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id]) + [2]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


# ---- whitening


def brute_whitening(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    centred = x - sums / n
    matrix = centred.T @ centred / n
    values, axes = np.linalg.eigh(matrix)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return exact, centred @ axes / np.sqrt(values), values / np.trace(matrix)


def check_whitening(rows, ids, vectors):
    exact, white, explained = brute_whitening(vectors)
    k = white.shape[1]
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == len(ids) * k
    for c in range(k):
        own = np.array([got[i, c + 1].whitened for i in ids])
        sign = np.sign(own @ white[:, c])
        assert np.abs(own - sign * white[:, c]).max() < 1e-8
        for i, d in zip(ids, exact, strict=True):
            r = got[i, c + 1]
            assert (r.n, r.deviation, r.deviation_digits) == (len(ids), d if d < 1 << 63 else None, str(d))
            assert abs(r.explained / explained[c] - 1) < 1e-10 and r.identity_error < 1e-9


def test_whitening_query_equals_numpy(spark):
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    check_whitening(queries.op12_whitening(spark, FOLDER).collect(), [i for i, _ in table], [v for _, v in table])


def test_vectors_that_take_no_part_and_great_entries(spark):
    rng = np.random.default_rng(4)
    good = [(i, [float(v) for v in rng.standard_normal(5) * [1, 2, 3, 1e9, 5] + [0, 7e5, 0, 0, 0]]) for i in range(40)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [float("nan")] * 5), (104, [1.0, 2.0, float("inf"), 0.0, 0.0]), (105, [1.0, 2.0])]
    rows = frame(spark, good + bad, "vec_id long, embedding array<double>")
    found = whitening.transform(rows, whitening.fit(rows)).collect()
    ids, vectors = [i for i, _ in good], [v for _, v in good]
    exact, white, _ = brute_whitening(vectors)
    assert {(r.vec_id, r.component) for r in found} == {(i, c) for i in ids for c in range(1, 6)}
    assert {r.vec_id: int(r.deviation_digits) for r in found} == dict(zip(ids, exact, strict=True))
    assert all(r.deviation is None for r in found if int(r.deviation_digits) >= 1 << 63)
    first = {r.vec_id: r.whitened for r in found if r.component == 1}
    assert np.abs(np.abs([first[i] for i in ids]) - np.abs(white[:, 0])).max() < 1e-8


def test_whitening_without_spread_ties_and_empty_tables(spark):
    ddl = "vec_id long, embedding array<float>, whitened string"
    same = frame(spark, [(1, [0.5, 0.25], "x"), (1, [0.5, 0.25], "y"), (None, [0.5, 0.25], "z")], ddl)
    rows = whitening.transform(same, whitening.fit(same)).collect()
    assert Counter((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows) == Counter({(1, 1, 3, 0, None, 0.0, 0.0): 2, (1, 2, 3, 0, None, 0.0, 0.0): 2, (None, 1, 3, 0, None, 0.0, 0.0): 1, (None, 2, 3, 0, None, 0.0, 0.0): 1})
    empty = frame(spark, [], ddl)
    assert whitening.fit(empty) is None and whitening.transform(empty, None).count() == 0
    square = frame(spark, [(i, [float(a), float(b)]) for i, (a, b) in enumerate([(0, 0), (0, 1), (1, 0), (1, 1)] * 3)], "vec_id long, embedding array<double>")
    found = whitening.fit(square)  # two equal eigenvalues
    assert np.allclose(found.values, 262144) and found.identity_error < 1e-12 and np.allclose(found.vectors @ found.vectors.T, np.eye(2))


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_spectrum_slicing_equals_a_full_decomposition(n):
    rng = np.random.default_rng(n)
    q = np.linalg.qr(rng.standard_normal((n, n)))[0]
    thirds = q @ np.diag(np.arange(n) // 3 + 1.0) @ q.T
    a = rng.standard_normal((n, 3 * n))
    for m in (a @ a.T, (thirds + thirds.T) / 2, np.ones((n, n)), np.diag(rng.standard_normal(n)), np.zeros((n, n))):
        values, axes = whitening.leading(m, 8)
        want = np.linalg.eigvalsh(m)[::-1][:8]
        size = max(1.0, np.abs(want).max())
        assert np.abs(values - want).max() <= 1e-12 * size and np.abs(axes @ m - values[:, None] * axes).max() <= 1e-12 * size
        assert np.abs(axes @ axes.T - np.eye(len(axes))).max() < 1e-9
        for shift in rng.uniform(-2 * size, 2 * size, 5):
            assert whitening.above(m, shift) == (np.linalg.eigvalsh(m) > shift).sum()


# ---- Merkle manifest


def brute_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def brute_way(levels, place):
    for level in levels[:-1]:
        first = place // 8 * 8
        yield level[first:place], level[place + 1:first + 8]
        place //= 8


def brute_manifest(docs):
    def leaf(doc):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc[0], doc[3], doc[2], doc[4], doc[1])))

    def shown(doc):
        if doc[0] is None or doc[1] is None or zlib.crc32(str(doc[0]).encode()) % 3:
            return leaf(doc)
        return leaf((doc[0], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in doc[1]), *doc[2:]))

    parts = sorted({d[2] for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for part in parts:
        own = sorted((d for d in docs if d[2] == part), key=lambda d: (d[0] is not None, d[0] or 0, leaf(d), shown(d)))
        trees.append((own, brute_tree([leaf(d) for d in own])))
    top = brute_tree([levels[-1][0] for _, levels in trees])
    out = []
    for t, (own, levels) in enumerate(trees):
        for place, doc in enumerate(own):
            way = [*brute_way(levels, place), *brute_way(top, t)]
            end = shown(doc)
            for before, after in way:
                end = sha("".join(before) + end + "".join(after))
            proof = [s for before, after in way for s in (*before, *after)]
            out.append((doc[0], leaf(doc), levels[-1][0], top[-1][0], sha("".join(proof)), end, end == top[-1][0], tuple(proof)))
    return out


DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def proved(spark, docs, **options):
    table = frame(spark, [(*d, "clash") for d in docs], DOCS)
    low = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.lower_plain(F.col("text"))).otherwise(F.col("text"))
    return merkle.prove(merkle.build(table, COLUMNS, altered={"text": low}), **options)


@pytest.mark.parametrize("block", [8, 64, 4096])
def test_manifest_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(merkle, "TIER", {8: 1, 64: 2, 4096: 4}[block])
    monkeypatch.setattr(merkle, "BLOCK", block)
    monkeypatch.setattr(merkle, "COOL", 1)
    docs = [(i, f"Text {i} É", "en", "s", 5) for i in range(600)] + [(i, "Only", "de", None, None) for i in range(9)] + [(7, "one Leaf", "fr", "s", 1)]
    docs += [(None, "no ID", "en", "s", 1), (None, None, None, None, None), (3, "", "", "", 0), (3, "", "", "", 0), (3, "Tie", "", "", 0), (-5, "x" * 5000, None, "s", 2)]
    docs += [(1000 + i, "A", f"l{i:02}", "s", 1) for i in range(20)]
    random.Random(0).shuffle(docs)
    got = Counter(tuple(r)[:7] + (tuple(r.siblings),) for r in proved(spark, docs, siblings=True).collect())
    assert got == Counter(brute_manifest(docs))


@pytest.mark.parametrize("docs", [[], [(1, "A", "en", "s", 1)], [(3, "A", None, None, None), (3, "A", None, None, None)]])
def test_small_manifests(spark, docs):
    assert Counter(tuple(r) for r in proved(spark, docs).collect()) == Counter(b[:7] for b in brute_manifest(docs))


def test_proofs_of_chosen_leaves(spark):
    docs = [(i, f"T{i}", "en" if i % 3 else "de", "s", 5) for i in range(200)]
    want = Counter(b[:7] for b in brute_manifest(docs) if b[0] % 37 == 1)
    assert Counter(tuple(r) for r in proved(spark, docs, wanted=F.col("key") % 37 == 1).collect()) == want


def test_missing_nodes_are_the_least_union():
    sizes = merkle.level_sizes(100)
    assert sizes == [100, 13, 2, 1] and list(merkle.missing(list(range(100)), 100)) == [] and list(merkle.missing([0], 1)) == []
    asked = list(merkle.missing([0, 1, 9], 100))
    assert len(asked) == len(set(asked)) and set(asked) == {(0, k) for k in range(2, 8)} | {(0, k) for k in range(8, 16) if k != 9} | {(1, k) for k in range(2, 8)} | {(2, 1)}


def test_manifest_query_and_twin(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert Counter(tuple(r) for r in queries.op13_merkle(spark, FOLDER).collect()) == Counter(b[:7] for b in brute_manifest(docs))
    status, _, detail = harness.check(spark, harness.connect(FOLDER), FOLDER, "op13_merkle", queries.op13_merkle, queries.TWINS["op13_merkle"])
    assert status == "ok", detail
