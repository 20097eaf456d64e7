"""Packing of a batch at once: the ids, pieces and places of every text."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tallyloom.llm import packing

NAME = "word_bpe_49k.json"
TEXTS = ["Échre%%% échre,  ÉCHRE\nstraße. STRASSE;;", None, "", " \n ", "don't don't's a|b <|endoftext|> x<|endoftext|>y", "été Ångström İstanbul µm ªº 12-3.5", "́ \t a　b \U0001f600!!", "w" * 300 + "." * 70]


def test_ids_of_a_batch_are_those_of_the_library():
    library = Tokenizer.from_file(public_tokenizers.path(NAME))
    for cached in (0, 1000):
        encoder = packing.Encoder(public_tokenizers.path(NAME), cached)
        for _ in range(2):
            ids, sizes = encoder.flat(pa.array(["left out", *TEXTS]).slice(1), 2)
            want = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in TEXTS]
            assert sizes.tolist() == [len(w) for w in want]
            assert ids.tolist() == [i for w in want for i in w]


def test_letters_with_accents_are_learnt_apart_from_signs_and_case():
    encoder = packing.Encoder(public_tokenizers.path(NAME), 1000)
    encoder.texts(["Échre%%% échre, ÉCHRE"])
    asked = []
    encoder.learn_words = lambda words: asked.extend(words) or {}
    encoder.texts(["échre échre%%% %%% ,"])
    assert asked == []


def test_pieces_are_binary_and_parts_lose_none():
    totals = np.array([1, 2, 3, 4095, 4096, 4097, 12_289])
    rows, lengths = packing.pieces_of(totals, 4096)
    assert lengths[rows == 2].tolist() == [2, 1]
    assert lengths[rows == 6].tolist() == [4096, 4096, 4096, 1]
    assert np.bincount(rows, lengths).tolist() == totals.tolist()
    assert packing.pieces_of(np.array([3]), 1)[1].tolist() == [1, 1, 1]
    places = np.concatenate(([0], np.cumsum(lengths)))
    parts = list(packing.parts_of(places, 4096))
    assert [a for a, _ in parts[1:]] == [b for _, b in parts[:-1]] and parts[-1][1] == len(lengths)
    assert all(places[b] - places[a] <= 4096 for a, b in parts)
