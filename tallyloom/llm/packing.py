"""Packing by power-of-two decomposition.

The tokens of a document are cut into pieces of binary lengths, the longest first. Every piece is a sequence of its own and
sequences of one length form a bucket, so batches are drawn from a bucket, no sequence crosses documents and nothing is padded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyloom.llm.common import chunks, release

#: entries of the cache of encoded runs, and the longest run that is cached
CACHED_RUNS, CACHED_LENGTH = 1_200_000, 64


#: letters that case and normal form map one to one, then signs; the vocabulary never joins the two, and each is one word of it
LETTERS_AND_SIGNS = re.compile(r"([A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]*)([.,!?;:|*#$%&]*)")


class Encoder:
    """Ids as the library gives them, little-endian unsigned 32-bit.

    The vocabulary drops white space and never joins across it, so the runs between blanks and line ends are encoded on
    their own, each different one of a batch once, and kept in a bounded cache. It is in lower case, so plain letters are looked up
    in lower case, apart from the signs after them. Whatever is new is encoded by the library.
    """

    def __init__(self, path: str, cached: int):
        from tokenizers import Tokenizer

        self.cached = cached
        self.library = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(self.library.get_vocab_size() + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def learn_words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of ``words``, each one word of the vocabulary; encoded together, told apart by the tokens that end a word."""
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = 4 * (np.flatnonzero(self.ends_word[ids]) + 1)
        data, ends = ids.tobytes(), ends.tolist()
        return {word: data[a:b] for word, a, b in zip(words, [0, *ends[:-1]], ends, strict=True)}

    def learn(self, runs: list[str]) -> dict[str, bytes]:
        """The ids of ``runs``, none of which may hold a blank; encoded together, told apart by their places."""
        starts = np.cumsum([0] + [len(r) + 1 for r in runs])[:-1]
        found = self.library.encode(" ".join(runs), add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        places = np.array([a for a, _ in found.offsets], np.int64)
        ends = np.searchsorted(places, np.append(starts[1:], np.iinfo(np.int64).max))
        return {run: ids[a:b].tobytes() for run, a, b in zip(runs, [0, *ends[:-1].tolist()], ends.tolist(), strict=True)}

    def ids_of(self, runs: list[str]) -> list[bytes]:
        """The ids of each of ``runs``, which are all different."""
        if len(self.known) > self.cached:
            self.known = {"": b""}
        known = self.known
        found = list(map(known.get, runs))
        plain, others, words = [], [], set()
        for i, run in enumerate(runs):
            if found[i] is None:
                if match := LETTERS_AND_SIGNS.fullmatch(run):
                    letters, signs = match.groups()
                    letters = letters.lower()
                    plain.append((i, letters, signs))
                    words.update((letters, signs))
                else:
                    others.append(i)
        words = [w for w in words if w not in known]
        for learn, new in ((self.learn_words, words), (self.learn, [runs[i] for i in others])):
            for start in range(0, len(new), 4096):
                known |= learn(new[start:start + 4096])
        for i, letters, signs in plain:
            known[runs[i]] = found[i] = known[letters] + known[signs]
        for i in others:
            found[i] = known[runs[i]]
        for run in [r for r in (*words, *(runs[i] for i, _, _ in plain), *(runs[i] for i in others)) if len(r) > CACHED_LENGTH]:
            known.pop(run, None)
        return found

    def flat(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` (null: empty) one after the other, each with ``end`` after it if given, and the number of each text."""
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        runs = coded.indices.to_numpy(zero_copy_only=False)
        found = self.ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.frombuffer(b"".join(found), "<u4")
        starts = np.cumsum(counts) - counts
        per_run = counts.take(runs)
        ends = np.cumsum(per_run)
        bounds = np.concatenate(([0], ends))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        out = ids.take(np.repeat(starts.take(runs) - ends + per_run, per_run) + np.arange(len(runs) and ends[-1]))
        sizes = np.diff(bounds)
        if end is None:
            return out, sizes
        return np.insert(out, bounds[1:], np.uint32(end)).astype("<u4", copy=False), sizes + 1

    def texts(self, texts: list[str]) -> list[bytes]:
        ids, sizes = self.flat(pa.array(texts, pa.string()))
        data, ends = ids.tobytes(), (4 * np.cumsum(sizes)).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


@cache
def encoder(name: str, cached: int = CACHED_RUNS) -> Encoder:
    """One encoder for each worker and vocabulary, which keeps ``cached`` runs at most between batches."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    import public_tokenizers

    return Encoder(public_tokenizers.path(name), cached)


def pieces_of(totals: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The document and the length of each piece, in order: as often as it fits ``longest`` (a power of two), then the binary digits of what remains."""
    powers = longest >> np.arange(longest.bit_length())
    times = (totals[:, None] & powers) > 0
    times = np.column_stack((totals // longest, times[:, 1:]))
    return np.repeat(np.arange(len(totals)), times.sum(axis=1)), np.repeat(np.tile(powers, len(totals)), times.ravel())


def parts_of(places: np.ndarray, most: int = 1 << 28) -> Iterator[tuple[int, int]]:
    """Consecutive pieces with at most ``most`` ids together (one longer than that is alone), as bounds."""
    a = 0
    while a < len(places) - 1:
        b = max(a + 1, int(np.searchsorted(places, places[a] + most, "right")) - 1)
        yield a, b
        a = b


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "word_bpe_49k.json", end: int = 2, longest: int = 4096, cached: int = CACHED_RUNS,
         most_bytes: int = 8 << 20) -> DataFrame:
    """One row per piece: ``key``, start, length, ids, doc_tokens, sequence_id, offset, bucket.

    ``ids`` are the little-endian unsigned 32-bit ids; ``bucket`` is the binary logarithm of the length: sequences of one
    bucket have one length, a power of two up to ``longest``, and need no padding. A null or empty text has only its end id. Rows
    that repeat a document or have no key are packed like any other, each with sequences of its own; an empty table
    gives none; other columns of ``docs`` are not read. ``sequence_id`` is unique: partition number, then position in it.
    A worker encodes about ``most_bytes`` of text at a time, which bounds its memory and not the texts: none is cut.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    docs = docs.select(docs[key].alias("doc_key"), docs[text].alias("doc_text"))
    kind = docs.schema["doc_key"].dataType
    schema = T.StructType([T.StructField(key, kind), *T.StructType.fromDDL("start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, bucket int")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 33
        encode = encoder(vocabulary, cached).flat
        for whole in batches:
            for batch in chunks(whole, "doc_text", most_bytes):
                ids, totals = encode(batch.column(1), end)
                rows, lengths = pieces_of(totals, longest)
                places = np.concatenate(([0], np.cumsum(lengths)))  # the pieces follow each other as the ids do
                starts = places[:-1] - (np.cumsum(totals) - totals)[rows]
                # most of a batch is one array of bytes; only texts of more than 2 GB of ids need several
                for a, b in parts_of(places):
                    part = slice(a, b)
                    data = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((4 * (places[a:b + 1] - places[a])).astype(np.int32)), pa.py_buffer(ids[places[a]:places[b]])])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows[part])), pa.array(starts[part]), pa.array(lengths[part]), data, pa.array(totals[rows[part]]),
                         pa.array(np.arange(sequence, sequence + b - a)), pa.array(np.zeros(b - a, np.int64)), pa.array(np.log2(lengths[part]).astype(np.int32))],
                        schema.fieldNames())
                    sequence += b - a
        release()

    return docs.mapInArrow(run, schema)
