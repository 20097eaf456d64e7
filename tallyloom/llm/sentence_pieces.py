"""Encoding and decoding with a byte-pair SentencePiece model, by vectorised merge rounds.

The symbols of all words that a batch meets for the first time lie in one flat numpy array. In a round every word finds its
least pair rank (a segmented minimum) and merges all leftmost places of it that do not overlap; the array is then compacted, and
words without a pair leave it. Merging the places of a word at once gives what one merge at a time gives, as long as no
piece made by a merge ranks equal or better than its own parts; where the vocabulary has such pieces (runs of blanks), a word merges
its leftmost place only.

Words end before a blank, and also between any two characters that no piece holds side by side: no merge can cross there,
so texts without blanks fall into short words too.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyloom.llm.common import chunks, texts_of

BLANK = "▁"
#: kinds of pieces in a model file; fixed values of its format
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
BYTE_PAIR = 2
NO_RANK = np.iinfo(np.int32).max
#: bytes of the cache of encoded words by estimate, and the longest word that is cached
CACHE_BYTES, CACHED_LENGTH = 96 << 20, 64
#: words of one set of merge rounds
ROUND_WORDS = 1 << 16


def one_byte(error: UnicodeError) -> tuple[str, int]:
    """Every byte that belongs to no character becomes a replacement character of its own."""
    return "�", error.start + 1


codecs.register_error("sentence_pieces.one_byte", one_byte)


class Model:
    """The vocabulary of a model file as tables.

    Symbols are piece ids; characters that only longer pieces know get numbers after them, all others negative ones.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            spec.ParseFromString(file.read())
        rules = spec.normalizer_spec
        kinds = np.array([p.type for p in spec.pieces])
        if (spec.trainer_spec.model_type != BYTE_PAIR or not spec.trainer_spec.byte_fallback or spec.trainer_spec.treat_whitespace_as_suffix or rules.precompiled_charsmap
                or rules.remove_extra_whitespaces or not rules.escape_whitespaces or not rules.add_dummy_prefix or np.isin(kinds, (USER_DEFINED, UNUSED)).any()):
            raise ValueError("only byte-pair models with byte fallback, a blank before the text and no other normalisation are supported")
        pieces = [p.piece for p in spec.pieces]
        scores = np.array([p.score for p in spec.pieces])
        normal = {pieces[i]: int(i) for i in np.flatnonzero(kinds == NORMAL)}
        if any(BLANK in p[1:] and p.strip(BLANK) for p in normal):
            raise ValueError("a piece holds a blank after other characters")
        self.unknown, self.end = int(np.flatnonzero(kinds == UNKNOWN)[0]), pieces.index(spec.trainer_spec.eos_piece)
        self.byte_ids = np.array([pieces.index(f"<0x{b:02X}>") for b in range(256)], np.int32)
        symbols = dict(normal)
        for char in sorted({c for p in normal for c in p}):
            symbols.setdefault(char, len(pieces) + len(symbols) - len(normal))
        self.size = max(symbols.values()) + 1
        self.n_pieces = len(pieces)
        self.of_char = -1 - np.arange(0x110000, dtype=np.int32)
        for char in {c for p in normal for c in p}:
            self.of_char[ord(char)] = symbols[char]
        ranks = np.unique(-scores, return_inverse=True)[1]
        pairs = {}
        risky = np.zeros(self.size, bool)
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = i
                    for part in (left, right):
                        if part < self.n_pieces and ranks[i] <= ranks[part]:
                            risky[part] = True
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys = np.append(keys, np.iinfo(np.int64).max)
        self.pair_ids = np.append(np.array([pairs[k] for k in keys.tolist()], np.int32), -1)
        self.pair_ranks = np.append(ranks[self.pair_ids[:-1]].astype(np.int32), NO_RANK)
        self.risky = risky
        sides = {symbols[a] * self.size + symbols[b] for p in normal for a, b in zip(p, p[1:], strict=False)}
        self.side_keys = np.append(np.array(sorted(sides), np.int64), np.iinfo(np.int64).max)
        surfaces = [p.replace(BLANK, " ").encode() for p in pieces]
        for b, i in enumerate(self.byte_ids.tolist()):
            surfaces[i] = bytes([b])
        self.controls = set(np.flatnonzero(kinds == CONTROL).tolist())
        surfaces[self.unknown] = spec.trainer_spec.unk_surface.encode()
        self.surfaces = surfaces
        self.starts_blank = [p.startswith(BLANK) for p in pieces]
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0

    # ---- encoding

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places in the pair tables; the last one stands for no pair."""
        keys = left.astype(np.int64) * self.size + right
        keys[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, at, len(self.pair_keys) - 1)

    def merged(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words, one after the other and with their lengths, after all merges: (symbols, lengths)."""
        n_words = len(lengths)
        if not len(symbols):
            return symbols, lengths
        own = np.repeat(np.arange(n_words), lengths)
        last = np.append(own[1:] != own[:-1], True)
        pair = np.full(len(symbols), len(self.pair_keys) - 1)
        inner = np.flatnonzero(~last)
        pair[inner] = self.lookup(symbols[inner], symbols[inner + 1])
        done_symbols, done_own = [], []
        while True:
            ranks = self.pair_ranks[pair]
            starts = np.flatnonzero(np.append(True, last[:-1]))
            sizes = np.diff(np.append(starts, len(symbols)))
            least = np.minimum.reduceat(ranks, starts)
            ended = least == NO_RANK
            if ended.any():
                gone = np.repeat(ended, sizes)
                done_symbols.append(symbols[gone])
                done_own.append(own[gone])
                stays = ~gone
                symbols, own, last, pair, ranks = (x[stays] for x in (symbols, own, last, pair, ranks))
                if not len(symbols):
                    break
                least, sizes = least[~ended], sizes[~ended]
            hits = np.flatnonzero(ranks == np.repeat(least, sizes))
            made = self.pair_ids[pair[hits]]
            # places that follow each other overlap: every second one of such a run is merged
            breaks = np.append(True, np.diff(hits) != 1)
            position = np.arange(len(hits))
            offset = position - position[breaks][np.cumsum(breaks) - 1]
            take = offset % 2 == 0
            alone = self.risky[made]
            if alone.any():
                word = own[hits]
                take &= ~alone | np.append(True, word[1:] != word[:-1])
            hits, made = hits[take], made[take]
            symbols[hits] = made
            last[hits] = last[hits + 1]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            at = np.cumsum(keep)[hits] - 1
            symbols, own, last, pair = symbols[keep], own[keep], last[keep], pair[keep]
            touched = np.zeros(len(symbols), bool)
            touched[at] = touched[at[at > 0] - 1] = True
            pair[touched] = len(self.pair_keys) - 1
            changed = np.flatnonzero(touched & ~last)
            pair[changed] = self.lookup(symbols[changed], symbols[changed + 1])
        symbols, own = np.concatenate(done_symbols), np.concatenate(done_own)
        order = np.argsort(own, kind="stable")
        return symbols[order], np.bincount(own, minlength=n_words)

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of every word (blanks as ``BLANK``), little-endian 32-bit."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        symbols = self.of_char[chars]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        # words are cut further where no piece holds both neighbours
        cut = np.ones(len(symbols), bool)
        keys = symbols[:-1].astype(np.int64) * self.size + symbols[1:]
        keys[(symbols[:-1] < 0) | (symbols[1:] < 0)] = -1
        cut[1:] = self.side_keys[np.searchsorted(self.side_keys, keys)] != keys
        cut[np.cumsum(sizes)[:-1]] = True
        starts = np.flatnonzero(cut)
        symbols, lengths = self.merged(symbols, np.diff(np.append(starts, len(symbols))))
        # single characters without a piece become their bytes
        bare = np.flatnonzero((symbols < 0) | (symbols >= self.n_pieces))
        counts = np.ones(len(symbols), np.int64)
        spelled = [self.spelled(s) for s in symbols[bare].tolist()]
        counts[bare] = [len(s) for s in spelled]
        ids = np.repeat(symbols, counts).astype("<i4")
        if len(bare):
            firsts = np.cumsum(counts)[bare] - counts[bare]
            flat = np.concatenate(spelled)
            ids[np.repeat(firsts, counts[bare]) + np.concatenate([np.arange(len(s)) for s in spelled])] = flat
        per_part = np.add.reduceat(counts, np.cumsum(lengths) - lengths) if len(lengths) else lengths
        ends = np.searchsorted(starts, np.cumsum(sizes))
        stops = np.append(0, np.cumsum(per_part))[ends]
        raw = ids.tobytes()
        return [raw[4 * a:4 * b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]

    def spelled(self, symbol: int) -> np.ndarray:
        char = chr(-1 - symbol) if symbol < 0 else chr(int(np.flatnonzero(self.of_char == symbol)[0]))
        return self.byte_ids[np.frombuffer(char.encode("utf-8", "surrogatepass"), np.uint8)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, little-endian 32-bit, without begin or end."""
        cut = [words_of(t) for t in texts]
        known, held = self.known, self.known_bytes
        unseen = list(set().union(*cut).difference(known))
        for start in range(0, len(unseen), ROUND_WORDS):
            part = unseen[start:start + ROUND_WORDS]
            known.update(zip(part, self.words([BLANK + w.replace(" ", BLANK) for w in part]), strict=True))
        out = [b"".join(map(known.__getitem__, own)) for own in cut]
        held += sum(200 + 5 * len(w) for w in unseen)
        for word in unseen:
            if len(word) > CACHED_LENGTH:
                held -= 200 + 5 * len(word)
                del known[word]
        if held > CACHE_BYTES:
            known.clear()
            held = 0
        self.known_bytes = held
        return out

    # ---- decoding

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; the blank before the first piece is dropped, ids out of the vocabulary raise an IndexError."""
        if ids and min(ids) < 0:
            raise IndexError("ids are not negative")
        if not self.controls.isdisjoint(ids):
            # control ids have no text, and no character holds bytes from both sides of one
            at = [k for k, i in enumerate(ids) if i in self.controls]
            runs = [ids[a + 1:b] for a, b in zip([-1, *at], [*at, len(ids)], strict=True)]
        else:
            runs = [ids]
        raw = [b"".join(map(self.surfaces.__getitem__, run)) for run in runs]
        first = next((k for k, run in enumerate(runs) if run), None)
        if first is not None and self.starts_blank[runs[first][0]]:
            raw[first] = raw[first][1:]
        return "".join([x.decode("utf-8", "sentence_pieces.one_byte") for x in raw])


DOUBLE = re.compile(" *[^ ]+| +$")


def words_of(text: str) -> list[str]:
    """Words of a text, each without the one blank before it (of the text, or the one that is put before the text)."""
    if not text:
        return []
    text = text.replace(BLANK, " ")
    words = text.split(" ")
    if "" not in words:
        return words
    return [w[1:] for w in DOUBLE.findall(" " + text)]


@cache
def model(name: str) -> Model:
    """One model for each worker and vocabulary."""
    import public_tokenizers

    return Model(public_tokenizers.path(name))


def _mapped(df: DataFrame, new: str, run) -> DataFrame:
    """``df`` with the columns ``new`` (DDL) in place of columns so named, made part by part of about 8 MB of text."""
    made = T.StructType.fromDDL(new)
    taken = {f.name.lower() for f in made}
    kept = [f for f in df.schema if f.name.lower() not in taken]
    names = [f.name for f in kept] + made.fieldNames()

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, columns in run(whole):
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in kept] + columns, names)

    return df.mapInArrow(mapped, T.StructType([*kept, *made]))


def encode(docs: DataFrame, text: str = "text", vocabulary: str = "piece_bpe_32k.model", end: bool = True, decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array of int) of every whole text, exactly as the library encodes it without sampling.

    ``end`` adds the end id; ``decoded`` adds a column of that name, the text decoded from the ids again. A null or empty text
    has no ids but the end id. Long texts are never cut; repeated rows are encoded like any other; an empty table gives none.
    Columns named ``ids`` (or ``decoded``, if asked for) are replaced, all others stay as they are.
    """

    def run(whole: pa.RecordBatch):
        own = model(vocabulary)
        last = np.array([own.end] if end else [], "<i4").tobytes()
        for batch in chunks(whole, text):
            found = [ids + last for ids in own.encode(texts_of(batch, text))]
            offsets = np.cumsum([0] + [len(ids) // 4 for ids in found])
            columns = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))]
            if decoded:
                columns.append(pa.array([own.decode(np.frombuffer(ids, "<i4").tolist()) for ids in found], pa.string()))
            yield batch, columns

    return _mapped(docs, "ids array<int>, decoded string" if decoded else "ids array<int>", run)


def decode(docs: DataFrame, ids: str = "ids", vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """``docs`` with ``decoded``, the text of the column ``ids`` (array of int), as the library decodes it.

    Null or empty arrays give an empty text; bytes that make no character become replacement characters; null elements are left
    out; an id outside the vocabulary is an error, as in the library. A column named ``decoded`` is replaced, all others stay.
    """

    def run(batch: pa.RecordBatch):
        own = model(vocabulary)
        lists = batch.column(batch.schema.get_field_index(ids))
        yield batch, [pa.array([own.decode([i for i in (x.as_py() or ()) if i is not None]) for x in lists], pa.string())]

    return _mapped(docs, "decoded string", run)
