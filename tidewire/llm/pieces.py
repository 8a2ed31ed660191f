"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the vocabulary's pieces reads a text once. At
each position its output links give every piece that ends there, and each
relaxes the best score of that position (Viterbi); the best path gives the
ids. Among equal scores the longest piece ending there wins. A character that
no piece covers becomes byte pieces, at the unknown score (the lowest piece
score minus 10), so decoding gives every text back.

White space is the mark U+2581, one mark leads the text, and nothing else is
normalised; a U+2581 in the text decodes to a space. No piece has a mark after
another character (checked on loading; otherwise texts aren't split), so the
best path of a text is that of its words, and each worker keeps the words it has
met lately.

Viterbi needs log-probabilities. Those of a unigram model are taken from its
file, and the ids are the library's (for models with byte pieces and without a
normaliser). The scores in the file of a BPE model are merge ranks; sums of them
mean nothing, and tokenizers aren't trained here, so the log-probability of the
piece of rank r is set to -ln(r + RANK_SHIFT), up to a constant: frequencies
fall off about like that. These ids are a segmentation of their own into the
file's pieces, not the library's BPE merges (on documents of the test data 87 %
of the words come out the same). Models of other kinds are refused.

Null text: no ids, decodes to "". Repeated rows are encoded one by one. Very
long texts are encoded whole. An empty table gives no row. Columns named like a
result are replaced.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import extended, quoted

#: The mark that stands for white space.
MARK = "▁"
#: Words that a worker keeps (some 200 bytes each); past that it keeps no new ones.
KEPT_WORDS = 250_000
#: Added to the ranks of BPE pieces, so that the first ones aren't too cheap.
RANK_SHIFT = 1000
#: Model types in a model file, and where it says its type.
UNIGRAM, BPE = 1, 2
TRAINER_SPEC, MODEL_TYPE = 2, 3


def fields(message: bytes):
    """(number, value) of the fields of a serialised message: integers, or bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
        else:
            size = varint() if wire == 2 else 8 if wire == 1 else 4
            at += size
            yield number, message[at - size : at]


def model_type(proto: bytes) -> int:
    spec = next((v for k, v in fields(proto) if k == TRAINER_SPEC), b"")
    return next((v for k, v in fields(spec) if k == MODEL_TYPE), UNIGRAM)


class Model:
    """Pieces, scores and automaton of a serialised model."""

    def __init__(self, proto: bytes):
        import ahocorasick
        import sentencepiece

        kind = model_type(proto)
        if kind not in (UNIGRAM, BPE):
            raise ValueError("the model has neither log-probabilities nor merge ranks")
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        self.score = np.zeros(n)
        self.text: list[bytes] = [b""] * n
        self.byte_id = [0] * 256
        self.automaton = ahocorasick.Automaton()
        lowest, pieces = 0.0, []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.text[i] = bytes([int(piece[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.score[i] = sp.get_score(i) if kind == UNIGRAM else -np.log(RANK_SHIFT - sp.get_score(i))
                lowest = min(lowest, self.score[i])
                self.text[i] = piece.replace(MARK, " ").encode()
                self.automaton.add_word(piece, (len(piece), i, float(self.score[i])))
                pieces.append(piece)
        self.automaton.make_automaton()
        self.unknown = lowest - 10
        for b, i in enumerate(self.byte_id):
            if b & 0xC0 != 0x80:  # the first byte of a character pays for all
                self.score[i] = self.unknown
        self.single = {p for p in pieces if len(p) == 1}
        self.words = cuts(pieces)
        self.kept: dict[str, bytes] = {}
        #: Texts of all pieces end to end, where each begins, and its length.
        self.bytes = np.frombuffer(b"".join(self.text), dtype=np.uint8)
        self.size = np.array([len(x) for x in self.text], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size

    def viterbi(self, word: str) -> list[int]:
        """Ids of the best path through a word (with marks for its spaces)."""
        n = len(word)
        best, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
        if self.single.issuperset(word):
            for end, (size, i, score) in self.automaton.iter(word):
                value = best[end + 1 - size] + score
                if value > best[end + 1]:
                    best[end + 1], back[end + 1] = value, (size, i)
        else:
            ending: dict[int, list] = {}
            for end, output in self.automaton.iter(word):
                ending.setdefault(end, []).append(output)
            for end, character in enumerate(word):
                if character not in self.single:
                    best[end + 1], back[end + 1] = best[end] + self.unknown, (1, -1)
                for size, i, score in ending.get(end, ()):
                    value = best[end + 1 - size] + score
                    if value > best[end + 1]:
                        best[end + 1], back[end + 1] = value, (size, i)
        ids, at = [], n
        while at:
            size, i = back[at]
            at -= size
            ids.extend([i] if i >= 0 else [self.byte_id[b] for b in reversed(word[at].encode())])
        ids.reverse()
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as four-byte numbers."""
        if not text:
            return b""
        words = self.words.findall(" " + text.replace(MARK, " "))
        found = list(map(self.kept.get, words))
        if None in found:
            keep = len(self.kept) < KEPT_WORDS
            for k, ids in enumerate(found):
                if ids is None:
                    found[k] = np.array(self.viterbi(words[k].replace(" ", MARK)), np.int32).tobytes()
                    if keep:
                        self.kept[words[k]] = found[k]
        return b"".join(found)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of the id runs that end at ``ends``."""
        size = self.size[ids]
        past = np.cumsum(size)
        data = self.bytes[np.repeat(self.begin[ids] - (past - size), size) + np.arange(past[-1] if len(past) else 0)].tobytes()
        bounds = np.concatenate(([0], past))[np.concatenate(([0], ends))]
        return [data[a:b].decode("utf-8", "replace")[1:] for a, b in zip(bounds, bounds[1:])]


def cuts(pieces: list[str]) -> re.Pattern:
    """Words whose best paths together are the text's: no piece reaches over a cut between them.

    Cut before a space (mark) that follows another character, around line ends,
    and before a sign that follows a letter, each only if no piece has such a
    pair of characters inside.
    """
    pairs = {(a, b) for p in pieces for a, b in zip(p, p[1:])}
    if any(b == MARK != a for a, b in pairs) or any("\n" in x for x in pairs):
        return re.compile("(?s).+")
    after_letter = {b for a, b in pairs if a.isalpha()}
    signs = "".join(c for c in "!\"#$%&()*+,./:;<=>?@[]^_`{|}~" if c not in after_letter)
    signs = re.escape(signs) or "\n"
    return re.compile(f" *(?:[{signs}]*[^ \n{signs}]+|[{signs}]+)|\n+| +")


_MODELS: dict[str, Model] = {}


def load(proto: bytes) -> Model:
    """The model of this worker; built once."""
    key = hashlib.sha256(proto).hexdigest()
    if key not in _MODELS:
        _MODELS[key] = Model(proto)
    return _MODELS[key]


def read_model(path: str) -> bytes:
    """Serialised model (about 0.5 MB, whatever the data), read by the driver and sent with the tasks."""
    with open(path, "rb") as file:
        return file.read()


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> list[pa.RecordBatch]:
    table = pa.Table.from_batches([batch])
    for name, values in columns.items():
        table = table.append_column(name, values)
    return table.to_batches()


def _slices(batches, rows: int = 200):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode(docs: DataFrame, proto: bytes, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` (but ids and score) with ``ids array<int>`` and ``score double``."""
    docs = docs.select(*quoted(c for c in docs.columns if c not in ("ids", "score")))

    def run(batches):
        model = load(proto)
        for batch in _slices(batches):
            ids = [model.encode(t or "") for t in batch.column(text_col).to_pylist()]
            flat, ends = np.frombuffer(b"".join(ids), np.int32), np.cumsum([0, *[len(x) // 4 for x in ids]])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            scores = [float(model.score[flat[a:b]].sum()) for a, b in zip(ends, ends[1:])]
            yield from _with(batch, ids=lists, score=pa.array(scores, pa.float64()))

    return docs.mapInArrow(run, extended(docs, docs.columns, "ids array<int>, score double"))


def decode(encoded: DataFrame, proto: bytes, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` (but ``to``) with the text of the ids; null ids give ""."""
    encoded = encoded.select(*quoted(c for c in encoded.columns if c != to))

    def run(batches):
        model = load(proto)
        for batch in _slices(batches):
            lists = batch.column(ids_col)
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
            texts = model.decode(lists.flatten().to_numpy(), ends)
            yield from _with(batch, **{to: pa.array(texts, pa.string())})

    return encoded.mapInArrow(run, extended(encoded, encoded.columns, f"`{to}` string"))
