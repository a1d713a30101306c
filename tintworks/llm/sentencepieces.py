"""SentencePiece encoding and decoding by a forward pass shared between words.

A text is cut into marked words (space marks and what follows them), which no
piece crosses.  A batch's distinct marked words are sorted, so that walking them is
a depth-first traversal of their trie: the forward states of a common prefix are
kept, and only the characters after it are worked out.

For unigram models a prefix's state is the best score of its segmentations and the
last piece of the best one (Viterbi).  For BPE models the best sum of scores is not
the result of merging, so the state is the last piece of the prefix's own BPE
result: of the pieces that end there, the one which stays as it is beside the last
piece before it when the two are merged from characters.  That is again one state
for a prefix, found from states of shorter prefixes, and gives what merging gives.

Characters without a piece become byte pieces.  Decoding joins pieces and bytes and
turns marks into spaces.

Edge cases: null and empty texts have no pieces and decode to the empty text; the
mark itself (U+2581) in a text decodes to a space; words of any length are encoded
whole; repeated rows give repeated results; an empty table gives an empty result.
Other columns of any name pass through, unless they have a result's name.

Memory: texts are taken in slices of SLICE_BYTES (a longer text is one by itself),
and a task remembers words' ids as numbers, WORD_CACHE words and PIECE_CACHE ids at
most (24 MB), and which pieces stay beside each other, STAY_CACHE pairs (25 MB).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, given
from .textkernel import span_hashes, utf8_views

MARK = "▁"
WORD_CACHE = 500_000
PIECE_CACHE = 2_000_000
STAY_CACHE = 200_000
SLICE_BYTES = 1 << 21
#: The state before a word's first character.
START = -(1 << 40)


def default_model_path() -> str:
    """The installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class PieceModel:
    """What encoding needs of a model: its kind, pieces with ids and scores, and byte pieces."""

    kind: str
    scores: dict[str, float]
    ids: dict[str, int]
    byte_ids: tuple[int, ...]
    surface: tuple[bytes, ...]
    unknown: int

    @staticmethod
    def load(path: str, kind: str | None = None) -> PieceModel:
        """Read a model file on the driver; `kind` overrides its own (bpe or unigram)."""
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules, trained = model.normalizer_spec, model.trainer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces or trained.treat_whitespace_as_suffix:
            raise ValueError("only models that leave the text as it is, with marks before words, are supported")
        kind = kind or {1: "unigram", 2: "bpe"}.get(trained.model_type)
        kinds = {p.type for p in model.pieces}
        if kind is None or not kinds <= {1, 2, 3, 6} or not trained.byte_fallback:
            raise ValueError("only unigram and BPE models with byte fallback and without user-defined pieces are supported")
        ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("a piece crosses the start of a word")
        byte_ids, surface = [0] * 256, []
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                byte_ids[int(p.piece[3:5], 16)] = i
                surface.append(bytes([int(p.piece[3:5], 16)]))
            else:
                surface.append(p.piece.replace(MARK, " ").encode() if p.type == 1 else b"")
        unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        return PieceModel(kind, {p: model.pieces[i].score for p, i in ids.items()}, ids, tuple(byte_ids), tuple(surface), unknown)


def merge(text: str, scores: dict[str, float]) -> list[str]:
    """Byte-pair merging from characters: always the pair of the best score, the leftmost of equals."""
    parts: list[str | None] = list(text)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < len(parts):
            pair = parts[i] + parts[after[i]]
            score = scores.get(pair)
            if score is not None:
                heapq.heappush(heap, (-score, i, pair))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, i, pair = heapq.heappop(heap)
        # what was offered may be merged with something else by now
        if parts[i] is None or after[i] >= len(parts) or parts[i] + parts[after[i]] != pair:
            continue
        gone = after[i]
        parts[i], parts[gone], after[i] = pair, None, after[gone]
        if after[i] < len(parts):
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [p for p in parts if p is not None]


class Encoder:
    """Encodes marked words; remembers them, and which pieces stay beside each other, within bounds."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.pieces = {i: p for p, i in model.ids.items()}
        self.longest = max(map(len, model.ids), default=1)
        self.stays: dict[int, bool] = {}
        self._clear()
        # the lengths, longest first, of the pieces that end in two given characters
        ends: dict[str, set[int]] = {}
        for p in model.ids:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {k: sorted(v, reverse=True) for k, v in ends.items()}
        self.least = min(model.scores.values(), default=0.0) - 10.0
        # white-space characters in no piece at all end a word just as a mark does
        self.lone = np.zeros(256, dtype=bool)
        self.lone[[ord(c) for c in "\n\r\t\v\f" if not any(c in p for p in model.ids)]] = True
        self.surface = np.frombuffer(b"".join(model.surface), dtype=np.uint8)
        self.surface_ends = np.cumsum([len(s) for s in model.surface])

    def _clear(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)
        self.slots = self.begins = self.sizes = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)

    def _name(self, piece: int) -> str:
        return self.pieces[piece] if piece >= 0 else "" if piece == START else chr(-1 - piece)

    def _beside(self, left: int, piece: int) -> bool:
        if len(self.stays) >= STAY_CACHE:
            self.stays.clear()
        x, y = self._name(left), self._name(piece)
        known = self.stays[left << 32 | piece] = merge(x + y, self.model.scores) == ([x, y] if x else [y])
        return known

    def _forward_bpe(self, word: str, last: list[int], start: int) -> None:
        """last[i]: the last piece of the BPE result of word[:i]; characters without a piece have negative numbers."""
        ids, stays, beside, lengths = self.model.ids, self.stays, self._beside, self.lengths
        for end in range(start + 1, len(word) + 1):
            for size in lengths.get(word[max(end - 2, 0) : end], ()):
                if size <= end:
                    piece = ids.get(word[end - size : end])
                    if piece is not None:
                        left = last[end - size]
                        known = stays.get(left << 32 | piece)
                        if beside(left, piece) if known is None else known:
                            break
            else:
                piece = ids.get(word[end - 1])
                if piece is None:
                    piece = -1 - ord(word[end - 1])
            last.append(piece)

    def _forward_unigram(self, word: str, best: list[float], last: list[int], start: int) -> None:
        """best[i], last[i]: the best score of word[:i] and its segmentation's last piece."""
        ids, scores = self.model.ids, self.model.scores
        for end in range(start + 1, len(word) + 1):
            top, chosen = None, 0
            for size in range(min(self.longest, end), 0, -1):
                name = word[end - size : end]
                score, piece = scores.get(name), ids.get(name)
                if score is None and size == 1:
                    score, piece = self.least, -1 - ord(name)
                if score is not None and (top is None or best[end - size] + score > top):
                    top, chosen = best[end - size] + score, piece
            best.append(top)
            last.append(chosen)

    def encode_words(self, words: list[str]) -> tuple[list[int], list[int]]:
        """(ids, sizes) of sorted words, one after the other."""
        names, byte_ids, bpe = self.pieces, self.model.byte_ids, self.model.kind == "bpe"
        before, best, last, flat, sizes = "", [0.0], [START], [], []
        for word in words:
            if bpe and word.startswith(MARK * 2):
                # runs of marks have pieces of one common score, where place decides
                found = [self.model.ids.get(p, -1 - ord(p[0])) for p in merge(word, self.model.scores)]
            else:
                shared, most = 0, min(len(before), len(word))
                while shared < most and before[shared] == word[shared]:
                    shared += 1
                del last[shared + 1 :], best[shared + 1 :]
                if bpe:
                    self._forward_bpe(word, last, shared)
                else:
                    self._forward_unigram(word, best, last, shared)
                found, at, before = [], len(word), word
                while at:
                    piece = last[at]
                    found.append(piece)
                    at -= len(names[piece]) if piece >= 0 else 1
                found.reverse()
            size = len(flat)
            for piece in found:
                if piece >= 0:
                    flat.append(piece)
                else:
                    flat += [byte_ids[b] for b in chr(-1 - piece).encode()]
            sizes.append(len(flat) - size)
        return flat, sizes

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        if len(self.known) + len(words) > WORD_CACHE or len(self.flat) > PIECE_CACHE:
            self._clear()
        order = sorted(range(len(words)), key=words.__getitem__)
        flat, sizes = self.encode_words([words[i] for i in order])
        sizes = np.array(sizes, dtype=np.int64)
        begins = np.cumsum(sizes) - sizes + len(self.flat)
        slots = np.arange(len(sizes)) + len(self.sizes)
        known, slots = np.concatenate([self.known, hashes[order]]), np.concatenate([self.slots, slots])
        order = np.argsort(known)
        self.known, self.slots = known[order], slots[order]
        self.begins, self.sizes = np.concatenate([self.begins, begins]), np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.array(flat, dtype=np.int32)])

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes among the known ones, and which are there."""
        at = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        return at, self.known[at] == hashes if len(self.known) else np.zeros(len(hashes), dtype=bool)

    def encode_slice(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, offsets, same) of UTF-8 texts, same telling whether decoding gives the text back."""
        mark, spaced = MARK.encode(), []
        for text in texts:
            spaced.append(b" " + text.replace(mark, b" ") if text else b"")
        data = np.frombuffer(b"".join(spaced), dtype=np.uint8)
        rows = np.cumsum([0, *map(len, spaced)])
        space, lone = data == 0x20, self.lone[data]
        begins = lone | space
        begins[1:] &= ~(space[1:] & space[:-1])
        begins[1:] |= lone[:-1] & ~space[1:]
        begins[rows[:-1][np.diff(rows) > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        hashes, first, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at, there = self._find(hashes)
        if not there.all():
            new = np.flatnonzero(~there)
            cut = [data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace").replace(" ", MARK) for i in first[new]]
            before = len(self.known)
            self._learn(hashes[new], cut)
            if len(self.known) != before + len(new):  # it was cleared before: all of the slice's words again
                self._clear()
                self._learn(hashes, [data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace").replace(" ", MARK) for i in first])
            at, _ = self._find(hashes)
        slots = self.slots[at][inverse]
        sizes = self.sizes[slots]
        to = np.cumsum(sizes)
        total = int(to[-1]) if len(to) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.begins[slots] - (to - sizes), sizes)]
        offsets = np.concatenate([[0], to])[np.searchsorted(starts, rows)]
        same = np.array([mark not in text for text in texts], dtype=bool)
        if self.decode_bytes(ids) != data.tobytes():
            same &= [self.decode(ids[a:b]).encode() == text for a, b, text in zip(offsets[:-1], offsets[1:], texts)]
        return ids, offsets, same

    def encode(self, text: str | None) -> list[int]:
        return self.encode_slice([(text or "").encode()])[0].tolist()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The surfaces of the pieces, with a space before each text."""
        ids = np.asarray(ids, dtype=np.int64)
        ends = self.surface_ends[ids]
        sizes = ends - np.where(ids > 0, self.surface_ends[ids - 1], 0)
        to = np.cumsum(sizes)
        total = int(to[-1]) if len(to) else 0
        return self.surface[np.arange(total) + np.repeat(ends - to, sizes)].tobytes()

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")[1:]


def _slices(column: pa.Array) -> Iterator[list[bytes]]:
    texts, held = [], 0
    for view in utf8_views(column):
        if texts and held + len(view) > SLICE_BYTES:
            yield texts
            texts, held = [], 0
        texts.append(view.tobytes())
        held += len(view)
    if texts:
        yield texts


def encode_pieces(docs: DataFrame, model: PieceModel, *, text: str = "text") -> DataFrame:
    """`docs` with piece_ids, n_pieces and round_trip (whether decoding gives the text back).

    The model's 32,000 or so pieces are broadcast; a map over rows, no shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<ids:array<int>,same:boolean>")
    def kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(held.value)
        for batch in batches:
            # a batch's results go slice by slice, so that no more is held than a slice's
            for texts in _slices(batch):
                ids, offsets, same = encoder.encode_slice(texts)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.StructArray.from_arrays([lists, pa.array(same)], ["ids", "same"])

    kernel = kernel.asNondeterministic()
    coded = docs.select(given(docs, "piece_ids", "n_pieces", "round_trip").alias("given"), kernel(column(text)).alias("encoded"))
    return coded.select("given.*", F.col("encoded.ids").alias("piece_ids"), F.size("encoded.ids").cast("bigint").alias("n_pieces"), F.col("encoded.same").alias("round_trip"))


def decode_pieces(ids: Column, model: PieceModel) -> Column:
    """The texts of arrays of piece ids; a null array decodes to null."""
    surface = model.surface

    @F.arrow_udf("string")
    def kernel(column: pa.Array) -> pa.Array:
        texts = [None if row is None else b"".join([surface[i] for i in row if i is not None and 0 <= i < len(surface)]).decode("utf-8", "replace")[1:] for row in column.to_pylist()]
        return pa.array(texts, pa.string())

    return kernel.asNondeterministic()(ids)
