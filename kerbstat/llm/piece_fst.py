"""SentencePiece encoding and decoding by a weighted transducer.

The transducer composes three parts: the normaliser (a word mark before the text, spaces to word marks),
the pieces (an arc per piece, from any state to the state named by the piece) and byte fallback (an arc per
character that is no piece, writing its bytes' pieces). Composed with a text it is a lattice over the text's
places, and the encoding is its shortest path in the tropical semiring.

Weights. In a unigram model an arc weighs minus its piece's score. A BPE model's encoding is no sum of
scores; there the weight of an arc depends on the state it leaves: nothing if merging the two pieces'
characters by the model's rules gives just these two pieces, infinity if not. A row of pieces is the BPE
encoding exactly if all its neighbours pass that test: merges inside a stretch do not depend on what stands
outside as long as none crosses its border, so the first crossing merge of the whole would also be one of
the two neighbours alone. Every prefix has one such row, so each place of the lattice has one state with a
finite weight. All finite paths weigh nothing: the first one to reach the end is the shortest. It is searched
depth first, long pieces first, and a place without a way on is not entered again.

No piece holds a word mark behind another character (this is checked), so paths through different words
are independent, and a text's path is that of its words in order. Tasks find the path of each distinct word
of a batch once and keep frequent ones. Decoding maps ids to bytes, word marks to spaces, and drops the
first space.

Nulls and edge cases: a null or empty text has no pieces and decodes to the empty text; a word mark in a
text decodes to a space; a null id is kept; repeated rows get a row each; an empty table gives no rows; a
text without spaces is one word, whatever its length; only the id and the text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from kerbstat.llm.common import slices

MARK = "▁"
#: Words, and tests of neighbours, that a worker keeps; bytes of text handled at once.
CACHE, TESTS, SLICE = 400_000, 1_000_000, 4 << 20


class PieceTransducer:
    """The transducer of one model file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces):
            raise ValueError("only the identity normaliser with a leading word mark is compiled")
        self.bpe = proto.trainer_spec.model_type == proto.trainer_spec.BPE
        model = SentencePieceProcessor(model_proto=proto.SerializeToString())
        kinds = [(model.is_control(i) or model.is_unknown(i), model.is_byte(i)) for i in range(model.vocab_size())]
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(kinds[i][1] for i in self.byte_ids):
            raise ValueError("the model has no byte fallback")
        names = [model.id_to_piece(i) for i in range(model.vocab_size())]
        self.ids = {name: i for i, (name, kind) in enumerate(zip(names, kinds, strict=True)) if not any(kind)}
        if any(MARK in name.lstrip(MARK) for name in self.ids):
            raise ValueError("a piece holds a word mark behind another character")
        self.weight = {name: -model.get_score(i) for name, i in self.ids.items()}
        self.unknown = max(self.weight.values()) + 10.0
        self.longest = max(map(len, self.ids))
        self.trie: dict = {}
        for name in self.ids:
            node = self.trie
            for c in name:
                node = node.setdefault(c, {})
            node[""] = True
        texts = [b"" if special else bytes([int(name[3:5], 16)]) if byte else name.replace(MARK, " ").encode() for name, (special, byte) in zip(names, kinds, strict=True)]
        self.is_byte = np.array([byte for _, byte in kinds])
        self.text_sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.text_begins = np.cumsum(self.text_sizes) - self.text_sizes
        self.text = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.arcs: dict[str, dict[str, bool]] = {}  # state -> piece -> whether its arc is open
        self.tested = 0
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, dtype=np.uint32)
        self.begins = np.zeros(1, dtype=np.int64)

    def merged(self, text: str) -> list[str]:
        """The model's merges carried out: the best pair first, of equal ones the leftmost."""
        parts = list(text)
        while True:
            pairs = [(w, i) for i in range(len(parts) - 1) if (w := self.weight.get(parts[i] + parts[i + 1])) is not None]
            if not pairs:
                return parts
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def neighbours(self, left: str, right: str) -> bool:
        """Whether the arc of ``right`` has a finite weight in the state of ``left`` ('' at the start)."""
        self.tested += 1
        return self.merged(left + right) == ([left, right] if left else [right])

    def path(self, word: str) -> list[int]:
        """Ids along the shortest path through the lattice of one word, its mark included."""
        pieces = self.unweighted(word) if self.bpe else self.weighted(word)
        ids = [self.ids.get(piece, -1) for piece in pieces]
        if -1 not in ids:
            return ids
        return [k for piece, i in zip(pieces, ids, strict=True) for k in ([i] if i >= 0 else [self.byte_ids[b] for b in piece.encode()])]

    def unweighted(self, word: str) -> list[str]:
        """The pieces of the path whose arcs all weigh nothing."""
        if self.tested > TESTS:
            self.arcs, self.tested = {}, 0
        n, arcs, ends_from = len(word), self.arcs, self.ends_from
        i, left, ends = 0, "", ends_from(word, 0)
        before: list[tuple[int, str, list[int]]] = []  # places passed: where, in which state, what is left to try
        closed: set[int] = set()
        while i < n:
            open_arcs = arcs.get(left)
            if open_arcs is None:
                open_arcs = arcs[left] = {}
            while ends:
                end = ends.pop()
                if end not in closed:
                    piece = word[i:end]
                    passed = open_arcs.get(piece)
                    if passed is None:
                        passed = open_arcs[piece] = self.neighbours(left, piece)
                    if passed:
                        break
            else:
                closed.add(i)
                i, left, ends = before.pop()
                continue
            before.append((i, left, ends))
            i, left, ends = end, piece, ends_from(word, end)
        return [left for _, left, _ in before[1:]] + [left] * (n > 0)

    def ends_from(self, word: str, i: int) -> list[int]:
        """Where the pieces that begin at a place end, the longest last; one character is always an arc."""
        ends, node, at = [i + 1], self.trie, i
        for c in word[i : i + self.longest]:
            node = node.get(c)
            if node is None:
                break
            at += 1
            if "" in node and at > i + 1:
                ends.append(at)
        return ends

    def weighted(self, word: str) -> list[str]:
        """The pieces of the path with the smallest sum of weights."""
        n = len(word)
        state, back, cost = [""] * (n + 1), [0] * (n + 1), [0.0] * (n + 1)
        for i in range(1, n + 1):
            best = None
            for j in range(max(0, i - self.longest), i):
                piece = word[j:i]
                known = piece in self.ids
                if not known and j < i - 1:
                    continue
                total = cost[j] + (self.weight[piece] if known else self.unknown)
                if best is None or total < best:
                    best = cost[i] = total
                    state[i], back[i] = piece, j
        pieces, at = [], n
        while at:
            pieces.append(state[at])
            at = back[at]
        return pieces[::-1]

    def words(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct words with their marks, the word at each place, and where each text's places begin."""
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        words, place = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        begins = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        marked = [MARK + w for w in words]
        if "" not in words and not any(MARK in w for w in words):
            return marked, place, begins
        # Runs of spaces, and marks in texts: put texts that have any together and cut them at each first mark.
        index = {w: i for i, w in enumerate(marked)}
        odd = np.array([not w or MARK in w for w in words])[place]
        rows, ends = [], [0]
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            own = place[a:b]
            if odd[a:b].any():
                whole = "".join(marked[i] for i in own) if b - a > 1 or words[own[0]] else ""
                own = np.array([index.setdefault(w, len(index)) for w in cut(whole)], dtype=np.int64)
            rows.append(own)
            ends.append(ends[-1] + len(own))
        return list(index), np.concatenate([np.zeros(0, np.int64), *rows]), np.array(ends)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's ids begin (one entry more than texts)."""
        words, place, begins = self.words(texts)
        if len(self.known) > CACHE:
            self.forget()
        fresh = [w for w in words if w not in self.known]
        lists = [self.path(w) for w in fresh]
        self.known |= {w: len(self.known) + k for k, w in enumerate(fresh)}
        self.begins = np.concatenate([self.begins, len(self.flat) + np.cumsum([len(x) for x in lists], dtype=np.int64)])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(lists), dtype=np.uint32)])
        index = np.array([self.known[w] for w in words], dtype=np.int64)
        return gathered(self.flat, self.begins[index][place], (self.begins[index + 1] - self.begins[index])[place], begins)

    def decode(self, ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the texts in a row, each still with its first space, and where each begins."""
        return gathered(self.text, self.text_begins[ids], self.text_sizes[ids], begins)


def cut(text: str) -> list[str]:
    """A normalised text cut before each word mark that follows another character."""
    words, at = [], 0
    for i in range(1, len(text)):
        if text[i] == MARK and text[i - 1] != MARK:
            words.append(text[at:i])
            at = i
    return words + [text[at:]] if text else []


def gathered(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``flat`` put in a row, and where those of each text begin."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    where = np.arange(ends[-1]) - np.repeat(ends[:-1] - first, sizes)
    return flat[where], ends[begins]


@lru_cache(maxsize=2)
def transducer(path: str) -> PieceTransducer:
    """One per worker process, kept between tasks."""
    return PieceTransducer(path)


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_pieces, n_byte_pieces, ids_crc32, decoded_crc32, round_trip[, ids])`` of every document.

    Checksums are of the ids as little-endian 32-bit numbers and of the decoded text's UTF-8;
    ``round_trip`` says whether the decoded text is the text itself (word marks read as spaces).
    """
    schema = "doc_id bigint, n_pieces bigint, n_byte_pieces bigint, ids_crc32 bigint, decoded_crc32 bigint, round_trip boolean" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_path)
        for whole in batches:
            for batch in slices(whole, 1, SLICE):
                texts = pc.fill_null(batch.column(1), "").cast(pa.string())
                ids, begins = machine.encode(texts)
                decoded, at = machine.decode(ids, begins)
                in_bytes = np.concatenate([[0], np.cumsum(machine.is_byte[ids])])
                little, data = ids.astype("<u4"), decoded.tobytes()
                rows = []
                for k, text in enumerate(texts.to_pylist()):
                    own = data[at[k] + 1 : at[k + 1]] if at[k] < at[k + 1] else b""
                    rows.append((zlib.crc32(little[begins[k] : begins[k + 1]].tobytes()), zlib.crc32(own), own == text.replace(MARK, " ").encode()))
                arrays = [
                    batch.column(0), pa.array(np.diff(begins)), pa.array(in_bytes[begins[1:]] - in_bytes[begins[:-1]]),
                    *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.bool_()))),
                ]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in schema.split(", ")])

    picked = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return picked.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model_path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``(doc_id, text)`` from arrays of ids; null ids give a null text, bytes that are no UTF-8 U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_path)
        for batch in batches:
            lists = batch.column(1)
            sizes = np.array(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
            begins = np.concatenate([[0], np.cumsum(sizes)])
            decoded, at = machine.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), begins)
            data, valid = decoded.tobytes(), lists.is_valid().to_pylist()
            texts = [data[at[k] : at[k + 1]].decode("utf-8", "replace").removeprefix(" ") if ok else None for k, ok in enumerate(valid)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    picked = encoded.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(ids_column).cast("array<int>").alias("ids"))
    return picked.mapInArrow(run, "doc_id bigint, text string")
