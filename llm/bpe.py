"""BPE encoding and decoding with the vocabulary of a public tokenizer file.

Text is normalized (NFC, runs of white space to one space, lower case), cut into pieces, and each piece is
merged by its own: symbols form a doubly linked list, a priority queue holds the ranks of adjacent pairs, and
an entry whose pair no longer stands there is skipped when it is taken out. Decoding concatenates vocabulary
strings in the way the file's format does without a decoder section: token strings joined by one space.

Pieces are kept with their ids in a cache of bounded size per worker, so frequent words are merged once.

Defined cases: null and empty texts have no tokens and decode to an empty text; control strings of the
vocabulary (such as `<|endoftext|>`) are tokens of their own; any length of text is encoded whole; repeated
rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from llm.registry import query, table
from tagloom.session import spread

# Pieces whose ids a worker remembers, in each of two generations; the older one goes when the younger is full.
CACHE_PIECES = 250_000

_loaded: dict[str, "Bpe"] = {}


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0
    for byte in range(256):
        out.append(chr(byte) if byte in plain else chr(256 + extra))
        extra += byte not in plain
    return out


class Bpe:
    """Encoder and decoder for a file of the word-end kind (`</w>`), as JSON."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        vocab = self.vocab
        # (left id, right id) -> (rank, id of the merged symbol)
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        special = {token["content"]: token["id"] for token in spec["added_tokens"]}
        self.special = special
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.tokens = {i: token for token, i in {**vocab, **special}.items()}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split)
        self.symbols = _byte_symbols()
        # One id per byte, inside a piece and at its end.
        self.inner = [vocab[s] for s in self.symbols]
        self.last = [vocab[s + self.suffix] for s in self.symbols]
        self.symbol_bytes = {symbol: byte for byte, symbol in enumerate(self.symbols)}
        self.rules = Tokenizer.from_file(path)
        self.assigned: set[str] = set()
        self.young: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}

    def normalize(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        # Letter by letter, so a final sigma is treated like any other.
        return text.lower() if "Σ" not in text else "σ".join(part.lower() for part in text.split("Σ"))

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece, given as bytes."""
        ids = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            found = merges.get((ids[i], ids[i + 1]))
            if found:
                queue.append((found[0], i, found[1]))
        heapq.heapify(queue)
        while queue:
            rank, i, merged = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            found = merges.get((ids[i], ids[j]))
            if not found or found[0] != rank:
                continue  # stale: one side was merged since
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merges.get((merged, ids[k]))
                if found:
                    heapq.heappush(queue, (found[0], i, found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((ids[h], merged))
                if found:
                    heapq.heappush(queue, (found[0], h, found[1]))
        return [i for i in ids if i >= 0]

    def pieces_of(self, text: str) -> list[list[int]]:
        """Ids of the pieces of a text without control strings, by chunks between blanks."""
        if not text.isascii() and self.has_young_letters(text):
            # Letters younger than Python's tables: normalized and cut by the tokenizer file's own rules.
            text = self.rules.normalizer.normalize_str(text)
            pieces = [p for p, _ in self.rules.pre_tokenizer.pre_tokenize_str(text)]
            return [self.merge(bytes(map(self.symbol_bytes.__getitem__, p))) for p in pieces]
        out, young, old = [], self.young, self.old
        for chunk in self.normalize(text).replace("\n", " ").split(" "):
            ids = young.get(chunk)
            if ids is None:
                ids = old.get(chunk)
                if ids is None:
                    ids = [i for piece in self.pieces.findall(chunk) for i in self.piece(piece)]
                if len(chunk) <= 64:
                    self.remember(chunk, ids)
                    young, old = self.young, self.old
            out.append(ids)
        return out

    def has_young_letters(self, text: str) -> bool:
        """Does it have code points that Python's Unicode tables don't know?"""
        new = set(text) - self.assigned
        self.assigned |= {c for c in new if unicodedata.category(c) != "Cn"}
        return bool(new - self.assigned)

    def piece(self, piece: str) -> list[int]:
        ids = self.young.get(piece) or self.old.get(piece)
        if ids is None:
            ids = self.merge(piece.encode("utf-8"))
            if len(piece) <= 64:
                self.remember(piece, ids)
        return ids

    def remember(self, piece: str, ids: list[int]):
        if len(self.young) >= CACHE_PIECES:
            self.young, self.old = {}, self.young
        self.young[piece] = ids

    def encode(self, text: str | None) -> array:
        if not text:
            return array("I")
        parts = [text]
        if any(token in text for token in self.special):
            parts = self.special_pattern.split(text)
        out: list[int] = []
        for place, part in enumerate(parts):
            if place % 2:
                out.append(self.special[part])
            elif part:
                for ids in self.pieces_of(part):
                    out += ids
        return array("I", out)

    def decode(self, ids) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


def load(path: str) -> Bpe:
    """The tokenizer of a file, read once per worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def _encode(batches, path):
    bpe = load(path)
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.slice(at, 64)
            ids = [bpe.encode(text) for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array([bpe.decode(x) for x in ids], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )


def _digest(batches):
    for batch in batches:
        ids = batch.column("ids")
        raw = ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
        offsets = ids.offsets.to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("n_tokens"),
                pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(offsets, offsets[1:])]),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in batch.column("decoded").to_pylist()]),
            ],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """`<doc_id, n_tokens, ids, decoded>` for every text of `<doc_id, text>`."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        lambda batches: _encode(batches, path), f"doc_id {kind}, n_tokens bigint, ids array<int>, decoded string"
    )


def encoded_digests(documents: DataFrame, path: str) -> DataFrame:
    """`<doc_id, n_tokens, ids_sha256, decoded_sha256>` from the same encoding, without moving ids and texts.

    Ids count as little-endian unsigned 32-bit integers, texts as UTF-8.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        lambda batches: _digest(_encode(batches, path)),
        f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_bpe")
def op2_bpe(spark, folder):
    documents = spread(table(spark, folder, "documents", "doc_id", "text"))
    return encoded_digests(documents, vocabulary_path())
