"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Texts go through the tokenizers library in pieces that no merge can cross; equal pieces of a task are
encoded once. A byte-level vocabulary spells every byte as a printable character; the table of that
spelling is rebuilt here from its rule, and decoding maps characters back to bytes.

Defined cases: a null text encodes as the empty text, and no ids decode to no bytes; repeated rows are
encoded alike; an empty table gives an empty result. Texts are encoded whole, of any length; a long
text is cut only where the split pattern cuts as well. A token may hold part of a character: its
offsets then cover the whole character, and decoding joins the bytes before it reads characters.
Bytes that do not form characters (from ids cut in the middle) become U+FFFD in decoded text. Binary that
is no row of ids decodes all the same: an id beyond the table, and a rest of fewer than four bytes, become
U+FFFD each.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Stands in decoded bytes for what is no id.
LOST = "\ufffd".encode()
#: Pieces remembered within a task; beyond it the memory starts anew.
REMEMBERED = 200_000
#: New pieces that go to the library as one text.
AT_ONCE = 16_384
#: Characters of text that are cut into pieces at a time.
CHARS_AT_ONCE = 1_000_000

_SPACE_BEFORE_SPACE = re.compile(r"\s ")
_codecs: dict[tuple[str, str], "Codec"] = {}


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def byte_spelling() -> list[str]:
    """The character that spells each byte: printable Latin-1 itself, others from U+0100 on in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spelled, beyond = [], 0x100
    for b in range(256):
        spelled.append(chr(b if b in printable else beyond))
        beyond += b not in printable
    return spelled


def read_ranks(path: str) -> list[bytes]:
    """The bytes of each id of a rank file."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for word, rank in pairs:
        out[int(rank)] = base64.b64decode(word)
    return out


class Codec:
    """Encoder and decoder of one rank file; made once in each Python worker."""

    def __init__(self, ranks_path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        self.bytes_of = read_ranks(ranks_path)
        spelled = byte_spelling()
        names = ["".join(map(spelled.__getitem__, b)) for b in self.bytes_of]
        id_of = {b: i for i, b in enumerate(self.bytes_of)}
        vocab = {name: i for i, name in enumerate(names)}
        merges = [pair for b in self.bytes_of if len(b) > 1 for pair in self._parents(b, id_of, names)]
        self.library = Tokenizer(models.BPE(vocab, merges))
        self.library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        #: Byte that a character spells.
        self.byte_of = {c: b for b, c in enumerate(spelled)}
        self.table = [bytes(map(self.byte_of.__getitem__, name)) for name in names]
        self.lengths = np.array([len(b) for b in self.table], dtype=np.int64)
        self.inner: dict[str, bytes] = {}

    @staticmethod
    def _parents(word: bytes, id_of: dict[bytes, int], names: list[str]) -> Iterator[tuple[str, str]]:
        """The merge that makes ``word``: what is left of its bytes when all earlier merges are done."""
        own, parts = id_of[word], [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 2:
            ranks = [id_of.get(parts[i] + parts[i + 1], own) for i in range(len(parts) - 1)]
            best = min(ranks)
            if best >= own:
                return
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        yield names[id_of[parts[0]]], names[id_of[parts[1]]]

    def _spell(self, pieces: list[str]) -> list[bytes]:
        """The ids of each text, encoded by itself."""
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.library.encode_batch_fast(pieces, add_special_tokens=False)]

    def _remember(self, new: list[str]) -> None:
        """Encode a space and each new piece. Those that end in no white space go to the library as one
        text, as the pattern cuts before the space of the next; token lengths in bytes tell them apart."""
        odd = [p for p in new if p == "" or p[-1].isspace()]
        self.inner.update(zip(odd, self._spell([f" {p}" for p in odd]), strict=True))
        plain = [p for p in new if not (p == "" or p[-1].isspace())]
        groups = [plain[at : at + AT_ONCE] for at in range(0, len(plain), AT_ONCE)]
        joined = [" " + " ".join(group) for group in groups]
        for group, ids in zip(groups, self._spell(joined), strict=True):
            ends = np.cumsum(self.lengths[np.frombuffer(ids, dtype="<u4")])
            sizes = np.fromiter((1 + (len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass"))) for p in group), dtype=np.int64, count=len(group))
            stops = (4 * (np.searchsorted(ends, np.cumsum(sizes)) + 1)).tolist()
            start = 0
            for piece, stop in zip(group, stops, strict=True):
                self.inner[piece] = ids[start:stop]
                start = stop

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return list(self.encoded(texts))

    def encoded(self, texts: list[str]) -> Iterator[bytes]:
        """As ``encode_batch``, a few texts at a time."""
        start, held = 0, 0
        for i, text in enumerate(texts, 1):
            held += len(text)
            if held >= CHARS_AT_ONCE or i == len(texts):
                yield from self._encode_some(texts[start:i])
                start, held = i, 0

    def _encode_some(self, texts: list[str]) -> list[bytes]:
        """The pattern always cuts before a space that follows no white space, so the parts between such
        spaces are encoded apart. Texts with white space before a space are cut only at the safe ones."""
        cuts = []
        for text in texts:
            parts = text.split(" ")
            if _SPACE_BEFORE_SPACE.search(text):
                parts = _rejoined(parts)
            cuts.append(parts)
        known = self.inner
        new = list({p for parts in cuts for p in parts[1:]} - known.keys())
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list({p for parts in cuts for p in parts[1:]})
        self._remember(new)
        heads = self._spell([parts[0] for parts in cuts])
        return [b"".join([head, *map(known.__getitem__, parts[1:])]) for head, parts in zip(heads, cuts, strict=True)]

    def decode(self, ids: bytes) -> bytes:
        rest = len(ids) % 4
        known = np.frombuffer(ids[: len(ids) - rest], dtype="<u4")
        if not rest and not (known >= len(self.table)).any():
            return b"".join(map(self.table.__getitem__, known.tolist()))
        return b"".join([*(self.table[i] if i < len(self.table) else LOST for i in known.tolist()), LOST if rest else b""])

    def offsets(self, ids: bytes, text: str) -> np.ndarray:
        """Start and end, in code points, of each token; a token with part of a character covers it."""
        at = np.frombuffer(ids, dtype="<u4")
        ends = np.cumsum(self.lengths[at])
        starts = ends - self.lengths[at]
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
        return np.stack([char_of[starts], char_of[ends - 1] + 1], axis=1) if len(at) else np.zeros((0, 2), dtype=np.int64)


def _rejoined(parts: list[str]) -> list[str]:
    """Parts that only spaces that follow no white space separate."""
    out = [parts[0]]
    for part in parts[1:]:
        before = out[-1]
        if before[-1:].isspace() or (before == "" and len(out) > 1):
            out[-1] = f"{before} {part}"
        else:
            out.append(part)
    return out


def codec(ranks_path: str, pattern: str) -> Codec:
    if (ranks_path, pattern) not in _codecs:
        _codecs[ranks_path, pattern] = Codec(ranks_path, pattern)
    return _codecs[ranks_path, pattern]


def decode_text(parts: Iterator[bytes]) -> Iterator[str]:
    """Text of byte parts in turn; a character split between parts comes with its last byte."""
    reader = codecs.getincrementaldecoder("utf-8")("replace")
    for part in parts:
        yield reader.decode(part)
    if rest := reader.decode(b"", final=True):
        yield rest


def encode(docs: DataFrame, text: str = "text", to: str = "ids", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with the ids of ``text`` as binary in column ``to`` (4 bytes each, little-endian)."""
    own_path, own_pattern = default_paths()
    path, split = ranks_path or own_path, pattern or own_pattern

    @F.pandas_udf("binary")
    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool = codec(path, split)
        for batch in batches:
            yield pd.Series(tool.encode_batch(batch.fillna("").tolist()), dtype=object)
        tool.inner.clear()

    return docs.withColumn(to, ids_of(F.col(text)))


def decode(docs: DataFrame, ids: str = "ids", to: str = "decoded", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with the bytes of ``ids`` in column ``to``."""
    own_path, own_pattern = default_paths()
    path, split = ranks_path or own_path, pattern or own_pattern

    @F.pandas_udf("binary")
    def bytes_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool = codec(path, split)
        for batch in batches:
            yield pd.Series([tool.decode(x or b"") for x in batch], dtype=object)

    return docs.withColumn(to, bytes_of(F.col(ids)))


def token_offsets(docs: DataFrame, text: str = "text", to: str = "offsets", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with [start, end) of each token in code points, flattened, in column ``to``."""
    own_path, own_pattern = default_paths()
    path, split = ranks_path or own_path, pattern or own_pattern

    @F.pandas_udf("array<int>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool = codec(path, split)
        for batch in batches:
            texts = batch.fillna("").tolist()
            yield pd.Series([tool.offsets(i, t).astype(np.int32).ravel() for i, t in zip(tool.encode_batch(texts), texts, strict=True)], dtype=object)

    return docs.withColumn(to, spans(F.col(text)))


def digest(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document: ids and decoded bytes are hashed
    where they are made, so that they need not leave the task."""
    own_path, own_pattern = default_paths()
    path, split = ranks_path or own_path, pattern or own_pattern

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tool = codec(path, split)
        for batch in batches:
            rows = [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(tool.decode(ids)).hexdigest()) for ids in tool.encoded(batch.fillna("").tolist())]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        tool.inner.clear()

    return docs.select("doc_id", hashed("text").alias("h")).select("doc_id", "h.*")
