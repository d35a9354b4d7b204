"""Byte-level BPE with content-defined chunk reuse, and its decoding.

A rolling hash over the UTF-8 bytes cuts a text into chunks whose limits depend on the content
near them only, so copies and edited copies share most chunks wherever they stand. Each chunk, and each
text of one chunk, is encoded once by a worker, across all documents it is given, and looked up from
then on, as long as it stays in the worker's bounded cache; sharing over workers would shuffle the texts. Tokens at a chunk's ends depend on what stands
beyond them, so a join is repaired: the text from the last sure limit of the left chunk to the
first sure limit of the right one is encoded again, taking in further chunks until both sides
agree on a limit. A sure limit is a single space between two other non-space characters: the
vocabulary's splitting pattern begins a piece there whatever stands around it, and no merge and no
special token crosses it. The ids are therefore those of the whole text.

The merges run in the tiktoken library on the vocabulary read from a tokenizers JSON file; the
tests hold both libraries against each other, over every code point among others. A stretch that its
pattern engine refuses (a run of some million spaces) goes to the tokenizers library itself.

Defined cases: a null text counts as empty; an empty text has no tokens and decodes to ""; a
special token's string in a text becomes its id, as in the tokenizers library; texts of any length
are encoded whole; repeated rows give repeated rows; an empty table gives an empty table; columns
other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from citelake.llm.common import map_texts, read_table

WINDOW_STEPS = (1, 2, 4, 8)  # a rolling hash over 16 bytes
CHUNK_BITS = 9  # chunks of 512 bytes on average
CACHE_BYTES = 16 << 20  # of chunk text kept by a worker; beyond it the cache starts afresh
_SURE = re.compile(rb"(?<=[!-~\x80-\xff]) (?=[!-~\x80-\xff])")  # ASCII space between non-space bytes
#: Unicode spaces in UTF-8 begin or end with these bytes; a limit beside one isn't sure.
_ODD_LEFT = re.compile(rb"(?:\xc2[\x80-\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\xaf]|\xe2\x81[\x9f-\xa0]|\xe3\x80\x80)$")
_ODD_RIGHT = re.compile(rb"\xc2[\x80-\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\xaf]|\xe2\x81[\x9f-\xa0]|\xe3\x80\x80")
#: Fixed splitting pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes and decodes texts with one vocabulary file; keeps a bounded cache of chunks."""

    def __init__(self, vocabulary: bytes, chunk_bits: int = CHUNK_BITS, cache_bytes: int = CACHE_BYTES):
        import tiktoken

        self.vocabulary = vocabulary
        file = json.loads(vocabulary)
        special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
        self.engine = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.bytes_of = [b""] * (1 + max([*ranks.values(), *special.values()]))
        for token, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
            self.bytes_of[i] = token
        self.mask, self.cache_bytes = np.uint32((1 << chunk_bits) - 1), cache_bytes
        self.gear = np.random.default_rng(10).integers(0, 1 << 32, 256, dtype=np.uint32)
        self.cache: dict[bytes, tuple] = {}
        self.kept = self.asked = self.reused = 0

    def _encode(self, text: bytes) -> list[int]:
        if not text:
            return []
        try:
            return self.engine.encode(text.decode("utf-8"), allowed_special="all")
        except ValueError:
            return self.plain.encode(text.decode("utf-8"), add_special_tokens=False).ids

    @cached_property
    def plain(self):
        from tokenizers import Tokenizer

        made = Tokenizer.from_buffer(self.vocabulary)
        made.no_padding()
        made.no_truncation()
        return made

    def cuts(self, data: bytes) -> list[int]:
        """Ends of the chunks, by a gear hash of the 16 bytes before; never inside a character."""
        n = len(data)
        if n <= 16:
            return [n]
        x = np.frombuffer(data, dtype=np.uint8)
        h = self.gear[x]
        for step in WINDOW_STEPS:
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        at = np.flatnonzero((h & (self.mask << np.uint32(16))) == 0) + 1
        at = at[at < n]
        return [*at[(x[at] & 0xC0) != 0x80].tolist(), n]

    def chunk(self, data: bytes) -> tuple | None:
        """(head, ids between the first and last sure limit, tail); None where there are not two."""
        self.asked += 1
        if (found := self.cache.get(data, self)) is not self:
            self.reused += 1
            return found
        sure = _sure_limits(data)
        made = None
        if sure and sure[0] < sure[1]:
            made = data[: sure[0]], array("I", self._encode(data[sure[0] : sure[1]])), data[sure[1] :]
        return self._keep(data, made)

    def _keep(self, key: bytes, made: object) -> object:
        self.kept += len(key)
        if self.kept > self.cache_bytes:
            self.cache.clear()
            self.kept = len(key)
        self.cache[key] = made
        return made

    def _alone(self, data: bytes) -> list[int]:
        """The ids of a text of one chunk."""
        self.asked += 1
        found = self.cache.get(key := b"\0text " + data)
        if found is not None:
            self.reused += 1
            return list(found)
        return list(self._keep(key, array("I", self._encode(data))))

    def encode(self, text: str | None) -> list[int]:
        data = (text or "").encode("utf-8")
        ids: list[int] = []
        start, join = 0, b""
        ends = self.cuts(data)
        if len(ends) == 1:
            return self._alone(data)
        for end in ends:
            found = self.chunk(piece := data[start:end])
            start = end
            if found is None:  # no agreement inside this chunk: the join takes all of it in
                join += piece
                continue
            head, core, tail = found
            ids += self._encode(join + head)
            ids.extend(core)
            join = tail
        return ids + self._encode(join)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _sure_limits(data: bytes) -> tuple[int, int] | None:
    """The first and the last sure limit in a chunk."""

    def good(at: int) -> bool:
        return not _ODD_RIGHT.match(data, at + 1) and not _ODD_LEFT.search(data[max(0, at - 3) : at])

    first = next((m.start() for m in _SURE.finditer(data) if good(m.start())), None)
    if first is None:
        return None
    at = len(data)
    while (at := data.rfind(b" ", 0, at)) > first:
        if _SURE.match(data, at) and good(at):
            return first, at
    return first, first


def ids_and_text(encoder: Encoder, texts: list[str | None]) -> dict[str, list]:
    """The operator's own outputs: ids and the text decoded from them."""
    ids = [encoder.encode(t) for t in texts]
    return {"ids": ids, "decoded": [encoder.decode(i) for i in ids]}


def digests(encoder: Encoder, texts: list[str | None]) -> dict[str, list]:
    """n_tokens and digests of the same ids and decoded texts, made where they are made."""
    out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
    names = [str(i) for i in range(len(encoder.bytes_of))]
    for text in texts:
        ids = encoder.encode(text)
        out["n_tokens"].append(len(ids))
        out["ids_sha256"].append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
        out["decoded_sha256"].append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
    return out


def vocabulary_bytes(path: str | None = None) -> bytes:
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), "rb") as file:
        return file.read()


def bpe(
    docs: DataFrame,
    vocabulary: bytes,
    id_column: str = "doc_id",
    text_column: str = "text",
    emit: Callable[[Encoder, list], dict[str, list]] = ids_and_text,
    schema: str = "ids array<int>, decoded string",
) -> DataFrame:
    """id_column and what emit makes of each text; no shuffle. vocabulary (fixed size) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make() -> Callable[[list], dict[str, list]]:
        encoder = Encoder(shared.value)
        return lambda texts: emit(encoder, texts)

    return map_texts(docs, id_column, text_column, schema, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return bpe(docs, vocabulary_bytes(), emit=digests, schema="n_tokens long, ids_sha256 string, decoded_sha256 string")
