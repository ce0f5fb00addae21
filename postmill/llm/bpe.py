"""Byte-level BPE of whole texts, with tree concatenation for long unsplit text.

A text is cut where the tokenizer's own splitting rule must cut whatever surrounds the place: at a space before a
character that is no white space. Pieces between such cuts are encoded once and remembered (a bounded cache).

What has no such cut is long unsplit text: one pre-token of many thousand bytes. Its halves are encoded apart and
concatenated as a tree. At each join a window of tokens around it is encoded again and grown until both sides
agree: the window's first token is the left half's token at that place, and its last token the right half's.
Then every two adjacent tokens occur adjacent in some correct encoding, and a sequence is the BPE encoding of its
bytes exactly if all its adjacent pairs are such, so the result is exact, not approximate.

Long documents are cut into blocks that become rows of their own, so that blocks of one text are encoded on
different executors; their ids meet again per document, as the text did in its row.

Whether a character is a letter, a digit or neither is known here for the ranges of KNOWN. Where a piece holds another one,
the tokenizers library itself splits that piece into pre-tokens; their ids come as all others do, long ones by the tree.

Nulls and edges: a null or empty text has no ids; a very long text, in any script, is many blocks; a null doc_id is kept;
repeated rows each return; an empty table gives no rows; other columns are ignored. The string of a special token in a
text is its id.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts longer than this many characters are encoded block by block.
BLOCK = 65_536
#: Pre-tokens longer than this many bytes are encoded as a tree of halves.
LEAF = 512
#: Remembered pieces of each process; about 60 MB. The memory is emptied when it is full.
CACHE = 400_000

#: The splitting rule of the vocabulary and its special token.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"
#: White space other than a space or line end; and what puts two white-space characters side by side.
_OTHER_SPACE = ("\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")
_SIDE_BY_SIDE = ("  ", " \n", "\n ", "\n\n")
_SAFE_CUT = re.compile(r" (?=\S)")
#: Characters outside these ranges are classed by the tokenizers library itself: Unicode tables differ between versions.
KNOWN = r"\x00-ɏͰ-ͳ΄-ΊΎ-ΡΣ-ϿЀ-҂‐-‧‰-⁞€ぁ-ゖァ-ヺ一-龥가-힣"
_ODD = re.compile(f"[^{KNOWN}]")
#: A place to cut that needs no class of an odd character: a space before a known character that is no white space.
_SURE_CUT = re.compile(rf" (?=[{KNOWN}])(?=\S)")


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Memory(dict):
    """Ids, as bytes, of pieces after `lead`."""

    def __init__(self, codec: Codec, lead: str):
        self.codec, self.lead = codec, lead

    def __missing__(self, piece: str) -> bytes:
        ids = self.codec.encode_piece(self.lead + piece)
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encodes and decodes as the tokenizers library does with the same vocabulary file."""

    _loaded: dict[str, Codec] = {}

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # The byte-level alphabet of such files: printable bytes stand for themselves, the others follow from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.special = self.library.token_to_id(SPECIAL)
        ranks = {bytes(chars[c] for c in token): i for token, i in vocabulary.items() if i != self.special}
        self.fast = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: self.special})
        self.pattern = regex.compile(PATTERN)
        self.first, self.rest = _Memory(self, ""), _Memory(self, " ")
        self.line_end = self.encode_piece("\n")

    @classmethod
    def load(cls, path: str) -> Codec:
        """One codec for each process and file."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if SPECIAL in text:
            special = np.uint32(self.special).tobytes()
            return special.join(self.encode(part) for part in text.split(SPECIAL))
        out: list[bytes] = []
        if text[:1] == "\n" or text[-1:] in (" ", "\n") or any(w in text for w in _SIDE_BY_SIDE) or any(w in text for w in _OTHER_SPACE):
            for i, piece in enumerate(_SAFE_CUT.split(text)):
                out.append((self.rest if i else self.first)[piece])
            return b"".join(out)
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append(self.line_end)
            head, *tail = line.split(" ")
            out.append(self.first[head])
            out.extend(map(self.rest.__getitem__, tail))
        return b"".join(out)

    def pre_tokens(self, text: str, at: int, end: int) -> Iterator[tuple[int, int]]:
        """Begin and end of each pre-token of text[at:end], which begins and ends with pre-tokens of the text."""
        part = text[at:end]
        if part.isascii() or not _ODD.search(part):
            for m in self.pattern.finditer(text, at, end):
                yield m.span()
        else:
            for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part):
                yield at + a, at + b

    def encode_piece(self, piece: str) -> bytes:
        if len(piece) <= LEAF // 4:
            if not piece.isascii() and _ODD.search(piece):
                return _packed(self.library.encode(piece, add_special_tokens=False).ids)
            return _packed(self.fast.encode_ordinary(piece))
        return _packed([i for a, b in self.pre_tokens(piece, 0, len(piece)) for i in self.tree(piece[a:b].encode("utf-8", "surrogatepass"))])

    def tree(self, run: bytes) -> list[int]:
        """Ids of the bytes of one pre-token, by concatenation of halves."""
        if len(run) <= LEAF:
            return self.fast._encode_single_piece(run)
        half = len(run) // 2
        return self.join(self.tree(run[:half]), self.tree(run[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded neighbours in one pre-token, by a growing window around the join."""
        if not left or not right:
            return left or right
        k = 4
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            window = self.fast._encode_single_piece(self.fast.decode_bytes(left[i:] + right[:j]))
            if (i == 0 or window[0] == left[i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[:i] + window + right[j:]
            k *= 2

    def decode(self, ids: bytes) -> str:
        return self.fast.decode_bytes(np.frombuffer(ids, dtype="<u4").tolist()).decode("utf-8", "replace")

    def blocks(self, text: str, block: int) -> Iterator[tuple[str, bool]]:
        """Pieces of a long text in order; True if a piece continues the pre-token of the one before.

        A block that is cut inside a pre-token holds that pre-token only.
        """
        for i, part in enumerate(text.split(SPECIAL)):
            if i:
                yield SPECIAL, False
            at = 0
            while len(part) - at > block:
                sure = list(_SURE_CUT.finditer(part, at + block // 2, at + block + 1))
                if sure:
                    cut = sure[-1].start()
                else:
                    # No sure cut: up to the next one the pre-tokens themselves are gone through. One of white space may
                    # be another one without the text after it: no cut behind it.
                    run = _SURE_CUT.search(part, at + block)
                    whole, width = run.start() if run else len(part), 2 * block
                    while True:
                        end, cut, first = min(whole, at + width), at, 0
                        for a, b in self.pre_tokens(part, at, end):
                            first = first or b
                            if b > at + block:
                                break
                            if not part[b - 1].isspace():
                                cut = b
                        if first < end or end == whole:
                            break
                        width *= 2  # the pre-token here may go on behind the window
                    if cut == at:  # the pre-token here has to stand alone
                        for k in range(at, first, block):
                            yield part[k : min(k + block, first)], k > at
                        at = first
                        continue
                yield part[at:cut], False
                at = cut
            if at < len(part):
                yield part[at:], False


def _digests(codec: Codec, ids: bytes) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids).encode("utf-8", "replace")).hexdigest()


def encode_documents(docs: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.load(path)
        for b in batches:
            found = [_digests(codec, codec.encode(t)) for t in b["text"]]
            out = pd.DataFrame(found, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").array)
            yield out

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.load(path)
        for b in batches:
            for doc_id, h, copies, text in zip(b["doc_id"].astype("Int64"), b["h"], b["copies"], b["text"]):
                pieces = list(codec.blocks(text, block))
                glued = [g for _, g in pieces]
                yield pd.DataFrame({"doc_id": pd.array([doc_id] * len(pieces), dtype="Int64"), "h": h, "copies": copies, "block": range(len(pieces)), "glued": glued, "next_glued": [*glued[1:], False], "piece": [p for p, _ in pieces]})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.load(path)
        for b in batches:
            raw = b["glued"] | b["next_glued"]
            yield pd.DataFrame(
                {
                    "doc_id": b["doc_id"].astype("Int64"),
                    "h": b["h"],
                    "copies": b["copies"],
                    "block": b["block"],
                    "glued": b["glued"],
                    "ids": [_packed(codec.tree(p.encode("utf-8", "surrogatepass"))) if r else codec.encode(p) for p, r in zip(b["piece"], raw)],
                }
            )

    def concatenate(group: pd.DataFrame) -> pd.DataFrame:
        codec = Codec.load(path)
        parts = group.sort_values("block")
        ids = concatenate_blocks(codec, list(zip(parts["ids"], parts["glued"])))
        n, a, c = _digests(codec, ids)
        doc_id = pd.array([group["doc_id"].iloc[0]], dtype="Int64")
        return pd.DataFrame({"doc_id": doc_id, "n_tokens": n, "ids_sha256": a, "decoded_sha256": c, "copies": group["copies"].iloc[0]})

    short = rows.where(F.length("text") <= block).mapInPandas(whole, schema)
    # A long text that is there several times under one id (null ids are one) is encoded once.
    long = rows.where(F.length("text") > block).groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    pieces = long.mapInPandas(split, "doc_id long, h long, copies long, block long, glued boolean, next_glued boolean, piece string")
    dealt = pieces.repartition(F.col("doc_id"), F.col("h"), F.col("block"))
    ids = dealt.mapInPandas(encode, "doc_id long, h long, copies long, block long, glued boolean, ids binary")
    found = ids.groupBy("doc_id", "h").applyInPandas(concatenate, f"{schema}, copies long")
    # Rows again: thousands at a time, so no array grows with the copies of a hot text.
    dozens = found.withColumn("left", F.explode(F.sequence(F.col("copies"), F.lit(1), F.lit(-4096))))
    each = dozens.withColumn("one", F.explode(F.sequence(F.lit(1), F.least(F.col("left"), F.lit(4096)).cast("int"))))
    return short.unionByName(each.select(short.columns))


def concatenate_blocks(codec: Codec, blocks: list[tuple[bytes, bool]]) -> bytes:
    """Ids of a text from those of its blocks. Blocks of one pre-token are joined in pairs, so the tree is as deep
    as the logarithm of their number; everything else only follows on."""
    runs: list[list[bytes]] = []
    for ids, glued in blocks:
        runs[-1].append(ids) if glued else runs.append([ids])
    out = []
    for run in runs:
        level = [np.frombuffer(x, dtype="<u4").tolist() for x in run] if len(run) > 1 else []
        while len(level) > 1:
            level = [codec.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        out.append(_packed(level[0]) if level else run[0])
    return b"".join(out)
