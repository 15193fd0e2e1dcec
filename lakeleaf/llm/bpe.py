"""Operator 2, byte-level BPE encoding and decoding.

A pre-token's greedy merges are found without running the merges: for every prefix of a word the *last token* of
that prefix's encoding is unique, and a token t can follow the encoding of the rest iff merging the bytes of
(last token of the rest, t) alone gives back exactly these two. The distinct words of a batch form a trie (held as
the sorted word list: a depth-first walk over the trie is a scan of that list with a stack as deep as the common
prefix). The stack holds the last-token state of every node on the path, so a shared prefix is worked out once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as Unicode's White_Space property, which the pattern's \s means there (a fixed value).
WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Code points that the pattern's engine here counts as letters or numbers, and the vocabulary's does not (fixed values).
LATE_LETTERS = (
    r"\U00000558\U0000058b-\U0000058c\U0000088f\U00000c5c\U00000cdc\U0000208f\U0000209d-\U0000209f\U0000a7ce-\U0000a7cf"
    r"\U0000a7d2\U0000a7d4\U0000a7dd\U0000a7e2\U0000a7f1\U0000ab6c-\U0000ab6d\U000107bb-\U000107bf\U00010940-\U00010959"
    r"\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3"
    r"\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    r"\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5"
    r"\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
LATE_NUMBERS = r"\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"


def word_pattern(letter: str, number: str) -> str:
    """The vocabulary's word pattern (a fixed value): contractions, letters, numbers, other signs, white space."""
    return rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?[^{WS}{letter}{number}]+|[{WS}]+(?![^{WS}])|[{WS}]+"


PLAIN = regex.compile(word_pattern(r"\p{L}", r"\p{N}"))
#: For texts with code points that the two tables see differently.
EXACT = regex.compile(word_pattern(rf"[\p{{L}}--[{LATE_LETTERS}]]", rf"[\p{{N}}--[{LATE_NUMBERS}]]"))
ODD = regex.compile(rf"[{LATE_LETTERS}{LATE_NUMBERS}]")


def words(text: str) -> list[str]:
    try:
        text.encode("latin-1")  # the quick test: the odd code points are far above
        return PLAIN.findall(text)
    except UnicodeEncodeError:
        return (EXACT if ODD.search(text) else PLAIN).findall(text)


#: Distinct words that a task remembers before it keeps only the last block's, which bounds its memory.
CACHE = 300_000
#: Pairs of tokens that it remembers.
PAIRS = 400_000
#: Characters of text whose words are learnt at once.
BLOCK = 8_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest
    take the code points from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {chr(b): b for b in own}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}


class Codec:
    """Encoder and decoder of one vocabulary file (the JSON text of a byte-level BPE)."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        letters = byte_alphabet()
        raw = lambda token: bytes(letters[c] for c in token)
        self.ids = {raw(token): i for token, i in data["model"]["vocab"].items()}
        self.bytes = {i: b for b, i in self.ids.items()}
        self.rank = {}
        for place, pair in enumerate(data["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[raw(left), raw(right)] = place
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.longest = max(map(len, self.ids))
        self.shift = max(self.bytes).bit_length()
        self.pairs: dict[int, bool] = {}  # left id << shift | id: whether id can stand after left in an encoding
        self.alone: dict[int, bool] = {}  # whether the bytes of a token are encoded as that one token
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # What is known of words: their ids as text, and what they decode to where that isn't the word itself.
        self.marks = {s: str(i) for s, i in self.special.items()}
        self.known: dict[str, str] = dict(self.marks)
        self.other: dict[str, bytes] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Plain BPE of a short string: the best-ranked pair first, from left to right among equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            place, at = min((self.rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if place == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, left: int, token: int) -> bool:
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        a, b = self.bytes[left], self.bytes[token]
        out = self.pairs[left << self.shift | token] = self.merged(a + b) == [a, b]
        return out

    def single(self, token: int) -> bool:
        if (out := self.alone.get(token)) is None:
            out = self.alone[token] = self.merged(self.bytes[token]) == [self.bytes[token]]
        return out

    def walk(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Depth-first over the trie of ``words``; yields each word with its ids."""
        ids, longest, known, shift = self.ids.get, self.longest, self.pairs.get, self.shift
        path, last, size = b"", [0], [0]  # last[n]: id of the last token of the encoding of path[:n]; size[n]: its bytes
        for data, word in sorted([(w.encode("utf-8"), w) for w in words]):
            n, most = 0, min(len(path), len(data))
            while n < most and path[n] == data[n]:
                n += 1
            del last[n + 1 :], size[n + 1 :]
            for end in range(n + 1, len(data) + 1):
                for start in range(end - longest if end > longest else 0, end):
                    if (token := ids(data[start:end])) is None:
                        continue
                    if start == 0:
                        if self.single(token):
                            break
                    else:
                        left = last[start]
                        ok = known(left << shift | token)
                        if ok or ok is None and self.follows(left, token):
                            break
                last.append(token)
                size.append(end - start)
            path = data
            out, end = [], len(data)
            while end:
                out.append(last[end])
                end -= size[end]
            yield word, out[::-1]

    def learn(self, words: set[str]) -> None:
        """Make ``known`` hold each of the words."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known = self.marks | {w: self.known[w] for w in words if w in self.known}
            self.other = {w: b for w, b in self.other.items() if w in words}
        for word, ids in self.walk(new):
            self.known[word] = ",".join(map(str, ids))
            if (back := self.decode_bytes(ids)) != word.encode("utf-8"):
                self.other[word] = back

    def forget(self) -> None:
        """Drop the words: the worker lives on, and what it holds is missing to the next step's tasks."""
        self.known, self.other = dict(self.marks), {}

    def decode_bytes(self, ids: list[int]) -> bytes:
        """Unknown ids give nothing."""
        return b"".join([self.bytes.get(i, b"") for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def pieces(self, text: str) -> list[str]:
        """Words in order. Strings of special tokens are cut out first; none of them can be a word of the pattern."""
        if self.split is None or not any(s in text for s in self.special):
            return words(text)
        parts = self.split.split(text)
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else words(part))]

    def encode(self, text: str) -> list[int]:
        found = self.pieces(text)
        ids = dict(self.walk([w for w in set(found) if w not in self.special])) | {s: [i] for s, i in self.special.items()}
        return [i for w in found for i in ids[w]]

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: tokens, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded text.

        Texts are taken in blocks, so what one block's words need is bounded."""
        at = 0
        while at < len(texts):
            block, chars = [], 0
            while at < len(texts) and (not block or chars + len(texts[at]) < BLOCK):
                chars += len(texts[at])
                block.append(texts[at])
                at += 1
            found = [self.pieces(t) for t in block]
            self.learn(set().union(*found))
            for parts in found:
                ids = ",".join(map(self.known.__getitem__, parts))
                if self.other and not self.other.keys().isdisjoint(parts):
                    text = b"".join([self.other.get(w) or w.encode("utf-8") for w in parts]).decode("utf-8", errors="replace")
                else:
                    text = "".join(parts)  # every word decodes to itself
                yield ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


_codecs: dict[int, Codec] = {}


def codec(spec: str) -> Codec:
    """One codec for each vocabulary and worker."""
    if (key := hash(spec)) not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(spec)
    return _codecs[key]


def bpe_digests(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256; one row per input row.

    ``vocabulary`` is the path of the tokenizer's JSON file on the driver; its text (a fixed size) goes to the
    workers by broadcast. A null text counts as empty and has no tokens. An empty table gives an empty result, other
    columns are ignored, repeated rows are repeated. A very long text is encoded whole; each of its distinct words is
    worked out once.
    """
    spec = docs.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(spec.value)
        for batch in batches:
            found = list(own.digests(batch["text"].tolist()))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [x[0] for x in found], "ids_sha256": [x[1] for x in found], "decoded_sha256": [x[2] for x in found]})
        own.forget()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_tokens(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``docs`` with the columns tokens (array<int>) and n_tokens, for training files. A null text has no tokens."""
    spec = docs.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        own = codec(spec.value)
        return texts.map(lambda t: own.encode(t or ""))

    return docs.withColumn("tokens", encode(F.coalesce(F.col(text), F.lit("")))).withColumn("n_tokens", F.size("tokens"))
