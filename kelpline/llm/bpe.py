"""Operator 1: byte-pair encoding and decoding by a prefix-sharing trie.

A BPE encoding has two properties that make a trie useful: every prefix of a word has one encoding, and a token
sequence is the encoding of its text exactly when each pair of neighbours is *compatible* (merging their joined
text gives the pair back). So the encoding of a prefix is known from its **last token** alone: it is the one token
that ends the prefix and is compatible with the last token of the prefix before it. The distinct words of a slice of
texts form a trie; a depth-first walk hands the last-token states from a node to its children (with the state of a
matcher that lists the tokens ending there), and the encoding of a prefix that many words share is computed once. Sorted words visit the nodes of their trie in depth-first order, so
only the states of the path from the root to the current node are held.

Edge cases: a null text counts as empty and has no tokens; an empty text decodes to an empty text; very long texts
and words take time in proportion to their length; repeated rows give repeated results; an empty table gives an empty
result; only the id and text columns are read, so other columns may have any name; a null id stays null.
"""

from __future__ import annotations

import functools
import gc
import itertools
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import resting, slices, turn_of

#: Entries of a worker's memories; a full one is emptied but for what is used just then, which changes no result.
MEMORY = 700_000
#: Longer words and runs, such as encoded data, are not remembered after their slice, so entries bound the bytes too.
LONGEST = 48

#: Above this the plain path below does not know a character's class; such texts go through the library's own splitter.
_ODD = re.compile("[\x1c-\x1fİ]|[^\x00-ɏ‐-‧€]")
_END = 511  # stands for the word end; the byte-level alphabet ends before it
_SPACE = re.compile("[\t-\r \x85\xa0]+")


def _plain(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not _ODD.search(text)
    return not ("\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text)


def _plain_class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


def _byte_table() -> dict[int, str]:
    """The usual byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """Encoder and decoder of one tokenizers JSON file with a word-end suffix and a byte-level alphabet."""

    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.memory = memory
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.library = Tokenizer.from_file(path)
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens") or ()}
        self.special_split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.strings: list[str] = [""] * size
        for string, number in [*self.vocab.items(), *self.special.items()]:
            self.strings[number] = string
        self.packed = [np.uint32(i).astype("<u4").tobytes() for i in range(size)]
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            whole = self.vocab[left + right if not self.suffix else left.removesuffix(self.suffix) + right]
            a, b = self.vocab[left], self.vocab[right]
            self.rank.setdefault(a << 20 | b, rank)
            self.parts.setdefault(whole, (a, b, rank))
        self._build_matcher()
        self.right_edges: dict[int, list[tuple[int, int]]] = {}
        self.left_edges: dict[int, list[tuple[int, int]]] = {}
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        letters, digits = _plain_class("L"), _plain_class("N")
        self.plain_words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{letters}{digits}]+")
        self.bytes_as_text = str.maketrans({chr(b): c for b, c in _byte_table().items()})

    def _edges(self, token: int, side: int, memory: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int]]:
        """The symbols that stand at one edge of a token while it is merged, each with the rank that consumes it."""
        found = memory.get(token)
        if found is None:
            found, end, at = [], 1 << 30, token
            while True:
                found.append((at, end))
                if at not in self.parts:
                    break
                end, at = self.parts[at][2], self.parts[at][side]
            memory[token] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined text of two tokens gives the same two tokens: no merge across the border comes
        before the merge that consumes either of its sides (a tie goes to the merge further left)."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            known, rank = True, self.rank
            ys = self._edges(right, 0, self.left_edges)
            for x, x_end in self._edges(left, 1, self.right_edges):
                for y, y_end in ys:
                    r = rank.get(x << 20 | y)
                    if r is not None and r < x_end and r <= y_end:
                        known = False
                        break
                if not known:
                    break
            if len(self.pairs) >= 4 * self.memory:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def _build_matcher(self) -> None:
        """Which tokens end at a node of a word trie: the states of an Aho-Corasick matcher of all tokens, longest first. The
        word end counts as one more character, and a token without merges is no result unless it is one character."""
        self.next: dict[int, int] = {}
        children: list[list[tuple[int, int]]] = [[]]
        own = [-1]
        for string, token in self.vocab.items():
            ends = bool(self.suffix) and string.endswith(self.suffix)
            text = string.removesuffix(self.suffix) if ends else string
            if not text or len(text) > 1 and token not in self.parts or ord(max(text)) >= _END:
                continue
            state = 0
            for c in [*map(ord, text), *([_END] if ends else [])]:
                key = state << 9 | c
                if key not in self.next:
                    self.next[key] = len(own)
                    children[state].append((c, len(own)))
                    children.append([])
                    own.append(-1)
                state = self.next[key]
            own[state] = token
        self.fail, depth = [0] * len(own), [0] * len(own)
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(own)
        queue = [0]
        for state in queue:
            for c, child in children[state]:
                depth[child] = depth[state] + 1
                back = self.fail[state]
                while back and back << 9 | c not in self.next:
                    back = self.fail[back]
                self.fail[child] = self.next.get(back << 9 | c, 0) if state else 0
                queue.append(child)
            if own[state] >= 0:
                self.ending[state] = ((depth[state], own[state]), *self.ending[self.fail[state]])
            else:
                self.ending[state] = self.ending[self.fail[state]]

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids (little-endian unsigned 32-bit) of distinct non-empty words in the byte-level alphabet."""
        pairs, compatible, step, fail, ending = self.pairs, self.compatible, self.next, self.fail, self.ending
        out: dict[str, bytes] = {}
        packed = self.packed.__getitem__
        # of the prefix of each length on the current path: its last token, where that begins, and the matcher's state
        tokens, starts, states = [-1], [0], [0]
        before, marked = "", bool(self.suffix)
        for word in sorted(words):
            n, shared = len(word), 0
            for a, b in zip(word[: n - 1], before, strict=False):
                if a != b:
                    break
                shared += 1
            shared = min(shared, len(tokens) - 1)
            del tokens[shared + 1 :], starts[shared + 1 :], states[shared + 1 :]
            state = states[shared]
            for depth in range(shared + 1, n + 1):
                c = ord(word[depth - 1])
                while (key := state << 9 | c) not in step:
                    state = fail[state]
                state = step[key]
                base = depth
                if depth == n and marked:
                    while (key := state << 9 | _END) not in step:
                        state = fail[state]
                    state = step[key]
                    base = depth + 1
                for length, token in ending[state]:
                    start = base - length
                    if start == 0:
                        break
                    fits = pairs.get(tokens[start] << 20 | token)
                    if fits or fits is None and compatible(tokens[start], token):
                        break
                else:
                    raise ValueError(f"no token ends {word[:depth]!r}")
                tokens.append(token)
                starts.append(start)
                states.append(state)
            ids, at = [], n
            while at:
                ids.append(tokens[at])
                at = starts[at]
            ids.reverse()
            out[word] = b"".join(map(packed, ids))
            tokens.pop()  # the last node carries the word end: a child of the path, and never shared
            starts.pop()
            states.pop()
            before = word
        return out

    def _byte_text(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.bytes_as_text)

    def _split(self, text: str) -> list[str]:
        """Words, in the byte-level alphabet, of a piece without special tokens whose classes are not plain."""
        text = self.library.normalizer.normalize_str(text)
        return [word for word, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text, as little-endian unsigned 32-bit integers; the texts' distinct words share one trie."""
        collects = gc.isenabled()
        gc.disable()  # many lists and no cycles: searching for cycles would take a fifth of the time
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        plans: list[list[int | list[str]]] = []
        odd: set[str] = set()
        fresh: set[str] = set()
        chunks, words = self.chunks, self.words
        for text in texts:
            plan: list[int | list[str]] = []
            plans.append(plan)
            at = 0
            marks = [(m.start(), m.end(), self.special[m[0]]) for m in self.special_split.finditer(text)] if text and "<|" in text or text and self.special and not all("<|" in x for x in self.special) else []
            for start, end, token in [*marks, (len(text or ""), 0, -1)]:
                piece = (text or "")[at:start]
                at = end
                if piece:
                    if _plain(piece):
                        parts = _SPACE.split(piece.lower()) if "\x85" in piece or "\xa0" in piece else piece.lower().split()
                        fresh.update(parts)
                    else:
                        parts = ["☃" + x for x in self._split(piece)]  # no plain chunk holds that character
                        odd.update(parts)
                    plan.append(parts)
                if token >= 0:
                    plan.append(token)
        if len(chunks) > self.memory or len(words) > self.memory:  # what this slice has in common with those before stays
            kept = {x: chunks[x] for x in itertools.chain(fresh, odd) if x in chunks}
            chunks.clear()
            words.clear()
            chunks.update(kept)
        fresh = {x for x in fresh if x not in chunks}
        fresh.discard("")
        odd = {x for x in odd if x not in chunks}
        found = {chunk: [w if w.isascii() and w.isprintable() else self._byte_text(w) for w in ([chunk] if chunk.isalpha() else self.plain_words.findall(chunk))] for chunk in fresh}
        found |= {chunk: [chunk[1:]] for chunk in odd}
        words |= self.encode_words({w for parts in found.values() for w in parts if w not in words})
        for chunk, parts in found.items():
            chunks[chunk] = words[parts[0]] if len(parts) == 1 else b"".join(map(words.__getitem__, parts))
        chunks[""] = b""
        get = chunks.__getitem__
        out = [b"".join(b"".join(map(get, x)) if isinstance(x, list) else self.packed[x] for x in plan) for plan in plans]
        for chunk in found:
            if len(chunk) > LONGEST:
                for word in {chunk: 0, **dict.fromkeys(found[chunk], 0)}:
                    if len(word) > LONGEST:
                        chunks.pop(word, None)
                        words.pop(word, None)
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included, as the library's decode gives it for this file."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.library.decoder is not None:
            return self.library.decode(numbers, skip_special_tokens=False)
        return " ".join(map(self.strings.__getitem__, numbers))


@functools.lru_cache(maxsize=1)
def _loaded(path: str, memory: int) -> WordBpe:
    return WordBpe(path, memory)


def encoder(path: str, memory: int = MEMORY) -> WordBpe:
    """One encoder for each Python worker; it is released when a task of another operator begins there."""
    turn_of("bpe", _loaded.cache_clear)
    return _loaded(path, memory)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """Encode whole texts: (id_col, ids binary) and, with ``decode``, the ids' decoded text as ``decoded``.

    ``ids`` are little-endian unsigned 32-bit integers. The file is read on each worker from ``tokenizer_path``. There
    is no shuffle: a task encodes the texts of its partition in slices.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, ids binary" + ", decoded string" * decode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_path)
        for batch in slices(batches, "text"):
            ids = bpe.encode(batch.column(1).to_pylist())
            columns = [batch.column(0), pa.array(ids, pa.binary())]
            if decode:
                columns.append(pa.array(map(bpe.decode, ids), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"][: len(columns)])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(resting(run), schema)
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The inverse reading: (id_col, text) of rows whose ``ids_col`` holds ids as ``encode`` gives them; null ids give an empty text."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_path)
        for batch in slices(batches, "ids"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or b"") for x in batch.column(1).to_pylist()], pa.string())], ["id", "text"])

    out = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(resting(run), f"id {kind}, text string")
    return out.withColumnRenamed("id", id_col)
