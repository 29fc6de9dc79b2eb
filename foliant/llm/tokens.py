"""Byte-level BPE ids of whole texts: vectorised pre-token split, one dictionary of pre-tokens a worker."""

from __future__ import annotations

import re
import unicodedata
from array import array

import numpy as np

from foliant.llm.common import distinct_spans

#: Pre-tokens remembered by a worker before it starts anew.
REMEMBERED = 300_000
#: Code points split at once; a longer text is one piece of work of its own.
AT_ONCE = 1 << 17
#: Fixed values of the byte-level pre-token rule: the contractions that are tokens of their own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Fixed values of the byte-level alphabet: bytes that stand for themselves; the others follow from U+0100 on.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
OTHER, LETTER, NUMBER, SPACE = range(4)


def byte_alphabet() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    table = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            table[i] = LETTER
        elif kind == "N":
            table[i] = NUMBER
        elif kind == "Z" or i in (9, 10, 11, 12, 13, 0x85):
            table[i] = SPACE
    return table


def pretoken_starts(codes: np.ndarray, classes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of the joined texts begin."""
    n = len(codes)
    first = np.zeros(n + 1, bool)
    first[text_starts] = True
    first[n] = True
    change = np.ones(n, bool)
    change[1:] = classes[1:] != classes[:-1]
    after_blank = np.zeros(n, bool)
    after_blank[1:] = codes[:-1] == 32
    starts = change & ~(after_blank & (classes != SPACE))
    before_word = np.zeros(n, bool)
    before_word[:-1] = (classes[:-1] == SPACE) & (classes[1:] != SPACE) & ~first[1:n]
    starts |= before_word | first[:n]
    quotes = np.flatnonzero((codes == 39) & starts)
    for p in quotes.tolist():
        for short in CONTRACTIONS:
            end = p + 1 + len(short)
            if end <= n and not first[p + 1 : end].any() and codes[p + 1 : end].tolist() == [ord(c) for c in short]:
                starts[p + 1 : end] = False
                if end < n:
                    starts[end] = True
                break
    return np.flatnonzero(starts)


class ByteBpe:
    """Ids of a byte-level BPE vocabulary file; its special tokens in a text have their own ids, as in `tokenizers`."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        letters = byte_alphabet()
        tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        # The longest of several that begin at one place.
        self.split = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        vocab = tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(letters[c] for c in k): v for k, v in vocab.items() if all(c in letters for c in k) and k not in self.special}
        self.encode_piece = tiktoken.Encoding(
            "byte_bpe", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={}
        )._core_bpe.encode_single_piece
        self.classes = char_classes()
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.begin, self.pool = array("q", [0]), array("I")

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """One little-endian uint32 array of ids for each text."""
        pieces: list[str] = []
        parts: list[tuple[int, list[int]]] = []  # of each text its first piece, and the special ids between its pieces
        for text in texts:
            marks = [(m.span(), self.special[m[0]]) for m in self.split.finditer(text)] if any(t in text for t in self.special) else []
            parts.append((len(pieces), [i for _, i in marks]))
            at = 0
            for (a, b), _ in marks:
                pieces.append(text[at:a])
                at = b
            pieces.append(text[at:])
        found, out = self._pieces(pieces), []
        for first, special in parts:
            one = [found[first]]
            for k, i in enumerate(special):
                one += [np.array([i], "<u4"), found[first + k + 1]]
            out.append(np.concatenate(one) if special else one[0])
        return out

    def _pieces(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            last, size = at, 0
            while last < len(texts) and (last == at or size + len(texts[last]) <= AT_ONCE):
                size += len(texts[last])
                last += 1
            out += self._chunk(texts[at:last])
            at = last
        return out

    def _chunk(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        if not joined:
            return [np.zeros(0, "<u4") for _ in texts]
        if len(self.known) > REMEMBERED:
            self.forget()
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.array([len(x) for x in texts], np.int64)
        text_starts = np.cumsum(lengths) - lengths
        starts = pretoken_starts(codes, self.classes[codes], text_starts[lengths > 0])
        ends = np.append(starts[1:], len(codes))
        inverse, where = distinct_spans(codes, starts, ends)
        slots = np.empty(len(where), np.int64)
        known, pool, begin = self.known, self.pool, self.begin
        for i, (a, b) in enumerate(zip(starts[where].tolist(), ends[where].tolist(), strict=True)):
            piece = joined[a:b]
            slot = known.get(piece)
            if slot is None:
                pool.extend(self.encode_piece(piece.encode("utf-8", "replace")))
                slot = known[piece] = len(begin) - 1
                begin.append(len(pool))
            slots[i] = slot
        bounds, ids = np.frombuffer(begin, np.int64), np.frombuffer(pool, np.uint32)
        token = slots[inverse]
        head, n = bounds[token], bounds[token + 1] - bounds[token]
        total = np.cumsum(n)
        stream = ids[np.arange(int(total[-1])) + np.repeat(head - (total - n), n)].astype("<u4", copy=True)
        del bounds, ids  # arrays that are lent out can't grow
        edge = np.concatenate([[0], total])[np.searchsorted(starts, np.append(text_starts, len(codes)))]
        return [stream[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
