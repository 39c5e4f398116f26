"""Token ids of whole texts by the tokenizers library, for Arrow batches inside tasks.

A word between white space gets the same ids wherever it stands, so each batch asks the library once
for each distinct word and gathers the ids of the texts from these.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .arrow import gather

#: Bytes of words and ids kept from batch to batch in a worker; beyond it the cache starts anew.
CACHED_BYTES = 96 << 20
#: Characters of the longest word that is kept at all.
CACHED_WORD = 200

#: White space as the split pattern sees it.
SPACES = "\\t-\\r \\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


#: A special token that rank files lack; it only parts words within one call.
RANKED_MARK = "<|cut|>"


class Pool:
    """Ids of distinct words in one flat array, with a dictionary from word to slot.

    Long words are encoded each time they come, so what is kept has a bound in bytes however long the texts are.
    """

    def __init__(self, encode, width=np.uint32):
        self.encode, self.width = encode, width
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.bytes = self.used = self.count = 0
        self.ids, self.starts, self.lengths = np.zeros(1 << 16, self.width), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _add(self, words: list[str]) -> dict[str, int]:
        words, flat, lengths = self.encode(words)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.count + len(words) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[self.count : self.count + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.count : self.count + len(words)] = lengths
        out = dict(zip(words, range(self.count, self.count + len(words))))
        self.used, self.count = self.used + len(flat), self.count + len(words)
        return out

    def take(self, words: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words[code] for all codes, one after the other, and how many each has."""
        if self.bytes > CACHED_BYTES:
            self.clear()
        if missing := [w for w in words if len(w) <= CACHED_WORD and w not in self.slot]:
            self.slot |= self._add(missing)
            self.bytes += sum(map(len, missing)) * 2 + 150 * len(missing)
        used, count = self.used, self.count
        long = self._add(w) if (w := [w for w in words if len(w) > CACHED_WORD]) else {}
        find = self.slot.__getitem__ if not long else lambda w: self.slot[w] if len(w) <= CACHED_WORD else long[w]
        slots = np.fromiter(map(find, words), np.int64, len(words))[codes]
        lengths = self.lengths[slots]
        out = self.ids[gather(self.starts[slots], lengths)], lengths
        if long:
            self.used, self.count = used, count
            if len(self.ids) > 4 * max(used, 1 << 20):
                self.ids = self.ids[: max(used, 1 << 16)].copy()
        return out


#: Letters that stay one letter in lower case, then punctuation that always starts a new match after a letter.
LETTER_MARK = "([a-zA-Z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{12f}\\x{131}-\\x{148}\\x{14a}-\\x{17f}])([.,!?;:%&$#*])"


def joined_encoder(tokenizer, mark: str):
    """Encodes many words in one call: put together around a special token, cut apart at its id. A word with the string of a special token goes alone, as ordinary text.

    Returns the words in another order, their ids in one array and how many ids each has.
    """
    mark_id = tokenizer.token_to_id(mark)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def encode(words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        rest = [w for w in words if any(t in w for t in special)]
        odd = set(rest)
        plain = [w for w in words if w not in odd]
        flat, lengths = [], []
        tokenizer.encode_special_tokens = False
        for k in range(0, len(plain), 20_000):
            ids = np.asarray(tokenizer.encode_batch_fast([mark.join(plain[k : k + 20_000]) + mark], add_special_tokens=False)[0].ids, np.uint32)
            cut = ids == mark_id
            ends = np.flatnonzero(cut)
            flat.append(ids[~cut])
            lengths.append(np.diff(ends, prepend=-1) - 1)
        tokenizer.encode_special_tokens = True  # a mark in a word here is ordinary text
        for w in rest:
            flat.append(np.asarray(tokenizer.encode(w, add_special_tokens=False).ids, np.uint32))
            lengths.append(np.array([len(flat[-1])]))
        return plain + rest, np.concatenate(flat or [np.zeros(0, np.uint32)]), np.concatenate(lengths or [np.zeros(0)]).astype(np.int64)

    return encode


class WordEncoder(Pool):
    """For tokenizers that treat every run of white space alike, ignore ASCII case and never join words across white space.

    A text with the string of a special token is encoded whole by the library's plain call, which gives the special id.
    """

    def __init__(self, tokenizer, mark: str):
        super().__init__(joined_encoder(tokenizer, mark))
        self.tokenizer = tokenizer
        self.special = "|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()) or "$^"

    def plain(self, text: str) -> np.ndarray:
        self.tokenizer.encode_special_tokens = False
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.width)


@lru_cache(maxsize=4)
def word_encoder(path: str, mark: str = "<|endoftext|>") -> WordEncoder:
    from tokenizers import Tokenizer

    return WordEncoder(Tokenizer.from_file(path), mark)


def encode_words(encoder: WordEncoder, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and n + 1 bounds of the texts in it: those of the library's plain call."""
    special = pc.match_substring_regex(text, encoder.special)
    rest = pc.if_else(special, "", text) if pc.any(special).as_py() else text
    spaced = pc.replace_substring_regex(pc.replace_substring_regex(pc.ascii_lower(rest), "[\\t\\n\\r]", " "), LETTER_MARK, "\\1 \\2")
    ids, bounds = _encode_parts(encoder, pc.split_pattern(spaced, " "))
    if rest is text:
        return ids, bounds
    parts = np.split(ids, bounds[1:-1])
    for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
        parts[i] = encoder.plain(text[i].as_py())
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _encode_parts(pool: Pool, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    coded = parts.flatten().dictionary_encode()
    ids, lengths = pool.take(coded.dictionary.to_pylist(), coded.indices.to_numpy())
    bounds = parts.offsets.to_numpy()
    return ids, np.concatenate([[0], np.cumsum(lengths)])[bounds - bounds[0]]


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends end_id to every text."""
    n = len(bounds) - 1
    return np.insert(ids, bounds[1:], np.full(n, end_id, ids.dtype)), bounds + np.arange(n + 1)


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones stand for themselves, the rest follow from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 256
    for b in range(256):
        if b in printable:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id, of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


@lru_cache(maxsize=4)
def rank_tokenizer(path: str, pattern: str):
    """A byte-level BPE of the tokenizers library with the merges that the ranks imply, and the bytes of each id.

    A pair may merge if its bytes are a token; the lowest rank merges first, so every split of a token into two others is a merge of that token's rank.
    """
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    tokens = read_ranks(path)
    char = byte_characters()
    name = {t: "".join(char[b] for b in t) for t in tokens}
    merges = [(name[t[:i]], name[t[i:]]) for t in tokens if len(t) > 1 for i in range(1, len(t)) if t[:i] in name and t[i:] in name]
    tokenizer = Tokenizer(models.BPE(vocab={name[t]: i for i, t in enumerate(tokens)}, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    tokenizer.add_special_tokens([RANKED_MARK])
    return tokenizer, tokens


@lru_cache(maxsize=4)
def rank_encoder(path: str, pattern: str) -> Pool:
    tokenizer, _ = rank_tokenizer(path, pattern)
    return Pool(joined_encoder(tokenizer, RANKED_MARK))


def encode_ranked(pool: Pool, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Like encode_words, for split patterns where a match may start with one space and white space is kept.

    Cuts lie where a match must start: at white space between other characters, and between a letter and punctuation.
    A text with adjoining white space, or with the character that marks the cuts, is encoded as one piece.
    """
    odd = pc.match_substring_regex(text, f"[{SPACES}][{SPACES}]|\\x01")
    marked = pc.replace_substring(pc.replace_substring(text, " ", "\x01 "), "\n", "\x01\n\x01")
    marked = pc.replace_substring_regex(marked, LETTER_MARK, "\\1\x01\\2")
    parts = pc.split_pattern(marked, "\x01")
    if pc.any(odd).as_py():
        rows = zip(odd.to_pylist(), text.to_pylist(), parts.to_pylist(), strict=True)
        parts = pa.array([[t] if o else p for o, t, p in rows], parts.type)
    return _encode_parts(pool, parts)
