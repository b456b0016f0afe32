"""Byte-pair merging for a published word-level vocabulary file: pre-tokenisation and two merge methods.

``RankArrayBpe`` holds part boundaries and adjacent ranks of a short word in flat arrays; ``HeapBpe`` keeps a
heap of adjacent pairs over a linked list and only counts. Both give what the ``tokenizers`` library gives for
the same file, which the tests check.
"""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush

#: Rank of a pair that no merge joins.
NO_MERGE = 1 << 60
#: Words with more symbols than this are merged by the heap, whose cost isn't quadratic.
SHORT_WORD = 48
#: Words kept in each of the two generations of a memo.
MEMO_WORDS = 250_000

#: Texts made of these characters only are split here: none is changed by NFC, each has a one-to-one lower case,
#: and each is surely a letter, a digit, white space or a sign in every Unicode version.
PLAIN_TEXT = re.compile("[\t-\r -~¡£§«¶·»¿À-ÖØ-öø-ÿŒœŠšŽž‘’“”–—…€]*")
PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿœšž]+|[0-9]|[^\sa-zß-öø-ÿœšž0-9]+")


class Memo(dict):
    """word -> value in two generations: when the young one is full it becomes the old one, so frequent words stay."""

    def __init__(self, make, size: int = MEMO_WORDS):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte value: printable Latin-1 for itself, others from 256 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in keep}
    letters |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in letters)}
    return [letters[b] for b in range(256)]


class WordVocabulary:
    """A ``tokenizers`` JSON file of kind BPE with byte letters and a word-end suffix: pieces, merges, splitting."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        odd = [k for k in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError(f"{path}: not a plain byte-letter BPE file ({', '.join(odd) or 'model, decoder or post-processor'})")
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = [""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for piece, i in [*self.ids.items(), *self.special.items()]:
            self.pieces[i] = piece
        #: (left id, right id) -> rank; merged[rank] is the joined piece's id.
        pairs = [(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.rank = {(self.ids[a], self.ids[b]): r for r, (a, b) in enumerate(pairs)}
        self.merged = [self.ids[a + b] for a, b in pairs]
        letters = byte_letters()
        self.inner = [self.ids[x] for x in letters]
        self.last = [self.ids[x + self.suffix] for x in letters]
        self._special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._library = Tokenizer.from_file(path)

    def symbols(self, word: str) -> list[int]:
        """Ids of a plain word's bytes, the last one with the word-end suffix."""
        raw = word.encode("utf-8", "surrogatepass")
        out = [self.inner[b] for b in raw]
        out[-1] = self.last[raw[-1]]
        return out

    def letter_symbols(self, word: str) -> list[int]:
        """Ids of a word that is already written in byte letters."""
        return [*(self.ids[c] for c in word[:-1]), self.ids[word[-1] + self.suffix]]

    def plain_words(self, text: str) -> list[str] | None:
        """The words of a text of plain characters, lower-cased; None if it needs the full normaliser."""
        if PLAIN_TEXT.fullmatch(text) and not any(s in text for s in self.special):
            return PLAIN_WORD.findall(text.lower())
        return None

    def full_words(self, text: str):
        """(byte-letter word, None) or (None, special id) in order, for any text: the file's own normaliser and split."""
        library = self._library
        for part in self._special_split.split(text) if self._special_split else [text]:
            if part in self.special:
                yield None, self.special[part]
            elif part:
                for word, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(part)):
                    yield word, None


def rank_array_merge(vocabulary: WordVocabulary, parts: list[int]) -> list[int]:
    """Merges ``parts`` in place: scan the contiguous array of adjacent ranks for its (leftmost) minimum, delete that
    boundary, refresh the ranks on both sides; ends when no adjacent pair has a rank."""
    get, merged = vocabulary.rank.get, vocabulary.merged
    ranks = [get(pair, NO_MERGE) for pair in zip(parts, parts[1:])]
    while ranks:
        least = min(ranks)
        if least == NO_MERGE:
            break
        at = ranks.index(least)
        parts[at] = merged[least]
        del parts[at + 1], ranks[at]
        if at:
            ranks[at - 1] = get((parts[at - 1], parts[at]), NO_MERGE)
        if at < len(ranks):
            ranks[at] = get((parts[at], parts[at + 1]), NO_MERGE)
    return parts


def heap_merge(vocabulary: WordVocabulary, symbols: list[int]) -> int:
    """Number of merges: pop the lowest-ranked adjacent pair (leftmost first) from a heap over a doubly linked list.

    ``symbols`` is changed in place: a symbol that was merged into its left neighbour becomes -1.
    """
    get, merged, n = vocabulary.rank.get, vocabulary.merged, len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := get(pair)) is not None]
    heapify(heap)
    merges = 0
    while heap:
        rank, i = heappop(heap)
        j = after[i]
        if symbols[i] < 0 or j >= n or get((symbols[i], symbols[j])) != rank:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j] = merged[rank], -1
        merges += 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := get((symbols[i], symbols[k]))) is not None:
                heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := get((symbols[h], symbols[i]))) is not None:
            heappush(heap, (r, h))
    return merges


class RankArrayBpe:
    """Encoder: text -> ids by the contiguous rank array; words of over SHORT_WORD symbols go through the heap."""

    def __init__(self, path: str):
        self.vocabulary = v = WordVocabulary(path)
        self._plain = Memo(lambda word: self._merge(v.symbols(word)))
        self._full = Memo(lambda word: self._merge(v.letter_symbols(word)))

    def _merge(self, symbols: list[int]) -> tuple[int, ...]:
        if len(symbols) <= SHORT_WORD:
            return tuple(rank_array_merge(self.vocabulary, symbols))
        heap_merge(self.vocabulary, symbols)
        return tuple(s for s in symbols if s >= 0)

    def encode(self, text: str) -> list[int]:
        words = self.vocabulary.plain_words(text)
        out: list[int] = []
        if words is not None:
            for ids in map(self._plain.__getitem__, words):
                out += ids
            return out
        for word, special in self.vocabulary.full_words(text):
            out += self._full[word] if special is None else (special,)
        return out

    def decode(self, ids) -> str:
        """What the library gives for a file without a decoder: the pieces with a space between them."""
        return " ".join(map(self.vocabulary.pieces.__getitem__, ids))


class HeapBpe:
    """Counter: text -> number of tokens as initial symbols minus merges; no ids are made."""

    def __init__(self, path: str):
        self.vocabulary = v = WordVocabulary(path)
        self._plain = Memo(lambda word: self._count(v.symbols(word)))
        self._full = Memo(lambda word: self._count(v.letter_symbols(word)))

    def _count(self, symbols: list[int]) -> int:
        return len(symbols) - heap_merge(self.vocabulary, symbols)

    def count(self, text: str) -> int:
        words = self.vocabulary.plain_words(text)
        if words is not None:
            return sum(map(self._plain.__getitem__, words))
        return sum(self._full[word] if special is None else 1 for word, special in self.vocabulary.full_words(text))


_loaded: dict[tuple, object] = {}


def loaded(kind, name: str, *more):
    """One instance of ``kind`` for the vocabulary file ``name`` in each worker process; ``name`` may be a path."""
    if (kind, name, more) not in _loaded:
        import public_tokenizers

        _loaded[kind, name, more] = kind(name if "/" in name else public_tokenizers.path(name), *more)
    return _loaded[kind, name, more]
