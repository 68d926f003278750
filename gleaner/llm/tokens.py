"""Exact ids of public tokenizers, with repeated words encoded once per worker.

Pre-tokenizers split a text at white space, so a text's ids are those of its words in a row. Words are
looked up in a bounded table and only unknown ones go through the tokenizers library; texts for which
the split is not known to be safe (white space other than blank and newline, or characters whose lower
case depends on neighbours) are encoded whole. The ids are those of encoding each text whole; the tests
hold the two against each other.
"""

from __future__ import annotations

import base64
import json
import os
import re
from itertools import chain

import numpy as np

#: A bound for the words of one generation a worker remembers; the one before is kept to be drawn on.
CACHE_WORDS = 700_000
ODD_SPACE = re.compile(r"[^\S \n]")
ODD_ASCII = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
#: Beyond these letters lower case is left to the library.
NOT_LATIN = re.compile(r"[^\x00-\u024f]")
#: White space and the word after it, for tokenizers that keep blanks.
SPACED = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
TAILS = frozenset(".,;:!?")
#: How a vocabulary file says that a run of letters is a piece, whose bytes are then written as letters.
LETTER_RUNS = json.dumps({"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"})

#: Vocabularies that exist as byte ranks too, which tiktoken turns into the same ids at several times the speed.
RANKS = {"byte_bpe_50k.json": "byte_bpe_50k.tiktoken"}

_encoders: dict[tuple[str, bool], Encoder] = {}


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file, or ``name`` itself if it is a path."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(name: str, keeps_spaces: bool) -> Encoder:
    """The worker's encoder for a vocabulary, made once."""
    key = (name, keeps_spaces)
    if key not in _encoders:
        _encoders[key] = Encoder(name, keeps_spaces)
    return _encoders[key]


class Encoder:
    def __init__(self, name: str, keeps_spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary(name))
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.split = SPACED.findall if keeps_spaces else str.split
        self.ranks = None
        if name in RANKS:
            import public_tokenizers
            import tiktoken

            with open(vocabulary(RANKS[name]), "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.ranks = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.folds = "Lowercase" in repr(self.tokenizer.normalizer)
        # A word of lower-case Latin letters is its own normal form and one piece of such a pre-tokenizer: its bytes go to the model.
        self.letters = None
        if self.folds and LETTER_RUNS in json.dumps(json.loads(self.tokenizer.to_str())["pre_tokenizer"]):
            from tokenizers import pre_tokenizers

            self.letters = Tokenizer(self.tokenizer.model)
            self.letters.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, by the library alone."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def of_words(self, tokenizer, words: list[str]) -> list[bytes]:
        """The same of words, which are short: their ids become one array."""
        found = [x.ids for x in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        ends = np.cumsum([0, *map(len, found)]) * 4
        ids = np.fromiter(chain.from_iterable(found), "<u4", ends[-1] // 4).tobytes()
        return [ids[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The same ids, by way of ranks or of the table of words; beyond Latin letters by the library alone."""
        if self.ranks is not None:
            plain = [NOT_LATIN.search(x) is None for x in texts]
            odd = iter(self.whole([x for x, ok in zip(texts, plain, strict=True) if not ok]))
            return [self.ranks.encode_to_numpy(x, disallowed_special=()).astype("<u4").tobytes() if ok else next(odd) for x, ok in zip(texts, plain, strict=True)]
        safe = [not any(map(x.__contains__, ODD_ASCII)) if x.isascii() else ODD_SPACE.search(x) is None for x in texts]
        if self.folds:
            texts = [x.lower() if ok and (x.isascii() or NOT_LATIN.search(x) is None) else x for x, ok in zip(texts, safe, strict=True)]
        words = [self.split(x) if ok else () for x, ok in zip(texts, safe, strict=True)]
        if len(self.known) > CACHE_WORDS:
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        new = set().union(*words).difference(known)
        again = new & before.keys()
        known.update((x, before[x]) for x in again)
        new -= again
        # "word," is "word" and ",": a mark after a letter always starts a piece of its own.
        cut = {x for x in new if len(x) > 1 and x[-1] in TAILS and x[-2].isalpha()}
        plain = [*({x[:-1] for x in cut} | {x[-1] for x in cut} | (new - cut)).difference(known)]
        if self.letters:
            own = [x for x in plain if x.isalpha() and x.islower() and (x.isascii() or NOT_LATIN.search(x) is None)]
            known.update(zip(own, self.of_words(self.letters, own), strict=True))
            plain = [*set(plain).difference(own)]
        known.update(zip(plain, self.of_words(self.tokenizer, plain), strict=True))
        for x in cut:
            known[x] = known[x[:-1]] + known[x[-1]]
        odd = iter(self.whole([x for x, ok in zip(texts, safe, strict=True) if not ok]))
        return [b"".join(map(known.__getitem__, w)) if ok else next(odd) for w, ok in zip(words, safe, strict=True)]


def portions(texts: list[str], most: int = 1 << 21):
    """Slices of ``texts`` of about ``most`` characters, at least one text each."""
    start = total = 0
    for i, x in enumerate(texts):
        total += len(x)
        if total >= most:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
