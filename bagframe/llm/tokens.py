"""Token ids of whole texts by the tokenizers library, as little-endian unsigned 32-bit integers."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import compress
from operator import not_

WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_pairs = re.compile(f"[{WHITE}][{WHITE}]|\0")
_parts = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_white = re.compile(f"[{WHITE}]")
#: White space other than spaces and line ends; two of these side by side are told by four strings.
_rare = [c for c in map(chr, range(0x3001)) if _white.match(c) and c not in " \n"] + ["\0"]
_twice = ("  ", " \n", "\n ", "\n\n")
#: White space by which a part can begin.
OPENERS = frozenset(" \n\t\r")
#: A word of Latin letters; it and the ASCII marks after it are encoded each by itself where the vocabulary splits there.
_word = re.compile(r"[ \n\t\r]?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: A space and such letters: a part that the vocabulary does not split before its merges.
_bare = re.compile(r" [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Most parts whose ids a worker remembers (about 250 bytes each).
CACHE = 600_000


def parts(text: str) -> list[str]:
    """Splits a text where white space begins. Byte-level BPE splits there too, whatever stands around it, so the parts' ids joined are the text's ids."""
    if any(x in text for x in _twice) or any(x in text for x in _rare) and _pairs.search(text):
        return _parts.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")


_visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The visible characters by which byte-level vocabularies write bytes: themselves, or the next one from 256 on.
VISIBLE = {b: chr(b) for b in _visible} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _visible)}


def byte_level(text: str) -> str:
    """The text's bytes as byte-level vocabularies write them."""
    return text.encode().decode("latin-1").translate(VISIBLE)


class Encoder:
    """Encodes texts part by part; parts seen before are not encoded again. The ids are those of encode(text, add_special_tokens=False): the literals of
    the file's added tokens (<|endoftext|>) count as these tokens."""

    def __init__(self, path: str, size: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.contents = sorted((a.content for a in added), key=len, reverse=True)
        self.literals = re.compile("(" + "|".join(map(re.escape, self.contents)) + ")")
        #: Tokens with rules on what stands around them: texts that hold one are encoded whole.
        self.whole = any(a.lstrip or a.rstrip or a.single_word for a in added)
        #: Bytes of each token: byte-level tokens have one character for each byte.
        vocabulary = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)
        #: Whether words are split from the marks after them, whatever these are.
        before = self.tokenizer.pre_tokenizer
        self.splits = self.tokenizer.normalizer is None and before is not None and all(any(at == 1 for _, (at, _) in before.pre_tokenize_str(x + m)) for x in "a\u00e9" for m in MARKS)
        #: The same merges without the search for words: for joined parts of a space and letters, as no merge crosses from letters to a space.
        self.merger = None
        if self.splits and self._bare_parts_join(vocabulary):
            self.merger = Tokenizer(self.tokenizer.model)
        self.size = size
        #: What the latest texts use, and what those before them used: half of `size` each, about.
        self.known: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}

    def _bare_parts_join(self, vocabulary: dict[str, int]) -> bool:
        """Whether joined parts of a space and letters are split before each space only, and no token crosses such a place."""
        from tokenizers.models import BPE

        model = self.tokenizer.model
        if not isinstance(model, BPE) or model.dropout or model.ignore_merges or model.continuing_subword_prefix or model.end_of_word_suffix:
            return False
        if [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(" ab \u00e9a")] != [byte_level(" ab"), byte_level(" \u00e9a")]:
            return False
        letters = set(byte_level("".join(c for c in map(chr, range(0x250)) if _bare.fullmatch(" " + c))))
        mark = byte_level(" ")
        crossing = re.compile(f"[^{mark}]{mark}")
        return not any(crossing.search(t) and letters.issuperset(t.replace(mark, "")) for t in vocabulary)

    def learn(self, new: set[str]) -> None:
        """Encodes parts. Those that begin with white space and end without it are encoded many at a time, one after another; the bytes of each token
        tell where a part's ids end. Words with marks at their end take the ids of the word and of the marks."""
        import numpy as np

        wanted, joined = set(), []
        for x in new:
            word = x.rstrip(MARKS) if self.splits else x
            if word and len(word) < len(x) and _word.fullmatch(word) and x not in self.contents:
                marks = x[len(word) :]
                joined.append((x, word, marks))
                if word not in self.known:
                    wanted.add(word)
                if marks not in self.known:
                    wanted.add(marks)
            else:
                wanted.add(x)
        bare, wide, chained, apart = [], [], [], []
        for x in wanted:
            if self.merger and x[0] == " " and x not in self.contents:
                if x.isascii():
                    if x[1:].isalpha():
                        bare.append(x)
                        continue
                elif _bare.fullmatch(x):
                    wide.append(x)
                    continue
            literal = x in self.contents or self.whole and self.literals.search(x)
            (chained if x[0] in OPENERS and not literal and not _white.match(x[-1]) else apart).append(x)
        kinds = [(self.merger, 100, bare), (self.merger, 100, wide), (self.tokenizer, 500, chained)]
        for tokenizer, n, some in ((t, n, parts[at : at + n]) for t, n, parts in kinds for at in range(0, len(parts), n)):
            text = "".join(some)
            plain = text.isascii()
            if tokenizer is self.merger:
                text = text.replace(" ", VISIBLE[32]) if plain else byte_level(text)
            ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            reached, ends = np.cumsum(self.lengths[ids]), np.cumsum(list(map(len, some if plain else map(str.encode, some))))
            last = np.searchsorted(reached, ends)
            if reached[-1] != ends[-1] or (reached[last] != ends).any():  # not a byte-level vocabulary
                apart += some
                continue
            blob, before = ids.tobytes(), 0
            for part, end in zip(some, (4 * (last + 1)).tolist()):
                self.known[part] = blob[before:end]
                before = end
        for at in range(0, len(apart), 20_000):
            some = apart[at : at + 20_000]
            for part, coded in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.known[part] = np.array(coded.ids, "<u4").tobytes()
        for x, word, marks in joined:
            self.known[x] = self.known[word] + self.known[marks]

    def split(self, text: str) -> list[str]:
        """Literals of added tokens, and the parts between them."""
        if not any(x in text for x in self.contents):
            return parts(text)
        if self.whole:
            return [text]
        return [p for i, x in enumerate(self.literals.split(text)) for p in ([x] if i % 2 else parts(x))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes."""
        all_parts, ends = [], []
        for t in texts:
            all_parts += self.split(t or "")
            ends.append(len(all_parts))
        if 2 * len(self.known) > self.size:
            self.before, self.known = self.known, {"": b""}
        found = list(map(self.known.get, all_parts))
        missed = list(compress(range(len(found)), map(not_, found)))
        new = {all_parts[i] for i in missed}
        new.discard("")  # its ids are as empty as those that lack
        again = {x: self.before[x] for x in new if x in self.before}
        self.known |= again
        self.learn(new.difference(again))
        for i in missed:
            found[i] = self.known[all_parts[i]]
        return [b"".join(found[a:b]) for a, b in zip([0, *ends], ends)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary file, kept across tasks."""
    return Encoder(path)


def forget() -> None:
    """Lets go of the encoders of this worker process: tasks of other operators call it, as workers outlive their stages."""
    encoder.cache_clear()


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file on this machine; each executor asks for its own."""
    import public_tokenizers

    return public_tokenizers.path(name)


def groups(texts: list[str], limit: int = 1 << 18):
    """Index ranges of runs of texts of about `limit` characters."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
