"""Fast, exact tokenization with the ``tokenizers`` library inside tasks.

Words repeat, so a worker encodes each distinct word once and looks it up
afterwards.  A text takes that way only where its words are separated by
single spaces (and single line feeds): there a byte-level or word-level BPE
never joins what such a separator divides.  Any other text, and one that may
hold a special token, is encoded whole.
"""

from __future__ import annotations

import os

import numpy as np

from .common import tokenizer_path

#: Bytes of words and their ids that a worker remembers before it starts afresh.
REMEMBERED = 24_000_000
#: What parts words in ASCII text beside single spaces and line feeds.
UNEVEN = ("  ", "\n\n", " \n", "\n ", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f")

_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder of a vocabulary file; kept between tasks."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path if os.path.exists(path) else tokenizer_path(path))
        # a special token's text is one id wherever it stands, so texts that may hold one are encoded whole
        self.special = sorted({t.content.lower()[:2] for t in self.tok.get_added_tokens_decoder().values() if t.content})
        # whether white space yields ids: a space then belongs to the next word
        self.keeps_space = bool(self.tok.encode(" ", add_special_tokens=False).ids)
        self.newline = self._whole("\n")
        #: what parts words that are encoded together; its id marks their ends
        self.divider = "\n" if self.keeps_space else " 0 "
        self.divides = np.frombuffer(self._whole(self.divider), "<u4")
        self.joint, self.bound = self._boundaries()
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.marks = {m: self._whole(m) for m in ".,"}
        self.letters: dict[str, bool] = {}

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _boundaries(self) -> tuple[str, np.ndarray]:
        """What parts words in one text, and which ids tell them apart: those that start with a space, or that end a word."""
        vocabulary = self.tok.get_vocab()
        bound = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if self.keeps_space:
            space = self.tok.id_to_token(int(np.frombuffer(self._whole(" "), "<u4")[0]))
            bound[[i for t, i in vocabulary.items() if t.startswith(space)]] = True
            return "", bound
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        if suffix:
            bound[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        return " ", bound

    def _may_be_special(self, text: str) -> bool:
        """Whether the text holds the first two characters of a special token, in either case."""
        if not any(s[0] in text or s[0].upper() in text for s in self.special):
            return False
        low = text.lower()
        return any(s in low for s in self.special)

    def _ends_in_letter(self, c: str) -> bool:
        """Whether ``c`` is a letter and still ends in one as the vocabulary normalises it."""
        if c not in self.letters:
            form = self.tok.normalizer.normalize_str(c) if self.tok.normalizer else c
            self.letters[c] = c.isalpha() and form[-1:].isalpha()
        return self.letters[c]

    def _learn(self, words: list[str]) -> None:
        """Encode distinct words, each on its own, and remember them."""
        # a letter and a mark after it are never one piece, unless the letter is normalised to end in a mark of its own
        stems = {w: w[:-1] for w in words if w[-1:] in self.marks and w[:-1] and self._ends_in_letter(w[-2])}
        known = self.known
        ask = {w for w in words if w not in stems}
        ask.update(stem for stem in stems.values() if stem not in known)
        # a word that starts with a space has one id that does; a word of letters has one id that ends it
        marked = [w for w in ask if (w[:1] == " " if self.keeps_space else w.isalpha())]
        if not self._encode_marked(marked):
            self._encode_joined([w for w in marked if w.isascii() and w.lstrip(" ").isalpha()])
        ask = ask.difference(known)
        if not self.keeps_space:
            self._encode_joined([w for w in ask if "0" not in w])
            ask = ask.difference(known)
        self._encode(list(ask))
        for w, stem in stems.items():
            known[w] = known[stem] + self.marks[w[-1]]
            self.held += len(known[w])
        self.held += sum(map(len, words))

    def _encode_marked(self, words: list[str]) -> bool:
        """Words in one text, told apart by the ids that begin or end a word; whether that is certain.

        Every word has at least one such id, so as many of them as words means one each.
        """
        if not words:
            return True
        raw = self._whole(self.joint.join(words))
        at = np.flatnonzero(self.bound[np.frombuffer(raw, "<u4")])
        if len(at) != len(words):
            return False
        cuts = [*(at * 4).tolist(), len(raw)] if self.keeps_space else [0, *((at + 1) * 4).tolist()]
        if cuts[0] or cuts[-1] != len(raw):
            return False
        self.known.update(zip(words, map(raw.__getitem__, map(slice, cuts, cuts[1:]))))
        self.held += len(raw)
        return True

    def _encode_joined(self, words: list[str]) -> None:
        """Words without the divider's digit or line feed in one text, parted by it, which costs less than each alone."""
        if not words or len(self.divides) != 1:
            return
        raw = self._whole(self.divider.join(words))
        ends = np.flatnonzero(np.frombuffer(raw, "<u4") == self.divides[0])
        if len(ends) == len(words) - 1:
            cuts = [0, *((ends + 1) * 4).tolist(), len(raw) + 4]
            self.known.update((w, raw[cuts[i]:cuts[i + 1] - 4]) for i, w in enumerate(words))
            self.held += len(raw)

    def _encode(self, words: list[str]) -> None:
        if not words:
            return
        enc = self.tok.encode(words, is_pretokenized=True, add_special_tokens=False)
        raw = np.asarray(enc.ids, "<u4").tobytes()
        owner = np.asarray([-1 if x is None else x for x in enc.word_ids], np.int64)
        cuts = (np.searchsorted(owner, np.arange(len(words) + 1)) * 4).tolist()
        self.known.update((w, raw[cuts[i]:cuts[i + 1]]) for i, w in enumerate(words))
        self.held += len(raw)

    def _words(self, text: str) -> list[str] | None:
        """What the text is looked up by, line feeds included where they yield ids; nothing if its words aren't parted by single spaces and line feeds."""
        if self.keeps_space and text.isascii():
            if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in UNEVEN):
                return None
        else:
            words = text.split()
            if " ".join(words) != text.replace("\n", " "):
                return None
            if not self.keeps_space:
                return words
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without special tokens."""
        if self.held > REMEMBERED:
            self.known.clear()
            self.held = 0
        known = self.known
        known["\n"] = self.newline
        plans: list = []
        met: set[str] = set()
        for text in texts:
            words = None if not text or "\0" in text or self._may_be_special(text) else self._words(text)
            plans.append(text if words is None else words)
            if words is not None:
                met.update(words)
        # a word is looked up once for all texts
        missing = met.difference(known)
        if missing:
            self._learn(list(missing))
        get = known.__getitem__
        return [(self._whole(plan) if plan else b"") if isinstance(plan, str) else b"".join(map(get, plan)) for plan in plans]
