"""Pre-tokens of byte-level BPE vocabularies: the pieces between which no merge reaches."""

from __future__ import annotations

import base64
import json
import os
import re

#: Letters, numbers and white space up to U+024F, as the pattern's
#: classes have them. Texts in this range take the faster engine.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = "\t-\r \x85\xa0"
BEYOND = re.compile("[^\x00-ɏ]")
LATIN = re.compile(
    f"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)


class Splitter:
    """Splits a text as ``pattern`` does; the pieces joined are the text."""

    def __init__(self, pattern: str):
        import regex

        self.whole = regex.compile(pattern)

    def __call__(self, text: str) -> list[str]:
        return (self.whole if BEYOND.search(text) else LATIN).findall(text)


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """Where a tokenizer's file is; ``folder`` overrides the installed place."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Library:
    """A tokenizer as its library loads it, one thread, no truncation or padding:
    tokenizers for .json, sentencepiece for .model."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.special: list[str] = []
        self.by_piece = False
        if path.endswith(".model"):
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda text: own.encode(text, num_threads=1)
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        says = json.loads(tokenizer.to_str())
        cut, model = says["pre_tokenizer"] or {}, says["model"]
        # only these have the pattern's pre-tokens, encoded each on its own
        self.by_piece = (
            says["normalizer"] is None and cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]
            and model["type"] == "BPE" and not model["dropout"] and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        )
        self.tokenize = tokenizer.model.tokenize

    def piece(self, piece: str) -> list[int]:
        """Ids of one pre-token, by the library's model."""
        return [t.id for t in self.tokenize(piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(BYTE_LETTERS))]


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable ones
    stand for themselves, the others follow from U+0100 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


#: A space between other white space, or between white space and the end: only
#: there does a pre-token reach over a space from the left.
INNER_SPACE = re.compile(r"\s (?=\s|\Z)")


class Kept(dict):
    """A bounded cache that makes what it lacks. What comes first stays: frequent
    keys come early."""

    def __init__(self, make, entries: int):
        super().__init__()
        self.make, self.entries = make, entries

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.entries:
            self[key] = value
        return value


class ChunkValues:
    """Values of texts from values of their pre-tokens, each kind met seldom.

    A text is cut before its spaces, where no pre-token crosses (texts in which
    one does are split whole), and a chunk's value is kept, as the value of each
    pre-token is. Both caches are bounded.

    measure gives a pre-token's value; combine puts values together.
    """

    def __init__(self, pattern: str, measure, combine, entries: int):
        self.split, self.combine = Splitter(pattern), combine
        self.pieces, self.chunks = Kept(measure, entries), Kept(self._chunk, entries)

    def _split(self, text: str):
        found = LATIN.findall(text) if text.isascii() else self.split(text)
        return self.combine(map(self.pieces.__getitem__, found))

    def _chunk(self, chunk: str):
        return self._split(" " + chunk)

    def value(self, text: str):
        """The combined value of a text."""
        if INNER_SPACE.search(text):
            return self._split(text)
        head, *tail = text.split(" ")
        return self.combine((self._split(head), self.combine(map(self.chunks.__getitem__, tail))))
