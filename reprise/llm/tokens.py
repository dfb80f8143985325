"""Token ids of whole texts with the tokenizers library, word by word.

The vocabulary file's normaliser and splitter never join what white space separates, so a text's ids are those of its
words in order. Each task encodes a word once and then looks it up; the table is emptied when it grows too large.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable

from reprise.llm.common import words_of

#: Words, and the bytes of a word, that a worker's table holds at most.
TABLE_WORDS = 600_000
TABLE_BYTES = 64
#: ASCII characters that are neither letters, digits, white space nor an apostrophe (which the splitter treats apart).
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != ord("'"))
_TABLES: dict[str, _Table] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Below this, text is composed as the normaliser would have it, and lower case goes letter by letter.
_PLAIN = "\u0250"


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: bytes that print stand for themselves, the others follow from 256 on, in order."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(shown))}


_LETTERS = _byte_letters()


def _lowered(word: str) -> str | None:
    """The word as the normaliser leaves it, if it is one run of plain letters; else None."""
    if word.isalpha() and max(word) < _PLAIN:
        low = word.lower()
        if low.isalpha():
            return low
    return None


def _parts(word: bytes) -> tuple[bytes, bytes]:
    """A word as (core, marks at its end): the splitter cuts there if the core ends with a letter or digit.

    Lower case is safe ahead of the normaliser for ASCII and plain letters; elsewhere composition comes first. What counts is the end
    of the core once it is in lower case: the dotted capital I becomes a letter and a combining dot, which belongs with marks.
    """
    core = word.rstrip(_MARKS)
    if core.isalpha() and b"|" not in word:  # ASCII letters
        return core.lower(), word[len(core) :]
    if b"<|" in word or b"|>" in word:
        return word, b""
    if not core:
        return b"", word
    if core.isascii():
        return (core.lower(), word[len(core) :]) if core[-1:].isalnum() else (word.lower() if word.isascii() else word, b"")
    text = core.decode()
    low = _lowered(text)
    if low:
        return low.encode(), word[len(core) :]
    return (core, word[len(core) :]) if text[-1].isalnum() and text[-1].lower()[-1].isalnum() else (word, b"")


def vocabulary_size(vocabulary: str | None = None) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary or default_vocabulary()).get_vocab_size()


class _Table(dict):
    """Ids by word, as bytes. A word that isn't there is encoded when it is asked for; parts are kept as the words that they are."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.merge = self.tokenizer.model.tokenize
        self.codes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def __missing__(self, word: bytes) -> bytes:
        core, marks = _parts(word)
        ids = (self.get(core) or self.part(core) if core else b"") + (self.get(marks) or self.part(marks) if marks else b"")
        if len(word) <= TABLE_BYTES:
            self[word] = ids
        return ids

    def part(self, part: bytes) -> bytes:
        text = part.decode()
        # one run of letters or marks: the splitter has nothing to do; ASCII that prints is its own byte letter
        if part.isascii():
            letters = text if part.isalpha() and part.islower() or not part.strip(_MARKS) else None
        else:
            letters = part.decode("latin-1").translate(_LETTERS) if text == _lowered(text) else None
        if letters is None:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        else:
            codes = self.codes
            ids = b"".join([codes[t.id] for t in self.merge(letters)])
        if len(part) <= TABLE_BYTES:
            self[part] = ids
        return ids


def encoder(vocabulary: str | None = None) -> Callable[[list[str | None]], list[bytes]]:
    """A function from texts to their ids as little-endian unsigned 32-bit integers, without special tokens. Null counts as empty.

    For a vocabulary whose splitter keeps white space apart (see above). The table lives as long as the worker.
    """
    name = vocabulary or default_vocabulary()
    if name not in _TABLES:
        _TABLES[name] = _Table(name)
    table = _TABLES[name]
    ids_of = table.__getitem__

    def encode(texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            if len(table) > TABLE_WORDS:
                table.clear()
            out.append(b"".join(map(ids_of, words_of(text))))
        return out

    return encode
