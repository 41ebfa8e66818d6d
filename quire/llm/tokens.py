"""Token ids by the tokenizers library, with a cache of what it gave for the words seen before.

A tokenizer file is read once in each Python worker. Texts of common Latin characters with plain spacing are cut at places
where its pre-tokenizer cuts anyway, and only new pieces go through the library; all other texts go through it whole, those that spell out an added
token such as <|endoftext|> included, which becomes that token's id as in a plain call of the library.
A byte-level vocabulary whose ids follow its merges needs no cache: tiktoken cuts and merges such texts at once.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from functools import lru_cache


#: Characters whose letter, number, case and normal form are the same to every library: ASCII, Latin-1 letters and
#: signs without superscripts and fractions, Latin Extended-A without dotted and deprecated letters, some punctuation.
PLAIN = "\n -~¡-±´-¸º»¿-įĲ-ňŊ-ſ‐-‧€"
ODD = re.compile(f"[^{PLAIN}]")
ASCII = bytes([10, *range(32, 127)])
#: What the word tokenizer's pre-tokenizer splits off from letters.
NOT_LETTERS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|\d|(?:[^\s\w]|_)+")
#: Kinds of Latin-1 characters for the word tokenizer: a letter, 0 digit, space, ' itself, . any other sign.
KINDS = "".join("'" if c == "'" else " " if c.isspace() else "0" if c.isdecimal() else "a" if c.isalnum() else "." for c in map(chr, range(256))).encode()
LETTERS = bytes(b for b in range(256) if KINDS[b] in b" a")
#: How the byte-level pre-tokenizer cuts a text.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A point or comma that the byte-level pre-tokenizer may join to the sign or space before it.
AFTER_SIGN = re.compile(r"[.,](?<=[\W_].)")


def word_pieces(text: str) -> list[str]:
    """A lower-cased text as the word tokenizer cuts it.

    Of most texts signs and digits stand alone, each a piece of its own, so that blanks around them do; runs of signs and
    apostrophes need the pattern.
    """
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return NOT_LETTERS.sub(r" \g<0> ", text).split()
    kinds = data.translate(KINDS)
    if b"'" in kinds or b".." in kinds:
        return NOT_LETTERS.sub(r" \g<0> ", text).split()
    for b in set(data.translate(None, LETTERS)):
        c = chr(b)
        text = text.replace(c, f" {c} ")
    return text.split()


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    out, n = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


class Encoder(dict):
    """Packed little-endian ids of the pieces seen lately, 16 bits wide where the vocabulary allows it.

    It keeps two generations of ``keep / 2`` pieces each: a full one becomes the old one, of which what is used comes back.
    """

    def __init__(self, path: str, keep: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.keep, self.old = self.tokenizer.model, keep, {}
        self.dtype, self.code = ("<u2", "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else ("<u4", "I")
        self.words_only = self.tokenizer.normalizer is not None
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = {c[:2] for c in added}  # a text with one of these may hold an added token
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE)
        letters = byte_letters()
        self.letters = str.maketrans({chr(b): c for b, c in letters.items()})
        self.whole = None  # a text at once, where its pieces are known to be cut as the library cuts them
        self.merge = None if self.words_only else self._merger({c: b for b, c in letters.items()})

    def _merger(self, byte_of: dict[str, int]):
        """The same vocabulary's merges by tiktoken, which takes a third of the time for a new word.

        A byte-level vocabulary whose ids follow its merges merges by least id; others keep the library's own model.
        """
        import tiktoken

        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if all(c in byte_of for c in token)}
        if len(ranks) < 256 or not all(bytes([b]) in ranks for b in range(256)):
            return None
        kind = json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}
        if kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space"):
            self.whole = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def pack(self, ids) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            letters = (piece[1:] if piece[0] == " " else piece).isalpha()
            out = self.pack(self.merge(piece.encode())) if letters and self.merge else self.ids_of(piece)
        self[piece] = out
        return out

    def ids_of(self, piece: str) -> bytes:
        if self.words_only or piece.isalpha():
            coded = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            return self.pack([t.id for t in self.model.tokenize(coded)])
        if piece[-1] in ".," and piece[-2:-1].isalpha():
            return self[piece[:-1]] + self[piece[-1]]
        return self.pack(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def odd(self, text: str) -> bool:
        """Must the library take the text whole?"""
        if text.isascii():
            if text.encode().translate(None, ASCII):
                return True
        elif ODD.search(text):
            return True
        if any(m in text for m in self.marks) and self.added.search(text):
            return True
        return not self.words_only and ("  " in text or " \n" in text or "\n " in text or "\n\n" in text)

    def encode(self, text: str) -> bytes:
        if self.odd(text):
            return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if self.whole and len(text) < 1 << 20:
            return self.pack(self.whole(text))
        if self.words_only:
            pieces = word_pieces(text.lower())
        else:
            cut = text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01")
            if not AFTER_SIGN.search(text):
                cut = cut.replace(".\x01", "\x01.\x01").replace(",\x01", "\x01,\x01")
            pieces = cut.split("\x01")
        if 2 * len(self) > self.keep:
            self.old = dict(self)
            self.clear()
        self[""] = b""
        return b"".join(map(self.__getitem__, pieces))


@lru_cache(maxsize=4)
def _loaded(path: str) -> Encoder:
    return Encoder(path)


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file: a path, or the name of one of the public tokenizers' files."""
    if os.sep not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    return _loaded(path)
