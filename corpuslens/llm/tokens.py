"""Fast exact encoding of whole texts with a public tokenizer file, for use inside tasks."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: A space between two non-spaces: both tokenizers' splitting rules always cut before it, so what lies between two such
#: places can be encoded alone (and remembered).
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: White space besides the space and the line feed; a text with none of it is cut by plain searches.
_RARE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_REMEMBER, _LONGEST = 240_000, 48
#: How the byte-level form splits a text when its file names no pattern of its own.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Up to here letters, digits, case and composition are the same in every Unicode version.
_LATIN = "\u024f"
_encoders: dict[tuple[str, bool], Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """ids(texts) gives each text's token ids as little-endian bytes (2 bytes an id when the vocabulary allows).

    Words between cuts are remembered, up to a fixed number of short ones. A new word of Latin letters is split by the
    tokenizer's own pattern into pieces, whose ids its model gives and which are remembered too; any other word is
    encoded by itself. Where the text of an added token stands (such as an end-of-text mark) the token's id is given, and
    what stands around it is encoded alone, as the library does; plain: such a text is a text like others. The result is
    the same as encoding each text whole.
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.words: dict[str, bytes] = {}  # what follows a cut, without its space
        self.pieces: dict[str, bytes] = {}
        self.split, self.lower = self._rule()
        self.letters = _byte_letters()
        self.added, self.marks = ({}, None) if plain else self._added()
        self.tok.encode_special_tokens = plain

    def _added(self):
        """Ids of the tokens that the file adds to its model, by their text, and the pattern that finds them; other kinds of such tokens are refused."""
        found = {}
        for t in json.loads(self.tok.to_str())["added_tokens"]:
            if t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]:
                raise ValueError(f"added token {t['content']!r} isn't matched as it stands")
            found[t["content"]] = np.array([t["id"]], self.dtype).tobytes()
        return found, re.compile("(" + "|".join(map(re.escape, sorted(found, key=len, reverse=True))) + ")") if found else None

    def _rule(self):
        """(split, lower): this tokenizer's splitting of Latin words and whether it lower-cases; (None, False) if it is of another form."""
        import regex

        d = json.loads(self.tok.to_str())
        pre, norm = d["pre_tokenizer"] or {}, d["normalizer"] or {}
        if d["model"]["type"] != "BPE":
            return None, False
        if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not norm:
            return regex.compile(_BYTE_LEVEL).findall, False
        steps = [x["type"] for x in norm.get("normalizers", [])]
        parts = pre.get("pretokenizers", [])
        if steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0]["invert"] and parts[0]["behavior"] == "Removed" and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"]:
            return regex.compile(parts[0]["pattern"]["Regex"]).findall, True
        return None, False

    def _alone(self, unit: str) -> bytes:
        return np.array(self.tok.encode(unit, add_special_tokens=False).ids, self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        stands = piece.replace(" ", self.letters[32]) if piece.isascii() and piece.isprintable() else "".join([self.letters[b] for b in piece.encode()])
        out = self.pieces[piece] = array(self.code, [t.id for t in self.tok.model.tokenize(stands)]).tobytes()
        return out

    def _unit(self, word: str, space: str, plain: bool = False) -> bytes:
        """Ids of a stretch of text that begins at a cut (with its space) or at the start (without). plain: no rare white space in it."""
        if self.split is None or not (word.isascii() or max(word) <= _LATIN) or not (plain or not any(c in word for c in _RARE)):
            return self._alone(space + word)
        get = self.pieces.get
        if self.lower:
            word, space = word.lower(), ""
        if word.isalpha():
            return get(space + word) or self._piece(space + word)
        if word[-1:] in (",", ".") and word[:-1].isalpha():
            a, b = space + word[:-1], word[-1]
            return (get(a) or self._piece(a)) + (get(b) or self._piece(b))
        return b"".join([get(x) or self._piece(x) for x in self.split(space + word)])

    def ids(self, texts: list[str | None]) -> list[bytes]:
        for kept in (self.words, self.pieces):
            if len(kept) > _REMEMBER:
                kept.clear()
        words, get = self.words, self.words.get
        out: list[bytes] = []
        for t in texts:
            if not t:
                out.append(b"")
                continue
            if any(x in t for x in self.added):
                parts = self.marks.split(t)  # odd ones are marks
                between = iter(self.ids(parts[::2]))
                out.append(b"".join([self.added[x] if i % 2 else next(between) for i, x in enumerate(parts)]))
                continue
            if "  " in t or " \n" in t or "\n " in t or t[-1] == " " or any(c in t for c in _RARE):
                head, *rest = _CUT.split(t)
                rest, plain = [x[1:] for x in rest], False
            else:
                head, *rest = t.split(" ")
                plain = True
            found = list(map(get, rest))
            if None in found:
                for i, x in enumerate(found):
                    if x is None:
                        w = rest[i]
                        x = get(w)
                        if x is None:
                            x = self._unit(w, " ", plain)
                            if len(w) <= _LONGEST:
                                words[w] = x
                        found[i] = x
            out.append((self._unit(head, "", plain) if head else b"") + b"".join(found))
        return out


def encoder(path: str, plain: bool = False) -> Encoder:
    """One per worker process, file and way of reading added tokens."""
    if (path, plain) not in _encoders:
        _encoders[path, plain] = Encoder(path, plain)
    return _encoders[path, plain]


def forget() -> None:
    """Let go of the encoders of tasks that this worker process has run before, and of the words they remember; the next task makes its own."""
    _encoders.clear()


def small_batches(batches, columns: tuple[str, ...], most_chars: int = 4_000_000):
    """Lists of row tuples of an Arrow batch iterator, cut so that texts of few megabytes are held at once."""
    for b in batches:
        cols = [b.column(b.schema.get_field_index(c)) for c in columns]
        rows, held = [], 0
        for i in range(b.num_rows):
            row = tuple(c[i].as_py() for c in cols)
            rows.append(row)
            held += sum(len(x) for x in row if isinstance(x, str))
            if held >= most_chars:
                yield rows
                rows, held = [], 0
        if rows:
            yield rows
