"""Token ids of whole texts with the tokenizers library, each distinct piece of a batch encoded once.

A text is cut where no token can reach across. The distinct pieces of a batch
are words of plain letters with marks behind them, or anything else. Plain
words go through the vocabulary's own model, very many in one call; marks and
other pieces go through the whole tokenizer; numpy puts the ids of the texts
together. From batch to batch the tokenizer is kept and the ids of at most
KEPT words and KEPT other pieces of KEPT_BYTES in all, so a worker's memory
depends on the size of a batch and on nothing else that grows.

The tokenizer is used as its file has it: the strings of its special tokens
in a text become those tokens, unless special_strings is False.
"""

from __future__ import annotations

import os
import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

#: Letters that are lower-cased one to one and composed already.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_EACH_LETTER = "".join(map(chr, [*range(65, 91), *range(97, 123), *(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))]))
#: Marks: a run of them that ends a piece is a word of its own after a letter; as a set of a regular expression too.
MARKS, _MARKS = string.punctuation, r"!-/:-@\[-`{-~"
#: Words in one call.
TOGETHER = 4096
#: Strings whose ids are kept from batch to batch, and their bytes.
KEPT, KEPT_BYTES = 300_000, 8 << 20
#: The characters that byte-level models have for a space and for the bytes of letters beyond ASCII that aren't the character of their own number.
_AS_CHARACTERS = [(" ", "Ġ"), *((chr(b), chr(256 + 33 + b - 127)) for b in range(0x80, 0xA1)), ("\xad", chr(256 + 67))]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def gathered(flat: np.ndarray, begin: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[begin[p]:begin[p + 1]] for each place p, one after the other, and where each begins."""
    size = begin[place + 1] - begin[place]
    start = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(start[-1], dtype=np.int64)
    at += np.repeat(begin[place] - start[:-1], size)
    return flat[at], start


def as_characters(data: bytes) -> str:
    """The bytes of plain words, spaces and newlines as the characters that byte-level models are written in;
    newlines stay."""
    text = data.decode("latin-1")
    for byte, character in _AS_CHARACTERS[: 1 if data.isascii() else None]:
        text = text.replace(byte, character)
    return text


class Kept:
    """What work() gives for distinct strings: ids, and where those of each string begin. Strings met in an
    earlier batch are not worked on again, as far as they are kept."""

    def __init__(self, work: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]):
        self.work = work
        self.keep(pa.array([], pa.large_utf8()), np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def keep(self, strings: pa.Array, ids: np.ndarray, begin: np.ndarray) -> None:
        self.strings, self.ids, self.begin = strings, ids, begin

    def __call__(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        at = pc.index_in(strings, value_set=self.strings)
        unknown = pc.is_null(at)
        new = strings.filter(unknown)
        ids, begin = self.work(new)
        place = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[unknown.to_numpy(zero_copy_only=False)] = len(self.strings) + np.arange(len(new))
        both = pa.concat_arrays([self.strings, new]), np.concatenate([self.ids, ids]), np.concatenate([self.begin, self.begin[-1] + begin[1:]])
        # beyond the bound what is kept begins anew with the last batch
        fit = [x for x in (both, (new, ids, begin)) if len(x[0]) <= KEPT and x[0].nbytes <= KEPT_BYTES]
        if fit:
            self.keep(*fit[0])
        return gathered(both[1], both[2], place)


class Encoder:
    """ids and offsets of batches of texts."""

    PLAIN = f"^[{LETTERS}]+[{_MARKS}]*$"

    def __init__(self, path: str, special_strings: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special_strings
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special_strings else []
        # the same model behind no other cut than that between the words it is given, in its own characters
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = CharDelimiterSplit("\n")
        self.kept_words, self.kept_others = Kept(self.words), Kept(lambda pieces: self.whole(pieces.to_pylist()))
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.edge = self.edges(names)

    def edges(self, names: list[str]) -> np.ndarray:
        """Which ids begin or end a word, so the ids of many words can be told apart."""
        raise NotImplementedError

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts as the tokenizer gives them, and where each text's begin."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        start = np.cumsum([0, *map(len, ids)])
        return np.array([x for own in ids for x in own], dtype=np.uint32), start

    def model_ids(self, words: pa.Array, between: str = "\n") -> np.ndarray:
        after = (pa.scalar("", pa.large_utf8()), pa.scalar(between, pa.large_utf8()))
        ended = [pc.binary_join_element_wise(words.slice(i, TOGETHER), *after) for i in range(0, len(words), TOGETHER)]
        parts = [as_characters(bytes(memoryview(e.buffers()[2])[: np.frombuffer(e.buffers()[1], np.int64)[len(e)]])) for e in ended]
        return np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in self.bare.encode_batch_fast(parts, add_special_tokens=False))])

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words and where each word's begin."""
        raise NotImplementedError

    def plain(self, pieces: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """A newline in front or not, word and marks of plain pieces."""
        return pa.nulls(len(pieces), pa.bool_()).fill_null(False), pc.utf8_rtrim(pieces, MARKS), pc.utf8_ltrim(pieces, _EACH_LETTER)

    def pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces and where each piece's begin."""
        plain = pc.match_substring_regex(pieces, self.PLAIN)
        is_plain = plain.to_numpy(zero_copy_only=False)
        line, word, mark = self.plain(pieces.filter(plain))
        word, mark = pc.dictionary_encode(word), pc.dictionary_encode(mark)
        parts = [self.whole(["\n"]), self.kept_words(word.dictionary), self.whole(mark.dictionary.to_pylist()), self.kept_others(pieces.filter(pc.invert(plain)))]
        flat = np.concatenate([p[0] for p in parts])
        shift = np.cumsum([0, *(len(p[0]) for p in parts)])
        begin = np.concatenate([*(p[1][:-1] + s for p, s in zip(parts, shift)), shift[-1:]])
        # a plain piece is a newline or nothing, a word, and marks that may have no ids
        first = np.cumsum([0, *(len(p[1]) - 1 for p in parts)])
        atoms = np.zeros((len(pieces), 3), np.int64)
        used = np.zeros((len(pieces), 3), bool)
        atoms[is_plain, 1] = first[1] + np.asarray(word.indices)
        atoms[is_plain, 2] = first[2] + np.asarray(mark.indices)
        used[is_plain] = True
        used[is_plain, 0] = line.to_numpy(zero_copy_only=False)
        atoms[~is_plain, 1] = first[3] + np.arange(len(pieces) - is_plain.sum())
        used[~is_plain, 1] = True
        ids, start = gathered(flat, begin, atoms[used])
        return ids, start[np.concatenate([[0], np.cumsum(used.sum(axis=1))])]


class WordEncoder(Encoder):
    """For a vocabulary whose pre-tokenizer drops white space and whose words end with a mark of
    their own: pieces are the runs between ASCII white space."""

    def edges(self, names: list[str]) -> np.ndarray:
        return np.array([n.endswith("</w>") for n in names])

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = self.model_ids(pc.utf8_lower(words))
        return ids, np.concatenate([[0], np.flatnonzero(self.edge[ids]) + 1])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and where each text begins (one more at the end); null is empty."""
        parts = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_utf8()))
        off = np.asarray(parts.offsets, dtype=np.int64)
        coded = pc.dictionary_encode(parts.flatten())
        ids, begin = self.pieces(coded.dictionary)
        ids, start = gathered(ids, begin, np.asarray(coded.indices, dtype=np.int64))
        return ids, start[off - off[0]] if len(texts) else np.zeros(1, np.int64)


class SpacedEncoder(Encoder):
    """For a byte-level vocabulary whose pre-tokenizer joins a space to the word behind it and keeps
    any other white space apart: pieces begin at each space and newline. Of a run of white space the
    last one belongs to what follows and the rest is one token or more, so two together are cut right
    as well; texts with three together, two at their end, other white space at the edge of a piece,
    a special token or the character that marks the cuts are encoded as a whole."""

    CUT = "\x00"
    PLAIN = f"^[ \n]?[{LETTERS}]+[{_MARKS}]*$"

    def edges(self, names: list[str]) -> np.ndarray:
        return np.array([n.startswith("Ġ") for n in names])

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        spaced = pc.starts_with(words, " ")
        is_spaced = spaced.to_numpy(zero_copy_only=False)
        ids = self.model_ids(words.filter(spaced))
        # between words that do not begin with a space a space alone tells them apart
        other = self.model_ids(words.filter(pc.invert(spaced)), "\n \n")
        ends = np.flatnonzero(self.edge[other])
        keep = ~self.edge[other]
        sizes = np.empty(len(words), np.int64)
        sizes[is_spaced] = np.diff(np.append(np.flatnonzero(self.edge[ids]), len(ids)))
        sizes[~is_spaced] = np.diff(ends, prepend=-1) - 1
        both = np.concatenate([ids, other[keep]])
        order = np.concatenate([np.flatnonzero(is_spaced), np.flatnonzero(~is_spaced)])
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        return gathered(both, np.concatenate([[0], np.cumsum(sizes[order])]), place)

    def plain(self, pieces: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        return pc.starts_with(pieces, "\n"), pc.utf8_ltrim(pc.utf8_rtrim(pieces, MARKS), "\n"), pc.utf8_ltrim(pieces, " \n" + _EACH_LETTER)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and where each text begins (one more at the end); null is empty."""
        texts = texts.fill_null("").cast(pa.large_utf8())
        docs = len(texts)
        if not docs:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        odd = np.zeros(docs, bool)
        for x in (self.CUT, *self.special):
            odd |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        cut = pc.replace_substring(pc.replace_substring(texts, " ", self.CUT + " "), "\n", self.CUT + "\n")
        parts = pc.split_pattern(cut, self.CUT)
        off = np.asarray(parts.offsets, dtype=np.int64)
        off = off - off[0]
        coded = pc.dictionary_encode(parts.flatten())
        codes, vocab = np.asarray(coded.indices, dtype=np.int64), coded.dictionary
        strange = pc.invert(pc.match_substring_regex(vocab, self.PLAIN)).to_numpy(zero_copy_only=False)
        alone, edge = np.zeros(len(vocab), bool), np.zeros(len(vocab), bool)
        for i, p in zip(np.flatnonzero(strange).tolist(), vocab.filter(pa.array(strange)).to_pylist(), strict=True):
            rest = p[1:] if p[:1] in (" ", "\n") else p
            alone[i] = bool(p) and not rest
            edge[i] = bool(rest) and (rest[0].isspace() or rest[-1].isspace())
        lone = alone[codes]
        wrong = edge[codes]
        last = np.zeros(len(codes) + 1, bool)
        last[off] = True
        wrong[:-1] |= lone[:-1] & lone[1:] & ~last[1:-1]
        if wrong.any():
            odd |= np.add.reduceat(wrong, off[:-1]) > 0
        ids, begin = self.pieces(vocab)
        ids, start = gathered(ids, begin, codes)
        start = start[off]
        if not odd.any():
            return ids, start
        slow = np.flatnonzero(odd)
        own, own_start = self.whole([texts[int(i)].as_py() for i in slow])
        order = np.arange(docs)
        order[slow] = docs + np.arange(len(slow))
        return gathered(np.concatenate([ids, own]), np.concatenate([start, start[-1] + own_start[1:]]), order)


def with_end(ids: np.ndarray, start: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text followed by end_id."""
    docs = len(start) - 1
    out = np.empty(len(ids) + docs, np.uint32)
    begin = start + np.arange(docs + 1)
    last = np.zeros(len(out), bool)
    last[begin[1:] - 1] = True
    out[last] = end_id
    out[~last] = ids
    return out, begin
