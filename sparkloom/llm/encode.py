"""Byte-level BPE through the tokenizers library, with a memo of words.

The pre-tokenizer of a byte-level BPE never joins what stands before a single space with that
space and a non-space after it, and a lone line break is a pre-token of its own. So a text may
be cut there, and a word's ids are the same wherever it stands. Each new word goes through the
library; a text's ids are then joined from the memo. Batches are cut by Arrow, which looks up each
of their words once. Texts where white space stands at an end or in a row are cut only where that
is safe, one by one.
"""

from __future__ import annotations

import os
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import process_cache

#: Words that a worker's memo holds at most, but for those of one batch; beyond it, the fifth that came last goes.
MEMO = 400_000
_RUNS = re.compile(r"\s\s|^\s|\s$|\r")
#: The same for Arrow's expressions, whose white space would be that of ASCII.
_SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ARROW_RUNS = rf"{_SPACES}{_SPACES}|\A{_SPACES}|{_SPACES}\z|\r"
#: Bytes beyond which a text is cut by itself (Arrow counts to 2^31 in a batch), and bytes of texts whose words are looked up at once.
LONG, CHUNK = 1 << 26, 8 << 20
#: Letters below this character count as letters in every version of Unicode.
LATIN = "ɐ"
_TAILED = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")
#: A byte-level vocabulary spells byte b as the character b if that prints, else as the next one from 256 on.
_SPELLED = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}
_SPACE = chr(_SPELLED[32])


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo(dict):
    """Calls ``learn`` for a key that it lacks."""

    learn = None

    def __missing__(self, key: str) -> bytes:
        return self.learn(key)


class Encoder:
    """ids of whole texts as little-endian unsigned 32-bit bytes.

    Keys of the memo: a word stands for itself with a space before it, \\r and a word for the
    word alone, any other text with \\r\\r before it for itself.
    """

    def __init__(self, path: str, most: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.memo, self.most = Memo(), most
        self.memo.learn = self._learn
        self.tails: dict[str, bytes] = {}
        self.four = [i.to_bytes(4, "little") for i in range(self.tok.get_vocab_size())]

    def _whole(self, text: str) -> bytes:
        four = self.four
        return b"".join([four[i] for i in self.tok.encode(text, add_special_tokens=False).ids])

    def _pretoken(self, text: str, space: str) -> bytes:
        """The ids of one pre-token, in the vocabulary's spelling of bytes."""
        four = self.four
        spelled = text if text.isascii() else text.encode().decode("latin-1").translate(_SPELLED)
        return b"".join([four[t.id] for t in self.tok.model.tokenize(space + spelled)])

    def _tail(self, marks: str) -> bytes:
        """The ids of a run of punctuation; the short ones, of which there are few, are kept."""
        ids = self.tails.get(marks)
        if ids is None:
            ids = self._pretoken(marks, "")
            if len(marks) <= 2:
                self.tails[marks] = ids
        return ids

    def _learn(self, key: str) -> bytes:
        """Letters are one pre-token, and so is a run of punctuation after them; the rest is encoded as text."""
        if key.isascii() and key.isalpha():
            four = self.four
            ids = self.memo[key] = b"".join([four[t.id] for t in self.tok.model.tokenize(_SPACE + key)])
            return ids
        if key[:1] == "\r":
            word, space, spelled = key[2 if key[:2] == "\r\r" else 1 :], "", ""
        else:
            word, space, spelled = key, " ", _SPACE
        if word.isalpha() and (word.isascii() or max(word) < LATIN) and key[:2] != "\r\r":
            ids = self._pretoken(word, spelled)
        elif key[:2] == "\r\r" or not word:
            ids = self._whole(word)
        elif (m := _TAILED.fullmatch(word)) and m[1].isalpha() and (m[1].isascii() or max(m[1]) < LATIN):
            ids = self.memo[m[1] if space else "\r" + m[1]] + self._tail(m[2])
        else:
            ids = self._whole(space + word)
        self.memo[key] = ids
        return ids

    def _keys(self, text: str) -> list[str]:
        if any(s in text for s in self.special):
            return ["\r\r" + text]
        if _RUNS.search(text):
            return ["\r\r" + x for x in re.split(r"(?= \S)", text)]
        return ("\r" + text.replace("\n", " \r\n \r")).split(" ")

    def _bound(self) -> None:
        if len(self.memo) > self.most:
            self.memo = Memo(islice(self.memo.items(), self.most * 4 // 5))
            self.memo.learn = self._learn

    def encode(self, texts: list[str]) -> list[bytes]:
        self._bound()
        get = self.memo.__getitem__
        return [b"".join(map(get, self._keys(t))) for t in texts]

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_array``, of texts without runs of white space."""
        self._bound()
        keys = pc.split_pattern(pc.binary_join_element_wise("\r", pc.replace_substring(texts, "\n", " \r\n \r"), ""), " ")
        words = keys.flatten().dictionary_encode()
        ids = list(map(self.memo.__getitem__, words.dictionary.to_pylist()))
        ends = np.zeros(len(ids) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) >> 2, out=ends[1:])
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))).take(words.indices)
        at = keys.offsets.to_numpy()
        return lists.flatten().to_numpy(), lists.offsets.to_numpy()[at - at[0]]

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each begins, with the end of all after them; a null text has none."""
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring_regex(texts, _ARROW_RUNS), pc.greater(pc.binary_length(texts), LONG))
        for x in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, x))
        odd = odd.to_numpy(zero_copy_only=False)
        if not len(odd) or not odd.any():
            return self._cut(texts)
        ids, ends = self._cut(texts.filter(pa.array(~odd)))
        plain = iter(np.split(ids, ends[1:-1])) if not odd.all() else iter(())
        hard = iter(self.encode(texts.filter(pa.array(odd)).to_pylist()))
        parts = [np.frombuffer(next(hard), "<i4") if o else next(plain) for o in odd.tolist()]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def stream(self, batches):
        """Each batch with the ids of its texts and where they begin, as ``encode_array`` gives them."""
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.column("text").nbytes
            if size >= CHUNK:
                yield from self._several(held)
                held, size = [], 0
        yield from self._several(held)

    def _several(self, held: list[pa.RecordBatch]):
        if not held:
            return
        ids, ends = self.encode_array(pa.chunked_array([b.column("text") for b in held]).combine_chunks())
        at = 0
        for b in held:
            part = ends[at : at + b.num_rows + 1]
            yield b, ids[part[0] : part[-1]], part - part[0]
            at += b.num_rows


def encoder(path: str, most: int = MEMO) -> Encoder:
    """This process's encoder of ``path``, with a memo of about ``most`` words."""
    cache = process_cache()
    if ("encoder", path, most) not in cache:
        cache["encoder", path, most] = Encoder(path, most)
    return cache["encoder", path, most]
