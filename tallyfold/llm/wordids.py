"""Token ids of many texts at once, from the ids of their words.

For a tokenizer that drops blanks, ignores case and cuts texts at the borders of letters, digits and signs before it
merges (word_bpe_49k.json), the ids of a text are those of its words in order. Texts are cut with numpy, equal words of
a slice are coded once and remembered, and the ids are taken by index. Cuts are made only where the tokenizer surely
makes them as well: at ASCII blanks, and between ASCII or Latin-1 letters, ASCII digits and ASCII signs other than the apostrophe.
"""

import os

import numpy as np
import pyarrow as pa

from tallyfold.llm.kernels import text_bytes

#: Bytes of text that are cut and coded at a time. Slices end at a blank or a text's end, so a long text takes several.
SLICE_BYTES = 1 << 20

_LETTER, _SIGN, _DIGIT, _OTHER, _BLANK = 1, 2, 3, 0, 4
_KINDS = np.zeros(256, np.uint8)
_KINDS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _SIGN
_KINDS[[*range(65, 91), *range(97, 123)]] = _LETTER
_KINDS[48:58] = _DIGIT
_KINDS[39] = _OTHER  # an apostrophe may begin 's, 't, ...
_KINDS[[*range(9, 14), 32]] = _BLANK


def blank_slices(data: np.ndarray, ends: np.ndarray, limit: int):
    """Byte ranges of about `limit` that end behind a blank or at the end of a text."""
    low, n = 0, len(data)
    while low < n:
        high = low + limit
        if high >= n:
            high = n
        else:
            stops = np.flatnonzero(_KINDS[data[low:high]] == _BLANK)
            text_end = int(ends[np.searchsorted(ends, high, "right") - 1])
            cut = max(low + int(stops[-1]) + 1 if len(stops) else 0, text_end)
            while cut <= low:  # neither within the slice: go on to the next
                more = data[high:high + limit]
                stops = np.flatnonzero(_KINDS[more] == _BLANK)
                later = int(ends[min(np.searchsorted(ends, high, "left"), len(ends) - 1)])
                if len(stops):
                    cut = min(high + int(stops[0]) + 1, later)
                elif later <= high + len(more):
                    cut = later
                else:
                    high += len(more)
            high = cut
        yield low, high
        low = high


class WordIds:
    """Ids of whole texts; up to `kept` words are remembered over batches (more are coded where they occur)."""

    def __init__(self, path: str, kept: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.codec, self.kept = Tokenizer.from_file(path), kept
        vocabulary = self.codec.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.closes = np.zeros(self.size, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, int] = {}
        self.ids, self.at = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)  # ids of word k: ids[at[k]:at[k + 1]]

    def _coded(self, words: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Words in the order in which they were coded, number of ids of each, and the ids.

        Words of letters only give one closing token each, so that many are coded as one text.
        """
        texts = [w.decode() for w in words]
        plain = [i for i, t in enumerate(texts) if t.isalpha()]
        rest = [i for i, t in enumerate(texts) if not t.isalpha()]
        order, lengths, ids = [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for a in range(0, len(plain), 4096):
            part = plain[a:a + 4096]
            found = np.array(self.codec.encode(" ".join([texts[i] for i in part]), add_special_tokens=False).ids, np.uint32)
            stops = np.flatnonzero(self.closes[found]) + 1
            if len(stops) != len(part) or stops[-1] != len(found):
                rest += part  # a letter that the tokenizer takes apart
                continue
            order += part
            lengths.append(np.diff(stops, prepend=0))
            ids.append(found)
        for a in range(0, len(rest), 4096):
            part = rest[a:a + 4096]
            found = [x.ids for x in self.codec.encode_batch([texts[i] for i in part], add_special_tokens=False)]
            order += part
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter((k for x in found for k in x), np.uint32))
        return order, np.concatenate(lengths), np.concatenate(ids)

    def _add(self, lengths: np.ndarray, ids: np.ndarray, first: int):
        """Keep the ids of words first, first + 1, ..."""
        if first + len(lengths) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros(max(len(self.at), len(lengths) + 1), np.int64)])
        start = int(self.at[first])
        self.at[first + 1:first + 1 + len(lengths)] = start + np.cumsum(lengths)
        if start + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        self.ids[start:start + len(ids)] = ids

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each of some distinct words; those beyond `kept` have one for this call only."""
        found = np.array([self.known.get(w, -1) for w in words], np.int64)
        new = np.flatnonzero(found < 0)
        if len(new):
            first, fresh = len(self.known), [words[i] for i in new]
            order, lengths, ids = self._coded(fresh)
            self._add(lengths, ids, first)
            found[new[order]] = first + np.arange(len(order))
            self.known.update((fresh[i], k) for k, i in enumerate(order[:max(0, self.kept - first)], first))
        return found

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin and end; null counts as empty."""
        data, ends = text_bytes(column)
        counts, parts = np.zeros(len(ends) - 1, np.int64), []
        for low, high in blank_slices(data, ends, SLICE_BYTES):
            part = data[low:high]
            kinds = _KINDS[part]
            special = b"<|" in part.tobytes()  # special tokens may stand here: cut at blanks only, keep capitals
            cut = np.zeros(len(part), bool)
            cut[0] = True
            cut[1:] = kinds[:-1] == _BLANK
            if not special:
                wide = np.flatnonzero(part[:-1] == 0xC3)
                wide = wide[(part[wide + 1] != 0x97) & (part[wide + 1] != 0xB7)]
                kinds[wide] = kinds[wide + 1] = _LETTER
                both = (kinds[1:] != _OTHER) & (kinds[:-1] != _OTHER)
                cut[1:] |= both & ((kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT))
                capital = (part >= 65) & (part <= 90)
                capital[:-1] &= part[1:] < 0x80  # else a mark may join it, for which case counts
                capital[-1] = False
                part = part + (capital.astype(np.uint8) << 5)
            heads = ends[np.searchsorted(ends, low):np.searchsorted(ends, high)] - low
            cut[heads[heads < len(part)]] = True
            solid = kinds != _BLANK
            starts = np.flatnonzero(cut & solid)
            if not len(starts):
                continue
            place = np.zeros(len(part) + 1, np.int32)
            np.cumsum(solid, out=place[1:])
            offsets = np.append(place[starts], place[-1]).astype(np.int32)
            words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(part[solid])]).dictionary_encode()
            number = self._numbers(words.dictionary.to_pylist())[np.asarray(words.indices)]
            begin, length = self.at[number], self.at[number + 1] - self.at[number]
            stop = np.cumsum(length)
            parts.append(self.ids[np.repeat(begin - stop + length, length) + np.arange(stop[-1])])
            owner = np.searchsorted(ends, starts + low, "right") - 1
            counts += np.bincount(owner, weights=length, minlength=len(counts)).astype(np.int64) if len(counts) < 4096 else _spread(owner, length, len(counts))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum(counts)])


def _spread(owner: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, owner, length)
    return out


_codecs: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One codec a worker process, so that what it has seen serves its later tasks."""
    if path not in _codecs:
        _codecs[path] = WordIds(path)
    return _codecs[path]
