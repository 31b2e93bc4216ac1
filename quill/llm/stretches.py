"""Ids of many texts at once: texts are cut where no token can reach across, and each different stretch is encoded once.

The bytes of an Arrow batch of texts are searched for sure boundaries in a few vector operations; the stretches between
them are dictionary-encoded without being copied, only those that the worker doesn't know yet go to the tokenizer, and the
ids of all texts are gathered from those of the stretches. Texts in which the boundaries would not be sure are encoded
whole. The ids are those of the whole texts; tests compare both.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Stretches that a worker remembers at most.
KNOWN = 800_000
SPACE, LINE = 0x20, 0x0A
STOPS = (0x2C, 0x2E)
#: By byte: ASCII letters; bytes that begin a visible character below U+0280.
LETTER, VISIBLE = (np.zeros(256, bool) for _ in range(2))
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
VISIBLE[[*range(0x21, 0x7F), *range(0xC3, 0xCA)]] = True


class Bytes:
    """The bytes of a batch of texts, one text after another, searched by the places of single bytes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.data, self.begins = data, np.zeros(len(data), bool)
        #: True where a text begins, and at the end.
        self.first = np.zeros(len(data) + 1, bool)
        self.first[starts] = self.first[-1] = self.begins[starts] = True

    def places(self, *values: int) -> np.ndarray:
        found = self.data == values[0]
        for v in values[1:]:
            found |= self.data == v
        return np.flatnonzero(found)

    def next(self, at: np.ndarray) -> np.ndarray:
        """The byte after each place, 0 after a text's last."""
        return np.where(self.first[at + 1], 0, self.data[np.minimum(at + 1, len(self.data) - 1)])

    def last(self, at: np.ndarray, by: int = 1) -> np.ndarray:
        """The byte before each place, 0 before a text's first."""
        out = np.where(self.first[at], 0, self.data[at - 1])
        return out if by == 1 else np.where(out == 0, 0, self.last(np.maximum(at - 1, 0), by - 1))

    def after_letter(self, at: np.ndarray) -> np.ndarray:
        """Whether an ASCII letter or one of U+00C0 to U+027F stands before; not the signs of multiplication and division."""
        last, lead = self.last(at), self.last(at, 2)
        return LETTER[last] | ((lead >= 0xC4) & (lead < 0xCA)) | ((lead == 0xC3) & (last != 0x97) & (last != 0xB7))


class StretchEncoder:
    """Base: a subclass says where stretches begin, and encodes stretches and whole texts. Null texts are empty ones."""

    kind = np.dtype("<u4")
    #: Texts that contain one of these are encoded whole.
    odd: tuple[str, ...] = ()

    def __init__(self):
        self.known: dict[str, bytes] = {}

    def cut(self, b: Bytes) -> None:
        """Sets b.begins where a stretch begins inside a text."""
        raise NotImplementedError

    def stretch_ids(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all stretches one after another, how many each has)."""
        raise NotImplementedError

    def whole_ids(self, text: str) -> list[int]:
        raise NotImplementedError

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's begin, and the end)."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = {}
        for x in self.odd:
            for i in np.nonzero(pc.match_substring(texts, x).to_numpy(zero_copy_only=False))[0].tolist():
                whole[i] = None
        if not whole:
            return self._plain(texts)
        for i in whole:
            whole[i] = np.array(self.whole_ids(texts[i].as_py()), self.kind)
        ids, bounds = self._plain(pa.array(["" if i in whole else t for i, t in enumerate(texts.to_pylist())], pa.string()))
        parts = [whole[i] if i in whole else ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.frombuffer(texts.buffers()[1], "<i4", len(texts) + 1, 4 * texts.offset) if len(texts) else np.zeros(1, "<i4")
        if offsets[-1] == offsets[0]:
            return np.zeros(0, self.kind), np.zeros(len(texts) + 1, np.int64)
        buffer = texts.buffers()[2]
        data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]]
        starts = np.unique(offsets[:-1][offsets[1:] > offsets[:-1]]) - offsets[0]
        b = Bytes(data, starts)
        self.cut(b)
        at = np.flatnonzero(b.begins)
        cuts = np.append(at, len(data)) + offsets[0]
        stretches = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(cuts.astype("<i4").tobytes()), buffer])
        coded = stretches.dictionary_encode()
        found = self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        counts = np.array([len(x) for x in found], np.int64) // self.kind.itemsize
        ids, which = np.frombuffer(b"".join(found), self.kind), coded.indices.to_numpy(zero_copy_only=False)
        n = counts[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        firsts = (np.cumsum(counts) - counts)[which]
        out = ids[np.repeat(firsts - ends[:-1], n) + np.arange(ends[-1])]
        return out, ends[np.searchsorted(at, offsets - offsets[0])]

    def _known(self, stretches: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        found = list(map(known.get, stretches))
        at = [i for i, x in enumerate(found) if x is None]
        if at:
            new = [stretches[i] for i in at]
            ids, counts = self.stretch_ids(new)
            raw, ends = ids.astype(self.kind).tobytes(), (np.cumsum(counts) * self.kind.itemsize).tolist()
            start = 0
            for i, x, end in zip(at, new, ends, strict=True):
                found[i] = known[x] = raw[start:end]
                start = end
        return found


class ByteLevelStretches(StretchEncoder):
    """A byte-level BPE file of the tokenizers library, whose pre-tokens are runs of letters, numbers, others or white
    space, the first three with a space before them.

    So a pre-token begins at a space that something visible follows, a full stop or comma after a letter is a pre-token's
    begin, and a line feed between one of these and a letter stands alone. special=False takes the strings of special
    tokens as plain text; else a text that may have one is encoded whole. Where each merge makes the next id, as in the
    public file, the ids are the merges' ranks, and the stretches are encoded by tiktoken, which does the same faster.
    """

    def __init__(self, path: str, pattern: str, special: bool = True):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["id"]: t["content"] for t in spec["added_tokens"]}
        spelled = byte_spelling()
        self.bytes_of = {i: added[i].encode() if i in added else bytes(spelled[c] for c in t) for t, i in self.tokenizer.get_vocab().items()}
        self.odd = tuple(added.values()) if special else ()
        self.kind = np.dtype("<u2" if max(self.bytes_of) < 1 << 16 else "<u4")
        vocabulary = spec["model"]["vocab"]
        made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        self.ranks = None
        if made == sorted(set(made)) and not spec.get("normalizer"):
            self.ranks = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={b: i for i, b in self.bytes_of.items() if i not in added}, special_tokens={})

    def cut(self, b: Bytes) -> None:
        spaces, stops, lines = b.places(SPACE), b.places(*STOPS), b.places(LINE)
        b.begins[spaces[VISIBLE[b.next(spaces)]]] = True
        b.begins[stops[b.after_letter(stops)]] = True
        alone = lines[np.isin(b.last(lines), STOPS) & LETTER[b.next(lines)]]
        b.begins[alone] = b.begins[alone + 1] = True

    def stretch_ids(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.ranks is not None:
            got = list(map(self.ranks.encode_ordinary, stretches))
        else:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(stretches, add_special_tokens=False)]
        counts = np.array(list(map(len, got)), np.int64)
        return np.fromiter(chain.from_iterable(got), np.int64, counts.sum()), counts

    def whole_ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class PieceStretches(StretchEncoder):
    """A sentencepiece BPE model without normalisation, which puts a space before the text.

    No piece may go on with a space after something else, join a letter and a following full stop or comma, or hold a line
    feed but as a byte; a model with such pieces has its texts encoded whole, as are texts with U+2581.
    """

    odd = ("▁",)

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.line = self.model.piece_to_id("<0x0A>")
        joins, probe = re.compile(r"[^▁]▁|[A-Za-zÀ-ɿ][.,]|\n"), "ﬁ é  Å "
        plain = self.model.decode(self.model.encode(probe)) == probe and self.model.encode("\n")[1:] == [self.line]
        self.by_stretch = plain and not any(joins.search(p) for p in pieces)
        self.kind = np.dtype("<u2" if len(pieces) <= 1 << 16 else "<u4")
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.bytes_of = {i: bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}

    def cut(self, b: Bytes) -> None:
        spaces, stops, lines = b.places(SPACE), b.places(*STOPS), b.places(LINE)
        b.begins[spaces[b.last(spaces) != SPACE]] = True
        b.begins[stops[b.after_letter(stops)]] = True
        b.begins[lines] = True
        b.begins[lines[~b.first[lines + 1]] + 1] = True

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.string()), "")
        # the model's space is part of the first stretch; an empty text gets none
        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise("", texts, " "))
        if self.by_stretch:
            return super().batch(texts)
        ids = [np.array(self.whole_ids(t), self.kind) for t in texts.to_pylist()]
        return np.concatenate([np.zeros(0, self.kind), *ids]), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)

    def stretch_ids(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many stretches are one text with line feeds between them, over which no piece reaches."""
        found, counts = [], np.ones(len(stretches), np.int64)
        for s in range(0, len(stretches), 1024):
            ids = np.array(self.model.encode("\n" + "\n".join(["" if x == "\n" else x for x in stretches[s : s + 1024]])), np.int64)
            at = np.flatnonzero(ids == self.line)
            counts[s : s + 1024] = np.diff(np.append(at, len(ids))) - 1
            found.append(ids[1:])
        ids = np.concatenate(found)
        # what stands after a stretch's line feed is its own; a stretch that is a line feed keeps it
        ends = np.cumsum(counts + 1)
        keep = np.ones(len(ids), bool)
        lines = np.array([x == "\n" for x in stretches], bool)
        keep[(ends - counts - 1)[~lines]] = False
        counts[lines] = 1
        return ids[keep], counts

    def whole_ids(self, text: str) -> list[int]:
        return self.model.encode(text[1:]) if text else []


def byte_spelling() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters for themselves, the
    other bytes in order for the characters from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def byte_level(path: str, pattern: str, special: bool = True) -> ByteLevelStretches:
    return ByteLevelStretches(path, pattern, special)


@lru_cache(maxsize=2)
def pieces(path: str) -> PieceStretches:
    return PieceStretches(path)
