"""Token ids of texts, by tokenizers whose words can be encoded one by one.

Both kinds of public tokenizer used here never join what stands on the two sides of a single blank
or line end between two other characters. So texts are cut there, the distinct pieces of a batch
are found by Arrow, a piece that is not remembered is encoded by the tokenizers library, and array
operations put the ids of the pieces in their places. The result equals encoding the whole text.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strayrow.llm.texts import give_back

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

REMEMBERED = 900_000
REMEMBERED_LENGTH = 64
CHUNK_BYTES = 12_000_000
RUN = 8_192

_SPACES = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: White space beside a blank or line end, or at an end of the text.
_UNSURE = f"[ \\n][{_SPACES}]|[{_SPACES}][ \\n]|\\A[{_SPACES}]|[{_SPACES}]\\z"
_CUT = re.compile(r"(?<=\S) (?=\S)")


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + count], one after the other."""
    ends = np.cumsum(counts)
    shift = np.repeat(starts - (ends - counts), counts)
    return flat[np.arange(len(shift)) + shift]


class _Memory:
    """Pieces and their ids as Arrow and numpy arrays; bounded by ``REMEMBERED`` short pieces.

    When it is full, what no batch has asked for since the last time is forgotten, or, if that is
    too little, everything.
    """

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.pieces = pa.array([], pa.string())
        self.flat = np.zeros(0, "<u4")
        self.counts = np.zeros(0, np.int64)
        self.used = np.zeros(0, bool)

    def places(self, pieces: pa.Array) -> np.ndarray:
        """Place of each piece, -1 for an unknown one."""
        found = pc.index_in(pieces, value_set=self.pieces).fill_null(-1).to_numpy().copy()
        self.used[found[found >= 0]] = True
        return found

    def starts(self) -> np.ndarray:
        return np.cumsum(self.counts) - self.counts

    def learn(self, pieces: pa.Array, flat: np.ndarray, counts: np.ndarray) -> None:
        short = pc.less_equal(pc.utf8_length(pieces), REMEMBERED_LENGTH).to_numpy(zero_copy_only=False)
        if not short.all():
            flat = flat[np.repeat(short, counts)]
            pieces, counts = pieces.filter(pa.array(short)), counts[short]
        if len(self.pieces) + len(pieces) > REMEMBERED:
            if self.used.sum() > REMEMBERED // 2:
                self.forget()
            else:
                self.flat = self.flat[np.repeat(self.used, self.counts)]
                self.pieces = self.pieces.filter(pa.array(self.used))
                self.counts = self.counts[self.used]
                self.used = np.zeros(len(self.counts), bool)
        self.pieces = pa.concat_arrays([self.pieces, pieces])
        self.flat = np.concatenate([self.flat, flat])
        self.counts = np.concatenate([self.counts, counts])
        self.used = np.concatenate([self.used, np.zeros(len(counts), bool)])


class PieceEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    ``blanks_count`` tells whether the tokenizer keeps white space (a blank then belongs to the
    piece after it) or drops it.
    """

    def __init__(self, path: str, blanks_count: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.blanks_count = blanks_count
        self.memory = _Memory()

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has; encoded in short runs, as the
        library's results are large."""
        flat, counts = array("I"), array("l")
        for at in range(0, len(pieces), RUN):
            texts = list(map(self._plain, pieces[at : at + RUN]))
            for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                counts.append(len(found))
                flat.extend(found.ids)
        return np.array(flat, "<u4"), np.array(counts, np.int64)

    def _pieces(self, texts: pa.Array) -> pa.ListArray:
        """Where blanks count, a piece that has no blank before it is marked by a line end."""
        if not self.blanks_count:
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        marked = pc.binary_join_element_wise("", pc.replace_substring(texts, "\n", " \n \n"), "\n")
        cut = pc.split_pattern(marked, " ")
        unsure = pc.match_substring_regex(texts, _UNSURE)
        if not pc.any(unsure).as_py():
            return cut
        odd = np.flatnonzero(unsure.to_numpy(zero_copy_only=False))
        own = pa.array([_CUT.split("\n" + t) for t in texts.take(pa.array(odd)).to_pylist()], cut.type)
        place = np.arange(len(texts))
        place[odd] = len(texts) + np.arange(len(odd))
        return pa.concat_arrays([cut, own]).take(pa.array(place))

    def _plain(self, piece: str) -> str:
        """What a piece stands for in the text."""
        if not self.blanks_count or piece == "\n":
            return piece
        return piece[1:] if piece[:1] == "\n" else " " + piece

    def _chunk(self, texts: pa.Array) -> list[bytes]:
        cut = self._pieces(texts)
        offsets = cut.offsets.to_numpy().copy()
        coded = cut.values.slice(int(offsets[0])).dictionary_encode()
        del cut
        memory, pieces = self.memory, coded.dictionary
        places = memory.places(pieces)
        new = np.flatnonzero(places < 0)
        missed = pieces.take(pa.array(new))
        new_flat, new_counts = self._ids(missed.to_pylist())
        # Remembered ids, then new ones.
        starts = np.concatenate([memory.starts(), len(memory.flat) + np.cumsum(new_counts) - new_counts])
        counts = np.concatenate([memory.counts, new_counts])
        flat = np.concatenate([memory.flat, new_flat])
        places[new] = len(memory.counts) + np.arange(len(new))
        own = places[coded.indices.to_numpy()]
        sizes = counts[own]
        data = gather(flat, starts[own], sizes).tobytes()
        del flat, starts, counts, own
        memory.learn(missed, new_flat, new_counts)
        before = np.concatenate([[0], np.cumsum(sizes)])
        ends = (4 * before[offsets - offsets[0]]).tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text, in order; a null or empty text has none."""
        texts = pc.fill_null(texts, "") if texts.null_count else texts
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < len(texts):
            # At least one text, else as many as the chunk holds.
            held = np.searchsorted(np.cumsum(sizes[at:]), CHUNK_BYTES, "right")
            end = at + max(1, int(held))
            ids = self._chunk(texts.slice(at, end - at))
            give_back()
            yield from (i if n else b"" for i, n in zip(ids, sizes[at:end].tolist()))
            at = end


@lru_cache(maxsize=4)
def encoder(path: str, blanks_count: bool) -> PieceEncoder:
    """One encoder for all tasks of a worker, with what it remembers."""
    return PieceEncoder(path, blanks_count)
