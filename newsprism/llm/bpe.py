"""BPE encoding and decoding with a published vocabulary, by tree concatenation.

Text splits exactly at ASCII white space: the vocabulary's pre-tokenizer drops it, and its
normaliser neither reaches across it nor removes it.  Each distinct run between spaces is
encoded once a chunk, its pre-tokens come from a bounded cache, and the ids of the chunk's texts are
gathered from there.

A run that the pre-tokenizer leaves long and unsplit is cut into leaves.  The leaves are encoded
as one parallel batch - all but the last by the same merges without the end-of-word suffix - and
concatenated pairwise, up a tree: at each join a window of tokens on both sides is re-encoded
and grows until it starts and ends with the tokens that the two sides already have.  A token
sequence is the BPE encoding of its text if each adjacent pair is the encoding of its own text,
so agreement beyond the window follows from agreement at its ends.

Defined cases: null text counts as empty and gives no ids; an empty list decodes to the empty
string; rows are encoded on their own, so repeated ids or rows change nothing; extra columns
pass through, and a result column replaces an input column of its name.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from newsprism.llm import vec
from newsprism.llm.columns import Columns, arrow_schema, batch_of, boxed_schema

#: Symbols of an unsplit run that are encoded in one piece.
LEAF = 512
#: Tokens on each side of a join that are re-encoded at first, and that must agree at its ends.
WINDOW, AGREE = 8, 2
#: Pre-tokens that a worker keeps; beyond that the cache starts anew.
PIECES = 250_000
CHUNK_BYTES = 4 << 20
#: Runs of printable ASCII and Latin-1 letters are split here: normal form C leaves them alone, and
#: below is what the pattern _KNOWN means on them.  All others, and other vocabularies, go through
#: the library's own normaliser and pre-tokenizer.
_OTHER = re.compile("[^!-~À-ÖØ-öø-ÿ\n]|<\\|")
#: Runs are split together, a newline behind each.
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^a-z0-9ß-öø-ÿ\n]+")
#: The byte-level symbols of Latin-1 letters: bytes 0xA1 to 0xFF but 0xAD stand for themselves,
#: 0x80 to 0xA0 for U+0122 to U+0142, 0xAD for U+0143.
_SYMBOLS = {c: "".join(chr(b) if b >= 0xA1 and b != 0xAD else chr(0x143 if b == 0xAD else b + 0xA2) for b in chr(c).encode()) for c in range(0xC0, 0x100)}
_KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of this vocabulary file, loaded once."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


class _Pieces(dict):
    """Numbers of pre-tokens, given as plain text: piece k has the ids from ends[k] to ends[k + 1].  The
    codec's model finds those that are missing; the newline is piece 0 and has none."""

    def __init__(self, codec: Codec):
        super().__init__({"\n": 0})
        self.codec, self.ids, self.ends = codec, array("I"), array("q", [0, 0])

    def __missing__(self, text: str) -> int:
        symbols = text if text.isascii() else text.translate(_SYMBOLS)
        self.ids.extend(self.codec._model(symbols))
        self.ends.append(len(self.ids))
        k = self[text] = len(self.ends) - 2
        return k


class Codec:
    def __init__(self, path: str, leaf: int = LEAF):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.leaf = leaf
        self.whole = Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None}))
        self.model = self.whole.model
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.path, self.parts = path, {}
        size = self.whole.get_vocab_size(with_added_tokens=True)
        self.names = [self.whole.id_to_token(i) or "" for i in range(size)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        lower = any(n.get("type") == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", []))
        self.plain = lower and steps[0].get("pattern", {}).get("Regex") == _KNOWN
        self.joiner = b" " if spec.get("decoder") is None else None
        self.pieces = _Pieces(self)

    def _part(self, final: bool) -> Tokenizer:
        """The merges alone, for the end of a run or for what stands before it.  Only long runs need
        them, so they are loaded with the first."""
        if final not in self.parts:
            with open(self.path, encoding="utf-8") as f:
                spec = json.load(f)
            bare = {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}
            model = spec["model"] if final else spec["model"] | {"end_of_word_suffix": None}
            self.parts[final] = Tokenizer.from_str(json.dumps(spec | bare | {"model": model}))
        return self.parts[final]

    # -- runs ------------------------------------------------------------------------------

    def _model(self, symbols: str) -> list[int]:
        """Ids of one pre-token, given as the model's symbols."""
        return self.long(symbols) if len(symbols) > self.leaf else [t.id for t in self.model.tokenize(symbols)]

    def run(self, text: str) -> list[int]:
        """Ids of a run without ASCII white space."""
        parts = self.split_special.split(text) if self.split_special else [text]
        out: list[int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                normal = self.whole.normalizer.normalize_str(part) if self.whole.normalizer else part
                pieces = self.whole.pre_tokenizer.pre_tokenize_str(normal) if self.whole.pre_tokenizer else [(normal, None)]
                out += [i for s, _ in pieces for i in self._model(s)]
        return out

    def runs(self, text: str, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs, and where each one's start (one more at the end).  text: a newline behind each
        run; ends: the places of these newlines."""
        others: dict[int, list[int]] = {}
        if not self.plain or _OTHER.search(text):
            odd = np.array([m.start() for m in _OTHER.finditer(text)], np.int64) if self.plain else ends
            words = text.split("\n")
            others = {k: self.run(words[k]) for k in np.unique(np.searchsorted(ends, odd)).tolist()}
            for k in others:
                words[k] = ""
            text = "\n".join(words)
        if len(self.pieces) > PIECES:
            self.pieces = _Pieces(self)
        parts = _SPLIT.findall(text.lower())
        piece = np.fromiter(map(self.pieces.__getitem__, parts), np.int64, len(parts))
        begin = np.array(self.pieces.ends, np.int64)
        size = np.diff(begin)[piece]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = np.array(self.pieces.ids, np.uint32)[np.repeat(begin[piece] - total[:-1], size) + np.arange(total[-1])]
        starts = np.concatenate([[0], total[np.flatnonzero(piece == 0)]])
        if not others:
            return ids, starts
        sizes = np.diff(starts)
        plain = np.ones(len(sizes), bool)
        plain[list(others)] = False
        sizes[list(others)] = [len(x) for x in others.values()]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(starts[-1], np.uint32)
        out[np.repeat(plain, sizes)] = ids
        for k, x in others.items():
            out[starts[k] : starts[k + 1]] = x
        return out, starts

    # -- tree concatenation ------------------------------------------------------------------

    def _text(self, ids: list[int]) -> str:
        return "".join(self.names[i] for i in ids)

    def _piece(self, symbols: str, final: bool) -> list[int]:
        return self._part(final).encode(symbols, add_special_tokens=False).ids

    def long(self, symbols: str) -> list[int]:
        cuts = [symbols[i : i + self.leaf] for i in range(0, len(symbols), self.leaf)]
        level = [e.ids for e in self._part(False).encode_batch(cuts[:-1], add_special_tokens=False)] + [self._piece(cuts[-1], True)]
        while len(level) > 1:
            pairs = range(0, len(level) - 1, 2)
            joined = [self.join(level[k], level[k + 1], k + 2 == len(level)) for k in pairs]
            level = joined + ([level[-1]] if len(level) % 2 else [])
        return level[0]

    def join(self, left: list[int], right: list[int], final: bool) -> list[int]:
        """The encoding of left's text and right's text as one; final: right ends the run."""
        a, b = min(WINDOW, len(left)), min(WINDOW, len(right))
        while True:
            at_end = b == len(right)
            text = self._text(left[len(left) - a :]) + self._text(right[:b])
            if final and at_end and self.suffix and text.endswith(self.suffix):
                text = text[: -len(self.suffix)]
            mid = self._piece(text, final and at_end)
            from_left, to_right = left[len(left) - a :], right[:b]
            fits_left = a == len(left) or mid[:AGREE] == from_left[:AGREE]
            fits_right = at_end or mid[-AGREE:] == to_right[-AGREE:]
            if fits_left and fits_right:
                return left[: len(left) - a] + mid + right[b:]
            a = a if fits_left else min(2 * a, len(left))
            b = b if fits_right else min(2 * b, len(right))

    # -- chunks of documents -----------------------------------------------------------------

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's ids start (one more at the end)."""
        w = vec.Words(texts)
        inside = ~vec.SPACES[w.buf]
        offsets = np.zeros(w.n + 1, np.int32)
        np.cumsum(w.ends - w.starts, out=offsets[1:])
        coded = pa.Array.from_buffers(pa.binary(), w.n, [None, pa.py_buffer(offsets), pa.py_buffer(w.buf[inside])]).dictionary_encode()
        if not w.n:
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        known = coded.dictionary
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(known)], known), b"\n")[0].as_py().decode() + "\n"
        ids, starts = self.runs(text, np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10))
        words = coded.indices.to_numpy()
        begin = starts[words]
        n = starts[words + 1] - begin
        total = np.concatenate([[0], np.cumsum(n)])
        return ids[np.repeat(begin - total[:-1], n) + np.arange(total[-1])], total[w.first]

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """Texts of consecutive id lists, as the library's decode() gives them."""
        if self.joiner is None:
            return [self.whole.decode(ids[a:b].tolist(), skip_special_tokens=False).encode() for a, b in zip(starts, starts[1:], strict=False)]
        if not hasattr(self, "spaced"):
            self.spaced = pa.array([n.encode() + self.joiner for n in self.names], pa.binary())
            self.widths = np.array([len(n.encode()) + 1 for n in self.names])
        data = self.spaced.take(pa.array(ids)).buffers()[2] if len(ids) else None
        raw = data.to_pybytes() if data else b""
        at = np.concatenate([[0], np.cumsum(self.widths[ids])])[starts]
        return [raw[a : max(a, b - 1)] for a, b in zip(at.tolist(), at.tolist()[1:], strict=False)]


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", end_id: int | None = None, decode: bool = True) -> DataFrame:
    """The rows of `docs` with n_tokens, ids (little-endian unsigned 32-bit, as binary) and, if
    asked, decoded text.  A map over the rows: nothing is shuffled.  `end_id` is appended to the
    ids of each document."""
    results = ["n_tokens", "ids", *["decoded"] * decode]
    own = Columns(docs, results, [text_col])
    rows = own.rows(text=own[text_col].cast("string"))
    spark_schema = boxed_schema(rows, "n_tokens bigint, ids binary" + ", decoded string" * decode)
    schema = arrow_schema(docs.sparkSession, spark_schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vec.release()
        c = codec(path)
        for batch in batches:
            texts = vec.utf8(batch.column(1))
            for i, j in vec.chunks(texts, CHUNK_BYTES):
                ids, starts = c.encode(texts[i:j])
                if end_id is not None:
                    ids = np.insert(ids, starts[1:], np.uint32(end_id))
                    starts = starts + np.arange(len(starts))
                raw, at = ids.astype("<u4").tobytes(), (4 * starts).tolist()
                cols = [*(x.slice(i, j - i) for x in batch.columns), pa.array(np.diff(starts), pa.int64()), pa.array([raw[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())]
                if decode:
                    cols.append(pa.array(c.decode(ids, starts), pa.binary()).cast(pa.string()))
                yield batch_of(cols, schema)
        vec.release()

    return own.back(rows.mapInArrow(encode, spark_schema), results, **{text_col: "text"})
