"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

A ranks file (base64 token, rank) becomes a BPE model over the byte alphabet: each byte is written as one
printable character, and every split of a token into two tokens is a merge at that token's rank, so the
merges of any adjacent pair agree with merging by ranks. Texts are cut into the pattern's pieces, a slice
of the batch at a time; each distinct piece is encoded once by the library (a bounded cache) and its ids
are copied to every place where the piece stands.
Decoding turns ids back into byte-alphabet texts and these into bytes; a character split over several
tokens is whole again once their bytes are joined. Offsets are characters: a token that holds part of a
character spans that character.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to no bytes; special
tokens do not exist, so their strings are ordinary text; an id outside the vocabulary raises; repeated
rows each get their own result; added columns replace input columns of the same name; a text longer than a
slice is a slice of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import array
import base64
import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .kernels import ranges, span_hash, trimmed

CACHE_PIECES = 200_000
SLICE_BYTES = 1_000_000


def byte_alphabet() -> list[str]:
    """The printable character for each byte: itself where printable, else the next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = itertools.count(256)
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def model_json(ranks: dict[bytes, int]) -> str:
    """The tokenizers model of a ranks file, as its JSON. Its size is that of the vocabulary."""
    from tokenizers import Tokenizer, models

    alphabet = byte_alphabet()
    write = lambda token: "".join(alphabet[b] for b in token)
    merges = [(write(t[:i]), write(t[i:])) for t, _ in sorted(ranks.items(), key=lambda x: x[1])
              for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    return Tokenizer(models.BPE(vocab={write(t): r for t, r in ranks.items()}, merges=merges)).to_str()


LETTER, NUMBER, OTHER, BLANK, BREAK = range(5)
BREAK_CHAR = "\ud800"  # between texts: no text holds a lone surrogate


def class_table() -> np.ndarray:
    """The pattern's class of every code point."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    for prop, kind in (("L", LETTER), ("N", NUMBER), ("White_Space", BLANK)):
        for m in regex.finditer(rf"\p{{{prop}}}+", every):
            at = np.frombuffer(m.group().encode("utf-32-le"), "<u4")
            out[at] = kind
    out[ord(BREAK_CHAR)] = BREAK
    return out


def piece_starts(cp: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the pattern's matches begin, for texts laid end to end with breaks between them.

    Pieces are runs of one class. The last blank before a run joins it if it is a space, and stands
    alone if not; blanks at the end of a text stay together. An apostrophe that begins a piece takes a
    contraction's letters with it.
    """
    if not len(cp):
        return np.empty(0, np.int64)
    kind = kinds[cp]
    new = np.empty(len(cp) + 1, bool)
    new[0] = new[-1] = True
    new[1:-1] = kind[1:] != kind[:-1]
    new[:-1][kind == BREAK] = True
    last = np.flatnonzero((kind[:-1] == BLANK) & (kind[1:] < BLANK))
    new[last] = True
    new[last[cp[last] == 32] + 1] = False
    quote = np.flatnonzero((cp[:-1] == 39) & (kind[1:] == LETTER))
    quote = quote[new[quote] & new[quote + 1]]
    first = cp[quote + 1]
    second = np.where(quote + 2 < len(cp), cp[np.minimum(quote + 2, len(cp) - 1)], 0)
    short = np.isin(first, [ord(c) for c in "stmd"])
    both = functools.reduce(np.logical_or, [(first == ord(x)) & (second == ord(y)) for x, y in ("re", "ve", "ll")])
    for hit, size in ((short, 2), (both & ~short, 3)):
        new[quote[hit] + 1] = False
        new[quote[hit] + size] = True
    return np.flatnonzero(new[:-1])


class Encoder:
    """Encodes slices of texts; keeps the ids of the pieces it has met, up to a bound."""

    BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # any two odd numbers

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.kinds = class_table()
        self._forget()

    def _forget(self):
        self.known, self.flat, self.count = {}, array.array("I"), array.array("I")

    def _learn(self, keys, pieces: list[str]) -> None:
        for i in range(0, len(pieces), 256):
            some = pieces[i:i + 256]
            mapped = [p.encode("utf-8").decode("latin-1").translate(self.alphabet) for p in some]
            e = self.tokenizer.encode(mapped, is_pretokenized=True, add_special_tokens=False)
            self.known.update(zip(keys[i:i + 256], range(len(self.count), len(self.count) + len(some))))
            self.flat.extend(e.ids)
            self.count.extend(np.bincount(e.word_ids, minlength=len(some)).tolist())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        joined = BREAK_CHAR.join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        starts = piece_starts(cp, self.kinds)
        ends = np.append(starts[1:], len(cp))
        breaks = cp[starts] == ord(BREAK_CHAR)
        text_of = np.cumsum(breaks)[~breaks]
        starts, ends = starts[~breaks], ends[~breaks]
        h1, h2 = (span_hash(cp, starts, ends, b) for b in self.BASES)
        _, first, which = np.unique(h1, return_index=True, return_inverse=True)
        if not np.array_equal(h2[first][which], h2):  # two pieces share a hash: keep every piece apart
            first, which = np.arange(len(starts)), np.arange(len(starts))
        if len(self.known) + len(first) > CACHE_PIECES:
            self._forget()
        keys = list(zip(h1[first].tolist(), h2[first].tolist()))
        new = [k for k, key in enumerate(keys) if key not in self.known]
        pieces = [joined[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
        self._learn([keys[k] for k in new], pieces)
        row = np.fromiter((self.known[key] for key in keys), np.int64, len(keys))[which]
        count, flat = np.array(self.count, np.int64), np.array(self.flat, "<u4")
        n = count[row]
        ids = flat[ranges((np.cumsum(count) - count)[row], n)]
        ends_of_text = np.cumsum(np.bincount(text_of, weights=n, minlength=len(texts)).astype(np.int64))
        return np.split(ids, ends_of_text[:-1])


def offsets_of(text: str, lengths: np.ndarray) -> np.ndarray:
    """(start, end) characters of each token, from the tokens' lengths in bytes."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    char_of = np.cumsum((data & 0xC0) != 0x80) - 1
    ends = np.cumsum(lengths)
    return np.stack([char_of[ends - lengths], char_of[ends - 1] + 1], axis=1).astype("<u4") if len(ends) \
        else np.empty((0, 2), "<u4")


def token_bytes(model: str) -> list[bytes]:
    """The bytes of each id, by reversing the byte alphabet over the model's vocabulary."""
    import json

    back = {c: b for b, c in enumerate(byte_alphabet())}
    vocab = json.loads(model)["model"]["vocab"]
    out = [None] * (max(vocab.values(), default=-1) + 1)
    for token, i in vocab.items():
        out[i] = bytes(back[c] for c in token)
    return out


def _append(batch, made):
    keep = [c for c in batch.schema.names if c not in made]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made.values()], names=[*keep, *made])


def _parts(batches, text_name, size_limit=SLICE_BYTES):
    """Each batch in slices of about so many bytes, so that results stay small beside the heap."""
    for b in batches:
        size = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(b.column(text_name)), 0)))
        at = 0
        while at < b.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + size_limit, "right")))
            yield b.slice(at, to - at)
            at = to


def _encode_batches(batches, model, text_name, with_offsets):
    import os

    import pyarrow.compute  # noqa: F401

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encoder, lengths = None, None
    for b in _parts(batches, text_name):
        if encoder is None:
            encoder = Encoder(model.value)
            lengths = np.array([len(t or b"") for t in token_bytes(model.value)]) if with_offsets else None
        texts = [t or "" for t in b.column(text_name).to_pylist()]
        ids = encoder.encode(texts)
        made = {"n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids": pa.array([x.tobytes() for x in ids], pa.binary())}
        if with_offsets:
            made["offsets"] = pa.array([offsets_of(t, lengths[x]).tobytes() for t, x in zip(texts, ids)], pa.binary())
        yield _append(b, made)


def _default(path):
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken")


def _broadcast_model(spark, path):
    """The model's size is fixed by the vocabulary file, not by the data."""
    return spark.sparkContext.broadcast(model_json(load_ranks(path)))


def _schema(df, added):
    names = {f.name for f in added}
    return T.StructType([*[f for f in df.schema if f.name not in names], *added])


def encode(docs: DataFrame, text_col: str = "text", ranks_path: str | None = None,
           offsets: bool = False) -> DataFrame:
    """Add ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers in a binary), and if asked
    ``offsets`` (pairs of such integers: first and past-the-last character of each token)."""
    model = _broadcast_model(docs.sparkSession, _default(ranks_path))
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    added += [T.StructField("offsets", T.BinaryType())] * offsets
    return docs.mapInArrow(lambda it: trimmed(_encode_batches(it, model, text_col, offsets)), _schema(docs, added))


def _decode_batches(batches, model, ids_name):
    import pyarrow.compute  # noqa: F401

    tokens = None
    for b in _parts(batches, ids_name):
        if tokens is None:
            tokens = token_bytes(model.value)
            size = np.array([len(t or b"") for t in tokens], np.int64)
            start, data = np.cumsum(size) - size, np.frombuffer(b"".join(t or b"" for t in tokens), np.uint8)
        out = []
        for x in b.column(ids_name).to_pylist():
            ids = np.frombuffer(x or b"", "<u4")
            out.append(data[ranges(start[ids], size[ids])].tobytes())
        yield _append(b, {"decoded": pa.array(out, pa.binary())})


def decode(df: DataFrame, ids_col: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """Add ``decoded``, the bytes of the ids. Cast it to string for text: characters split over tokens
    are whole in the joined bytes; a slice of ids that begins or ends inside a character keeps its bytes."""
    model = _broadcast_model(df.sparkSession, _default(ranks_path))
    return df.mapInArrow(lambda it: trimmed(_decode_batches(it, model, ids_col)),
                         _schema(df, [T.StructField("decoded", T.BinaryType())]))


SQL = None


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs).drop("text")
    return decode(coded).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                                F.sha2("decoded", 256).alias("decoded_sha256"))
