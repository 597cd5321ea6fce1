"""BPE encoding and decoding with forced boundaries.

A pair of neighbouring bytes that is inside no vocabulary token can never be merged, so a cut there is certain. Of
those pairs, two kinds also end every match of the splitting pattern, whatever stands around: those whose right byte
is ASCII white space and whose left byte is not, and those of an ASCII letter or digit and ASCII punctuation other than
the apostrophe. At them a text falls into fragments whose encodings do not depend on each other. Each fragment is
encoded once a worker and the results are concatenated.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import remembered, table, tidy, tokenizer, tokenizer_path

#: Fragments that a worker remembers at most; the memory is emptied when it is full.
REMEMBER = 250_000
WHITE = b"\t\n\x0b\x0c\r "
#: White space beyond ASCII. A text that has any is not cut after a byte of a longer character.
WIDE_WHITE = re.compile(r"[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


@functools.lru_cache(maxsize=1)
def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the others are
    numbered from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Fragments that are one match of the splitting pattern: the merges can be run on them alone.
ONE_MATCH = re.compile(r" ?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+|[!-&(-/:-@\[-`{-~]+)")


def as_letters() -> dict[int, int]:
    """For str.translate() on bytes read as Latin-1."""
    return {b: ord(c) for c, b in byte_letters().items()}


class Codec:
    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        letters = byte_letters()
        special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.token_bytes = {
            i: special[i].encode() if i in special else bytes(letters[c] for c in t) for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()
        }
        self.special = {t.encode(): i for i, t in special.items()}
        self.find_special = re.compile(b"(" + b"|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + b")") if special else None
        inside = np.zeros((256, 256), dtype=bool)
        for i, t in self.token_bytes.items():
            if i not in special:
                inside[list(t[:-1]), list(t[1:])] = True
        #: Pairs of bytes that no token holds.
        self.forced = ~inside
        white = np.zeros(256, dtype=bool)
        white[list(WHITE)] = True
        word = np.array([chr(i).isalnum() and i < 128 for i in range(256)])
        mark = np.array([32 < i < 127 and i != ord("'") for i in range(256)]) & ~word
        certain = self.forced & ((~white[:, None] & white[None, :]) | (word[:, None] & mark[None, :]))
        self.cuts = certain.ravel()
        self.ascii_cuts = (certain & (np.arange(256) < 128)[:, None]).ravel()
        self.letters = as_letters()
        self.known: dict[bytes, tuple[str, bytes, int]] = {}

    def fragments(self, text: bytes) -> list[bytes]:
        if len(text) < 2:
            return [text] if text else []
        b = np.frombuffer(text, dtype=np.uint8).astype(np.uint16)
        cuts = self.cuts
        if not text.isascii() and WIDE_WHITE.search(text.decode("utf-8", "replace")):
            cuts = self.ascii_cuts
        at = [0, *(np.flatnonzero(cuts[(b[:-1] << 8) | b[1:]]) + 1).tolist(), len(text)]
        return [text[i:j] for i, j in zip(at, at[1:])]

    def learn(self, fragments: list[bytes]) -> dict[bytes, tuple[str, bytes, int]]:
        out, hard = {}, []
        merge, letters = self.tokenizer.model.tokenize, self.letters
        for f in fragments:
            if ONE_MATCH.fullmatch(f.decode("utf-8", "replace")):
                out[f] = self._entry([x.id for x in merge(f.decode("latin-1").translate(letters))])
            else:
                hard.append(f)
        for i in range(0, len(hard), 4096):
            part = hard[i : i + 4096]
            for f, e in zip(part, self.tokenizer.encode_batch_fast([f.decode("utf-8", "replace") for f in part], add_special_tokens=False)):
                out[f] = self._entry(e.ids)
        return out

    def _entry(self, ids: list[int]) -> tuple[str, bytes, int]:
        return ",".join(map(str, ids)), b"".join([self.token_bytes[x] for x in ids]), len(ids)

    def pieces(self, text: bytes) -> list[tuple[str, bytes, int]]:
        """(ids, bytes of those ids, number of ids) for each fragment, in order."""
        parts = self.find_special.split(text) if self.find_special and self.find_special.search(text) else [text]
        out = []
        for part in parts:
            if part in self.special:
                i = self.special[part]
                out.append((str(i), self.token_bytes[i], 1))
                continue
            fragments = self.fragments(part)
            known = self.known
            try:
                out += [known[f] for f in fragments]
            except KeyError:
                new = self.learn([*{f for f in fragments if f not in known}])
                out += [known[f] if f in known else new[f] for f in fragments]
                if len(known) + len(new) > REMEMBER:
                    known.clear()
                if len(new) <= REMEMBER:
                    known.update(new)
        return out

    def encode(self, text: bytes) -> list[int]:
        return [int(i) for ids, _, n in self.pieces(text) if n for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        """Special tokens are kept; bytes that are no UTF-8 become replacement characters."""
        return b"".join(self.token_bytes[i] for i in ids if i in self.token_bytes).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """One codec for each Python worker."""
    kept = remembered("bpe")
    if path not in kept:
        kept[path] = Codec(path)
    return kept[path]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each input row: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded.

    Null and empty texts have no ids: n_tokens 0 and the digests of the empty string. Ids pass through as they are, null
    or repeated. Texts are read whole, a row at a time; an empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        c = codec(path)
        for b in batches:
            n, ids, decoded, lists, texts = [], [], [], [], []
            for t in b.column("text").to_pylist():
                pieces = c.pieces(t)
                n.append(sum(x[2] for x in pieces))
                joined = ",".join([x[0] for x in pieces if x[2]])
                back = b"".join([x[1] for x in pieces]).decode("utf-8", "replace")
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
                if with_ids:
                    lists.append([int(i) for i in joined.split(",")] if joined else [])
                    texts.append(back)
            columns = [b.column("id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(lists, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = slim.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return slim.mapInArrow(tidy(run), schema + (", ids array<int>, decoded string" if with_ids else ""))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
