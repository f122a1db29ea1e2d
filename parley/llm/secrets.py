"""Secrets in texts: three fixed patterns, and random strings found by how badly they tokenise.

A byte-pair vocabulary spells ordinary words, even unknown ones, with several characters a token. A random
string has few, as hardly any merge applies. Candidates are all unbroken runs of 16 characters and more; known
digests (hexadecimal of the usual lengths), UUIDs and identifiers (parts that tokenise as words, joined by
underscores, hyphens, capitals or numbers) are set aside, so that checksums and names are not reported as secrets
of this kind; so are paths, whose parts between slashes are all short, dates and numbers, digests or identifiers.
Random strings of fewer than LEAST_CHARS characters are not told from words by their few tokens and not reported;
nor are most strings of digits alone, which the vocabulary spells in groups of several.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import blocks as B
from parley.llm.shared import kept, map_texts

KINDS = ("assign", "access", "hex", "random")
LEAST_CHARS = 16  # of a candidate for the token test
MOST_CHARS_PER_TOKEN = 2.2
WORD_CHARS_PER_TOKEN = 2.6  # of the letters of an identifier, part by part: random ones stay below
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST_CHARS)
#: Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE)
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.IGNORECASE)
_STAMP = re.compile(r"[0-9TZ_+-]+")
SHORT = 8  # characters of a path's part that tell nothing
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_IN_RUN = np.zeros(256, bool)
_IN_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True


class Vocabulary:
    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def chars_per_token(self, run: str) -> float:
        return len(run) / max(1, len(self.encoding.encode_ordinary(run)))


def vocabulary(path: str, pattern: str) -> Vocabulary:
    own = kept(__name__)
    if path not in own:
        own[path] = Vocabulary(path, pattern)
    return own[path]


def is_identifier(run: str, words: Vocabulary) -> bool:
    """The letters between marks, capitals and numbers tokenise as words do."""
    parts = _PARTS.findall(run)
    return bool(parts) and sum(map(len, parts)) > WORD_CHARS_PER_TOKEN * sum(len(words.encoding.encode_ordinary(p)) for p in parts)


def is_known(run: str, words: Vocabulary) -> bool:
    """Digests, UUIDs, identifiers and paths of these, which are no secrets however they tokenise."""
    if _DIGEST.fullmatch(run) or _UUID.fullmatch(run) or is_identifier(run, words):
        return True
    parts = [p for p in run.split("/") if p]
    return "/" in run and all(len(p) < SHORT or _STAMP.fullmatch(p) or is_known(p, words) for p in parts)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches that these spans cover, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def find_secrets(text: str, words: Vocabulary) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in _HEX.finditer(text) if len(m[0]) >= 32]
    taken, at = _merged([(s, e) for _, s, e in out]), 0
    for m in _RUN.finditer(text):  # both lists are in order
        run = m[0].rstrip("=")
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at < len(taken) and taken[at][0] < m.end():
            continue
        if re.search("[A-Za-z0-9]", run) and words.chars_per_token(run) <= MOST_CHARS_PER_TOKEN and not is_known(run, words):
            out.append(("random", *m.span()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _suspects(block: B.Block) -> np.ndarray:
    """Documents of the block in which some pattern may match: none of the others has a span."""
    data, offsets = block.data, block.offsets
    out = np.zeros(block.n_docs, bool)
    if not len(data):
        return out
    inside = _IN_RUN[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= LEAST_CHARS  # those of 32 hex digits too; runs may cross a document's end here, which only adds suspects
    for a, b in zip(starts[long], ends[long], strict=True):
        out[np.searchsorted(offsets, a, side="right") - 1 : np.searchsorted(offsets, b, side="left")] = True
    lower = data.tobytes().translate(_LOWER)
    for word in (*_ASSIGN_WORDS, b"akia"):
        at = lower.find(word)
        while at >= 0:
            doc = np.searchsorted(offsets, at, side="right") - 1
            out[doc] = True
            at = lower.find(word, max(at + 1, int(offsets[doc + 1]) - len(word) + 1))  # a word across two documents only adds a suspect
    return out


def spans_of(texts: pa.Array, words: Vocabulary) -> Iterator[tuple[int, list[str | None], list[list[tuple[str, int, int]]]]]:
    """By block: its first row, the texts in which there are spans (else None), and the spans."""
    for block in B.blocks(texts):
        found: list[list[tuple[str, int, int]]] = [[] for _ in range(block.n_docs)]
        kept: list[str | None] = [None] * block.n_docs
        for i in np.flatnonzero(_suspects(block)).tolist():
            text = block.data[block.offsets[i] : block.offsets[i + 1]].tobytes().decode(errors="replace")
            if spans := find_secrets(text, words):
                found[i], kept[i] = spans, text
        yield block.first, kept, found


def shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, vocabulary_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), one row for each row of ``docs``; null texts have no spans.

    Nothing is shuffled: each row's result depends on its text alone, so repeats and null ids need no rule. A very long
    text is searched whole, in a block of its own; other columns are not looked at.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("n_assign long, n_access long, n_hex long, base_sha256 string, spans string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(vocabulary_path, pattern)
        for batch in batches:
            for first, _, found in spans_of(batch.column("text"), words):
                columns = [[sum(k == kind for k, _, _ in spans) for spans in found] for kind in KINDS[:3]]
                columns += [[hashlib.sha256(shown([x for x in spans if x[0] != "random"]).encode()).hexdigest() for spans in found], [shown(spans) for spans in found]]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(found)), *map(pa.array, columns)], names=schema.names)

    return map_texts(docs, run, schema)


def redacted_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each maximal stretch of spans replaced by [SECRET]."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, vocabulary_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with secrets in ``text`` replaced; every row and column stays, null stays null."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(vocabulary_path, pattern)
        for batch in batches:
            column = batch.column(text)
            for first, kept, found in spans_of(column, words):
                own = batch.slice(first, len(found))
                fixed = [None if t is None else redacted_text(t, s) for t, s in zip(kept, found, strict=True)]
                mask = pa.array([t is not None for t in fixed])
                new = pc.if_else(mask, pa.array(fixed, column.type), own.column(text))
                yield pa.RecordBatch.from_arrays([new if name == text else own.column(name) for name in schema.names], names=schema.names)

    return map_texts(docs, run, schema)
