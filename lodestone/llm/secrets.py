"""Secret scans by a recursive decoding worklist.

Three base patterns are searched in a text.  Then every encoded part is unwrapped into a layer: percent, Unicode and
character escapes, of which those that others make are unwrapped too, into a copy of the whole text; base64, in all
four alignments of a run, and in lines of equal width also as a whole; and compressed streams among decoded bytes.
Each layer is scanned and unwrapped in the same way, until no new layer appears.  A layer that was already seen for
the same part of the text is not entered again, so decoders that reproduce their input end.

A layer knows of each of its characters which part of the original text it stands for, and a span is reported as
the parts of its characters, from the first to the last: escapes and base64 are mapped to the character, what is in
a compressed stream to the whole stream.  Bytes are read as Latin-1, as all patterns are ASCII; so bytes that are not
UTF-8 hide nothing beside them.

Defined results: a null text is an empty one and has no spans; equal spans are reported once; repeated rows each
get a result.  Escapes that name no character stand for one unknown one.  All members of compressed streams are read
to their end, WINDOW bytes at a time; windows overlap by OVERLAP bytes, so a key with its spaces, or an encoded part
inside of a stream, that is longer than that may be missed where a window ends.  Work is in proportion to the text
and what is unwrapped from it, also without spaces.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a decompressed stream that are scanned at once, and that two neighbouring windows share.
WINDOW, OVERLAP = 4 << 20, 256 << 10
#: The base kinds, in the order in which equal starts are listed, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, those of 16 and more
_NAMES = ("passw", "secret", "token", "api")

_ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}|(?:%u|\\u)[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_LONGEST = 10
#: Characters that can be part of an escape.
_ACTIVE = frozenset("%\\&#;{}uxX0123456789abcdefABCDEF")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_NEXT_LINE = re.compile(r"[ \t]*\r?\n[ \t]*([A-Za-z0-9+/_-]+={0,2})")
#: How gzip, zlib, bzip2 and xz streams begin.
_MAGIC = re.compile(rb"(\x1f\x8b\x08)|(x[\x01\x5e\x9c\xda])|(BZh[1-9])|(\xfd7zXZ\x00)")
#: Without any of these decoded bytes hold neither a base pattern nor an encoded part.
_WORTH = re.compile(r"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{16}|\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ|[A-Za-z0-9+/_-]{16}|" + _ESCAPE.pattern)
#: A text without any of these, and without a run of base64, has no layers.
_SIGNS = ("%", "\\u", "\\x", "&#", "\x1f\x8b\x08", "x\x01", "x^", "x\x9c", "x\xda", "BZh", "\xfd7zXZ")


@dataclass
class Layer:
    """A text and where the part of the original text begins and ends that each of its characters stands for."""

    text: str
    start: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, text: str) -> Layer:
        places = np.arange(len(text) + 1)
        return cls(text, places[:-1], places[1:])


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) of the base patterns' matches, ascending, ends excluded, in code points."""
    found = []
    small = text.lower()
    if any(x in small for x in _NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _character(escape: str) -> str:
    digits = escape.strip("%\\u{}x&#X;")
    code = int(digits, 10 if escape[0] == "&" and escape[2] not in "xX" else 16)
    return "\ufffd" if 0xD800 <= code < 0xE000 or code > 0x10FFFF else chr(code)


def _unescaped(layer: Layer) -> Layer | None:
    """The layer without escapes, those that others make included; None if it has none.

    One pass: where a new character completes an escape with those before and after it, that is unwrapped at once."""
    text, at = layer.text, 0
    if not _ESCAPE.search(text):
        return None
    parts: list[str] = []
    starts, ends = [], []  # of whole parts, as places in the layer
    last: list[tuple[str, int, int]] = []  # the characters before `at` that an escape may still take in

    def settle(keep: int) -> None:
        if len(last) > keep:
            done = last[: len(last) - keep]
            del last[: len(last) - keep]
            parts.append("".join(c for c, _, _ in done))
            starts.append(np.array([a for _, a, _ in done]))
            ends.append(np.array([b for _, _, b in done]))

    def plain(upto: int) -> None:
        nonlocal at
        if upto - at > _LONGEST:
            settle(0)
            parts.append(text[at : upto - _LONGEST])
            starts.append(np.arange(at, upto - _LONGEST))
            ends.append(np.arange(at + 1, upto - _LONGEST + 1))
            at = upto - _LONGEST
        last.extend((text[k], k, k + 1) for k in range(at, upto))
        at = upto

    while m := _ESCAPE.search(text, at):
        plain(m.start())
        at = m.end()
        last.append((_character(m[0]), m.start(), at))
        while last[-1][0] in _ACTIVE:
            before = last[-_LONGEST:]
            near = "".join(c for c, _, _ in before) + text[at : at + _LONGEST]
            made = next((x for k in range(len(before)) if (x := _ESCAPE.match(near, k)) and x.end() >= len(before)), None)
            if made is None:
                break
            at += made.end() - len(before)
            begin = before[made.start()][1]
            del last[len(last) - len(before) + made.start() :]
            last.append((_character(made[0]), begin, at))
        if len(last) > 1 << 12:
            settle(_LONGEST)
    plain(len(text))
    settle(0)
    return Layer("".join(parts), layer.start[np.concatenate(starts)], layer.end[np.concatenate(ends) - 1])


def _runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Base64 in a text, as the (start, end) of its lines: every run, and runs over lines of equal width.

    A shorter last line may belong to the run or not."""
    lined = 0
    for m in _RUN.finditer(text):
        yield [m.span()]
        if m.start() < lined:
            continue
        lines = [m.span()]
        while text[lines[-1][1] - 1] != "=" and (n := _NEXT_LINE.match(text, lines[-1][1])):
            lines.append(n.span(1))
        lined = lines[-1][1]
        run: list[tuple[int, int]] = []
        for line in [*lines, (lined, lined)]:
            width = line[1] - line[0]
            if run and width != run[0][1] - run[0][0]:
                if 0 < width < run[0][1] - run[0][0]:
                    yield [*run, line]
                if len(run) > 1:
                    yield run
                run = []
            run.append(line)


def _decoded(layer: Layer) -> Iterator[Layer]:
    """What each run of base64 holds in each of its alignments, where that is worth a look."""
    for lines in _runs(layer.text):
        whole = "".join(layer.text[a:b] for a, b in lines)
        body = whole.rstrip("=").translate({45: 43, 95: 47})
        for skip in range(4):
            size = len(body) - skip
            size -= size % 4 == 1
            text = base64.b64decode(body[skip : skip + size] + "=" * (-size % 4)).decode("latin-1")
            if not _WORTH.search(text):
                continue
            places = np.concatenate([np.arange(a, b) for a, b in lines])
            bits = 8 * np.arange(len(text))
            start, end = layer.start[places[skip + bits // 6]], layer.end[places[skip + (bits + 7) // 6]]
            end[-1] = layer.end[places[-1]]  # with its padding
            yield Layer(text, start, end)


def _windows(unpack, data: bytes, at: int) -> Iterator[tuple[bytes, int]]:
    """What an unpacker makes of data from a place on, at most WINDOW bytes at a time, each with the place it has come
    to.  What comes before damage counts.  Data are fed in growing pieces, as most that look like a stream are none."""
    held, size, left, step = [], 0, b"", 256
    try:
        while not unpack.eof and (left or at < len(data) or size == WINDOW):
            if not left and getattr(unpack, "needs_input", True):
                left, at, step = data[at : at + step], at + step, min(4 * step, 1 << 20)
            held.append(unpack.decompress(left, WINDOW - size))
            left = getattr(unpack, "unconsumed_tail", b"")
            size += len(held[-1])
            if size == WINDOW:
                yield b"".join(held), min(at, len(data)) - len(left) - len(unpack.unused_data)
                held, size = [], 0
    except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
        pass
    if size:
        yield b"".join(held), min(at, len(data)) - len(left) - len(unpack.unused_data)


def _unpacked(layer: Layer, data: bytes) -> Iterator[Layer]:
    """What compressed streams among a layer's bytes hold, members that follow one another together."""
    at, ended, tail, before = 0, -1, b"", None
    while m := _MAGIC.search(data, at):
        kind = m.lastindex
        unpack = zlib.decompressobj(31 if kind == 1 else 15) if kind < 3 else bz2.BZ2Decompressor() if kind == 3 else lzma.LZMADecompressor()
        start, at = m.start(), m.start() + 1
        if data[ended:start].strip(b"\0"):  # xz streams may be padded
            tail = b""
        for out, end in _windows(unpack, data, start):
            held, size = tail + out, (len(tail) + len(out),)
            starts = np.broadcast_to(layer.start[start], size)
            if tail and before != start:
                starts = np.concatenate([np.full(len(tail), layer.start[before]), starts[: len(out)]])
            tail, before = held[-OVERLAP:], before if tail and len(held) <= OVERLAP else start
            yield Layer(held.decode("latin-1"), starts, np.broadcast_to(layer.end[end - 1], size))
            if unpack.eof:
                at = ended = end


def _layers(layer: Layer) -> Iterator[Layer]:
    """Each layer that one holds directly."""
    if (plain := _unescaped(layer)) is not None:
        yield plain
    yield from _decoded(layer)
    yield from _unpacked(layer, layer.text.encode("latin-1", "replace"))


def all_spans(text: str) -> list[tuple[int, int, str]]:
    """Base spans and those of every layer, mapped to the text, ascending and once each."""
    found, seen = set(base_spans(text)), set()
    work = [_layers(Layer.of(text))] if any(x in text for x in _SIGNS) or _RUN.search(text) else []
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        key = (hashlib.blake2b(layer.text.encode(), digest_size=16).digest(), int(layer.start[0]), int(layer.end[-1])) if layer.text else None
        if key is None or key in seen:
            continue
        seen.add(key)
        found.update((int(layer.start[s]), kind, int(layer.end[e - 1])) for s, kind, e in base_spans(layer.text))
        work.append(_layers(layer))
    return sorted(found)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str, mark: str = "[REDACTED]") -> str:
    """text with every span, overlapping ones together, replaced by a mark."""
    out, at = [], 0
    for start, _, end in all_spans(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_spans, spans (array of kind, start, end)."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column("text")]
            base, every = [base_spans(x) for x in texts], [all_spans(x) for x in texts]
            counts = [pa.array([sum(k == kind for _, k, _ in spans) for spans in base], pa.int64()) for kind in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(map(shown, base), span), pa.array(map(shown, every), span)], ["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans"])

    kind = "array<struct<kind: string, start: long, end: long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, n_assign long, n_access long, n_hex long, base_spans {kind}, spans {kind}")


def redact(docs: DataFrame) -> DataFrame:
    """docs with secrets in `text` replaced; n_chars, where it is a column, counts the new text; other columns stay."""
    names = docs.columns
    at = names.index("text")
    count = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = [x.as_py() for x in batch.column(at)]
            after = [x and redacted(x) for x in before]
            columns = list(batch.columns)
            columns[at] = pa.array(after, columns[at].type)
            if count is not None:
                old = columns[count].to_pylist()
                columns[count] = pa.array([n if a == b else len(b) for n, a, b in zip(old, before, after, strict=True)], columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
