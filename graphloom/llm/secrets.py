"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty.

The base patterns are reported as they match. Beyond them, a candidate is an unbroken run
of key characters close after a word that announces a credential. Its novelty is the
number of bytes it adds to a zstandard frame primed with the surrounding code and with
words that usually name things: text that the dictionary or the surroundings explain
costs little, random key material costs nearly its entropy. A long candidate is costed in
pieces, since zstandard entropy-codes longer literals and would price an alphabet instead.
A found run goes on over dots and line ends as long as novel runs follow.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .kernels import text_of, text_slices

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_ANNOUNCES = re.compile(r"(?ai:passw(?:or)?d|passwd|pwd|secret|token|api[_\- ]?key|access[_\- ]?key|private[_\- ]?key|credential|bearer|authorization|auth|signature)")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=\-]{16,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=\-]+")
_LINE = re.compile(r"\r?\n[ \t]*([A-Za-z0-9+/_=\-]+)(?=[ \t]*\r?(?:\n|\Z))")
_DOTTED = re.compile(r"\.(?:[A-Za-z0-9+/_=\-]{1,15}\.){0,2}([A-Za-z0-9+/_=\-]{16,})")
#: Characters of a candidate that are costed at once; literals of 64 bytes and more are entropy-coded.
PIECE = 48
#: Characters between an announcing word and a candidate, and around a candidate that prime the frame.
REACH, AROUND = 48, 2048
#: A candidate is reported if it adds at least this many bytes a character.
NOVELTY = 0.8
#: Words that name things in code and configuration; they prime every frame.
IDENTIFIERS = """
access account action address admin agent algorithm allow amount api app application args array async attribute auth authorization
await backend backup base batch bearer bin block body bool boolean branch bucket buffer build bytes cache call callback catch certificate
channel char check class client close cluster code column command comment commit common compile component config configuration connect
connection console const constant container content context control cookie count create credential current cursor data database date debug
default define delete deploy description device dict digest directory document domain double download driver element email enable encode
encrypt endpoint entry enum environment error event exception execute expire export expression false field file filter final finally flag
float folder format frame from function generate get global group handler hash header hidden host html http https identifier image import
index info init input insert install instance int integer interface internal interval item iterator java javascript job join json key
label lambda language layer length level library limit line link list listener load local location lock log login long loop machine main
manager map master match memory message meta method model module mount name namespace network node null number object offset open option
order output owner package page panel parameter parse parser password path pattern payload permission phone pipeline plugin point policy
pool port position post prefix print priority private process profile project property protected protocol provider proxy public publish
query queue random range read record reference region register release remote remove replace report repository request require reset
resource response result return role root route router row runtime sample schedule schema scope script search secret section secure select
self send sequence server service session set setting setup shard shared signature size socket source spec split stack stage start state
static status step storage store stream string struct style submit suffix super sync system table target task template test text thread
throw time timeout timestamp title token tool trace track transaction transform true type undefined union unique unit update upload url
user username util value variable vector version view void volume web widget width window worker write xml yaml zone
""".encode()


def _cost(dictionary: bytes, text: bytes) -> int:
    primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_dict_id=False).compress(text))


def novelty(before: str, candidate: str, after: str) -> float:
    """Bytes a character that ``candidate`` adds to frames primed with its surroundings and the identifiers, in pieces of ``PIECE`` at most."""
    n, k = len(candidate), max(1, -(-len(candidate) // PIECE))
    total = 0
    for i in range(k):
        lo, hi = n * i // k, n * (i + 1) // k
        primer = (before + candidate[:lo])[-AROUND:] if lo < AROUND else candidate[lo - AROUND : lo]
        dictionary = IDENTIFIERS + after.encode("utf-8", "replace") + primer.encode("utf-8", "replace")
        lead = primer[-32:].encode("utf-8", "replace") or b" "
        total += _cost(dictionary, lead + candidate[lo:hi].encode()) - _cost(dictionary, lead)
    return total / max(1, n)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed patterns, by start and then kind; offsets count code points."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _mixed(value: str) -> bool:
    """A key has digits, and capitals or small letters."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def _is_novel(text: str, a: int, b: int, least: float) -> bool:
    return _mixed(text[a:b]) and novelty(text[max(0, a - AROUND) : a], text[a:b], text[b : b + AROUND]) >= least


def _extended(text: str, a: int, b: int, least: float) -> int:
    """The end of the key whose first run is ``a:b``: novel runs behind a dot or on whole lines of their own belong to it."""
    width = b - a
    while True:
        if (m := _DOTTED.match(text, b)) and _is_novel(text, *m.span(1), least):
            b, width = m.end(), len(m[1])
        elif (m := _LINE.match(text, b)) and len(m[1]) >= 16 and _is_novel(text, *m.span(1), least):
            b, width = m.end(), len(m[1])
        elif m and width >= 32 and len(m[1]) < 16 and (m[1].endswith("=") or _mixed(m[1])):
            # The rest of a block of full lines.
            return m.end()
        else:
            return b


def _covered(base: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans (ordered by start) cover together, as disjoint stretches in order."""
    starts: list[int] = []
    ends: list[int] = []
    for _, s, e in base:
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def novel_spans(text: str, base: list[tuple[str, int, int]], least: float = NOVELTY) -> list[tuple[str, int, int]]:
    """Incompressible key-like runs in a sensitive context that no base span overlaps, with what adjoins them."""
    found, done = [], -1
    starts, ends = _covered(base)
    for word in _ANNOUNCES.finditer(text):
        at = max(word.end(), done)
        # A run that starts within reach is seen with its first 16 characters, wherever it ends.
        while m := _CANDIDATE.search(text, at, min(len(text), word.end() + REACH + 16)):
            a = m.start()
            at = b = _RUN.match(text, a).end()
            if a <= done:
                continue
            done = b
            # Of the stretches that start before b, the last one reaches furthest.
            if (i := bisect_left(starts, b)) and ends[i - 1] > a:
                continue
            if _is_novel(text, a, b, least):
                at = done = _extended(text, a, b, least)
                found.append(("novel", a, done))
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans`` for every row; a null text counts as empty.

    Repeated rows give repeated results, and an empty table an empty one. Bytes that aren't
    UTF-8 count as U+FFFD. A text is searched whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for _, offsets, data in text_slices(batch.column(1)):
                raw = data.tobytes()
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    text = text_of(raw[a:b])
                    base = base_spans(text)
                    every = sorted(base + novel_spans(text, base), key=lambda s: (s[1], KINDS.index(s[0])))
                    counts.append([sum(s[0] == k for s in every) for k in KINDS])
                    digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    spans.append(joined(every))
            columns = list(zip(*counts, strict=True)) or [[]] * len(KINDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")
