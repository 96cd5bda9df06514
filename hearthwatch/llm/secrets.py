"""Secret scans: fixed patterns, and strings in sensitive contexts that a primed compressor finds new."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthwatch.llm.base import byte_slices, texts_of

# The base patterns, their least lengths, and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGNED = 8
KINDS = ("assign", "access", "hex", "novel")

SENSITIVE = re.compile(r"(?:pass(?:word|wd|phrase)|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential|authorization|bearer|signature)", re.IGNORECASE | re.ASCII)
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "authorization", "bearer", "signature")
LEAST = 16  # characters of a candidate at least
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~-]{16,}")
MARKS = "=+/_.~-"
PART = re.compile(r"[A-Za-z0-9]{16,}")
IDENTIFIER = re.compile(r"[A-Za-z0-9_-]*")
ASSIGNED = re.compile(r"""["'\])]*\s{0,8}[:=]""")
REACH = 48  # characters behind the identifier of a sensitive word in which a candidate begins
WORDS = 8  # sensitive words of one run up to which each one's whole tail is measured too, besides what stands between two words
PIECE = 1 << 14  # characters of a candidate that are compressed at a time
AROUND = 2048  # characters of surrounding text on either side that the compressor has seen
NOVEL = 0.6  # marginal compressed bytes per character, from which a string is new
IDENTIFIERS = (
    "password passwd passphrase secret token api_key apikey access_key private_key client_secret client_id credential "
    "authorization Authorization: Bearer Basic signature config configuration settings environment getenv process.env os.environ "
    "username user_name hostname localhost example.com http:// https:// www. .com .org .json .yaml .properties import from return "
    "function class public static final private void string String const let var None null true false self this new "
    "request response header headers content-type application/json database connection timeout endpoint region bucket "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000000000000000000000000000 "
    "xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx ................................ ________________________________ 1234567890123456 "
    "your_api_key your-token-here changeme placeholder CHANGE_ME example sample dummy test testing "
)


class Novelty:
    """Bytes that a candidate adds to its compressed surroundings, under a dictionary of identifiers."""

    def __init__(self, identifiers: str = IDENTIFIERS) -> None:
        import zstandard

        self.compressor = zstandard.ZstdCompressor(
            level=9, dict_data=zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False)

    def marginal(self, around: str, candidate: str) -> int:
        base = around.encode()
        return len(self.compressor.compress(base + b"\n" + candidate.encode())) - len(self.compressor.compress(base + b"\n"))


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping in each kind."""
    out = []
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def candidates(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans to be measured, by start and the longer first: behind each sensitive word the rest of its own run, and all
    runs that begin up to REACH behind its identifier; of each of them also what follows an inner `=`. What stands between
    two words of a run is always measured. The rest of an identifier that a value is assigned to is a name, and only
    measured if it has digits like a secret."""
    found, inside, near = set(), {}, []
    starts = [a for a, _ in runs]

    def add(a: int, b: int) -> None:
        found.add((a, b))
        found.update((at, b) for at in (text.find("=", a, b), text.rfind("=", a, b)) if at > a)

    def digits(a: int, b: int) -> int:
        return sum(c.isdigit() for c in text[a:b])

    for word in SENSITIVE.finditer(text):
        k = bisect_right(starts, word.end()) - 1
        if k >= 0 and word.end() < runs[k][1]:
            inside.setdefault(k, []).append(word.span())
        else:
            near.append(IDENTIFIER.match(text, word.end()).end())
    for k, spans in inside.items():
        # of a run with very many words the parts between two words are measured, and what follows the last one
        for _, end in spans if len(spans) <= WORDS else [*spans[:WORDS], spans[-1]]:
            at = IDENTIFIER.match(text, end, runs[k][1]).end()
            if digits(end, at) > 1 or not ASSIGNED.match(text, at):
                add(end, runs[k][1])
            add(at, runs[k][1])
            near.append(at)
        found.update((a, b) for (_, a), (b, _) in zip(spans, spans[1:]))
        near.append(runs[k][1])
    for at in near:
        k = bisect_left(starts, at)
        while k < len(runs) and starts[k] <= at + REACH:
            add(*runs[k])
            k += 1
    return sorted((s for s in found if s[1] - s[0] >= LEAST), key=lambda s: (s[0], -s[1]))


def outside(a: int, b: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of a span without the disjoint sorted spans `taken`."""
    out = []
    k = max(bisect_right(taken, (a,)) - 1, 0)
    while k < len(taken) and taken[k][0] < b:
        if taken[k][1] > a:
            out.append((a, taken[k][0]))
            a = taken[k][1]
        k += 1
    return [s for s in [*out, (a, b)] if s[1] - s[0] >= LEAST]


def copies(text: str, runs: list[tuple[int, int]], strings: set[str]) -> Iterator[tuple[int, int]]:
    """Where any of the strings stands in a run, leftmost and the longest first; time does not grow with their number."""
    lengths = {}
    for s in strings:
        lengths.setdefault(s[:LEAST], set()).add(len(s))
    lengths = {head: sorted(ls, reverse=True) for head, ls in lengths.items()}
    for a, b in runs:
        while a <= b - LEAST:
            size = next((n for n in lengths.get(text[a : a + LEAST], ()) if a + n <= b and text[a : a + n] in strings), 0)
            if size:
                yield a, a + size
            a += size or 1


def surroundings(text: str, a: int, b: int) -> str:
    """The text around a candidate, with copies of it or of a part of it that could be a candidate blanked."""
    own = text[a:b]
    parts = set(PART.findall(own))

    def blanked(side: str) -> str:
        for whole in {own, own.strip(MARKS)}:
            if len(whole) >= LEAST:
                side = side.replace(whole, " " * len(whole))
        return PART.sub(lambda m: " " * len(m[0]) if m[0] in parts else m[0], side) if parts else side

    reach = AROUND + len(own)  # copies may stand across the edge
    return blanked(text[max(0, a - reach) : a])[-AROUND:] + "\n" + blanked(text[b : b + reach])[:AROUND]


def novel_spans(text: str, low: str, base: list[tuple[int, int, int]], novelty: Novelty, least: float = NOVEL) -> list[tuple[int, int, int]]:
    """Candidates behind a sensitive word, as far as they are outside the base spans, that are new to the compressor given
    the identifiers and the text around them without their own copies; then all other places of these strings.

    Runs that follow a new one after white space only are candidates too, as are the lines of a key block.
    """
    if not any(h in low for h in HINTS) or not SENSITIVE.search(text):
        return []
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    taken = []
    for a, b, _ in base:
        if taken and a <= taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    new, starts = [], [a for a, _ in runs]

    def measured(a: int, b: int) -> bool:
        around = surroundings(text, a, b)
        fresh = sum(novelty.marginal(around, text[i : min(i + PIECE, b)]) for i in range(a, b, PIECE)) >= least * (b - a)
        if fresh:
            new.append((a, b))
            insort(taken, (a, b))
        return fresh

    for span in candidates(text, runs):
        for a, b in outside(*span, taken):
            while measured(a, b):
                k = bisect_left(starts, b)
                if k == len(runs) or not text[b : starts[k]].isspace() or outside(*runs[k], taken) != [runs[k]]:
                    break
                a, b = runs[k]
    strings = {text[a:b] for a, b in new} | {s for a, b in new if len(s := text[a:b].strip(MARKS)) >= LEAST}
    for a, b in copies(text, runs, strings) if new else ():
        if outside(a, b, taken) == [(a, b)]:
            new.append((a, b))
            insort(taken, (a, b))
    return [(a, b, 3) for a, b in sorted(new)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))


def secret_spans(docs: DataFrame, least: float = NOVEL, identifiers: str = IDENTIFIERS) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel) of every document; spans are kind:start:end in
    code points, comma-joined by start, then by kind as in KINDS.

    A NULL text is empty: no spans, the digest of nothing. Whole texts are searched, and runs of any length are measured
    and reported whole. Novel spans are all places of a string that is new in one; copies of it are taken out of the
    text around it first. Novelty alone decides, so a long word or path that nothing else in reach contains counts too. Repeated rows and NULL ids keep
    one row each; an empty table gives none; other columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(identifiers)
        for batch in byte_slices(batches):
            counts, digests, spans = [], [], []
            for text in texts_of(batch):
                low = text.lower()
                base = base_spans(text, low)
                new = novel_spans(text, low, base, novelty, least)
                counts.append([sum(k == i for *_, k in base) for i in range(3)] + [len(new)])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + new))
            n = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            yield pa.record_batch([batch.column("doc_id"), *n[:3], pa.array(digests), pa.array(spans), n[3]],
                                  ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")
