"""Secrets: fixed patterns, and strings in a sensitive context that zstandard finds new.

A candidate is a run of token characters, with letters and digits or (where it
is long) both cases, that begins within ``REACH`` code points after a sensitive word.  Its
novelty is what it adds to the compressed size of the code around it, by a
compressor that is primed with a dictionary of identifiers, for each of its
bytes.  Names, paths, words and repeated values cost a few bytes for a match; a
random string costs nearly one byte each.  What costs ``NOVEL`` or more and
takes ``LEAST_ADDED`` bytes is reported as kind ``novel`` where it touches no
pattern's span.

The identifier dictionary holds words of code (in the module) and the most
frequent lower-case words of all documents, counted in the tasks that read them
and added by Spark; it has at most ``WORDS`` words of 4 to 20 letters, so its
size is bounded, and random strings hold no such words that are frequent.

Cases: a null or empty text has no spans; repeated rows are read each; matches
of one kind never overlap, those of two may; very long texts and runs take
linear time (a run beyond ``LONGEST`` characters is data and no key); a null
doc_id keeps its row; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.wordhash import slices, tidy

KINDS = ("assign", "access", "hex", "novel")
#: Words of the dictionary taken from the documents.
WORDS = 2_048
REACH, AROUND = 48, 256
LEAST, LONGEST = 12, 512
NOVEL, LEAST_ADDED = 0.85, 10
#: Distinct words of a task that are counted before they are sent.
HELD = 200_000
_START = 512

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{16,}")
_CONTEXT = re.compile(r"passw|passphrase|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|client[_ -]?key|credential|auth(?!or(?!i[sz]))|bearer|signature|connection[_ -]?string", re.ASCII | re.IGNORECASE)
_CONTEXT_HINTS = ("passw", "passphrase", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "signature", "connection")
_RUN = re.compile(r"[A-Za-z0-9+/=_.~-]{%d,}" % LEAST, re.ASCII)
_DIGIT, _LETTERS = re.compile("[0-9]"), re.compile("[A-Za-z].*[A-Za-z]")
_WORD = re.compile("[a-z]{4,20}")

# Common identifiers and words of code and configuration.
IDENTIFIERS = (
    "return function const import export default class public private protected static final void string boolean integer object array "
    "self this null none true false print console logger debug error warning exception raise throw catch finally while break continue "
    "username password passphrase secret token access_token refresh_token api_key apiKey client_id client_secret private_key public_key "
    "authorization authenticate authentication Authorization Bearer Basic Content-Type application/json credentials certificate signature "
    "config configuration settings environment environ variable process.env os.environ getenv get_secret get_token getToken setToken "
    "createUser updateUser deleteUser getUserById request response session cookie header headers payload message encode decode base64 "
    "http https localhost www.example.com 127.0.0.1 host hostname port database connection connectionString server client service endpoint "
    "version number 0123456789 2019 2020 2021 2022 2023 2024 2025 hash algorithm checksum digest sha256 sha512 md5 uuid rsa aes ssh-rsa utf-8 main test tests example sample "
    "placeholder changeme your_token_here your_api_key xxxxxxxxxxxxxxxx ****************"
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the patterns' matches that hold, in order of start, then kind."""
    out = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs in a sensitive context that could be a key, by their place; they never overlap."""
    low = text.lower()
    if not any(h in low for h in _CONTEXT_HINTS):
        return []
    out, at = [], 0
    while word := _CONTEXT.search(text, at):
        at = word.end()
        reach = at + REACH
        while (run := _RUN.search(text, at, reach + LEAST)) and run.start() < reach:
            a = run.start()
            at = b = _RUN.match(text, a).end()  # the whole run, which is not read again
            while a < b and text[a] in "=.~":
                a += 1
            while b > a and text[b - 1] in ".-~":
                b -= 1
            own = text[a:b]
            if LEAST <= b - a <= LONGEST and _mixed(own):
                out.append((a, b))
    return out


def _mixed(run: str) -> bool:
    """Two letters and a digit; or, in a long run, both cases."""
    return bool(_DIGIT.search(run) and _LETTERS.search(run) or len(run) >= 20 and run.lower() != run and run.upper() != run)


class Novelty:
    """Marginal compressed bytes against a dictionary and the text around, in lower case."""

    def __init__(self, dictionary: bytes) -> None:
        dictionary = dictionary.lower()
        # Literals stay bytes, whatever their alphabet: the fast strategy with a target length codes only what repeats.
        how = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_FAST, target_length=1, min_match=4, hash_log=17, window_log=18, write_content_size=0)
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(compression_params=how)
        self.code = zstandard.ZstdCompressor(dict_data=primed, compression_params=how)
        # One long match: with it every block is a compressed one, so that short strings are measured like long ones.
        self.start = dictionary[-_START:]
        # No match begins in a block's last bytes: both blocks end alike.
        self.end = b"\n" + self.start[:16]

    def added(self, text: str, a: int, b: int) -> int:
        """Bytes that text[a:b] adds to what stands around it, where its own repeats are left out."""
        own = text[a:b].lower().encode()
        around = (text[max(0, a - AROUND) : a] + "\n" + text[b : b + AROUND]).lower().encode("utf-8", "replace").replace(own, b"")
        before = self.start + around + b"\n"
        return len(self.code.compress(before + own + self.end)) - len(self.code.compress(before + self.end))

    def novel(self, text: str, a: int, b: int) -> bool:
        added = self.added(text, a, b)
        return added >= LEAST_ADDED and added >= NOVEL * (b - a)


def all_spans(code: Novelty, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The patterns' spans and all spans, both in order."""
    base = base_spans(text)
    more, i, reach = [], 0, 0
    for a, b in candidates(text):
        while i < len(base) and base[i][0] < b:
            reach = max(reach, base[i][2])
            i += 1
        if reach <= a and code.novel(text, a, b):
            more.append((a, 3, b))
    return base, sorted(base + more)


@tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[str] = Counter()

    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column("text"):
            total.update(_WORD.findall(text.as_py() or ""))
            if len(total) >= HELD:
                yield sent()
                total.clear()
    if total:
        yield sent()


def identifier_dictionary(documents: DataFrame, words: int = WORDS) -> bytes:
    """The module's identifiers after the documents' most frequent words, the rarest first: what is near the end is cheapest to refer to."""
    seen = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "word string, n long")
    top = seen.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(words)
    return " ".join([*(r["word"] for r in reversed(top.collect())), IDENTIFIERS]).encode()  # ``words`` rows of at most 20 letters


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


@tidy
def _find(batches: Iterator[pa.RecordBatch], dictionary: bytes) -> Iterator[pa.RecordBatch]:
    code = Novelty(dictionary)
    for batch in batches:
        for part in slices(batch):
            rows = [all_spans(code, text.as_py() or "") for text in part.column("text")]
            count = [[sum(k == kind for _, k, _ in base) for base, _ in rows] for kind in range(3)]
            cols = [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in count)]
            cols += [pa.array([len(s) - len(b) for b, s in rows], pa.int64()), pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in rows], pa.string()), pa.array([_joined(s) for _, s in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])


def find_secrets(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """One row for each document: doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans (kind:start:end)."""
    dictionary = identifier_dictionary(documents, words)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(partial(_find, dictionary=dictionary), "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")
